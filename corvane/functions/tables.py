"""Table functions for SQL: chunks and augmented chunks by LATERAL."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

_PARTS = StructType([StructField("seq", IntegerType()), StructField("part", StringType())])


def chunker(default_width: int = 1000):
    """A table function (text [, width]) to (seq, part): consecutive slices of code points; none of a null or empty text."""

    class Chunks:
        def eval(self, text: str, width: int = default_width) -> Iterator[tuple[int, str]]:
            if width is None or width < 1:
                raise ValueError("width must be at least 1")
            for k, at in enumerate(range(0, len(text or ""), width)):
                yield k, text[at : at + width]

    return udtf(Chunks, returnType=_PARTS)


def augmenter(rule: Callable[[str], Iterable[str]]):
    """A table function (text) to (seq, part): the texts that ``rule`` makes of one; none of a null."""

    class Augmented:
        def eval(self, text: str) -> Iterator[tuple[int, str]]:
            if text is not None:
                yield from enumerate(rule(text))

    return udtf(Augmented, returnType=_PARTS)


def halves(text: str) -> list[str]:
    """A text and, if it has two words or more, its first and last half by words: a small augmentation."""
    words = re.findall(r"\S+", text)
    k = len(words) // 2
    return [text, " ".join(words[:k]), " ".join(words[k:])] if k else [text]


def register(spark: SparkSession, width: int = 1000, rule: Callable[[str], Iterable[str]] = halves) -> None:
    """Makes chunk_text, augment_text (Python) and chunk_rows (built-in functions alone, for large tables) known to SQL."""
    spark.udtf.register("chunk_text", chunker(width))
    spark.udtf.register("augment_text", augmenter(rule))
    # the slices of a text are one linear pass of a pattern, as in operators/chunks.py
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION chunk_rows(body STRING, width INT) RETURNS TABLE (seq INT, part STRING) "
        "RETURN SELECT s, p FROM (SELECT posexplode(regexp_extract_all(body, concat('(?s)(.{1,', width, '})'), 1)) AS (s, p))"
    )
