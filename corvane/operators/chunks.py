"""Documents to chunks: fixed-width cutting, filters, expansion."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.functions.text import strip

#: Default chunk width, width of the example pipeline, least stripped length.
WIDTH, EXAMPLE_WIDTH, MIN_LEN = 1000, 512, 20


def chunk(docs: DataFrame, max_chars: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Consecutive slices of ``max_chars`` code points: id, doc_id, seq, text, tokens (null), metadata (null).

    A null or empty text has no chunk. One linear pass per text.
    """
    if max_chars < 1:
        raise ValueError("max_chars must be at least 1")
    parts = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s)(.{{1,{max_chars}}})"), F.lit(1))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("seq", "text"))
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("seq").cast("string")).alias("id"), "doc_id", "seq", "text", F.lit(None).cast("int").alias("tokens"), F.lit(None).cast("map<string,string>").alias("metadata"))


def min_len(chunks: DataFrame, least: int = MIN_LEN) -> DataFrame:
    """Keeps chunks of at least ``least`` code points without outer white space; their text stays as it is."""
    return chunks.where(F.length(strip(F.col("text"))) >= least)


def apply_filter(chunks: DataFrame, rule: Callable[[Column], Column]) -> DataFrame:
    """rule: text to a text, or to null to drop the chunk."""
    return chunks.withColumn("text", rule(F.col("text"))).where(F.col("text").isNotNull())


def augment(chunks: DataFrame, rule: Callable[[Column], Column]) -> DataFrame:
    """rule: text to an array of texts, each a chunk of its own."""
    rows = chunks.select(F.struct("*").alias("row"), F.posexplode(rule(F.col("text"))).alias("k", "part"))
    own = {"id": F.concat("row.id", F.lit("."), F.col("k").cast("string")).alias("id"), "text": F.col("part").alias("text")}
    return rows.select(*[own.get(c, F.col(f"row.`{c}`")) for c in chunks.columns])


def compatible(left: DataFrame, right: StructType) -> bool:
    """Whether a block that takes ``right`` can follow one that gives ``left``."""
    have = {f.name: f.dataType for f in left.schema}
    return all(have.get(f.name) == f.dataType for f in right)


@dataclass(frozen=True)
class Block:
    """A step from rows to rows, with the columns that it needs."""

    name: str
    takes: StructType
    run: Callable[[DataFrame], DataFrame]


def connect(rows: DataFrame, *blocks: Block) -> DataFrame:
    """The blocks one after the other. One that can't follow is an error when the plan is made, before any row is read."""
    before = "the input"
    for block in blocks:
        if not compatible(rows, block.takes):
            raise TypeError(f"{block.name} can't follow {before}: it takes {block.takes.simpleString()}")
        rows, before = block.run(rows), block.name
    return rows
