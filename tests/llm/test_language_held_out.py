from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.llm import packing
from corvane.llm.language_id import language_id

DATA = Path("/root/testdata/sf0.01/documents.parquet")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_held_out_rows(spark):
    """Rows that the model isn't fitted on: their languages are hidden and must be found by the text and by all evidence."""
    docs = spark.read.parquet(str(DATA)).withColumn("held", F.pmod(F.xxhash64("text"), F.lit(4)) == 0)
    out = language_id(docs, declared=F.when(~F.col("held"), F.col("lang")), host=F.col("source")).where("held and n_chars >= 200").collect()
    assert len(out) > 100
    for column in ("text_language", "language"):
        assert sum(r[column] == r.lang for r in out) > 0.9 * len(out), column


def test_long_repeated_tied_and_clashing(spark):
    say = {"en": "the house and the garden with the old tree was there ", "de": "das haus und der garten mit dem alten baum war dort "}
    rows = [(k, say[x] * (1 + k % 3), x, "was", 0.5) for k, x in enumerate(["en", "de"] * 20)]
    rows += [(100, say["de"] * 20_000, None, "was", 0.5)] + [(101, say["en"], None, None, None)] * 3 + [(None, "zz", None, None, None), (102, "", "en", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, language string, confidence double")
    out = language_id(df, declared=F.col("lang"))
    assert out.columns == ["doc_id", "text", "lang", "language", "confidence", "text_language", "rejected"] and out.count() == len(rows)
    got = out.collect()
    assert {r.language for r in got if r.doc_id == 100} == {"de"} and [r.language for r in got if r.doc_id == 101] == ["en"] * 3
    assert all(0 < r.confidence <= 1 for r in got if not r.rejected and r.text.strip()) and {r.rejected for r in got if r.doc_id == 102} == {True}
    kept = language_id(df, declared=F.col("lang"), keep=("doc_id", "doc_id", "confidence"))
    assert kept.columns == ["doc_id", "language", "confidence", "text_language", "rejected"]
    assert sorted((str(r.doc_id), r.language) for r in kept.collect()) == sorted((str(r.doc_id), r.language) for r in got)
    same = spark.createDataFrame([(k, "abc abc", x) for k, x in enumerate(["b", "a"] * 5)] + [(50, "abc abc", None)], "doc_id long, text string, lang string")
    assert language_id(same, declared=F.col("lang")).where("doc_id = 50").first().text_language == "a"  # a tie: the first by name


def test_packing_with_many_salts_and_full_pieces(spark, monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(packing, "SORTED", 3)
    rows = [(k, "a " * (k % 5)) for k in range(120)] + [(None, "a " * 64)] * 4 + [(500 + k, None) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = packing.best_fit_packing(docs, tokenizers.path("word_bpe_49k.json"), 8).collect()
    assert sum(r.length for r in got) == sum((t or "").count("a") + 1 for _, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 8
    assert len(by) == -(-sum(r.length for r in got) // 8)
