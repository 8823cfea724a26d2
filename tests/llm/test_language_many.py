import random
import time

from pyspark.sql import functions as F

from corvane.llm import language_id as L


def test_two_hundred_languages(spark):
    """Plans don't grow with the number of declared values."""
    rng = random.Random(1)
    words = {f"x{k:03}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(12)] for k in range(200)}
    rows = [(2 * k + j, " ".join(rng.choices(words[x], k=30)), x, f"h{k % 7}") for k, x in enumerate(words) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    L.language_id(df.where("doc_id < 20"), declared=F.col("lang"), host=F.col("host"), keep=("doc_id",)).collect()
    begun = time.time()
    got = {r.doc_id: r.language for r in L.language_id(df, declared=F.col("lang"), host=F.col("host"), keep=("doc_id",)).collect()}
    assert time.time() - begun < 30 and got == {r[0]: r[2] for r in rows}


def test_rare_declared_values_are_missing_evidence(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_LANGUAGES", 2)
    say = {"en": "the house and the garden with the old tree", "de": "das haus und der garten mit dem alten baum"}
    rows = [(k, f"{say[x]} {k}", x) for k, x in enumerate(["en", "de"] * 20)] + [(90 + k, f"{say['de']} a", f"junk{k}") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.language for r in L.language_id(df, declared=F.col("lang")).where("doc_id >= 90").collect()} == {"de"}
