import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path, rows, items, **more):
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.withColumns({k: F.lit(v) for k, v in more.items()}).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names and out.count() == 0


def test_columns_of_the_operators_names_keep_their_values(spark, tmp_path):
    import corpus_pipeline

    own = [" ".join(f"{c}{k}" for k in range(40)) for c in ("alpha", "beta", "gamma", "delta")]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(own)] + [(10, own[0] + "\nAll rights reserved", "en", None, None), (None, None, None, None, None)]
    rows += [(20 + k, f"{chr(97 + k)} very own words of text number {chr(97 + k)}{chr(98 + k)}\nAll rights reserved", "en", "s", 9) for k in range(9)]
    more = {"contaminated": True, "n_words": 7, "rejected": True, "language": "xx", "n_dropped": 5, "n_lines": 6, "_k1": 1, "_id": "i", "_text": "t", "_in0": 3}
    tables(spark, tmp_path, rows, [(1, own[1])], **more)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = out.collect()
        assert all({k: r[k] for k in more} == more for r in got), name
        left[name] = {r.doc_id: r for r in got}
    # each stage by itself, on all rows
    assert None not in left["language ID"] and set(left["language ID"]) == {r[0] for r in rows if r[0] is not None}
    assert left["line dedup"][20].text.count("\n") == 0 and left["line dedup"][20].n_chars == len(left["line dedup"][20].text) and None in left["line dedup"]
    assert 10 not in left["n-gram Jaccard join"] and None in left["n-gram Jaccard join"]
    assert set(left["benchmark decontamination"]) == {r[0] for r in rows} - {1}
    assert corpus_pipeline.packing(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == len(rows)
