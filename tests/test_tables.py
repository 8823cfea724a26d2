"""Table functions, numbered task lines and the keyed stream."""

import gzip
import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import tables
from corvane.operators import chunks, store
from corvane.sources.readers import numbered_lines, read_numbered_tasks


def test_table_functions(spark):
    tables.register(spark, 3)
    docs = spark.createDataFrame([(1, ""), (2, "abc"), (3, "a😀bc"), (4, None), (5, "a\nb\ncd")], "doc_id long, text string")
    want = sorted((r.doc_id, r.seq, r.text) for r in chunks.chunk(docs, 3).collect())
    for call in ("chunk_text(d.text)", "chunk_text(d.text, 3)", "chunk_rows(d.text, 3)"):
        assert sorted(map(tuple, spark.sql(f"SELECT d.doc_id, c.seq, c.part FROM {{docs}} d, LATERAL {call} c", docs=docs).collect())) == want
    spark.udtf.register("twice", tables.augmenter(lambda t: [t, t.upper()]))
    assert sorted(map(tuple, spark.sql("SELECT d.doc_id, a.seq, a.part FROM {docs} d, LATERAL twice(d.text) a WHERE d.doc_id IN (2, 4)", docs=docs).collect())) == [(2, 0, "abc"), (2, 1, "ABC")]
    assert tables.halves("a b c") == ["a b c", "a", "b c"] and tables.halves("one") == ["one"]
    with pytest.raises(Exception, match="at least 1"):
        spark.sql("SELECT * FROM chunk_text('x', 0)").collect()


ROW = {"prompt": "p", "reference_code": "1", "metadata": {"library": "n"}, "code_context": "c"}


def test_lines_are_numbered_across_parts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, n in (("a.jsonl", 4000), ("b.jsonl", 30)):
        (tmp_path / "in" / name).write_text("".join(f"{name} {k}{' ' * (k % 7)}\n" for k in range(1, n + 1)))
    with gzip.open(tmp_path / "in" / "c.jsonl.gz", "wt") as f:
        f.write("c.jsonl.gz 1\n\nc.jsonl.gz 3")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = numbered_lines(spark, str(tmp_path / "in"))
        assert df.rdd.getNumPartitions() > 5
        rows = [(r.file.rsplit("/", 1)[1], r.line, r.value.strip()) for r in df.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 4033 and all(v in ("", f"{f} {k}") for f, k, v in rows) and sum(v == "" for *_, v in rows) == 1


@pytest.mark.parametrize("bad,said", [("{oops", "b.jsonl:3: malformed line"), ("[1]", "b.jsonl:3: "), (json.dumps({k: v for k, v in ROW.items() if k != "metadata"}), "b.jsonl:3: missing key: metadata")])
def test_an_error_names_file_and_line(spark, tmp_path, bad, said):
    good = json.dumps(ROW | {"extra": 1})
    (tmp_path / "a.jsonl").write_text(f"{good}\n\n{good}\n")
    assert sorted((r.line, r.prompt, r.metadata["library"]) for r in read_numbered_tasks(spark, str(tmp_path)).collect()) == [(1, "p", "n"), (3, "p", "n")]
    (tmp_path / "b.jsonl").write_text(f"{good}\n{good}\n{bad}\n{good}\n")
    with pytest.raises(Exception, match=said):
        read_numbered_tasks(spark, str(tmp_path)).collect()


def test_a_keyed_stream_is_an_upsert(spark, tmp_path):
    keyed = pytest.importorskip("corvane.streaming.keyed")
    kind = "id string, wseq long, text string, n int"
    writes = [[("x", 5, "x5", 1), ("y", 6, "y6", None)], [("x", 9, "x9", 2), ("z", 7, None, 3)], [("y", 2, "late", 4), ("x", 8, "not last", 5), ("x", 8, "nor this", 6)]]

    def turn(k):
        spark.createDataFrame(writes[k], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        keyed.upsert_to(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)  # a new query each time: a restart
        changes = spark.read.parquet(str(tmp_path / "out"))
        last = changes.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("batch")))).where("_k = 1").select("id", "text", "n", "pos")
        so_far = spark.createDataFrame([w for b in writes[: k + 1] for w in b], kind)
        assert sorted(map(tuple, last.collect())) == sorted(map(tuple, store.upsert(so_far).select("id", "text", "n", "pos").collect()))
        return changes

    for k in range(3):
        changes = turn(k)
    assert changes.where("batch = 2").count() == 2  # z was not written again
