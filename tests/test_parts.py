import pytest
from pyspark.sql import functions as F

from corvane.operators import evaluate
from corvane.operators.chunks import Block, apply_filter, augment, chunk, connect
from corvane.sources import readers, sinks


def test_connected_blocks_are_compared_before_rows_are_read(spark):
    docs = spark.createDataFrame([(1, "abcdef"), (2, None), (3, "")], "doc_id long, text string")
    cut = Block("chunks", docs.schema, lambda d: chunk(d, 4))
    takes = chunk(docs, 4).schema
    upper = Block("upper", takes, lambda c: apply_filter(c, lambda t: F.when(F.length(t) > 1, F.upper(t))))
    twice = Block("twice", takes, lambda c: augment(c, lambda t: F.array(t, t)))
    assert sorted((r.id, r.text) for r in connect(docs, cut, upper, twice).collect()) == [("1#0.0", "ABCD"), ("1#0.1", "ABCD"), ("1#1.0", "EF"), ("1#1.1", "EF")]
    assert connect(docs).count() == 3
    with pytest.raises(TypeError, match="upper can't follow the input"):
        connect(docs, upper)
    with pytest.raises(TypeError, match="chunks can't follow bad"):
        connect(docs, Block("bad", docs.schema, lambda d: d.select("doc_id")), cut)


def test_addresses_of_columns_are_those_of_values(spark):
    rows = spark.createDataFrame([("remote", "h", 8), ("local", "l", 9), ("local", None, 9)], "mode string, host string, port int")
    url = readers.address_column(F.col("host"), F.col("port"), F.lit("/v1"))
    got = [r[0] for r in rows.select(readers.endpoint_column(F.col("mode"), url, F.concat(url, F.lit("?")))).collect()]
    assert got == [readers.address("h", 8, "/v1"), readers.address("l", 9, "/v1") + "?", None]
    for mode in ("'other'", "cast(null as string)"):
        with pytest.raises(Exception, match="not implemented connection"):
            spark.range(1).select(readers.endpoint_column(F.expr(mode), F.lit("r"), F.lit("l"))).collect()


@pytest.mark.parametrize("rows", [[("a", "x", 1), ("a", "y", 0), ("longer name", None, 1), (None, "x", None)], [("a", "x", None)], []])
def test_summary_lines_are_the_summary_text(spark, tmp_path, rows):
    summary = evaluate.summary(spark.createDataFrame(rows, "library string, perturbation_type string, score int"))
    lines = [r.value for r in sinks.summary_lines(summary).orderBy("level", "part", "key").collect()]
    assert "\n".join(lines) == sinks.summary_text(summary)
    sinks.write_summary(summary, str(tmp_path / "out"))
    assert [r.value for r in readers.numbered_lines(spark, str(tmp_path / "out")).orderBy("line").collect()] == lines
    assert len(list((tmp_path / "out").glob("part-*"))) == 1
