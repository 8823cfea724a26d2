"""Tables and JSON-lines task sets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TASK = "prompt string, reference_code string, metadata map<string,string>, code_context string"
REQUIRED = ("prompt", "reference_code", "metadata", "code_context")


#: Spark cuts files into parts of at least so many bytes.
LEAST_PART = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Deals a table over all cores that is too small to be cut into a part for each; others are left as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * LEAST_PART else rows


def _checked(rows: DataFrame) -> DataFrame:
    def required(c: str) -> Column:
        return F.when(F.col(c).isNull(), F.raise_error(F.lit(f"missing key: {c}"))).otherwise(F.col(c)).alias(c)

    return rows.select(*[required(c) for c in REQUIRED])


def read_tasks(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A (compressed) JSON-lines file of tasks. Malformed lines and missing keys are errors, other keys are ignored.

    A gzip file is one partition; give ``partitions`` to spread the rows before costly work.
    """
    rows = _checked(spark.read.schema(TASK).option("mode", "FAILFAST").json(path))
    return rows.repartition(partitions) if partitions else rows


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files: lines counted from 1 in each file, whatever parts Spark cuts the files into.

    The parts are byte ranges, read side by side (a gzip file is one). A first pass counts the lines of each
    part; a part's own lines follow on those of the parts before it. No line changes its task.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = rows.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "_block", "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row for each part of a file
    joined = rows.join(F.broadcast(blocks), ["file", "_block"])
    same = F.shiftright("_at", 33) == F.shiftright("_from", 33)
    line = F.when(same, F.col("_before") + F.col("_at") - F.col("_from") + 1).otherwise(F.raise_error(F.lit("the files were cut in another way in the second pass")))
    return joined.select("file", line.cast("bigint").alias("line"), "value")


def read_numbered_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks with the file and line that they come from; an error names both. Blank lines are no tasks, but count."""
    lines = numbered_lines(spark, path).where(~F.col("value").rlike(r"^\s*$"))
    whole = TASK + ", _bad string"
    x = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.select("file", "line", x.alias("x"))
    place = F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(": "))
    wrong = F.when(F.col("x._bad").isNotNull() | F.col("x").isNull(), F.lit("malformed line"))
    for c in REQUIRED:
        wrong = wrong.when(F.col(f"x.{c}").isNull(), F.lit(f"missing key: {c}"))
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(place, wrong))).otherwise(F.col("x"))
    return rows.select("file", "line", checked.alias("x")).select("file", "line", *[f"x.{c}" for c in REQUIRED])


def parse_tasks(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same from a column of JSON texts."""
    return _checked(lines.select(F.from_json(column, TASK, {"mode": "FAILFAST"}).alias("x")).select("x.*"))


def address(host: str, port: int | str, path: str = "") -> str:
    """The address of a service from its parts."""
    return f"http://{host}:{port}{path}"


def endpoint(mode: str, remote: str, local: str) -> str:
    """The address of the chosen connection."""
    if mode not in ("remote", "local"):
        raise ValueError(f"not implemented connection: {mode}")
    return remote if mode == "remote" else local


def address_column(host: Column, port: Column, path: Column) -> Column:
    """address() of a table's columns; null if a part is."""
    return F.concat(F.lit("http://"), host, F.lit(":"), port.cast("string"), path)


def endpoint_column(mode: Column, remote: Column, local: Column) -> Column:
    """endpoint() of a table's columns; another mode, or none, ends the job with the same message."""
    wrong = F.raise_error(F.concat(F.lit("not implemented connection: "), F.coalesce(mode, F.lit("None"))))
    return F.when(mode == "remote", remote).when(mode == "local", local).otherwise(wrong)


def configured(env: Mapping[str, str]) -> str:
    """The model's address by environment: CONNECTION chooses between LLM_ and VLLM_ with HOST, PORT and PATH each."""
    remote, local = (address(*(env.get(f"{p}_{part}", "") for part in ("HOST", "PORT", "PATH"))) for p in ("LLM", "VLLM"))
    return endpoint(env.get("CONNECTION", ""), remote, local)
