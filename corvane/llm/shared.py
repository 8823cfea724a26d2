"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder. Only a local session that has not set it gets
a temporary folder of its own, which goes when Python ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that the JVM sends to a Python worker at once: by rows alone, a batch grows with the texts.
BATCH_BYTES, _BATCH = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"

_local: list[str] = []
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="corvane-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again.

    Lineage ends here, so that a lost executor costs no more than the stages since.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more: what was made of them has been written, too."""
    for t in tables:
        _written.remove(t._written_at)
        _delete(t.sparkSession, t._written_at)


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this process has written; their DataFrames can't be read after it."""
    while _written:
        _delete(spark, _written.pop())


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the batches of workers in this session, unless it has a bound of its own."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Spark cuts files into parts of at least so many bytes.
LEAST_PART = 4 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Deals a table over all cores that is too small to be cut into a part for each; others are left as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * LEAST_PART else rows
