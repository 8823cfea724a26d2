"""Tables between steps, in the folder that all executors share.

``spark.checkpoint.dir`` names that folder. Only a local session that has not set it gets a
temporary folder of its own, which goes when Python ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new table."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="corvane-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        top = f"file://{_local[0]}"
    return f"{top.rstrip('/')}/corvane/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table and reads it again: what made it, such as calls of a model, never runs a second time for its rows."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


#: Rows of a few values each that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def sized(small: DataFrame) -> DataFrame:
    """A table, written, to be broadcast if its counted rows allow."""
    small = written(small, "small")
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for t in tables:
        jvm, conf = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(t._written_at)
        path.getFileSystem(conf).delete(path, True)
