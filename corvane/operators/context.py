"""Context strings from ranked chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def header(id_col: str = "id", doc_col: str = "doc_id") -> Column:
    return F.concat(F.lit("[CHUNK "), F.col(id_col).cast("string"), F.lit(" | doc="), F.col(doc_col).cast("string"), F.lit("]\n"))


def assemble(ranked: DataFrame, tasks: DataFrame) -> DataFrame:
    """(item_id, context): a task's chunks in rank order, a blank line between; empty without chunks."""
    parts = ranked.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("rk", F.concat(header(), "text").alias("t")))).alias("p"))
    return tasks.select("item_id").join(parts, "item_id", "left").select("item_id", F.coalesce(F.array_join(F.col("p.t"), "\n\n"), F.lit("")).alias("context"))
