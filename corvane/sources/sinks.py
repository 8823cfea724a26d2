"""Results as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The heads of the three blocks' first columns, and of the others.
HEADS, COUNT, MEAN = ("all", "library", "kind"), "count", "mean"


def block(rows: list[tuple], names: tuple[str, ...]) -> str:
    """Fixed-width columns, numbers with three decimals."""
    cells = [names, *[tuple("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) for r in rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(names))]
    return "\n".join("  ".join(v.ljust(w) if i == 0 else v.rjust(w) for i, (v, w) in enumerate(zip(r, widths, strict=True))).rstrip() for r in cells)


def summary_text(summary: DataFrame) -> str:
    """Of evaluate.summary(): the overall, per-library and per-kind blocks. The rows are as many as groups."""
    rows = summary.orderBy("level", "key").collect()
    return "\n".join(block([(r.key or "score", r.n, r.mean) for r in rows if r.level == k], (head, COUNT, MEAN)) for k, head in enumerate(HEADS))


def summary_lines(summary: DataFrame) -> DataFrame:
    """The lines of summary_text() as a table: level, part (0: the head), key, value. Nothing passes through the driver."""
    mean = F.when(F.col("mean").isNull(), F.lit("")).otherwise(F.format_string("%.3f", F.bround("mean", 3)))
    rows = summary.select("level", F.lit(1).alias("part"), F.coalesce("key", F.lit("score")).alias("key"), F.col("n").cast("string").alias("n"), mean.alias("m"))
    heads = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("level"), F.lit(0).alias("part"), F.lit(h).alias("key"), F.lit(COUNT).alias("n"), F.lit(MEAN).alias("m")) for k, h in enumerate(HEADS)]))
    rows = rows.unionByName(summary.sparkSession.range(1).select(heads.alias("x")).select("x.*"))
    width = {c: F.max(F.length(c)).over(Window.partitionBy("level")) for c in ("key", "n", "m")}
    rows = rows.select("level", "part", "key", "n", "m", *[w.alias(f"_{c}") for c, w in width.items()])
    line = F.concat_ws("  ", F.rpad("key", F.col("_key"), F.lit(" ")), F.lpad("n", F.col("_n"), F.lit(" ")), F.lpad("m", F.col("_m"), F.lit(" ")))
    return rows.select("level", "part", "key", F.rtrim(line).alias("value"))


def write_summary(summary: DataFrame, path: str) -> None:
    """summary_text() as one text file in the folder ``path``, written by Spark; its lines are as many as groups."""
    summary_lines(summary).repartition(1).sortWithinPartitions("level", "part", "key").select("value").write.text(path)


def write_tasks(tasks: DataFrame, path: str) -> None:
    """Tasks as gzipped JSON lines, which readers.read_tasks reads."""
    tasks.write.option("compression", "gzip").json(path)


def write_text(text: str, path: str) -> None:
    with open(path, "w") as f:
        f.write(text)
