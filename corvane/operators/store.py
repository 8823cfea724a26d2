"""A keyed chunk store: upserts keep a key's first place and its last value."""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import tokens


#: The file that makes a run count, and the buckets of an index.
COMMIT, BUCKETS = "_COMMITTED", 64


def upsert(writes: DataFrame, id_col: str = "id", order_col: str = "wseq") -> DataFrame:
    """The state after writes in ``order_col``: last values, and pos, the order of first writes. A partial aggregate per key."""
    rest = [c for c in writes.columns if c not in (id_col, order_col)]
    out = writes.groupBy(id_col).agg(F.max_by(F.struct(*rest), order_col).alias("v"), F.min(order_col).alias("pos"))
    return out.select(id_col, *[F.col(f"v.{c}").alias(c) for c in rest], "pos")


def topk_single(chunks: DataFrame, query: str, k: int = 10, order: tuple[str, ...] = ("doc_id", "seq")) -> DataFrame:
    """The first ``k`` chunks by shared distinct tokens, ties in store order, scores of 0 (such as that of a null text) included."""
    if k < 0:
        raise ValueError("k must not be negative")
    score = F.coalesce(F.size(F.array_intersect(tokens(F.col("text")), tokens(F.lit(query)))), F.lit(0)).cast("bigint")
    return chunks.withColumn("score", score).orderBy(F.desc("score"), *order).limit(k)


def _merge(rows: DataFrame) -> DataFrame:
    """One row per id: the columns of its last write, and the places of its first and last."""
    rest = [c for c in rows.columns if c not in ("id", "pos", "_last")]
    out = rows.groupBy("id").agg(F.max_by(F.struct(*rest), "_last").alias("v"), F.min("pos").alias("pos"), F.max("_last").alias("_last"))
    return out.select("id", *[F.col(f"v.{c}").alias(c) for c in rest], "pos", "_last")


def _bucket(token: Column) -> Column:
    return F.pmod(F.crc32(F.encode(token, "UTF-8")), F.lit(BUCKETS)).cast("int")


def _postings(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(tokens(F.col("text"))).alias("token"), "id", F.col("_last.add").alias("add"))


@dataclass(frozen=True)
class Part:
    """A table of a store: an add, or a run that stands for the adds from ``first`` to ``last``."""

    name: str
    level: int
    first: int
    last: int
    batches: tuple[str, ...] = ()

    def holds(self, other: Part) -> bool:
        return self.level > other.level and self.first <= other.first and other.last <= self.last


def live(parts: list[Part]) -> list[Part]:
    """Those that no other part stands for, in the order of adds."""
    return sorted((p for p in parts if not any(q.holds(p) for q in parts)), key=lambda p: p.first)


def due(parts: list[Part], fan: int) -> list[Part]:
    """The oldest ``fan`` live parts of the lowest level that has so many; nothing if none has."""
    now = live(parts)
    for level in sorted({p.level for p in now}):
        own = [p for p in now if p.level == level]
        if len(own) >= fan:
            return own[:fan]
    return []


class ChunkStore:
    """Chunks at a Parquet path of any file system that Spark knows.

    Each add is a table of its own, ``add-<number>[-<batch>]``, so nothing that is there is ever
    written again and its cost is that of what is added. Reading merges the live tables with one
    partial aggregate per key. ``compact`` merges tables of one level, ``fan`` at a time, into a run
    of the next, so that their number grows with the logarithm of that of the adds and each chunk is
    rewritten as often. A run has a name of its own in each try and counts from the moment its commit file is
    there; then the tables that it stands for are deleted. Whatever is unfinished is not read, stands in
    nobody's way, and goes with the compaction that covers it. One writer at a time: a second one fails, as its
    folder exists.

    With ``indexed``, each table has postings (token, id, add) at ``<path>.index``, in files by buckets of
    tokens; a query reads the buckets of its tokens, and texts only of the chunks that it returns.
    """

    def __init__(self, spark: SparkSession, path: str, fan: int = 8, indexed: bool = True):
        if fan < 2:
            raise ValueError("fan must be at least 2")
        self._spark, self._path, self._fan, self._indexed = spark, path.rstrip("/"), fan, indexed

    def _hadoop(self, path: str):
        sc = self._spark.sparkContext
        top = sc._jvm.org.apache.hadoop.fs.Path(path)
        return top, top.getFileSystem(sc._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        top, fs = self._hadoop(path)
        return fs.exists(top)

    def _delete(self, name: str) -> None:
        for path in (f"{self._path}/{name}", f"{self._path}.index/{name}"):
            top, fs = self._hadoop(path)
            fs.delete(top, True)

    def _committed(self, name: str) -> tuple[str, ...] | None:
        """The batches of a run, or None while it has no commit file."""
        top, fs = self._hadoop(f"{self._path}/{name}/{COMMIT}")
        if not fs.exists(top):
            return None
        stream = fs.open(top)
        try:
            return tuple(json.loads(self._spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _commit(self, name: str, batches: tuple[str, ...]) -> None:
        path = f"{self._path}/{name}/{COMMIT}"
        (part, fs), (whole, _) = self._hadoop(path + ".part"), self._hadoop(path)
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(batches).encode()))
        out.close()
        if not fs.rename(part, whole):
            raise OSError(f"{path} could not be committed")

    def _parts(self) -> tuple[list[Part], list[str], int]:
        """The finished tables, the names of unfinished ones, and the largest number of an add."""
        top, fs = self._hadoop(self._path)
        found, broken, most = [], [], 0
        for x in fs.listStatus(top) if fs.exists(top) else []:
            name = x.getPath().getName()
            kind, *rest = name.split("-", 2) if name.startswith("add-") else name.split("-")
            if kind == "add" and rest[0].isdigit():
                part = Part(name, 0, int(rest[0]), int(rest[0]), tuple(rest[1:]))
                done = self._exists(f"{self._path}/{name}/_SUCCESS")
            elif kind == "run" and len(rest) == 4 and all(r.isdigit() for r in rest[:3]):
                batches = self._committed(name)
                part, done = Part(name, *map(int, rest[:3]), batches or ()), batches is not None
            elif kind == "state" and rest[0].isdigit():  # of an earlier version: all adds so far
                part, done = Part(name, 1, 0, int(rest[0])), self._exists(f"{self._path}/{name}/_SUCCESS")
            else:
                continue
            (found if done else broken).append(part if done else name)
            most = max(most, part.last)
        return found, broken, most

    def tables(self) -> list[str]:
        """The tables that a read merges."""
        return [p.name for p in live(self._parts()[0])]

    def add(self, chunks: DataFrame, order_col: str = "wseq", batch: str = "") -> bool:
        """chunks: id, the store's columns, and the order of writes within this add (any orderable type, the same
        in all adds of a store).

        ``batch`` names the add: one whose name is there already is a replay and changes nothing.
        Returns whether the chunks were added.
        """
        parts, _, most = self._parts()
        if batch and any(batch in p.batches for p in parts):
            return False
        written = F.struct(F.lit(most + 1).cast("bigint").alias("add"), F.col(order_col).alias("order"))
        name = f"add-{most + 1:08d}{'-' * bool(batch)}{batch}"
        _merge(chunks.withColumns({"pos": written, "_last": written}).drop(order_col)).write.parquet(f"{self._path}/{name}")
        self._index(name)
        return True

    def _index(self, name: str) -> None:
        """Postings of a table that is there. A table without them is read whole by queries."""
        rows = self._read(name)
        if self._indexed and "text" in rows.columns:
            postings = _postings(rows).withColumn("bucket", _bucket(F.col("token")))
            postings.repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").mode("overwrite").parquet(f"{self._path}.index/{name}")

    def _read(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._path}/{name}")

    def _union(self, names: list[str]) -> DataFrame:
        every = self._read(names[0])
        for n in names[1:]:
            every = every.unionByName(self._read(n))
        return every

    def _names(self) -> list[str]:
        names = self.tables()
        if not names:
            raise FileNotFoundError(f"no chunks at {self._path}")
        return names

    def _merged(self) -> DataFrame:
        names = self._names()
        return self._union(names) if len(names) == 1 else _merge(self._union(names))

    def compact(self, full: bool = False) -> int:
        """Merges tables until no level has ``fan`` of them (``full``: all into one), and deletes what runs stand for. Returns how many runs it made."""
        made = 0
        while True:
            parts, broken, _ = self._parts()
            now = live(parts)
            merge = (now if full and len(now) > 1 and not made else []) or due(parts, self._fan)
            if not merge:
                # what interrupted compactions and adds have left
                covered = max((p.last for p in now if p.level), default=-1)
                old = [n for n in broken if n.startswith("run-") or int(n.split("-")[1]) <= covered]
                for name in (*old, *[p.name for p in parts if p not in now]):
                    self._delete(name)
                return made
            level, first, last = 1 + max(p.level for p in merge), merge[0].first, merge[-1].last
            name = f"run-{level}-{first:08d}-{last:08d}-{uuid.uuid4().hex[:8]}"
            _merge(self._union([p.name for p in merge])).write.parquet(f"{self._path}/{name}")
            self._index(name)
            self._commit(name, tuple(b for p in merge for b in p.batches))
            for p in merge:
                self._delete(p.name)
            made += 1

    def all(self) -> DataFrame:
        """Every chunk, in store order."""
        return self._merged().drop("_last").orderBy("pos")

    def postings(self, wanted: list[str]) -> DataFrame:
        """(token, id, add) of the wanted tokens, from their buckets alone where a table has an index."""
        buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in wanted})
        every = None
        for name in self._names():
            path = f"{self._path}.index/{name}"
            rows = self._spark.read.parquet(path).where(F.col("bucket").isin(buckets)) if self._exists(f"{path}/_SUCCESS") else _postings(self._read(name))
            rows = rows.where(F.col("token").isin(wanted)).select("token", "id", "add")
            every = rows if every is None else every.unionByName(rows)
        return every

    def query(self, text: str, k: int = 10) -> DataFrame:
        """The first ``k`` chunks by shared distinct tokens, as topk_single has them in store order.

        Of all chunks it reads ids and places; of tokens, the postings of those in ``text``; texts of ``k`` chunks.
        """
        if k < 0:
            raise ValueError("k must not be negative")
        wanted = sorted(set(text.split()))
        if not wanted or k == 0:
            return topk_single(self._merged().drop("_last"), text, k, ("pos",))
        # a chunk that was written again has its tokens of the last time
        now = self._union(self._names()).groupBy("id").agg(F.min("pos").alias("pos"), F.max("_last").alias("_last"))
        hits = self.postings(wanted).groupBy("id", "add").agg(F.count("*").alias("score"))
        scored = now.join(hits.withColumnRenamed("id", "_id"), now["id"].eqNullSafe(F.col("_id")) & (F.col("add") == F.col("_last.add")), "left")
        top = scored.select("id", "pos", F.coalesce("score", F.lit(0)).cast("bigint").alias("score")).orderBy(F.desc("score"), "pos").limit(k)
        best = top.collect()  # k rows
        rows = self._merged().drop("_last").where(F.col("id").isin([r.id for r in best]) | (F.col("id").isNull() & F.lit(any(r.id is None for r in best))))
        scores = self._spark.createDataFrame([(r.id, r.score) for r in best], f"_id {rows.schema['id'].dataType.simpleString()}, score bigint")
        return rows.join(F.broadcast(scores), rows["id"].eqNullSafe(F.col("_id"))).drop("_id").orderBy(F.desc("score"), "pos").limit(k)
