"""Top-k retrieval for batches of tasks by token overlap."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import tokens
from corvane.sources.shared import BROADCAST_ROWS, sized, written

ORDER = ("doc_id", "seq")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), *ORDER)
    return scored.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def index(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """Postings (token, doc_id, seq) of the tokens that ``asked`` (token) has; a chunk's tokens are made once."""
    tokens_of = chunks.select(*ORDER, F.explode(tokens(F.col("text"))).alias("token"))
    return written(tokens_of.join(sized(asked), "token", "left_semi"), "postings")


@dataclass(frozen=True)
class Steps:
    """The tables of one retrieval, for those who want to see what it has joined."""

    seeds: DataFrame
    found: DataFrame
    top: DataFrame


def pruned(tasks: DataFrame, chunks: DataFrame, k: int = 10, budget: int = 50) -> Steps:
    """Top-k hits of tasks by an inverted index that reads common tokens only to complete scores.

    A task's tokens are put in the order of rarity. Its seeds, the rarest tokens that together have ``budget``
    times ``k`` postings, give chunks whose whole scores are a floor: the k-th best of them. Every chunk with
    that score or more shares one of the task's tokens without its (floor - 1) most common ones, so
    only these tokens' postings are joined; the common ones are looked up in the chunks so found.
    """
    asked = written(tasks.select("item_id", F.explode(tokens(F.col("text"))).alias("token")), "asked")
    postings = index(chunks, asked.select("token").distinct())
    held = written(postings.groupBy(*ORDER).agg(F.collect_list("token").alias("held")), "held")
    frequency = postings.groupBy("token").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("item_id").orderBy("n", "token")
    ranked = asked.join(frequency, "token").withColumn("place", F.row_number().over(rarest)).withColumn("before", F.sum("n").over(rarest.rowsBetween(Window.unboundedPreceding, -1)))
    ranked = written(ranked.withColumn("before", F.coalesce("before", F.lit(0))), "asked-by-rarity")
    few = ranked.count() <= BROADCAST_ROWS

    def meet(wanted: DataFrame) -> DataFrame:
        """Postings of the wanted tokens: files of postings are small for their rows, and Spark would broadcast them."""
        return postings.join(F.broadcast(wanted) if few else wanted.hint("merge"), "token")

    whole = ranked.groupBy("item_id").agg(F.collect_list("token").alias("wanted"))

    seeds = meet(ranked.where(F.col("before") < budget * k).select("item_id", "token")).select("item_id", *ORDER).distinct()
    scored = seeds.join(held, list(ORDER)).join(whole, "item_id").select("item_id", F.size(F.array_intersect("held", "wanted")).alias("score"))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"))
    floor = scored.withColumn("rk", F.row_number().over(best)).where(F.col("rk") == k).select("item_id", F.col("score").alias("floor"))
    sizes = ranked.groupBy("item_id").agg(F.max("place").alias("size")).join(floor, "item_id", "left").select("item_id", (F.col("size") - F.coalesce("floor", F.lit(1)) + 1).alias("last"))
    sizes = written(sizes, "prefixes")
    placed = ranked.join(sizes, "item_id").select("item_id", "token", (F.col("place") <= F.col("last")).alias("first"))
    found = meet(placed.where("first").select("item_id", "token")).groupBy("item_id", *ORDER).agg(F.count("*").alias("n"))
    rest = placed.where("not first").groupBy("item_id").agg(F.collect_list("token").alias("common"))
    score = F.col("n") + F.when(F.col("common").isNull(), 0).otherwise(F.size(F.array_intersect("held", "common")))
    scores = found.join(rest, "item_id", "left").join(held, list(ORDER)).select("item_id", *ORDER, score.cast("bigint").alias("score"))
    return Steps(seeds, found, _ranked(scores, k))


#: Bytes of chunks, by Spark's statistics, from which the pruned index saves more than its steps take.
PRUNE_FROM = 1 << 30


def _hits(tasks: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The same top-k hits by one join of all postings: a row for each token that a task and a chunk share."""
    asked = tasks.select("item_id", F.explode(tokens(F.col("text"))).alias("token"))
    held = chunks.select(*ORDER, F.explode(tokens(F.col("text"))).alias("token"))
    return _ranked(held.join(asked, "token").groupBy("item_id", *ORDER).agg(F.count("*").alias("score")), k)


def topk_batch(tasks: DataFrame, chunks: DataFrame, k: int = 10, prune: bool | None = None) -> DataFrame:
    """(item_id, rk, doc_id, seq, score) by an inverted index: the pruned one of ``pruned``, or for
    chunks of less than ``PRUNE_FROM`` bytes, unless ``prune`` says so, a single join. The rows are the same.

    A task with fewer than ``k`` hits gets the first chunks in store order that are no hits, with
    a score of 0. They are among the first ``k`` chunks, so these are offered to every task: a
    chunk that is a hit, too, keeps its score, and a task with ``k`` hits has no place for them.
    Ids of documents and chunks may have any orderable type.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if prune is None:
        prune = int(str(chunks._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= PRUNE_FROM
    hits = pruned(tasks, chunks, k).top if prune else _hits(tasks, chunks, k)
    first = chunks.select(*ORDER).orderBy(*ORDER).limit(k).agg(F.collect_list(F.struct(*ORDER)).alias("first"))
    pad = tasks.select("item_id").join(F.broadcast(first)).select("item_id", F.explode("first").alias("c"))
    pad = pad.select("item_id", *[F.col(f"c.{c}").alias(c) for c in ORDER], F.lit(0).cast("bigint").alias("score"))
    every = hits.drop("rk").unionByName(pad).groupBy("item_id", *ORDER).agg(F.max("score").alias("score"))
    return _ranked(every, k).select("item_id", F.col("rk").cast("bigint").alias("rk"), *ORDER, "score")


#: Chunks and tasks of a block of topk_batch_cross.
CHUNKS, TASKS = 1 << 14, 1 << 13


def _best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The scores of all pairs of a block of chunks and a block of tasks, of which each task's best ``k`` are kept."""

    def best(chunks: pa.Table, tasks: pa.Table) -> pa.Table:
        chunks = chunks.sort_by("place")
        n, held, asked = len(chunks), chunks["t"].combine_chunks(), tasks["q"].combine_chunks()
        words = asked.flatten().unique()
        word, at = np.asarray(pc.fill_null(pc.index_in(held.flatten(), words), -1)), np.asarray(pc.list_parent_indices(held))
        order = np.argsort(word, kind="stable")
        at, ends = at[order], np.searchsorted(word[order], np.arange(len(words) + 1))  # the chunks of each word
        of = np.split(np.asarray(pc.index_in(asked.flatten(), words)), np.searchsorted(np.asarray(pc.list_parent_indices(asked)), np.arange(1, len(asked))))
        no_chunk, no_task = (np.asarray(x.is_null()) for x in (held, asked))
        row, pair, score = [np.zeros(0, "int64")], [np.zeros(0, "int64")], [np.zeros(0, "int64")]
        for task in range(len(asked) if n else 0):
            shared = np.bincount(np.concatenate([at[:0], *(at[ends[w] : ends[w + 1]] for w in of[task])]), minlength=n)
            # no score where a text is null: behind all others, and in store order as those of one score
            shared[no_chunk | no_task[task]] = -1
            top = np.argpartition(n * shared - np.arange(n), n - min(k, n))[n - min(k, n) :]
            row.append(np.full(len(top), task))
            pair.append(top)
            score.append(shared[top])
        row, pair, score = (np.concatenate(x) for x in (row, pair, score))
        return pa.table({"item_id": tasks["item_id"].take(row)} | {c: chunks[c].take(pair) for c in ORDER} | {"score": pa.array(score, mask=score < 0)})

    return best


def topk_batch_cross(tasks: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """The same by comparing every pair: a check of topk_batch, all pairs by design.

    Blocks of ``CHUNKS`` chunks meet blocks of ``TASKS`` tasks, each a group of its own. A group keeps only the best ``k``
    chunks of each of its tasks, so no table of all pairs is ever made or sorted.
    """
    spark = chunks.sparkSession
    n, m = chunks.count(), tasks.count()
    high, wide = max(-(-n // CHUNKS), min(3 * spark.sparkContext.defaultParallelism, n), 1), max(-(-m // TASKS), 1)
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asked = tasks.select("item_id", tokens(F.col("text")).alias("q")).withColumn("across", F.pmod(F.xxhash64("item_id"), F.lit(wide)).cast("int"))
    held = chunks.select(*ORDER, tokens(F.col("text")).alias("t")).withColumn("down", F.pmod(F.xxhash64(*ORDER), F.lit(high)).cast("int"))
    block = ["down", "across"]
    held = held.withColumn("across", every(wide)).withColumn("place", F.row_number().over(Window.partitionBy(*block).orderBy(*ORDER)))
    kinds = {f.name: f.dataType.simpleString() for f in [*tasks.select("item_id").schema, *chunks.select(*ORDER).schema]}
    pairs = held.groupBy(*block).cogroup(asked.withColumn("down", every(high)).groupBy(*block))
    scored = pairs.applyInArrow(_best(k), ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", score bigint")
    return _ranked(scored, k).select("item_id", F.col("rk").cast("bigint").alias("rk"), *ORDER, "score")


def with_text(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    return ranked.join(chunks.select(*ORDER, "id", "text"), list(ORDER))


def rerank(ranked: DataFrame, by: Column, k: int = 5) -> DataFrame:
    """The best ``k`` of each task's candidates by another score, ties in the former order."""
    w = Window.partitionBy("item_id").orderBy(by.desc(), "rk")
    return ranked.withColumn("new_rk", F.row_number().over(w).cast("bigint")).where(F.col("new_rk") <= k)
