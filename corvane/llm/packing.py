"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

Documents are tokenised once and cut into pieces; a histogram of piece lengths (at most
``capacity`` rows, whatever the corpus) comes to the driver, where best-fit decreasing runs
over counts: equal sequences are one group, and a group takes as many pieces of a length at
once as fit. The plan gives, per length, ranges of ranks and the sequences and offsets that
they take. Pieces get their rank within their length from a salted row number, with as many
salts as the length's count asks for, so that no length, however common, is one task, and join
the plan. Pieces that fill a sequence need no rank: each is one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .known import Known, gather, held
from .shared import bounded_batches, written

#: Pieces of one length that are ranked in one sort, on average.
SORTED = 50_000


def _ids(path: str) -> Known:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)

    def compute(words: list[bytes], _) -> list:
        out = []
        for i in range(0, len(words), 4096):
            out += [e.ids for e in t.encode_batch_fast([w.decode() for w in words[i : i + 4096]], add_special_tokens=False)]
        return out

    return Known(compute, np.uint32)


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches):
        known = held(("packing", path), lambda: _ids(path))
        for batch in batches:
            which, piece, start, length, crc = [], [], [], [], []
            for row, data, offsets in W.chunks(batch["_text"]):
                # a special token's string is known by its "<|", and only in lower case
                w = W.Words(data, offsets, W.SPACES, lower=b"<|" not in data.tobytes(), cut=True)
                at, size, flat = known.look(w.hashes(), w.word)
                ids = gather(at, size, flat)
                ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[w.first]
                n = np.diff(ends)
                out = np.full(len(ids) + len(n), end_id, "<u4")
                out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                begin, raw = ends[:-1] + np.arange(len(n)), out.tobytes()
                for d, (b, size_d) in enumerate(zip(begin.tolist(), (n + 1).tolist(), strict=True)):
                    for k, s in enumerate(range(0, size_d, capacity)):
                        m = min(capacity, size_d - s)
                        which.append(row + d)
                        piece.append(k)
                        start.append(s)
                        length.append(m)
                        crc.append(zlib.crc32(raw[4 * (b + s) : 4 * (b + s + m)]))
            yield pa.RecordBatch.from_pydict({"_id": batch["_id"].take(pa.array(which, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return run


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, end rank, first sequence, pieces in each, offset)."""
    free: dict[int, list[tuple[int, tuple]]] = {}  # by room left: (number of equal sequences, their (length, pieces, offset))
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = next((r for r in range(length, capacity + 1) if free.get(r)), None)
            many, held = free[room].pop() if room else (left, ())
            room = room or capacity
            each = room // length
            full = min(many, left // each)
            rest = left - full * each if full < many else 0
            add = lambda k, room=room, held=held, length=length: (room - k * length, (*held, (length, k, capacity - room)))
            if full:
                r, what = add(each)
                free.setdefault(r, []).append((full, what))
            if rest:
                r, what = add(rest)
                free.setdefault(r, []).append((1, what))
            if held and many - full - bool(rest):
                free.setdefault(room, []).append((many - full - bool(rest), held))
            left -= full * each + rest
    rank, sequence, out = dict.fromkeys(histogram, 0), 0, []
    for r in sorted(free):
        for many, held in free[r]:
            for length, k, offset in held:
                out.append((length, rank[length], rank[length] + many * k, sequence, k, offset))
                rank[length] += many * k
            sequence += many
    return out


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents, each its token ids and then ``end_id``, into sequences of at most ``capacity``.

    Only documents longer than a sequence are cut. Returns a row per piece: the id, piece (from
    0), start, length, ids_crc32 (of the piece's ids as little-endian 32-bit), sequence_id and
    offset (gapless from 0 in each sequence). Null and empty texts are the end id alone; repeated
    rows and null ids are packed like others; other columns are ignored; an empty table gives an
    empty one.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = docs.sparkSession
    bounded_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    pieces = written(base.mapInArrow(_pieces(tokenizer_path, end_id, capacity), f"_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint"), "pieces")
    histogram = {r.length: r.n for r in pieces.where(F.col("length") < capacity).groupBy("length").agg(F.count("*").alias("n")).collect()}
    # both tables have a size that depends on the capacity alone
    slots = spark.createDataFrame(plan(histogram, capacity), "length bigint, _lo bigint, _hi bigint, _first bigint, _each bigint, _at bigint")
    salts = spark.createDataFrame([(k, -(-n // SORTED)) for k, n in histogram.items()], "length bigint, _salts bigint")
    rest = pieces.where(F.col("length") < capacity).join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("_id", "piece"), F.col("_salts")))
    counts = rest.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).select("length", "_salt", "_base")
    ranked = rest.withColumn("_rn", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_rn") - 1)
    placed = ranked.join(F.broadcast(slots), (ranked.length == slots.length) & (ranked._rank >= slots._lo) & (ranked._rank < slots._hi)).drop(slots.length)
    k = F.col("_rank") - F.col("_lo")
    named = [F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32"]
    shared = placed.select(*named, (F.col("_first") + F.floor(k / F.col("_each"))).alias("sequence_id"), (F.col("_at") + F.pmod(k, F.col("_each")) * F.col("length")).alias("offset"))
    full = pieces.where(F.col("length") == capacity)
    return shared.unionByName(full.select(*named, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")))
