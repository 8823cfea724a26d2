"""Exact substring deduplication by level-wise doubling.

A window is ``width`` consecutive words of one document. Counting every window of a corpus
would shuffle every word; here lengths double instead. The first level takes only those
runs of ``width / 4`` words that are the least (by hash) among the runs of some window, so
about one run in thirteen, yet at least one of each window and the same one wherever the
window stands. Runs that stand alone are dropped; the rest are extended to twice the
length, to the right and to the left; what still repeats is extended to whole windows, and
windows that stand alone are dropped. No level ever drops a window that repeats. The levels
before the last only choose candidates, by 64-bit hashes; whole windows are equal if 96 bits
of two independent hashes are (among 10**13 windows, one wrong pair in a thousand corpora).

Counts are partial aggregates; what repeats finds its documents by joins that adaptive
execution can split, and each document's finds are bounded by its own words. Rows are
known by a digest of their text, so doc_id may be null or repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import bounded_batches, dropped, written

KEY = ["_k1", "_k2"]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_k1"), F.hash(text).alias("_k2"))


def _levels(width: int) -> tuple[int, int, int]:
    """Run length, its double, and the number of runs in a window."""
    run = max(1, -(-width // 4))
    return run, min(2 * run, width), width - run + 1


def _least(rolling: W.Rolling, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows, and the place of the least run (leftmost of equals) in each."""
    run, _, runs = _levels(width)
    starts = W.window_starts(first, width)
    if not len(starts):
        return starts, starts
    every = np.arange(first[-1] - run + 1)
    order = (rolling.at(every, run) >> np.uint64(32) << np.uint64(32)) | every.astype(np.uint64)
    return starts, (W.sliding(order, runs, np.minimum)[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _side(rolling: W.Rolling, places: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs at ``places``: which (index), side (0 right, 1 left) and hash of their doubles within the document."""
    run, double, _ = _levels(width)
    doc = np.searchsorted(first, places, "right") - 1
    right = np.flatnonzero(places + double <= first[doc + 1])
    back = places - (double - run)
    left = np.flatnonzero(back >= first[doc])
    h = np.concatenate([rolling.at(places[right], double), W.mix(rolling.at(back[left], double) + np.uint64(1))])
    return np.concatenate([right, left]), np.repeat([0, 1], [len(right), len(left)]), h


def _emit(k1, k2, docs: np.ndarray, local: np.ndarray, h: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    columns = {"h": pa.array(W.signed(h)), "_k1": pa.array(k1[docs]), "_k2": pa.array(k2[docs]), "pos": pa.array(local.astype(np.int32))}
    return pa.RecordBatch.from_pydict(columns | {k: pa.array(v.astype(np.int32)) for k, v in more.items()})


def _batches(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        k1, k2 = batch["_k1"].to_numpy(zero_copy_only=False), batch["_k2"].to_numpy(zero_copy_only=False)
        for row, data, offsets in W.chunks(batch["_text"]):
            w = W.Words(data, offsets, W.SPACES)
            yield batch, k1, k2, row, w


def _runs(width: int):
    def run(batches):
        for _, k1, k2, row, w in _batches(batches):
            rolling = W.Rolling(w.hashes())
            _, at = _least(rolling, w.first, width)
            at = np.unique(at)
            if len(at):
                doc = np.searchsorted(w.first, at, "right") - 1
                yield _emit(k1, k2, doc + row, at - w.first[doc], rolling.at(at, _levels(width)[0]))

    return run


def _given(column, row: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a list column: the flat values of rows row : row + n, and the row of each."""
    part = column.slice(row, n)
    values, lengths = part.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(part).fill_null(0).to_numpy(zero_copy_only=False)
    return values.astype(np.int64), np.repeat(np.arange(n), lengths)


def _doubled(width: int):
    def run(batches):
        for batch, k1, k2, row, w in _batches(batches):
            pos, doc = _given(batch["found"], row, len(w.n))
            at = pos + w.first[doc]
            rolling = W.Rolling(w.hashes())
            which, side, h = _side(rolling, at, w.first, width)
            if len(which):
                yield _emit(k1, k2, doc[which] + row, pos[which], h, side=side)

    return run


def _windows(width: int):
    run_length, double, _ = _levels(width)

    def run(batches):
        for batch, k1, k2, row, w in _batches(batches):
            pos, doc = _given(batch["found"], row, len(w.n))
            rolling = W.Rolling(w.hashes())
            starts, least = _least(rolling, w.first, width)
            ok = np.zeros((2, w.first[-1] + 1), bool)
            ok[pos & 1, (pos >> 1) + w.first[doc]] = True
            right = least - starts + double <= width
            starts = starts[np.where(right, ok[0, least], ok[1, least])]
            if len(starts):
                d = np.searchsorted(w.first, starts, "right") - 1
                check = (W.Rolling(w.hashes(1), 1).at(starts, width) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield _emit(k1, k2, d + row, starts - w.first[d], rolling.at(starts, width), check=check)

    return run


def _removed(width: int):
    def run(batches):
        for batch in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            for row, data, offsets in W.chunks(batch["_text"]):
                w = W.Words(data, offsets, W.SPACES)
                pos, doc = _given(batch["found"], row, len(w.n))
                gone = W.covered(pos + w.first[doc], width, len(w.starts))
                keep = np.flatnonzero(~gone)
                keeper = np.searchsorted(w.first, keep, "right") - 1
                last = np.append(keeper[1:] != keeper[:-1], True) if len(keep) else np.zeros(0, bool)
                marks = np.zeros(len(data) + 2, np.int8)
                np.add.at(marks, w.starts[keep], 1)
                np.add.at(marks, w.ends[keep] + ~last, -1)
                out = data.copy()
                out[w.ends[keep[~last]]] = 0x20
                mask = np.cumsum(marks[:-2], dtype=np.int8) > 0
                sizes = np.concatenate([[0], np.cumsum(mask)])[offsets]
                flat = out[mask].tobytes()
                for a, b in zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True):
                    texts.append(flat[a:b])
                    digests.append(hashlib.sha256(flat[a:b]).hexdigest())
                total = np.concatenate([[0], np.cumsum(gone)])
                n_words.append(w.n)
                n_removed.append(total[w.first[1:]] - total[w.first[:-1]])
            if n_words:
                yield pa.RecordBatch.from_pydict(
                    {"_id": batch["_id"], "n_words": pa.array(np.concatenate(n_words).astype(np.int64)), "n_removed": pa.array(np.concatenate(n_removed).astype(np.int64)), "kept_sha256": pa.array(digests), "kept_text": pa.array(texts, pa.binary()).cast(pa.string())}
                )

    return run


def _repeated(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose key occurs more than once, and the written keys: so the join's rows come straight from a shuffle that can be split where a key is hot."""
    often = written(rows.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1").select(*by), "often")
    return rows.join(often, by, "left_semi"), often


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35) -> DataFrame:
    """Removes every word that a repeated window of ``width`` words covers.

    Returns one row per input row: the id, n_words, n_removed, kept_sha256 (lowercase hex of
    the kept words joined by one space, UTF-8) and kept_text. Null and empty texts have no
    words; texts of fewer than ``width`` words lose nothing; equal texts lose all their
    windows; repeated rows each count as a document; other columns are ignored, an empty
    table gives an empty one.
    """
    if width < 1:
        raise ValueError("width must be at least 1")
    bounded_batches(docs.sparkSession)
    run_t = "h bigint, _k1 bigint, _k2 int, pos int"
    base = keyed(docs, id_col, text_col)
    # runs that are the least of some window, then those that occur twice
    runs = written(base.mapInArrow(_runs(width), run_t), "runs")
    rows, often = _repeated(runs, ["h"])
    found = rows.groupBy(*KEY).agg(F.collect_set("pos").alias("found"))
    doubles = written(base.join(found, KEY).mapInArrow(_doubled(width), run_t + ", side int"), "doubles")
    dropped(runs, often)
    rows, often = _repeated(doubles, ["h"])
    found = rows.groupBy(*KEY).agg(F.collect_set(F.col("pos").cast("bigint") * 2 + F.col("side")).alias("found"))
    windows = written(base.join(found, KEY).mapInArrow(_windows(width), run_t + ", check int"), "windows")
    dropped(doubles, often)
    rows, _ = _repeated(windows, ["h", "check"])
    found = rows.groupBy(*KEY).agg(F.collect_set("pos").alias("found"))
    id_type = docs.schema[id_col].dataType.simpleString()
    out = base.join(found, KEY, "left").mapInArrow(_removed(width), f"_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
    return out.withColumnRenamed("_id", id_col)
