"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Benchmark items are few against the corpus, but not by nature: they come to the driver one
block of at most ``block_bytes`` of text at a time. A block's windows are a sorted hash array
with places in the block's normalised text (about 30 bytes a window, at most one window per
word), so its size is bounded whatever the benchmark. With one block the scan marks the words
at once, without a shuffle. With more, each block has a scan of its own that writes what it
hits, then the block goes, and documents get their hits by a join on a digest of their text.
Each hit is compared word by word with the item's window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .known import forget
from .shared import bounded_batches, written

#: Bytes of benchmark text in one hash set; a larger benchmark is scanned in more blocks.
BLOCK_BYTES = 16 << 20
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hit_spans")
KEY = ["_k1", "_k2"]


class _Grams:
    """The windows of one block of items: per length, sorted hashes with their places in the normalised text and their items."""

    def __init__(self, ids: list[str], texts: list[str], n: int):
        self.ids = ids
        text, size, found = [], 0, {}
        for row, data, offsets in W.chunks(pa.array(texts, pa.large_string())):
            w = W.Words(data, offsets, W.NOT_ALNUM, lower=True)
            rolling = W.Rolling(w.hashes())
            joined = b" ".join(w.word(i) for i in range(len(w.starts)))
            ends = np.cumsum(w.ends - w.starts + 1) - 1 + size
            begins = ends - (w.ends - w.starts)
            text.append(joined)
            size += len(joined) + 1
            for length in np.unique(np.minimum(w.n, n)).tolist():
                items = np.flatnonzero(np.minimum(w.n, n) == length)
                if length:
                    at = np.concatenate([np.arange(w.first[d], w.first[d + 1] - length + 1) for d in items])
                    owner = np.searchsorted(w.first, at, "right") - 1 + row
                    found.setdefault(length, []).append((rolling.at(at, length), begins[at], ends[at + length - 1], owner))
        self.text = b" ".join(text)
        self.by_length = {}
        for length, parts in found.items():
            h, begin, end, owner = map(np.concatenate, zip(*parts, strict=True))
            order = np.lexsort((owner, h))
            h, begin, end, owner = h[order], begin[order], end[order], owner[order]
            self.by_length[length] = (h, begin, end, owner.astype(np.int32))

    def gram(self, begin: int, end: int) -> bytes:
        return self.text[begin:end]


def _hits(block: _Grams, w: W.Words) -> Iterator[tuple[int, int, set[int]]]:
    """First word, length and items of each window of the chunk that is one of the block's."""
    rolling = W.Rolling(w.hashes())
    for length, (hashes, begin, end, owner) in block.by_length.items():
        at = W.window_starts(w.first, length)
        h = rolling.at(at, length)
        low = np.searchsorted(hashes, h)
        for k in np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == h).tolist():
            a = int(at[k])
            gram = b" ".join(w.word(x) for x in range(a, a + length))
            high = int(np.searchsorted(hashes, h[k], "right"))
            items = {int(owner[p]) for p in range(int(low[k]), high) if block.gram(begin[p], end[p]) == gram}
            if items:
                yield a, length, items


def _scan(block: _Grams):
    """Of each text that the block hits: its key, the runs of words that are hit (begin and end in turn) and the items."""

    def run(batches):
        forget()
        for batch in batches:
            rows, spans, items = [], [], []
            for row, data, offsets in W.chunks(batch["_text"]):
                w = W.Words(data, offsets, W.NOT_ALNUM, lower=True)
                own: dict[int, list] = {}
                for a, length, found in _hits(block, w):
                    d = int(np.searchsorted(w.first, a, "right")) - 1
                    hit, seen = own.setdefault(d, ([], set()))
                    hit.append((a - int(w.first[d]), a - int(w.first[d]) + length))
                    seen |= found
                for d, (hit, seen) in own.items():
                    rows.append(row + d)
                    spans.append([x for run_ in _joined(hit) for x in run_])
                    items.append([block.ids[i] for i in sorted(seen)])
            if rows:
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_pydict({k: batch[k].take(take) for k in KEY} | {"_spans": pa.array(spans, pa.list_(pa.int64())), "_items": pa.array(items, pa.list_(pa.string()))})

    return run


def _joined(spans) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _marks(block: _Grams | None, share: tuple[int, int]):
    """Per document the results; the hits are the block's, or else those in the columns _spans and _items."""
    up, down = share

    def run(batches):
        forget()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in RESULTS}
            given = None if block else (batch["_spans"], batch["_items"])
            for row, data, offsets in W.chunks(batch["_text"]):
                w = W.Words(data, offsets, W.NOT_ALNUM, lower=True)
                own: dict[int, tuple[list, set]] = {}
                if block:
                    for a, length, found in _hits(block, w):
                        d = int(np.searchsorted(w.first, a, "right")) - 1
                        hit, seen = own.setdefault(d, ([], set()))
                        hit.append((a - int(w.first[d]), a - int(w.first[d]) + length))
                        seen.update(block.ids[i] for i in found)
                else:
                    for d in range(len(w.n)):
                        spans = given[0][row + d].as_py()
                        if spans:
                            flat = [x for part in spans for x in part]
                            own[d] = (list(zip(flat[::2], flat[1::2], strict=True)), {x for part in given[1][row + d].as_py() for x in part})
                for d, n in enumerate(w.n.tolist()):
                    hit, seen = own.get(d, ((), ()))
                    runs, items = _joined(hit), sorted(seen)
                    n_hit, first = sum(b - a for a, b in runs), int(w.first[d])
                    out["n_words"].append(n)
                    out["n_hit"].append(n_hit)
                    out["n_items"].append(len(items))
                    out["items"].append(items)
                    out["items_sha256"].append(hashlib.sha256(",".join(items).encode()).hexdigest())
                    out["contaminated"].append(n_hit > 0 and down * n_hit >= up * n)
                    out["hit_spans"].append([int(x - offsets[d]) for a, b in runs for x in (w.starts[first + a], w.ends[first + b - 1])])
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int64()))
            names = [f for f in batch.schema.names if f.startswith("_c")]
            yield pa.RecordBatch.from_pydict({f: batch[f] for f in names} | {"_text": batch["_text"].cast(pa.string())} | {k: pa.array(out[k], t) for k, t in zip(RESULTS, types, strict=True)})

    return run


def _cut(text: str | None, spans: list[int]) -> str | None:
    raw, out, at = (text or "").encode(), [], 0
    for b, e in zip(spans[::2], spans[1::2], strict=True):
        out.append(raw[at:b])
        at = e
    return b"".join([*out, raw[at:]]).decode()


def read_items(benchmark: DataFrame, n: int, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[_Grams]:
    """The benchmark's windows, one block of bounded size after the other, at least one. Rows without a text have no windows, an id that is null is 'null'."""
    ids, texts, size, blocks = [], [], 0, 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct().toLocalIterator():
        size += len(row.t.encode())
        if texts and size > block_bytes:
            yield _Grams(ids, texts, n)
            ids, texts, size, blocks = [], [], len(row.t.encode()), blocks + 1
        ids.append(row.i if row.i is not None else "null")
        texts.append(row.t)
    if texts or not blocks:
        yield _Grams(ids, texts, n)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: tuple[int, int] = (1, 20), id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Marks the words of each document that lie in a window of a benchmark item.

    Words are lower-cased runs of letters, digits and non-ASCII characters; a window is ``n``
    consecutive words of an item, or the whole item if it has fewer. Returns per row: the id,
    the columns in ``keep``, the text, n_words, n_hit, n_items, items_sha256, contaminated (n_hit
    over n_words is at least ``share`` and not 0), items and hit_spans (byte offsets, begin and
    end in turn). A kept column of one of these names is replaced by the result, but for the id
    and the text, which stay what they are called. Null and empty texts have no words and are
    clean; items without words hit nothing; repeated items count once, repeated rows each have a
    result; an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    names = [c for c in dict.fromkeys((id_col, *keep)) if c != text_col and (c == id_col or c not in RESULTS)]
    src = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)], F.col(text_col).alias("_text"))
    schema = ", ".join(f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    schema += ", _text string, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>, hit_spans array<bigint>"
    blocks = read_items(benchmark, n, item_id, item_text, block_bytes)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        out = src.mapInArrow(_marks(block, share), schema)
    else:
        text = F.col("_text")
        keyed = src.withColumns({"_k1": F.xxhash64(text), "_k2": F.hash(text)})
        tables = []
        while block is not None:  # one block at a time: the next is made when this one's hits are written
            tables.append(written(keyed.select("_text", *KEY).mapInArrow(_scan(block), "_k1 bigint, _k2 int, _spans array<bigint>, _items array<string>").distinct(), "hits"))
            block, after = after, next(blocks, None)
        hits = tables[0]
        for t in tables[1:]:
            hits = hits.unionByName(t)
        hits = hits.groupBy(*KEY).agg(F.collect_list("_spans").alias("_spans"), F.collect_list("_items").alias("_items"))
        out = keyed.join(hits, KEY, "left").mapInArrow(_marks(None, share), schema)
    own = [c for c in RESULTS if c not in (id_col, text_col)]
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], F.col("_text").alias(text_col), *own)


def remove_hits(docs: DataFrame, mode: str = "document", text_col: str = "text") -> DataFrame:
    """Of decontaminate()'s rows: drops contaminated documents, or cuts the hit spans out of them."""
    if mode == "document":
        return docs.where(~F.col("contaminated"))
    if mode != "span":
        raise ValueError("mode is 'document' or 'span'")
    cut = F.udf(_cut, "string")
    return docs.withColumn(text_col, F.when(F.size("hit_spans") > 0, cut(text_col, "hit_spans")).otherwise(F.col(text_col)))
