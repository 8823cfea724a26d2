"""Log-probabilities of texts under an n-gram model of the corpus, by weighted backoff automata.

The model is one of hierarchical priors, as those of MacKay and Peto (1995): a word w after a context h has
probability (c(h, w) + m p(w | h without its first word)) / (c(h) + m), down to (c(w) + 0.5) / (N + 0.5 (V + 1)).
Here m = a c(h) ** POWER, with an a for each order that leaves as much to shorter contexts as Good and Turing
find new. A context's weight of what it has not seen, m / (c(h) + m), is that of a failure arc, so counts
are all that the model needs, and the probabilities after any context sum to 1.

No task and no broadcast holds the model, which grows with the corpus. Documents are taken together in
chunks of about ``CHUNK`` tokens, written once as token numbers. A chunk asks for the n-grams that it
holds, each once with its count in the chunk's training texts: hashes in sorted order, dealt by their
ranges. A range's task sums the counts of each n-gram over all chunks and answers each chunk in its own
order. With the answers a chunk has the part of the model that its texts can reach: an automaton whose
states are the n-grams that the corpus has as contexts, with an arc for each n-gram and a failure arc
to the next shorter context. Each text runs through it once from left to right.

Words and n-grams are known by 64 bits of hash. The begin of a text is a context like the end of one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import bounded_batches, written

#: Tokens of a chunk, n-grams of a range (as a mean; an n-gram counts once for each chunk that holds it), and classes of counts in a doubling.
CHUNK, RANGE, CLASSES = 1 << 20, 1 << 20, 8
#: What a context leaves to shorter ones grows with this power of its count, as its kinds of followers do.
POWER = 0.75
_U = np.uint64
#: Stands for the end of a text, and before its first word.
END = W.mix(np.array([0x6C6D5F656E64], np.uint64))[0]


def _packed(values: np.ndarray) -> bytes:
    """Non-negative integers: their bytes in planes, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n).T).view("<u4").ravel()


_CHUNK = "_chunk bigint, _sizes array<int>, _held array<boolean>, _words binary, _n int, _tokens binary"


def _chunks(most: int):
    """Rows (id, text, held out) to rows of about ``most`` tokens; a longer text is in one with what came before it."""

    def run(batches):
        at, number = TaskContext.get().partitionId() << 32, 0
        hashes, sizes, held, ids, total = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, total
            words, tokens, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")  # frequent words have small numbers
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            all_sizes = np.concatenate(sizes).astype(np.int32)
            ends = pa.array([0, len(all_sizes)], pa.int32())
            row = {"_chunk": pa.array([at + number], pa.int64())}
            own = pa.chunked_array(ids).combine_chunks()
            row["_ids"] = pa.ListArray.from_arrays(ends, own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own)
            row["_sizes"] = pa.ListArray.from_arrays(ends, pa.array(all_sizes))
            row["_held"] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(held)))
            row |= {"_words": pa.array([words[order].tobytes()], pa.binary()), "_n": pa.array([total], pa.int32()), "_tokens": pa.array([_packed(rank[tokens])], pa.binary())}
            number, total = number + 1, 0
            for x in (hashes, sizes, held, ids):
                x.clear()
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            out = np.asarray(batch["_held"].to_numpy(zero_copy_only=False), bool)
            for first, data, offsets in W.chunks(batch["_text"]):
                w = W.Words(data, offsets, W.SPACES, lower=True)
                many = len(w.n)
                hashes.append(np.insert(w.hashes(), w.first[1:], END))
                sizes.append(w.n + 1)
                held.append(out[first : first + many])
                ids.append(batch["_id"].slice(first, many))
                total += len(hashes[-1])
                if total >= most:
                    yield flush()
        if sizes:
            yield flush()

    return run


class Grams:
    """The n-grams of a chunk: of each order, the places of the last token, and the n-grams in the order of their hashes."""

    def __init__(self, row: dict, order: int):
        sizes, words = np.asarray(row["_sizes"], np.int64), np.frombuffer(row["_words"], np.uint64)
        tokens = _unpacked(row["_tokens"], row["_n"]).astype(np.int64)
        self.docs, self.sizes = len(sizes), sizes
        # each text with its begin before it
        self.first = np.cumsum(sizes) - sizes + np.arange(self.docs)
        total = len(tokens) + self.docs
        self.begin = np.zeros(total, bool)
        self.begin[self.first] = True
        seq = np.full(total, END, np.uint64)
        seq[~self.begin] = words[tokens]
        place = np.arange(total) - np.repeat(self.first, sizes + 1)
        train = np.repeat(~np.asarray(row["_held"], bool), sizes + 1)
        self.at, self.keys, self.number, self.here = [], [], [], []
        ends, h = seq == END, seq
        for k in range(1, order + 1):
            if k > 1:
                h = np.concatenate([h[:1], W.mix(h[:-1] ^ W.mix(seq[1:] + _U(k)))])
            at = np.flatnonzero(place >= max(1, k - 1))
            own = h[at]
            if k > 1:  # the last bit of a longer n-gram says whether it ends the text and so is no context
                own = (own & ~_U(1)) | ends[at].astype(np.uint64)
            keys, number = np.unique(own, return_inverse=True)
            self.at.append(at)
            self.keys.append(keys)
            self.number.append(number)
            self.here.append(np.bincount(number[train[at]], minlength=len(keys)))


def _width(values: np.ndarray) -> int:
    most = int(values.max(initial=0))
    return next(b for b in (1, 2, 4, 8) if most < 1 << 8 * b)


_ASKED = "order int, range int, chunk bigint, n int, gap int, keys binary, width int, counts binary"


def _requests(order: int, ranges: int):
    """Chunks to a row for each order and range of hashes that it has n-grams in: sorted hashes by their gaps, and counts."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row, order)
                for k in range(order):
                    keys, here = grams.keys[k], grams.here[k]
                    if not len(keys):  # texts too short for this order
                        continue
                    own = ((keys >> _U(32)) * _U(ranges)) >> _U(32)
                    cuts = np.flatnonzero(np.diff(own)) + 1
                    out = []
                    for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                        gaps = np.diff(keys[a:b])
                        gap = 6 if not len(gaps) or int(gaps.max()) < 1 << 48 else 8
                        packed = keys[a : a + 1].tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :gap].tobytes()
                        width = _width(here[a:b])
                        out.append((k + 1, int(own[a]), row["_chunk"], b - a, gap, packed, width, here[a:b].astype(f"<u{width}").tobytes()))
                    names = [x.split()[0] for x in _ASKED.split(", ")]
                    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
                    for i in range(0, len(out), 512):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 512], strict=True), types, strict=True)], names)

    return run


def _keys(n: int, gap: int, data: bytes) -> np.ndarray:
    gaps = np.zeros((n, 8), np.uint8)
    gaps[0] = np.frombuffer(data, np.uint8, 8)
    gaps[1:, :gap] = np.frombuffer(data, np.uint8, offset=8).reshape(n - 1, gap)
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


_TOTALS = "chunk bigint, order int, range int, width int, counts binary, class int, kinds bigint, contexts bigint, total bigint"


def _totals(table: pa.Table) -> pa.Table:
    """A range: the answers to its chunks, and how many n-grams (and contexts) have counts of each class."""
    rows = table.to_pylist()
    order, sizes = rows[0]["order"], [r["n"] for r in rows]
    keys = np.concatenate([_keys(r["n"], r["gap"], r["keys"]) for r in rows])
    here = np.concatenate([np.frombuffer(r["counts"], f"<u{r['width']}").astype(np.int64) for r in rows])
    kinds, number = np.unique(keys, return_inverse=True)
    total = np.zeros(len(kinds), np.int64)
    np.add.at(total, number, here)
    out = []
    for r, answer in zip(rows, np.split(total[number], np.cumsum(sizes)[:-1]), strict=True):
        width = _width(answer)
        out.append((r["chunk"], order, r["range"], width, answer.astype(f"<u{width}").tobytes(), None, None, None, None))
    context = (kinds & _U(1) == 0) | (order == 1)
    live = total > 0
    classes = (np.log2(total[live]) * CLASSES).astype(np.int64)
    for c in np.unique(classes).tolist():
        own = classes == c
        out.append((None, order, rows[0]["range"], None, None, c, int(own.sum()), int((own & context[live]).sum()), int(total[live][own].sum())))
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in _TOTALS.split(", ")])


def prior_weight(contexts: list[tuple[int, float]], once: int) -> float:
    """The a for which what contexts (how many, mean count) leave to shorter ones is, over their counts, the number of n-grams that occur once.

    That is the share of what is new by Good and Turing. It is below the sum of all counts unless all are new.
    """
    low, high = 1e-3, 1e6
    for _ in range(80):
        a = math.sqrt(low * high)
        left = sum(n * c * a / (a + c ** (1 - POWER)) for n, c in contexts)
        low, high = (a, high) if left < once else (low, a)
    return math.sqrt(low * high)


class Automaton:
    """The states and arcs of the n-grams of a chunk, from their counts in the corpus.

    counts: by order. weights: the a of each order from the second. State 0 is the empty context.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], weights: list[float], tokens: int, words: int):
        order = len(counts)
        zero = np.log10(tokens + 0.5 * (words + 1))
        self.unigram = np.log10(counts[0] + 0.5) - zero
        self.words = len(counts[0])
        # places of one occurrence, and with it the n-grams without the last and without the first token
        number = [np.full(len(grams.begin), -1) for _ in range(order)]
        for k in range(order):
            number[k][grams.at[k]] = grams.number[k]
        end = np.searchsorted(grams.keys[0], END)
        number[0][grams.begin] = end
        self.tokens = number[0]
        state = [np.full(len(c), 0) for c in counts]  # of each n-gram as a context
        fail, back, size = [np.zeros(1, np.int64)], [np.zeros(1)], 1
        keys, logs, onward = [np.arange(self.words)], [self.unigram], []
        p = 10.0**self.unigram
        for k in range(order):
            one = np.zeros(len(counts[k]), np.int64)
            one[grams.number[k]] = grams.at[k]
            live = counts[k] > 0
            if k:
                before, shorter = number[k - 1][one - 1], number[k - 1][one]
                # both of a live n-gram are live
                whole = np.maximum(counts[k - 1][before], 1)  # none is 0 before a live n-gram
                m = weights[k - 1] * whole**POWER
                p = (counts[k] + m * p[shorter]) / (whole + m)
                keys.append((state[k - 1][before] * self.words + number[0][one])[live])
                logs.append(np.log10(p[live]))
            if k < order - 1:
                state[k][live] = size + np.arange(int(live.sum()))
                size += int(live.sum())
                fail.append(state[k - 1][shorter][live] if k else np.zeros(int(live.sum()), np.int64))
                m = weights[k] * counts[k][live] ** POWER
                back.append(np.log10(m / (counts[k][live] + m)))
                onward.append(state[k][live] if k else state[0])
            else:
                onward.append(state[k - 1][shorter][live] if k else state[0])
        self.start = int(state[0][end])
        self.arcs = dict(zip(np.concatenate(keys).tolist(), range(sum(map(len, keys))), strict=True))
        self.logs, self.onward = np.concatenate(logs).tolist(), np.concatenate(onward).tolist()
        self.fail, self.back = np.concatenate(fail).tolist(), np.concatenate(back).tolist()

    def score(self, tokens: list[int]) -> float:
        """One walk over a text: along the arc of each token, or down failure arcs until there is one."""
        state, total = self.start, 0.0
        arc, words, logs, onward, back, fail = self.arcs.get, self.words, self.logs, self.onward, self.back, self.fail
        for t in tokens:
            a = arc(state * words + t)
            while a is None:
                total += back[state]
                state = fail[state]
                a = arc(state * words + t)
            total += logs[a]
            state = onward[a]
        return total


def _scores(order: int, weights: list[float], tokens: int, words: int):
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunks.drop_columns(["_ids"]).to_pylist()[0]
        grams = Grams(row, order)
        counts: list[list[np.ndarray]] = [[] for _ in range(order)]
        for r in sorted(answers.select(["order", "range", "width", "counts"]).to_pylist(), key=lambda r: (r["order"], r["range"])):
            counts[r["order"] - 1].append(np.frombuffer(r["counts"], f"<u{r['width']}").astype(np.int64))
        model = Automaton(grams, [np.concatenate(c) if c else np.zeros(0, np.int64) for c in counts], weights, tokens, words)
        starts = np.cumsum(grams.sizes) - grams.sizes
        own = model.tokens[~grams.begin]
        known = np.concatenate(counts[0])[own] > 0
        sequence, ends = own.tolist(), (starts + grams.sizes).tolist()
        scores = [model.score(sequence[a:b]) for a, b in zip(starts.tolist(), ends, strict=True)]
        ids = chunks["_ids"].combine_chunks()
        return pa.table(
            [ids.flatten(), pa.array(row["_held"], pa.bool_()), pa.array(grams.sizes), pa.array(np.add.reduceat(known.astype(np.int64), starts)), pa.array(np.add.reduceat(model.unigram[own], starts)), pa.array(scores, pa.float64())],
            ["_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    return run


def held_out_by_id(id_col: str) -> Column:
    """Whether crc32 of the id as text is 1 modulo 5; a null id is an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def lm_scores(docs: DataFrame, order: int = 2, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, in_range: int = RANGE) -> DataFrame:
    """Per row: the id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Learns from the rows that are not held out (by default ``held_out_by_id``; a null is not held out) and
    scores all. Tokens are words between ASCII white space, A-Z lower-cased, and one end a text. base_score is
    the sum of unigram terms, score the log10 probability under the model of ``order``; of order 1 they are
    equal. Null and empty texts are their end alone; repeated rows count each; a long text is scored
    whole; without training texts every word is unknown and scores 0;
    ``chunk`` and ``in_range`` (tokens of a chunk, n-grams of a range) change no result; other columns are ignored; an empty
    table gives an empty one.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    bounded_batches(docs.sparkSession)
    rule = held_out_by_id(id_col) if held_out is None else held_out
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(rule, F.lit(False)).alias("_held"))
    id_type = rows.schema["_id"].dataType.simpleString()
    chunks = written(rows.mapInArrow(_chunks(chunk), f"_chunk bigint, _ids array<{id_type}>, {_CHUNK.partition(', ')[2]}"), "lm-chunks")
    total = chunks.agg(F.sum(F.col("_n").cast("bigint"))).first()[0] or 0
    asked = chunks.drop("_ids").mapInArrow(_requests(order, -(-max(total, 1) // in_range)), _ASKED)
    counted = written(asked.groupBy("order", "range").applyInArrow(_totals, _TOTALS), "lm-counts")
    found = counted.where("class is not null").groupBy("order", "class").agg(*[F.sum(c).alias(c) for c in ("kinds", "contexts", "total")]).collect()
    by = {k: [r for r in found if r["order"] == k] for k in range(1, order + 1)}
    kinds = {k: sum(r["kinds"] for r in by[k]) for k in by}
    once = {k: sum(r["kinds"] for r in by[k] if r["class"] == 0) for k in by}
    weights = [prior_weight([(r["contexts"], r["total"] / r["kinds"]) for r in by[k - 1]], once[k]) if kinds[k] else 1.0 for k in range(2, order + 1)]
    tokens = sum(r["total"] for r in by[1])
    answers = counted.where("chunk is not null").select(F.col("chunk").alias("_chunk"), "order", "range", "width", "counts")
    schema = f"_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    out = chunks.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(_scores(order, weights, tokens, kinds[1]), schema)
    return out.select(F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
