"""Token counts under a unigram model, with scores shared along a trie of pre-tokens.

A pre-token is a run of non-space bytes, cut between an ASCII letter or digit and an ASCII
mark; one that starts a word has the word mark in front. The distinct pre-tokens of a chunk
are walked in the order of a trie: the forward scores (best log-probability and piece count
of each prefix) of a prefix that several share are computed once and stay on a stack, and
each end of a pre-token stores its count. Counts then go back to documents by hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .known import Known, held
from .shared import bounded_batches

MARK = "▁"
#: Log-probability of a byte that no piece covers.
UNKNOWN_BYTE = -20.0


def piece_scores(path: str) -> dict[str, float]:
    """Log-probabilities of a vocabulary in rank order, by Zipf's law (the files of merges hold ranks, not probabilities)."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_unknown(i) or m.is_control(i) or m.is_unused(i))]
    total = math.log(sum(1 / (r + 2.7) for r in range(len(pieces))))
    return {p: -math.log(r + 2.7) - total for r, p in enumerate(pieces)}


def trie_counts(tokens: list[str], scores: dict[str, float]) -> list[int]:
    """Pieces in the best segmentation of each token; of equal scores, the fewest pieces. A character of no piece counts its bytes."""
    longest = max(map(len, scores), default=1)
    out = [0] * len(tokens)
    best, count, text = [0.0], [0], ""
    get = scores.get
    for k in sorted(range(len(tokens)), key=tokens.__getitem__):  # the trie, depth first
        word = tokens[k]
        shared, top = 0, min(len(word), len(text))
        while shared < top and word[shared] == text[shared]:
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for j in range(shared + 1, len(word) + 1):
            size = len(word[j - 1].encode())
            s, c = best[j - 1] + UNKNOWN_BYTE * size, count[j - 1] + size
            for i in range(max(0, j - longest), j):
                p = get(word[i:j])
                if p is not None:
                    p += best[i]
                    if p > s or (p == s and count[i] + 1 < c):
                        s, c = p, count[i] + 1
            best.append(s)
            count.append(c)
        text = word
        out[k] = count[-1]
    return out


def _memory(path: str) -> Known:
    scores = piece_scores(path)
    return Known(lambda words, _: [(c,) for c in trie_counts([w.decode() for w in words], scores)], np.uint32)


def _counts(path: str):
    def run(batches):
        known = held(("token counts", path), lambda: _memory(path))
        for batch in batches:
            pre, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, data, offsets in W.chunks(batch["_text"]):
                w = W.Words(data, offsets, W.SPACES, cut=True)
                head = np.ones(len(w.starts), bool)
                head[1:] = w.starts[1:] != w.ends[:-1]
                head[w.first[:-1][w.n > 0]] = True
                h = np.where(head, w.hashes(), ~w.hashes())
                mark = MARK.encode()
                at, _, flat = known.look(h, lambda i, w=w, head=head: mark + w.word(i) if head[i] else w.word(i))
                sums = np.concatenate([[0], np.cumsum(flat[at], dtype=np.int64)])
                pre.append(w.n)
                total.append(sums[w.first[1:]] - sums[w.first[:-1]])
            yield pa.RecordBatch.from_pydict({"_id": batch["_id"], "n_pretokens": pa.array(np.concatenate(pre).astype(np.int64)), "n_tokens": pa.array(np.concatenate(total).astype(np.int64))})

    return run


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_pretokens and n_tokens. No shuffle.

    Null and empty texts count 0; repeated rows count each; other columns are ignored; an
    empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return base.mapInArrow(_counts(vocabulary_path), f"_id {id_type}, n_pretokens bigint, n_tokens bigint").withColumnRenamed("_id", id_col)
