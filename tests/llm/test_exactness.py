import hashlib

import numpy as np

from corvane.llm import words
from corvane.llm.decontaminate import decontaminate, remove_hits
from corvane.llm.jaccard_join import jaccard_join
from corvane.llm.substring_dedup import substring_dedup


def colliding(m=11):
    """Two byte strings of 2**m letters that every polynomial hash modulo 2**64 takes for equal."""
    a = b"a"
    for _ in range(m):
        a += bytes(195 - x for x in a)
    return a.decode(), bytes(195 - x for x in a).decode()


def test_words_of_any_pattern_differ():
    rng = np.random.default_rng(4)
    a, b = colliding()
    texts = [a, b, "x" * 8, "x" * 9, "x", "x" * 127, "x" * 128, "x" * 129, "é" * 4, *("".join(rng.choice(list("ab"), n)) for n in range(1, 140))]
    data = np.frombuffer(" ".join(texts + texts).encode(), np.uint8)
    w = words.Words(data, np.array([0, len(data)]), words.SPACES)
    for seed in (0, 1):
        h = w.hashes(seed)
        assert len(set(h.tolist())) == len(set(texts)) and (h[: len(texts)] == h[len(texts) :]).all()
    assert not set(w.hashes(0).tolist()) & set(w.hashes(1).tolist())


def test_colliding_words_are_different(spark):
    a, b = colliding()
    rest = [f"r{k}" for k in range(34)]
    docs = spark.createDataFrame([(1, " ".join([a, *rest])), (2, " ".join([b, *rest]))], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup(docs).collect()} == {0}
    short = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert sorted((r.component_id, r.n_links) for r in jaccard_join(short).collect()) == [(1, 0), (2, 0)]


def test_decontaminate_with_columns_of_all_result_names(spark):
    rows = [(1, "one two three four", False, 7, 7, 7, "x", ["y"], [1]), (2, "clean words here", True, 7, 7, 7, "x", ["y"], [1]), (3, None, True, 7, 7, 7, "x", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, contaminated boolean, n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, hit_spans array<long>")
    bench = spark.createDataFrame([(5, "TWO three"), (6, "Three four five")], "item_id long, text string")
    for block in (1 << 20, 1):  # in the scan, and by a join
        out = decontaminate(docs, bench, keep=tuple(docs.columns), block_bytes=block)
        got = {r.doc_id: r for r in out.collect()}
        assert len(out.columns) == len(set(out.columns)) == 9
        assert [got[k].contaminated for k in (1, 2, 3)] == [True, False, False] and got[1].items == ["5"] and got[1].n_hit == 2
        assert got[1].items_sha256 == hashlib.sha256(b"5").hexdigest() and got[3].n_words == 0
        assert [r.doc_id for r in remove_hits(out).orderBy("doc_id").collect()] == [2, 3]
        assert remove_hits(out, "span").where("doc_id = 1").first().text == "one  four"


def test_decontaminate_blocks(spark):
    words_ = [f"w{(i * i) % 97}" for i in range(400)]
    docs = spark.createDataFrame([(k, " ".join(words_[k : k + 60])) for k in range(0, 300, 10)] * 2 + [(None, "!"), (900, "")], "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(words_[k : k + 15])) for k in range(5, 300, 40)] + [(1000, "w4"), (1000, "w4"), (None, "w9 w16")], "item_id long, text string")
    one, more = (sorted(map(str, decontaminate(docs, items, block_bytes=b).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans").collect())) for b in (1 << 20, 90))
    assert one == more and len(one) == 62
    assert decontaminate(docs, items.where("false"), block_bytes=1).where("contaminated").count() == 0


def test_benchmark_blocks_come_one_at_a_time(spark, monkeypatch):
    from corvane.llm import decontaminate as module

    alive, most = [], []

    class Grams(module._Grams):
        def __init__(self, ids, texts, n):
            super().__init__(ids, texts, n)
            alive.append(len(ids))
            most.append(sum(len(t) for t in texts))

    monkeypatch.setattr(module, "_Grams", Grams)
    bench = spark.createDataFrame([(k, f"item{k} " * 10) for k in range(30)], "item_id long, text string")
    assert sum(1 for _ in module.read_items(bench, 13, "item_id", "text", 200)) == 13 and sum(alive) == 30 and max(most) <= 200
