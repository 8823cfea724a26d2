import collections

import numpy as np
import pytest

from corvane.llm import jaccard_join as module
from corvane.llm.jaccard_join import jaccard_join


def brute(rows, n, percent):
    """{id: (set size, component, links)}; ids are unique."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    links = collections.defaultdict(set)
    ids = sorted(i for i in sets if sets[i])
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    out = {}
    for i in sorted(sets):
        if i not in out:
            todo, comp = [i], {i}
            while todo:
                for j in links[todo.pop()] - comp:
                    comp.add(j)
                    todo.append(j)
            out |= {j: (len(sets[j]), min(comp), len(links[j])) for j in comp}
    return out


def near_copies(rng, groups, members, length=60, vocabulary=10_000):
    rows = []
    for g in range(groups):
        base = [f"w{x}" for x in rng.integers(vocabulary, size=length)]
        for m in range(members):
            words = list(base)
            for at in rng.integers(length, size=rng.integers(0, 4)):
                words[at] = f"x{rng.integers(10**6)}"
            rows.append((100 * g + m, " ".join(words[: length - int(rng.integers(0, 3))])))
    return rows


@pytest.mark.parametrize("percent", [60, 85, 100])
def test_blocks_and_buckets(spark, monkeypatch, percent):
    rng = np.random.default_rng(9)
    rows = near_copies(rng, 3, 40) + [(1000 + k, " ".join(f"v{x}" for x in rng.integers(6, size=40))) for k in range(60)]
    rows += [(2000, None), (2001, ""), (2002, "v1 v2"), (2003, "V1 v2"), (2004, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, 4, percent)
    for members in (512, 7):  # one block, many
        monkeypatch.setattr(module, "BLOCK_MEMBERS", members)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join(docs, 4, percent).collect()}
        assert got == want


def test_sets_whose_digests_clash_are_told_apart(spark):
    rows = near_copies(np.random.default_rng(3), 4, 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join(docs, digest_bits=3).collect()}
    assert got == brute(rows, 4, 85)


def test_a_small_vocabulary_does_not_chain_all_classes(spark, monkeypatch):
    """Rows that are dealt grow with the prefix shingles, not with the square of the classes."""
    counts, keep = {}, module.written

    def seen(df, name):
        out = keep(df, name)
        if name == "prefixes":
            counts[n] = sum(len({p for p in r.pivots if p is not None}) for r in out.select("pivots").collect())
        return out

    monkeypatch.setattr(module, "written", seen)
    for n in (200, 400):
        rng = np.random.default_rng(1)
        rows = [(k, " ".join(f"v{x}" for x in rng.integers(16, size=160))) for k in range(n)]
        assert {r.n_links for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}
    assert counts[400] < 3.2 * max(1, counts[200])
