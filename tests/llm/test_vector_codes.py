import hashlib
import math

import numpy as np
import pytest

from corvane.llm.vector_codes import LEAF, Tree, kept_rows, vector_codes


def brute(rows, parts=8, entries=16, rounds=6):
    """{id: (code, error)} and the digest, by the definition, in Python's integers."""
    kept = [(i, [math.floor(4096 * x) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // parts
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for _, v in kept]
    books = [[cut[k][p] for k in range(min(entries, len(cut)))] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, p: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        own = [[nearest(c[p], p) for c in cut] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                if mine := [c[p] for c, o in zip(cut, own[p], strict=True) if o == e]:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    codes = [[nearest(c[p], p) for p in range(parts)] for c in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), bytes(code).hex(), sum(far(c[p], books[p][code[p]]) for p in range(parts))) for (i, _), c, code in zip(kept, cut, codes, strict=True)), digest


def vectors(n, seed, grid):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in np.round(rng.normal(0, 0.2, 16) * grid) / grid], int(i) % 3) for i in rng.permutation(n)]


# a coarse grid is full of ties and equal parts
@pytest.mark.parametrize("n,grid", [(1, 4096), (9, 4), (700, 4), (700, 1e6)])
def test_equals_brute_force(spark, n, grid):
    rows = vectors(n, n, grid)
    got = vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()
    expected, digest = brute(rows)
    assert sorted((str(r.vec_id), r.code, r.error) for r in got) == expected and {r.codebooks_sha256 for r in got} == {digest}
    by = {k: sum(r.error for r in got if r.label == k) for k in range(3)}
    assert all(r.label_error == by[r.label] for r in got)


def test_filter_assigns_like_a_scan_of_all():
    rng = np.random.default_rng(5)
    for n in (1, LEAF, LEAF + 1, 333):
        points, entries = rng.integers(-4, 4, (n, 2)), rng.integers(-4, 4, (7, 2))
        sums, counts, codes = Tree(points).assign(entries, coded=True)
        expected = ((points[:, None] - entries) ** 2).sum(axis=2).argmin(axis=1)
        assert codes.tolist() == expected.tolist() and counts.tolist() == np.bincount(expected, minlength=7).tolist()
        assert all(sums[e].tolist() == points[expected == e].sum(axis=0).tolist() for e in range(7))


def test_subtrees_are_assigned_whole():
    """Far clusters: nearly all points are never looked at."""
    rng = np.random.default_rng(6)
    centres = np.array([[0, 0], [10_000, 0], [0, 10_000], [10_000, 10_000]])
    tree = Tree(np.concatenate([c + rng.integers(-9, 9, (1024, 2)) for c in centres]))
    looked = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            looked.append(np.size(key))
            return super().__getitem__(key)

    tree.points = tree.points.view(Watched)
    assert tree.assign(centres)[1].tolist() == [1024] * 4 and sum(looked) == 0


def test_nulls_repeats_and_names(spark):
    nan, inf = float("nan"), float("inf")
    good = vectors(40, 3, 8)
    rows = [*good, (None, good[0][1], None), (None, good[1][1], None), good[5], (90, None, 1), (91, [None] * 16, 1), (92, [nan] + [0.0] * 15, 1), (93, [0.0] * 15 + [-inf], None), (94, [0.5] * 8, 7), (95, [], 7)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, code string, _id string").repartition(4)
    got = vector_codes(df).collect()
    expected, _ = brute([r for r in rows if r[0] not in (94, 95)])
    assert sorted((str(r.vec_id), r.code, r.error) for r in got if r.code) == expected
    assert sorted((r.vec_id, r.label_error) for r in got if r.code is None) == [(94, None), (95, None)]
    assert {r.label_error for r in got if r.label is None} == {sum(r.error for r in got if r.label is None)}
    assert vector_codes(df.where("false")).count() == 0 and kept_rows(df, "embedding").count() == len(rows) - 4
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes(df, parts=7)
    with pytest.raises(Exception, match="too large"):
        vector_codes(spark.createDataFrame([(1, [1e9] * 8, 1)], "vec_id long, embedding array<double>, label int"))
