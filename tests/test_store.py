"""The store's levels, commits and index: what is interrupted loses nothing and stands in nobody's way."""

import pytest

from corvane.operators import store
from corvane.operators.store import Part


def rows(spark, *r):
    return spark.createDataFrame(list(r), "id string, text string, wseq long").coalesce(1)


def content(s):
    return [(r.id, r.text) for r in s.all().collect()]


class Killed(Exception):
    pass


def filled(spark, path, n=5, fan=2, batches=False):
    s = store.ChunkStore(spark, str(path), fan=fan, indexed=False)
    for k in range(n):
        s.add(rows(spark, (f"k{k}", f"t{k}", 1), ("same", f"v{k}", 2)), batch=f"b-{k}" * batches)
    return s


def test_levels_bound_the_tables_of_a_thousand_adds():
    parts, most, rewritten = [], 0, 0
    for n in range(1, 1001):
        parts.append(Part(f"add-{n}", 0, n, n))
        while merge := store.due(parts, 8):
            assert [p.last + 1 for p in merge[:-1]] == [p.first for p in merge[1:]]
            parts.append(Part("run", 1 + max(p.level for p in merge), merge[0].first, merge[-1].last))
            rewritten += merge[-1].last - merge[0].first + 1
        parts = store.live(parts)
        most = max(most, len(parts))
        assert [n for p in parts for n in range(p.first, p.last + 1)] == list(range(1, n + 1))
    assert most <= 7 * 4 and rewritten <= 4 * 1000


def test_compaction_keeps_the_content_and_the_batches(spark, tmp_path):
    s = filled(spark, tmp_path / "s", batches=True)
    want = content(s)
    assert want == [("k0", "t0"), ("same", "v4"), ("k1", "t1"), ("k2", "t2"), ("k3", "t3"), ("k4", "t4")]
    assert s.compact() == 3 and [n.split("-")[:2] for n in s.tables()] == [["run", "2"], ["add", "00000005"]]
    assert content(s) == want and len(list((tmp_path / "s").iterdir())) == 2 and s.compact() == 0
    assert not s.add(rows(spark, ("same", "lost", 1)), batch="b-1") and not s.add(rows(spark, ("same", "lost", 1)), batch="b-4")
    assert s.add(rows(spark, ("same", "v5", 1)), batch="b-5") and dict(content(s))["same"] == "v5"
    assert s.compact(full=True) == 1 and len(s.tables()) == 1 and [k for k, _ in content(s)] == [k for k, _ in want]


@pytest.mark.parametrize("stage", ["_index", "_commit", "_delete"])
def test_a_killed_compaction_is_done_again(spark, tmp_path, monkeypatch, stage):
    s = filled(spark, tmp_path / "s")
    want = content(s)

    def killed(*_):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(store.ChunkStore, stage, killed)
        for _ in range(2):  # and again: each try has a name of its own
            with pytest.raises(Killed):
                s.compact()
    again = store.ChunkStore(spark, str(tmp_path / "s"), fan=2, indexed=False)
    assert content(again) == want
    again.add(rows(spark, ("k9", "t9", 1)))
    assert again.compact() >= 1 and content(again) == [*want, ("k9", "t9")]
    again.compact()
    assert len(list((tmp_path / "s").iterdir())) == len(again.tables()) == 2


def test_an_unfinished_add_is_skipped_and_cleared(spark, tmp_path):
    s = filled(spark, tmp_path / "s", n=3)
    (tmp_path / "s" / "add-00000004-x").mkdir()
    s.add(rows(spark, ("late", "l", 1)))
    assert (tmp_path / "s" / "add-00000005").exists() and ("late", "l") in content(s)
    s.compact()
    assert len(s.tables()) == 1 and not (tmp_path / "s" / "add-00000004-x").exists()


def test_a_state_of_the_earlier_layout_is_read(spark, tmp_path):
    s = filled(spark, tmp_path / "s", n=2)
    s._merged().write.parquet(str(tmp_path / "s" / "state-00000002"))
    s.add(rows(spark, ("k7", "t7", 1)))
    assert s.tables() == ["state-00000002", "add-00000003"] and [k for k, _ in content(s)] == ["k0", "same", "k1", "k7"]


def test_queries_read_their_buckets(spark, tmp_path):
    s = store.ChunkStore(spark, str(tmp_path / "s"), fan=2)
    s.add(rows(spark, ("x", "red blue", 1), ("y", "red", 2), ("z", "blue blue green", 3), ("e", "", 4), ("n", None, 5)))
    s.add(rows(spark, ("x", "grey", 1), ("w", "red blue green", 2)))
    s.add(rows(spark, ("y", "blue red green red", 1)))
    plain = lambda text, k: [(r.id, r.score) for r in store.topk_single(s._merged().drop("_last"), text, k, ("pos",)).collect()]
    asked = [(t, k) for t in ("red blue", "green grey", "none", "", "blue") for k in (0, 1, 3, 10)]

    def same():
        for text, k in asked:
            assert [(r.id, r.score) for r in s.query(text, k).collect()] == plain(text, k), (text, k)

    same()
    plan = s.postings(["red"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(bucket") == 3 and "text" not in plan
    s.compact()
    same()
    store.ChunkStore(spark, str(tmp_path / "s"), indexed=False).add(rows(spark, ("u", "red green", 1)))  # without postings: read whole
    same()
    got = s.query("red green", 2)
    assert got.columns == s._merged().drop("_last").columns + ["score"]
