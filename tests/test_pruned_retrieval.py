import random

from pyspark.sql import functions as F

from corvane.operators import retrieve


def tables(spark, n_chunks, n_tasks, seed=1):
    """Words by Zipf's law; each task holds a passage of one chunk, of which there are copies."""
    rng = random.Random(seed)
    words, weights = [f"w{k}" for k in range(2000)], [1 / (k + 1) for k in range(2000)]
    texts = [" ".join(rng.choices(words, weights, k=80)) for _ in range(n_chunks)]
    for k in range(0, n_chunks - 12, 20):
        for j in range(1, 12):
            texts[k + j] = " ".join(rng.sample(texts[k].split(), 60))
    asked = [" ".join(texts[20 * (k % (n_chunks // 20))].split()[:30]) for k in range(n_tasks)]
    chunks = spark.createDataFrame([(k // 3, k % 3, t) for k, t in enumerate(texts)], "doc_id long, seq int, text string")
    return spark.createDataFrame(list(enumerate(asked)), "item_id long, text string"), chunks


def test_same_rows_from_fewer_pairs(spark):
    tasks, chunks = (t.coalesce(2) for t in tables(spark, 500, 12))
    steps = retrieve.pruned(tasks, chunks, 10)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(retrieve.topk_batch(tasks, chunks, 10, prune=True)) == rows(retrieve.topk_batch_cross(tasks, chunks, 10))
    joined = steps.found.agg(F.sum("n")).first()[0]
    assert joined < 0.5 * retrieve._hits(tasks, chunks, 500).agg(F.sum("score")).first()[0]


def test_edges(spark):
    chunks = spark.createDataFrame([(1, 0, "a b c"), (1, 1, "b"), (2, 0, "c c d"), (3, 0, ""), (4, 0, None)], "doc_id long, seq int, text string")
    tasks = spark.createDataFrame([(1, "a b"), (2, "zzz"), (3, "c d e"), (4, ""), (5, None)], "item_id long, text string")
    for k in (1, 9):
        got = sorted(map(tuple, retrieve.topk_batch(tasks, chunks, k, prune=True).collect()))
        assert got == sorted(map(tuple, retrieve.topk_batch(tasks, chunks, k, prune=False).collect())) and len(got) == 5 * min(k, 5)
    assert retrieve.topk_batch(tasks.where("false"), chunks, 3, prune=True).count() == 0
    assert retrieve.topk_batch(tasks, chunks.where("false"), 3, prune=True).count() == 0


def test_cross_keeps_the_best_of_blocks(spark, monkeypatch):
    """every pair is compared, in blocks; only the best of each block are ranked, with nulls and ties as in SQL."""
    tasks, chunks = (t.coalesce(2) for t in tables(spark, 500, 12))
    chunks = chunks.withColumn("text", F.when(F.col("doc_id") % 7 != 0, F.col("text")))
    tasks = tasks.unionByName(spark.createDataFrame([(90, None), (91, ""), (92, "zzz")], "item_id long, text string"))
    texts, asked = ([tuple(r) for r in df.collect()] for df in (chunks, tasks))
    want = []
    for item, text in asked:
        score = lambda t, q=text: None if t is None or q is None else len(set(t.split()) & set(q.split()))
        pairs = sorted((-1 if score(t) is None else score(t), -d, -s) for d, s, t in texts)[::-1][:10]
        want += [(item, rk, -d, -s, None if x < 0 else x) for rk, (x, d, s) in enumerate(pairs, 1)]
    ranked, sizes = retrieve._ranked, []
    monkeypatch.setattr(retrieve, "_ranked", lambda scored, k: sizes.append(scored.count()) or ranked(scored, k))
    for c, t in ((1 << 14, 1 << 13), (100, 4)):
        monkeypatch.setattr(retrieve, "CHUNKS", c)
        monkeypatch.setattr(retrieve, "TASKS", t)
        assert sorted(map(tuple, retrieve.topk_batch_cross(tasks, chunks, 10).collect()), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
    assert max(sizes) <= 15 * 12 * 10 < 15 * 500
    assert retrieve.topk_batch_cross(tasks.where("false"), chunks, 3).count() == retrieve.topk_batch_cross(tasks, chunks.where("false"), 3).count() == 0
    assert retrieve.topk_batch_cross(tasks, chunks, 600).count() == 15 * 500
