import numpy as np

from corvane.llm.jaccard_join import jaccard_join


def test_empty_blocks_add_no_links(spark, monkeypatch):
    base = [f"w{k}" for k in range(400)]
    rng = np.random.default_rng(5)
    rows = []
    for g in range(24):  # pairs of near copies in two blocks, of which one is often empty
        words = [f"{g}{w}" for w in base]
        for c in range(2):
            rows.append((10 * g + c, " ".join([*words, *(f"x{rng.integers(10**9)}" for _ in range(3))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr("corvane.llm.jaccard_join.BLOCK_SHINGLES", 400)
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join(docs).collect()}
    assert got == {i: (i - i % 10, 1) for i, _ in rows}
