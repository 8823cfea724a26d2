from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")


def test_one_row_of_each_component_stays(spark):
    import corpus_pipeline

    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcde")
    rows = [(1, a, "en"), (1, a, "en"), (2, a, "en")]  # repeated rows and a copy
    rows += [(2, b, "en"), (3, b, "de"), (3, b, None)]  # 2 has another text, too
    rows += [(None, b, "en"), (None, c, "en"), (None, c, "en"), (None, c + " x", "en")]  # copies without an id
    rows += [(7, d, "en"), (8, None, "en"), (8, None, "en"), (None, e, "en")]
    docs = spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, (r.text or "")[:1]) for r in corpus_pipeline.near(spark, docs.repartition(3), "").collect())
    assert got == {(1, "a"): 1, (2, "b"): 1, (None, "c"): 1, (7, "d"): 1, (8, ""): 2, (None, "e"): 1}
