import collections
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corvane.llm import lm_scoring
from corvane.llm.lm_scoring import POWER, lm_scores, prior_weight

END = object()


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), END]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


class Brute:
    """The model by its definition, over tuples of words."""

    def __init__(self, texts, order):
        self.c = [collections.Counter() for _ in range(order)]
        for t in texts:
            w = [END, *tokens(t)]
            for k in range(order):
                self.c[k].update(tuple(w[i - k : i + 1]) for i in range(max(k, 1), len(w)))
        self.n, self.v, self.order = sum(self.c[0].values()), len(self.c[0]), order
        self.a = []
        for k in range(1, order):
            own = collections.defaultdict(list)
            for h, c in self.c[k - 1].items():
                own[int(math.log2(c) * lm_scoring.CLASSES)].append((c, k == 1 or h[-1] is not END))
            contexts = [(sum(x for _, x in v), sum(c for c, _ in v) / len(v)) for v in own.values()]
            self.a.append(prior_weight(contexts, sum(c == 1 for c in self.c[k].values())) if self.c[k] else 1.0)

    def p(self, h, w):
        if not h:
            return (self.c[0][(w,)] + 0.5) / (self.n + 0.5 * (self.v + 1))
        whole = self.c[len(h) - 1][h]
        if not whole:
            return self.p(h[1:], w)
        m = self.a[len(h) - 1] * whole**POWER
        return (self.c[len(h)][*h, w] + m * self.p(h[1:], w)) / (whole + m)

    def score(self, text):
        w = [END, *tokens(text)]
        return sum(math.log10(self.p(tuple(w[max(0, i - self.order + 1) : i]), w[i])) for i in range(1, len(w)))

    def row(self, i, text):
        t = tokens(text)
        return (str(i), held(i), len(t), sum(self.c[0][(w,)] > 0 for w in t), self.n, sum(math.log10(self.p((), w)) for w in t), self.score(text))


def corpus():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)] + ["É", "Tail."]
    docs = [(k, " ".join(rng.choices(words, range(42, 0, -1), k=rng.randint(0, 60))).replace("w1", "W1")) for k in range(60)]
    return [*docs, (None, "no id at all"), (None, None), (61, ""), (62, "only here, never there"), (62, "only here, never there"), (63, " \t\n"), (64, "w1 " * 3000), (65, docs[0][1]), (66, docs[0][1])]


@pytest.mark.parametrize("order,chunk,in_range", [(1, 1 << 20, 1 << 20), (2, 1 << 20, 1 << 20), (2, 50, 40), (3, 700, 300), (4, 1, 1000)])
def test_equals_brute_force(spark, order, chunk, in_range):
    docs = corpus()
    model = Brute([t for i, t in docs if not held(i)], order)
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score int, _chunk string").repartition(3)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_scores(df, order, chunk=chunk, in_range=in_range).collect())
    expected = sorted(model.row(*d) for d in docs)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    assert [x for r in got for x in r[5:]] == pytest.approx([x for r in expected for x in r[5:]], rel=1e-9)


def test_probabilities_sum_to_one():
    docs = corpus()
    model = Brute([t for _, t in docs], 3)
    for h in [(), (END,), ("w1",), ("w1", "w1"), ("w3", "w0"), ("never", "w2")]:
        assert sum(model.p(h, w) for (w,) in model.c[0]) + model.p(h, "unknown") == pytest.approx(1)


def test_learns_what_follows_what(spark):
    rng = random.Random(3)
    follow = {f"a{k}": [f"a{(k * 7 + j) % 30}" for j in range(3)] for k in range(30)}

    def text():
        w = ["a0"]
        for _ in range(50):
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w)

    rows = lm_scores(spark.createDataFrame([(k, text()) for k in range(100)], "doc_id long, text string")).collect()
    out = [r for r in rows if r.held_out]
    assert out and all(r.score > 0.5 * r.base_score for r in out)  # logs: nearer to 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert lm_scores(df.where("false")).count() == 0
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_scores(df, 3, held_out=F.lit(True)).collect()] in ([(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)], [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)])
    assert {r.held_out for r in lm_scores(df, held_out=F.lit(None).cast("boolean")).collect()} == {False}
