import collections
import math
import re

import numpy as np
import pytest

from corvane.llm.line_dedup import line_dedup

NAMES, TOWNS = ("Ann Bob Cy Dee Eve Fay Gus".split(), "Rome Oslo Bern Kiel Lyon Bath Linz Metz".split())
SITES = "News Blog Wiki Shop Mail Forum".split()


def brute(rows, min_docs=8, constant=0.75, depth=3, min_tokens=3, loose=0.6):
    """{(id, text): gone line numbers}, by the definition."""
    mask = lambda t: re.sub(r"[!-/:-~]*+[0-9][!-~]*+", "<*>", t)
    lines = []
    for doc in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        for no, raw in enumerate((doc[1] or "").split("\n") if doc[1] is not None else []):
            line = raw.strip(" \t\x0b\f\r").replace("\t", " ")
            if line:
                n, m = line.count(" ") + 1, mask(line)
                leaf = ("s", m) if n < min_tokens else (n, mask(" ".join(line.split(" ")[: min(depth, n // 2)])))
                lines.append((doc, no, line, m, leaf, m.split(" ")))
    reached = collections.defaultdict(set)
    for doc, *_, leaf, _t in lines:
        reached[leaf].add(doc)
    lines = [x for x in lines if len(reached[x[4]]) >= min_docs]
    support = collections.Counter((x[4], p, t) for x in lines if len(x[5]) >= min_tokens for p, t in enumerate(x[5]) if t != "<*>")
    by = collections.defaultdict(list)
    for doc, no, line, m, leaf, tokens in lines:
        by["w", m if re.search(r"[^\W\d_]", m) else line].append((doc, no))
        own = [(p, t) for p, t in enumerate(tokens) if t != "<*>"]
        least = max(1, math.ceil(constant * len(tokens)) - (len(tokens) - len(own)))
        if len(tokens) >= min_tokens and len(own) >= least:
            ranks = sorted((support[leaf, p, t] for p, t in own), reverse=True)
            fall = next((k for k in range(1, len(ranks)) if 2 * ranks[k] <= ranks[k - 1]), len(tokens))
            if fall + len(tokens) - len(own) >= max(math.ceil(loose * len(tokens)), min(depth, len(tokens) // 2) + 2):
                least = min(least, fall)
            s = ranks[least - 1]
            by[leaf, tuple((p, t) for p, t in own if support[leaf, p, t] >= s)].append((doc, no))
    gone = collections.defaultdict(set)
    for places in by.values():
        if len({d for d, _ in places}) >= min_docs:
            for doc, no in places[1:]:
                gone[doc].add(no)
    return gone


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = brute(rows, **options)
    want = collections.Counter((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t]), len(gone[i, t])) for i, t in rows)
    got = collections.Counter((r.doc_id, r.text, r.n_dropped) for r in line_dedup(df, **options).collect())
    assert got == want
    return gone


@pytest.mark.parametrize("n", [49, 64, 10_000])
def test_fields_are_fields_in_a_corpus_of_any_size(spark, n):
    rows = [(k, f"Written by our author {NAMES[k % 7]} for the town of {TOWNS[k // 7 % 8]} here") for k in range(n)]
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in out.where("n_dropped = 0").collect()} == {0} and out.count() == n


@pytest.mark.parametrize("n", [20, 200, 10_000])
def test_three_fields_in_eight_tokens(spark, n):
    rng = np.random.default_rng(n)
    line = lambda: f"Posted on site by {rng.choice(NAMES)} {rng.choice(TOWNS)} in {rng.choice(SITES)}"
    rows = [(k, line()) for k in range(n)]
    gone = check(spark, rows)
    assert {d for d, lost in gone.items() if lost} == set(rows[1:])


def test_lines_that_only_begin_alike_stay(spark):
    rng = np.random.default_rng(3)
    words = [a + b for a in "bcdfghklmnprst" for b in "aeiou"]
    rows = [(k, f"It was on a {' '.join(rng.choice(words, 3))}") for k in range(60)] + [(100 + k, f"Thank you for the {rng.choice(words)} {rng.choice(words)}") for k in range(60)]
    assert not any(check(spark, rows).values())


def test_brute_force(spark):
    rng = np.random.default_rng(11)
    words = [f"w{chr(97 + k)}" for k in range(26)]
    rows = []
    for k in range(120):
        own = [" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(3)]
        own += [f"Posted by our {rng.choice(NAMES)} in {rng.choice(TOWNS)} on day {rng.integers(40)} again"] * int(rng.integers(0, 3))
        own += [f"The {rng.choice(words)} house of {rng.choice(TOWNS)} has a garden", f"Page {k % 9} of {k}", "Les.", "", " \t", f"{k % 5} {k % 3} 7"]
        rows.append((k, "\n".join(rng.permutation(own))))
    rows += [(None, "Les.\nPage 1 of 2"), (None, None), (7, ""), rows[5], rows[5], (6, rows[5][1])]
    gone = check(spark, rows)
    assert sum(map(len, gone.values())) > 300
    check(spark, rows, min_docs=3, constant=0.5, depth=2)
    check(spark, rows, min_docs=3, constant=0.9, loose=0.5)


def test_ties_and_long_texts(spark):
    rows = [(k, "\n".join(["one two three four", "five six seven eight"] * 1500 + [f"own{chr(97 + k)} line here now"])) for k in range(8)]
    gone = check(spark, rows)
    assert len(gone[rows[0]]) == 2998 and len(gone[rows[1]]) == 3000
