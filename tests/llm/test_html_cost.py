import itertools
import time

import numpy as np

from corvane.llm.html_extract import Page, best_run, extract, html_extract

LONG = " ".join(f"a{k}" for k in range(60))


def test_best_run_by_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(300):
        scores = rng.integers(-4, 4, rng.integers(0, 12)).tolist()
        sums = {(a, b): sum(scores[a:b]) for a, b in itertools.combinations(range(len(scores) + 1), 2)}
        top = max([0, *sums.values()])
        a, b = best_run(scores)
        assert sum(scores[a:b]) == top and (top or (a, b) == (0, 0))


def test_depth_takes_linear_time():
    n = 100_000
    pages = {
        "div": "<div>" * n + LONG,
        "spans and stray ends": "<section>" + "<span>x" * n + "</p></i></b>" * n,
        "items": "<ul>" + "<li><span><i>x" * n,
        "ends that close nothing": "<p>" + "<section>" + "</p>" * n + LONG,
        "articles": "<article><p>x" * 20_000,
        "scripts": "<script>x</SCRIPT >y" * n,
        "names": "<div class='sidebar'>x" * 20_000,
    }
    for name, page in pages.items():
        start = time.process_time()
        extract(f"<body>{page}</body>", {})
        assert time.process_time() - start < 20, name


def test_drawings_and_formulas():
    assert extract("<article><p>One</p><svg/><p>Two</p><svg><title>x</title><g>drawn</g></svg><p>three <math><mi>x</mi>=1</math></p></article>", {}) == "One\nTwo\nthree x=1"
    assert extract(f"<article><p>İ{LONG}</p><SCRIPT>no</SCRIPT><p>rest</p></article>", {}) == f"İ{LONG}\nrest"


def test_no_name_empties_a_page():
    for name in ("has-sidebar", "no-comments", "with-ads", "page-with-sidebar", "nav-fixed", "sidebar", "comments widget", "ad"):
        for inner in ("<p>{}</p>", "<article><p>{}</p></article>", "<h1>Head</h1><p>{}</p>", "<div class='sidebar'><p>{}</p></div>"):
            got = extract(f"<body><div class='{name}'>{inner.format(LONG)}</div></body>", {})
            assert got.endswith(LONG), (name, inner)
    page = f"<body><div class='sidebar'><div class='menu'>Home</div><p>{LONG}</p></div></body>"
    assert extract(page, {}) == LONG
    page = f"<body><div class='post-with-comments'><h1>Head</h1><p>{LONG}</p><div class='comments'><p>I disagree</p></div></div><div class='sidebar'>More</div></body>"
    assert extract(page, {}) == f"Head\n{LONG}"


def test_same_pages_in_any_order(spark):
    html = [f"<body><nav>Home {k}</nav><article><p>{LONG} {k}</p></article></body>" for k in range(40)] + [f"<div>{LONG}</div>"]
    rows = [(k, "u", h, "kept", "old") for k, h in enumerate(html * 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, extra string, text string")
    a, b = (sorted(map(tuple, html_extract(x, sample_pages=5, keep=("extra", "text")).collect())) for x in (df.repartition(3), df.orderBy("html")))
    assert a == b and {r[:1] + r[2:4] for r in a} == {(k, "kept", f"{LONG} {k % 41}" if k % 41 < 40 else LONG) for k in range(123)}


def test_unclosed_and_entities():
    assert [x[2] for x in Page("<p>a &lt; b<p>c<li>d<li>e <!-- f").items if x[0] == "b"] == [["a", "<", "b"], ["c"], ["d"], ["e"]]
