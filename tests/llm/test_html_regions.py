from corvane.llm.html_extract import extract

LONG, SHORT = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 60), ("b", 40)))


def test_a_run_is_never_narrowed():
    both = f"{LONG}\n{SHORT}"
    for page in ("<div class='text'>{}</div><div class='text'>{}</div>", "<p class='body'>{}</p><p class='body'>{}</p>", "<article><p>{}</p></article><article><p>{}</p></article>"):
        assert extract(f"<html><body>{page.format(LONG, SHORT)}</body></html>", {}) == both, page


def test_modifiers_and_wrappers_are_no_boilerplate():
    for name in ("has-sidebar", "content with-sidebar", "no-comments", "comments-enabled", "page sidebar-wrapper"):
        assert extract(f"<body><div class='{name}'><article><p>{LONG}</p></article></div></body>", {}) == LONG, name
    for name in ("sidebar", "comments-list", "nav"):
        page = f"<body><article><p>{LONG}</p></article><div class='{name}'><article class='comment'><p>{SHORT}</p></article></div></body>"
        assert extract(page, {}) == LONG, name
