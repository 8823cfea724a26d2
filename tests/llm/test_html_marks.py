"""Marks of every kind are evidence: none empties a page, and none cuts an article whose text they name."""

import pytest

from corvane.llm.html_extract import extract

LONG, MORE = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 60), ("b", 70)))

WRAPPERS = [
    "<form id='aspnetForm' action='/x'><div>{}</div></form>",
    "<form>{}",
    "<div><form class='search'><div>{}</div></div>",
    "<div role='dialog'>{}</div>",
    "<div role='main'><div role='form'>{}</div></div>",
    "<div style='display: none'>{}</div>",
    "<div hidden>{}</div>",
    "<div aria-hidden='true'>{}</div>",
    "<aside>{}</aside>",
    "<footer><nav>{}</nav></footer>",
    "<dialog open>{}</dialog>",
    "<div class='sidebar'>{}</div>",
    "<div id='comments'>{}</div>",
    "<div role='navigation'><div class='ad'>{}</div></div>",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_a_wrapper_keeps_the_article(wrapper):
    page = f"<body><nav>Home News</nav>{wrapper.format(f'<article><h1>Head</h1><p>{LONG}</p></article>')}<footer>Imprint</footer></body>"
    assert extract(page, {}) == f"Head\n{LONG}"
    alone = f"<body>{wrapper.format(f'<p>{LONG}</p><p>{MORE}</p>')}</body>"
    assert extract(alone, {}) == f"{LONG}\n{MORE}"


@pytest.mark.parametrize("wrapper", [w for w in WRAPPERS if not any(x in w for x in ("nav", "aside"))])
def test_a_wrapper_without_an_article_keeps_its_text(wrapper):
    head = f"<body><nav>Home News</nav>{wrapper.format(f'<h1>Head</h1><p>{LONG}</p><p>{MORE}</p>')}</body>"
    assert extract(head, {}).endswith(f"{LONG}\n{MORE}")  # without weights a short heading is not worth its tags
    # a line beside it is no reason to lose it
    beside = f"<body>{wrapper.format(f'<p>{LONG}</p><p>{MORE}</p>')}<div>Imprint</div></body>"
    assert f"{LONG}\n{MORE}" in extract(beside, {})


@pytest.mark.parametrize(
    "inner",
    [
        "<h2 id='related-work'>{}</h2>",
        "<h2 id='social-impact'>{}</h2>",
        "<h3 id='comments'>{}</h3>",
        "<section id='navigation-methods'><p>{}</p></section>",
        "<div class='recipe-cookies'><p>{}</p></div>",
        "<p class='share-price'>{}</p>",
        "<blockquote class='reply'>{}</blockquote>",
        "<div class='sponsor-history'>{}</div>",
        "<p class='dinner-menu'>{}</p>",
        "<td class='popup-books-of-the-year'>{}</td>",
        "<div class='has-related'>{}</div>",
        "<form><p>{}</p><p>{}</p><p>{}</p></form>",
    ],
)
def test_an_article_keeps_what_its_names_are_about(inner):
    text = inner.replace("{}", MORE)
    page = f"<body><nav>Home</nav><article><p>{LONG}</p>{text}<p>{LONG}</p></article></body>"
    assert extract(page, {}) == "\n".join([LONG, *[MORE] * inner.count("{}"), LONG])


def test_an_id_made_of_a_heading_marks_nothing():
    page = f"<article><p>{LONG}</p><section id='navigation'><h2>Navigation</h2><p>{MORE}</p></section></article>"
    assert extract(page, {}) == f"{LONG}\nNavigation\n{MORE}"
    assert extract(page.replace("<h2>Navigation", "<h2>Elsewhere"), {}) == LONG


@pytest.mark.parametrize(
    "inner",
    [
        "<div class='ad'>Buy</div>",
        "<div class='share-buttons'>Post it</div>",
        "<ul class='social-links'><li>Friend us</li></ul>",
        "<div class='related-posts'><p>Others</p></div>",
        "<div class='herald-newsletter'>Mail</div>",
        "<section id='comments'><h2>Comments</h2><p>I disagree</p></section>",
        "<p class='advertisement'>Buy</p>",
        "<div class='cookie-notice'>We use them</div>",
        "<aside>See also</aside>",
        "<nav>1 2 3</nav>",
        "<div role='complementary'>Others</div>",
        "<div hidden>Later</div>",
        "<form><label>Mail</label><input><button>Go</button> Sign up</form>",
        "<div class='td-sidebar'>Others</div>",
    ],
)
def test_an_article_loses_its_boilerplate(inner):
    page = f"<body><div class='menu'>Home</div><article><p>{LONG}</p>{inner}<p>{MORE}</p></article><div class='page-footer'>Imprint</div></body>"
    assert extract(page, {}) == f"{LONG}\n{MORE}"


def test_a_form_around_an_article_loses_its_controls():
    page = f"<form><input value=x><label>Search</label><button>Go</button><select><option>One</select><article><p>{LONG}</p></article></form>"
    assert extract(page, {}) == LONG
