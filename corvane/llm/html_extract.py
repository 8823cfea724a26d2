"""Main text of HTML pages by a maximum-scoring contiguous region.

A page is a sequence of tags and blocks of text. Words and tags have weights by where they
stand, log-odds fitted on labelled pages (those with exactly one article or main element,
whose inside is the label); without them, words count up and tags down. A linear scan finds the
run of the sequence with the largest sum. Scripts, styles, controls and what else is no text are never part of it.
Elements that their tag, role, hiding, class or id marks as boilerplate are left out, too, but all these marks are
evidence only: a marked element is a wrapper, and stays, if it holds all article and main elements of the page,
or if nothing would be left of the page without it; one that is not for navigation by its tag or role also if it holds
all h1 headings of a page without articles, or nearly all of a page without either; and a form if it holds more
text than forms have. A class or id marks only if all its words are those of boilerplate, or its last is one that
names nothing else; it marks no quotation; an id that is made of the words of the element's heading, and
any id of a heading, says what the text is about. Parts of a class name after a modifier
(``has-sidebar``) or with one at the end (``comments-enabled``) mark nothing. The run is widened to the
content element that holds all that is kept of it, if there is one, else by those that hold over half
of it; it is never narrowed.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches

# Element names of the HTML standard by use, and usual class names.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
LEFT_OUT = frozenset("script style noscript template iframe svg button select textarea head title object canvas".split())
#: Marked by their tag: for navigation, and others.
NAVIGATION, ASIDE = frozenset("nav aside footer menu".split()), frozenset("form dialog".split())
CONTENT = frozenset(("article", "main"))
#: An end tag of another element does not close one that holds any of these.
HOLDS = ("article", "main", "body", "table", "section")
#: Elements that end one of their own kind, and what bounds the search for it.
ITEMS, LISTS = frozenset("li dd dt tr td th option".split()), ("ul", "ol", "dl", "table", "menu")
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommended related reply replies respond share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Boilerplate unless the element also names content.
WEAK = frozenset("header footer masthead meta tags tools".split())
NAMES_CONTENT = frozenset("article post entry content story main body text".split())
#: Of a name that holds a word of BOILERPLATE, the other words that leave it one.
NEUTRAL = frozenset(
    "area article articles bar block blog body bottom box btn button buttons col column container content count desktop email entry field fixed foot footer form global grid group head header heading holder icon icons info inner input item items left link links list main media mobile module more outer page panel post posts primary right row section secondary sign signup site slot sticky text thread title top unit up user view wrap wrapper".split()
)
#: Words that, as a name's last, name nothing but boilerplate.
STRUCTURE = frozenset("advert advertisement breadcrumb breadcrumbs commentlist comments disqus modal navbar newsletter pager pagination popup sidebar sponsored toolbar widget".split())
#: Elements of running text, which names of one kind of word alone mark; headings, of which no id does.
RUNNING, HEADINGS = frozenset("p pre dd dt figcaption td h1 h2 h3 h4 h5 h6".split()), frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("dialog alert form".split())
NAVIGATION_ROLES = frozenset("navigation banner contentinfo complementary search menu toolbar".split())
#: Words in a form from which on it is a wrapper.
FORM_WORDS = 100

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^<>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
_NAME = re.compile(r"[a-z]+|[0-9]+")
#: A class or id that says what the element has or lacks, not what it is.
_MODIFIER = re.compile(r"(?:.*[-_])?(?:has|have|with|without|no|not|is|hide|show)[-_].*|.*[-_](?:enabled|disabled|open|closed|on|off|active|visible|hidden)")
_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
#: A number to add to counts of the labelled pages, and the weights where there are none.
SMOOTH, WORD, TAG = 1.0, 0.2, -1.0


def _marks(tag: str, part: str) -> bool:
    """Whether a class or id, as one name, is one of boilerplate."""
    words = _NAME.findall(part)
    named = [w for w in words if w in BOILERPLATE or w in WEAK]
    if not named or tag == "blockquote" or _MODIFIER.fullmatch(part):
        return False
    if not any(w in BOILERPLATE for w in named) and any(w in NAMES_CONTENT for w in words):
        return False
    if all(w in BOILERPLATE or w in WEAK or w in NEUTRAL or len(w) < 3 or w.isdigit() for w in words):
        return True
    return words[-1] in STRUCTURE and tag not in RUNNING


def _kind(tag: str, attributes: str) -> tuple[str, bool, str, str, bool]:
    """A tag's feature, whether it is never text, its mark (navigation, other, or none), the id that alone marks it, and whether it is or names content."""
    mark = "navigation" if tag in NAVIGATION else "other" if tag in ASIDE else ""
    names: set[str] = set()
    by_class, by_id, own = False, "", set()
    content = tag in CONTENT
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                names.update(_NAME.findall(value))
                own.update(w for part in value.split() if not _MODIFIER.fullmatch(part) for w in _NAME.findall(part))
                if key == "class":
                    by_class |= any(_marks(tag, part) for part in value.split())
                elif tag not in HEADINGS and _marks(tag, value):
                    by_id = value
            elif key == "role" and value in NAVIGATION_ROLES:
                mark = "navigation"
            elif (key == "role" and value in ROLES) or key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                mark = mark or "other"
        if names:
            content |= bool(names & NAMES_CONTENT)
            if content and not own & BOILERPLATE:  # such as entry-header
                by_class, by_id = False, ""
    marked = mark or ("other" if by_class or by_id else "")
    alone = by_id if not mark and not by_class else ""
    return ".".join([tag, *sorted(names & (BOILERPLATE | WEAK | NAMES_CONTENT))]), tag in LEFT_OUT, marked, alone, content and not marked and tag in BLOCKS


class Page:
    """Items in page order: ('t', feature, depth of content) for tags, ('b', feature, text, left out) for blocks."""

    def __init__(self, source: str):
        self.items: list[tuple] = []
        self.regions: list[tuple[int, int, bool]] = []  # first and last item of content elements; whether by tag
        stack: list[tuple[str, str, bool, int, bool, str, str]] = []  # tag, feature, never text, its item, content, mark, marking id
        open_at: dict[str, list[int]] = {}  # places in the stack of each tag that is open
        blocks: list[str] = []  # features of the blocks that are open
        contents = 0  # content elements that are open
        marked: list[tuple[int, int, str, str]] = []  # first and last item of what is marked, how, and by which id alone
        unlike: set[int] = set()  # items of content elements that a name marks, such as a comment's
        text: list[str] = []
        out = 0  # boilerplate elements that are open
        at, size = 0, len(source)

        def last(*tags: str) -> int:
            """The topmost place in the stack of one of the tags, or -1."""
            return max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)

        def close_block() -> None:
            if text:
                words = _html.unescape("".join(text)).split()
                text.clear()
                if words:
                    self.items.append(("b", blocks[-1] if blocks else "", words, out > 0))

        def pop(to: int) -> None:
            nonlocal out, contents
            while len(stack) > to:
                tag, _, bad, item, content, mark, alone = stack.pop()
                open_at[tag].pop()
                if tag in BLOCKS:
                    blocks.pop()
                out -= bad
                contents -= content
                if mark:
                    marked.append((item, len(self.items), "form" if tag == "form" and mark == "other" else mark, alone))
                if content:
                    self.regions.append((item, len(self.items), tag in CONTENT))

        while at < size:
            k = source.find("<", at)
            if k < 0:
                text.append(source[at:])
                break
            if k > at:
                text.append(source[at:k])
            m = _TAG.match(source, k)
            if not m:
                text.append("<")
                at = k + 1
                continue
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                if m[0].startswith("<![CDATA["):
                    text.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
                continue
            tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
            block = tag in BLOCKS or tag in LEFT_OUT or (tag == "label" and bool(open_at.get("form")))
            if block:
                close_block()
            elif tag == "br":
                text.append(" ")
            if closing:
                depth = last(tag)
                if depth >= 0:
                    if tag not in ("body", "html", "article", "main", "section") and last(*HOLDS) > depth:
                        continue  # a stray end tag does not close what holds it
                    self.items.append(("t", "/" + stack[depth][1]))
                    pop(depth)
                continue
            feature, bad, mark, alone, content = _kind(tag, attributes)
            if tag == "label":
                bad = block
            if tag == "header":  # that of the content has its title
                mark, alone = "" if contents else "navigation", ""
            if tag in CONTENT or tag in ("body", "html"):
                if mark:
                    unlike.add(len(self.items))
                mark, alone, content = "", "", tag in CONTENT
            if block:
                if tag in ITEMS:
                    keep = last(*(("dd", "dt") if tag in ("dd", "dt") else (tag,)))
                    keep = keep if keep > last(*LISTS) else -1
                else:
                    keep = last("p")
                if keep >= 0:
                    pop(keep)
            self.items.append(("t", feature))
            empty = attributes.endswith("/")
            if tag in RAW and not (empty and tag in ("template", "iframe")):
                end = _END[tag].search(source, at)
                at = (source.find(">", end.start()) + 1 or size) if end else size
                self.items.append(("t", "/" + feature))
                continue
            if tag not in VOID and not empty:
                open_at.setdefault(tag, []).append(len(stack))
                stack.append((tag, feature, bad, len(self.items) - 1, content, mark, alone))
                if tag in BLOCKS:
                    blocks.append(feature)
                out += bad
                contents += content
        close_block()
        pop(0)
        self._leave_out(marked, [(p, q) for p, q, by_tag in self.regions if by_tag and p not in unlike])

    def _leave_out(self, marked: list[tuple[int, int, str, str]], tagged: list[tuple[int, int]]) -> None:
        """Leaves out what is marked, but for wrappers and for ids that are made of headings."""
        words = [0, *accumulate(len(x[2]) if x[0] == "b" and not x[3] else 0 for x in self.items)]
        heads = [i for i, x in enumerate(self.items) if x[0] == "t" and x[1].partition(".")[0] == "h1"]
        least, most = min((p for p, _ in tagged), default=0), max((q for _, q in tagged), default=0)
        spans = []
        for p, q, how, alone in marked:
            if tagged and p <= least and most <= q:
                continue
            if how != "navigation" and not tagged and heads and p <= heads[0] and heads[-1] < q:
                continue
            if how == "form" and words[q] - words[p] > FORM_WORDS:
                continue
            if alone and alone not in ("comments", "respond", "disqus") and self._slug(p, q) == _NAME.findall(alone):
                continue
            spans.append((p, q, how))
        # how many marked elements, other and for navigation, each block lies in
        change, depths = {False: Counter(), True: Counter()}, []
        for p, q, how in spans:
            change[how == "navigation"][p] += 1
            change[how == "navigation"][q] -= 1
        others = navigation = 0
        for i, x in enumerate(self.items):
            others += change[False][i]
            navigation += change[True][i]
            if x[0] == "b" and not x[3]:
                depths.append((i, others, navigation, len(x[2])))
        free = Counter()
        for _, o, n, size in depths:
            if not n:
                free[o] += size
        if free:
            # the outermost others are wrappers while nothing is left, or next to nothing of a page without a sign of where its text is
            left, hidden = 0, sum(size for _, o, _, size in depths if o)
            by = Counter()
            for _, o, _, size in depths:
                by[o] += size
            wrappers = 0
            for wrappers in range(max(by) + 1):
                left += free[wrappers]
                hidden -= by[wrappers] if wrappers else 0
                if left and (tagged or heads or hidden < 10 * left):
                    break
            gone = [i for i, o, n, _ in depths if n or o > wrappers]
        else:  # all of the page is in elements for navigation
            least = min((o + n for _, o, n, _ in depths), default=0)
            gone = [i for i, o, n, _ in depths if o + n > least]
        for i in gone:
            self.items[i] = (*self.items[i][:3], True)

    def _slug(self, p: int, q: int) -> list[str]:
        """The words of the first heading between two items."""
        for i in range(p, min(q, len(self.items) - 1)):
            if self.items[i][0] == "t" and self.items[i][1].partition(".")[0] in HEADINGS:
                return _NAME.findall(" ".join(self.items[i + 1][2]).lower()) if self.items[i + 1][0] == "b" else []
        return []


def labelled(page: Page) -> list[tuple[str, int, bool]]:
    """Features with their counts and whether they lie in the page's one content element; empty without one."""
    regions = [x for x in page.regions if x[2]]
    if len(regions) != 1:
        return []
    a, b, _ = regions[0]
    return [(("w " + x[1]) if x[0] == "b" else x[1], len(x[2]) if x[0] == "b" else 1, a <= i <= b and not (x[0] == "b" and x[3])) for i, x in enumerate(page.items)]


def fit(pages: list[str]) -> dict[str, float]:
    """Weights of features: log-odds of lying in the content; of a word at most 1 and of a tag at most 3 either way."""
    inside, outside = Counter(), Counter()
    for source in pages:
        for feature, n, good in labelled(Page(source)):
            (inside if good else outside)[feature] += n
    out = {}
    for f in inside.keys() | outside.keys():
        most = 1.0 if f.startswith("w ") else 3.0
        out[f] = max(-most, min(most, math.log((inside[f] + SMOOTH) / (outside[f] + SMOOTH))))
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the run with the largest sum, the first of equals; (0, 0) if no sum is above 0."""
    best, begin, end, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, begin, end = total, start, i + 1
    return begin, end


def extract(source: str | None, weights: dict[str, float]) -> str:
    page = Page(source or "")
    scores = []
    for x in page.items:
        if x[0] == "t":
            scores.append(weights.get(x[1], TAG))
        else:
            w = weights.get("w " + x[1], WORD)
            scores.append(len(x[2]) * (-abs(w) if x[3] else w))
    a, b = best_run(scores)
    if a < b:
        total = [0, *accumulate(len(x[2]) if x[0] == "b" and not x[3] else 0 for x in page.items)]

        def words(p: int, q: int) -> int:
            return total[max(p, q)] - total[p]

        most = words(a, b)
        around = [(tagged, words(max(a, p), min(b, q + 1, len(page.items))), -k, p, q) for k, (p, q, tagged) in enumerate(page.regions)]
        around = [x for x in around if x[1] * 2 > most]
        holds = [x for x in around if x[1] == most]
        for *_, p, q in [max(holds)] if holds else around:
            a, b = min(a, p), max(b, q + 1)
    return "\n".join(" ".join(x[2]) for x in page.items[a:b] if x[0] == "b" and not x[3])


def _run(weights: dict[str, float]):
    def run(batches):
        for batch in batches:
            texts = [extract(x.as_py(), weights) for x in batch["_html"]]
            own = {f: batch[f] for f in batch.schema.names if f != "_html"}
            yield pa.RecordBatch.from_pydict(own | {"text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    return run


def _labelled_pages(rows: DataFrame, most: int) -> list[str]:
    """The ``most`` distinct pages with a content element that have the least hashes: the same in any order of rows."""
    some = rows.where(F.col("_html").rlike("(?i)<(?:article|main)\\b")).select("_html", F.shiftrightunsigned(F.xxhash64("_html"), 2).alias("_h"))
    total = some.agg(F.approx_count_distinct("_h")).first()[0]
    cut = int(min(1.0, 1.5 * most / max(total, 1)) * (1 << 62))  # half as many again as needed: the count is an estimate
    found = some.where(F.col("_h") <= cut).distinct().orderBy("_h", "_html").limit(most)
    return [r[0] for r in found.collect()]


def html_extract(pages: DataFrame, sample_pages: int = 300, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Returns per row the id, url, columns in ``keep``, text (blocks joined by a newline; empty if there is none) and n_chars.

    Weights are fitted on at most ``sample_pages`` distinct pages that hold a content element,
    chosen by hash. Null and empty html have no text; markup that never closes ends with the page;
    any depth of elements takes linear time; pages of equal html have equal texts, repeated rows
    give repeated results; of runs with equal sums the first counts; other columns are ignored,
    kept ones named text or n_chars are replaced; an empty table gives an empty one.
    """
    bounded_batches(pages.sparkSession)
    names = [c for c in dict.fromkeys((id_col, url_col, *keep)) if c not in ("text", "n_chars")]
    rows = pages.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)], F.col(html_col).alias("_html"))
    weights = fit(_labelled_pages(rows, sample_pages))
    schema = ", ".join(f"_c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    out = rows.mapInArrow(_run(weights), f"{schema}, text string, n_chars bigint")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], "text", "n_chars")
