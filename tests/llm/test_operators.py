import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from corvane.llm import fingerprints, html_extract, known, packing, shared, token_counts, warc, words  # noqa: E402
from corvane.llm.decontaminate import decontaminate, remove_hits  # noqa: E402
from corvane.llm.jaccard_join import jaccard_join  # noqa: E402
from corvane.llm.language_id import language_id, page_evidence  # noqa: E402
from corvane.llm.line_dedup import line_dedup  # noqa: E402
from corvane.llm.substring_dedup import substring_dedup  # noqa: E402

SPACE, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOREM = [f"w{(i * i * 7 + i) % 911}" for i in range(300)]


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def corpus():
    a, rng = " ".join(LOREM), np.random.default_rng(1)
    rows = [(1, a), (2, a), (3, " ".join(LOREM[:290] + ["x"] * 4)), (4, None), (5, ""), (6, "One  two\tthree"), (7, "one TWO three"), (8, "x " * 200), (9, " ".join(LOREM[100:140])), (None, "alone here with no id at all"), (10, a + "\n" + a), (10, a + "\n" + a), (11, "é" * 5000)]
    return rows + [(20 + k, " ".join(rng.choice(LOREM, 120))) for k in range(6)]


@pytest.fixture(scope="module")
def docs(spark):
    # names that the operators use themselves
    return spark.createDataFrame([(i, t, "q", 1) for i, t in corpus()], "doc_id long, text string, _text string, n long").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, _text string, n long")


def test_words_and_known():
    data = np.frombuffer(b"a,b c", np.uint8)
    w = words.Words(data, np.array([0, 4, 5]), words.SPACES, cut=True)
    assert [w.word(i) for i in range(4)] == [b"a", b",", b"b", b"c"] and w.n.tolist() == [3, 1]
    k = known.Known(lambda ws, _: [(len(x),) * 2 for x in ws], np.uint32, limit=1)
    for _ in range(2):
        at, size, flat = k.look(w.hashes(), w.word)
        assert known.gather(at, size, flat).tolist() == [1] * 8


def test_substring_dedup(docs, empty):
    rows = corpus()
    split = [re.findall(SPACE, t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    expected = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = {k for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        expected.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    key = lambda r: (str(r[0]), r[3])
    assert sorted(map(tuple, substring_dedup(docs).collect()), key=key) == sorted(expected, key=key)
    assert substring_dedup(empty).count() == 0


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard_join(docs, empty, n, percent):
    rows = corpus()
    sets = []
    for _, t in rows:
        w = re.findall(SPACE, lower(t))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    link = [[a is not b and bool(a) and 100 * len(a & b) >= percent * len(a | b) for b in sets] for a in sets]
    comp = list(range(len(rows)))
    for _ in rows:
        comp = [min([comp[i]] + [comp[j] for j in range(len(rows)) if link[i][j]]) for i in range(len(rows))]
    least = lambda i: min((rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None), default=None)
    expected = sorted((str(rows[i][0]), len(sets[i]), str(least(i)), sum(link[i])) for i in range(len(rows)))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in jaccard_join(docs, n, percent).collect())
    assert got == expected
    assert jaccard_join(empty).count() == 0


def test_decontaminate(spark, docs, empty):
    items = [(1, " ".join(LOREM[10:40])), (1, " ".join(LOREM[10:40])), (2, "TWO, three"), (3, None), (4, "!!"), (12, "two three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    grams = {}
    for i, t in items:
        w = re.findall(ALNUM, lower(t))
        for k in range(len(w) - min(13, len(w)) + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    expected = []
    for i, t in corpus():
        w = re.findall(ALNUM, lower(t))
        hit, found = set(), set()
        for g, owner in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= owner
        expected.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    for block in (32 << 20, 1):
        out = decontaminate(docs, bench, keep=("_text", "n"), block_bytes=block)
        got = [(str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()]
        assert sorted(got) == sorted(expected)
    assert remove_hits(out, "span").where("doc_id = 7").first().text == "one "
    assert decontaminate(empty, bench).count() == 0 and not decontaminate(docs, bench.where("false")).where("contaminated").count()


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    expected = []
    for i, x in corpus():
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        expected += [(str(i), k // 100, k, len(ids[k : k + 100]), zlib.crc32(ids[k : k + 100].tobytes())) for k in range(0, len(ids), 100)]
    got = packing.best_fit_packing(docs, path, 100).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 100
    assert packing.best_fit_packing(empty, path).count() == 0


def test_tokenizer_words_equal_whole_texts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["it's don't I'LL x's", "<|startoftext|>a<|ENDOFTEXT|> <|", "a1b2,c-d é, ΑΣ Σ", "„quote“ 3.14|x,'s", "a b c\x1cd", "ÉCOLE!!! #tag @x", "x́,y ,̈z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids_crc32 for r in packing.best_fit_packing(rows, path).collect()}
    assert got == {i: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, x in enumerate(texts)}


def test_plan_is_best_fit_decreasing():
    hist = {7: 3, 5: 4, 3: 5, 2: 1, 10: 1}
    bins = []
    for n in sorted((n for n, c in hist.items() for _ in range(c)), reverse=True):
        fit = [b for b in bins if 10 - sum(b) >= n]
        (min(fit, key=lambda b: 10 - sum(b)) if fit else bins.append([]) or bins[-1]).append(n)
    plan = packing.plan(hist, 10)
    assert {n: sum(p[2] - p[1] for p in plan if p[0] == n) for n in hist} == hist
    assert max(p[3] + (p[2] - p[1]) // p[4] for p in plan) == len(bins)


def test_token_counts(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = token_counts.piece_scores(path)

    def brute(token):
        best = [(0.0, 0)]
        for j in range(1, len(token) + 1):
            size = len(token[j - 1].encode())
            best.append(max([(best[j - 1][0] + token_counts.UNKNOWN_BYTE * size, best[j - 1][1] - size)] + [(best[i][0] + scores[token[i:j]], best[i][1] - 1) for i in range(j) if token[i:j] in scores]))
        return -best[-1][1]

    expected = []
    for i, t in corpus():
        n = total = 0
        if len(t or "") < 4000:
            for w in re.findall(SPACE, t or ""):
                for k, p in enumerate(re.split(r"(?<=[a-zA-Z0-9])(?=[!-/:-@\[-`{-~])(?!['|])|(?<=[!-&(-/:-@\[-`{}~])(?=[a-zA-Z0-9])", w)):
                    n, total = n + 1, total + brute(("" if k else token_counts.MARK) + p)
            expected.append((str(i), n, total))
    got = sorted((str(r.doc_id), r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(docs, path).where("doc_id is null or doc_id <> 11").collect())
    assert got == sorted(expected)
    assert token_counts.token_counts(empty, path).count() == 0


def test_warc(spark):
    rows = [(3, "http://a/\n", "<p>x</p>", 0), (5, None, "<p>x</p>", 0), (1, "u", None, 0), (2, "u", "", 0), (9, "u", "é" * 300_000, 0), (None, "u", "solo", 0), (4, "u", "y\r\n\r\nWARC/1.1", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n long")
    bundles = warc.write_archives(pages)
    got = {r.page_id: r for r in warc.read_archives(bundles).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {3: ("revisit", 5), 5: ("response", None), 1: ("revisit", 2), 2: ("response", None), 9: ("response", None), None: ("response", None), 4: ("response", None)}
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        assert got[i].payload_bytes == len(raw) and got[i].payload_digest == warc.digest(raw)
    assert {r.record_type for r in warc.read_archives(warc.write_archives(pages, 9)).collect()} == {"response"}
    data = {r.bundle_id: bytes(r.bundle) for r in bundles.collect()}
    for r in warc.index(bundles).collect():
        (head, _), = warc.parse(warc.read_at(data[r.bundle_id], r.frame, r.offset, r.length))
        assert head["warc-record-id"] == f"<{r.record_id}>"
    import io

    import zstandard

    one = next(iter(data.values()))
    assert list(warc.parse(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(one), read_across_frames=True).read()))
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0


def test_language_id(spark):
    say = {"en": "the house and the garden with the old tree was there", "de": "das haus und der garten mit dem alten baum war dort", "fr": "la maison et le jardin avec le vieil arbre était là"}
    rows = [(k, say[x], x, f"h{k % 4}") for k, x in enumerate(list(say) * 10)] + [(90, "le jardin et la maison", "en", "h9"), (91, None, "en", "h1"), (92, "123 ###", "en", "h1"), (93, "", None, None), (94, "the garden and the house", None, None), (95, "a", "fr", "h1"), (96, "der baum und das haus", "xx-YY", "h2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    got = {r.doc_id: r for r in language_id(df, declared=F.col("lang"), host=F.col("host")).collect()}
    assert all(got[k].language == x for k, x in enumerate(list(say) * 10)) and got[90].language == "fr" and got[94].language == "en"
    assert [got[k].rejected for k in (91, 92, 93, 95)] == [True, True, True, False]
    assert language_id(df.where("false"), declared=F.col("lang")).count() == 0
    assert all(r.rejected for r in language_id(df).collect())
    p = spark.createDataFrame([("https://u@www.x.de:80/fr/1?x", "<HTML class=a LANG='pt-BR'>"), ("http://x.com/a", "<p>")], "url string, html string")
    assert [tuple(r) for r in p.select(*page_evidence(F.col("url"), F.col("html")).values()).collect()] == [("pt", "fr", "www.x.de"), (None, "com", "x.com")]


PAGE = '<html><head><title>T</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="ad">Buy now</div><article><header><h1>Big&amp;  news</h1></header><p>First <b>bold</b>\n text.<br>Next<p>Second &eacute; one.<form>Sign up</form><div class="comments"><p>I disagree</p></div></article><footer>&copy; me</footer></body></html>'


def test_html_extract(spark):
    other = PAGE.replace("<article>", '<div id="content">').replace("</article>", "</div>")
    rows = [(1, "u", PAGE, 0), (2, "u", other, 0), (3, None, None, 0), (4, "u", "", 0), (5, "u", "<p>a < b <", 0), (6, "u", "<script>x" * 50, 0), (None, "u", "<article><p>" + "word " * 50_000, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    got = {r.page_id: r.text for r in html_extract.html_extract(df).collect()}
    good = "Big& news\nFirst bold text. Next\nSecond é one."
    assert got[1] == good and got[2] == good and got[3] == "" and got[4] == "" and got[6] == "" and got[None] == " ".join(["word"] * 50_000)
    assert html_extract.html_extract(df.where("false")).count() == 0
    assert html_extract.best_run([-1, 2, -1, 3, -9, 1]) == (1, 4) and html_extract.best_run([-1]) == (0, 0)


def test_line_dedup(spark):
    own = lambda k: " ".join(["own", *(chr(97 + k) * n for n in range(3, 9)), "text"])
    rows = [(k, f"{own(k)}\nPosted by {name} on day {k}\nAll rights reserved now") for k, name in enumerate(["Ann"] * 12)]
    rows += [(50, None), (51, ""), (52, "x\n\nx"), (None, "All rights reserved now"), (0, rows[0][1])]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, n_lines string")
    out = line_dedup(df)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert got[None].text == "All rights reserved now" and got[0].text == rows[0][1].rsplit("\n", 1)[0]
    for k in range(1, 12):
        assert got[k].text == rows[k][1].split("\n")[0] and got[k].n_dropped == 2
    assert got[50].text is None and got[50].n_lines == 0 and got[51].text == "" and got[52].text == "x\n\nx"
    assert line_dedup(df.where("false")).count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_line_dedup_short_masked_and_fields(spark):
    months = ["March", "April", "May"]
    rows = []
    for k in range(144):
        own = " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}" for j in range(5))
        name, town = f"N{'abcdefghijkl'[k % 12]}", f"T{'abcdef'[k // 12 % 6]}"  # each in many lines, each pair in two
        rows.append([own, "Les.", "版权所有。保留一切权利。", f"第{k}页", f"Page {k} of {k + 3}", "Tel: 030 1234 5678", f"a\tb\t{k}", f"Posted on {k} {months[k % 3]} {1980 + k} at 10:32 by admin", f"Written by our author {name} for the town of {town} here"])
        rows[-1] += ["", f"{k} {k + 1} {k + 2}", f"章{chr(0x4E00 + k)}{k}文 {k} {k}"]  # blank, numbers and texts of their own
    rows.append(["own words of one more"] + ["Once."] * 9)  # in one document only
    df = spark.createDataFrame([(k, "\n".join(r)) for k, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup(df).collect()}
    assert got[144].n_dropped == 0 and got[0].text == "\n".join(rows[0])
    for k in range(3, 144):
        assert got[k].text == "\n".join(rows[k][:1] + rows[k][9:]), k


def test_fingerprints(spark, docs, empty):
    cuts = (None, r"\s+", r"[.!?|\n\u3002\uFF01\uFF1F\uFF0E\u0964\u0965\u061F\u06D4\u1362\u104A\u104B]+\s*")

    def level(t):  # the longest paragraphs that are not too few
        for lvl, least, longest in ((2, fingerprints.WORDS, fingerprints.SENTENCE), (1, fingerprints.LETTERS, fingerprints.WORD)):
            k = len(re.split(cuts[lvl], t))
            if len(t) >= least and k >= fingerprints.LEAST and k * longest >= len(t):
                return lvl
        return 0

    def units(t, lvl):
        parts = re.split(cuts[lvl], t) if lvl else [t[i : i + 2] for i in range(max(len(t) - 1, 1))]
        return {p for p in parts if p}

    def near(a, b):
        lvl = max(level(a), level(b))
        x, y = units(a, lvl), units(b, lvl)
        return round(len(x & y) / len(x | y), 9) if x | y else 1.0

    rows = sorted(((i, t or "") for i, t in corpus()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = []
    for k, (i, t) in enumerate(rows):
        after, q = rows[(k + 1) % len(rows)][1], len(t) // 4
        e = t[: len(t) - q] + after[:q]
        expected.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), near(t, e), near(t, after)))
    got = fingerprints.fingerprints(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(expected)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint != by[3].fingerprint
    assert max(r.next_cells for r in got) > 10 * fingerprints.CELLS
    assert fingerprints.fingerprints(empty).count() == 0
    assert "Python" not in fingerprints.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("depth", [24, 2])
def test_sketches_find_every_difference(spark, monkeypatch, depth):
    monkeypatch.setattr(fingerprints, "DEPTH", depth)
    monkeypatch.setattr(fingerprints, "FIRST", min(depth, 16))
    rng = np.random.default_rng(8)
    rows = []
    for n, m, c in [(0, 0, 0), (0, 1, 0), (1, 0, 3), (5, 5, 200), (9, 30, 0), (60, 60, 500), (0, 400, 10), (300, 300, 0), (700, 1, 300)]:
        x = [f"p{v}" for v in rng.choice(10**6, n + m + c, replace=False)]
        rows.append((x[: n + c], x[n:], n + m))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, d int").select("d", *[F.transform(k, lambda p: fingerprints._key(F.xxhash64(p))).alias(k) for k in "ab"])
    for a, b in ("ab", "ba"):
        cells = fingerprints.subtract(*[fingerprints.sketch(fingerprints._signed(F.col(k), 1)) for k in (a, b)])
        assert all(r.d == r.got for r in df.select("d", fingerprints.differing(F.col(a), F.col(b), cells)["d"].alias("got")).collect())


def test_shared_tables(spark):
    t = shared.written(spark.range(3), "t")
    assert t.count() == 3
    shared.clear(spark)
    with pytest.raises(Exception):
        spark.read.parquet(t.inputFiles()[0]).count()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    a = " ".join(LOREM)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in [(1, a), (2, a), (3, " ".join(LOREM[:295])), (4, None), (5, "12 34"), (6, " ".join(LOREM[::-1])), (7, " ".join(LOREM[200:230]))]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(LOREM[200:230]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {6}  # 1 holds the passage as a tenth of itself; 2 and 3 are its copies
    assert len(corpus_pipeline.STAGES) == 5


def test_roots_of_a_block():
    from corvane.llm.jaccard_join import _roots

    assert _roots(4, np.array([1, 2, 0]), np.array([2, 3, 3])).tolist() == [0, 0, 0, 0]
    rng = np.random.default_rng(3)
    for size in (1, 2, 9, 60):
        for _ in range(200):
            i, j = rng.integers(0, size, (2, rng.integers(0, size + 1)))
            expected = list(range(size))
            for _ in range(size):
                for a, b in zip(i, j, strict=True):
                    expected[a] = expected[b] = min(expected[a], expected[b])
            assert _roots(size, i, j).tolist() == expected
