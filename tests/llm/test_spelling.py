import collections
import random
import re
import zlib

import pytest

from corvane.llm.acyclic import Automaton
from corvane.llm.spelling import near_words, roots, spelling_variants


def edits(word, letters):
    """All that one insertion, deletion or replacement makes of a word."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return ({a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}) - {word}


def brute(docs, size=5, least=3):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= size and c >= least}
    near = {w: sorted(edits(w, set("".join(n))) & n.keys(), key=lambda v: (-n[v], v)) for w in n}
    form = {w: v[0] if v and n[v[0]] >= 2 * n[w] else None for w, v in near.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, n[w], len(near[w]), form[w] or "", n.get(form[w], 0), root(w)) for w in n)


def rows(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in df.collect())


def corpus(seed, letters, size):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(*size))) for _ in range(120)]
    return [(k if k % 7 else None, " ".join(w if rng.random() < 0.6 else rng.choice(sorted(edits(w, letters))) for w in rng.choices(words, range(120, 0, -1), k=300))) for k in range(40)]


@pytest.mark.parametrize("letters,size,most", [("abéÀ", (4, 9), 10**6), ("abéÀ", (4, 9), 3), ("ab", (5, 8), 1)])
def test_equals_brute_force(spark, letters, size, most):
    docs = [*corpus(1, letters, size), (1, None), (2, ""), (3, "1 2, ; Œœ"), (5, "Long" + "x" * 5000), (6, "longxx" + "x" * 4998), (6, "longxx" + "x" * 4998), (7, "LONG" + "x" * 5000 + " long" + "x" * 5000)]
    docs += [(9, "repeated rows here"), (9, "repeated rows here"), (9, "repeated rows here")]
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n long").repartition(3)
    assert rows(spelling_variants(df, most=most)) == brute(docs)


def test_nothing(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (2, "two words")], "doc_id long, text string")
    assert spelling_variants(df).count() == 0 and spelling_variants(df.where("false")).count() == 0


def test_automaton_numbers_words_and_is_minimal():
    words = sorted({"".join(random.Random(k).choices("abc", k=1 + k % 6)) for k in range(300)})
    a = Automaton(words)
    assert [a.number(w) for w in words] == list(range(len(words))) and a.number("abcabcabc") == -1 and a.number("") == -1
    assert Automaton(["ab", "cb", "db"]).arcs.__len__() == 3 and Automaton([]).number("x") == -1
    # of all words of one length, a state a letter
    assert len(Automaton(sorted(x + y + z for x in "abcd" for y in "abcd" for z in "abcd")).arcs) == 4
    for w in [*words[::7], "abcabc", "zzz", "aaa"]:
        for exact in range(len(w) + 1):
            found = [words[k] for k in a.near(w, exact)]
            assert len(found) == len(set(found))
            assert set(found) == {v for v in words if v[:exact] == w[:exact] and v[exact:] in edits(w[exact:], "abcz")}


def test_near_words_share_a_hot_half(spark):
    """Thousands of words with one first half, dealt by three quarters."""
    words = sorted({f"aaaaa{''.join(random.Random(k).choices('bcdefgh', k=5))}" for k in range(3000)})
    df = spark.createDataFrame([(w, 3 + k % 5) for k, w in enumerate(words)], "word string, n long")
    got = {r.word: r.n_near for r in near_words(df, most=500).collect()}
    known = set(words)
    assert got == {w: len(e) for w in words if (e := edits(w, "abcdefgh") & known)}


def test_roots_of_long_chains(spark):
    chain = [(f"w{k:02}", f"w{k + 1:02}") for k in range(21)] + [(f"x{k}", "w05") for k in range(50)]
    got = {r.word: r.root for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert len(got) == 71 and set(got.values()) == {"w21"}
