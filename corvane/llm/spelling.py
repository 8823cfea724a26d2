"""Spelling variants: each word's near words, the form it is a variant of, and the root of its chain of forms.

Words at an edit distance of one share all that lies before or all that lies behind the error. So a word
that is cut in halves finds each near word by one half: either its first half is a prefix of the near
word, which a forward automaton of words follows, or its last half is a suffix, which a backward one
does. Words are dealt by hashes of their halves, those that lengths of one less and one more would
have included, so that a word and all that share the half meet in one bucket; each bucket builds its
two minimal automata, follows a word's half exactly and completes it with one error. What both
directions find counts for the forward one alone. Word numbers lead to the near words and their counts.

A half that more than ``most`` words share is cut once more: its words are dealt by the half and
either half of what is left, so that three quarters of a word agree in a bucket.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .acyclic import Automaton
from .line_dedup import checked
from .shared import bounded_batches, dropped, written

RUNS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a bucket, as a mean, and the most words that a bucket's half may share before it is cut.
BUCKET, MOST = 40_000, 20_000


def word_counts(docs: DataFrame, every: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the lower-cased runs of letters, of which one in ``every`` lacks a code point.

    Which run and which code point follow from crc32 of ``<doc_id>:<run>``; a null id is written as nothing.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUNS), F.lit(0))).alias("_run"))
    runs = runs.select("_id", F.translate("_run", UPPER, LOWER).alias("_run"))
    h = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    at = F.pmod(F.col("_h"), F.length("_run")).cast("int")
    cut = F.concat(F.expr("left(_run, cast(pmod(_h, length(_run)) as int))"), F.substring("_run", at + 2, F.length("_run")))
    runs = runs.withColumn("_h", h).select(F.when(F.col("_h") % every == 0, cut).otherwise(F.col("_run")).alias("word"))
    return runs.groupBy("word").agg(F.count("*").alias("n"))


def _left(n: Column) -> Column:
    return F.substring("word", F.lit(1), n.cast("int"))


def _right(n: Column) -> Column:
    return F.substring("word", (F.col("size") - n + 1).cast("int"), n.cast("int"))


def _halves(words: DataFrame, whole: bool) -> DataFrame:
    """A row for each direction and each length (as) that a word looking for this one may have.

    Unless ``whole``, only lengths that give different halves. ask: whether the length is the word's own.
    """
    size, even = F.col("size"), F.col("size") % 2 == 0
    lengths = {"f": [size, F.when(even, size - 1).otherwise(size + 1)], "b": [size, F.when(even, size + 1).otherwise(size - 1)]}
    if whole:
        lengths = dict.fromkeys(lengths, [size - 1, size, size + 1])
    rows = words.withColumn("size", F.length("word")).withColumn("_p", F.explode(F.array(*[F.struct(F.lit(d).alias("side"), x.cast("int").alias("length")) for d, xs in lengths.items() for x in xs])))
    rows = rows.select("word", "n", "size", "_p.side", "_p.length").withColumn("half", F.expr("length div 2"))
    key = F.when(F.col("side") == "f", _left(F.col("half"))).otherwise(_right(F.col("length") - F.col("half")))
    return rows.withColumn("key", F.concat("side", key)).withColumn("ask", F.col("length") == size)


def _asked(rows: DataFrame, forward: Column, exact: Column, must: Column, skip: Column) -> DataFrame:
    """What a bucket needs of a word: the code points that the walk takes exactly, those of its begin that a near word must have, and those that it must not."""
    return rows.select("key", "word", "n", "ask", forward.alias("forward"), exact.cast("int").alias("exact"), must.cast("int").alias("must"), skip.cast("int").alias("skip"))


def dealt(words: DataFrame, most: int = MOST) -> DataFrame:
    """words(word, n) as rows (key, word, n, ask, forward, exact, must, skip): near words of one that asks have its key."""
    rows = _halves(words, whole=False)
    hot = written(rows.groupBy("key").count().where(F.col("count") > most).select("key"), "hot-halves")
    half, rest, forward = F.col("half"), F.col("length") - F.col("half"), F.col("side") == "f"
    none = F.lit(-1)

    def simple(r: DataFrame) -> DataFrame:
        return _asked(r, forward, F.when(forward, half).otherwise(rest), F.lit(0), F.when(forward, none).otherwise(half))

    if hot.isEmpty():
        return simple(rows)
    again = _halves(words, whole=True).join(checked(hot), "key", "left_semi")
    # the part beside the half is cut at q: the error lies before or behind it
    again = again.withColumn("q", F.when(forward, half + F.expr("(length - half) div 2")).otherwise(F.expr("half div 2")))
    q, length = F.col("q"), F.col("length")
    ahead, behind = again.where(forward), again.where(~forward)
    cut = [
        _asked(ahead.withColumn("key", F.concat(F.lit("fl"), _left(q))), F.lit(True), q, F.lit(0), none),
        _asked(ahead.withColumn("key", F.concat(F.lit("fr"), _left(half), F.lit("|"), _right(length - q))), F.lit(False), length - q, half, q),
        _asked(behind.withColumn("key", F.concat(F.lit("bl"), _left(q), F.lit("|"), _right(rest))), F.lit(False), rest, q, half),
        _asked(behind.withColumn("key", F.concat(F.lit("br"), _right(length - q))), F.lit(False), length - q, F.lit(0), q),
    ]
    out = simple(rows.join(checked(hot), "key", "left_anti"))
    for c in cut:
        out = out.unionByName(c)
    return out


_FOUND = "word string, n_near bigint, form string, form_n bigint"


def _bucket(table: pa.Table) -> pa.Table:
    """For each word that asks: how many words are near, and the best of them."""
    counts = dict(zip(table["word"].to_pylist(), table["n"].to_pylist(), strict=True))
    sides: dict[bool, list[str]] = {True: [], False: []}
    seen: set[tuple[bool, str]] = set()
    rows = list(zip(*(table[c].to_pylist() for c in ("forward", "word", "ask", "exact", "must", "skip")), strict=True))
    for forward, word, *_ in rows:
        if (forward, word) not in seen:
            seen.add((forward, word))
            sides[forward].append(word if forward else word[::-1])
    automata = {}
    for forward, words in sides.items():
        words.sort()
        automata[forward] = Automaton(words)
    out = []
    for forward, word, ask, exact, must, skip in rows:
        if not ask:
            continue
        words, n, best = sides[forward], 0, None
        for k in automata[forward].near(word if forward else word[::-1], exact):
            other = words[k] if forward else words[k][::-1]
            if other[:must] == word[:must] and (skip < 0 or other[:skip] != word[:skip]):
                n += 1
                rank = (-counts[other], other)
                if best is None or rank < best:
                    best = rank
        if best:
            out.append((word, n, best[1], -best[0]))
    columns = list(zip(*out, strict=True)) if out else [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n_near", "form", "form_n"])


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """words(word, n) to (word, n_near, form, form_n): near words, and the one of largest n (the least of equals); words without any have no row."""
    rows = dealt(words, most)
    buckets = max(1, -(-4 * words.count() // BUCKET))
    found = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).drop("key").groupBy("bucket").applyInArrow(_bucket, _FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form) to (word, root): the end of each word's chain, by pointers that double in length. Counts double along a chain, so it has no cycle."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        dropped(now)
        now = step
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = step.select("word", "root")
        now._written_at = step._written_at


def spelling_variants(docs: DataFrame, least_size: int = 5, least_n: int = 3, factor: int = 2, every: int = 97, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """Per word of ``least_size`` code points and ``least_n`` occurrences: word, n, n_near, form, form_n and root.

    Near words differ by one code point. The form is the near word of largest n (the least in code-point
    order of equals) if that is ``factor`` times the word's own or more. Null and empty texts have no
    words, and a null id is written as nothing where ids count; repeated rows count each; words of any
    length are compared whole; other columns are ignored; an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    words = written(word_counts(base, every, "_id", "_text").where((F.length("word") >= least_size) & (F.col("n") >= least_n)), "words")
    found = words.join(near_words(words, most), "word", "left")
    real = F.col("form_n") >= F.col("n") * factor
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(real, F.col("form")).alias("form"), F.when(real, F.col("form_n")).alias("form_n")), "forms")
    out = found.join(roots(found.where("form is not null")), "word", "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
