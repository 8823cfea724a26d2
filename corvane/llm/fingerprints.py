"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame operations only.

A text's paragraphs are digested to 48 bits with 16 bits of check, and each digest goes to one
cell of each of three subtables; a cell keeps a count and the digests' exclusive or. The
fingerprint is the sketch of ``CELLS`` cells. Two sketches subtract cell by cell, common digests
cancel, and peeling recovers the differing ones: a cell of count 1 or -1 whose check fits holds
one digest, which leaves its other cells. Where cells are left, the retry is larger: the digests
are halved by a bit of another hash, each half has a sketch of ``CELLS`` cells, and what fails
again is halved again, so that the whole sketch doubles only where it has to. Digests are only
compared directly in parts that still fail at a depth of ``DEPTH``, for which some two to the
power of that many digests must differ. Likeness is the Jaccard similarity that the number of
differing digests gives.

What is a paragraph depends on the text, so that short ones have some too: lines and sentences,
or words if these are too few for the text's length, or pairs of letters if words are too few.
Two texts are compared by the longer paragraphs of the two, so likeness has no direction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions

#: Cells of a fingerprint and of each part of a larger sketch, a multiple of three, and how often a part may be halved.
CELLS, DEPTH = 24, 24
#: Sentences need texts of so many characters and words of so many; paragraphs need to be so many at least, of so many characters each at most, on average.
WORDS, LETTERS, LEAST, SENTENCE, WORD = 400, 48, 4, 400, 24
#: Ends of sentences: ASCII, Chinese and Japanese, Devanagari, Arabic, Ethiopic, Burmese.
MARKS = r"[.!?|\n\u3002\uFF01\uFF1F\uFF0E\u0964\u0965\u061F\u06D4\u1362\u104A\u104B]+\s*"
ROUNDS = 10
#: Differing digests that a part of the first larger sketch is to have, and the depth at which that sketch may be at most.
LOAD, FIRST = 8, 16
#: Groups of consecutive ids for each shuffle partition.
SPREAD = 4


def sentences(text: Column) -> Column:
    return F.split(text, MARKS)


def level(text: Column, cut: Column | None = None) -> Column:
    """0 for pairs of letters, 1 for words, 2 for lines and sentences. cut: the sentences, if they are there already."""
    n = F.length(text)

    def enough(parts: Column, longest: int) -> Column:
        return let(F.size(parts), lambda k: (k >= LEAST) & (k * longest >= n))

    return F.when((n >= WORDS) & enough(sentences(text) if cut is None else cut, SENTENCE), 2).when((n >= LETTERS) & enough(F.split(text, r"\s+"), WORD), 1).otherwise(0)


def digests(text: Column, lvl: Column, cut: Column | None = None) -> Column:
    """The distinct paragraph digests of a text."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    parts = F.when(lvl == 0, pairs).when(lvl == 1, F.split(text, r"\s+")).otherwise(sentences(text) if cut is None else cut)
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p != ""), lambda p: _key(F.xxhash64(p))))


def _cell(key: Column, table: int) -> Column:
    third = CELLS // 3
    return (F.pmod(F.shiftright(key, 16 + 16 * table), F.lit(third).cast("bigint")) + F.lit(third * table)).cast("int")


def _key(digest: Column) -> Column:
    """A digest's upper 48 bits with a check of them below."""
    top = F.shiftleft(F.shiftrightunsigned(digest, 16), 16)
    return top.bitwiseOR(F.hash(top).bitwiseAND(F.lit(0xFFFF)).cast("bigint"))


def let(value: Column, body) -> Column:
    """body of value, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _signed(keys: Column, sign: int) -> Column:
    """Keys with a sign and a hash of 32 bits, by which parts are made."""
    return F.transform(keys, lambda k: F.struct(F.hash(k).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")).alias("h"), k.alias("k"), F.lit(sign).alias("s")))


def sketch(signed: Column) -> Column:
    """array<struct<c, k>>: the sum of signs and the keys of each cell. With the keys of two texts and unlike signs it is the difference of their sketches."""
    third = CELLS // 3
    rows = F.transform(signed, lambda r: F.struct(r["k"].alias("k"), r["s"].alias("s"), *[_cell(r["k"], t).alias(f"i{t}") for t in range(3)]))

    def cell(own):
        empty = F.struct(F.lit(0).alias("c"), F.lit(0).cast("bigint").alias("k"))
        return F.aggregate(own, empty, lambda s, r: F.struct((s["c"] + r["s"]).alias("c"), s["k"].bitwiseXOR(r["k"]).alias("k")))

    def table(rows, t):
        return F.transform(F.sequence(F.lit(third * t), F.lit(third * t + third - 1)), lambda i: cell(F.filter(rows, lambda r: r[f"i{t}"] == i)))

    return let(rows, lambda rows: F.concat(*[table(rows, t) for t in range(3)]))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k")))


def peel(cells: Column) -> Column:
    """struct<cells, found, go>: what peeling leaves, and the differing keys with their sign."""
    third = CELLS // 3
    start = F.struct(cells.alias("cells"), F.array().cast("array<struct<c:int,k:bigint>>").alias("found"), F.lit(True).alias("go"))

    def less(cells, placed):
        def one(t):
            def of(x, i):
                here = F.filter(placed, lambda p: p[f"i{t}"] == i + third * t)
                return F.aggregate(here, x, lambda a, p: F.struct((a["c"] - p["p"]["c"]).alias("c"), a["k"].bitwiseXOR(p["p"]["k"]).alias("k")))

            return F.transform(F.slice(cells, third * t + 1, third), of)

        return F.concat(*[one(t) for t in range(3)])

    def after(s, pure):
        placed = F.transform(pure, lambda p: F.struct(p.alias("p"), *[_cell(p["k"], t).alias(f"i{t}") for t in range(3)]))
        cells = F.when(F.size(pure) > 0, let(placed, lambda q: less(s["cells"], q))).otherwise(s["cells"])
        return F.struct(cells.alias("cells"), F.concat(s["found"], pure).alias("found"), (F.size(pure) > 0).alias("go"))

    def turn(s, _):
        pure = F.array_distinct(F.filter(s["cells"], lambda x: (F.abs(x["c"]) == 1) & (x["k"] == _key(x["k"]))))
        return F.when(s["go"], let(pure, lambda p: after(s, p))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _differing(cells: Column) -> Column:
    """The number of differing digests, or null if peeling did not end."""
    return let(peel(cells), lambda s: F.when(~F.exists(s["cells"], lambda x: (x["c"] != 0) | (x["k"] != 0)), F.size(s["found"])))


def differing(a: Column, b: Column, cells: Column) -> Column:
    """struct<d, cells, ...>: how many digests differ, and the cells of the sketches that said so.

    cells: the difference of the two sketches. If it can't be peeled, the parts of a first larger
    sketch are as many as the sum of its squared counts asks for, which estimates the difference.
    A part of depth i is the digests whose hash has its number as the highest i bits.
    """
    none = F.array().cast("array<bigint>")
    shifted = lambda x, by: F.call_function("shiftright", x, by)

    def larger(rows, squares):
        apart = F.abs(F.size(a) - F.size(b)).cast("double")
        # of counts that are sums of d signs with the total ``apart``, spread over a table's cells
        third = CELLS // 3
        guess = (squares / 3.0 - apart * apart / third) * (third / (third - 1))
        depth = F.least(F.greatest(F.ceil(F.log2(F.least(F.greatest(apart, guess), (F.size(a) + F.size(b)).cast("double")) / LOAD)).cast("int"), F.lit(1)), F.lit(FIRST))

        def turn(s, _):
            def attempt(hashes, p):
                def counted(own):
                    x, y = (F.transform(F.filter(own, lambda r: r["s"] == sign), lambda r: r["k"]) for sign in (1, -1))
                    direct = F.size(F.array_except(x, y)) + F.size(F.array_except(y, x))
                    return F.when(F.size(own) == 0, 0).when(s["depth"] < DEPTH, _differing(sketch(own))).otherwise(direct)

                many = F.size(hashes) - F.size(F.array_remove(hashes, p))
                own = F.when(many == 0, F.slice(rows, 1, 0)).otherwise(F.slice(rows, F.array_position(hashes, p).cast("int"), many))
                return F.struct(p.alias("p"), let(own, counted).alias("d"))

            def after(tried):
                failed = F.filter(tried, lambda t: t["d"].isNull())
                return F.struct(
                    F.aggregate(tried, s["d"], lambda n, t: n + F.coalesce(t["d"], F.lit(0))).alias("d"),
                    (s["cells"] + CELLS * (F.size(tried) - F.size(failed))).alias("cells"),
                    (s["depth"] + 1).alias("depth"),
                    F.flatten(F.transform(failed, lambda t: F.array(t["p"] * 2, t["p"] * 2 + 1))).alias("pending"),
                )

            hashes = F.transform(rows, lambda r: shifted(r["h"], 32 - s["depth"]))
            return F.when(F.size(s["pending"]) == 0, s).otherwise(let(let(hashes, lambda h: F.transform(s["pending"], lambda p: attempt(h, p))), after))

        start = let(depth, lambda i: F.struct(F.lit(0).alias("d"), F.lit(0).alias("cells"), i.alias("depth"), F.sequence(F.lit(0).cast("bigint"), F.call_function("shiftleft", F.lit(1).cast("bigint"), i) - 1).alias("pending")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), start, turn)

    def tried(first):
        squares = F.aggregate(cells, F.lit(0).cast("bigint"), lambda n, x: n + x["c"] * x["c"])
        done = F.struct(first.alias("d"), F.lit(CELLS).alias("cells"), F.lit(0).alias("depth"), none.alias("pending"))
        rows = F.array_sort(F.concat(_signed(a, 1), _signed(b, -1)))
        return F.when(first.isNotNull(), done).otherwise(let(rows, lambda rows: larger(rows, squares)))

    return let(F.when(F.abs(F.size(a) - F.size(b)) <= CELLS, _differing(cells)), tried)


def likeness(a: Column, b: Column, d: Column) -> Column:
    """From the digests of two texts and how many differ. Two texts without a paragraph are alike."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, 1.0).otherwise((n - d).cast("double") / (n + d))


def _text(cells: Column, lvl: Column) -> Column:
    """A sketch in print: the level, then count and keys in hexadecimal; runs of empty cells are dots."""
    return F.concat(lvl.cast("string"), F.lit(":"), F.array_join(F.transform(cells, lambda x: F.when(x["c"] == 0, ".").otherwise(F.concat_ws("-", F.hex(x["c"].cast("bigint")), F.lower(F.hex(x["k"]))))), ","))


def fingerprint(text: Column) -> Column:
    return let(level(text), lambda lvl: _text(sketch(_signed(digests(text, lvl), 1)), lvl))


def _blocks(docs: DataFrame, id_col: str, n: int) -> Column:
    """The group of consecutive ids that a row is in: about n groups, none empty, by quantiles of the ids."""
    row = docs.agg(F.min(id_col).alias("least"), F.percentile_approx(id_col, [i / n for i in range(1, n)] or [0.5], 20 * n).alias("cuts")).first()
    bounds = sorted({b for b in row.cuts or [] if b > row.least})
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    marks = F.array(*[F.lit(b) for b in bounds[::step]])
    every = F.array(*[F.lit(b) for b in bounds])
    coarse = F.greatest(F.size(F.filter(marks, lambda b: b <= F.col("id"))) - 1, F.lit(0)) * step
    return coarse + F.size(F.filter(F.slice(every, coarse + 1, step), lambda b: b <= F.col("id")))


def _own(rows: DataFrame, text: str, lvl: str, found: str) -> DataFrame:
    """Adds the level and the digests of a text; the text is cut into sentences once."""
    rows = rows.withColumn("_cut", F.when(F.length(text) >= WORDS, sentences(F.col(text))))
    rows = rows.withColumn(lvl, level(F.col(text), F.col("_cut")))
    return rows.withColumn(found, digests(F.col(text), F.col(lvl), F.col("_cut"))).drop("_cut")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text (null: empty) with its level and digests, and those of the next document in ascending order of id; after the last comes the first.

    Rows of one id are in the order of their texts, null ids come first. The order is found
    within groups of consecutive ids; only each group's first row meets the group before it.
    """
    n = max(2, SPREAD * partitions(docs.sparkSession))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("block", _blocks(docs, id_col, n).cast("int") if n > 1 else F.lit(0))
    order = Window.partitionBy("block").orderBy(F.col("id").asc_nulls_first(), "text")
    firsts = rows.groupBy("block").agg(F.min(F.struct("id", "text")).alias("first"))
    last = rows.agg(F.max("block").alias("b")).first().b or 0
    firsts = firsts.select(F.pmod(F.col("block") - 1, F.lit(last + 1)).alias("block"), F.col("first.text").alias("text"))
    rows, firsts = (_own(x, "text", "l_text", "d_text").withColumn("_own", F.struct("text", "l_text", "d_text")) for x in (rows, firsts))
    firsts = firsts.select("block", F.col("_own").alias("_first"))
    led = rows.withColumn("_lead", F.lead("_own").over(order))
    after = F.coalesce("_lead", "_first", "_own")
    rows = led.join(firsts, "block", "left").select("id", "text", "l_text", "d_text", after.alias("_next"))
    return rows.select("id", "text", "l_text", "d_text", F.col("_next.text").alias("next"), F.col("_next.l_text").alias("l_next"), F.col("_next.d_text").alias("d_next"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints each text, its edited text (the last quarter replaced from the next document's start), and compares.

    Returns one row per input row: the id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next (likeness of the text to the edited text and to
    the next document, 0 to 1), edited_cells and next_cells (cells of the sketches that peeling
    emptied for these). Ids are numbers. Null is an empty text; a single row is its own next; equal
    texts have equal fingerprints; other columns are ignored; an empty table gives an empty one.
    """
    rows = with_next(docs, id_col, text_col)
    n = F.length("text")
    rows = rows.withColumn("n", n).withColumn("q", F.floor(n / 4).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - F.col("q")), F.substring("next", F.lit(1), F.col("q"))))
    rows = _own(rows, "edited", "l_edited", "d_edited")
    # at the longer paragraphs of the two, which are mostly the text's own
    for other in ("edited", "next"):
        rows = rows.withColumn(f"m_{other}", F.greatest("l_text", f"l_{other}"))
        common = F.col(f"m_{other}")
        rows = rows.withColumn(f"a_{other}", F.when(common == F.col("l_text"), F.col("d_text")).otherwise(digests(F.col("text"), common)))
        rows = rows.withColumn(f"b_{other}", F.when(common == F.col(f"l_{other}"), F.col(f"d_{other}")).otherwise(digests(F.col(other), common)))
    rows = rows.select("id", "n", F.sha2("edited", 256).alias("edited_sha256"), *[f"{p}_{name}" for p in "ld" for name in ("text", "edited")], *[f"{p}_{name}" for p in "mab" for name in ("edited", "next")])
    # one expression for all sketches and one for both comparisons: it is large, and planned once so
    sketched = F.array("d_text", "d_edited", *[F.when((F.col(f"m_{o}") != F.col("l_text")), F.col(f"a_{o}")) for o in ("edited", "next")], F.when(F.col("m_edited") != F.col("l_edited"), F.col("b_edited")), F.col("b_next"))
    rows = rows.withColumn("_s", F.transform(sketched, lambda d: sketch(_signed(d, 1))))
    s_text, s_edited, a_edited, a_next, b_edited, b_next = (F.get("_s", F.lit(i)) for i in range(6))
    pairs = [("edited", F.coalesce(a_edited, s_text), F.coalesce(b_edited, s_edited)), ("next", F.coalesce(a_next, s_text), b_next)]
    rows = rows.withColumn("_p", F.array(*[F.struct(F.col(f"a_{o}").alias("a"), F.col(f"b_{o}").alias("b"), subtract(x, y).alias("c")) for o, x, y in pairs]))
    compared = F.transform("_p", lambda p: let(differing(p["a"], p["b"], p["c"]), lambda x: F.struct(likeness(p["a"], p["b"], x["d"]).alias("near"), x["cells"].alias("cells"))))
    rows = rows.withColumn("_x", compared)
    return rows.select(
        F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_chars"), "edited_sha256",
        _text(s_text, F.col("l_text")).alias("fingerprint"), _text(s_edited, F.col("l_edited")).alias("edited_fingerprint"),
        *[F.get("_x", F.lit(i))[field].alias(f"{prefix}{other}{suffix}") for field, prefix, suffix in (("near", "near_", ""), ("cells", "", "_cells")) for i, other in enumerate(("edited", "next"))],
    )
