"""Line deduplication by a fixed-depth tree of line templates, in DataFrame operations only.

A line's tokens are its parts between spaces and tabs; runs of ASCII characters with a digit are
masked. Its leaf in the tree is its token count and leading tokens, or for a line of fewer than
``min_tokens`` tokens the masked line. Leaves that fewer than ``min_docs`` documents reach are
done with. The lines of the others have two templates: the masked line (the line itself if no
letter is left of it), whatever its token count; and, from ``min_tokens`` tokens on, its leaf with
its constants. Those are its best-supported tokens, the support of a token being the number of
the leaf's lines that hold it at its place: as many as make, with the masked tokens, ``constant``
of all its tokens, and any that tie with the last of them. A line whose supports first fall to
half or less before that has no more constants than come before the fall, if these and the
masked tokens make ``loose`` of all and two more than the leading ones: a template may have
that many fields, and a leaf of lines that only begin alike is no template. What is not constant
is a field. Only ranks and ratios of supports count, never their size, so a template is the same
in a corpus of any size.
Templates that recur in ``min_docs`` documents are boilerplate: their lines go, but for the
first one in the corpus, so that each line that goes has an earlier one of its template.

Lines are aggregated by content before their tokens are compared, so a line that a third of
all documents hold is one row there; counts are partial aggregates and joins are equi-joins.
Leaves, lines and templates are known by 64 bits of hash, templates and documents by 96.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written

FIELD = "<*>"
#: Rows of a table that is broadcast; a larger one is joined by a shuffle. Its rows are a few numbers each.
BROADCAST_ROWS = 200_000


def checked(small: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its counted size allows."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _masked(text: Column) -> Column:
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, r"[!-/:-~]*+[0-9][!-~]*+", FIELD)).otherwise(text)


def line_dedup(docs: DataFrame, min_docs: int = 8, constant: float = 0.75, depth: int = 3, min_tokens: int = 3, id_col: str = "doc_id", text_col: str = "text", loose: float = 0.6) -> DataFrame:
    """Drops lines whose template recurs in ``min_docs`` documents or more, but for the first such line.

    First is by id (null first), then by line. Lines of fewer than ``min_tokens`` tokens have no
    template but their masked line; blank lines stay.
    Returns all columns of the input with the text that is left, and n_lines, n_dropped. A null
    text stays null with no lines, an empty text is one empty line; rows that repeat both id and
    text are one document and share its fate; a longer text has more lines and no other limit; an
    empty table gives an empty one. A column named n_lines or n_dropped is replaced.
    """
    text = F.col(text_col)
    base = docs.drop(*[c for c in ("n_lines", "n_dropped") if c != text_col and c in docs.columns])
    base = base.withColumn("_k1", F.xxhash64(id_col, text_col)).withColumn("_k2", F.hash(text_col, id_col))
    lines = base.select(F.col(id_col).alias("id"), "_k1", "_k2", F.posexplode(F.split(text, "\n")).alias("no", "line")).withColumn("line", F.btrim("line", F.lit(" \t\x0b\f\r")))
    lines = lines.where(F.col("line") != "").withColumn("line", F.translate("line", "\t", " "))
    lines = lines.withColumn("n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    lines = lines.withColumn("lead", F.expr(f"substring_index(line, ' ', least({int(depth)}, n div 2))"))
    leaf = F.when(F.col("n") < min_tokens, F.xxhash64(F.lit(-1), _masked(F.col("line")))).otherwise(F.xxhash64("n", _masked(F.col("lead"))))
    lines = lines.select("id", "_k1", "_k2", "no", "line", leaf.alias("leaf"))
    leaves = lines.select("leaf", "_k1").distinct().groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf")
    hot = lines.join(checked(written(leaves, "leaves")), "leaf", "left_semi").withColumn("masked", _masked(F.col("line")))
    letters = F.col("masked").rlike(r"\p{L}")
    whole = [F.when(letters, f(F.lit(0), "masked")).otherwise(f(F.lit(1), "line")) for f in (F.xxhash64, F.hash)]
    hot = hot.select("id", "_k1", "_k2", "no", whole[0].alias("whole"), whole[1].alias("check"), F.split("masked", " ").alias("tokens"), "leaf", F.xxhash64("masked").alias("line"))
    hot = written(hot, "lines")

    long = hot.where(F.size("tokens") >= min_tokens)
    unique = long.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.first("tokens").alias("tokens"))
    masked = F.size(F.filter("tokens", lambda t: t == FIELD))
    least = F.greatest(F.ceil(F.size("tokens") * float(constant)).cast("int") - masked, F.lit(1))
    lead = F.least(F.lit(int(depth)), F.floor(F.size("tokens") / 2).cast("int"))
    enough = F.greatest(F.ceil(F.size("tokens") * float(loose)).cast("int"), lead + 2) - masked
    places = unique.select("leaf", "line", "n", least.alias("least"), enough.alias("loose"), F.posexplode(F.transform("tokens", lambda t: F.when(t != FIELD, F.xxhash64(t)))).alias("place", "token")).where("token is not null")
    supports = places.groupBy("leaf", "place", "token").agg(F.sum("n").alias("s"))
    ranked = places.join(supports, ["leaf", "place", "token"]).groupBy("leaf", "line", "least", "loose").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "place", "token"))).alias("t"))
    ranked = ranked.where(F.size("t") >= F.col("least"))
    # supports are negative here; the last place has none after it
    fall = F.array_position(F.zip_with("t", F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(1))), lambda a, b: b["s"] * 2 >= a["s"]), True).cast("int")
    ranked = ranked.withColumn("least", F.when((fall >= F.col("loose")) & (fall > 0), F.least(fall, "least")).otherwise(F.col("least")))
    constants = F.array_sort(F.transform(F.filter("t", lambda x: x["s"] <= F.element_at("t", F.col("least"))["s"]), lambda x: F.struct(x["place"], x["token"])))
    templates = ranked.select("leaf", "line", constants.alias("constants")).select("leaf", "line", F.xxhash64("leaf", "constants").alias("template"), F.hash("constants", "leaf").alias("check"))

    named = long.select("id", "_k1", "_k2", "no", "leaf", "line").join(templates, ["leaf", "line"]).select("id", "_k1", "_k2", "no", "template", "check")
    named = written(named.unionByName(hot.select("id", "_k1", "_k2", "no", F.col("whole").alias("template"), "check")), "templates")
    dropped(hot)
    documents = named.groupBy("template", "check", "_k1").agg(F.min(F.struct("id", "_k1", "no")).alias("first"))
    recurring = documents.groupBy("template", "check").agg(F.count("*").alias("d"), F.min("first").alias("first")).where(F.col("d") >= min_docs)
    recurring = written(recurring.select("template", "check", F.col("first._k1").alias("first_k1"), F.col("first.no").alias("first_no")), "recurring")
    gone = named.join(checked(recurring), ["template", "check"]).where((F.col("_k1") != F.col("first_k1")) | (F.col("no") != F.col("first_no")))
    gone = gone.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set("no")).alias("_gone"))
    parts = F.split(text, "\n")
    # what lies between two lines that go is one slice, so a text of many lines is walked once
    begins, ends = F.concat(F.array(F.lit(0)), F.transform("_gone", lambda i: i + 1)), F.concat("_gone", F.array(F.size(parts)))
    left = F.flatten(F.zip_with(begins, ends, lambda b, e: F.slice(parts, b + 1, e - b)))
    out = base.join(gone, ["_k1", "_k2"], "left")
    return out.select(
        *[F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(left, "\n")).alias(text_col) if c == text_col else F.col(c) for c in base.columns if c not in ("_k1", "_k2")],
        F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("bigint").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("bigint").alias("n_dropped"),
    )
