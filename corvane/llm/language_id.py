"""Language identification by Bayesian fusion of text, declared language, address and host.

Text: a multinomial model of byte trigrams (lower-cased letters, spaces and non-ASCII bytes),
fitted on distinct texts of the ``MOST_LANGUAGES`` declared languages that have most of them (what else
is declared counts as missing), chosen by hash: of each at most an equal
share of ``sample_rows``, though never less than ``LEAST`` (a language adds 256 KB to the model),
and a text's rows count by their logarithm; one more class, ``und``, takes all trigrams for equally
likely. Declared language and address suffix: each names
the true language with a given reliability. Host: a prior over languages from a grouped count
of what the text model alone says over all rows, smoothed towards the prior of the suffix,
itself smoothed towards that of all rows. Scores, priors and posteriors are one array each, in the
order of languages, so plans are the same for any number of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .known import forget
from .shared import bounded_batches, written

BUCKETS = 1 << 16
#: Distinct texts of a language that the model may always take.
LEAST = 50
#: Languages of the model: declared values of fewer texts are evidence that is missing.
MOST_LANGUAGES = 256
#: Hosts in a table that is broadcast (a host is a name and a number per language); more are joined by a shuffle.
BROADCAST_HOSTS = 50_000
UND = "und"
_LETTER = np.zeros(256, bool)
_LETTER[[0x20, 0x0A, *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of letters within documents, and their documents."""
    d = W._LOWER[data]
    if len(d) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = _LETTER[d]
    ok = ok[:-2] & ok[1:-1] & ok[2:]
    for back in (1, 2):  # not across documents
        at = offsets[1:-1] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    at = np.flatnonzero(ok)
    x = d.astype(np.uint32)
    key = (x[at] << np.uint32(16)) | (x[at + 1] << np.uint32(8)) | x[at + 2]
    return ((key * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), np.searchsorted(offsets, at, "right") - 1


def fit(rows: list[tuple[str, str, float]]) -> tuple[list[str], np.ndarray]:
    """Languages (und last) and the log-probabilities of buckets, from (language, text, weight) rows."""
    counts: dict[str, np.ndarray] = {}
    for lang, text, weight in rows:
        for _, data, offsets in W.chunks(pa.array([text], pa.large_string())):
            buckets, _ = _trigrams(data, offsets)
            counts[lang] = counts.get(lang, 0) + weight * np.bincount(buckets, minlength=BUCKETS)
    langs = sorted(counts)
    table = np.zeros((BUCKETS, len(langs) + 1), np.float32)
    for i, lang in enumerate(langs):
        c = counts[lang] + 0.05
        table[:, i] = np.log(c / c.sum())
    table[:, -1] = -math.log(BUCKETS)
    return [*langs, UND], table


def _scores(table: np.ndarray, text: str, back: list[str]):
    def run(batches):
        forget()
        for batch in batches:
            total = [np.zeros((0, table.shape[1]), np.float32)]
            n = [np.zeros(0, np.int64)]
            for _, data, offsets in W.chunks(batch[text]):
                docs = len(offsets) - 1
                buckets, doc = _trigrams(data, offsets)
                edges = np.searchsorted(doc, np.arange(docs + 1))
                part = np.empty((docs, table.shape[1]), np.float32)
                sums = np.zeros(len(buckets) + 1)
                for i in range(table.shape[1]):
                    np.cumsum(table[buckets, i], dtype=np.float64, out=sums[1:])
                    part[:, i] = sums[edges[1:]] - sums[edges[:-1]]
                total.append(part)
                letters = np.concatenate([[0], np.cumsum(_LETTER[W._LOWER[data]] & ~W.SPACES[data])])
                n.append(letters[offsets[1:]] - letters[offsets[:-1]])
            flat = np.concatenate(total)
            scores = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, table.shape[1]), pa.int32()), pa.array(flat.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in back), scores, pa.array(np.concatenate(n))], names=[*back, "_scores", "_n"])

    return run


def _primary(c: Column) -> Column:
    return F.lower(F.substring_index(F.substring_index(F.trim(c), "-", 1), "_", 1))


def _sample(rows: DataFrame, most: int) -> list[tuple[str, str, float]]:
    """Of each declared language, its distinct texts of the least hashes; n rows of a text weigh 1 + log2(n)."""
    labelled = rows.where(F.col("_declared").isNotNull() & (F.col("_text") != "")).select("_declared", "_text", F.shiftrightunsigned(F.xxhash64("_text"), 2).alias("_h"))
    most_texts = labelled.groupBy("_declared").agg(F.approx_count_distinct("_h").alias("n")).orderBy(F.desc("n"), "_declared").limit(MOST_LANGUAGES)
    texts = {r[0]: r[1] for r in most_texts.collect()}
    if not texts:
        return []
    bound = max(LEAST, -(-most // len(texts)))
    # half as many again as needed: the counts are estimates
    cuts = F.create_map(*[F.lit(x) for lang, n in texts.items() for x in (lang, int(min(1.0, 1.5 * bound / max(n, 1)) * (1 << 62)))])
    by: dict[str, list] = {}
    for r in labelled.where(F.col("_h") <= F.element_at(cuts, F.col("_declared"))).groupBy("_declared", "_h", "_text").count().collect():
        by.setdefault(r[0], []).append((r[1], r[2], 1 + math.log2(r[3])))
    return [(lang, text, weight) for lang in sorted(by) for _, text, weight in sorted(by[lang])[:bound]]


def language_id(
    df: DataFrame, text_col: str = "text", declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, sample_rows: int = 2000, text_weight: float = 0.3, declared_right: float = 0.9, suffix_right: float = 0.8, smoothing: float = 20.0, und_prior: float = 0.01, keep: tuple[str, ...] | None = None
) -> DataFrame:
    """Returns the columns in ``keep`` (all of the input if None) and language, confidence, text_language and rejected.

    If the text is not to be returned, the scores are written beside the kept columns, and both
    the host counts and the result come from there. If it is, texts are scored for the counts and
    again for the result: writing all texts once more would cost more than that.

    language is the class of the largest posterior, or null where the text has no letter (also
    null and empty texts) or ``und`` wins: those rows are rejected, whatever else says. Letters
    too few for a trigram leave it to the other evidence. Missing evidence counts for nothing; declared values unknown to the model are taken as
    missing; ties go to the first language by name; repeated rows each count; without a labelled
    row all rows are rejected; an empty table gives an empty one. Input columns of the names
    above are replaced.
    """
    bounded_batches(df.sparkSession)
    own = ("language", "confidence", "text_language", "rejected")
    names = [c for c in (df.columns if keep is None else dict.fromkeys(keep)) if c not in own or c == text_col]
    null = F.lit(None).cast("string")
    src = df.select(
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)], F.col(text_col).alias("_text"), (null if declared is None else _primary(declared)).alias("_declared"),
        (null if suffix is None else _primary(suffix)).alias("_suffix"), F.coalesce(null if host is None else host, F.lit("")).alias("_host"),
    )
    langs, table = fit(_sample(src, sample_rows))
    known = langs[:-1]
    own_text = f"_c{names.index(text_col)}" if text_col in names else None

    def scored(rows: DataFrame, keep: list[str]) -> DataFrame:
        text = own_text if own_text in keep else "_text"  # goes to the workers once
        schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
        rows = rows.select(*dict.fromkeys([*keep, text]))
        return rows.mapInArrow(_scores(table, text, keep), f"{schema}, _scores array<float>, _n bigint")

    names_of = F.lit(langs) if len(langs) > 1 else F.array(F.lit(UND))

    def says(scores: Column) -> Column:
        """The place of the largest, the first of equals; null without a letter."""
        return F.when(F.col("_n") > 0, F.array_position(scores, F.array_max(scores)).cast("int"))

    base = scored(src, [f"_c{i}" for i in range(len(names))] + ["_declared", "_suffix", "_host"])
    if own_text is None:
        base = written(base, "scores")
    if known:
        prior = _priors((scored(src, ["_suffix", "_host"]) if own_text else base).select("_host", F.coalesce("_suffix", F.lit("")).alias("_sfx"), says(F.col("_scores")).alias("l")), len(known), smoothing)
        few = prior.count() <= BROADCAST_HOSTS
        base = base.withColumn("_sfx", F.coalesce("_suffix", F.lit(""))).join(F.broadcast(prior) if few else prior, ["_host", "_sfx"], "left")
    else:
        base = base.withColumn("_prior", F.array().cast("array<double>"))

    def evidence(column: str, right: float) -> tuple[str, Column]:
        place = F.array_position(F.lit(known), F.col(column)) if known else F.lit(0)
        return f"{column}_at", F.when(place > 0, place.cast("int") - 1)

    kinds = (("_declared", declared_right), ("_suffix", suffix_right))
    base = base.withColumns(dict(evidence(*k) for k in kinds))

    def posterior(x: Column, i: Column) -> Column:
        for column, right in kinds:
            wrong = math.log((1 - right) / max(1, len(known) - 1)) if right < 1 else -1e9
            x = x + F.when(F.col(f"{column}_at").isNull(), 0.0).when(F.col(f"{column}_at") == i, math.log(right)).otherwise(wrong)
        return x

    text = F.zip_with(F.slice("_scores", 1, len(known)), "_prior", lambda s, p: s.cast("double") * text_weight + p + math.log(1 - und_prior))
    und = F.element_at("_scores", len(langs)).cast("double") * text_weight + math.log(und_prior)
    out = base.withColumn("_q", F.concat(F.transform(text, posterior), F.array(und)))
    out = out.withColumn("_best", F.array_max("_q"))
    winner = F.element_at(names_of, says(F.col("_q")))
    language = F.when(winner != UND, winner)
    return out.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], language.alias("language"),
        F.when(F.col("_n") > 0, 1 / F.aggregate("_q", F.lit(0.0), lambda total, x: total + F.exp(x - F.col("_best")))).alias("confidence"), F.element_at(names_of, says(F.col("_scores"))).alias("text_language"), language.isNull().alias("rejected"),
    )


def _priors(said: DataFrame, known: int, smoothing: float) -> DataFrame:
    """said(_host, _sfx, l: place from 1, null or beyond ``known`` for none) to (_host, _sfx, _prior): log-probabilities of languages in order."""
    counts = written(said.groupBy("_host", "_sfx", "l").count(), "hosts")
    whole = {r[0]: r[1] for r in counts.groupBy("l").agg(F.sum("count")).collect() if r[0] and r[0] <= known}  # a row for each language
    total = sum(whole.values())
    overall = F.lit([(whole.get(i, 0) + 1) / (total + known) for i in range(1, known + 1)])

    def arrays(*keys: str) -> DataFrame:
        """For each key the counts of all languages in order, and their sum."""
        own = counts.groupBy(*keys, "l").agg(F.sum("count").alias("n")).where(F.col("l").isNotNull() & (F.col("l") <= known))
        own = own.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("l", "n"))).alias("m"), F.sum("n").alias("sum"))
        own = counts.select(*keys).distinct().join(own, list(keys), "left")
        return own.select(*keys, F.transform(F.sequence(F.lit(1), F.lit(known)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("n"), F.coalesce("sum", F.lit(0)).alias("sum"))

    parents = arrays("_sfx").select("_sfx", F.zip_with("n", overall, lambda n, o: (n + smoothing * o) / (F.col("sum") + smoothing)).alias("parent"))
    prior = arrays("_host", "_sfx").join(parents, "_sfx")
    return written(prior.select("_host", "_sfx", F.zip_with("n", "parent", lambda n, p: F.log((n + smoothing * p) / (F.col("sum") + smoothing))).alias("_prior")), "priors")


def page_evidence(url: Column, html: Column) -> dict[str, Column]:
    """Declared language, suffix and host of a web page: the lang attribute of its html tag, the language part of its path or else the last label of its host, and its host."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([a-z]{2})(?:[/?#]|$)", 1)
    top = F.regexp_extract(host, r"\.([a-z]{2,})$", 1)
    lang = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1)
    empty = lambda c: F.when(c != "", c)
    return {"declared": empty(lang), "suffix": F.coalesce(empty(path), empty(top)), "host": empty(host)}
