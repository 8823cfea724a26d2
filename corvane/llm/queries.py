"""The queries of this subpackage: one per operator, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .fingerprints import fingerprints
from .html_extract import html_extract
from .jaccard_join import jaccard_join
from .language_id import language_id, page_evidence
from .line_dedup import line_dedup
from .lm_scoring import lm_scores
from .packing import best_fit_packing
from .substring_dedup import substring_dedup
from .shared import spread
from .spelling import spelling_variants
from .token_counts import token_counts
from .vector_codes import vector_codes
from .warc import read_archives, write_archives


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(_table(spark, sf_dir, "pages")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language_id(docs, declared=F.col("lang"), host=F.col("source"), keep=("doc_id",))
    return out.select("doc_id", "language", F.round("confidence", 4).alias("confidence"), "rejected")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of pages by their main text, their markup's declaration, their address and host."""
    pages = _table(spark, sf_dir, "pages")
    evidence = page_evidence(F.col("url"), F.col("html"))
    texts = html_extract(pages.withColumns({f"_{k}": v for k, v in evidence.items()}), keep=tuple(f"_{k}" for k in evidence))
    out = language_id(texts, **{k: F.col(f"_{k}") for k in evidence}, keep=("page_id",))
    return out.select("page_id", "language", F.round("confidence", 4).alias("confidence"), "rejected")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(_table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_codes(_table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_line_dedup, op2_token_counts, op3_substring_dedup, op4_jaccard_join, op5_decontaminate, op6_warc, op7_language_id, op8_best_fit_packing, op9_fingerprints, op10_html_extract, op11_vector_codes, op12_lm_scoring, op13_spelling_variants, language_id_pages, pipeline)
    return {f.__name__: f for f in named}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
 g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
 r AS (SELECT doc_id, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
 c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM r),
 gone AS (SELECT doc_id, list(k) AS ks FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
 sha256(array_to_string(list_filter(w, lambda x, i: ks IS NULL OR NOT list_contains(ks, i)), ' ')) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
"""

OP4 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
 t(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(min(t.b) AS BIGINT) AS component_id,
 CAST((SELECT count(*) FROM l WHERE l.a = d.doc_id) AS BIGINT) AS n_links
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN t ON t.a = d.doc_id GROUP BY d.doc_id, n.n
"""

OP5 = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
 b AS (SELECT DISTINCT item_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
 bg AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
 sizes AS (SELECT DISTINCT m FROM bg),
 dg AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
 h AS (SELECT doc_id, i, dg.m, item_id FROM dg JOIN bg ON dg.g = bg.g AND dg.m = bg.m),
 hits AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
 items AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(hits.n > 0 AND 20 * hits.n >= len(w), false) AS contaminated
FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""


# A distance and an entry are one number, so the least is the nearest with ties to the lower index.
_NEAREST = "SELECT p.part, p.vec_id, p.label, p.x, min(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 16 + c.entry) AS m FROM p JOIN {book} c USING (part) GROUP BY ALL"
_ROUND = """, a{k} AS MATERIALIZED (SELECT part, vec_id, x, m % 16 AS entry FROM ({nearest})),
 m{k} AS (SELECT part, entry, list(v ORDER BY i) AS x FROM (SELECT part, entry, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS v FROM a{k}, range(1, len(x) + 1) t(i) GROUP BY ALL) GROUP BY ALL),
 b{k} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.x, b{last}.x) AS x FROM b{last} LEFT JOIN m{k} USING (part, entry))"""
OP11 = (
    """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS MATERIALIZED (SELECT vec_id, label, part, q[part * len(q) // 8 + 1:(part + 1) * len(q) // 8] AS x FROM v, range(8) t(part)),
 f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16)),
 b0 AS MATERIALIZED (SELECT part, entry, x FROM p JOIN f USING (vec_id))"""
    + "".join(_ROUND.format(k=k, last=k - 1, nearest=_NEAREST.format(book=f"b{k - 1}")) for k in range(1, 7))
    + f""",
 z AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(m % 16)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM ({_NEAREST.format(book="b6")}) GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b6) AS codebooks_sha256 FROM z
"""
)


# The remainder of each half byte by the reflected polynomial 0xEDB88320 of crc32.
_CRC = [0]
for _k in range(1, 16):
    _c = _k
    for _ in range(4):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _CRC.append(_c)
_CRC32 = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(2 * strlen(s)), lambda i: CAST(instr('0123456789ABCDEF', substring(x, CAST(i + 2 - 2 * (i % 2) AS INTEGER), 1)) - 1 AS BIGINT))), lambda a, b: xor(CAST({_CRC} AS BIGINT[])[1 + (xor(a, b) & 15)], a >> 4)), 4294967295)"
OP13 = rf"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
 g AS (SELECT run, n, s, hex(encode(s)) AS x FROM (SELECT run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s FROM r GROUP BY doc_id, run)),
 h AS (SELECT run, n, {_CRC32} AS h FROM g),
 w AS MATERIALIZED (SELECT * FROM (SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1) WHERE length(word) >= 5 AND n >= 3),
 v AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
 p AS (SELECT a.word, a.n, b.word AS near, b.n AS m FROM v a JOIN v b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT v.word, v.n, w.word, w.n FROM v JOIN w ON v.rest = w.word UNION SELECT w.word, w.n, v.word, v.n FROM v JOIN w ON v.rest = w.word),
 b AS (SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, near) AS form, max(m) AS m FROM p GROUP BY word),
 f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN form END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM w LEFT JOIN b ON b.word = w.word),
 c AS (SELECT word, coalesce(form, word) AS root FROM f UNION SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.*, c.root FROM f JOIN c ON c.word = f.word JOIN f e ON e.word = c.root AND e.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    out = {"op3_substring_dedup": OP3, "op4_jaccard_join": OP4, "op5_decontaminate": OP5, "op11_vector_codes": OP11, "op13_spelling_variants": OP13}
    try:
        import corpus_pipeline
    except ModuleNotFoundError as e:  # it lies beside the package, which may be used without it
        if e.name != "corpus_pipeline":
            raise
        return out
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
