"""A corpus from documents to packed sequences: STAGES in order, each (name, function of spark, docs, sf_dir).

Every stage but the last returns the columns of documents, whatever they are called, with their
values; n_chars follows the text. For all stages: an empty table gives an empty one, repeated rows
are judged alike, a long text is judged as a whole, and extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontaminate as contamination
from corvane.llm.jaccard_join import jaccard_join
from corvane.llm.language_id import language_id
from corvane.llm.line_dedup import checked, line_dedup
from corvane.llm.packing import best_fit_packing
from corvane.llm.queries import tokenizer_path
from corvane.llm.shared import written


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with all columns but doc_id and text under names that no operator uses, and these by column."""
    names = {c: c if c in ("doc_id", "text") else f"_in{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(c).alias(n) for c, n in names.items()]), names


def back(out: DataFrame, names: dict[str, str]) -> DataFrame:
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language stay: one without a letter, or of no language that the rest is in, goes.

    A null or empty text has no letter; null declarations and sources are no evidence; of equally
    likely languages any is one, so a tie stays.
    """
    rows, names = aside(docs)
    return back(language_id(rows, declared=F.col(names["lang"]), host=F.col(names["source"])).where(~F.col("rejected")), names)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, but for their first place; a document of nothing else goes with them.

    A null text and null ids stay as they are; the first of lines in documents of one id is that
    of the least digest.
    """
    rows, names = aside(docs)
    out = line_dedup(rows).where((F.col("n_dropped") == 0) | (F.col("text") != ""))
    if "n_chars" in names:
        n = F.col(names["n_chars"])
        out = out.withColumn(names["n_chars"], F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(n))
    return back(out, names)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by shared five-word shingles (similarity of 0.8 or more), one stays: that with the least id.

    Rows are told apart by all their columns: null ids come last, rows of one id are in the order of
    a digest, and of rows that are equal in all columns one stays. Null, empty and blank texts are
    linked with nothing and stay.
    """
    parts = [*docs.columns, *[F.col(c).isNull() for c in docs.columns]]
    keyed = docs.withColumns({"_a": F.xxhash64(*parts), "_b": F.hash(*parts[::-1])})
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("_a").alias("a"), F.col("_b").alias("b"))
    found = jaccard_join(keyed.select(row.alias("row"), "text"), n=5, percent=80, id_col="row").where("n_shingles > 0")
    first = (F.col("row.a") == F.col("component_id.a")) & (F.col("row.b") == F.col("component_id.b"))
    # a key is either first in its component, once or more, or it goes
    found = found.groupBy(F.col("row.a").alias("_a"), F.col("row.b").alias("_b")).agg(F.min(first).alias("first"), F.count("*").alias("n"))
    gone = written(found.where("not first or n > 1").select("_a", "_b", "first"), "copies")
    rest = keyed.join(checked(gone), ["_a", "_b"], "left_anti").select(*docs.columns)
    again = gone.where("first").select("_a", "_b")
    if again.isEmpty():
        return rest
    return rest.unionByName(keyed.join(checked(again), ["_a", "_b"], "left_semi").select(*docs.columns).distinct())


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words lies in benchmark passages go; null and empty texts stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, names = aside(docs)
    found = contamination.decontaminate(rows, benchmark, keep=tuple(rows.columns))
    return back(contamination.remove_hits(found), names)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed; null and empty texts are an end id each."""
    return best_fit_packing(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near), ("benchmark decontamination", contaminated), ("best-fit packing", packing)]

#: SQL has no form for the fitted language model and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
