"""A training-data pipeline over documents, in stages that each read what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.llm.common import documents, materialize
from bidlens.llm.decontamination import drop_leaky
from bidlens.llm.line_dedup import drop_boilerplate, near_pages
from bidlens.llm.ngram_join import keep_one_of_each
from bidlens.llm.packing import pack
from bidlens.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold.

    Null and empty texts have no toxic passage and stay.  Rows that repeat an id are scored each by its own text.  An empty
    table, or labels of one class only, keeps every row.
    """
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = docs.select(F.struct(*COLUMNS).alias("row"), "text")
    return score_toxicity(kept, model, keep="row").where(F.col("score") < THRESHOLD).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; near copies of a text count as one page.

    Every row stays; a text may become empty.  n_chars is counted anew where lines go.  A null source is a source of its own,
    null texts stay null; rows that repeat an id are cut each in its own text.
    """
    cut = drop_boilerplate(docs.select(*COLUMNS), host_col="source", text_col="text", page_class=near_pages(docs))
    return cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies.

    Null ids, and null or wordless texts, link with nothing and stay; rows that repeat an id are judged each by its own text.
    """
    return keep_one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Null ids, null and empty texts stay; rows that repeat an id go together.  An empty benchmark keeps every row.
    """
    return drop_leaky(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token sequences packed into sequences of 2048 tokens.

    Null and empty texts are a lone separator; repeated rows and ids are packed like any other; no row gives no row.
    """
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: Trained scores, embeddings and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
