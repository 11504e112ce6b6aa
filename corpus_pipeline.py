"""A corpus pipeline of five stages, each handing Parquet to the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitsieve.functions.session import scratch_path
from traitsieve.llm import mixing, ngram_join, packing, quality, substring_dedup
from traitsieve.llm.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels``, does not reject."""
    docs = docs.select(*COLUMNS)
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("score") >= quality.THRESHOLD).drop("score")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    docs = docs.select(*COLUMNS)
    found = ngram_join.jaccard_components(docs)
    later = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti")


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the word windows that stand in a smaller doc_id; others stay as they are."""
    cut = substring_dedup.cut_texts(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the schedule that holds sources to their weights."""
    return mixing.mixed_order(docs.select(*COLUMNS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their bins, packed range by range of the mixing schedule.

    Row order does not survive a table, so the slots are taken again from the same rows.
    """
    return packing.pack(mixing.mix(docs.select(*COLUMNS)), slot="mix_slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup_stage),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: The fitted classifier and the packing have no SQL equal; a test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to what its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
