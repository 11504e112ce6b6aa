"""The driver's tables as labelled feature tables (see FIXTURES.md, part C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitsieve.operators.split import with_fold
from traitsieve.table import FeatureTable

EMBEDDING_WIDTH = 64
DOC_FEATURES = (
    "n_chars",
    "n_words",
    "n_lines",
    "digit_share",
    "non_letter_share",
    "upper_share",
    "mean_word_length",
)
LINE_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def emb(spark: SparkSession, folder: str) -> FeatureTable:
    """Embeddings: 64 features, 10 classes."""
    return FeatureTable.from_array(
        read(spark, folder, "embeddings"), "vec_id", "label", "embedding", EMBEDDING_WIDTH
    )


def emb_bin(spark: SparkSession, folder: str) -> FeatureTable:
    """Embeddings with a planted binary label: f0 + f1 > 0."""
    table = emb(spark, folder)
    planted = (F.get("values", F.lit(0)) + F.get("values", F.lit(1)) > 0).cast("int")
    return table.with_df(table.df.withColumn("label", planted))


def miss(spark: SparkSession, folder: str, every: int = 17) -> FeatureTable:
    """Embeddings with one cell in ``every`` nulled, on a diagonal pattern."""
    table = emb(spark, folder)
    holed = F.transform(
        "values", lambda v, j: F.when(F.col("row_id") % every != j % every, v)
    )
    return table.with_values(holed)


def miss_some(spark: SparkSession, folder: str) -> FeatureTable:
    """As ``miss``, but only every third row has holes."""
    table = miss(spark, folder)
    whole = emb(spark, folder).df.select("row_id", F.col("values").alias("_whole"))
    rows = table.df.join(whole, "row_id")
    values = F.when(F.col("row_id") % 3 == 0, F.col("values")).otherwise(F.col("_whole"))
    return table.with_df(rows.withColumn("values", values).drop("_whole"))


def flawed(spark: SparkSession, folder: str) -> FeatureTable:
    """Embeddings plus a constant and a low-variance feature derived from f0."""
    table = emb(spark, folder)
    f0 = F.get("values", F.lit(0))
    more = F.concat("values", F.array(f0 * 0.0, f0 * 0.01))
    return FeatureTable(table.df.withColumn("values", more), (*table.names, "f0_zero", "f0_small"))


def doc_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a quality label and seven figures of their whole text."""
    def left_of(kept: str):
        """Number of characters of a class: what is left when all runs of others go."""
        return F.length(F.regexp_replace("text", f"[^{kept}]+", "")).cast("double")

    letters, digits, upper, spaces = (left_of(c) for c in ("A-Za-z", "0-9", "A-Z", r" \n"))
    size = F.greatest(F.length("text"), F.lit(1)).cast("double")
    words = spaces + 1.0
    figures = read(spark, folder, "documents").select(
        "doc_id",
        "lang",
        "source",
        F.col("n_chars").cast("double").alias("n_chars"),
        words.alias("n_words"),
        (left_of(r"\n") + 1).alias("n_lines"),
        (digits / size).alias("digit_share"),
        (1.0 - letters / size).alias("non_letter_share"),
        (upper / size).alias("upper_share"),
        ((size - spaces) / words).alias("mean_word_length"),
    )
    labels = read(spark, folder, "labels").select("doc_id", "quality")
    return figures.join(labels, "doc_id")


def doc(spark: SparkSession, folder: str) -> FeatureTable:
    return FeatureTable.from_wide(
        doc_wide(spark, folder), "doc_id", "quality", extra=("lang", "source")
    )


def line(spark: SparkSession, folder: str, label: str = "l_returnflag") -> FeatureTable:
    """Line items: four numeric features and a flag as label, keyed by content."""
    parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in parts],
                            F.col("l_extendedprice").cast("decimal(18,2)").cast("string")))
    rows = read(spark, folder, "lineitem").select(key.alias("row_id"), label, *LINE_FEATURES)
    return FeatureTable.from_wide(rows, "row_id", label)


def cust(spark: SparkSession, folder: str) -> DataFrame:
    """Customers: ``row_id, label`` (segment), ``Dataset`` (region), balance."""
    nation = read(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    region = read(spark, folder, "region").select("r_regionkey", F.col("r_name").alias("Dataset"))
    return (
        read(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("row_id"), F.col("c_mktsegment").alias("label"), "Dataset", "c_acctbal")
    )


def split_source(spark: SparkSession, folder: str, named: bool = True) -> DataFrame:
    """Documents with a split column: names mapped from the source, or the source."""
    documents = read(spark, folder, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("lang").alias("label"), "n_chars", "source"
    )
    category = (
        F.when(F.col("source").isin("src0", "src1", "src2", "src3"), "Training")
        .when(F.col("source").isin("src4", "src5"), "TEST")
        .otherwise("holdout")
    )
    return documents.withColumn("Category", category if named else F.col("source")).drop("source")


def pred(spark: SparkSession, folder: str, folds: int | None = None) -> DataFrame:
    """Two fixed rules as predictors of document quality, one row per model and row."""
    rows = doc_wide(spark, folder).withColumnsRenamed({"doc_id": "row_id", "quality": "label"})
    if folds:
        rows = with_fold(rows, folds)
    letters = 1.0 - F.col("non_letter_share")
    calm = 1.0 - F.col("digit_share") - F.col("upper_share")

    def rule(name: str, score, cut: float):
        return F.struct(
            F.lit(name).alias("model"),
            (score >= cut).cast("int").alias("prediction"),
            score.alias("score"),
        )

    rules = F.array(rule("letters", letters, 0.75), rule("calm", calm, 0.95))
    kept = ["row_id", "label", *(["fold"] if folds else [])]
    return rows.select(*kept, F.explode(rules).alias("r")).select(
        "r.model", *kept, "r.prediction", "r.score"
    )


def by_class(spark: SparkSession, folder: str) -> DataFrame:
    """A three-class prediction table: line-item flags guessed from price and discount."""
    rows = line(spark, folder).df
    price, discount = F.get("values", F.lit(1)), F.get("values", F.lit(2))
    guess = F.when(discount > 0.05, "A").when(price > 30000, "N").otherwise("R")
    return rows.select(
        F.lit("rule").alias("model"), "row_id", "label", guess.alias("prediction"), price.alias("score")
    )
