"""Set operations over the feature lists of several selection methods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitsieve.functions.columns import ratio


def combined_features(selection: DataFrame) -> DataFrame:
    """Distinct union of all lists, sorted by name and ranked."""
    return (
        selection.select("feature")
        .distinct()
        .withColumn("rank", F.row_number().over(Window.orderBy("feature")))
    )


def pairwise_overlap(selection: DataFrame) -> DataFrame:
    """``method_a, method_b, n_common, jaccard`` for every pair of methods.

    The lists are read once: a feature votes for each pair of the few methods that
    chose it, and a method paired with itself gives its own size.
    """
    chosen = selection.groupBy("feature").agg(F.collect_set("method").alias("ms"))
    common = (
        chosen.select(F.explode("ms").alias("a"), "ms")
        .select("a", F.explode("ms").alias("b"))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # One row per pair of methods; disjoint pairs are filled in from the sizes.
    own = F.when(F.col("a") == F.col("b"), F.struct(F.col("a").alias("method"), "n"))
    tally = common.agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("a", "b"), "n"))).alias("counts"),
        F.collect_list(own).alias("sizes"),
    )
    pairs = tally.select("counts", "sizes", F.explode("sizes").alias("x")).select(
        "counts", "x", F.explode("sizes").alias("y")
    )
    key = F.struct(F.col("x.method").alias("a"), F.col("y.method").alias("b"))
    shared = F.coalesce(F.try_element_at("counts", key), F.lit(0))
    union = F.col("x.n") + F.col("y.n") - F.col("n_common")
    return pairs.select("x", "y", shared.alias("n_common")).select(
        F.col("x.method").alias("method_a"),
        F.col("y.method").alias("method_b"),
        "n_common",
        ratio(F.col("n_common"), union).alias("jaccard"),
    )


def feature_method_map(selection: DataFrame, scores: DataFrame) -> DataFrame:
    """Each listed feature with its rank in the method and the method's CV score."""
    return selection.select("feature", "method", "rank").join(
        scores.select("method", F.col("auc").alias("method_score")), "method", "left"
    )


def method_scoreboard(
    selection: DataFrame, scores: DataFrame, order: Sequence[str]
) -> DataFrame:
    """Per method: list size, CV AUC and accuracy, rank and the best flag.

    A method without features scores 0; equal AUCs go to the earlier method.
    """
    sizes = selection.groupBy("method").agg(F.count(F.lit(1)).alias("n_features"))
    place = F.array_position(F.lit(list(order)), F.col("method"))
    zero = F.lit(0.0)
    w = Window.orderBy(F.desc("auc"), F.col("place"))
    return (
        sizes.join(scores, "method", "left")
        .select(
            "method",
            "n_features",
            F.coalesce("auc", zero).alias("auc"),
            F.coalesce("accuracy", zero).alias("accuracy"),
            place.alias("place"),
        )
        .withColumn("rank", F.row_number().over(w))
        .withColumn("is_best", F.col("rank") == 1)
        .drop("place")
    )


def concat_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both tables; a column absent from one is null there."""
    return first.unionByName(second, allowMissingColumns=True)


def concat_columns(features: DataFrame, target: DataFrame) -> DataFrame:
    """Features and target side by side, matched by the row key."""
    return features.join(target, "row_id")
