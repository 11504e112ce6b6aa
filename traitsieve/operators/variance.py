"""Variance filtering: thresholds, top-N, summaries and plot figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitsieve.operators.moments import feature_moments
from traitsieve.table import FeatureTable

VARIANCE_THRESHOLD = 0.01
TOP_VARIANCE_FEATURES = 1000
HISTOGRAM_BINS = 50
LOG_OFFSET = 1e-10


def feature_variance(table: FeatureTable, complete: bool = False) -> DataFrame:
    """``feature_idx, feature, variance`` (sample variance, missing cells skipped)."""
    return feature_moments(table, complete=complete).select(
        "feature_idx", table.name_of().alias("feature"), "variance"
    )


def above_threshold(variances: DataFrame, threshold: float = VARIANCE_THRESHOLD) -> DataFrame:
    """Features whose variance reaches the threshold."""
    return variances.filter(F.col("variance") >= threshold)


def top_by_variance(variances: DataFrame, n: int = TOP_VARIANCE_FEATURES) -> DataFrame:
    """The ``n`` features of largest variance, ranked; ties go to the earlier column."""
    order = [F.desc_nulls_last("variance"), F.asc("feature_idx")]
    # One row per feature reaches this window, never one per sample.
    return (
        variances.filter(F.col("variance").isNotNull())
        .orderBy(*order)
        .limit(n)
        .withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    )


def variance_summary(variances: DataFrame, threshold: float = VARIANCE_THRESHOLD) -> DataFrame:
    v = F.col("variance")
    return variances.agg(
        F.count(F.lit(1)).alias("total_features"),
        F.avg(v).alias("mean_variance"),
        F.median(v).alias("median_variance"),
        F.min(v).alias("min_variance"),
        F.max(v).alias("max_variance"),
        F.count_if(v < threshold).alias("features_below_threshold"),
        F.count_if(v == 0).alias("zero_variance_features"),
        F.count_if(v < VARIANCE_THRESHOLD).alias("low_variance_features"),
    )


def problem_features(
    variances: DataFrame, threshold: float = VARIANCE_THRESHOLD, high: float = 0.99
) -> DataFrame:
    """``feature_idx, feature, problem``: zero, low or very high variance."""
    v = F.col("variance")
    limit = variances.agg(F.percentile("variance", high).alias("limit")).scalar()
    problems = F.array_compact(
        F.array(
            F.when(v == 0, "zero_variance"),
            F.when((v > 0) & (v < threshold), "low_variance"),
            F.when(v > limit, "very_high_variance"),
        )
    )
    return variances.select("feature_idx", "feature", F.explode(problems).alias("problem"))


def variance_histogram(variances: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins from smallest to largest variance; the last bin is closed."""
    span = variances.agg(
        F.struct(F.min("variance").alias("lo"), F.max("variance").alias("hi")).alias("span")
    ).scalar()
    placed = variances.filter(F.col("variance").isNotNull()).withColumn("span", span)
    lo, hi = F.col("span.lo"), F.col("span.hi")
    step = (F.col("variance") - lo) * bins / (hi - lo)
    bin_ = F.when(hi == lo, 1).otherwise(F.least(F.floor(step) + 1, F.lit(bins)))
    return (
        placed.withColumn("bin", bin_.cast("int"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n_features"))
    )


def log_variance_box(variances: DataFrame) -> DataFrame:
    """Box-plot figures of ``log10(variance + 1e-10)``."""
    logs = variances.select(F.log10(F.col("variance") + LOG_OFFSET).alias("v"))
    five = F.percentile("v", [0.0, 0.25, 0.5, 0.75, 1.0])
    names = ["minimum", "q1", "median", "q3", "maximum"]
    return logs.agg(five.alias("q")).select(
        *[F.col("q")[i].alias(n) for i, n in enumerate(names)]
    )
