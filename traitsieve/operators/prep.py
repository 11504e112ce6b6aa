"""Imputation, scaling and label encoding.

Fitted figures (one number per feature, one code per class) reach the rows as
scalar subqueries: fit and transform are one lazy plan and no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitsieve.functions.blocks import block_moments, quantiles
from traitsieve.functions.columns import classes_of
from traitsieve.functions.session import broadcast_if_small
from traitsieve.operators.moments import NARROW_WIDTH, feature_moments, per_feature
from traitsieve.table import FeatureTable

# Class names that fix which of two labels is the positive one (fixed values).
POSITIVE_OF_PAIR = "IR"
NEGATIVE_OF_PAIR = "IS"
SCORE_EPSILON = 1e-8


def per_feature_array(stats: DataFrame, value: Column, width: int) -> Column:
    """Scalar subquery: array over all features of ``value`` (null where absent)."""
    known = stats.select(F.col("feature_idx"), value.alias("v"))
    every = stats.sparkSession.range(width).select(F.col("id").cast("int").alias("feature_idx"))
    entries = F.array_sort(F.collect_list(F.struct("feature_idx", "v")))
    return (
        every.join(broadcast_if_small(known, width), "feature_idx", "left")
        .agg(F.transform(entries, lambda e: e["v"]).alias("a"))
        .scalar()
    )


def _with_fitted(
    table: FeatureTable, fitted: Column, change: Callable[[Column, Column], Column]
) -> FeatureTable:
    """Change every value with the figure fitted for its feature."""
    rows = table.df.withColumn("_fitted", fitted)
    return table.with_df(
        rows.withColumn("values", F.zip_with("values", "_fitted", change)).drop("_fitted")
    )


def feature_medians(table: FeatureTable) -> DataFrame:
    """``feature_idx, quantile``: exact medians by radix selection over blocks of features."""
    found = quantiles(table.df, table.width, 0.5)
    rows = [(i, float(v)) for i, v in enumerate(found) if v == v]
    return table.df.sparkSession.createDataFrame(rows, "feature_idx int, quantile double")


def impute(table: FeatureTable, strategy: str = "mean", fit_on: FeatureTable | None = None) -> FeatureTable:
    """Fill missing cells: ``mean``, ``median`` (exact), ``zero``, or ``drop`` the row.

    Statistics come from ``fit_on`` (the training part), by default the table itself.
    """
    if strategy == "drop":
        return table.filter(~F.exists("values", lambda v: v.isNull()))
    if strategy == "zero":
        return table.with_values(F.transform("values", lambda v: F.coalesce(v, F.lit(0.0))))
    source = table if fit_on is None else fit_on
    if strategy == "mean":
        fill = per_feature_array(feature_moments(source), F.col("mean"), table.width)
    elif strategy == "median":
        fill = per_feature_array(feature_medians(source), F.col("quantile"), table.width)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return _with_fitted(table, fill, lambda v, s: F.coalesce(v, s))


def standardise(
    table: FeatureTable, fit_on: FeatureTable | None = None, complete: bool = False
) -> FeatureTable:
    """Centre and divide by the population deviation; constant features become 0."""
    source = table if fit_on is None else fit_on
    moments = feature_moments(source, complete=complete)
    n = F.col("n")
    spread = F.sqrt(F.coalesce(F.col("variance"), F.lit(0.0)) * (n - 1) / n)
    fitted = per_feature_array(
        moments,
        F.struct(
            F.col("mean").alias("mean"),
            F.when(spread == 0, F.lit(1.0)).otherwise(spread).alias("spread"),
        ),
        table.width,
    )
    return _with_fitted(table, fitted, lambda v, s: (v - s["mean"]) / s["spread"])


def encode_labels(df: DataFrame, fit_on: DataFrame | None = None, label: str = "label") -> DataFrame:
    """Add ``code``: position of the label among the sorted labels of ``fit_on``.

    A label that the training rows do not hold fails the query.
    """
    classes = classes_of(df if fit_on is None else fit_on, label)
    position = F.array_position(classes, F.col(label))
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.col(label).cast("string")))
    return df.withColumn(
        "code", F.when(position > 0, (position - 1).cast("int")).otherwise(unknown.cast("int"))
    )


def decode_labels(df: DataFrame, fit_on: DataFrame, code: str, label: str = "label") -> DataFrame:
    """Add ``<code>_label``: the label of a numeric code or prediction."""
    decoded = F.get(classes_of(fit_on, label), F.col(code).cast("int"))
    return df.withColumn(f"{code}_label", decoded)


def positive_label(df: DataFrame, label: str = "label") -> Column:
    """Scalar subquery: the positive one of two labels.

    The named pair decides when both occur, else the second label in sort order.
    """
    classes = F.col("classes")
    pair = F.array_contains(classes, POSITIVE_OF_PAIR) & F.array_contains(classes, NEGATIVE_OF_PAIR)
    return (
        df.agg(F.array_sort(F.collect_set(F.col(label).cast("string"))).alias("classes"))
        .select(F.when(pair, F.lit(POSITIVE_OF_PAIR)).otherwise(F.get(classes, F.lit(1))).alias("p"))
        .scalar()
    )


def with_binary_target(
    df: DataFrame, label: str = "label", positive: str | None = None
) -> DataFrame:
    """Add ``target``: 1 for the positive label, 0 for the other."""
    chosen = positive_label(df, label) if positive is None else F.lit(positive)
    return df.withColumn("target", (F.col(label).cast("string") == chosen).cast("int"))


def min_max_scores(df: DataFrame, score: str = "score", by: str | None = None) -> DataFrame:
    """Scale a score column to 0..1 by its own range, or by its range within each ``by``."""
    if by is not None:
        ranges = df.groupBy(by).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
        scaled = (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(SCORE_EPSILON))
        return df.join(ranges, by).withColumn(score, scaled).drop("_lo", "_hi")
    span = df.agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi")).alias("s")).scalar()
    lo, hi = F.col("_span.lo"), F.col("_span.hi")
    scaled = (F.col(score) - lo) / (hi - lo + F.lit(SCORE_EPSILON))
    return df.withColumn("_span", span).withColumn(score, scaled).drop("_span")


def with_class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight`` = rows / (classes * rows of the class)."""
    per_class = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    weights = per_class.agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("k"),
        F.map_from_entries(F.collect_list(F.struct(label, "n"))).alias("sizes"),
    ).select(
        F.transform_values("sizes", lambda _, n: F.col("total") / (F.col("k") * n)).alias("w")
    )
    return df.withColumn("weight", F.try_element_at(weights.scalar(), F.col(label)))


def preprocess(
    train: FeatureTable,
    test: FeatureTable | None = None,
    missing: str = "mean",
    scale: bool = True,
    encode: bool = True,
) -> tuple[FeatureTable, FeatureTable | None]:
    """Impute, standardise and encode; every figure is fitted on the training part.

    Unlike a per-table imputation, the test part never sees its own statistics.
    """
    parts = [train] if test is None else [train, test]
    if missing == "drop":
        parts = [impute(p, "drop") for p in parts]
        done = [standardise(p, fit_on=parts[0]) for p in parts] if scale else parts
    elif scale:
        fitted = _fill_and_scale(train, missing)
        done = [
            _with_fitted(p, fitted, lambda v, s: (F.coalesce(v, s["fill"]) - s["mean"]) / s["spread"])
            for p in parts
        ]
    else:
        done = [impute(p, missing, fit_on=train) for p in parts]
    if encode:
        done = [
            p.with_df(
                encode_labels(p.df, fit_on=train.df).withColumn("label", F.col("code")).drop("code")
            )
            for p in done
        ]
    return done[0], done[1] if test is not None else None


def fitted_figures(train: FeatureTable, missing: str = "mean") -> list:
    """Fill value, mean and deviation of every feature, on the driver (three numbers each)."""
    row = train.df.sparkSession.range(1).select(_fill_and_scale(train, missing).alias("s")).first()
    return [s if s is not None else {"fill": 0.0, "mean": 0.0, "spread": 1.0} for s in row["s"]]


def _fill_and_scale(train: FeatureTable, missing: str) -> Column:
    """Per feature the fill value and the mean and deviation after filling.

    Filling m of n + m cells moves mean and squares by a known amount, so the raw
    moments give the figures of the filled column without a second pass.
    """
    if train.width > NARROW_WIDTH:
        stats = block_moments(train.df, train.width).withColumnRenamed("rows", "all")
    else:
        stats = per_feature(
            train,
            {"n": F.count, "all": lambda v: F.count(F.lit(1)), "mean": F.avg, "variance": F.var_samp},
        )
    if missing == "median":
        stats = stats.join(feature_medians(train).withColumnRenamed("quantile", "fill"), "feature_idx", "left")
    elif missing == "mean":
        stats = stats.withColumn("fill", F.col("mean"))
    elif missing == "zero":
        stats = stats.withColumn("fill", F.lit(0.0))
    else:
        raise ValueError(f"unknown strategy {missing!r}")
    n, total, mean, fill = (F.col(c) for c in ("n", "all", "mean", "fill"))
    known = F.coalesce(mean, F.lit(0.0))
    centre = (n * known + (total - n) * fill) / total
    squares = (
        F.coalesce(F.col("variance") * (n - 1), F.lit(0.0))
        + n * (known - centre) * (known - centre)
        + (total - n) * (fill - centre) * (fill - centre)
    )
    spread = F.sqrt(squares / total)
    return per_feature_array(
        stats,
        F.struct(
            fill.alias("fill"),
            centre.alias("mean"),
            F.when(spread == 0, F.lit(1.0)).otherwise(spread).alias("spread"),
        ),
        train.width,
    )
