"""Validation gates and data-quality reports."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitsieve.operators.moments import per_feature
from traitsieve.operators.variance import VARIANCE_THRESHOLD
from traitsieve.table import FeatureTable, missing_to_null, numeric_columns, quoted

MISSING_LIMIT = 0.1
MIN_SAMPLES = 10
MAX_CLASSES = 10
MIN_CLASS_SIZE = 5
MAX_IMBALANCE = 10
MIN_COMMON_SHARE = 0.8


def missing_by_column(df: DataFrame) -> DataFrame:
    """``column, n_missing, missing_fraction`` for every column, target included."""
    numeric = set(numeric_columns(df))
    absent = [
        (missing_to_null(quoted(c)) if c in numeric else quoted(c)).isNull().cast("double")
        for c in df.columns
    ]
    flags = FeatureTable(
        df.select(F.lit(0).alias("row_id"), F.lit(0).alias("label"), F.array(*absent).alias("values")),
        tuple(df.columns),
    )
    return per_feature(flags, {"n_missing": F.sum, "missing_fraction": F.avg}).select(
        flags.name_of().alias("column"), F.col("n_missing").cast("long").alias("n_missing"), "missing_fraction"
    )


def feature_profile(table: FeatureTable) -> DataFrame:
    """One pass per feature: missing cells, range, variance, constant and low flags."""
    stats = per_feature(
        table,
        {
            "n_missing": lambda v: F.count_if(v.isNull()),
            "missing_fraction": lambda v: F.avg(v.isNull().cast("int")),
            "low": F.min,
            "high": F.max,
            "variance": F.var_samp,
        },
    )
    return stats.select(
        "feature_idx",
        table.name_of().alias("feature"),
        "n_missing",
        "missing_fraction",
        "variance",
        F.coalesce(F.col("low") == F.col("high"), F.lit(True)).alias("is_constant"),
        F.coalesce(F.col("variance") < VARIANCE_THRESHOLD, F.lit(False)).alias("is_low_variance"),
    )


def constant_features(table: FeatureTable) -> DataFrame:
    """Features with at most one distinct value among their present cells."""
    return feature_profile(table).filter("is_constant").select("feature_idx", "feature")


def excessive_missing(table: FeatureTable, limit: float = MISSING_LIMIT) -> DataFrame:
    """Features, label and metadata whose missing fraction is strictly over the limit."""
    others = missing_by_column(table.df.select("label", *[quoted(c) for c in table.extra]))
    features = feature_profile(table).select(
        F.col("feature").alias("column"), "n_missing", "missing_fraction"
    )
    return features.unionByName(others).filter(F.col("missing_fraction") > limit)


def class_distribution(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))


def target_checks(df: DataFrame) -> DataFrame:
    """One row: label counts, the two errors and the three warnings."""
    sizes = class_distribution(df)
    present = F.col("label").isNotNull()
    n = F.when(present, F.col("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count(n).alias("n_classes"),
        F.min(n).alias("smallest"),
        F.max(n).alias("largest"),
    ).select(
        "*",
        (F.col("n_missing") > 0).alias("error_missing"),
        (F.col("n_classes") < 2).alias("error_one_class"),
        (F.col("n_classes") > MAX_CLASSES).alias("warn_many_classes"),
        F.coalesce(F.col("smallest") < MIN_CLASS_SIZE, F.lit(False)).alias("warn_small_class"),
        F.coalesce(F.col("largest") / F.col("smallest") > MAX_IMBALANCE, F.lit(False)).alias(
            "warn_imbalance"
        ),
    )


def gate(table: FeatureTable, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """One row that says whether the table may be used, and what it warns about.

    One pass over the cells and one over the labels.
    """
    over = F.col("missing_fraction") > MISSING_LIMIT
    features = feature_profile(table).agg(
        F.struct(
            F.collect_list(F.when(over, F.col("feature"))).alias("too_missing"),
            F.count_if("is_constant").alias("n_constant"),
        ).alias("f")
    )
    target = target_checks(table.df).withColumn("f", features.scalar())
    too_missing = F.col("f.too_missing")
    if table.extra:
        others = missing_by_column(table.df.select(*[quoted(c) for c in table.extra]))
        listed = others.agg(F.collect_list(F.when(over, F.col("column"))).alias("c"))
        too_missing = F.concat(too_missing, listed.scalar())
    return target.withColumn("too_missing", F.sort_array(too_missing)).select(
        "n_rows",
        F.lit(table.width).alias("n_features"),
        "n_classes",
        F.array_join("too_missing", ",").alias("too_missing"),
        F.col("f.n_constant").alias("n_constant"),
        (F.col("n_rows") >= min_samples).alias("enough_samples"),
        "warn_many_classes",
        "warn_small_class",
        "warn_imbalance",
        (
            (F.col("n_rows") > 0)
            & (F.size("too_missing") == 0)
            & ~F.col("error_missing")
            & ~F.col("error_one_class")
        ).alias("passes"),
    )


def validate(table: FeatureTable, min_samples: int = MIN_SAMPLES) -> dict:
    """Raise ``ValueError`` when the table fails its gate, else return the report."""
    report = gate(table, min_samples).first().asDict()
    if report["n_rows"] == 0:
        raise ValueError("the table is empty")
    if report["too_missing"]:
        raise ValueError(f"over {MISSING_LIMIT:.0%} missing in: {report['too_missing']}")
    if not report["passes"]:
        raise ValueError("the target has missing values or fewer than two classes")
    if not report["enough_samples"]:
        raise ValueError(f"fewer than {min_samples} samples")
    return report


def unknown_classes(train: DataFrame, test: DataFrame) -> DataFrame:
    """Labels of the test table that the training table does not hold."""
    return test.select("label").distinct().join(
        train.select("label").distinct(), "label", "left_anti"
    )


def compatibility(train: FeatureTable, test: FeatureTable) -> DataFrame:
    """One row: common features, whether they are too few, labels only in test."""
    common = len(set(train.names) & set(test.names))
    if common == 0:
        raise ValueError("train and test have no numeric feature in common")
    return unknown_classes(train.df, test.df).agg(
        F.lit(len(train.names)).alias("n_train_features"),
        F.lit(common).alias("n_common"),
        F.lit(common < len(train.names) * MIN_COMMON_SHARE).alias("warn_few_common"),
        F.count(F.lit(1)).alias("n_unknown_classes"),
        F.array_join(F.array_sort(F.collect_list(F.col("label").cast("string"))), ",").alias(
            "unknown_classes"
        ),
    )


def check_pair(train: FeatureTable, test: FeatureTable) -> None:
    """Warn of few common features and of labels that only the test part has."""
    row = compatibility(train, test).first()
    if row["warn_few_common"]:
        warnings.warn(f"only {row['n_common']} of {row['n_train_features']} features are common", stacklevel=2)
    if row["n_unknown_classes"]:
        warnings.warn(f"labels only in the test part: {row['unknown_classes']}", stacklevel=2)


def quality_report(table: FeatureTable, source: DataFrame | None = None) -> DataFrame:
    """Long report ``section, item, value`` from one feature pass and one label pass.

    Section ``type`` names each column of ``source`` (the table as it was read) with its type.
    """

    def line(section: str, item, value):
        return F.struct(
            F.lit(section).alias("section"),
            (F.lit(item) if isinstance(item, str) else item.cast("string")).alias("item"),
            value.cast("double").alias("value"),
        )

    name = F.col("feature")
    constant, low = F.col("is_constant").cast("int"), F.col("is_low_variance").cast("int")
    per_feature = feature_profile(table).select(
        F.explode(
            F.array(
                line("total", "features", F.lit(1)),
                line("total", "missing_cells", F.col("n_missing")),
                line("total", "constant_features", constant),
                line("total", "low_variance_features", low),
                line("missing", name, F.col("n_missing")),
                line("constant", name, constant),
                line("low_variance", name, low),
            )
        ).alias("l")
    )
    per_class = class_distribution(table.df).select(
        F.explode(
            F.array(line("total", "samples", F.col("n")), line("class", F.col("label"), F.col("n")))
        ).alias("l")
    )
    lines = per_feature.unionByName(per_class)
    if source is not None:
        named = [(f"{f.name} {f.dataType.simpleString()}",) for f in source.schema.fields]
        kinds = source.sparkSession.createDataFrame(named, "column string")
        lines = lines.unionByName(kinds.select(line("type", F.col("column"), F.lit(1)).alias("l")))
    return (
        lines.groupBy("l.section", "l.item")
        .agg(F.sum("l.value").alias("value"))
        .filter((F.col("value") > 0) | ~F.col("section").isin("constant", "low_variance"))
    )
