"""Projections and type handling over wide tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitsieve.operators.moments import per_feature
from traitsieve.table import METADATA_COLUMNS, FeatureTable, numeric_columns, quoted

# Bounds a column must lie strictly inside to be narrowed (fixed values).
INTEGER_BOUNDS = (
    ("tinyint", -(2**7), 2**7 - 1),
    ("smallint", -(2**15), 2**15 - 1),
    ("int", -(2**31), 2**31 - 1),
)
HALF_FLOAT_BOUND = 65504.0


def separate_features(df: DataFrame, target: str) -> tuple[list[str], DataFrame]:
    """Numeric columns except the target, and the table cut down to both."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is not in the table")
    features = numeric_columns(df, {target})
    if not features:
        raise ValueError("the table has no numeric feature column")
    return features, df.select(*[quoted(c) for c in features], quoted(target))


def drop_metadata(
    df: DataFrame, target: str, metadata: tuple[str, ...] = METADATA_COLUMNS
) -> tuple[DataFrame, list[str]]:
    """Drop metadata and non-numeric columns; also return the latter's names."""
    rest = [c for c in df.columns if c not in set(metadata) | {target}]
    numeric = set(numeric_columns(df))
    kept = [c for c in rest if c in numeric]
    reported = [c for c in rest if c not in numeric]
    return df.select(*[quoted(c) for c in kept], quoted(target)), reported


def align_features(train: FeatureTable, test: FeatureTable) -> tuple[FeatureTable, FeatureTable]:
    """Both tables on their common features, in the training order."""
    known = set(test.names)
    common = [n for n in train.names if n in known]
    if not common:
        raise ValueError("train and test have no numeric feature in common")
    return train.select_names(common), test.select_names(common)


def column_ranges(df: DataFrame) -> DataFrame:
    """One row per numeric column: ``column, data_type, low_int, high_int, low, high``.

    Integers and floating columns keep their own arrays, so long keys stay exact.
    """

    def part(kind: type, as_type: str) -> DataFrame | None:
        fields = [f for f in df.schema.fields if isinstance(f.dataType, kind)]
        if not fields:
            return None
        table = FeatureTable(
            df.select(
                F.lit(0).alias("row_id"),
                F.lit(0).alias("label"),
                F.array(*[quoted(f.name).cast(as_type) for f in fields]).alias("values"),
            ),
            tuple(f.name for f in fields),
        )
        whole = as_type == "bigint"
        low, high, none = F.col("lo"), F.col("hi"), F.lit(None)
        types = F.lit([f.dataType.simpleString() for f in fields])
        return per_feature(table, {"lo": F.min, "hi": F.max}).select(
            table.name_of().alias("column"),
            F.get(types, F.col("feature_idx")).alias("data_type"),
            (low if whole else none).cast("bigint").alias("low_int"),
            (high if whole else none).cast("bigint").alias("high_int"),
            (none if whole else low).cast("double").alias("low"),
            (none if whole else high).cast("double").alias("high"),
        )

    parts = [part(T.IntegralType, "bigint"), part(T.FractionalType, "double")]
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])


def narrow_plan(df: DataFrame) -> DataFrame:
    """``column, data_type, new_type``: the smallest type each column fits strictly."""
    whole = F.lit(None).cast("string")
    for name, low, high in reversed(INTEGER_BOUNDS):
        fits = (F.col("low_int") > low) & (F.col("high_int") < high)
        whole = F.when(fits, F.lit(name)).otherwise(whole)
    real = F.when(
        (F.col("low") > -HALF_FLOAT_BOUND) & (F.col("high") < HALF_FLOAT_BOUND), "float"
    )
    is_whole = F.col("data_type").isin("tinyint", "smallint", "int", "bigint")
    chosen = F.coalesce(F.when(is_whole, whole).when(F.col("data_type") == "double", real), "data_type")
    return column_ranges(df).select("column", "data_type", chosen.alias("new_type"))


def narrow_types(df: DataFrame) -> DataFrame:
    """Cast every column to its narrowed type; booleans and strings stay as they are."""
    # The plan has one row per numeric column, never one per sample.
    new_types = {r["column"]: r["new_type"] for r in narrow_plan(df).collect()}
    return df.select(
        *[
            quoted(c).cast(new_types[c]).alias(c) if c in new_types else quoted(c)
            for c in df.columns
        ]
    )


def two_features(table: FeatureTable, first: str, second: str) -> DataFrame:
    """Label with two chosen features, the figures of a class-separation plot."""
    pair = table.select_names([first, second])
    return pair.df.select(
        "row_id", "label", F.get("values", F.lit(0)).alias("x"), F.get("values", F.lit(1)).alias("y")
    )
