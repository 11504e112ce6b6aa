"""Writers for result tables, ML-ready data and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traitsieve.table import FeatureTable

FORMATS = ("parquet", "csv", "json")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write a result table and return its path."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported output format: {fmt!r}")
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def write_ml_ready(
    train: FeatureTable,
    test: FeatureTable,
    features: Sequence[str],
    folder: str,
    target: str = "label",
    fmt: str = "parquet",
    name: str = "ml_ready",
) -> tuple[str, str]:
    """Selected features and target of both parts, one folder each."""
    paths = []
    for part, table in (("train", train), ("test", test)):
        ready = table.select_names(features).wide(target)
        paths.append(write_table(ready, f"{folder}/{name}_{part}.{fmt}", fmt))
    return paths[0], paths[1]


def write_selection(selection: DataFrame, folder: str, best_method: str, fmt: str = "parquet") -> dict:
    """All lists, the best method's list and the combined list."""
    from traitsieve.operators.compare import combined_features

    return {
        "all_methods": write_table(selection, f"{folder}/all_methods.{fmt}", fmt),
        "best_method": write_table(
            selection.filter(F.col("method") == best_method), f"{folder}/best_method.{fmt}", fmt
        ),
        "combined": write_table(combined_features(selection), f"{folder}/combined.{fmt}", fmt),
    }


def summary_row(spark: SparkSession, **parts: Column | str | float | int) -> DataFrame:
    """One nested row; columns may be scalar subqueries or structs of them."""
    columns = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in parts.items()]
    return spark.range(1).select(*columns)


def write_summary(summary: DataFrame, path: str) -> str:
    return write_table(summary, path, "json")


def read_summary(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return spark.read.json(path) if schema is None else spark.read.schema(schema).json(path)
