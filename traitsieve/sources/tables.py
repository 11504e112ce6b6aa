"""Readers for labelled tables: CSV or Parquet, one file set or a train/test pair."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitsieve.operators.compare import concat_rows
from traitsieve.operators.profile import check_pair, validate
from traitsieve.operators.shape import align_features
from traitsieve.operators.split import train_test
from traitsieve.table import METADATA_COLUMNS, FeatureTable, numeric_columns, quoted

# Spellings of a missing cell in text files (fixed values).
MISSING_SPELLINGS = ("", "NA", "N/A", "NaN", "null")
MAX_CSV_COLUMNS = 200_000


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """Read a table by its suffix.  A missing path or another suffix is an error.

    Give ``schema`` for large CSV input: inferring types reads the data once more.
    """
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix != ".csv":
        raise ValueError(f"unsupported file format: {suffix or path!r}")
    reader = spark.read.option("header", True).option("maxColumns", MAX_CSV_COLUMNS)
    if schema is not None:
        return reader.option("nullValue", "NA").option("nanValue", "NaN").schema(schema).csv(path)
    raw = reader.option("nullValue", "NA").option("nanValue", "NaN").option("inferSchema", True).csv(path)
    return _numbers_from_text(raw)


def _numbers_from_text(raw: DataFrame) -> DataFrame:
    """Columns left as text only because of other missing spellings become numbers."""
    texts = [f.name for f in raw.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return raw
    present = {c: F.when(~F.trim(quoted(c)).isin(*MISSING_SPELLINGS), F.trim(quoted(c))) for c in texts}
    flags = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                (v.isNotNull() & v.try_cast("double").isNull()).alias("is_text"),
                v.isNotNull().alias("is_present"),
            )
            for c, v in present.items()
        ]
    )
    # One row per text column comes back.
    found = (
        raw.select(F.explode(flags).alias("f"))
        .groupBy("f.column")
        .agg(F.max("f.is_text").alias("is_text"), F.max("f.is_present").alias("is_present"))
        .filter(~F.col("is_text") & F.col("is_present"))
    )
    numeric = {r["column"] for r in found.collect()}
    return raw.select(
        *[
            present[c].cast("double").alias(c) if c in numeric
            else present[c].alias(c) if c in present
            else quoted(c)
            for c in raw.columns
        ]
    )


def load_table(
    spark: SparkSession,
    path: str,
    target: str,
    row_id: str | None = None,
    exclude: tuple[str, ...] = METADATA_COLUMNS,
    extra: tuple[str, ...] = (),
    schema: T.StructType | str | None = None,
) -> FeatureTable:
    """Labelled table; the first column is the row key unless ``row_id`` names one.

    With ``schema`` a CSV file is read once, when it is used.
    """
    raw = read_table(spark, path, schema)
    key = raw.columns[0] if row_id is None else row_id
    return FeatureTable.from_wide(raw, key, target, exclude, extra)


def load_pair(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    target: str,
    row_id: str,
    use_predefined_split: bool = True,
    schema: T.StructType | str | None = None,
    check: bool = True,
    **split_options,
) -> tuple[FeatureTable, FeatureTable]:
    """Train and test table on their common features, or both pooled and split anew.

    ``check`` runs the gates: either table may fail its own, and the pair is compared.
    """
    train = load_table(spark, train_path, target, row_id, exclude=(), schema=schema)
    test = load_table(spark, test_path, target, row_id, exclude=(), schema=schema)
    if check:
        for part in (train, test):
            validate(part)
        check_pair(train, test)
    train, test = align_features(train, test)
    if use_predefined_split:
        return train, test
    return train_test(train.with_df(concat_rows(train.df, test.df)), **split_options)


def describe_columns(df: DataFrame, target: str) -> dict[str, list[str]]:
    """Names of the numeric features and of the columns that cannot be features."""
    features = numeric_columns(df, {target})
    return {
        "features": features,
        "other": [c for c in df.columns if c != target and c not in set(features)],
    }
