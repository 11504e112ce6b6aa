"""The labelled feature table every operator takes and returns.

A table of thousands of numeric columns is kept as one ``array<double>`` column,
so the plan stays small however wide the data is, and missing cells are nulls
inside the array.  ``long()`` and ``vectors()`` give the two other shapes.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns that describe a sample and are never features (fixed values of the data
# format; ``_c0`` is the name Spark gives to a blank CSV header).
METADATA_COLUMNS = (
    "Category",
    "Dataset",
    "Patient_ID",
    "X",
    "Unnamed: 0",
    "index",
    "_c0",
)


def quoted(name: str) -> Column:
    """Column by its literal name, whatever dots or backticks it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def missing_to_null(value: Column) -> Column:
    """NaN is a missing cell; Spark aggregates skip only nulls."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


@dataclass(frozen=True)
class FeatureTable:
    """``df`` holds ``row_id, label, values`` and the columns named in ``extra``.

    A table just read from plain columns knows them as ``wide`` (``row_id, label``, extra and
    one column per feature, ``_0, _1, ...``), so that a choice of features reads only those.
    """

    df: DataFrame
    names: tuple[str, ...]
    extra: tuple[str, ...] = ()
    wide_df: DataFrame | None = None

    @classmethod
    def from_wide(
        cls,
        df: DataFrame,
        row_id: str,
        label: str,
        exclude: Iterable[str] = METADATA_COLUMNS,
        extra: Sequence[str] = (),
    ) -> FeatureTable:
        """Numeric columns become features; the rest is dropped unless in ``extra``."""
        if label not in df.columns:
            raise ValueError(f"target column {label!r} is not in the table")
        features = numeric_columns(df, {row_id, label, *exclude, *extra})
        if not features:
            raise ValueError("the table has no numeric feature column")
        head = [quoted(row_id).alias("row_id"), quoted(label).alias("label"), *[quoted(c) for c in extra]]
        values = [missing_to_null(quoted(c)) for c in features]
        return cls(
            df.select(*head, F.array(*values).alias("values")),
            tuple(features),
            tuple(extra),
            df.select(*head, *[v.alias(f"_{i}") for i, v in enumerate(values)]),
        )

    @classmethod
    def from_array(
        cls, df: DataFrame, row_id: str, label: str, array: str, width: int
    ) -> FeatureTable:
        values = F.transform(F.col(array), missing_to_null)
        return cls(
            df.select(
                F.col(row_id).alias("row_id"),
                F.col(label).alias("label"),
                values.alias("values"),
            ),
            tuple(f"f{i}" for i in range(width)),
        )

    @property
    def width(self) -> int:
        return len(self.names)

    def with_df(self, df: DataFrame) -> FeatureTable:
        return replace(self, df=df, wide_df=None)

    def with_values(self, values: Column) -> FeatureTable:
        return self.with_df(self.df.withColumn("values", values))

    def filter(self, condition: Column) -> FeatureTable:
        return self.with_df(self.df.filter(condition))

    def select(self, indices: Sequence[int]) -> FeatureTable:
        """Project onto features by position, in the given order."""
        others = [quoted(c) for c in self.df.columns if c != "values"]
        if self.wide_df is None:
            picks, source = [F.get(F.col("values"), F.lit(int(i))) for i in indices], self.df
        else:
            picks, source = [F.col(f"_{int(i)}") for i in indices], self.wide_df
        made = F.array(*picks) if picks else F.array().cast("array<double>")
        wide = self.wide_df and source.select(*others, *[p.alias(f"_{k}") for k, p in enumerate(picks)])
        return replace(
            self,
            df=source.select(*others, made.alias("values")),
            wide_df=wide,
            names=tuple(self.names[i] for i in indices),
        )

    def select_names(self, features: Sequence[str]) -> FeatureTable:
        position = {n: i for i, n in enumerate(self.names)}
        unknown = [f for f in features if f not in position]
        if unknown:
            raise ValueError(f"features not in the table: {unknown}")
        return self.select([position[f] for f in features])

    def long(self, keep_missing: bool = False) -> DataFrame:
        """One row per cell: ``row_id, label, *extra, feature_idx, value``."""
        cells = self.df.select(
            "row_id",
            "label",
            *[quoted(c) for c in self.extra],
            F.posexplode("values").alias("feature_idx", "value"),
        )
        return cells if keep_missing else cells.filter(F.col("value").isNotNull())

    def vectors(self) -> DataFrame:
        """``values`` as an ML vector column ``features``; needs complete data."""
        return self.df.withColumn("features", array_to_vector("values")).drop("values")

    def wide(self, label: str = "label", row_id: str = "row_id") -> DataFrame:
        return self.df.select(
            F.col("row_id").alias(row_id),
            *[F.get(F.col("values"), i).alias(n) for i, n in enumerate(self.names)],
            *[quoted(c) for c in self.extra],
            F.col("label").alias(label),
        )

    def name_of(self, feature_idx: str = "feature_idx") -> Column:
        return F.element_at(F.lit(list(self.names)), F.col(feature_idx) + 1)
