"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(value: Column | str, places: int = 6) -> Column:
    """Round and drop the sign of zero, so results compare across engines."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column, places) + F.lit(0.0)


def ratio(numerator: Column, denominator: Column, empty: float = 0.0) -> Column:
    """Division that gives ``empty`` when the denominator is zero."""
    return F.coalesce(
        F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(empty)
    )


def classes_of(df: DataFrame, label: str = "label") -> Column:
    """Sorted distinct labels as a scalar subquery; size is the number of classes."""
    return df.agg(F.array_sort(F.collect_set(label)).alias("classes")).scalar()


def digamma(n: Column) -> Column:
    """Digamma for n >= 1: eight recurrence steps, then the asymptotic series."""
    shift = 8
    x = n.cast("double")
    z = x + F.lit(float(shift))
    z2 = z * z
    series = (
        F.log(z)
        - 0.5 / z
        - (1.0 / 12 - (1.0 / 120 - (1.0 / 252 - 1.0 / (240 * z2)) / z2) / z2) / z2
    )
    for i in range(shift):
        series = series - 1.0 / (x + F.lit(float(i)))
    return series
