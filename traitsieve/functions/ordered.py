"""Exact running totals and quantiles that never sort a whole key in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitsieve.functions.session import broadcast_if_small

ROWS_PER_SLICE = 2_000_000


def slice_edges(df: DataFrame, place: Column, rows: int, rows_per_slice: int) -> list[float]:
    """Cut points that part ``rows`` rows of a key into slices by their ``place``.

    They come from a mergeable quantile sketch, return to the driver as a handful
    of numbers, and are literals from then on: every branch of the plan cuts alike.
    """
    slices = -(-rows // rows_per_slice)
    if slices <= 1:
        return []
    shares = [i / slices for i in range(1, slices)]
    placed = df.select(place.cast("double").alias("place"))
    return sorted(set(placed.approxQuantile("place", shares, 0.2 / slices)))


def with_slice(df: DataFrame, place: Column, edges: Sequence[float]) -> DataFrame:
    """Add ``slice``; rows of equal place always share one."""
    if not edges:
        return df.withColumn("slice", F.lit(0))
    inner = [e for e in edges if e not in (float("inf"), float("-inf"))]
    cutter = Bucketizer(
        splits=[float("-inf"), *inner, float("inf")], inputCol="_place", outputCol="_cut"
    )
    return (
        cutter.transform(df.withColumn("_place", place.cast("double")))
        .withColumn("slice", F.col("_cut").cast("int"))
        .drop("_cut", "_place")
    )


def feature_scale(cells: DataFrame, width: int) -> Callable[[str], Column]:
    """Place of a value within its feature: its bulk, 1% to 99%, mapped to 0..1.

    Slicing by place instead of by value keeps features of unlike scale apart from
    each other's cut points.  Subtracting and dividing never swap two values, so
    the order inside a feature stays.  Two numbers per feature reach the driver.
    """
    bulk = cells.groupBy("feature_idx").agg(
        F.percentile_approx("value", [0.01, 0.99], 1000).alias("b")
    )
    low, spread = [0.0] * width, [1.0] * width
    for row in bulk.collect():
        first, last = row["b"]
        low[row["feature_idx"]] = first
        spread[row["feature_idx"]] = last - first or 1.0

    def place(value: str) -> Column:
        idx = F.col("feature_idx")
        return (F.col(value) - F.get(F.lit(low), idx)) / F.get(F.lit(spread), idx)

    return place


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    totals: dict[str, str],
    edges: Sequence[float] = (),
    tie: Sequence[str] = (),
    place: Column | None = None,
) -> DataFrame:
    """Running sum of each column in ``totals`` (name -> new name) by ``value``.

    Without ``edges`` this is one window per key.  With them, each slice of a key
    is summed on its own and then raised by the total of the slices before it, so
    a key holding most of the rows is spread over as many tasks as it has slices.
    ``place`` (by default the value) must rise with the value inside each key.
    """
    order = [value, *tie]
    if not edges:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(w).alias(n) for c, n in totals.items()])

    group = [*keys, "slice"]
    sliced = with_slice(df, F.col(value) if place is None else place, edges)
    within = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*group)
        .agg(*[F.sum(c).alias(f"_{n}") for c, n in totals.items()])
        .select(
            *group,
            *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in totals.values()],
        )
    )
    return (
        sliced.join(offsets, group)
        .select(
            *df.columns,
            *[(F.sum(c).over(within) + F.col(f"_{n}")).alias(n) for c, n in totals.items()],
        )
    )


def exact_quantile(
    df: DataFrame, key: str, value: str, share: float, n_keys: int, accuracy: int = 10_000
) -> DataFrame:
    """Linear-interpolated quantile for each of ``n_keys`` keys: ``key, quantile``.

    A sketch brackets the wanted rank, rows outside the bracket are only counted,
    and the few distinct values inside it are ranked exactly.  If the bracket ever
    missed the rank the query fails instead of answering approximately.
    """
    margin = 2.0 / accuracy
    shares = [max(0.0, share - margin), min(1.0, share + margin)]
    bracket = df.groupBy(key).agg(
        F.count(value).alias("_n"),
        F.percentile_approx(value, shares, accuracy).alias("_b"),
    )
    placed = df.join(broadcast_if_small(bracket, n_keys), key).withColumn(
        "_zone",
        F.when(F.col(value) < F.col("_b")[0], -1).when(F.col(value) > F.col("_b")[1], 1).otherwise(0),
    )
    groups = (
        placed.groupBy(
            key, "_n", "_zone", F.when(F.col("_zone") == 0, F.col(value)).alias("_inside")
        )
        .agg(F.count(F.lit(1)).alias("_c"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        .withColumn("_v", F.when(F.col("_zone") < 0, F.col("_hi")).otherwise(F.col("_lo")))
    )
    w = Window.partitionBy(key).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    position = (F.col("_n") - 1) * F.lit(float(share))
    ranked = groups.withColumn("_upto", F.sum("_c").over(w)).withColumn("_pos", position)

    def at(rank):
        known = (
            F.when(F.col("_zone") == 0, F.lit(True))
            .when(F.col("_zone") < 0, rank == F.col("_upto"))
            .otherwise(rank == F.col("_upto") - F.col("_c") + 1)
        )
        here = (rank > F.col("_upto") - F.col("_c")) & (rank <= F.col("_upto")) & known
        return F.max(F.when(here, F.col("_v")))

    ends = ranked.groupBy(key).agg(
        at(F.floor("_pos") + 1).alias("_a"),
        at(F.ceil("_pos") + 1).alias("_z"),
        F.first(F.col("_pos") - F.floor("_pos")).alias("_part"),
    )
    missed = F.raise_error(F.lit("quantile bracket missed its rank; raise accuracy")).cast("double")
    return ends.select(
        key,
        F.when(F.col("_a").isNull() | F.col("_z").isNull(), missed)
        .otherwise(F.col("_a") + F.col("_part") * (F.col("_z") - F.col("_a")))
        .alias("quantile"),
    )
