"""Univariate feature scores: ANOVA F and two mutual-information estimators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitsieve.functions.blocks import bin_counts
from traitsieve.functions.columns import digamma
from traitsieve.functions.ordered import (
    ROWS_PER_SLICE,
    feature_scale,
    running_totals,
    slice_edges,
    with_slice,
)
from traitsieve.functions.session import broadcast_if_small
from traitsieve.operators.moments import NARROW_WIDTH, feature_moments
from traitsieve.table import FeatureTable

NEIGHBOURS = 3
MI_BINS = 10


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Rank features by score, ties by column order; one row per feature."""
    order = [F.desc_nulls_last("score"), F.asc("feature_idx")]
    best = scores if k is None else scores.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def anova_f(table: FeatureTable, complete: bool = False) -> DataFrame:
    """One-way ANOVA F per feature: ``feature_idx, feature, score``.

    Built from per-class count, mean and variance, so the rows are read once and
    only classes x features rows are shuffled; sums are taken around the means.
    """
    per_class = feature_moments(table, by_label=True, complete=complete)
    feature = Window.partitionBy("feature_idx")
    grand = F.sum(F.col("n") * F.col("mean")).over(feature) / F.sum("n").over(feature)
    parts = per_class.withColumn("grand", grand)
    deviation = F.col("mean") - F.col("grand")
    sums = parts.groupBy("feature_idx").agg(
        F.sum(F.col("n") * deviation * deviation).alias("between"),
        F.sum((F.col("n") - 1) * F.coalesce("variance", F.lit(0.0))).alias("within"),
        F.count(F.lit(1)).alias("classes"),
        F.sum("n").alias("rows"),
    )
    ms_between = F.try_divide(F.col("between"), F.col("classes") - 1)
    ms_within = F.try_divide(F.col("within"), F.col("rows") - F.col("classes"))
    # A feature without spread inside its classes separates them perfectly.
    score = F.when(
        (ms_within == 0) & (ms_between > 0), F.lit(float("inf"))
    ).otherwise(F.try_divide(ms_between, ms_within))
    return sums.select("feature_idx", table.name_of().alias("feature"), score.alias("score"))


def _with_radius(points: DataFrame, neighbours: int) -> DataFrame:
    """Add ``radius, lower, upper``: the k-th nearest distance and the bounds it sets.

    At most ``neighbours`` distinct values on each side, and the copies of the value
    itself, can be among the k nearest.  The radius is the smallest of those gaps
    that has k values within it.  A neighbour's own value is the bound on its side,
    because value +- radius may round past it.
    """
    sides = [(s, i) for s in ("below", "above") for i in range(1, neighbours + 1)]
    gaps = [F.abs(F.col("value") - F.col(f"{s}_{i}")).alias(f"gap_{s}_{i}") for s, i in sides]

    def within(gap: str) -> str:
        return " + ".join(
            ["copies - 1", *[f"IF(gap_{s}_{i} <= {gap}, {s}_n{i}, 0)" for s, i in sides]]
        )

    each = [f"gap_{s}_{i}" for s, i in sides]
    radius = ", ".join(["IF(copies - 1 >= k, 0D, NULL)", *[f"IF({within(g)} >= k, {g}, NULL)" for g in each]])

    def bound(side: str, otherwise: str) -> str:
        known = " ".join(f"WHEN gap_{side}_{i} = radius THEN {side}_{i}" for i in range(1, neighbours + 1))
        return f"CASE {known} ELSE {otherwise} END"

    return (
        points.select("*", *gaps)
        .withColumn("radius", F.expr(f"least({radius})"))
        .withColumn("lower", F.expr(bound("below", "value - radius")))
        .withColumn("upper", F.expr(bound("above", "value + radius")))
    )


def _slicing(
    cells: DataFrame, width: int, rows: int, rows_per_slice: int
) -> tuple[Callable[[str], Column], list[float]]:
    """How to cut long features into value slices; no edges when they are short."""
    if rows <= rows_per_slice:
        return F.col, []
    place = feature_scale(cells, width)
    return place, slice_edges(cells, place("value"), rows, rows_per_slice)


def _with_border_rows(points: DataFrame, neighbours: int) -> DataFrame:
    """Add to each slice the nearest rows of the slices around it, marked ``guest``."""
    group = ["feature_idx", "label", "slice"]
    entry = F.struct(F.col("value"), F.col("copies"))
    low = Window.partitionBy(*group).orderBy("value")
    high = Window.partitionBy(*group).orderBy(F.desc("value"))
    ends = (
        points.select("*", F.row_number().over(low).alias("_lo"), F.row_number().over(high).alias("_hi"))
        .filter((F.col("_lo") <= neighbours) | (F.col("_hi") <= neighbours))
        .groupBy(*group)
        .agg(
            F.collect_list(F.when(F.col("_lo") <= neighbours, entry)).alias("_lows"),
            F.collect_list(F.when(F.col("_hi") <= neighbours, entry)).alias("_highs"),
        )
    )
    # Every slice listed here holds at least one row, so `neighbours` slices on
    # each side are enough to find `neighbours` values.
    along = Window.partitionBy("feature_idx", "label").orderBy("slice")
    around = ends.select(
        *group,
        F.flatten(F.collect_list("_highs").over(along.rowsBetween(-neighbours, -1))).alias("before"),
        F.flatten(F.collect_list("_lows").over(along.rowsBetween(1, neighbours))).alias("after"),
    )
    near_below = F.slice(F.sort_array("before", asc=False), 1, neighbours)
    near_above = F.slice(F.sort_array("after"), 1, neighbours)
    guests = (
        around.select(*group, F.explode(F.concat(near_below, near_above)).alias("g"))
        .select(*group, F.col("g.value").alias("value"), F.col("g.copies").alias("copies"))
        .withColumn("guest", F.lit(True))
    )
    # Guests carry no class size; they only serve as neighbours.
    return points.withColumn("guest", F.lit(False)).unionByName(guests, allowMissingColumns=True)


def mutual_information(
    table: FeatureTable,
    neighbours: int = NEIGHBOURS,
    rows: int | None = None,
    classes: int | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Nearest-neighbour estimate of MI(feature; class): ``feature_idx, feature, score``.

    Ross (PLoS ONE 2014) without tie-breaking noise.  For each point the radius is
    the distance to its k-th nearest same-class value, and m counts the values of
    any class strictly inside it (or equal to it when the radius is zero).
    Equal values are merged first and long features are cut into value slices,
    so no task has to hold a whole feature.
    """
    cells = table.long().select("feature_idx", "label", "value")
    if rows is None or classes is None:
        rows, classes = table.df.agg(F.count(F.lit(1)), F.approx_count_distinct("label")).first()
    place, edges = _slicing(cells, table.width, rows, rows_per_slice)

    points = cells.groupBy("feature_idx", "label", "value").agg(F.count(F.lit(1)).alias("copies"))
    # One row per feature and class, summed from the merged points rather than the
    # rows.  Classes of a single sample carry no distance.  Broadcast when small: a
    # large class must not pull its points into one task.
    sizes = points.groupBy("feature_idx", "label").agg(F.sum("copies").alias("n_class"))
    sizes = broadcast_if_small(sizes.filter("n_class > 1"), 2 * table.width * classes)
    points = points.join(sizes, ["feature_idx", "label"])
    points = with_slice(points, place("value"), edges)
    marked = _with_border_rows(points, neighbours) if edges else points.withColumn("guest", F.lit(False))

    order = Window.partitionBy("feature_idx", "label", "slice").orderBy("value")
    around = []
    for i in range(1, neighbours + 1):
        around += [
            F.lag("value", i).over(order).alias(f"below_{i}"),
            F.lag("copies", i).over(order).alias(f"below_n{i}"),
            F.lead("value", i).over(order).alias(f"above_{i}"),
            F.lead("copies", i).over(order).alias(f"above_n{i}"),
        ]
    k = F.least(F.col("n_class") - 1, F.lit(neighbours)).cast("int")
    local = _with_radius(
        marked.select("*", *around).filter(~F.col("guest")).withColumn("k", k), neighbours
    )
    value, lower, upper = F.col("value"), F.col("lower"), F.col("upper")
    zero = F.col("radius") == 0

    # Three events per point: it adds its copies, its upper bound reads the count
    # below it and its lower bound the count up to it.  At equal value the order is
    # upper bound, point, lower bound; a zero radius reads around its own value.
    def event(at: Column, turn: Column, weight: Column, sign: int) -> Column:
        return F.struct(
            at.alias("at"), turn.alias("turn"), weight.alias("weight"), F.lit(sign).alias("sign")
        )

    none = F.lit(0).cast("long")
    events = local.select(
        "feature_idx",
        "label",
        "value",
        "copies",
        "k",
        "n_class",
        F.explode(
            F.array(
                event(value, F.lit(1), F.col("copies"), 0),
                event(upper, F.when(zero, 2).otherwise(0), none, 1),
                event(lower, F.when(zero, 0).otherwise(2), none, -1),
            )
        ).alias("e"),
    ).select("feature_idx", "label", "value", "copies", "k", "n_class", "e.*")
    counted = running_totals(
        events, ["feature_idx"], "at", {"weight": "seen"}, edges, tie=["turn"], place=place("at")
    )
    inside = (
        counted.filter("sign <> 0")
        .groupBy("feature_idx", "label", "value")
        .agg(
            F.first("copies").alias("copies"),
            F.first("k").alias("k"),
            F.first("n_class").alias("n_class"),
            F.sum(F.col("sign") * F.col("seen")).alias("m"),
        )
    )
    copies = F.col("copies")
    parts = inside.groupBy("feature_idx").agg(
        F.sum(copies).alias("n"),
        F.sum(copies * digamma(F.col("k"))).alias("psi_k"),
        F.sum(copies * digamma(F.col("n_class"))).alias("psi_class"),
        F.sum(copies * digamma(F.col("m"))).alias("psi_m"),
    )
    estimate = digamma(F.col("n")) + (F.col("psi_k") - F.col("psi_class") - F.col("psi_m")) / F.col("n")
    return parts.select(
        "feature_idx",
        table.name_of().alias("feature"),
        F.greatest(estimate, F.lit(0.0)).alias("score"),
    )


def binned_mutual_information(
    table: FeatureTable,
    bins: int = MI_BINS,
    rows: int | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Plug-in MI on equal-frequency bins; equal values always share a bin.

    Wide tables are binned in blocks of features, narrow ones in slices of values.
    """
    if table.width > NARROW_WIDTH:
        counts = bin_counts(table.df, table.width, bins)
        known = counts.withColumn("n", F.sum("c").over(Window.partitionBy("feature_idx")))
        return _plug_in(table, known.select("feature_idx", "n", "bin", "label", "c"))
    cells = table.long().select("feature_idx", "label", "value")
    if rows is None:
        rows = table.df.count()
    place, edges = _slicing(cells, table.width, rows, rows_per_slice)
    # Rows meet once, as counts per value and class; all else is built from those.
    by_class = cells.groupBy("feature_idx", "value", "label").agg(F.count(F.lit(1)).alias("c"))
    by_value = by_class.groupBy("feature_idx", "value").agg(
        F.sum("c").alias("copies"), F.collect_list(F.struct("label", "c")).alias("classes")
    )
    totals = by_class.groupBy("feature_idx").agg(F.sum("c").alias("n"))
    grid = (
        running_totals(by_value, ["feature_idx"], "value", {"copies": "upto"}, edges, place=place("value"))
        .join(broadcast_if_small(totals, table.width), "feature_idx")
        .select(
            "feature_idx",
            "n",
            F.floor((F.col("upto") - F.col("copies")) * bins / F.col("n")).alias("bin"),
            F.inline("classes"),
        )
        .groupBy("feature_idx", "n", "bin", "label")
        .agg(F.sum("c").alias("c"))
    )
    return _plug_in(table, grid)


def _plug_in(table: FeatureTable, grid: DataFrame) -> DataFrame:
    """MI from counts ``feature_idx, n, bin, label, c``."""
    row = Window.partitionBy("feature_idx", "bin")
    column = Window.partitionBy("feature_idx", "label")
    joint = grid.select(
        "*", F.sum("c").over(row).alias("n_bin"), F.sum("c").over(column).alias("n_label")
    )
    share = F.col("c") / F.col("n")
    term = share * F.log(share / (F.col("n_bin") / F.col("n") * (F.col("n_label") / F.col("n"))))
    return joint.groupBy("feature_idx").agg(F.sum(term).alias("mi")).select(
        "feature_idx",
        table.name_of().alias("feature"),
        F.greatest("mi", F.lit(0.0)).alias("score"),
    )


def select_k_best(scores: DataFrame, k: int) -> DataFrame:
    """Best ``k`` features with ``rank``; all of them when there are fewer."""
    return ranked(scores, k)


def stacked(selections: dict[str, DataFrame]) -> DataFrame:
    """``method, feature_idx, feature, rank, score`` over several rankings."""
    parts = [
        s.select(F.lit(m).alias("method"), "feature_idx", "feature", "rank", "score")
        for m, s in selections.items()
    ]
    return reduce(DataFrame.unionByName, parts)
