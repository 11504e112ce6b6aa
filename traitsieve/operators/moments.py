"""Per-feature aggregates: any aggregate, and count, mean and variance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitsieve.functions.blocks import block_moments
from traitsieve.table import FeatureTable

# Up to this width one aggregate with a column per feature beats exploding the rows.
NARROW_WIDTH = 40


def per_feature(
    table: FeatureTable,
    aggregates: dict[str, Callable[[Column], Column]],
    by: Sequence[str] = (),
    complete: bool = False,
) -> DataFrame:
    """``[by,] feature_idx`` and one column per aggregate; missing cells are null.

    A narrow table is aggregated in place: the array never materialises and only
    the columns needed are read.  A wide one is exploded into cells, so the plan
    does not grow with its width; both combine inside each task before the shuffle.
    An empty table has no rows either way; with ``complete`` a missing cell fails the query.
    """
    missing = F.raise_error(F.lit("missing cell in a table said to be complete")).cast("double")
    if table.width > NARROW_WIDTH:
        return (
            table.long(keep_missing=True)
            .groupBy(*by, "feature_idx")
            .agg(*[make(F.col("value")).alias(n) for n, make in aggregates.items()])
        )
    columns = [
        F.struct(
            F.lit(i).alias("feature_idx"),
            *[make(F.col(f"_v{i}")).alias(n) for n, make in aggregates.items()],
        )
        for i in range(table.width)
    ]
    # Taken out in a projection of their own, the values fold back into plain columns.
    values = [F.get(F.col("values"), F.lit(i)) for i in range(table.width)]
    values = [(F.coalesce(v, missing) if complete else v).alias(f"_v{i}") for i, v in enumerate(values)]
    return (
        table.df.select(*by, *values)
        .groupBy(*by)
        .agg(F.array(*columns).alias("_stats"), F.count(F.lit(1)).alias("_rows"))
        .filter("_rows > 0")
        .select(*by, F.explode("_stats").alias("_s"))
        .select(*by, "_s.*")
    )


def feature_moments(
    table: FeatureTable, by_label: bool = False, complete: bool = False
) -> DataFrame:
    """``[label,] feature_idx, n, mean, variance`` with the sample variance.

    ``complete`` promises there is no missing cell; a wide table then keeps one
    vector per class and task.  Other wide tables are worked on in blocks of features.
    """
    by = ["label"] if by_label else []
    if not complete and table.width > NARROW_WIDTH:
        found = block_moments(table.df, table.width, by_label)
        return found.where("n > 0").select(*by, "feature_idx", "n", "mean", "variance")
    if table.width <= NARROW_WIDTH:
        moments = per_feature(
            table, {"n": F.count, "mean": F.avg, "variance": F.var_samp}, by, complete
        )
        return moments.filter(F.col("n") > 0)
    summary = Summarizer.metrics("mean", "variance").summary(array_to_vector(F.col("values")))
    cells = F.arrays_zip(
        vector_to_array(F.col("s.mean")).alias("mean"),
        vector_to_array(F.col("s.variance")).alias("variance"),
    )
    return (
        table.df.groupBy(*by, F.lit(0).alias("_all"))  # a key, so that an empty table has no group
        .agg(F.count(F.lit(1)).alias("n"), summary.alias("s"))
        .select(*by, "n", F.posexplode(cells).alias("feature_idx", "cell"))
        .select(
            *by,
            "feature_idx",
            "n",
            F.col("cell.mean").alias("mean"),
            F.when(F.col("n") > 1, F.col("cell.variance")).alias("variance"),
        )
    )
