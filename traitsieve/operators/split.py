"""Reproducible splits and folds by the hash of the row key.

A stratified split needs the n-th smallest hash of each class.  Ranking whole
classes would put a class into one task; instead histograms over longer and longer
hash prefixes find the prefix that holds the cut until few rows share it, only that
prefix is ranked, and every row is then placed by comparing its own hash with its
class's cut - no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitsieve.table import FeatureTable

SEED = 42
TEST_SHARE = 0.2
FOLDS = 5
#: Rows of a cell that one task may rank.
CELL_MOST = 100_000
HASH_DIGITS = 32
TRAIN_NAMES = ("train", "training")
TEST_NAMES = ("test", "testing")


def row_hash(seed: int = SEED, row_id: str = "row_id") -> Column:
    return F.md5(F.concat_ws("|", F.col(row_id).cast("string"), F.lit(str(seed))))


def _class_cuts(
    df: DataFrame,
    strata: Column,
    ranks: Callable[[Column], Column],
    seed: int,
    prefix: int,
    eager: bool = True,
    most: int = CELL_MOST,
) -> Column:
    """Map class -> array of the hashes at the wanted ranks.

    ``eager`` computes them now (a few hashes per class), so that later passes over the
    same split need not, and refines the prefix until a cell is small.  Else they are a
    scalar subquery with one prefix.  ``ranks`` turns a class size into an array of ranks
    in rising order.
    """
    keyed = df.select(strata.alias("stratum"), row_hash(seed).alias("hash"))
    if eager:
        return _refined_cuts(keyed, ranks, prefix, most)
    keyed = keyed.withColumn("cell", F.substring("hash", 1, prefix))
    stratum = Window.partitionBy("stratum")
    running = stratum.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = keyed.groupBy("stratum", "cell").agg(F.count(F.lit(1)).alias("n"))
    located = cells.select(
        "stratum",
        "cell",
        (F.sum("n").over(running) - F.col("n")).alias("before"),
        F.sum("n").over(running).alias("upto"),
        F.sum("n").over(stratum).alias("size"),
    )
    wanted = (
        located.select("stratum", "cell", "before", "upto", F.posexplode(ranks(F.col("size"))).alias("pos", "rank"))
        .filter((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("upto")))
        .groupBy("stratum", "cell")
        .agg(
            F.first("before").alias("before"),
            F.collect_list(F.struct("pos", "rank")).alias("targets"),
        )
    )
    # `wanted` has at most classes x ranks rows whatever the data size.
    near = keyed.join(F.broadcast(wanted), ["stratum", "cell"])
    place = F.col("before") + F.row_number().over(
        Window.partitionBy("stratum", "cell").orderBy("hash")
    )
    cuts = (
        near.withColumn("place", place)
        .select("stratum", "hash", "place", F.explode("targets").alias("t"))
        .filter(F.col("place") == F.col("t.rank"))
        .groupBy("stratum")
        .agg(F.array_sort(F.collect_list(F.struct("t.pos", "hash"))).alias("cuts"))
        .select("stratum", F.transform("cuts", lambda c: c["hash"]).alias("cuts"))
    )
    return cuts.agg(
        F.map_from_entries(F.collect_list(F.struct("stratum", "cuts"))).alias("cuts")
    ).scalar()


def _refined_cuts(keyed: DataFrame, ranks: Callable[[Column], Column], digits: int, most: int) -> Column:
    """The hashes at the wanted ranks by radix selection on hexadecimal digits.

    A scan counts rows by the next digits of the hash in the cells that hold a wanted rank (at
    first the whole class).  Cells of at most ``most`` rows are ranked.  A cell of the whole hash
    is that hash, however many rows share it.
    """
    spark, kind = keyed.sparkSession, keyed.schema["stratum"].dataType.simpleString()
    keyed = keyed.where("stratum is not null")
    schema = f"stratum {kind}, cell string, pos int, rank long, n long"
    empty = F.create_map().cast(f"map<{kind}, array<string>>")
    known, wanted = 0, None
    while True:
        step = F.substring("hash", 1, min(known + digits, HASH_DIGITS))
        if wanted is None:
            cells = keyed.groupBy("stratum", F.lit("").alias("above"), step.alias("cell"))
        else:
            near = keyed.withColumn("above", F.substring("hash", 1, known))
            held = wanted.select("stratum", F.col("cell").alias("above")).distinct()
            cells = near.join(F.broadcast(held), ["stratum", "above"]).groupBy("stratum", "above", step.alias("cell"))
        cells = cells.agg(F.count(F.lit(1)).alias("n"))
        inside = Window.partitionBy("stratum", "above")
        upto = F.sum("n").over(inside.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        cells = cells.select("*", upto.alias("upto"), F.sum("n").over(inside).alias("size"))
        if wanted is None:
            asked = cells.select("*", F.posexplode(ranks(F.col("size"))).alias("pos", "rank"))
        else:
            asked = cells.join(
                F.broadcast(wanted.select("stratum", F.col("cell").alias("above"), "pos", "rank")), ["stratum", "above"]
            )
        asked = asked.where((F.col("rank") > F.col("upto") - F.col("n")) & (F.col("rank") <= F.col("upto")))
        asked = asked.select("stratum", "cell", "pos", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "n")
        rows = asked.collect()  # at most classes x ranks rows whatever the data size
        if not rows:
            return empty
        known = min(known + digits, HASH_DIGITS)
        wanted = spark.createDataFrame(rows, schema)
        if known == HASH_DIGITS or max(r["n"] for r in rows) <= most:
            break
    if known < HASH_DIGITS:
        near = keyed.withColumn("cell", F.substring("hash", 1, known))
        place = F.row_number().over(Window.partitionBy("stratum", "cell").orderBy("hash"))
        held = F.broadcast(wanted.select("stratum", "cell").distinct())
        placed = near.join(held, ["stratum", "cell"]).withColumn("rank", place)
        found = placed.join(F.broadcast(wanted.select("stratum", "cell", "pos", "rank")), ["stratum", "cell", "rank"])
        rows = [(r["stratum"], r["pos"], r["hash"]) for r in found.select("stratum", "pos", "hash").collect()]
    else:
        rows = [(r["stratum"], r["pos"], r["cell"]) for r in rows]
    cuts: dict = {}
    for stratum, _, cut in sorted(rows, key=lambda r: r[1]):
        cuts.setdefault(stratum, []).append(cut)
    return F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])


def with_test_flag(
    df: DataFrame,
    share: float = TEST_SHARE,
    seed: int = SEED,
    stratify: bool = True,
    prefix: int = 3,
    eager: bool = True,
    most: int = CELL_MOST,
) -> DataFrame:
    """Add ``is_test``: the ``round(share * n)`` smallest hashes of every class."""
    strata = F.col("label") if stratify else F.lit("all")
    cuts = _class_cuts(
        df, strata, lambda n: F.array(F.round(n * F.lit(share)).cast("long")), seed, prefix, eager, most
    )
    cut = F.get(F.try_element_at(cuts, strata), F.lit(0))
    return df.withColumn("is_test", F.coalesce(row_hash(seed) <= cut, F.lit(False)))


def with_fold(
    df: DataFrame, folds: int = FOLDS, seed: int = SEED, prefix: int = 3, eager: bool = True,
    most: int = CELL_MOST,
) -> DataFrame:
    """Add ``fold`` 0..folds-1: equal-sized runs of each class in hash order."""

    def ends(n: Column) -> Column:
        base, extra = F.floor(n / folds), n % folds
        return F.array(
            *[F.lit(j) * base + F.least(F.lit(j), extra) for j in range(1, folds)]
        )

    cuts = _class_cuts(df, F.col("label"), ends, seed, prefix, eager, most)
    passed = F.size(F.filter("_cuts", lambda c: c < F.col("_hash")))
    return (
        df.withColumn("_cuts", F.try_element_at(cuts, F.col("label")))
        .withColumn("_hash", row_hash(seed))
        .withColumn("fold", F.greatest(passed, F.lit(0)).cast("int"))
        .drop("_cuts", "_hash")
    )


def with_hash_flag(df: DataFrame, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``is_test`` by hash value alone: one projection, shares approximate."""
    point = F.conv(F.substring(row_hash(seed), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return df.withColumn("is_test", point < share)


def predefined_split(df: DataFrame, column: str, row_id: str = "row_id") -> DataFrame:
    """Add ``split`` from a split column and keep only rows in train or test.

    When the names give no train row or no test row, the category of the smallest
    row key is train and every other category is test.
    """
    named = (
        F.when(F.lower(F.col(column)).isin(*TRAIN_NAMES), "train")
        .when(F.lower(F.col(column)).isin(*TEST_NAMES), "test")
    )
    seen = df.agg(
        F.struct(
            F.count_if(named == "train").alias("n_train"),
            F.count_if(named == "test").alias("n_test"),
            F.min_by(column, row_id).alias("first"),
        ).alias("seen")
    ).scalar()
    by_order = F.when(F.col(column) == F.col("_seen.first"), "train").otherwise("test")
    usable = (F.col("_seen.n_train") > 0) & (F.col("_seen.n_test") > 0)
    return (
        df.withColumn("_seen", seen)
        .withColumn("split", F.when(usable, named).otherwise(by_order))
        .filter(F.col("split").isNotNull())
        .drop("_seen")
    )


def train_test(table: FeatureTable, **options) -> tuple[FeatureTable, FeatureTable]:
    """Stratified train and test part of a table."""
    flagged = with_test_flag(table.df, **options)
    train = table.with_df(flagged.filter(~F.col("is_test")).drop("is_test"))
    test = table.with_df(flagged.filter("is_test").drop("is_test"))
    return train, test
