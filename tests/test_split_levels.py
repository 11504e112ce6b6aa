"""Splits by prefixes refined level by level, beside ranking whole classes."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from traitsieve.operators import split


@pytest.fixture(scope="module")
def rows(spark):
    label = F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 50 == 1, "b").when(F.col("id") != 7, "c")
    return spark.range(3_000).select(F.col("id").alias("row_id"), label.alias("label"))


def ranked(rows, share=0.2):
    known = rows.where("label is not null")
    w = Window.partitionBy("label")
    first = F.row_number().over(w.orderBy(split.row_hash())) <= F.round(F.count("*").over(w) * share)
    return {r["row_id"] for r in known.withColumn("t", first).where("t").collect()}


def held_out(df):
    return {r["row_id"] for r in df.where("is_test").collect()}


@pytest.mark.parametrize("most, prefix", [(split.CELL_MOST, 3), (40, 1), (5, 2), (1, 1), (0, 5)])
def test_levels_equal_ranking(rows, most, prefix):
    assert held_out(split.with_test_flag(rows, prefix=prefix, most=most)) == ranked(rows)
    folds = {r["row_id"]: r["fold"] for r in split.with_fold(rows, 5, prefix=prefix, most=most).collect()}
    w = Window.partitionBy("label").orderBy(split.row_hash())
    want = rows.where("label is not null").withColumn("f", F.ntile(5).over(w) - 1)
    assert all(folds[r["row_id"]] == r["f"] for r in want.collect())


def test_no_cell_above_the_limit_is_ranked(rows, monkeypatch):
    """Only windows over the counts of prefixes and over small cells are left."""
    seen = []
    whole = F.row_number

    def counted():
        seen.append(1)
        return whole()

    monkeypatch.setattr(split.F, "row_number", counted)
    split.with_test_flag(rows, most=0)  # all digits are used, nothing is ranked
    assert not seen
    split.with_test_flag(rows)
    assert seen


def test_one_key_for_a_third_of_the_rows(spark):
    """Rows of one key stay together, however small the limit."""
    rows = spark.range(900).select(F.when(F.col("id") < 300, 5).otherwise(F.col("id")).alias("row_id"), F.lit("a").alias("label"))
    got = split.with_test_flag(rows, share=0.5, most=10).groupBy("row_id").agg(F.countDistinct("is_test").alias("n"))
    assert got.where("n > 1").count() == 0
    held = split.with_test_flag(rows, share=0.5, most=10).where("is_test").count()
    assert held in (450, *range(451, 751))


def test_no_rows_and_no_labels(spark):
    none = spark.createDataFrame([(1, None), (2, None)], "row_id long, label string")
    assert split.with_test_flag(none).where("is_test").count() == 0
    assert split.with_fold(none.where("false")).count() == 0
