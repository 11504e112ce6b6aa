"""Missing cells, constant columns, odd names, empty denominators, wrong input."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from traitsieve.operators import compare, metrics, prep, profile, shape, split
from traitsieve.operators import univariate as uni
from traitsieve.operators import variance as var
from traitsieve.sources import fixtures as fx
from traitsieve.sources import sinks, tables
from traitsieve.table import FeatureTable

SCHEMA = "row_id long, label string, values array<double>"


def table(spark, rows, names=("a", "b")):
    return FeatureTable(spark.createDataFrame(rows, SCHEMA), names)


def test_nan_is_missing_and_odd_names_survive(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame(
            [(1, "x", 1.0, float("nan"), 3), (2, "y", 2.0, 5.0, 4)],
            "id long, y string, `g.1` double, P double, p long",
        )
        t = FeatureTable.from_wide(df, "id", "y")
        assert t.names == ("g.1", "P", "p")
        assert {r["feature_idx"]: r["n"] for r in t.long().groupBy("feature_idx").agg(F.count("*").alias("n")).collect()} == {0: 2, 1: 1, 2: 2}
        assert t.wide().columns == ["row_id", "g.1", "P", "p", "label"]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_table_needs_target_and_features(spark):
    df = spark.createDataFrame([(1, "x")], "id long, y string")
    with pytest.raises(ValueError):
        FeatureTable.from_wide(df, "id", "nope")
    with pytest.raises(ValueError):
        FeatureTable.from_wide(df, "id", "y")


def test_gate_errors(spark):
    one_class = table(spark, [(i, "x", [1.0, float(i)]) for i in range(12)])
    with pytest.raises(ValueError, match="fewer than two"):
        profile.validate(one_class)
    few = table(spark, [(i, "xy"[i % 2], [1.0, float(i)]) for i in range(4)])
    with pytest.raises(ValueError, match="samples"):
        profile.validate(few)
    holes = table(spark, [(i, "xy"[i % 2], [None if i < 2 else 1.0, 1.0]) for i in range(12)])
    with pytest.raises(ValueError, match="a"):
        profile.validate(holes)
    fine = table(spark, [(i, "xy"[i % 2], [None if i < 2 else float(i), 1.0]) for i in range(20)])
    report = profile.validate(fine)
    assert report["passes"] and report["n_constant"] == 1  # exactly 0.1 missing is allowed


def test_missing_label_fails_the_gate(spark):
    t = table(spark, [(i, None if i == 0 else "xy"[i % 2], [1.0, float(i)]) for i in range(12)])
    assert not profile.gate(t).first()["passes"]


def test_constant_column_scales_to_zero_and_scores_nothing(spark):
    t = table(spark, [(i, "xy"[i % 2], [7.0, float(i)]) for i in range(10)])
    scaled = prep.standardise(t)
    assert {r["value"] for r in scaled.long().filter("feature_idx = 0").collect()} == {0.0}
    assert uni.anova_f(t).filter("feature = 'a'").first()["score"] is None
    assert [r["feature"] for r in profile.constant_features(t).collect()] == ["a"]


def test_perfect_separation_is_infinite_and_first(spark):
    t = table(spark, [(i, "xy"[i % 2], [float(i % 2), float(i)]) for i in range(10)])
    best = uni.ranked(uni.anova_f(t), 1).first()
    assert best["feature"] == "a" and best["score"] == float("inf")


def test_k_beyond_the_width_returns_everything(spark):
    t = table(spark, [(i, "xy"[i % 2], [float(i), float(i * i)]) for i in range(10)])
    assert uni.ranked(uni.anova_f(t), 50).count() == 2
    assert var.top_by_variance(var.feature_variance(t), 50).count() == 2


def test_median_of_even_count_and_all_missing_column(spark):
    t = table(spark, [(1, "x", [1.0, None]), (2, "x", [2.0, None]), (3, "y", [None, None]), (4, "y", [10.0, None])])
    filled = {r["row_id"]: r["values"] for r in prep.impute(t, "median").df.collect()}
    assert filled[3] == [2.0, None]


def test_drop_keeps_label_with_its_row(spark):
    t = table(spark, [(1, "x", [1.0, None]), (2, "y", [2.0, 3.0])])
    assert [(r["row_id"], r["label"]) for r in prep.impute(t, "drop").df.collect()] == [(2, "y")]


def test_unknown_test_label_is_an_error(spark):
    train = table(spark, [(1, "x", [1.0, 2.0])]).df
    test = table(spark, [(2, "z", [1.0, 2.0])]).df
    with pytest.raises(PySparkException):
        prep.encode_labels(test, fit_on=train).collect()


def test_positive_label_of_the_named_pair(spark):
    pair = spark.createDataFrame([("IR",), ("IS",)], "label string")
    other = spark.createDataFrame([("a",), ("b",)], "label string")
    hit = {r["label"]: r["target"] for r in prep.with_binary_target(pair).collect()}
    assert hit == {"IR": 1, "IS": 0}
    assert {r["label"]: r["target"] for r in prep.with_binary_target(other).collect()} == {"a": 0, "b": 1}


def test_numeric_labels_sort_by_number(spark):
    df = spark.createDataFrame([(10,), (9,), (2,)], "label int")
    assert {r["label"]: r["code"] for r in prep.encode_labels(df).collect()} == {2: 0, 9: 1, 10: 2}


def test_metrics_without_a_denominator_are_zero(spark):
    pred = spark.createDataFrame(
        [("m", 1, 0, 0, 0.1), ("m", 2, 0, 0, 0.1)], "model string, row_id long, label int, prediction int, score double"
    )
    row = metrics.binary_metrics(pred, 1).first()
    assert (row["accuracy"], row["sensitivity"], row["precision"], row["f1_score"]) == (1.0, 0.0, 0.0, 0.0)
    assert row["specificity"] == 1.0
    assert metrics.auc(pred, 1).first()["auc"] is None


def test_specificity_uses_the_positive_label(spark):
    pred = spark.createDataFrame(
        [("m", 1, "IR", "IR", 0.9), ("m", 2, "IS", "IR", 0.8), ("m", 3, "IS", "IS", 0.2), ("m", 4, "IS", "IS", 0.1)],
        "model string, row_id long, label string, prediction string, score double",
    )
    row = metrics.binary_metrics(pred, "IR").first()
    assert row["sensitivity"] == 1.0 and row["specificity"] == pytest.approx(2 / 3)


def test_roc_starts_at_the_origin(spark, sf):
    curve = metrics.roc_curve(fx.pred(spark, sf), 1)
    start = curve.filter(F.col("threshold") == float("inf")).collect()
    assert len(start) == 2 and all((r["fpr"], r["tpr"]) == (0.0, 0.0) for r in start)


def test_overlap_of_disjoint_lists(spark):
    lists = spark.createDataFrame([("m", "a"), ("n", "b")], "method string, feature string")
    got = {(r["method_a"], r["method_b"]): (r["n_common"], r["jaccard"]) for r in compare.pairwise_overlap(lists).collect()}
    assert got == {("m", "m"): (1, 1.0), ("n", "n"): (1, 1.0), ("m", "n"): (0, 0.0), ("n", "m"): (0, 0.0)}


def test_csv_with_every_missing_spelling(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,y,a,b,c\n1,x,1.5,N/A,u\n2,y,NA,2,null\n3,x,null,,v\n4,y,NaN,4,w\n")
    t = tables.load_table(spark, str(path), "y")
    assert t.names == ("a", "b")
    assert {r["row_id"]: r["values"] for r in t.df.collect()} == {
        1: [1.5, None], 2: [None, 2.0], 3: [None, None], 4: [None, 4.0],
    }
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "t.xlsx"))
    with pytest.raises(PySparkException):
        tables.read_table(spark, str(tmp_path / "none.csv"))


def test_narrowing_is_strict_and_leaves_flags_alone(spark):
    df = spark.createDataFrame(
        [(127, -127, 65504.0, 1.0, True, "a"), (0, 126, 0.0, -2.0, False, "b")],
        "edge long, small long, wide double, thin double, flag boolean, name string",
    )
    types = dict(shape.narrow_types(df).dtypes)
    assert types == {
        "edge": "smallint", "small": "tinyint", "wide": "double", "thin": "float", "flag": "boolean", "name": "string",
    }


def test_alignment_follows_the_training_order(spark):
    a = table(spark, [(1, "x", [1.0, 2.0])], ("p", "q"))
    b = table(spark, [(2, "x", [3.0, 4.0])], ("q", "p"))
    _, test = shape.align_features(a, b)
    assert test.names == ("p", "q") and test.df.first()["values"] == [4.0, 3.0]
    with pytest.raises(ValueError):
        shape.align_features(a, table(spark, [(2, "x", [3.0, 4.0])], ("r", "s")))


def test_predefined_split_drops_other_rows(spark, sf):
    rows = split.predefined_split(fx.split_source(spark, sf), "Category")
    assert {r["Category"] for r in rows.collect()} == {"Training", "TEST"}


def test_summary_round_trip(spark, tmp_path):
    row = sinks.summary_row(spark, a=1, b="x", c=F.struct(F.lit(2.5).alias("d")))
    back = sinks.read_summary(spark, sinks.write_summary(row, str(tmp_path / "s.json"))).first()
    assert (back["a"], back["b"], back["c"]["d"]) == (1, "x", 2.5)
    with pytest.raises(ValueError):
        sinks.write_table(row, str(tmp_path / "s.xlsx"), "xlsx")
