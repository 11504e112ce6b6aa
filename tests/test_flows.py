"""The three runs end to end, on small model sets."""

import pytest
from pyspark.sql import functions as F

from traitsieve.operators import models as ml
from traitsieve.operators import selection
from traitsieve.plans import flows
from traitsieve.sources import fixtures as fx
from traitsieve.table import FeatureTable

METHODS = ("univariate_f_test", "mutual_information", "lasso_regularization")


def small_selectors(samples, k):
    return selection.default_selectors(
        samples, k, ml.random_forest(20, 5), ml.gradient_boosting(5, 3), step=0.5, grids={}
    )


def small_models(samples):
    return {
        "RandomForest": ml.random_forest(10, 6),
        "LogisticRegression": ml.logistic_regression(samples.n_rows, max_iter=30),
    }


@pytest.fixture(scope="module")
def named(spark, sf):
    """Planted labels under the special pair of names, with holes."""
    table = fx.emb_bin(spark, sf).select(range(12))
    label = F.when(F.col("label") == 1, "IR").otherwise("IS")
    holes = F.transform("values", lambda v, j: F.when(F.col("row_id") % 31 != j, v))
    return table.with_df(table.df.withColumn("label", label).withColumn("values", holes))


def test_both_runs(spark, named, tmp_path):
    chosen, compared = flows.run_all(
        named, str(tmp_path), models=small_models, top_n=3, n_features=4, top_variance=10,
        methods=METHODS, selectors=small_selectors, judge=ml.random_forest(10, 5), folds=3,
    )
    assert chosen.train.width == 10 and 2 <= len(chosen.features) <= 4
    assert {"f0", "f1"} <= set(chosen.features)
    assert chosen.test_accuracy > 0.7
    board = chosen.board.collect()
    assert len(board) == 3 and sum(r["is_best"] for r in board) == 1
    ready = spark.read.parquet(chosen.paths["train"])
    assert ready.columns == ["row_id", *chosen.features, "label"]
    summary = spark.read.json(chosen.paths["summary"]).first()
    assert summary["best_method"] == chosen.best_method and len(summary["methods"]) == 3

    assert set(compared.full.models) == {"RandomForest", "LogisticRegression"}
    figures = {r["model"]: r for r in compared.metrics.collect()}
    # IR is positive although it sorts first.
    assert all(r["auc"] > 0.8 for r in figures.values())
    assert compared.comparison.count() == 6
    assert len(compared.top_features) == min(3, len(chosen.features))
    report = spark.read.json(compared.paths["summary"]).first()
    assert report["best_model"] == compared.full.best


def test_selection_run_with_a_split_column(spark, sf, tmp_path):
    wide = fx.doc_wide(spark, sf)
    part = F.when(F.col("source").isin("src0", "src1", "src2", "src3", "src4"), "Test").otherwise("Train")
    table = FeatureTable.from_wide(wide.withColumn("Category", part), "doc_id", "quality", extra=("Category",))
    chosen = flows.run_feature_selection(
        table, str(tmp_path), n_features=3, methods=("univariate_f_test", "lasso_regularization"),
        selectors=small_selectors, judge=ml.random_forest(5, 3), folds=2, split_column="Category", fmt="csv",
    )
    assert chosen.test.df.select("Category").distinct().first()[0] == "Test"
    assert len(chosen.features) <= 3


def test_model_run_on_several_classes(spark, sf, tmp_path):
    table = fx.doc(spark, sf)
    table = FeatureTable(table.df.withColumn("label", F.col("lang")).drop("lang", "source"), table.names)
    train, test = flows.split_table(table, None, 0.3, 1)
    result = flows.run_models(train, test, str(tmp_path), small_models, top_n=3)
    assert result.comparison is None
    assert "weighted_f1" in result.metrics.columns and result.metrics.count() == 2
