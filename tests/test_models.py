"""Fitted models: planted signal is found, noise is not, saved models agree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitsieve.functions import session
from traitsieve.functions.session import scratch_path
from traitsieve.operators import importance, metrics, selection, split
from traitsieve.operators import explore
from traitsieve.operators import models as ml
from traitsieve.sources import fixtures as fx


@pytest.fixture(scope="module")
def pair(spark, sf):
    train, test = split.train_test(fx.emb_bin(spark, sf), eager=True)
    return ml.prepare(train, folds=3), ml.prepare(test, fit_on=train)


def first_two(ranking):
    return {r["feature"] for r in ranking.filter("rank <= 2").collect()}


def test_selectors_find_the_planted_features(pair):
    samples, _ = pair
    assert first_two(selection.by_importance(samples, ml.random_forest(30, 8), 10)) == {"f0", "f1"}
    assert first_two(selection.by_importance(samples, ml.gradient_boosting(5, 3), 10)) == {"f0", "f1"}
    assert first_two(selection.lasso(samples, 10)) == {"f0", "f1"}
    forest = ml.random_forest(20, 6)
    kept = selection.recursive_elimination(samples, forest, 4, step=0.5)
    assert kept.count() == 4 and first_two(kept) == {"f0", "f1"}


def test_elimination_one_at_a_time(pair):
    samples = pair[0].select(range(5))
    model = ml.logistic_regression(samples.n_rows, max_iter=20)
    assert first_two(selection.recursive_elimination(samples, model, 2, step=1)) == {"f0", "f1"}


def test_lasso_keeps_few_and_falls_back(pair):
    samples, _ = pair
    strong = selection.lasso(samples, 20, c=0.02)
    assert 0 < strong.count() < 20
    assert selection.lasso(samples, 3, c=1e-5).count() == 3


def test_lasso_search_and_balance(pair):
    samples, _ = pair
    found = selection.lasso(samples, 5, grid_c=(0.01, 0.1), balanced=True, max_iter=30)
    assert first_two(found) == {"f0", "f1"}


@pytest.mark.parametrize(
    "build",
    [
        lambda s: ml.random_forest(30, 8),
        lambda s: ml.gradient_boosting(5, 3),
        lambda s: ml.ada_boost(8),
        lambda s: ml.logistic_regression(s.n_rows),
        lambda s: ml.linear_svm(s.n_rows, max_iter=20),
        lambda s: ml.k_nearest(15, "distance"),
        lambda s: ml.rbf_svm(s.n_rows, len(s.names), max_iter=20),
    ],
    ids=["forest", "boosting", "ada", "logistic", "linear_svm", "knn", "rbf_svm"],
)
def test_models_beat_chance_and_reload(spark, pair, build):
    train, test = pair
    model = build(train).fit(train.rows)
    pred = ml.predict_table(model, test.rows, "m").cache()
    assert metrics.auc(pred, 1.0).first()["auc"] > 0.7
    assert pred.filter((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
    found = ml.ModelSet({"My Model": model}, pred, "My Model")
    paths = ml.save_models(found, scratch_path(spark, "test-models"))
    assert paths["My Model"].endswith("my_model_model")
    again = ml.predict_table(ml.load_model(paths["best"]), test.rows, "m")
    gap = pred.join(again.select("row_id", F.col("score").alias("other")), "row_id")
    assert gap.filter(F.abs(F.col("score") - F.col("other")) > 1e-12).count() == 0
    assert gap.count() == test.n_rows


def test_ada_boost_weights_follow_the_definition(pair):
    """The second stump must be the best one for the reweighted rows."""
    train, _ = pair
    stumps = ml.ada_boost(3).fit(train.rows).fitted
    rows = train.rows.collect()
    x = np.array([r["features"].toArray() for r in rows])
    y = np.array([r["label"] for r in rows])
    w = np.ones(len(y)) / len(y)
    for feature, threshold, left, right, alpha in stumps:
        said = np.where(x[:, feature] <= threshold, left, right)
        error = w[said != y].sum()
        assert alpha == pytest.approx(np.log((1 - error) / error), rel=1e-6)
        w = w * np.exp(alpha * (said != y))
        w /= w.sum()


def test_permuted_labels_score_like_chance(spark, sf):
    table = fx.emb_bin(spark, sf)
    shuffled = (F.conv(F.substring(split.row_hash(5), 1, 4), 16, 10).cast("long") % 2).cast("int")
    samples = ml.prepare(table.with_df(table.df.withColumn("label", shuffled)), folds=3)
    pred = selection.out_of_fold(samples, ml.logistic_regression(samples.n_rows, c=0.01), 3)
    assert abs(metrics.auc(pred, 1.0).first()["auc"] - 0.5) < 0.1


def test_same_seed_same_forest_after_repartition(spark, sf):
    table = fx.emb_bin(spark, sf)
    one = ml.prepare(table)
    two = ml.prepare(table.with_df(table.df.repartition(5)))
    forest = ml.random_forest(5, 4)
    assert np.allclose(
        ml.importances(forest.fit(one.rows)), ml.importances(forest.fit(two.rows))
    )


def test_grid_search_prefers_the_better_point(spark, pair):
    samples, _ = pair
    model = ml.logistic_regression(samples.n_rows, l1_ratio=1.0, max_iter=30)
    grid = [{model.regParam: r} for r in (10.0, 0.01)]
    found = ml.grid_search(samples, model, grid, folds=3)
    scores = [r["score"] for r in ml.search_scores(found, spark).orderBy("point").collect()]
    assert scores[1] > scores[0]
    assert found.bestModel.getOrDefault("regParam") == 0.01
    assert len(ml.param_maps(ml.random_forest(), ml.FOREST_GRID)) == 4


def test_method_evaluation_ranks_signal_over_noise(pair):
    samples, _ = pair
    judged = selection.evaluate_methods(
        samples, {"noise": [40, 41], "signal": [0, 1], "empty": []}, 3, ml.random_forest(10, 4)
    )
    rows = {r["method"]: r for r in judged.collect()}
    assert set(rows) == {"noise", "signal"}
    assert rows["signal"]["auc"] > 0.8 > rows["noise"]["auc"]
    assert selection.best_method(judged, ("noise", "signal")) == "signal"


def test_out_of_fold_scores_every_row_once(pair):
    samples, _ = pair
    pred = selection.out_of_fold(samples.select([0, 1]), ml.logistic_regression(samples.n_rows, max_iter=10), 3)
    assert pred.count() == pred.select("row_id").distinct().count() == samples.n_rows


def test_top_features_fall_back(pair):
    samples = pair[0].select(range(6))
    assert importance.top_features(None, samples, 2).count() == 2
    equal = importance.top_features(None, samples, 3, with_data=False)
    assert [r["feature"] for r in equal.orderBy("rank").collect()] == ["f0", "f1", "f2"]


def test_multiclass_models_report_every_class(spark, sf):
    table = fx.doc(spark, sf)
    table = table.with_df(table.df.withColumn("label", F.col("lang")))
    samples = ml.prepare(table)
    for build in (ml.logistic_regression(samples.n_rows, max_iter=20), ml.linear_svm(samples.n_rows, max_iter=5, n_classes=4), ml.ada_boost(4)):
        model = build.fit(samples.rows)
        pred = ml.predict_table(model, samples.rows, "m")
        report = ml.test_report(pred, samples).first()
        assert report["accuracy"] > 0.4 and 0 <= report["auc"] <= 1
    assert ml.importances(model) is None


def test_components_are_centred_and_signed(spark, sf):
    scores, ratio = explore.principal_components(fx.flawed(spark, sf))
    shares = [r["explained_variance_ratio"] for r in ratio.orderBy("component").collect()]
    assert shares[0] >= shares[1] > 0
    means = scores.agg(F.avg("pc1"), F.avg("pc2"), F.corr("pc1", "pc2")).first()
    assert np.allclose(list(means), 0, atol=1e-9)


def test_untrained_set_refuses_to_predict(pair):
    with pytest.raises(ValueError):
        ml.ModelSet().predict(pair[1].rows)


def test_components_without_a_covariance_are_the_same(spark, sf):
    table = fx.emb(spark, sf)
    direct, shares = explore.principal_components(table)
    passes, other = explore.principal_components(table, covariance_features=8)
    gap = direct.join(passes.select("row_id", F.col("pc1").alias("o1"), F.col("pc2").alias("o2")), "row_id")
    worst = gap.agg(F.max(F.abs(F.col("pc1") - F.col("o1"))), F.max(F.abs(F.col("pc2") - F.col("o2")))).first()
    assert max(worst) < 1e-3
    pairs = zip(shares.orderBy("component").collect(), other.orderBy("component").collect())
    assert all(abs(a[1] - b[1]) < 1e-6 for a, b in pairs)


def test_several_classes_are_searched_by_auc(spark, sf):
    table = fx.doc(spark, sf)
    samples = ml.prepare(table.with_df(table.df.withColumn("label", F.col("lang"))), folds=2)
    model = ml.logistic_regression(samples.n_rows, max_iter=20)
    found = ml.grid_search(samples, model, [{model.regParam: 0.01}], folds=2, metric="roc_auc")
    assert isinstance(found.getEvaluator(), ml.OneVsRestAuc) and 0.5 < found.avgMetrics[0] <= 1
    kernel = ml.rbf_svm(samples.n_rows, len(samples.names), max_iter=5, components=64, n_classes=samples.n_classes)
    pred = ml.predict_table(kernel.fit(samples.rows), samples.rows, "SVM")
    assert pred.filter(~F.col("score").between(0, 1)).count() == 0


def test_neighbours_refuse_missing_cells(spark, sf):
    from traitsieve.operators import knn

    with pytest.raises(Exception, match="impute before"):
        knn.nearest_neighbours(fx.emb(spark, sf), fx.miss(spark, sf), k=3).collect()


def test_forest_keeps_node_ids_and_is_the_same_forest(spark, sf):
    """Deep trees from cached node ids, whose lineage checkpoints cut, are those of walks from the root."""
    samples = ml.prepare(fx.emb_bin(spark, sf)).select(range(4))
    forest = ml.random_forest(5, 20)
    assert forest.getCacheNodeIds() and forest.getCheckpointInterval() > 0
    assert spark.sparkContext.getCheckpointDir()
    kept, walked = forest.fit(samples.rows), forest.copy().setCacheNodeIds(False).fit(samples.rows)
    assert kept.toDebugString == walked.toDebugString


@pytest.mark.parametrize(
    "numbers, tasks",
    [(0, 2), (1_000_001, 2), (7_000_000, 7), (12_000_000, 12), (39_000_000, 12), (192_000_000, 12), (320_000_000, 20)],
)
def test_partitions_of_a_fit_grow_before_they_become_more(numbers, tasks):
    """From twelve on, each one costs a tree fit the statistics of all its nodes once more."""
    assert session.fit_tasks(numbers) == tasks
