"""The shared-scan path beside the library's own fits, and its optimality conditions."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from traitsieve.operators import models as ml
from traitsieve.operators import path
from traitsieve.operators.path import ALL_ROWS, Point
from traitsieve.sources import fixtures as fx


@pytest.fixture(scope="module")
def samples(spark):
    return ml.prepare(fx.emb_bin(spark, "/root/testdata/sf0.01"), folds=3)


@pytest.fixture(scope="module")
def several(spark):
    return ml.prepare(fx.emb(spark, "/root/testdata/sf0.01").select(range(12)), folds=3)


@pytest.mark.parametrize("l1", [0.0, 0.5, 1.0])
def test_equals_the_library(samples, l1):
    reg = 1.0 / samples.n_rows
    mine = path.fit(samples.rows, Point(reg, l1), 64, 2)
    theirs = LogisticRegression(regParam=reg, elasticNetParam=l1, maxIter=1000, tol=1e-12, standardization=False).fit(samples.rows)
    assert np.allclose(mine.coefficients.toArray(), theirs.coefficients.toArray(), atol=2e-3)
    assert mine.interceptVector[0] == pytest.approx(theirs.intercept, abs=2e-3)
    both = mine.transform(samples.rows).select("row_id", F.col("probability").alias("p"), F.col("prediction").alias("c")).join(
        theirs.transform(samples.rows), "row_id"
    )
    one = lambda c: F.get(vector_to_array(c), F.lit(1))
    far = both.agg(F.max(F.abs(one("p") - one("probability"))), F.count_if(F.col("c") != F.col("prediction"))).first()
    assert far[0] < 2e-3 and far[1] <= 1


def test_equals_the_library_for_classes(several):
    reg = 1.0 / several.n_rows
    mine = path.fit(several.rows, Point(reg, 0.0), 12, several.n_classes)
    theirs = LogisticRegression(regParam=reg, maxIter=1000, tol=1e-12, standardization=False).fit(several.rows)
    assert np.allclose(mine.coefficientMatrix.toArray(), theirs.coefficientMatrix.toArray(), atol=2e-3)


def plain_slope(x, y, w, mass):
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    return ((mass * (p - y)) @ np.c_[x, np.ones(len(x))]) / mass.sum()


def test_every_point_is_optimal(samples):
    rows = samples.rows.select("label", "fold", vector_to_array("features").alias("x")).collect()
    x, y, fold = (np.array([r[c] for r in rows], dtype=float) for c in ("x", "label", "fold"))
    model = ml.logistic_regression(samples.n_rows)
    maps = [
        {model.regParam: 1.0 / (c * samples.n_rows), model.elasticNetParam: l1, **({model.weightCol: "weight"} if b else {})}
        for c in (0.01, 1.0, 100.0) for l1 in (0.0, 0.5, 1.0) for b in (False, True)
    ]
    found, fits = path.search(samples.rows, model, maps, 64, 2, samples.n_rows)
    assert len(fits) == 18 * 4 and len(found.avgMetrics) == 18
    for point, fitted in fits.items():
        w = np.r_[fitted.coefficients.toArray(), fitted.interceptVector[0]]
        seen = fold != point.fold
        n = np.array([seen[y == c].sum() for c in (0, 1)])
        mass = seen * (n.sum() / (2 * n[y.astype(int)]) if point.balanced else 1.0)
        l1 = np.r_[np.full(64, point.reg * point.l1), 0.0]
        l2 = np.r_[np.full(64, point.reg * (1 - point.l1)), 0.0]
        s = plain_slope(x, y, w, mass) + l2 * w
        off = np.where(w != 0, np.abs(s + l1 * np.sign(w)), np.maximum(np.abs(s) - l1, 0))
        assert off.max() <= 1e-5 and off.max() <= 0.01 * point.reg, point


def test_scores_are_those_of_the_folds(samples):
    """The search's means equal metrics of predictions made fold by fold."""
    model = ml.logistic_regression(samples.n_rows)
    maps = [{model.regParam: 0.002}, {model.regParam: 0.2}]
    found, fits = path.search(samples.rows, model, maps, 64, 2, samples.n_rows, "accuracy")
    for i, m in enumerate(maps):
        right = []
        for f in range(3):
            fitted = fits[Point(m[model.regParam], 0.0, False, f)]
            held = fitted.transform(samples.rows.where(F.col("fold") == f))
            right.append(held.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0])
        assert found.avgMetrics[i] == pytest.approx(np.mean(right), abs=1e-12)
    assert found.bestModel.getOrDefault("regParam") == maps[int(np.argmax(found.avgMetrics))][model.regParam]
    assert fits[Point(0.2, 0.0, False, ALL_ROWS)].coefficients == found.models[1].coefficients


def test_points_in_groups_and_classes(several, monkeypatch):
    model = ml.logistic_regression(several.n_rows)
    maps = [{model.regParam: r, model.elasticNetParam: 0.5} for r in (0.001, 0.01, 0.1)]
    whole, _ = path.search(several.rows, model, maps, 12, several.n_classes, several.n_rows)
    monkeypatch.setattr(path, "FIGURES", 4_000)
    parts, _ = path.search(several.rows, model, maps, 12, several.n_classes, several.n_rows)
    assert np.allclose(whole.avgMetrics, parts.avgMetrics) and not path.fits(5_000, 2)


def test_saved_scores_reload(samples, tmp_path):
    fitted = path.fit(samples.rows, Point(0.01, 1.0), 64, 2)
    fitted.write().overwrite().save(str(tmp_path / "m"))
    assert path.LinearScores.load(str(tmp_path / "m")).coefficients == fitted.coefficients


def test_one_class_constant_and_empty_folds(spark):
    rows = spark.createDataFrame(
        [(i, float(i % 2), [1.0, 0.0, float(i)]) for i in range(12)], "row_id long, label double, values array<double>"
    )
    from pyspark.ml.functions import array_to_vector

    rows = rows.withColumn("features", array_to_vector("values")).withColumn("fold", (F.col("row_id") % 2).cast("int"))
    model = ml.logistic_regression(12)
    found, fits = path.search(rows, model, [{model.regParam: 0.1}], 3, 2, 12)
    assert all(np.isfinite(f.coefficients.toArray()).all() for f in fits.values())
    assert len(found.avgMetrics) == 1


def test_a_scan_in_which_no_loss_falls():
    none = np.zeros((0, 1, 5))
    assert path.violations(none, none, none, none).shape == (0,)
    two = np.ones((2, 1, 5))
    assert path.violations(two, two * 3, two, two * 0).tolist() == [4.0, 4.0]


def test_points_go_on_when_all_of_them_step_too_far(monkeypatch):
    """A bowl whose curvature is given as a third of what it is, so that the first steps go too far."""
    scans = []

    def scan(blocks, weights, folds, by_class):
        scans.append(len(weights))
        off = weights - 2.0
        return (off**2).sum(axis=(1, 2)) / 2, off, np.tile(np.eye(weights.shape[2]) / 3, (len(weights), 1, 1, 1))

    monkeypatch.setattr(path, "scan", scan)
    found = path.fit_points(None, [Point(1e-9)], 2, 2, np.ones((1, 2)))
    assert len(scans) > 2 and np.allclose(found, 2.0, atol=1e-4)


def test_large_coefficients_under_a_weak_penalty_reach_the_optimum(monkeypatch):
    """Curvature near the solver's own: what that adds may not move the optimum."""
    bend, goal = 1e-11, 1500.0

    def scan(blocks, weights, folds, by_class):
        off = bend * (weights - goal)
        return (off**2).sum(axis=(1, 2)) / bend / 2, off, np.tile(np.eye(weights.shape[2]) * bend, (len(weights), 1, 1, 1))

    monkeypatch.setattr(path, "scan", scan)
    reg = 1e-9
    found = path.fit_points(None, [Point(reg, 1.0)], 2, 2, np.ones((1, 2)))
    assert np.allclose(found[0, 0, :2], goal - reg / bend, rtol=1e-3)
