"""Boosted stumps beside plain numpy, on values few enough that every cut is an edge."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from traitsieve.operators import adaboost
from traitsieve.operators.adaboost import AdaBoost


def frame(spark, x, y):
    rows = [(i, float(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_id long, label double, v array<double>").repartition(5)
    return df.withColumn("features", array_to_vector("v")).drop("v")


def plain(x, y, rounds, rate=1.0):
    """Errors of the stumps chosen one after the other by Gini impurity."""
    k, weight, errors = int(y.max()) + 1, np.ones(len(y)) / len(y), []
    margins = np.zeros((len(y), k))
    for _ in range(rounds):
        best = None
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                side = x[:, f] <= cut
                mass = [np.bincount(y[s], weight[s], k) for s in (side, ~side)]
                gini = sum(m.sum() - (m**2).sum() / m.sum() for m in mass)
                if best is None or gini < best[0] - 1e-12:
                    best = (gini, np.where(side, mass[0].argmax(), mass[1].argmax()))
        wrong = best[1] != y
        error = weight[wrong].sum()
        if error >= 1 - 1 / k:
            break
        alpha = rate * (math.log((1 - error) / error) + math.log(k - 1))
        margins[np.arange(len(y)), best[1]] += alpha
        weight = weight * np.where(wrong, math.exp(alpha), 1.0)
        weight /= weight.sum()
        errors.append(error)
    return margins, errors


@pytest.mark.parametrize("classes, features", [(2, adaboost.FEATURES), (3, adaboost.FEATURES), (2, 2)])
def test_equals_the_definition(spark, monkeypatch, classes, features):
    monkeypatch.setattr(adaboost, "FEATURES", features)
    rng = np.random.default_rng(classes)
    x = rng.integers(0, 12, (400, 5)).astype(float)
    y = np.clip((x[:, 1] + x[:, 3] + rng.integers(0, 6, 400)) // (27 / classes), 0, classes - 1).astype(int)
    model = AdaBoost(rounds=12, learningRate=0.7).fit(frame(spark, x, y))
    margins, errors = plain(x, y, 12, 0.7)
    assert len(model.fitted) == len(errors) >= 8
    got = model.transform(frame(spark, x, y)).orderBy("row_id").select("rawPrediction").collect()
    assert np.allclose([r[0].toArray() for r in got], margins, atol=1e-8)


def test_stops_where_it_must(spark):
    x = np.array([[0.0], [0.0], [1.0], [1.0]])
    assert len(AdaBoost(rounds=9).fit(frame(spark, x, np.array([0, 0, 1, 1]))).fitted) == 1
    with pytest.raises(ValueError, match="no stump"):
        AdaBoost(rounds=9).fit(frame(spark, np.ones((4, 1)), np.array([0, 1, 0, 1])))
    lone = AdaBoost(rounds=3).fit(frame(spark, np.ones((4, 1)), np.array([0, 1, 1, 1])))
    assert lone.transform(frame(spark, x, np.zeros(4))).where(F.col("prediction") != 1).count() == 0


def test_many_features_meet_in_parts(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 1_200))
    y = (x[:, 1_100] > 0.3).astype(int)
    first = AdaBoost(rounds=2).fit(frame(spark, x, y)).fitted[0]
    assert first[0] == 1_100 and abs(first[1] - 0.3) < 0.2
