"""Model-based feature selectors and the comparison of selection methods."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitsieve.operators import models as ml
from traitsieve.operators import path
from traitsieve.operators.metrics import accuracy, cross_validated, cross_validated_classes
from traitsieve.operators.models import Samples
from traitsieve.operators.split import FOLDS, SEED, with_fold
from traitsieve.operators.univariate import (
    anova_f,
    mutual_information,
    ranked,
)

N_FEATURES = 100
# Grids that the selectors search by default (fixed values).
SELECTOR_GRIDS: dict = {
    "random_forest_importance": ml.FOREST_GRID,
    "rfe_random_forest": ml.FOREST_GRID,
    "lasso_regularization": ml.FULL_GRIDS["lasso_c"],
    "gradient_boosting_importance": {"maxIter": [50, 100], "stepSize": [0.05, 0.1]},
}
# The selectors' full grids (fixed values).
SELECTOR_FULL_GRIDS: dict = {
    "random_forest_importance": {
        "numTrees": [50, 100, 200],
        "maxDepth": [ml.UNLIMITED_DEPTH, 10, 20],
        "minInstancesPerNode": [1, 2, 4],
    },
    "rfe_random_forest": ml.FOREST_GRID,
    "lasso_regularization": ml.FULL_GRIDS["lasso_c"],
    "gradient_boosting_importance": {"maxIter": [50, 100, 200], "stepSize": [0.01, 0.1, 0.2], "maxDepth": [3, 5, 7]},
}
LASSO_FLOOR = 1e-5
# Names and order of the methods (fixed values; ties go by the order).
METHODS = (
    "univariate_f_test",
    "mutual_information",
    "random_forest_importance",
    "rfe_random_forest",
    "lasso_regularization",
    "gradient_boosting_importance",
)


def ranking(samples: Samples, scores: Sequence[float], k: int, kept: Sequence[int] | None = None) -> DataFrame:
    """``feature_idx, feature, score, rank`` from one score per feature."""
    chosen = range(len(samples.names)) if kept is None else kept
    rows = [(int(i), samples.names[i], float(scores[i])) for i in chosen]
    spark = samples.rows.sparkSession
    return ranked(
        spark.createDataFrame(rows, "feature_idx int, feature string, score double"), k
    )


def fit_tuned(
    samples: Samples, estimator: Estimator, grid: dict | list | None, metric: str = "roc_auc", folds: int = ml.GRID_FOLDS
):
    """Fit as given, or grid-search first when a grid is passed."""
    if not grid:
        return estimator.fit(samples.rows)
    return ml.grid_search(samples, estimator, grid, folds, metric).bestModel


def by_importance(samples: Samples, estimator: Estimator, k: int, grid: dict | None = None) -> DataFrame:
    """The ``k`` largest importances of a fitted forest or boosting."""
    return ranking(samples, ml.importances(fit_tuned(samples, estimator, grid)), k)


def recursive_elimination(
    samples: Samples, estimator: Estimator, k: int, step: int | float = 0.1, grid: dict | None = None
) -> DataFrame:
    """Drop the weakest features and refit until ``k`` are left.

    ``step`` is the number, or the share of the features at hand, dropped per fit;
    1 drops one at a time.  Each fit reads the cached rows through a slicer, so
    rounds do not stack up.  Scores are the importances of the last fit.
    """
    kept = list(range(len(samples.names)))
    if grid:
        best = ml.grid_search(samples, estimator, grid, metric="roc_auc").bestModel
        tuned = {estimator.getParam(name): best.getOrDefault(name) for name in grid}
        estimator = estimator.copy(tuned)
    while True:
        weight = ml.importances(estimator.fit(samples.select(kept).rows))
        surplus = len(kept) - k
        if surplus <= 0:
            break
        drop = step if isinstance(step, int) else max(1, int(step * len(kept)))
        order = sorted(range(len(kept)), key=lambda i: (weight[i], -kept[i]))
        gone = set(order[: min(drop, surplus)])
        kept = [f for i, f in enumerate(kept) if i not in gone]
    scores = np.zeros(len(samples.names))
    scores[kept] = weight
    return ranking(samples, scores, k, kept)


def lasso_model(
    samples: Samples,
    c: float = 0.1,
    grid_c: Sequence[float] = (),
    balanced: bool | Sequence[bool] = False,
    max_iter: int = 200,
    folds: int = ml.GRID_FOLDS,
):
    """The L1-logistic fit; strengths and class weights are searched first if there are several."""
    from traitsieve.operators.prep import with_class_weight

    weighing = [balanced] if isinstance(balanced, bool) else list(balanced)
    model = ml.logistic_regression(samples.n_rows, c, l1_ratio=1.0, max_iter=max_iter)
    maps = [
        {model.regParam: 1.0 / (x * samples.n_rows), **({model.weightCol: "weight"} if w else {})}
        for x in (grid_c or [c])
        for w in weighing
    ]
    if len(maps) == 1 and ml.on_path(samples, model, maps):
        point = path.as_points(model, maps)[0]
        return path.fit(samples.rows, point, len(samples.names), samples.n_classes)
    weighted = samples if not any(weighing) else replace(samples, rows=with_class_weight(samples.rows))
    return fit_tuned(weighted, model, maps, folds=folds)


def lasso(
    samples: Samples,
    k: int,
    c: float = 0.1,
    grid_c: Sequence[float] = (),
    balanced: bool | Sequence[bool] = False,
    max_iter: int = 200,
) -> DataFrame:
    """Features with an L1-logistic coefficient of at least 1e-5, at most ``k``.

    When none is that large, the ``k`` largest coefficients are taken.  ``grid_c``
    searches the strength first; ``balanced`` weighs classes inversely to size
    (``(False, True)`` searches that too).
    """
    return lasso_list(samples, lasso_model(samples, c, grid_c, balanced, max_iter), k)


def lasso_list(samples: Samples, fitted, k: int) -> DataFrame:
    # Several classes: a feature is as strong as its coefficients together.
    size = np.abs(fitted.coefficientMatrix.toArray()).sum(axis=0)
    kept = [i for i in range(len(size)) if size[i] >= LASSO_FLOOR]
    if not kept:
        return ranking(samples, np.abs(fitted.coefficientMatrix.toArray()[0]), k)
    return ranking(samples, size, k, kept)


def default_selectors(
    samples: Samples,
    k: int,
    forest: Estimator | None = None,
    boosting: Estimator | None = None,
    step: int | float = 0.1,
    grids: dict[str, dict | Sequence[float]] | None = None,
) -> dict[str, Callable[[], DataFrame]]:
    """The six methods by name; the model-based ones search their grids first.

    ``grids`` (``SELECTOR_GRIDS`` by default, ``SELECTOR_FULL_GRIDS`` has all points) has a grid by
    method; ``{}`` fits as given.  The lasso's search tries each strength with and without class weights.
    """
    grids = SELECTOR_GRIDS if grids is None else grids
    forest = ml.random_forest() if forest is None else forest
    if boosting is None:
        boosting = ml.gradient_boosting(depth=3, n_classes=samples.n_classes)
    return {
        "univariate_f_test": lambda: ranked(anova_f(samples.table, complete=True), k),
        "mutual_information": lambda: ranked(
            mutual_information(samples.table, rows=samples.n_rows, classes=samples.n_classes), k
        ),
        "random_forest_importance": lambda: by_importance(
            samples, forest, k, grids.get("random_forest_importance")
        ),
        "rfe_random_forest": lambda: recursive_elimination(
            samples, forest, k, step, grids.get("rfe_random_forest")
        ),
        "lasso_regularization": lambda: lasso(
            samples, k, grid_c=grids.get("lasso_regularization", ()),
            balanced=(False, True) if grids.get("lasso_regularization") else False,
        ),
        "gradient_boosting_importance": lambda: by_importance(
            samples, boosting, k, grids.get("gradient_boosting_importance")
        ),
    }


def listed(selection: DataFrame) -> dict[str, list[int]]:
    """Feature positions per method, in rank order (a few short lists)."""
    lists: dict[str, list[int]] = {}
    for r in selection.select("method", "rank", "feature_idx").orderBy("method", "rank").collect():
        lists.setdefault(r["method"], []).append(r["feature_idx"])
    return lists


def out_of_fold(samples: Samples, estimator: Estimator, folds: int = FOLDS, name: str = "model") -> DataFrame:
    """Prediction table in which every row is scored by a model that never saw it."""
    rows = samples.rows
    if "fold" not in rows.columns:
        rows = with_fold(rows, folds, SEED, eager=True)
    parts = [
        ml.predict_table(
            estimator.fit(rows.filter(F.col("fold") != i)),
            rows.filter(F.col("fold") == i),
            name,
            samples.positive,
        )
        for i in range(folds)
    ]
    return reduce(DataFrame.unionByName, parts)


def fold_metrics(pred: DataFrame, samples: Samples) -> DataFrame:
    """Mean and deviation of accuracy and AUC over folds, for any number of classes."""
    if samples.n_classes == 2:
        return cross_validated(pred, float(samples.positive), rows=samples.n_rows)
    return cross_validated_classes(pred, samples.n_classes, rows=samples.n_rows)


def evaluate_methods(
    samples: Samples,
    lists: dict[str, list[int]],
    folds: int = FOLDS,
    judge: Estimator | None = None,
    grid: dict | None = None,
) -> DataFrame:
    """``method, auc, accuracy, std_auc, std_accuracy``: CV of a forest on each list.

    The lists were chosen on the same rows, so the figures are optimistic.  A
    method whose list is empty has no row here and scores 0 on the scoreboard.
    """
    judge = ml.random_forest() if judge is None else judge
    tables = []
    for method, features in lists.items():
        if not features:
            continue
        chosen = samples.select(features)
        model = judge
        if grid:
            best = ml.grid_search(chosen, judge, grid, metric="roc_auc").bestModel
            model = judge.copy({judge.getParam(n): best.getOrDefault(n) for n in grid})
        tables.append(out_of_fold(chosen, model, folds, method))
    pred = reduce(DataFrame.unionByName, tables)
    return fold_metrics(pred, samples).select(
        F.col("model").alias("method"),
        F.col("mean_auc").alias("auc"),
        F.col("mean_accuracy").alias("accuracy"),
        "std_auc",
        "std_accuracy",
    )


def score_by_accuracy(
    samples: Samples, lists: dict[str, list[int]], folds: int = FOLDS, trees: int = 50
) -> DataFrame:
    """The plain scoring: fixed forest, accuracy only, no tuning."""
    judge = ml.random_forest(trees)
    tables = [out_of_fold(samples.select(f), judge, folds, m) for m, f in lists.items() if f]
    pred = reduce(DataFrame.unionByName, tables)
    folded = accuracy(pred, ["model", "fold"])
    return folded.groupBy(F.col("model").alias("method")).agg(F.avg("accuracy").alias("accuracy"))


def best_method(scores: DataFrame, order: Sequence[str] = METHODS) -> str:
    """Highest AUC; the earlier method on ties."""
    place = {m: i for i, m in enumerate(order)}
    rows = scores.select("method", "auc").collect()
    return min(rows, key=lambda r: (-r["auc"], place.get(r["method"], len(place))))["method"]
