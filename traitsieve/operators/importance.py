"""Feature importance of fitted models and models on the top features only."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitsieve.operators import models as ml
from traitsieve.operators.metrics import compare_feature_sets
from traitsieve.operators.models import ModelSet, Samples
from traitsieve.operators.selection import ranking
from traitsieve.operators.univariate import mutual_information, ranked

TOP_FEATURES = 20


def feature_importance(model: Model, samples: Samples) -> DataFrame | None:
    """``feature_idx, feature, score, rank`` of every feature; None if unavailable."""
    weights = ml.importances(model)
    return None if weights is None else ranking(samples, weights, len(samples.names))


def top_features(
    model: Model | None, samples: Samples, n: int = TOP_FEATURES, with_data: bool = True
) -> DataFrame:
    """Best ``n`` features of a model; without importances, by mutual information,
    and without data either, all features alike."""
    weights = None if model is None else ml.importances(model)
    if weights is not None:
        return ranking(samples, weights, n)
    if with_data:
        return ranked(mutual_information(samples.table, rows=samples.n_rows, classes=samples.n_classes), n)
    return ranking(samples, np.ones(len(samples.names)), n)


def top_indices(ranking_: DataFrame) -> list[int]:
    return [r["feature_idx"] for r in ranking_.orderBy("rank").collect()]


def train_on_top(
    train: Samples, test: Samples, models: dict[str, Estimator], top: list[int]
) -> ModelSet:
    """The same models with the same parameters, fitted on the top features."""
    return ml.train_models(train.select(top), test.select(top), models)


def all_against_top(
    train: Samples, test: Samples, name: str, fresh: Estimator, top: list[int], full: DataFrame
) -> DataFrame:
    """Metric by metric: the best model on all features against its class, with
    default parameters, on the top features.  ``full`` holds the predictions of
    the former; weighted figures for more than two classes."""
    small = train_on_top(train, test, {name: fresh}, top)
    return compare_feature_sets(
        ml.test_report(full.filter(F.col("model") == name), test), ml.test_report(small.predictions, test)
    )
