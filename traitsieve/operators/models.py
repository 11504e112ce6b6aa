"""Classifiers: estimators, grids, grid search, prediction tables, persistence.

Models are ``pyspark.ml`` estimators over a column ``features`` and a numeric
``label`` 0..k-1.  Parameter names follow Spark; the inverse strength C of the
linear models maps to ``regParam = 1 / (C * rows)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    Evaluator,
    MulticlassClassificationEvaluator,
)
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitsieve.functions.session import stable_layout
from traitsieve.operators import path
from traitsieve.operators.adaboost import AdaBoost
from traitsieve.operators.fourier import FourierFeatures
from traitsieve.operators.knn import NEIGHBOURS
from traitsieve.operators.knn_model import KNearest
from traitsieve.operators.metrics import (
    accuracy,
    model_metrics,
    one_vs_rest_auc,
    weighted_metrics,
)
from traitsieve.operators.prep import (
    NEGATIVE_OF_PAIR,
    POSITIVE_OF_PAIR,
    encode_labels,
    min_max_scores,
    standardise,
)
from traitsieve.operators.stages import LabelNames, PreparedFeatures
from traitsieve.operators.split import SEED, with_fold
from traitsieve.table import FeatureTable

UNLIMITED_DEPTH = 30
GRID_FOLDS = 3
#: A label with more values than this is not a class.
CLASSES_MOST = 10_000


@dataclass(frozen=True)
class Samples:
    """Rows ready for a fit: ``row_id, label (double code), features``, cached."""

    rows: DataFrame
    names: tuple[str, ...]
    n_rows: int
    n_classes: int
    table: FeatureTable
    positive: int = 1
    preparation: PreparedFeatures | None = None
    labels: LabelNames | None = None

    def select(self, indices: Sequence[int]) -> Samples:
        indices = [int(i) for i in indices]
        slicer = VectorSlicer(inputCol="features", outputCol="_chosen", indices=indices)
        chosen = slicer.transform(self.rows).drop("features").withColumnRenamed("_chosen", "features")
        return replace(
            self,
            rows=chosen,
            names=tuple(self.names[i] for i in indices),
            table=self.table.select(indices),
            preparation=self.preparation.chosen(indices) if self.preparation else None,
        )

    def release(self) -> None:
        self.rows.unpersist()


def prepare(
    table: FeatureTable,
    fit_on: FeatureTable | None = None,
    scale: bool = True,
    folds: int | None = None,
    missing: str = "mean",
) -> Samples:
    """Standardise, encode and lay out a complete table for repeated fits.

    ``missing`` is the rule by which the fitted pipeline fills cells of raw rows.
    """
    source = table if fit_on is None else fit_on
    # One row per class comes back.
    counted = table.df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(CLASSES_MOST + 1)
    sizes = {r["label"]: r["n"] for r in counted.collect()}
    if len(sizes) > CLASSES_MOST:
        raise ValueError(f"the label has more than {CLASSES_MOST} values")
    n_rows, pair = sum(sizes.values()), {str(c) for c in sizes} == {POSITIVE_OF_PAIR, NEGATIVE_OF_PAIR}
    scaled = standardise(table, fit_on=source, complete=True) if scale else table
    coded = encode_labels(scaled.df, fit_on=source.df)
    coded = coded.withColumn("label", F.col("code").cast("double")).drop("code")
    if folds:
        coded = with_fold(coded, folds, eager=True)
    ready = scaled.with_df(coded)
    keep = ["row_id", "label", "features", *(["fold"] if folds else [])]
    rows = stable_layout(ready.vectors().select(*keep), n_rows, table.width)
    return Samples(
        rows, table.names, n_rows, len(sizes), _from_cache(ready, rows), positive=0 if pair else 1,
        preparation=PreparedFeatures.fitted(source, missing=missing, scale=scale) if fit_on is None else None,
        labels=LabelNames.fitted(source.df) if fit_on is None else None,
    )


def _from_cache(table: FeatureTable, rows: DataFrame) -> FeatureTable:
    """The same table read from the cached rows, so later statistics reuse them."""
    return table.with_df(
        rows.select("row_id", "label", vector_to_array("features").alias("values"))
    )


# --- estimators --------------------------------------------------------------------


def random_forest(trees: int = 100, depth: int = 10, seed: int = SEED, **params) -> Estimator:
    # With cached node ids a pass takes no row down its trees again; the forest is the same.
    return RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", cacheNodeIds=True, **params
    )


def gradient_boosting(
    rounds: int = 100, depth: int = 5, step: float = 0.1, subsample: float = 1.0,
    n_classes: int = 2, seed: int = SEED,
) -> Estimator:
    boosted = GBTClassifier(
        maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=subsample, seed=seed
    )
    return boosted if n_classes == 2 else OneVsRest(classifier=boosted)


def ada_boost(rounds: int = 100, learning_rate: float = 1.0, seed: int = SEED) -> Estimator:
    return AdaBoost(rounds=rounds, learningRate=learning_rate, seed=seed)


def logistic_regression(
    n_rows: int, c: float = 1.0, l1_ratio: float = 0.0, max_iter: int = 100, weight: str | None = None
) -> Estimator:
    model = LogisticRegression(
        regParam=1.0 / (c * n_rows), elasticNetParam=l1_ratio, maxIter=max_iter, standardization=False
    )
    return model.setWeightCol(weight) if weight else model


def linear_svm(n_rows: int, c: float = 1.0, max_iter: int = 50, n_classes: int = 2) -> Estimator:
    """Linear SVM; with two classes a logistic fit on the margin gives probabilities."""
    svm = LinearSVC(
        regParam=1.0 / (c * n_rows), maxIter=max_iter, standardization=False,
        rawPredictionCol="rawPrediction" if n_classes > 2 else "margin",
    )
    if n_classes > 2:
        return OneVsRest(classifier=svm)
    return Pipeline(stages=[svm, *_calibration()])


def k_nearest(k: int = NEIGHBOURS, weights: str = "uniform", p: int = 2) -> Estimator:
    return KNearest(k=k, weights=weights, p=p)


def _calibration() -> list:
    return [
        VectorSlicer(inputCol="margin", outputCol="margin_1", indices=[1]),
        LogisticRegression(featuresCol="margin_1", predictionCol="calibrated_prediction"),
    ]


def rbf_svm(
    n_rows: int, width: int, c: float = 1.0, gamma: float | None = None, components: int = 1024,
    max_iter: int = 50, seed: int = SEED, n_classes: int = 2,
) -> Estimator:
    """SVM with an RBF kernel, approximated by random Fourier features; one against the rest
    for more than two classes.

    ``gamma`` defaults to 1 / width, which is right for standardised features.
    """
    lifted = FourierFeatures(
        inputCol="features", outputCol="lifted", components=components, width=width,
        gamma=1.0 / width if gamma is None else gamma, seed=seed,
    )
    svm = LinearSVC(
        featuresCol="lifted", regParam=1.0 / (c * n_rows), maxIter=max_iter, standardization=False,
        rawPredictionCol="rawPrediction" if n_classes > 2 else "margin",
    )
    if n_classes > 2:
        return Pipeline(stages=[lifted, OneVsRest(classifier=svm, featuresCol="lifted")])
    return Pipeline(stages=[lifted, svm, *_calibration()])


# --- grids -------------------------------------------------------------------------

# Full parameter grids per model family (fixed values).
FULL_GRIDS = {
    "forest": {
        "numTrees": [100, 200, 300],
        "maxDepth": [UNLIMITED_DEPTH, 10, 20],
        "minInstancesPerNode": [1, 2, 4],
    },
    "boosting": {
        "maxIter": [100, 200, 300],
        "stepSize": [0.01, 0.05, 0.1, 0.2],
        "maxDepth": [3, 5, 7],
        "subsamplingRate": [0.8, 0.9, 1.0],
    },
    "ada_boost": {"rounds": [50, 100, 200], "learningRate": [0.01, 0.1, 1.0]},
    "logistic_c": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0],
    "logistic_l1": [0.0, 0.5, 1.0],
    "svm_c": [0.1, 1.0, 10.0],
    "lasso_c": [0.001, 0.01, 0.1, 1.0, 10.0],
    "knn": {"k": [3, 5, 7, 9, 11, 15], "weights": ["uniform", "distance"], "p": [1, 2]},
}

# The grid of the elimination's and the judge's forest (fixed values).
FOREST_GRID = {"numTrees": [50, 100], "maxDepth": [UNLIMITED_DEPTH, 10]}


def param_of(estimator: Estimator, name: str):
    """A parameter by name, of the estimator or of the one it wraps."""
    if estimator.hasParam(name):
        return estimator.getParam(name)
    inner = estimator.getStages() if isinstance(estimator, Pipeline) else [estimator.getClassifier()]
    return next(s.getParam(name) for s in inner if s.hasParam(name))


def param_maps(estimator: Estimator, grid: dict[str, Sequence]) -> list[dict]:
    """Every combination of a name -> values grid as Spark parameter maps."""
    maps: list[dict] = [{}]
    for name, values in grid.items():
        param = param_of(estimator, name)
        maps = [{**m, param: v} for m in maps for v in values]
    return maps


class OneVsRestAuc(Evaluator):
    """Macro mean of the exact one-vs-rest AUCs, for any number of classes."""

    def __init__(self, n_classes: int) -> None:
        super().__init__()
        self.n_classes = n_classes

    def _evaluate(self, dataset: DataFrame) -> float:
        pred = dataset.select(F.lit("m").alias("model"), "label", class_scores(dataset).alias("scores"))
        return one_vs_rest_auc(pred, [float(c) for c in range(self.n_classes)]).first()["auc"]

    def isLargerBetter(self) -> bool:
        return True


def evaluator(metric: str, n_classes: int):
    """``roc_auc`` (exact; one against the rest for several classes) or ``accuracy``."""
    if metric == "roc_auc" and n_classes == 2:
        return BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0)
    if metric == "roc_auc":
        return OneVsRestAuc(n_classes)
    if metric == "accuracy":
        return MulticlassClassificationEvaluator(metricName="accuracy")
    raise ValueError(f"unknown metric {metric!r}")


def grid_search(
    samples: Samples,
    estimator: Estimator,
    grid: dict[str, Sequence] | list[dict],
    folds: int = GRID_FOLDS,
    metric: str = "roc_auc",
    parallelism: int = 2,
    seed: int = SEED,
) -> CrossValidatorModel | path.PathSearch:
    """Cross-validate every grid point on stratified folds and refit the best on all.

    Logistic grids over strength, share of L1 and class weights are fitted in shared scans.
    """
    maps = param_maps(estimator, grid) if isinstance(grid, dict) else grid
    rows = samples.rows
    if "fold" not in rows.columns:
        rows = with_fold(rows, folds, seed, eager=True)
    if on_path(samples, estimator, maps):
        found, _ = path.search(
            rows, estimator, maps, len(samples.names), samples.n_classes, samples.n_rows, metric, samples.positive
        )
        found.evaluator = evaluator(metric, samples.n_classes)
        return found
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=maps,
        evaluator=evaluator(metric, samples.n_classes),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    )
    return search.fit(rows)


def with_params(estimator: Estimator, values: dict[str, object]) -> Estimator:
    """A copy with parameters set by name, wrapped ones too."""
    return estimator.copy({param_of(estimator, name): v for name, v in values.items()})


def on_path(samples: Samples, estimator: Estimator, maps: Sequence[dict]) -> bool:
    """Can the grid be fitted in shared scans?  Wider models go to the library's own search."""
    if not isinstance(estimator, LogisticRegression):
        return False
    shared = {estimator.regParam, estimator.elasticNetParam, estimator.weightCol}
    return all(set(m) <= shared for m in maps) and path.fits(len(samples.names), samples.n_classes)


def described(point: dict) -> str:
    """A parameter map in words, parameters in the order of their names."""
    return ", ".join(f"{p.name}={v}" for p, v in sorted(point.items(), key=lambda e: e[0].name))


def search_scores(found: CrossValidatorModel | path.PathSearch, spark) -> DataFrame:
    """``point, params, score`` of a grid search, best first by rank."""
    points = [
        (i, described(m), float(s))
        for i, (m, s) in enumerate(zip(found.getEstimatorParamMaps(), found.avgMetrics))
    ]
    return spark.createDataFrame(points, "point int, params string, score double")


# --- training and prediction -------------------------------------------------------


def class_scores(scored: DataFrame):
    """Array of a model's probabilities, or of its margins where it gives none."""
    return vector_to_array(next(c for c in ("probability", "rawPrediction") if c in scored.columns))


def predict_table(model: Model, rows: DataFrame, name: str, positive: int = 1) -> DataFrame:
    """``model, row_id, label, prediction, score, scores`` for any fitted model.

    ``score`` belongs to the positive class; ``scores`` has one entry per class.  A
    model without probabilities gives margins; its ``score`` is then scaled to 0..1.
    """
    scored = model.transform(rows)
    scores = class_scores(scored)
    keep = [c for c in ("fold",) if c in scored.columns]
    table = scored.select(
        F.lit(name).alias("model"),
        "row_id",
        F.col("label").cast("double").alias("label"),
        *keep,
        F.col("prediction").cast("double").alias("prediction"),
        F.get(scores, F.lit(positive)).alias("score"),
        scores.alias("scores"),
    )
    return table if "probability" in scored.columns else min_max_scores(table)


def importances(model: Model) -> np.ndarray | None:
    """Tree importances, else absolute coefficients of the first class, else nothing."""
    if isinstance(model, CrossValidatorModel):
        return importances(model.bestModel)
    if isinstance(model, PipelineModel):
        if any(isinstance(s, FourierFeatures) for s in model.stages):
            return None
        return importances(model.stages[0])
    if hasattr(model, "featureImportances"):
        return np.asarray(model.featureImportances.toArray())
    if hasattr(model, "coefficientMatrix"):
        return np.abs(model.coefficientMatrix.toArray()[0])
    if hasattr(model, "coefficients"):
        return np.abs(model.coefficients.toArray())
    if hasattr(model, "models"):
        parts = [importances(m) for m in model.models]
        return None if any(p is None for p in parts) else np.mean(parts, axis=0)
    return None


@dataclass
class ModelSet:
    """Fitted models by name, their predictions and the name of the best.

    ``searched`` has the cross-validated score and the chosen parameters in words of models
    that a grid was searched for, ``chosen`` the parameters by name.  With ``preparation`` and ``labels`` a model goes
    out as a whole pipeline, from raw rows to label names.
    """

    models: dict[str, Model] = field(default_factory=dict)
    predictions: DataFrame | None = None
    best: str | None = None
    positive: int = 1
    searched: dict[str, tuple[float, str]] = field(default_factory=dict)
    chosen: dict[str, dict[str, object]] = field(default_factory=dict)
    preparation: PreparedFeatures | None = None
    labels: LabelNames | None = None

    def search_table(self, spark) -> DataFrame:
        """``model, cv_score, best_params`` of the models that a grid was searched for."""
        rows = [(name, score, params) for name, (score, params) in self.searched.items()]
        return spark.createDataFrame(rows, "model string, cv_score double, best_params string")

    @property
    def best_model(self) -> Model:
        if self.best is None:
            raise ValueError("no model trained; call train_models first")
        return self.models[self.best]

    def predict(self, rows: DataFrame) -> DataFrame:
        """Prediction table of the best model for prepared rows."""
        return predict_table(self.best_model, rows, self.best, self.positive)

    def pipeline(self, name: str | None = None) -> PipelineModel:
        """Preparation, model and label names as one model over raw rows."""
        model = self.models[name] if name else self.best_model
        before = [self.preparation] if self.preparation else []
        return PipelineModel(stages=[*before, model, *([self.labels] if self.labels else [])])


def default_models(samples: Samples, tune: bool = False) -> dict[str, Estimator | tuple[Estimator, dict]]:
    """The model set by name; with ``tune`` each model comes with its full grid."""
    n, k, width = samples.n_rows, samples.n_classes, len(samples.names)
    models = {
        "RandomForest": random_forest(),
        "GradientBoosting": gradient_boosting(n_classes=k),
        "AdaBoost": ada_boost(),
        "SVM": rbf_svm(n, width, n_classes=k),
        "LinearSVM": linear_svm(n, n_classes=k),
        "LogisticRegression": logistic_regression(n),
        "KNN": k_nearest(),
    }
    if not tune:
        return models
    strengths = lambda cs: [1.0 / (c * n) for c in cs]
    svm = {"regParam": strengths(FULL_GRIDS["svm_c"])}
    grids = {
        "RandomForest": FULL_GRIDS["forest"],
        "GradientBoosting": FULL_GRIDS["boosting"],
        "AdaBoost": FULL_GRIDS["ada_boost"],
        "SVM": svm,
        "LinearSVM": svm,
        "LogisticRegression": {
            "regParam": strengths(FULL_GRIDS["logistic_c"]), "elasticNetParam": FULL_GRIDS["logistic_l1"],
        },
        "KNN": FULL_GRIDS["knn"],
    }
    return {name: (model, grids[name]) for name, model in models.items()}


def train_models(
    train: Samples, test: Samples, models: dict[str, Estimator | tuple[Estimator, dict]]
) -> ModelSet:
    """Fit every model, stack the test predictions, and name the most accurate.

    A model may come with a grid, which is then searched first.  Equal accuracies
    go to the model named first.
    """
    result = ModelSet(positive=train.positive, preparation=train.preparation, labels=train.labels)
    tables = []
    for name, model in models.items():
        if isinstance(model, tuple):
            found = grid_search(train, *model, metric="accuracy")
            result.models[name] = found.bestModel
            at = int(np.argmax(found.avgMetrics))
            point = found.getEstimatorParamMaps()[at]
            result.searched[name] = (float(found.avgMetrics[at]), described(point))
            result.chosen[name] = {p.name: v for p, v in point.items()}
        else:
            result.models[name] = model.fit(train.rows)
        tables.append(predict_table(result.models[name], test.rows, name, train.positive))
    result.predictions = reduce(DataFrame.unionByName, tables).persist()
    # One row per model.
    scores = {r["model"]: r["accuracy"] for r in accuracy(result.predictions).collect()}
    result.best = max(models, key=lambda m: scores.get(m, 0.0))
    return result


def model_folder(name: str) -> str:
    """Folder name of a model: lower case, spaces to underscores."""
    return name.replace(" ", "_").lower() + "_model"


def test_report(pred: DataFrame, samples: Samples, models: int = 1) -> DataFrame:
    """Figures per model: the six binary ones, or weighted ones for more classes.

    ``samples`` are the rows that the ``models`` predicted.
    """
    rows = samples.n_rows * models
    if samples.n_classes == 2:
        return model_metrics(pred, float(samples.positive), rows=rows)
    classes = [float(c) for c in range(samples.n_classes)]
    return (
        accuracy(pred)
        .join(one_vs_rest_auc(pred, classes, rows=rows * len(classes)), "model")
        .join(weighted_metrics(pred), "model")
    )


def save_models(found: ModelSet, folder: str) -> dict[str, str]:
    """Write every model and the best one, each with its preparation and label names."""
    paths = {}
    for name, model in found.models.items():
        paths[name] = f"{folder}/{model_folder(name)}"
        wrapped = found.pipeline(name)
        wrapped.write().overwrite().save(paths[name])
        if name == found.best:
            paths["best"] = f"{folder}/best_model"
            wrapped.write().overwrite().save(paths["best"])
    return paths


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
