"""The three end-to-end runs: feature selection, model comparison, and both."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitsieve.operators import importance, profile, selection
from traitsieve.operators import models as ml
from traitsieve.operators.compare import combined_features, feature_method_map, method_scoreboard
from traitsieve.operators.metrics import accuracy, compare_feature_sets, scoreboard
from traitsieve.operators.models import ModelSet, Samples
from traitsieve.operators.prep import impute
from traitsieve.operators.shape import align_features
from traitsieve.operators.split import (
    FOLDS,
    SEED,
    TEST_SHARE,
    predefined_split,
    train_test,
)
from traitsieve.operators.univariate import stacked
from traitsieve.operators.variance import (
    TOP_VARIANCE_FEATURES,
    feature_variance,
    top_by_variance,
)
from traitsieve.sources import sinks
from traitsieve.table import FeatureTable


@dataclass(frozen=True)
class SelectionRun:
    train: FeatureTable
    test: FeatureTable
    lists: DataFrame
    board: DataFrame
    best_method: str
    features: list[str]
    test_accuracy: float
    paths: dict[str, str]
    tuned_accuracy: float | None = None


@dataclass(frozen=True)
class ModelRun:
    full: ModelSet
    top: ModelSet
    metrics: DataFrame
    top_metrics: DataFrame
    comparison: DataFrame | None
    top_features: list[str]
    paths: dict[str, str]
    #: Beyond two classes: the weighted figures side by side.
    weighted_comparison: DataFrame | None = None


def split_table(
    table: FeatureTable, split_column: str | None, share: float, seed: int
) -> tuple[FeatureTable, FeatureTable]:
    """By a split column when there is one, else stratified at random."""
    if split_column is None:
        return train_test(table, share=share, seed=seed, eager=True)
    named = predefined_split(table.df, split_column)
    return tuple(
        table.with_df(named.filter(F.col("split") == part).drop("split")) for part in ("train", "test")
    )


def run_feature_selection(
    table: FeatureTable,
    folder: str,
    n_features: int = selection.N_FEATURES,
    top_variance: int = TOP_VARIANCE_FEATURES,
    methods: Sequence[str] = selection.METHODS,
    selectors: Callable[[Samples, int], dict[str, Callable[[], DataFrame]]] = selection.default_selectors,
    judge: Estimator | None = None,
    judge_grid: dict | None = None,
    folds: int = FOLDS,
    split_column: str | None = None,
    test_share: float = TEST_SHARE,
    variance_on: str = "train",
    missing: str = "mean",
    fmt: str = "parquet",
    seed: int = SEED,
    check_grid: dict | None = None,
) -> SelectionRun:
    """Validate, split, pre-filter by variance, run and compare the selectors, export.

    The variance filter sees raw values of the training part (``variance_on='all'``
    for the whole table); imputation and scaling are fitted on the training part.
    Without a ``judge`` of its own the run tunes one for each method's features on
    ``judge_grid`` (``FOREST_GRID`` by default).  If forest importance wins, a forest
    tuned on ``check_grid`` is checked on the test part too.
    """
    if judge is None and judge_grid is None:
        judge_grid = ml.FOREST_GRID
    profile.validate(table)
    train, test = split_table(table, split_column, test_share, seed)
    profile.check_pair(train, test)
    source = table if variance_on == "all" else train
    best = top_by_variance(feature_variance(source), top_variance)
    keep = sorted(r["feature_idx"] for r in best.select("feature_idx").collect())
    dropped = [n for i, n in enumerate(train.names) if i not in set(keep)]
    train, test = train.select(keep), test.select(keep)
    test = impute(test, missing, fit_on=train)
    train = impute(train, missing)

    samples = ml.prepare(train, folds=folds)
    chosen = selectors(samples, n_features)
    lists = stacked({m: chosen[m]() for m in methods}).persist()
    judged = selection.evaluate_methods(samples, selection.listed(lists), folds, judge, judge_grid).persist()
    best_name = selection.best_method(judged, methods)
    board = method_scoreboard(lists, judged, methods)
    indices = selection.listed(lists)[best_name]
    names = [train.names[i] for i in indices]

    held = ml.prepare(test, fit_on=train)
    plain, tuned = check_on_test(
        samples.select(indices), held.select(indices), ml.random_forest(seed=seed),
        (check_grid or ml.FULL_GRIDS["forest"]) if best_name == "random_forest_importance" else None,
    )
    pred = reduce(DataFrame.unionByName, [p for p in (plain, tuned) if p is not None])
    checked = {r["model"]: r["accuracy"] for r in accuracy(pred).collect()}  # two rows at most
    test_accuracy, tuned_accuracy = checked["plain"], checked.get("tuned")

    paths = sinks.write_selection(lists, folder, best_name, fmt)
    paths["scores"] = sinks.write_table(board, f"{folder}/method_scores.{fmt}", fmt)
    paths["feature_method_map"] = sinks.write_table(
        feature_method_map(lists, judged), f"{folder}/feature_method_map.{fmt}", fmt
    )
    paths["train"], paths["test"] = sinks.write_ml_ready(train, test, names, folder, fmt=fmt)
    combined = [r["feature"] for r in combined_features(lists).orderBy("rank").collect()]
    paths["all_train"], paths["all_test"] = sinks.write_ml_ready(
        train, test, combined, folder, fmt=fmt, name="ml_ready_all_methods"
    )
    summary = sinks.summary_row(
        table.df.sparkSession,
        data=F.struct(
            F.lit(samples.n_rows).alias("train_rows"),
            F.lit(held.n_rows).alias("test_rows"),
            F.lit(table.width).alias("features"),
            F.lit(train.width).alias("features_after_variance_filter"),
            F.lit(dropped).cast("array<string>").alias("features_dropped_by_variance"),
        ),
        best_method=best_name,
        selected=F.lit(names),
        methods=board.agg(
            F.sort_array(F.collect_list(F.struct("rank", "method", "n_features", "auc", "accuracy")))
        ).scalar(),
        test_accuracy=test_accuracy,
        tuned_test_accuracy=F.lit(tuned_accuracy).cast("double"),
        seed=seed,
    )
    paths["summary"] = sinks.write_summary(summary, f"{folder}/summary.json")
    return SelectionRun(train, test, lists, board, best_name, names, test_accuracy, paths, tuned_accuracy)


def check_on_test(
    train: Samples, test: Samples, forest: Estimator, grid: dict | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Test predictions of a plain forest and, with a grid, of one tuned by accuracy."""
    plain = ml.predict_table(forest.fit(train.rows), test.rows, "plain", train.positive)
    if not grid:
        return plain, None
    tuned = ml.grid_search(train, forest, grid, FOLDS, "accuracy").bestModel
    return plain, ml.predict_table(tuned, test.rows, "tuned", train.positive)


def run_models(
    train: FeatureTable,
    test: FeatureTable,
    folder: str,
    models: Callable[[Samples], dict[str, Estimator]] = ml.default_models,
    top_n: int = importance.TOP_FEATURES,
    missing: str = "mean",
    fmt: str = "parquet",
) -> ModelRun:
    """Train all models, pick the best, repeat on its top features, compare, export."""
    train, test = align_features(train, test)
    profile.validate(train)
    profile.check_pair(train, test)
    test = impute(test, missing, fit_on=train)
    train = impute(train, missing)
    fit, held = ml.prepare(train), ml.prepare(test, fit_on=train)

    chosen = models(fit)
    full = ml.train_models(fit, held, chosen)
    spark = train.df.sparkSession
    figures = ml.test_report(full.predictions, held, len(chosen))
    board = scoreboard(figures, order=list(chosen), searched=full.search_table(spark))
    ranking = importance.top_features(full.best_model, fit, min(top_n, train.width))
    top = importance.top_indices(ranking)
    names = [train.names[i] for i in top]
    # The model set is rebuilt for the narrower input: some models depend on its width.
    narrow = {name: m[0] if isinstance(m, tuple) else m for name, m in models(fit.select(top)).items()}
    tuned = {n: ml.with_params(m, full.chosen[n]) if n in full.chosen else m for n, m in narrow.items()}
    small = ml.train_models(fit.select(top), held.select(top), tuned)
    small_figures = ml.test_report(small.predictions, held, len(chosen))
    best = F.col("model") == full.best
    compared = compare_feature_sets(figures.filter(best), small_figures.filter(best))
    comparison, weighted = (compared, None) if fit.n_classes == 2 else (None, compared)

    paths = {f"all/{k}": v for k, v in ml.save_models(full, f"{folder}/all_features").items()}
    paths |= {f"top/{k}": v for k, v in ml.save_models(small, f"{folder}/top_features").items()}
    paths["top_features"] = sinks.write_table(ranking, f"{folder}/top_features.{fmt}", fmt)
    paths["train"], paths["test"] = sinks.write_ml_ready(train, test, names, folder, fmt=fmt)
    summary = sinks.summary_row(
        train.df.sparkSession,
        best_model=full.best,
        best_model_top_features=small.best,
        all_features=board.agg(F.sort_array(F.collect_list(F.struct("rank", *[c for c in board.columns if c != "rank"])))).scalar(),
        top_features=small_figures.agg(F.collect_list(F.struct("*"))).scalar(),
        selected=F.lit(names),
        train_rows=fit.n_rows,
        test_rows=held.n_rows,
    )
    paths["summary"] = sinks.write_summary(summary, f"{folder}/summary.json")
    return ModelRun(full, small, figures, small_figures, comparison, names, paths, weighted)


def run_all(
    table: FeatureTable,
    folder: str,
    models: Callable[[Samples], dict[str, Estimator]] = ml.default_models,
    top_n: int = importance.TOP_FEATURES,
    **options,
) -> tuple[SelectionRun, ModelRun]:
    """Feature selection, then the models on the best method's features."""
    chosen = run_feature_selection(table, f"{folder}/selection", **options)
    compared = run_models(
        chosen.train.select_names(chosen.features),
        chosen.test.select_names(chosen.features),
        f"{folder}/models",
        models,
        top_n,
    )
    return chosen, compared
