"""Evaluation metrics as aggregations over a prediction table.

The table has one row per model and sample: ``model, row_id, label, prediction,
score``; labels and predictions share a type, the score rises with the positive
class.  Everything but the curve is derived from grouped counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitsieve.functions.columns import ratio
from traitsieve.functions.ordered import ROWS_PER_SLICE, running_totals, slice_edges

# The six figures of a model's report, in their usual order (fixed values).
METRICS = ("accuracy", "auc", "sensitivity", "specificity", "precision", "f1_score")


def contingency(pred: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    return pred.groupBy(*keys, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def accuracy(pred: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    hit = (F.col("label") == F.col("prediction")).cast("double")
    return pred.groupBy(*keys).agg(F.avg(hit).alias("accuracy"))


def confusion_matrix(pred: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Counts for every pair of labels, zeros included."""
    cells = contingency(pred, keys)
    # Classes per model is a small set; both sides of a pair are unfolded from it.
    classes = cells.select(*keys, F.explode(F.array("label", "prediction")).alias("c")).groupBy(
        *keys
    ).agg(F.collect_set("c").alias("cs"))
    grid = (
        classes.select(*keys, F.explode("cs").alias("label"), "cs")
        .select(*keys, "label", F.explode("cs").alias("prediction"))
    )
    return grid.join(cells, [*keys, "label", "prediction"], "left").select(
        *keys, "label", "prediction", F.coalesce("n", F.lit(0)).alias("n")
    )


def binary_metrics(
    pred: DataFrame, positive: Column | int | str, keys: Sequence[str] = ("model",)
) -> DataFrame:
    """Accuracy, sensitivity, specificity, precision and F1 of the positive label."""
    wanted = positive if isinstance(positive, Column) else F.lit(positive)
    cells = contingency(pred, keys).withColumn("_p", wanted)
    is_pos, said_pos = F.col("label") == F.col("_p"), F.col("prediction") == F.col("_p")

    def total(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).alias(name)

    counts = cells.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        total(F.col("label") == F.col("prediction"), "hits"),
        total(is_pos & said_pos, "tp"),
        total(~is_pos & ~said_pos, "tn"),
        total(~is_pos & said_pos, "fp"),
        total(is_pos & ~said_pos, "fn"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.select(
        *keys,
        ratio(F.col("hits"), F.col("n")).alias("accuracy"),
        ratio(tp, tp + fn).alias("sensitivity"),
        ratio(tn, tn + fp).alias("specificity"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def class_metrics(pred: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Precision, recall, F1 and support of every class."""
    none = F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(none)
    sides = F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("support"), none.alias("said"), hit.alias("tp")),
        F.struct(F.col("prediction").alias("c"), none.alias("support"), F.col("n").alias("said"), none.alias("tp")),
    )
    sums = (
        contingency(pred, keys)
        .select(*keys, F.explode(sides).alias("s"))
        .groupBy(*keys, F.col("s.c").alias("class"))
        .agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "said", "tp")])
    )
    tp = F.col("tp")
    return sums.select(
        *keys,
        "class",
        ratio(tp, F.col("said")).alias("precision"),
        ratio(tp, F.col("support")).alias("recall"),
        ratio(2 * tp, F.col("said") + F.col("support")).alias("f1"),
        "support",
    )


def weighted_metrics(pred: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Support-weighted precision, recall and F1."""
    weight = F.col("support")
    return class_metrics(pred, keys).groupBy(*keys).agg(
        *[
            ratio(F.sum(F.col(m) * weight), F.sum(weight)).alias(f"weighted_{m}")
            for m in ("precision", "recall", "f1")
        ]
    )


def class_report(pred: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Per-class rows, then the macro and the weighted average."""
    per_class = class_metrics(pred, keys)
    three = ("precision", "recall", "f1")
    support = F.col("support")
    averages = per_class.groupBy(*keys).agg(
        F.struct(F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in three]).alias("macro"),
        F.struct(
            F.lit("weighted avg").alias("class"),
            *[ratio(F.sum(F.col(m) * support), F.sum(support)).alias(m) for m in three],
        ).alias("weighted"),
        F.sum("support").alias("support"),
    )
    rows = averages.select(*keys, F.explode(F.array("macro", "weighted")).alias("r"), "support")
    return per_class.withColumn("class", F.col("class").cast("string")).unionByName(
        rows.select(*keys, "r.*", "support")
    )


def _is(column: str, positive: Column | int | str) -> Column:
    return F.col(column) == (positive if isinstance(positive, Column) else F.lit(positive))


def _score_counts(
    pred: DataFrame,
    positive: Column | int | str,
    keys: Sequence[str],
    rows: int | None,
    rows_per_slice: int,
    outcomes: bool = False,
) -> DataFrame:
    """Positives and negatives per distinct score with running sums by falling score.

    ``outcomes`` also counts hits, true positives and positive predictions, for
    which the table must have predictions.
    """
    flags = {"pos": _is("label", positive), "neg": ~_is("label", positive)}
    if outcomes:
        flags["hits"] = F.col("label") == F.col("prediction")
        flags["tp"] = _is("label", positive) & _is("prediction", positive)
        flags["said"] = _is("prediction", positive)
    down = (-F.col("score")).alias("down")
    grouped = pred.groupBy(*keys, down).agg(*[F.count_if(f).alias(n) for n, f in flags.items()])
    if rows is None:
        rows = pred.count()
    edges = slice_edges(pred.select(down), F.col("down"), rows, rows_per_slice) if rows > rows_per_slice else []
    return running_totals(grouped, keys, "down", {"pos": "cum_pos", "neg": "cum_neg"}, edges)


def _won() -> Column:
    """Pairs a score group decides: each negative is beaten by the positives above
    it and ties with its equals."""
    return F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0))


def _area() -> Column:
    return F.try_divide(_won(), F.sum("pos").cast("double") * F.sum("neg").cast("double"))


def _class_totals(pred: DataFrame, positive: Column | int | str, keys: Sequence[str]) -> DataFrame:
    wanted = positive if isinstance(positive, Column) else F.lit(positive)
    hit = F.col("label") == wanted
    return pred.groupBy(*keys).agg(
        F.count_if(hit).alias("n_pos"), F.count_if(~hit).alias("n_neg")
    )


def roc_curve(
    pred: DataFrame,
    positive: Column | int | str,
    keys: Sequence[str] = ("model",),
    origin: bool = True,
    rows: int | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """``threshold, fpr, tpr`` at every distinct score, optionally with (0, 0)."""
    counts = _score_counts(pred, positive, keys, rows, rows_per_slice)
    totals = _class_totals(pred, positive, keys)
    # One row per model: broadcast, since a model's scores must not meet in one task.
    curve = counts.join(F.broadcast(totals), list(keys)).select(
        *keys,
        (-F.col("down")).alias("threshold"),
        ratio(F.col("cum_neg"), F.col("n_neg")).alias("fpr"),
        ratio(F.col("cum_pos"), F.col("n_pos")).alias("tpr"),
    )
    if not origin:
        return curve
    start = totals.select(
        *keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionByName(curve)


def auc(
    pred: DataFrame,
    positive: Column | int | str,
    keys: Sequence[str] = ("model",),
    rows: int | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Exact area under the ROC curve; null when a class is absent."""
    counts = _score_counts(pred, positive, keys, rows, rows_per_slice)
    return counts.groupBy(*keys).agg(_area().alias("auc"))


def model_metrics(
    pred: DataFrame,
    positive: Column | int | str,
    keys: Sequence[str] = ("model",),
    rows: int | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """The six figures per key, all from one grouping of the predictions by score."""
    counts = _score_counts(pred, positive, keys, rows, rows_per_slice, outcomes=True)
    sums = counts.groupBy(*keys).agg(
        _area().alias("auc"), *[F.sum(c).alias(c) for c in ("pos", "neg", "hits", "tp", "said")]
    )
    pos, neg, tp, said = (F.col(c) for c in ("pos", "neg", "tp", "said"))
    return sums.select(
        *keys,
        ratio(F.col("hits"), pos + neg).alias("accuracy"),
        "auc",
        ratio(tp, pos).alias("sensitivity"),
        ratio(neg - (said - tp), neg).alias("specificity"),
        ratio(tp, said).alias("precision"),
        ratio(2 * tp, said + pos).alias("f1_score"),
    )


def one_vs_rest_auc(
    scores: DataFrame, classes: Sequence, keys: Sequence[str] = ("model",), rows: int | None = None
) -> DataFrame:
    """Macro mean of one-vs-rest AUCs from a table with an array column ``scores``."""
    per_class = scores.select(
        *keys,
        "label",
        F.posexplode("scores").alias("pos", "score"),
    ).withColumn("class", F.get(F.lit(list(classes)), F.col("pos")))
    if rows is None:
        rows = scores.count() * len(classes)
    wide_keys = [*keys, "class"]
    return (
        auc(per_class, F.col("class"), wide_keys, rows)
        .groupBy(*keys)
        .agg(F.avg("auc").alias("auc"))
    )


def scoreboard(
    metrics: DataFrame, by: str = "accuracy", order: Sequence[str] = (), searched: DataFrame | None = None
) -> DataFrame:
    """Add ``rank`` and ``is_best``; ties go to the model named first in ``order``.

    ``searched`` (``model, cv_score, best_params``) adds the outcome of each model's grid search.
    """
    if searched is not None:
        metrics = metrics.join(searched, "model", "left")
    place = F.array_position(F.lit(list(order)), F.col("model")) if order else F.col("model")
    w = Window.orderBy(F.desc_nulls_last(by), place)
    return metrics.withColumn("rank", F.row_number().over(w)).withColumn(
        "is_best", F.col("rank") == 1
    )


def compare_feature_sets(all_features: DataFrame, top_features: DataFrame) -> DataFrame:
    """``model, metric, all_features, top_features, higher`` side by side, for the figures at hand."""
    figures = [c for c in all_features.columns if c != "model" and c in top_features.columns]

    def tall(df: DataFrame, name: str) -> DataFrame:
        return df.unpivot(["model"], figures, "metric", name)

    a, t = F.col("all_features"), F.col("top_features")
    higher = F.when(a > t, "all_features").when(t > a, "top_features").otherwise("equal")
    return (
        tall(all_features, "all_features")
        .join(tall(top_features, "top_features"), ["model", "metric"])
        .withColumn("higher", higher)
    )


def cross_validated(
    pred: DataFrame, positive: Column | int | str, keys: Sequence[str] = ("model",), rows: int | None = None
) -> DataFrame:
    """Mean and population deviation of the fold accuracies and AUCs."""
    folds = model_metrics(pred, positive, [*keys, "fold"], rows)
    return folds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"),
        F.avg("accuracy").alias("mean_accuracy"),
        F.stddev_pop("accuracy").alias("std_accuracy"),
        F.avg("auc").alias("mean_auc"),
        F.stddev_pop("auc").alias("std_auc"),
    )


def cross_validated_classes(pred: DataFrame, n_classes: int, keys: Sequence[str] = ("model",), rows: int | None = None) -> DataFrame:
    """The same for any number of classes, with the macro mean of one-vs-rest AUCs."""
    by_fold, classes = [*keys, "fold"], [float(c) for c in range(n_classes)]
    area = one_vs_rest_auc(pred, classes, by_fold, None if rows is None else rows * n_classes)
    return accuracy(pred, by_fold).join(area, by_fold).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"),
        F.avg("accuracy").alias("mean_accuracy"),
        F.stddev_pop("accuracy").alias("std_accuracy"),
        F.avg("auc").alias("mean_auc"),
        F.stddev_pop("auc").alias("std_auc"),
    )
