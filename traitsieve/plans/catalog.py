"""Every operator as a named query over the driver's tables.

Names follow the operator inventory; ``oracle.py`` states the same results in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traitsieve.functions.columns import rounded
from traitsieve.functions.session import scratch_path
from traitsieve.operators import (
    compare,
    explore,
    importance,
    knn,
    metrics,
    path,
    prep,
    profile,
    selection,
    shape,
    split,
)
from traitsieve.operators import models as ml
from traitsieve.operators import univariate as uni
from traitsieve.operators import variance as var
from traitsieve.plans.flows import check_on_test
from traitsieve.sources import fixtures as fx
from traitsieve.sources import sinks, tables
from traitsieve.table import FeatureTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

METHOD_ORDER = ("f_test", "binned_mi", "variance")
LIST_SIZE = 20


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded_doubles(df: DataFrame) -> DataFrame:
    """Round every double column to six places, for comparison across engines."""
    return df.select(*[rounded(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def cells(table: FeatureTable) -> DataFrame:
    return rounded_doubles(table.long(keep_missing=True).select("row_id", "feature_idx", "value"))


# --- projections and type handling -------------------------------------------------


@query
def separate_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(shape.separate_features(fx.read(spark, sf, "orders"), "o_orderstatus")[1])


@query
def drop_metadata_columns(spark: SparkSession, sf: str) -> DataFrame:
    kept, _ = shape.drop_metadata(
        fx.read(spark, sf, "orders"), "o_orderpriority", ("o_custkey", "o_orderdate")
    )
    return rounded_doubles(kept)


@query
def project_selected_features(spark: SparkSession, sf: str) -> DataFrame:
    table = fx.emb(spark, sf)
    best = var.top_by_variance(var.feature_variance(table, complete=True), 5)
    names = [r["feature"] for r in best.orderBy("rank").collect()]
    chosen = table.select_names(names)
    return rounded_doubles(
        chosen.long().select("row_id", chosen.name_of().alias("feature"), "feature_idx", "value")
    )


@query
def align_common_features(spark: SparkSession, sf: str) -> DataFrame:
    table = fx.emb(spark, sf)
    test = FeatureTable(table.df, tuple(f"f{i + 10}" for i in range(table.width)))
    _, aligned = shape.align_features(table, test)
    return rounded_doubles(aligned.long().select("row_id", aligned.name_of().alias("feature"), "value"))


@query
def narrow_numeric_types(spark: SparkSession, sf: str) -> DataFrame:
    return shape.narrow_plan(fx.read(spark, sf, "lineitem"))


@query
def predefined_split(spark: SparkSession, sf: str) -> DataFrame:
    return split.predefined_split(fx.split_source(spark, sf), "Category").select(
        "row_id", "label", "split"
    )


@query
def predefined_split_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return split.predefined_split(fx.split_source(spark, sf, named=False), "Category").select(
        "row_id", "label", "split"
    )


@query
def two_feature_projection(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(shape.two_features(fx.emb(spark, sf), "f0", "f1"))


# --- validation and profiling ------------------------------------------------------


@query
def missing_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(
        profile.feature_profile(fx.miss(spark, sf)).select("feature", "n_missing", "missing_fraction")
    )


@query
def missing_fraction_gate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(profile.excessive_missing(fx.miss(spark, sf, every=7)))


@query
def constant_features(spark: SparkSession, sf: str) -> DataFrame:
    return profile.constant_features(fx.flawed(spark, sf))


@query
def target_checks(spark: SparkSession, sf: str) -> DataFrame:
    return profile.target_checks(fx.doc(spark, sf).df)


@query
def dataset_gate(spark: SparkSession, sf: str) -> DataFrame:
    return profile.gate(fx.miss(spark, sf, every=7))


@query
def train_test_compatibility(spark: SparkSession, sf: str) -> DataFrame:
    table = fx.emb(spark, sf)
    train = table.filter(F.col("label") <= 7)
    test = table.filter(F.col("label") >= 6).select(range(50))
    return profile.compatibility(train, test)


@query
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    table = fx.flawed(spark, sf)
    return rounded_doubles(profile.quality_report(table, table.wide()))


@query
def class_distribution_by_split(spark: SparkSession, sf: str) -> DataFrame:
    table = fx.line(spark, sf)
    return profile.class_distribution(split.with_hash_flag(table.df), "is_test")


# --- preprocessing -----------------------------------------------------------------


@query
def impute_mean(spark: SparkSession, sf: str) -> DataFrame:
    return cells(prep.impute(fx.miss(spark, sf), "mean"))


@query
def impute_median(spark: SparkSession, sf: str) -> DataFrame:
    return cells(prep.impute(fx.miss(spark, sf), "median"))


@query
def drop_incomplete_rows(spark: SparkSession, sf: str) -> DataFrame:
    return cells(prep.impute(fx.miss_some(spark, sf), "drop"))


@query
def impute_zero(spark: SparkSession, sf: str) -> DataFrame:
    return cells(prep.impute(fx.miss(spark, sf), "zero"))


@query
def standardise_train_test(spark: SparkSession, sf: str) -> DataFrame:
    table = fx.flawed(spark, sf)
    train, _ = split.train_test(table)
    return cells(prep.standardise(table, fit_on=train, complete=True))


@query
def encode_target(spark: SparkSession, sf: str) -> DataFrame:
    return prep.encode_labels(fx.cust(spark, sf).select("row_id", "label"))


@query
def binary_target(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.line(spark, sf, "l_linestatus").df.select("row_id", "label")
    return prep.with_binary_target(rows)


@query
def decode_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.cust(spark, sf).select("row_id", "label")
    coded = prep.encode_labels(rows).select("row_id", "code")
    return prep.decode_labels(coded, rows, "code")


@query
def preprocess_train_test(spark: SparkSession, sf: str) -> DataFrame:
    train, test = prep.preprocess(*split.train_test(fx.miss(spark, sf), eager=True))
    both = train.with_df(compare.concat_rows(
        train.df.withColumn("part", F.lit("train")), test.df.withColumn("part", F.lit("test"))
    ))
    return rounded_doubles(
        both.df.select("row_id", "part", "label", F.posexplode("values").alias("feature_idx", "value"))
    )


@query
def min_max_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = fx.pred(spark, sf).select("model", "row_id", "score")
    return rounded_doubles(prep.min_max_scores(scores, by="model"))


@query
def balanced_class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(prep.with_class_weight(fx.doc(spark, sf).df.select("row_id", "label")))


# --- splits and folds --------------------------------------------------------------


@query
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return split.with_test_flag(fx.emb(spark, sf).df.select("row_id", "label"))


@query
def validation_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.emb(spark, sf).df.select("row_id", "label")
    return split.with_test_flag(rows, share=0.25, seed=7, stratify=False)


@query
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    return split.with_fold(fx.emb(spark, sf).df.select("row_id", "label"))


@query
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return split.with_hash_flag(fx.emb(spark, sf).df.select("row_id", "label"))


# --- variance ----------------------------------------------------------------------


@query
def feature_variance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(var.feature_variance(fx.miss(spark, sf)))


@query
def variance_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(var.above_threshold(_variances(spark, sf)))


@query
def top_variance_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(var.top_by_variance(_variances(spark, sf), LIST_SIZE))


@query
def variance_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(var.variance_summary(_variances(spark, sf)))


@query
def problem_features(spark: SparkSession, sf: str) -> DataFrame:
    return var.problem_features(_variances(spark, sf))


@query
def variance_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return var.variance_histogram(_variances(spark, sf))


@query
def log_variance_box(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(var.log_variance_box(_variances(spark, sf)))


def _variances(spark: SparkSession, sf: str) -> DataFrame:
    return var.feature_variance(fx.flawed(spark, sf), complete=True)


# --- univariate selectors ----------------------------------------------------------


@query
def anova_f_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(uni.anova_f(fx.miss(spark, sf)))


@query
def f_test_on_line_items(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(uni.ranked(uni.anova_f(fx.line(spark, sf), complete=True)))


@query
def mutual_information(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(uni.mutual_information(fx.emb(spark, sf)))


@query
def mutual_information_ties(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(uni.mutual_information(fx.doc(spark, sf)))


@query
def binned_mutual_information(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(uni.binned_mutual_information(fx.line(spark, sf)))


@query
def separating_features(spark: SparkSession, sf: str) -> DataFrame:
    """Of the 48 most variable features, the 20 that separate the labels best."""
    table = fx.emb(spark, sf)
    wide = var.top_by_variance(var.feature_variance(table, complete=True), 48)
    scores = uni.anova_f(table, complete=True).join(
        wide.select("feature_idx", "variance"), "feature_idx"
    )
    return rounded_doubles(uni.ranked(scores, LIST_SIZE))


# --- feature lists -----------------------------------------------------------------


def _selection(spark: SparkSession, sf: str) -> DataFrame:
    table = fx.emb_bin(spark, sf)
    variances = var.feature_variance(table, complete=True)
    return uni.stacked(
        {
            "variance": uni.ranked(variances.withColumnRenamed("variance", "score"), LIST_SIZE),
            "f_test": uni.ranked(uni.anova_f(table, complete=True), LIST_SIZE),
            "binned_mi": uni.ranked(uni.binned_mutual_information(table), LIST_SIZE),
        }
    )


def _method_scores(spark: SparkSession, sf: str, lists: DataFrame) -> DataFrame:
    """Cross-validated figures of a sign rule on the first feature of each list."""
    table = fx.emb_bin(spark, sf)
    folded = table.with_df(split.with_fold(table.df, folds=3))
    first = lists.filter("rank = 1").select("method", "feature_idx")
    cells = folded.df.select(
        "row_id", "label", "fold", F.posexplode("values").alias("feature_idx", "score")
    )
    rule = (F.col("score") > 0).cast("int").alias("prediction")
    # One row per method.
    oof = cells.join(F.broadcast(first), "feature_idx").select(
        "method", "row_id", "label", "fold", rule, "score"
    )
    return metrics.cross_validated(oof, 1, ["method"]).select(
        "method", F.col("mean_auc").alias("auc"), F.col("mean_accuracy").alias("accuracy")
    )


@query
def stacked_feature_lists(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(_selection(spark, sf))


@query
def feature_rankings(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(uni.ranked(uni.anova_f(fx.emb_bin(spark, sf), complete=True)))


@query
def combined_feature_set(spark: SparkSession, sf: str) -> DataFrame:
    return compare.combined_features(_selection(spark, sf))


@query
def pairwise_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(compare.pairwise_overlap(_selection(spark, sf)))


@query
def feature_method_map(spark: SparkSession, sf: str) -> DataFrame:
    lists = _selection(spark, sf).persist()
    return rounded_doubles(compare.feature_method_map(lists, _method_scores(spark, sf, lists)))


@query
def method_scoreboard(spark: SparkSession, sf: str) -> DataFrame:
    lists = _selection(spark, sf).persist()
    scores = _method_scores(spark, sf, lists)
    return rounded_doubles(compare.method_scoreboard(lists, scores, METHOD_ORDER))


@query
def unknown_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.emb(spark, sf).df
    return profile.unknown_classes(rows.filter(F.col("label") <= 7), rows.filter(F.col("label") >= 6))


@query
def concat_train_test_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.doc_wide(spark, sf).select("doc_id", "quality", "n_chars", "n_words")
    first = rows.filter("quality = 1").drop("n_words")
    return rounded_doubles(compare.concat_rows(first, rows.filter("quality = 0").drop("n_words")))


@query
def concat_feature_target_columns(spark: SparkSession, sf: str) -> DataFrame:
    wide = fx.doc_wide(spark, sf)
    features = wide.select(F.col("doc_id").alias("row_id"), "n_chars", "mean_word_length")
    target = fx.read(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), "toxic")
    return rounded_doubles(compare.concat_columns(features, target))


# --- metrics -----------------------------------------------------------------------


@query
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(metrics.accuracy(fx.pred(spark, sf)))


@query
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(fx.by_class(spark, sf))


@query
def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(metrics.binary_metrics(fx.pred(spark, sf), 1))


@query
def weighted_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(metrics.weighted_metrics(fx.by_class(spark, sf)))


def _n_pred(spark: SparkSession, sf: str) -> int:
    """Rows of the prediction table: two rules per labelled document."""
    return 2 * fx.read(spark, sf, "labels").count()


@query
def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(metrics.roc_curve(fx.pred(spark, sf), 1, origin=False, rows=_n_pred(spark, sf)))


@query
def auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(metrics.auc(fx.pred(spark, sf), 1, rows=_n_pred(spark, sf)))


@query
def auc_on_line_items(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(metrics.auc(fx.by_class(spark, sf), "R"))


@query
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(metrics.class_report(fx.by_class(spark, sf)))


@query
def model_scoreboard(spark: SparkSession, sf: str) -> DataFrame:
    """Each rule with its figures, and beside them the score and the name it won its folds with."""
    rows = _n_pred(spark, sf)
    folds = metrics.cross_validated(fx.pred(spark, sf, folds=3), 1, rows=rows)
    searched = folds.select(
        "model", F.col("mean_accuracy").alias("cv_score"), F.concat(F.lit("rule="), "model").alias("best_params")
    )
    figures = metrics.model_metrics(fx.pred(spark, sf), 1, rows=rows)
    return rounded_doubles(metrics.scoreboard(figures, searched=searched))


@query
def feature_set_comparison(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.pred(spark, sf)
    figures = metrics.model_metrics(rows, 1, rows=_n_pred(spark, sf))

    def of(rule: str) -> DataFrame:
        return figures.filter(F.col("model") == rule).withColumn("model", F.lit("rule"))

    return rounded_doubles(metrics.compare_feature_sets(of("letters"), of("calm")))


@query
def cross_validated_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_doubles(
        metrics.cross_validated(fx.pred(spark, sf, folds=3), 1, rows=_n_pred(spark, sf))
    )


# --- exploration -------------------------------------------------------------------


@query
def target_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return profile.class_distribution(fx.line(spark, sf).df)


@query
def target_by_cohort(spark: SparkSession, sf: str) -> DataFrame:
    return explore.target_by_cohort(fx.cust(spark, sf), "Dataset")


@query
def pca_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Per row: scores centred, uncorrelated, and no longer than the standardised row."""
    table = fx.emb(spark, sf)
    scores, _ = explore.principal_components(table)
    scaled = prep.standardise(table, complete=True).df
    length = F.aggregate("values", F.lit(0.0), lambda total, v: total + v * v)
    rows = scores.join(scaled.select("row_id", length.alias("squares")), "row_id").persist()
    whole = rows.agg(F.struct(F.avg("pc1").alias("m1"), F.avg("pc2").alias("m2"), F.corr("pc1", "pc2").alias("r")).alias("w")).scalar()
    return rows.select(
        "row_id", "label",
        (F.greatest(F.abs(whole["m1"]), F.abs(whole["m2"])) < 1e-9).alias("centred"),
        (F.abs(whole["r"]) < 1e-6).alias("uncorrelated"),
        (F.col("pc1") ** 2 + F.col("pc2") ** 2 <= F.col("squares") + 1e-9).alias("within_row"),
    )


@query
def pca_explained_variance(spark: SparkSession, sf: str) -> DataFrame:
    """Per component: its share is the variance of its scores, and above the even share."""
    table = fx.emb(spark, sf)
    scores, shares = explore.principal_components(table)
    spread = scores.agg(F.array(F.var_pop("pc1"), F.var_pop("pc2")).alias("v")).scalar()
    share = F.get(spread, F.col("component") - 1) / table.width
    return shares.select(
        "component",
        (F.abs(share - F.col("explained_variance_ratio")) < 1e-9).alias("is_variance_of_scores"),
        (F.col("explained_variance_ratio") >= 1.0 / table.width).alias("above_even_share"),
    )


# --- nearest neighbours ------------------------------------------------------------


@query
def nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    train, test = split.train_test(fx.emb(spark, sf), eager=True)
    return rounded_doubles(knn.nearest_neighbours(train, test, k=5, pivots=8, block_rows=128))


@query
def knn_classification(spark: SparkSession, sf: str) -> DataFrame:
    train, test = split.train_test(fx.emb_bin(spark, sf), eager=True)
    return rounded_doubles(knn.knn_classify(train, test, k=7, weights="distance", p=1))


# --- model-based selectors and models (fits; checked by rows and by the tests) -----


def _planted(spark: SparkSession, sf: str, folds: int | None = None) -> ml.Samples:
    return ml.prepare(fx.emb_bin(spark, sf), folds=folds)


def _planted_pair(spark: SparkSession, sf: str) -> tuple[ml.Samples, ml.Samples]:
    train, test = split.train_test(fx.emb_bin(spark, sf), eager=True)
    return ml.prepare(train), ml.prepare(test, fit_on=train)


def checked(pred: DataFrame, argmax: bool = True) -> DataFrame:
    """A prediction table as its rows and what must hold for any fit of them."""
    right = pred.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).scalar()
    best = (F.array_position("scores", F.array_max("scores")) - 1).cast("double")
    return pred.select(
        "model", "row_id", "label",
        F.col("score").between(0, 1).alias("score_in_range"),
        ((F.col("prediction") == best) if argmax else F.col("prediction").isin(0.0, 1.0)).alias("prediction_fits_scores"),
        (right > 0.5).alias("better_than_chance"),
    )


def checked_list(ranking: DataFrame) -> DataFrame:
    """A feature list as its ranks and what must hold for it: planted features first, scores falling."""
    by_rank = Window.orderBy("rank")  # one short list
    return ranking.select(
        "rank",
        (F.col("feature").isin("f0", "f1") == (F.col("rank") <= 2)).alias("planted_first"),
        F.coalesce(F.col("score") <= F.lag("score").over(by_rank), F.lit(True)).alias("falling"),
        (F.col("score") > 0).alias("positive"),
    )


def in_range(df: DataFrame, keys: list[str], figures: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).between(0, 1).alias(f"{c}_in_range") for c in figures])


def _fitted(spark: SparkSession, sf: str, name: str, build, argmax: bool = True) -> DataFrame:
    train, test = _planted_pair(spark, sf)
    model = build(train).fit(train.rows)
    return checked(ml.predict_table(model, test.rows, name), argmax)


@query
def forest_importance_selection(spark: SparkSession, sf: str) -> DataFrame:
    return checked_list(selection.by_importance(_planted(spark, sf), ml.random_forest(), LIST_SIZE))


@query
def boosting_importance_selection(spark: SparkSession, sf: str) -> DataFrame:
    found = selection.by_importance(_planted(spark, sf), ml.gradient_boosting(), LIST_SIZE)
    return checked_list(found)


@query
def forest_elimination_selection(spark: SparkSession, sf: str) -> DataFrame:
    found = selection.recursive_elimination(_planted(spark, sf), ml.random_forest(), LIST_SIZE, step=0.1)
    return checked_list(found)


@query
def logistic_elimination_selection(spark: SparkSession, sf: str) -> DataFrame:
    """One feature at a time."""
    samples = _planted(spark, sf)
    model = ml.logistic_regression(samples.n_rows)
    return checked_list(selection.recursive_elimination(samples, model, LIST_SIZE, step=1))


@query
def lasso_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Per feature: does its coefficient meet the optimality conditions, is it listed if it is large."""
    samples = _planted(spark, sf)
    model = selection.lasso_model(samples, c=0.1)
    chosen = selection.lasso_list(samples, model, LIST_SIZE).select("feature_idx", F.lit(True).alias("listed"))
    penalty = 1.0 / (0.1 * samples.n_rows)
    error = F.get(vector_to_array("probability"), F.lit(1)) - F.col("label")
    terms = model.transform(samples.rows).select(
        F.posexplode(F.transform(vector_to_array("features"), lambda x: x * error)).alias("feature_idx", "g")
    )
    size = F.get(F.lit(model.coefficients.toArray().tolist()), F.col("feature_idx"))
    slope = terms.groupBy("feature_idx").agg(F.avg("g").alias("g")).withColumn("w", size)
    tight = F.abs(F.col("g") + F.signum("w") * penalty) <= 0.02 * penalty
    largest = F.row_number().over(Window.orderBy(F.desc(F.abs("w")), "feature_idx"))
    slope = slope.withColumn("large", (largest <= LIST_SIZE) & (F.abs("w") >= selection.LASSO_FLOOR))
    return slope.join(chosen, "feature_idx", "left").select(
        F.col("feature_idx").cast("int").alias("feature_idx"),
        F.when(F.abs("w") > 1e-9, tight).otherwise(F.abs("g") <= penalty * 1.02).alias("optimal"),
        (F.coalesce("listed", F.lit(False)) == F.col("large")).alias("listed_if_large"),
    )


@query
def regularisation_path(spark: SparkSession, sf: str) -> DataFrame:
    """Six strengths on three folds and on all rows: does each coefficient meet the optimality conditions?

    The slopes are worked out here from the rows, not taken from the scans that fitted the points.
    """
    samples = _planted(spark, sf, folds=3)
    model = ml.logistic_regression(samples.n_rows, l1_ratio=1.0)
    strengths = {1.0 / (c * samples.n_rows): c for c in ml.FULL_GRIDS["logistic_c"]}
    maps = [{model.regParam: reg} for reg in strengths]
    _, fits = path.search(samples.rows, model, maps, len(samples.names), 2, samples.n_rows)
    weights = spark.createDataFrame(
        [
            (strengths[p.reg], p.reg, p.fold, [float(w) for w in (*m.coefficients.toArray(), m.interceptVector[0])])
            for p, m in fits.items()
        ],
        "c double, reg double, left_out int, w array<double>",
    )
    with_one = F.concat(vector_to_array("features"), F.array(F.lit(1.0)))  # the intercept's feature comes last
    rows = samples.rows.select("row_id", "fold", "label", with_one.alias("x")).where("x is not null")
    # rows that share a key count as one row, whose margin is the sum of theirs
    whole = rows.groupBy("row_id", F.col("fold").alias("own_fold"), "label").agg(
        vector_to_array(Summarizer.sum(array_to_vector("x"))).alias("whole")
    )
    met = rows.drop("label").join(whole.hint("merge"), "row_id").crossJoin(F.broadcast(weights))
    met = met.where("fold <> left_out and own_fold <> left_out")
    margin = F.aggregate(F.zip_with("whole", "w", lambda x, w: x * w), F.lit(0.0), lambda s, v: s + v)
    met = met.withColumn("e", 1 / (1 + F.exp(-margin)) - F.col("label")).where("e is not null")
    # a row and fit becomes one vector; tasks add the vectors up before anything travels
    pull = array_to_vector(F.transform("x", lambda x: x * F.col("e")))
    point = ["c", "reg", "left_out"]
    means = met.groupBy(*point).agg(vector_to_array(Summarizer.mean(pull)).alias("g"), F.first("w").alias("w"))
    slopes = means.select(*point, F.posexplode(F.arrays_zip("g", "w")).alias("feature_idx", "s"))
    slopes = slopes.select(*point, "feature_idx", "s.g", "s.w")
    penalty = F.when(F.col("feature_idx") < len(samples.names), F.col("reg")).otherwise(0.0)
    off = F.when(F.col("w") == 0, F.abs("g") - penalty).otherwise(F.abs(F.col("g") + F.signum("w") * penalty))
    return slopes.select(
        "c", F.col("left_out").alias("fold"), "feature_idx", (off <= 0.01 * F.col("reg") + 1e-12).alias("optimal")
    )


@query
def tuned_selections(spark: SparkSession, sf: str) -> DataFrame:
    """The first two features of three methods after a search; ``tuned``: the fit has one of the grid's points."""
    samples = _planted(spark, sf, folds=3)
    small = {
        "random_forest_importance": {"numTrees": [20, 40], "minInstancesPerNode": [1, 4]},
        "gradient_boosting_importance": {"maxIter": [5, 10], "maxDepth": [3, 5]},
        "lasso_regularization": [0.1, 1.0],
    }
    estimators = {
        "random_forest_importance": ml.random_forest(), "gradient_boosting_importance": ml.gradient_boosting(),
    }
    parts = []
    for method, estimator in estimators.items():
        found = ml.grid_search(samples, estimator, small[method])
        point = {name: found.bestModel.getOrDefault(name) for name in small[method]}
        ranking = selection.ranking(samples, ml.importances(found), 8)
        parts.append((method, ranking, all(v in small[method][n] for n, v in point.items())))
    fitted = selection.lasso_model(samples, grid_c=small["lasso_regularization"], balanced=(False, True))
    known = [1.0 / (c * samples.n_rows) for c in small["lasso_regularization"]]
    parts.append(("lasso_regularization", selection.lasso_list(samples, fitted, 8), fitted.getOrDefault("regParam") in known))
    return reduce(
        DataFrame.unionByName,
        [
            checked_list(r)
            .select(F.lit(m).alias("method"), "rank", "planted_first", "falling", F.lit(t).alias("tuned"))
            .where("rank <= 2")  # the lasso may list no more
            for m, r, t in parts
        ],
    )


@query
def lasso_selection_multiclass(spark: SparkSession, sf: str) -> DataFrame:
    samples = ml.prepare(fx.emb(spark, sf))
    found = selection.lasso(samples, LIST_SIZE, c=1.0, balanced=True)
    by_rank = Window.orderBy("rank")
    return found.select(
        "rank",
        F.coalesce(F.col("score") <= F.lag("score").over(by_rank), F.lit(True)).alias("falling"),
        (F.col("score") > 0).alias("positive"),
    )


@query
def evaluate_selection_methods(spark: SparkSession, sf: str) -> DataFrame:
    samples = _planted(spark, sf, folds=5)
    f_list = uni.ranked(uni.anova_f(samples.table, complete=True), 8)
    forest = ml.random_forest()
    lists = selection.listed(
        uni.stacked(
            {
                "univariate_f_test": f_list,
                "mutual_information": uni.ranked(uni.mutual_information(samples.table, rows=samples.n_rows, classes=2), 8),
                "random_forest_importance": selection.by_importance(samples, forest, 8),
                "rfe_random_forest": selection.recursive_elimination(samples, forest, 8, step=0.5),
                "lasso_regularization": selection.lasso(samples, 8),
                "gradient_boosting_importance": selection.by_importance(samples, ml.gradient_boosting(20, 3), 8),
            }
        )
    )
    judged = selection.evaluate_methods(samples, lists, folds=5, judge=ml.random_forest(50, 8))
    return in_range(judged, ["method"], ["auc", "accuracy", "std_auc", "std_accuracy"])


@query
def plain_method_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The fixed forest on five folds, for the four lists that take no loop of fits."""
    samples = _planted(spark, sf, folds=5)
    lists = uni.stacked({
        "univariate_f_test": uni.ranked(uni.anova_f(samples.table, complete=True), 8),
        "mutual_information": uni.ranked(uni.mutual_information(samples.table, rows=samples.n_rows, classes=2), 8),
        "random_forest_importance": selection.by_importance(samples, ml.random_forest(), 8),
        "lasso_regularization": selection.lasso(samples, 8),
    })
    return in_range(selection.score_by_accuracy(samples, selection.listed(lists)), ["method"], ["accuracy"])


@query
def random_forest_model(spark: SparkSession, sf: str) -> DataFrame:
    return _fitted(spark, sf, "RandomForest", lambda s: ml.random_forest())


@query
def gradient_boosting_model(spark: SparkSession, sf: str) -> DataFrame:
    return _fitted(spark, sf, "GradientBoosting", lambda s: ml.gradient_boosting())


@query
def ada_boost_model(spark: SparkSession, sf: str) -> DataFrame:
    return _fitted(spark, sf, "AdaBoost", lambda s: ml.ada_boost())


@query
def logistic_regression_model(spark: SparkSession, sf: str) -> DataFrame:
    return _fitted(spark, sf, "LogisticRegression", lambda s: ml.logistic_regression(s.n_rows))


@query
def logistic_regression_multiclass(spark: SparkSession, sf: str) -> DataFrame:
    train, test = split.train_test(fx.emb(spark, sf), eager=True)
    fit, held = ml.prepare(train), ml.prepare(test, fit_on=train)
    model = ml.logistic_regression(fit.n_rows).fit(fit.rows)
    pred = ml.predict_table(model, held.rows, "LogisticRegression")
    best = (F.array_position("scores", F.array_max("scores")) - 1).cast("double")
    return pred.select(
        "model", "row_id", "label",
        F.forall("scores", lambda s: s.between(0, 1)).alias("scores_in_range"),
        (F.size("scores") == held.n_classes).alias("a_score_per_class"),
        (F.col("prediction") == best).alias("prediction_fits_scores"),
    )


@query
def linear_svm_model(spark: SparkSession, sf: str) -> DataFrame:
    return _fitted(spark, sf, "LinearSVM", lambda s: ml.linear_svm(s.n_rows), argmax=False)


@query
def rbf_svm_model(spark: SparkSession, sf: str) -> DataFrame:
    return _fitted(spark, sf, "SVM", lambda s: ml.rbf_svm(s.n_rows, len(s.names)), argmax=False)


@query
def k_nearest_model(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _planted_pair(spark, sf)
    return ml.predict_table(ml.k_nearest().fit(train.rows), test.rows, "KNN").drop("scores")


@query
def model_grid_search(spark: SparkSession, sf: str) -> DataFrame:
    samples = _planted(spark, sf, folds=3)
    model = ml.logistic_regression(samples.n_rows)
    _, grid = ml.default_models(samples, tune=True)["LogisticRegression"]
    found = ml.grid_search(samples, model, grid, folds=3)
    scores = ml.search_scores(found, spark)
    chosen = {model.getParam(n): found.bestModel.getOrDefault(n) for n in grid}
    top = scores.orderBy(F.desc("score"), "point").first()["params"]
    return scores.select(
        "point", F.col("score").between(0, 1).alias("score_in_range"),
        F.lit(ml.described(chosen) == top).alias("refit_with_best"),
    )


def _model_set(train: ml.Samples) -> dict:
    """All seven at their own sizes, one of them with its full grid."""
    name = "LogisticRegression"
    return {**ml.default_models(train), name: ml.default_models(train, tune=True)[name]}


@query
def train_and_score_models(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _planted_pair(spark, sf)
    models = _model_set(train)
    found = ml.train_models(train, test, models)
    figures = ml.test_report(found.predictions, test, len(models))
    board = metrics.scoreboard(figures, order=list(models), searched=found.search_table(spark))
    flags = in_range(board, ["model", "rank", "is_best", "accuracy", "cv_score", "best_params"], ["auc", "sensitivity", "specificity", "precision", "f1_score"])
    by_rank = Window.orderBy("rank")
    return flags.select(
        "model",
        (F.col("is_best") == (F.col("rank") == 1)).alias("first_is_best"),
        (F.col("is_best") == (F.col("model") == found.best)).alias("best_is_named"),
        F.coalesce(F.col("accuracy") <= F.lag("accuracy").over(by_rank), F.lit(True)).alias("falling"),
        (F.col("best_params").isNotNull() & F.col("cv_score").between(0, 1)).alias("searched"),
        "auc_in_range", "sensitivity_in_range", "specificity_in_range",
    )


@query
def predict_with_best_model(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _planted_pair(spark, sf)
    found = ml.train_models(
        train, test, {"LogisticRegression": ml.logistic_regression(train.n_rows), "KNN": ml.k_nearest()}
    )
    return prep.decode_labels(checked_prediction(found, test), fx.emb_bin(spark, sf).df, "label")


def checked_prediction(found: ml.ModelSet, test: ml.Samples) -> DataFrame:
    """The best model's predictions beside those of the run that chose it."""
    own = found.predictions.filter(F.col("model") == found.best)
    again = found.predict(test.rows).select("row_id", F.col("prediction").alias("p"), F.col("score").alias("s"))
    return own.join(again, "row_id").select(
        "row_id", "label", (F.col("prediction") == F.col("p")).alias("same_prediction"),
        (F.abs(F.col("score") - F.col("s")) < 1e-12).alias("same_score"),
    )


@query
def predict_named_pair(spark: SparkSession, sf: str) -> DataFrame:
    """Labels IR and IS: the positive one sorts first, and its score is the score."""
    table = fx.emb_bin(spark, sf)
    named = table.with_df(table.df.withColumn("label", F.when(F.col("label") == 1, "IR").otherwise("IS")))
    train, test = split.train_test(named, eager=True)
    fit, held = ml.prepare(train), ml.prepare(test, fit_on=train)
    found = ml.train_models(fit, held, {"LogisticRegression": ml.logistic_regression(fit.n_rows)})
    rows = checked_prediction(found, held)
    higher = found.predictions.select("row_id", ((F.col("score") > 0.5) == (F.col("prediction") == 0)).alias("score_of_ir"))
    return prep.decode_labels(rows.join(higher, "row_id"), named.df, "label")


@query
def save_and_load_models(spark: SparkSession, sf: str) -> DataFrame:
    """Raw rows with holes through the saved pipeline and through the one in memory."""
    train, test = _planted_pair(spark, sf)
    found = ml.train_models(train, test, {"Logistic Regression": ml.logistic_regression(train.n_rows)})
    paths = ml.save_models(found, scratch_path(spark, "models"))
    raw = split.train_test(fx.miss(spark, sf), eager=True)[1].df.select("row_id", "values")

    def scored(model, name: str) -> DataFrame:
        chance = F.get(vector_to_array("probability"), F.lit(1))
        return model.transform(raw).select("row_id", chance.alias(f"score_{name}"), F.col("predicted_label").alias(name))

    both = scored(found.pipeline(), "before").join(scored(ml.load_model(paths["best"]), "after"), "row_id")
    return both.select(
        "row_id",
        (F.col("before") == F.col("after")).alias("same_label"),
        (F.col("score_before") == F.col("score_after")).alias("same_score"),
        F.col("after").isin(0, 1).alias("label_is_known"),
    )


@query
def model_feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    samples = _planted(spark, sf)
    model = ml.random_forest().fit(samples.rows)
    found = importance.feature_importance(model, samples)
    total = found.agg(F.sum("score")).scalar()
    return found.select("feature_idx", "feature", (F.abs(total - 1) < 1e-9).alias("sums_to_one"))


@query
def top_model_features(spark: SparkSession, sf: str) -> DataFrame:
    samples = _planted(spark, sf)
    return checked_list(importance.top_features(ml.random_forest().fit(samples.rows), samples))


@query
def models_on_top_features(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _planted_pair(spark, sf)
    models = {"LogisticRegression": ml.logistic_regression(train.n_rows), "RandomForest": ml.random_forest()}
    full = ml.train_models(train, test, models)
    top = importance.top_indices(importance.top_features(full.best_model, train, 8))
    small = importance.train_on_top(train, test, models, top)
    figures = ml.test_report(small.predictions, test, len(models))
    return in_range(figures, ["model"], ["accuracy", "auc", "sensitivity", "specificity"])


@query
def all_against_top_features(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _planted_pair(spark, sf)
    name, model = "LogisticRegression", ml.logistic_regression(train.n_rows)
    full = ml.train_models(train, test, {name: model})
    top = importance.top_indices(importance.top_features(full.best_model, train, 8))
    both = importance.all_against_top(train, test, name, model, top, full.predictions)
    a, t = F.col("all_features"), F.col("top_features")
    said = F.when(a > t, "all_features").when(t > a, "top_features").otherwise("equal")
    flags = in_range(both.withColumn("fits", F.col("higher") == said), ["model", "metric", "fits"], ["all_features", "top_features"])
    return flags


@query
def all_against_top_features_multiclass(spark: SparkSession, sf: str) -> DataFrame:
    """Ten classes: weighted figures side by side."""
    train, test = split.train_test(fx.emb(spark, sf), eager=True)
    fit, held = ml.prepare(train), ml.prepare(test, fit_on=train)
    name, model = "LogisticRegression", ml.logistic_regression(fit.n_rows)
    full = ml.train_models(fit, held, {name: model})
    top = importance.top_indices(importance.top_features(full.best_model, fit, 8))
    both = importance.all_against_top(fit, held, name, model, top, full.predictions)
    a, t = F.col("all_features"), F.col("top_features")
    said = F.when(a > t, "all_features").when(t > a, "top_features").otherwise("equal")
    return in_range(both.withColumn("fits", F.col("higher") == said), ["model", "metric", "fits"], ["all_features", "top_features"])


@query
def test_check_of_best_features(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _planted_pair(spark, sf)
    top = importance.top_indices(uni.ranked(uni.anova_f(train.table, complete=True), 8))
    plain, tuned = check_on_test(train.select(top), test.select(top), ml.random_forest(), ml.FOREST_GRID)
    found = metrics.accuracy(plain.unionByName(tuned))
    return found.select("model", (F.col("accuracy") > 0.5).alias("better_than_chance"))


# --- sources and sinks -------------------------------------------------------------


@query
def load_csv_table(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.write_table(fx.miss(spark, sf).wide(), scratch_path(spark, "table") + ".csv", "csv")
    return cells(tables.load_table(spark, path, "label"))


@query
def load_train_test_pair(spark: SparkSession, sf: str) -> DataFrame:
    train, test = split.train_test(fx.emb(spark, sf))
    folder = scratch_path(spark, "pair")
    paths = [
        sinks.write_table(part.wide(), f"{folder}/{name}.parquet")
        for name, part in (("train", train.select(range(60))), ("test", test.select(range(4, 64))))
    ]
    loaded, held = tables.load_pair(
        spark, *paths, "label", "row_id", use_predefined_split=False, seed=7
    )
    return held.long().groupBy("row_id", "label").agg(rounded(F.sum("value")).alias("total"))


@query
def export_ml_ready(spark: SparkSession, sf: str) -> DataFrame:
    train, test = split.train_test(fx.emb(spark, sf))
    best = importance.top_indices(uni.ranked(uni.anova_f(train, complete=True), 5))
    names, folder = [train.names[i] for i in best], scratch_path(spark, "ml")
    paths = sinks.write_ml_ready(train, test, names, folder, fmt="csv")
    lists = uni.stacked({
        "f_test": uni.ranked(uni.anova_f(train, complete=True), 5),
        "variance": uni.ranked(var.feature_variance(train, complete=True).withColumnRenamed("variance", "score"), 5),
    })
    combined = [r["feature"] for r in compare.combined_features(lists).orderBy("rank").collect()]
    paths += sinks.write_ml_ready(train, test, combined, folder, fmt="csv", name="ml_ready_all_methods")
    parts = [
        tables.load_table(spark, p, "label").long().select(
            F.lit(n).alias("part"), "row_id", "label", "feature_idx", "value"
        )
        for n, p in zip(("train", "test", "all_train", "all_test"), paths)
    ]
    return rounded_doubles(reduce(compare.concat_rows, parts))


@query
def export_result_tables(spark: SparkSession, sf: str) -> DataFrame:
    lists = _selection(spark, sf).persist()
    paths = sinks.write_selection(lists, scratch_path(spark, "lists"), "f_test")
    best = spark.read.parquet(paths["best_method"]).select("feature", "rank")
    combined = spark.read.parquet(paths["combined"]).select("feature", "rank")
    return best.withColumn("list", F.lit("best")).unionByName(
        combined.withColumn("list", F.lit("combined"))
    )


@query
def export_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    table = fx.emb(spark, sf)
    sizes = profile.class_distribution(table.df)
    classes = sizes.agg(F.struct(F.sum("n").alias("samples"), F.count(F.lit(1)).alias("classes")).alias("s"))
    best = uni.ranked(uni.anova_f(table, complete=True), 3)
    names = best.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda r: r["feature"]).alias("f"))
    row = sinks.summary_row(
        spark, data=classes.scalar(), selected=names.scalar(), seed=split.SEED, target="label"
    )
    path = sinks.write_summary(row, scratch_path(spark, "summary"))
    back = sinks.read_summary(spark, path)
    return back.select(
        "data.samples", "data.classes", F.array_join("selected", ",").alias("selected"), "seed", "target"
    )


# Fits that take a minute or more come last.
for _name in (
    "boosting_importance_selection",
    "gradient_boosting_model",
    "model_grid_search",
    "forest_elimination_selection",
    "ada_boost_model",
    "train_and_score_models",
    "evaluate_selection_methods",
    "plain_method_scores",
    "tuned_selections",
    "test_check_of_best_features",
    "logistic_elimination_selection",
):
    QUERIES[_name] = QUERIES.pop(_name)
