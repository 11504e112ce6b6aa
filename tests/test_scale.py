"""The spread-out ways of working give what the one-window ways give."""

from collections import Counter
from math import isclose

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from traitsieve.functions.ordered import exact_quantile
from traitsieve.operators import knn, metrics, split
from traitsieve.operators import univariate as uni
from traitsieve.operators.moments import feature_moments
from traitsieve.sources import fixtures as fx
from traitsieve.table import FeatureTable


def values(df, key, column):
    return {tuple(r[k] for k in key): r[column] for r in df.collect()}


def assert_close(a, b, rel=1e-9):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=rel, abs=1e-12), k


@pytest.fixture(scope="module")
def skewed(spark):
    """Two features; one value holds a third of all rows, one class 90 % of them."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        tied = 0.0 if i % 3 == 0 else float(rng.integers(1, 40))
        rows.append((i, "big" if i % 10 else "small", [tied, float(rng.normal()) * 1e6]))
    rows += [(600, "single", [5.0, 1.0])]
    df = spark.createDataFrame(rows, "row_id long, label string, values array<double>")
    return FeatureTable(df, ("tied", "wide"))


@pytest.mark.parametrize("score", [uni.mutual_information, uni.binned_mutual_information])
def test_sliced_scores_equal_whole(skewed, score):
    whole = values(score(skewed), ["feature"], "score")
    sliced = values(score(skewed, rows_per_slice=37), ["feature"], "score")
    assert_close(whole, sliced)


def test_mutual_information_equals_brute_force(skewed):
    rows = [(r["label"], r["values"]) for r in skewed.df.collect()]

    def psi(n):
        return -0.5772156649015329 + sum(1 / i for i in range(1, n))

    got = values(uni.mutual_information(skewed, rows_per_slice=50), ["feature"], "score")
    sizes = Counter(label for label, _ in rows)
    used = [(l, v) for l, v in rows if sizes[l] > 1]
    for j, name in enumerate(skewed.names):
        x = np.array([v[j] for _, v in used])
        y = np.array([l for l, _ in used])
        total = 0.0
        for i in range(len(x)):
            same = np.abs(x[(y == y[i])] - x[i])
            same = np.sort(same)[1:]
            k = min(3, len(same))
            r = same[k - 1]
            d = np.abs(x - x[i])
            m = int((d < r).sum()) if r > 0 else int((d == 0).sum())
            total += psi(k) - psi(sizes[y[i]]) - psi(m)
        expected = max(0.0, psi(len(x)) + total / len(x))
        assert isclose(got[(name,)], expected, abs_tol=1e-9)


def test_sliced_curve_and_auc_equal_whole(spark, sf):
    pred = fx.pred(spark, sf)
    assert_close(
        values(metrics.auc(pred, 1), ["model"], "auc"),
        values(metrics.auc(pred, 1, rows_per_slice=20), ["model"], "auc"),
    )
    key = ["model", "threshold"]
    assert_close(
        values(metrics.roc_curve(pred, 1), key, "tpr"),
        values(metrics.roc_curve(pred, 1, rows_per_slice=20), key, "tpr"),
    )


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.99, 1.0])
@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_exact_quantile(skewed, share, accuracy):
    cells = skewed.long()
    expected = cells.groupBy("feature_idx").agg(F.percentile("value", share).alias("quantile"))
    got = exact_quantile(cells, "feature_idx", "value", share, 2, accuracy)
    assert_close(values(expected, ["feature_idx"], "quantile"), values(got, ["feature_idx"], "quantile"))


@pytest.mark.parametrize("prefix", [1, 2, 3])
@pytest.mark.parametrize("eager", [False, True])
def test_split_equals_ranking_whole_classes(skewed, prefix, eager):
    rows = skewed.df.select("row_id", "label")
    ranked = rows.select(
        "row_id",
        (
            F.row_number().over(Window.partitionBy("label").orderBy(split.row_hash()))
            <= F.round(F.count("*").over(Window.partitionBy("label")) * 0.2)
        ).alias("is_test"),
    )
    got = split.with_test_flag(rows, prefix=prefix, eager=eager)
    assert values(ranked, ["row_id"], "is_test") == values(got, ["row_id"], "is_test")


@pytest.mark.parametrize("folds", [2, 5])
def test_folds_equal_ntile_and_survive_repartition(skewed, folds):
    rows = skewed.df.select("row_id", "label")
    w = Window.partitionBy("label").orderBy(split.row_hash())
    expected = rows.select("row_id", (F.ntile(folds).over(w) - 1).alias("fold"))
    got = split.with_fold(rows.repartition(7), folds, prefix=1)
    assert values(expected, ["row_id"], "fold") == values(got, ["row_id"], "fold")


def test_vector_and_long_moments_agree(spark, sf):
    table = fx.line(spark, sf)
    key = ["label", "feature_idx"]
    for column in ("n", "mean", "variance"):
        assert_close(
            values(feature_moments(table, True), key, column),
            values(feature_moments(table, True, complete=True), key, column),
        )


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("pivots,block_rows", [(1, 1000), (6, 20), (30, 7)])
def test_neighbours_equal_brute_force_with_copies(spark, p, pivots, block_rows):
    """A third of the training rows are copies of one point."""
    rng = np.random.default_rng(3)
    train = [(i, int(i % 3), [1.0, 1.0] if i % 3 == 0 else [float(a) for a in rng.integers(0, 9, 2)]) for i in range(150)]
    test = [(1000 + i, 0, [float(a) for a in rng.integers(0, 9, 2)]) for i in range(40)] + [(2000, 0, [1.0, 1.0])]
    schema = "row_id long, label int, values array<double>"
    a = FeatureTable(spark.createDataFrame(train, schema), ("x", "y"))
    b = FeatureTable(spark.createDataFrame(test, schema), ("x", "y"))
    found = knn.nearest_neighbours(a, b, k=4, p=p, pivots=pivots, block_rows=block_rows)
    got = {}
    for r in found.orderBy("row_id", "position").collect():
        got.setdefault(r["row_id"], []).append((round(r["distance"], 9), r["neighbour_id"]))
    for row_id, _, q in test:
        d = [(round(float((np.abs(np.array(v) - q) ** p).sum() ** (1 / p)), 9), i) for i, _, v in train]
        assert got[row_id] == sorted(d)[:4]


def test_fewer_training_rows_than_neighbours(spark):
    schema = "row_id long, label int, values array<double>"
    a = FeatureTable(spark.createDataFrame([(1, 0, [0.0]), (2, 1, [3.0])], schema), ("x",))
    b = FeatureTable(spark.createDataFrame([(9, 0, [1.0])], schema), ("x",))
    assert knn.nearest_neighbours(a, b, k=5).count() == 2


def test_row_order_and_column_order_do_not_matter(spark, sf):
    table = fx.emb_bin(spark, sf)
    base = values(uni.anova_f(table), ["feature"], "score")
    turned = table.select(range(table.width - 1, -1, -1))
    assert_close(base, values(uni.anova_f(turned), ["feature"], "score"))
    assert_close(base, values(uni.anova_f(table.with_df(table.df.repartition(5))), ["feature"], "score"))


def test_doubling_rows_keeps_accuracy_and_auc(spark, sf):
    pred = fx.pred(spark, sf)
    twice = pred.unionByName(pred)
    assert_close(values(metrics.auc(pred, 1), ["model"], "auc"), values(metrics.auc(twice, 1), ["model"], "auc"))
    assert_close(
        values(metrics.accuracy(pred), ["model"], "accuracy"),
        values(metrics.accuracy(twice), ["model"], "accuracy"),
    )


@pytest.mark.parametrize("width", [40, 41])
def test_narrow_and_wide_tables_give_the_same_answers(spark, width):
    from traitsieve.operators import moments

    rows = [(i, i % 2, [float(i * j % 7) for j in range(width)]) for i in range(6)]
    table = FeatureTable(spark.createDataFrame(rows, "row_id long, label int, values array<double>"), tuple(f"f{j}" for j in range(width)))
    empty = table.filter(F.lit(False))
    assert moments.feature_moments(empty).count() == 0
    assert moments.feature_moments(empty, complete=True).count() == 0
    holed = table.with_values(F.transform("values", lambda v, j: F.when(j != 3, v)))
    with pytest.raises(Exception):
        moments.feature_moments(holed, complete=True).collect()


def test_selecting_reads_only_the_chosen_columns(spark, tmp_path):
    wide = spark.range(20).select("id", (F.col("id") % 2).alias("label"), *[(F.col("id") * i).alias(f"c{i}") for i in range(1000)])
    wide.write.parquet(str(tmp_path / "wide"))
    table = FeatureTable.from_wide(spark.read.parquet(str(tmp_path / "wide")), "id", "label").select([7, 3])
    plan = table.df._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema:"):].split("\n")[0]
    assert "c7:" in read and "c3:" in read and "c8:" not in read and "c500:" not in read
    assert table.df.orderBy("row_id").first()["values"] == [0.0, 0.0]


def test_neighbour_search_shuffles_no_copy_of_a_block(spark):
    """Queries and training rows meet in a replicated loop: what is shuffled is k rows a query and part."""
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 2), [float(a) for a in rng.normal(size=16)]) for i in range(600)]
    table = FeatureTable(spark.createDataFrame(rows, "row_id long, label int, values array<double>"), tuple(f"f{i}" for i in range(16)))
    found = knn.nearest_neighbours(table.filter(F.col("row_id") < 400), table.filter(F.col("row_id") >= 400), k=3, pivots=4, block_rows=8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "values" not in plan
    x = np.array([r[2] for r in rows])
    d = np.sqrt(((x[400:, None] - x[None, :400]) ** 2).sum(-1))
    got = {(r["row_id"], r["position"]): r["neighbour_id"] for r in found.collect()}
    assert got == {(400 + i, j + 1): int(d[i].argsort(kind="stable")[j]) for i in range(200) for j in range(3)}


def test_candidates_of_neighbours_hold_no_batch_and_keep_ties():
    import pyarrow as pa

    ids = pa.array([[7, 8]])[0]
    best = knn._Best(ids, np.array([[0.0], [np.inf]]).tobytes(), 1, 2, 2)
    assert best.ids.buffers()[1].address != ids.values.buffers()[1].address
    best.add(pa.array([[5, 9]])[0], pa.array([[0, 1]])[0], np.array([[1.0], [2.0]]).tobytes())
    best.add(pa.array([[3, 4]])[0], pa.array([[1, 1]])[0], np.array([[-1.0], [-1.0]]).tobytes())
    assert best.near.tolist() == [[3, 4], [3, 4]]  # ties, and distances without end, go by key
