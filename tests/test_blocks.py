"""Statistics by blocks of features beside plain numpy, at awkward sizes and values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitsieve.functions import blocks
from traitsieve.operators import prep, univariate
from traitsieve.operators.moments import feature_moments
from traitsieve.table import FeatureTable


def made(spark, n=400, width=70, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * 10.0 ** rng.integers(-8, 8, width)
    x[:, 1] = rng.integers(0, 3, n)  # many equal numbers
    x[:, 2] = 7.5
    x[:, 3] = np.where(rng.random(n) < 0.5, 0.0, -0.0)
    x[:, 4] = [1e308, -1e308, 5e-324, -5e-324] * (n // 4)
    x[rng.random((n, width)) < 0.1] = np.nan
    x[:, 5] = np.nan
    x[: n - 1, 6] = np.nan
    x[n - 1, 6] = -3.0
    labels = [None if i % 50 == 0 else "abc"[i % 3] for i in range(n)]
    rows = [(i, labels[i], [None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, label string, values array<double>").repartition(7)
    return FeatureTable(df, tuple(f"f{i}" for i in range(width))), x, np.array(labels, dtype=object)


def test_keys_keep_the_order():
    x = np.array([-np.inf, -1e308, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1e308, np.inf])
    keys = blocks.keys_of(x)
    assert (np.diff(keys.astype(object)) >= 0).all() and keys[4] == keys[5] and len(np.unique(keys)) == 9
    assert (blocks.numbers_of(keys) == x).all()


@pytest.mark.parametrize("size", [blocks.FEATURES, 16])
def test_moments(spark, size):
    table, x, labels = made(spark)
    x[:, 4] = np.nan  # squares of the largest numbers are infinite
    table = table.with_values(F.transform("values", lambda v, i: F.when(i != 4, v)))
    got = {r["feature_idx"]: r for r in blocks.block_moments(table.df, 70, size=size).collect()}
    assert len(got) == 70
    for i in range(70):
        v = x[~np.isnan(x[:, i]), i]
        assert (got[i]["rows"], got[i]["n"]) == (400, len(v))
        assert got[i]["mean"] == (pytest.approx(v.mean(), rel=1e-9, abs=1e-15) if len(v) else None)
        assert got[i]["variance"] == (pytest.approx(v.var(ddof=1), rel=1e-9, abs=1e-25) if len(v) > 1 else None)
    by = {(r["label"], r["feature_idx"]): r for r in blocks.block_moments(table.df, 70, True, size).collect()}
    assert len(by) == 4 * 70
    for label in (None, "a", "b", "c"):
        v = x[np.array([k == label for k in labels]), 9]
        v = v[~np.isnan(v)]
        assert by[label, 9]["n"] == len(v) and by[label, 9]["mean"] == pytest.approx(v.mean(), rel=1e-9)


@pytest.mark.parametrize("cell", [blocks.CELL, 10, 1, 0])
def test_quantiles(spark, cell):
    """A tiny limit of a cell goes through all digits."""
    table, x, _ = made(spark)
    for share in (0.0, 0.5, 0.9, 1.0):
        got = blocks.quantiles(table.df, 70, share, cell, 32)
        for i in range(70):
            v = np.sort(x[~np.isnan(x[:, i]), i])
            if not len(v):
                assert np.isnan(got[i])
                continue
            at = (len(v) - 1) * share
            low, high = v[int(np.floor(at))], v[int(np.ceil(at))]
            assert got[i] == low + (at - np.floor(at)) * (high - low)
        if cell not in (10, 0):
            break


@pytest.mark.parametrize("bins", [2, 10])
def test_bins(spark, bins):
    table, x, labels = made(spark)
    got = {(r["feature_idx"], r["label"], r["bin"]): r["c"] for r in blocks.bin_counts(table.df, 70, bins, cell=20).collect()}
    want = {}
    for i in range(70):
        fine = ~np.isnan(x[:, i])
        v = x[fine, i]
        less = (v[:, None] > v[None, :]).sum(axis=1)
        for label, bin_ in zip(labels[fine], less * bins // max(len(v), 1)):
            want[i, label, bin_] = want.get((i, label, bin_), 0) + 1
    assert got == want


def test_wide_tables_are_not_exploded(spark, capsys):
    width = 10_000
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, width))
    rows = [(i, i % 2, [float(v) for v in x[i]]) for i in range(60)]
    table = FeatureTable(
        spark.createDataFrame(rows, "row_id long, label int, values array<double>"), tuple(f"f{i}" for i in range(width))
    )
    for df in (feature_moments(table), univariate.anova_f(table), univariate.binned_mutual_information(table)):
        df.explain("formatted")
        assert "Generate" not in capsys.readouterr().out
        assert df.count() == width
    filled = prep.impute(table, "median").df.first()["values"]
    assert len(filled) == width
    assert blocks.quantiles(table.df, width, 0.5)[77] == np.median(x[:, 77])


def test_empty_tables(spark):
    table, _, _ = made(spark)
    none = table.filter(F.lit(False))
    assert feature_moments(none).count() == 0 and np.isnan(blocks.quantiles(none.df, 70, 0.5)).all()
    assert blocks.bin_counts(none.df, 70, 10).count() == 0
