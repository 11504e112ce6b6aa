"""Exploratory figures: target counts, cohort pivot and principal components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitsieve.operators.prep import impute, standardise
from traitsieve.table import FeatureTable

#: Features whose covariance the driver holds (8 bytes x features squared); wider tables
#: get their components by subspace iteration, whose steps are passes over the rows.
COVARIANCE_FEATURES = 4_000
ITERATIONS = 100
TOLERANCE = 1e-12


def target_by_cohort(df: DataFrame, cohort: str, classes: Sequence | None = None) -> DataFrame:
    """Cohort rows x class columns of counts, missing combinations 0."""
    pivot = df.groupBy(cohort).pivot("label", classes) if classes else df.groupBy(cohort).pivot("label")
    return pivot.agg(F.count(F.lit(1))).na.fill(0)


def principal_components(
    table: FeatureTable, k: int = 2, covariance_features: int = COVARIANCE_FEATURES
) -> tuple[DataFrame, DataFrame]:
    """Scores ``row_id, label, pc1..`` and ``component, explained_variance_ratio``.

    Missing cells become 0; all features take part at any width, and the sign is
    fixed so the largest loading is positive.
    """
    scaled = standardise(impute(table, "zero"), complete=True)
    if scaled.width <= covariance_features:
        model = PCA(k=k, inputCol="features", outputCol="pcs").fit(scaled.vectors())
        loadings, explained = model.pc.toArray(), list(model.explainedVariance)
    else:
        loadings, explained = _subspace(scaled, k)
    signs = np.array([1.0 if abs(c.max()) >= abs(c.min()) else -1.0 for c in loadings.T])
    scores = _projected(scaled.df, loadings * signs).select(
        "row_id", "label", *[F.col("_y")[i].alias(f"pc{i + 1}") for i in range(k)]
    )
    shares = [(i + 1, float(v)) for i, v in enumerate(explained)]
    ratios = table.df.sparkSession.createDataFrame(
        shares, "component int, explained_variance_ratio double"
    )
    return scores, ratios


def _projected(df: DataFrame, loadings: np.ndarray) -> DataFrame:
    """``df`` with ``_y``: the values' products with each column of ``loadings``."""

    def product(column: np.ndarray):
        paired = F.zip_with("values", F.lit(column.tolist()), lambda v, w: v * w)
        return F.aggregate(paired, F.lit(0.0), lambda total, v: total + v)

    return df.withColumn("_y", F.array(*[product(c) for c in loadings.T]))


def _subspace(table: FeatureTable, k: int) -> tuple[np.ndarray, list[float]]:
    """Leading components of standardised values without their covariance.

    A step multiplies the covariance with a few vectors in one pass: every task sums
    its rows' products, a width x (k + 8) matrix, and the driver orthonormalises the sum.
    """
    width, size = table.width, min(table.width, k + 8)
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(width, size)))[0]
    rows = table.df.select("values").persist()
    n, variance = rows.count(), 0.0
    values = np.zeros(size)
    try:
        for _ in range(ITERATIONS):
            shared = table.df.sparkSession.sparkContext.broadcast(basis)

            def products(batches):
                total, squares = np.zeros((width, size)), 0.0
                for batch in batches:
                    x = batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                    total += x.T @ (x @ shared.value)
                    squares += float((x * x).sum())
                yield _packed(total, squares)

            parts = rows.mapInArrow(products, "squares double, total array<double>")
            summed = parts.select("squares", F.posexplode("total")).groupBy("pos")
            summed = summed.agg(F.sum("col").alias("v"), F.sum("squares").alias("s")).collect()
            step = np.zeros(width * size)
            for r in summed:
                step[r["pos"]] = r["v"]
            variance = summed[0]["s"] / max(n - 1, 1)
            basis, small = np.linalg.qr(step.reshape(width, size) / max(n - 1, 1))
            before, values = values, np.sort(np.abs(np.linalg.svd(small, compute_uv=False)))[::-1]
            if np.abs(values[:k] - before[:k]).max() <= TOLERANCE * values[0]:
                break
    finally:
        rows.unpersist()
    turned = np.linalg.svd(small)[0]
    return (basis @ turned)[:, :k], [v / variance for v in values[:k]]


def _packed(total: np.ndarray, squares: float):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict(
        {"squares": pa.array([squares]), "total": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))}
    )
