"""AdaBoost (SAMME) over decision stumps.

The rows are packed once: each feature as the number of its bin between exact quantiles.  A row's
weight follows from the stumps so far, so a round is one scan without state: a task works out the
weights of its rows, adds them up by feature, bin and class, and where the sums of some features
meet the best split of these is found, with the weight of the rows that it gets wrong.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitsieve.functions.blocks import order_statistics

BINS = 32
#: Cells of a packed block of rows, and features whose sums travel together.
BLOCK_CELLS = 4_000_000
FEATURES = 512


def _binned(edges: np.ndarray):
    """Rows packed into blocks: bins (rows x features) and classes."""
    width = len(edges)
    size = max(1, BLOCK_CELLS // max(width, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                some = batch.slice(i, size)
                x = some.column("values").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, width)
                codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
                y = some.column("y").to_numpy(zero_copy_only=False).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([codes.astype(np.uint8).tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())],
                    names=["codes", "y"],
                )

    return run


def _masses(stumps: list[tuple], norm: float, width: int, classes: int):
    """Weights by feature, bin and class under the stumps so far (feature, bin, left, right, alpha)."""
    feature, cut = (np.array([s[i] for s in stumps], dtype=np.int64) for i in (0, 1))
    left, right, alpha = (np.array([s[i] for s in stumps], dtype=float) for i in (2, 3, 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width * BINS * classes)
        for batch in batches:
            for packed, labels in zip(batch.column("codes"), batch.column("y")):
                y = np.frombuffer(labels.as_py(), np.int32)
                codes = np.frombuffer(packed.as_py(), np.uint8).reshape(len(y), width)
                said = np.where(codes[:, feature] <= cut, left, right)
                weight = np.exp((said != y[:, None]) @ alpha - norm)
                for f in range(0, width, FEATURES):
                    some = codes[:, f : f + FEATURES].astype(np.int64)
                    at = ((np.arange(f, f + some.shape[1]) * BINS + some) * classes + y[:, None]).ravel()
                    low = f * BINS * classes
                    high = low + some.shape[1] * BINS * classes
                    sums[low:high] += np.bincount(at - low, np.repeat(weight, some.shape[1]), high - low)
        step = FEATURES * BINS * classes
        parts = [sums[i : i + step].tobytes() for i in range(0, len(sums), step)]
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(len(parts)), pa.int32()), "sums": pa.array(parts, pa.binary())})

    return run


SPLIT = "impurity double, feature int, bin int, left int, right int, missed double, total double"


def best_split(mass: np.ndarray) -> tuple[float, int, int, int, int, float, float]:
    """Best stump of some features by Gini impurity from weights (features x bins x classes).

    Equal splits go to the feature and bin that come first; without a split both sides are the
    larger class (bin ``BINS``).
    """
    whole = mass[0].sum(axis=0)
    total, major = float(whole.sum()), int(whole.argmax())
    below = mass.cumsum(axis=1)[:, :-1]
    above = whole - below
    n_below, n_above = below.sum(axis=2), above.sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = n_below - (below**2).sum(axis=2) / n_below + n_above - (above**2).sum(axis=2) / n_above
    least = 1e-12 * total
    spread = np.where((n_below > least) & (n_above > least), spread, np.inf)
    feature, at = np.unravel_index(int(spread.argmin()), spread.shape)
    alone = total - (whole**2).sum() / max(total, 1e-300)
    if not spread[feature, at] < alone - least:
        return alone, 0, BINS, major, major, total - float(whole[major]), total
    left, right = below[feature, at], above[feature, at]
    missed = left.sum() - left.max() + right.sum() - right.max()
    return float(spread[feature, at]), int(feature), int(at), int(left.argmax()), int(right.argmax()), float(missed), total


def _best(classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("sums")):
                figures = np.frombuffer(packed.as_py())
                sums[part] = sums[part] + figures if part in sums else figures
        rows = []
        for part, figures in sums.items():
            found = best_split(figures.reshape(-1, BINS, classes))
            rows.append((found[0], found[1] + part * FEATURES, *found[2:]))
        if rows:
            names = [c.split()[0] for c in SPLIT.split(", ")]
            kinds = [pa.float64(), *[pa.int32()] * 4, pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def _stump_array(stumps: list[tuple]) -> Column:
    names = ("feature", "threshold", "left", "right", "alpha")
    return F.array(
        *[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, s)]) for s in stumps]
    )


def _vote(values: Column, stump: Column) -> Column:
    return F.when(F.get(values, stump["feature"]) <= stump["threshold"], stump["left"]).otherwise(
        stump["right"]
    )


class AdaBoost(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted stumps; ``rounds`` stumps at most, shrunk by ``learningRate``."""

    rounds = Param(Params._dummy(), "rounds", "number of stumps", TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "shrinkage", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    def __init__(self, rounds: int = 50, learningRate: float = 1.0, seed: int = 42):
        super().__init__()
        self._setDefault(rounds=50, learningRate=1.0, seed=42)
        self._set(rounds=rounds, learningRate=learningRate, seed=seed)

    def _fit(self, dataset: DataFrame) -> AdaBoostModel:
        rows = dataset.select(vector_to_array("features").alias("values"), F.col("label").cast("int").alias("y"))
        most, width = rows.agg(F.max("y"), F.max(F.size("values"))).first()
        classes = most + 1
        steps = np.arange(1, BINS)
        edges, _ = order_statistics(rows, width, lambda n: -(-steps[None, :] * n[:, None] // BINS) - 1)
        packed = rows.mapInArrow(_binned(edges), "codes binary, y binary").persist(StorageLevel.MEMORY_AND_DISK)
        stumps: list[tuple] = []
        norm = 0.0
        for _ in range(self.getOrDefault("rounds")):
            sums = packed.mapInArrow(_masses(stumps, norm, width, classes), "part int, sums binary")
            parts = -(-width // FEATURES)
            found = sums.repartition(min(parts, 200), "part").mapInArrow(_best(classes), SPLIT).collect()
            stump = min(found, key=lambda r: (r["impurity"], r["feature"], r["bin"]))  # a row per part
            error = stump["missed"] / stump["total"]
            side = (stump["feature"], stump["bin"], stump["left"], stump["right"])
            if error <= 1e-12:
                stumps.append((*side, 1.0))
                break
            if error >= 1 - 1 / classes:
                break
            alpha = math.log((1 - error) / error) + math.log(max(1, classes - 1))
            alpha *= self.getOrDefault("learningRate")
            stumps.append((*side, alpha))
            # the next weights add up to about one
            norm += math.log(1 + error * math.expm1(alpha)) + (math.log(stump["total"]) if len(stumps) == 1 else 0.0)
        packed.unpersist()
        if not stumps:
            raise ValueError("no stump beats chance on these rows")
        cut = lambda f, c: math.inf if c >= BINS - 1 else float(edges[f, c])
        return AdaBoostModel(json.dumps([(f, cut(f, c), float(a), float(b), w) for f, c, a, b, w in stumps]), classes)


class AdaBoostModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Votes of the stumps; ``probability`` is each class's share of the votes."""

    stumps = Param(Params._dummy(), "stumps", "fitted stumps as JSON", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)

    def __init__(self, stumps: str = "[]", classes: int = 2):
        super().__init__()
        self._set(stumps=stumps, classes=classes)

    @property
    def fitted(self) -> list[tuple]:
        return [tuple(s) for s in json.loads(self.getOrDefault("stumps"))]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fitted = self.fitted
        total = sum(s[4] for s in fitted)
        zeros = F.array(*[F.lit(0.0)] * self.getOrDefault("classes"))
        votes = F.aggregate(
            _stump_array(fitted),
            zeros,
            lambda acc, s: F.transform(
                acc,
                lambda v, c: v + F.when(_vote(F.col("_values"), s) == c, s["alpha"]).otherwise(0.0),
            ),
        )
        shares = F.transform("_votes", lambda v: v / F.lit(total))
        return (
            dataset.withColumn("_values", vector_to_array("features"))
            .withColumn("_votes", votes)
            .withColumn("rawPrediction", array_to_vector("_votes"))
            .withColumn("probability", array_to_vector(shares))
            .withColumn(
                "prediction",
                (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double"),
            )
            .drop("_values", "_votes")
        )
