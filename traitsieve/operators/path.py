"""Logistic regression at many strengths and on all folds, in shared scans of the rows.

Every fit asked for (a strength, a share of L1, class weights or not, a fold left out or none)
is a point.  The rows are packed once into blocks; a scan of the blocks gives loss, gradient and
curvature of all points at once, as products of a block with the matrix of all coefficients.
The driver then solves each point's penalised quadratic model (over the coefficients in use, where
there is an L1 part) and the next scan tries the result; a point whose loss did not fall halves its step,
one that meets the optimality conditions drops out.  The fits on all rows are points of the same
scans, so the winner of a search needs no refit.

Figures that travel are of the size of the model, never of the table: per point a vector and a
square matrix of the width for each class.  Points are taken together up to ``FIGURES`` numbers.
With more than two classes the curvature is that of each class alone, doubled, which bounds the
whole from above.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitsieve.operators.metrics import cross_validated, cross_validated_classes

#: Numbers of curvature that a task holds and sends at a time (8 bytes each).
FIGURES = 20_000_000
#: Cells of a packed block.
BLOCK_CELLS = 500_000
SCANS = 200
#: Rounds by coordinate over all points before each point is solved to the end.
SWEEPS = 3
#: A point is done when no optimality condition is off by more than this share of its penalty.
TOLERANCE = 1e-3
#: Curvature added for the solver, in case the rows give a direction none.
RIDGE = 1e-12
ALL_ROWS = -1


@dataclass(frozen=True)
class Point:
    """One fit: strength, share of L1, class weights, and the fold that is left out."""

    reg: float
    l1: float = 0.0
    balanced: bool = False
    fold: int = ALL_ROWS


class LinearScores(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted linear classifier: one row of coefficients and intercept a class (one row for two)."""

    weights = Param(Params._dummy(), "weights", "rows of coefficients, the intercept last, as JSON", TypeConverters.toString)
    regParam = Param(Params._dummy(), "regParam", "strength of the penalty", TypeConverters.toFloat)
    elasticNetParam = Param(Params._dummy(), "elasticNetParam", "share of L1", TypeConverters.toFloat)

    def __init__(self, weights: str = "[]", regParam: float = 0.0, elasticNetParam: float = 0.0):
        super().__init__()
        self._set(weights=weights, regParam=regParam, elasticNetParam=elasticNetParam)

    def _rows(self) -> np.ndarray:
        return np.array(json.loads(self.getOrDefault("weights")), dtype=np.float64)

    @property
    def coefficientMatrix(self) -> DenseMatrix:
        rows = self._rows()[:, :-1]
        return DenseMatrix(rows.shape[0], rows.shape[1], rows.ravel(order="F"))

    @property
    def coefficients(self) -> DenseVector:
        return DenseVector(self._rows()[0, :-1])

    @property
    def interceptVector(self) -> DenseVector:
        return DenseVector(self._rows()[:, -1])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = self._rows()

        @F.pandas_udf("array<double>")
        def margins(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype=object)
            z = np.stack(values.to_numpy()) @ rows[:, :-1].T + rows[:, -1]
            return pd.Series(list(np.hstack([-z, z]) if z.shape[1] == 1 else z))

        raw = dataset.withColumn("_margins", margins(vector_to_array("features")))
        if len(rows) == 1:
            up = 1 / (1 + F.exp(-F.get("_margins", F.lit(1))))
            chance = F.array(1 - up, up)
        else:
            part = F.transform("_margins", lambda m: F.exp(m - F.array_max("_margins")))
            total = F.aggregate(part, F.lit(0.0), lambda s, x: s + x)
            chance = F.transform(part, lambda x: x / total)
        best = F.array_position("_margins", F.array_max("_margins")) - 1
        return raw.select(
            *dataset.columns,
            array_to_vector("_margins").alias("rawPrediction"),
            array_to_vector(chance).alias("probability"),
            best.cast("double").alias("prediction"),
        )


@dataclass
class PathSearch:
    """A finished search: the points with their mean scores, and the best one's fit on all rows."""

    maps: list[dict]
    avgMetrics: list[float]
    models: list[LinearScores]
    evaluator: Evaluator | None = None

    @property
    def bestModel(self) -> LinearScores:
        return self.models[int(np.argmax(self.avgMetrics))]

    def getEstimatorParamMaps(self) -> list[dict]:
        return self.maps

    def getEvaluator(self) -> Evaluator | None:
        return self.evaluator


# --- packed rows ---------------------------------------------------------------------

BLOCK = "x binary, y binary, fold binary"


def _packed(width: int):
    size = max(1, BLOCK_CELLS // max(width, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                some = batch.slice(i, size)
                x = some.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                columns = [x, *(some.column(c).to_numpy(zero_copy_only=False).astype(np.int32) for c in ("y", "fold"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c.tobytes()], pa.binary()) for c in columns], names=["x", "y", "fold"]
                )

    return run


def blocks_of(rows: DataFrame, width: int) -> DataFrame:
    """``features, label, fold`` packed into blocks of rows, cached for many scans."""
    fold = F.col("fold").cast("int") if "fold" in rows.columns else F.lit(ALL_ROWS - 1)
    plain = rows.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"), fold.alias("fold"))
    return plain.mapInArrow(_packed(width), BLOCK).persist(StorageLevel.MEMORY_AND_DISK)


def _arrays(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cells with a column of ones, labels and folds of each block."""
    for i in range(batch.num_rows):
        y, fold = (np.frombuffer(batch.column(c)[i].as_py(), np.int32) for c in ("y", "fold"))
        x = np.ones((len(y), width + 1))
        x[:, :width] = np.frombuffer(batch.column("x")[i].as_py()).reshape(len(y), width)
        yield x, y, fold


def class_counts(blocks: DataFrame, n_classes: int) -> dict[int, np.ndarray]:
    """Rows of each class by fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                y, fold = (np.frombuffer(batch.column(c)[i].as_py(), np.int32) for c in ("y", "fold"))
                pairs, n = np.unique(np.stack([fold, y]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_pydict({"fold": pairs[0], "y": pairs[1], "n": n})

    found: dict[int, np.ndarray] = {}
    for r in blocks.mapInArrow(run, "fold int, y int, n long").groupBy("fold", "y").agg(F.sum("n").alias("n")).collect():
        found.setdefault(r["fold"], np.zeros(n_classes))[r["y"]] = r["n"]
    return found


def class_weights(points: Sequence[Point], counts: dict[int, np.ndarray], n_classes: int) -> np.ndarray:
    """Weight of a row by point and class: 1, or inverse to the size of the class among the point's rows."""
    out = np.ones((len(points), n_classes))
    for i, point in enumerate(points):
        if point.balanced:
            own = sum((n for f, n in counts.items() if f != point.fold), np.zeros(n_classes))
            out[i] = own.sum() / (n_classes * np.maximum(own, 1))
    return out


# --- one scan ------------------------------------------------------------------------


def chances(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Probabilities, rows x points x classes (one class of two)."""
    points, k, width = weights.shape
    z = (x @ weights.reshape(points * k, width).T).reshape(len(x), points, k)
    if k == 1:
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    z = np.exp(z - z.max(axis=2, keepdims=True))
    return z / z.sum(axis=2, keepdims=True)


def _figures(weights: np.ndarray, folds: np.ndarray, by_class: np.ndarray):
    """Sum of weights, loss, slope and curvature of each point over a task's rows."""
    points, k, width = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss = np.zeros(points), np.zeros(points)
        slope, curve = np.zeros((points * k, width)), np.zeros((points * k, width, width))
        for batch in batches:
            for x, y, fold in _arrays(batch, width - 1):
                mass = by_class.T[y] * (fold[:, None] != folds[None, :])
                p = chances(x, weights)
                is_class = (y[:, None] == (np.arange(k) if k > 1 else [1])).astype(float)[:, None, :]
                hit = p if k > 1 else np.where(is_class > 0, p, 1 - p)
                said = np.log(np.maximum(hit, 1e-300))
                total += mass.sum(axis=0)
                loss -= (mass * ((said * is_class).sum(axis=2) if k > 1 else said[:, :, 0])).sum(axis=0)
                miss = (mass[:, :, None] * (p - is_class)).reshape(len(x), points * k)
                slope += miss.T @ x
                bend = (mass[:, :, None] * p * (1 - p) * (1 if k == 1 else 2)).reshape(len(x), points * k)
                for q in range(points * k):
                    curve[q] += (x * bend[:, q, None]).T @ x
        packed = np.hstack([total[:, None], loss[:, None], slope.reshape(points, -1), curve.reshape(points, -1)])
        yield pa.RecordBatch.from_pydict(
            {"point": pa.array(np.arange(points), pa.int32()), "figures": pa.array([r.tobytes() for r in packed], pa.binary())}
        )

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for point, packed in zip(batch.column("point").to_pylist(), batch.column("figures")):
            figures = np.frombuffer(packed.as_py())
            sums[point] = sums[point] + figures if point in sums else figures
    if sums:
        yield pa.RecordBatch.from_pydict(
            {"point": pa.array(list(sums), pa.int32()), "figures": pa.array([v.tobytes() for v in sums.values()], pa.binary())}
        )


def scan(blocks: DataFrame, weights: np.ndarray, folds: np.ndarray, by_class: np.ndarray):
    """Means over each point's rows: loss, slope and curvature; tasks' sums are added before they travel on."""
    points, k, width = weights.shape
    kind = "point int, figures binary"
    parts = blocks.mapInArrow(_figures(weights, folds, by_class), kind)
    rows = {r["point"]: np.frombuffer(bytes(r["figures"])) for r in parts.repartition(min(points, 8), "point").mapInArrow(_summed, kind).collect()}
    all_ = np.stack([rows[i] for i in range(points)]) if len(rows) == points else np.zeros((points, 2 + k * width * (width + 1)))
    total = np.maximum(all_[:, 0], 1e-300)[:, None]
    loss, slope, curve = np.split(all_[:, 1:] / total, [1, 1 + k * width], axis=1)
    return loss[:, 0], slope.reshape(points, k, width), curve.reshape(points, k, width, width)


# --- the solver ----------------------------------------------------------------------


def violations(weights: np.ndarray, slope: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """How far each point is from the optimality conditions, by its worst coefficient."""
    s = slope + l2 * weights
    off = np.where(weights != 0, np.abs(s + l1 * np.sign(weights)), np.maximum(np.abs(s) - l1, 0))
    return off.max(axis=tuple(range(1, off.ndim)))  # of no point at all: nothing


def penalised_step(weights, slope, curve, l1, l2) -> np.ndarray:
    """Minimum of the penalised quadratic models, all points together.

    Shapes: ``weights, slope, l1, l2`` models x width, ``curve`` models x width x width.
    """
    out = weights.copy()
    smooth = (l1 == 0).all(axis=1)
    if smooth.any():
        h = curve[smooth] + (l2[smooth][:, :, None] + RIDGE) * np.eye(curve.shape[1])
        out[smooth] -= np.linalg.solve(h, (slope + l2 * weights)[smooth][:, :, None])[:, :, 0]
    rest = np.flatnonzero(~smooth)
    w, q, p1, p2 = weights[rest].copy(), slope[rest].copy(), l1[rest], l2[rest]
    columns = np.ascontiguousarray(curve[rest].transpose(1, 0, 2))
    bend = np.maximum(np.diagonal(curve[rest], axis1=1, axis2=2) + p2, 1e-12)
    for _ in range(SWEEPS if len(rest) else 0):
        for j in range(w.shape[1]):
            at = w[:, j] * bend[:, j] - (q[:, j] + p2[:, j] * w[:, j])
            new = np.sign(at) * np.maximum(np.abs(at) - p1[:, j], 0) / bend[:, j]
            q += columns[j] * (new - w[:, j])[:, None]
            w[:, j] = new
    for i, model in enumerate(rest):
        # a touch of curvature around the point at hand: it damps the step and leaves the optimum where it is
        damped = curve[model] + RIDGE * np.eye(curve.shape[1])
        out[model] = _exact(w[i], slope[model] - damped @ weights[model], damped, p1[i], p2[i])
    return out


def _exact(w: np.ndarray, offset: np.ndarray, curve: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """Minimum of one model: solve for the coefficients in use, drop one that would change its sign,
    take in the one whose condition is off most, until all conditions hold."""
    w = w.copy()
    for _ in range(4 * len(w) + 20):
        used = np.flatnonzero((w != 0) | (l1 == 0))
        sign = np.sign(w[used])
        h = curve[np.ix_(used, used)] + np.diag(l2[used])
        new = np.linalg.solve(h, -offset[used] - l1[used] * sign)
        flips = (l1[used] > 0) & (new * sign <= 0)
        if flips.any():
            share = np.where(flips, w[used] / np.where(flips, w[used] - new, 1.0), np.inf)
            first = int(share.argmin())
            w[used] += share[first] * (new - w[used])
            w[used[first]] = 0.0
            continue
        w[used] = new
        pull = offset + curve @ w + l2 * w
        off = np.where((w == 0) & (l1 > 0), np.abs(pull) - l1, 0.0)
        worst = int(off.argmax())
        if off[worst] <= 1e-12 + 1e-6 * l1[worst]:
            break
        w[worst] = -np.sign(pull[worst]) * off[worst] / max(curve[worst, worst] + l2[worst], 1e-12)
    return w


def fit_points(
    blocks: DataFrame, points: Sequence[Point], width: int, n_classes: int, by_class: np.ndarray, scans: int = SCANS
) -> np.ndarray:
    """Coefficients (points x classes x width + 1, the intercept last) of all points."""
    k = 1 if n_classes == 2 else n_classes
    size = k * (width + 1) ** 2
    if len(points) * size > FIGURES and len(points) > 1:
        n = max(1, FIGURES // size)
        parts = [fit_points(blocks, points[i : i + n], width, n_classes, by_class[i : i + n], scans) for i in range(0, len(points), n)]
        return np.concatenate(parts)
    shape = (len(points), k, width + 1)
    reg = np.array([p.reg for p in points])
    l1 = np.zeros(shape) + (reg * [p.l1 for p in points])[:, None, None]
    l2 = np.zeros(shape) + (reg * [1 - p.l1 for p in points])[:, None, None]
    l1[:, :, -1] = l2[:, :, -1] = 0.0
    goal = np.clip(TOLERANCE * reg, 1e-10, 1e-5)
    folds = np.array([p.fold for p in points])
    base = np.zeros(shape)
    trial, value = base.copy(), np.full(len(points), np.inf)
    open_ = np.arange(len(points))
    for _ in range(scans):
        loss, slope, curve = scan(blocks, trial[open_], folds[open_], by_class[open_])
        w = trial[open_]
        now = loss + (l1[open_] * np.abs(w) + l2[open_] * w**2 / 2).sum(axis=(1, 2))
        fell = now <= value[open_] + 1e-13 * np.abs(now)
        held = open_[~fell]
        trial[held] = (base[held] + trial[held]) / 2  # a step too far: go half of it
        good = open_[fell]
        base[good], value[good] = trial[good], now[fell]
        done = violations(base[good], slope[fell], l1[good], l2[good]) <= goal[good]
        go = good[~done]
        if len(go):
            flat = lambda a: a[go].reshape(len(go) * k, width + 1)
            at = np.flatnonzero(fell)[~done]
            step = penalised_step(
                flat(base), slope[at].reshape(-1, width + 1), curve[at].reshape(-1, width + 1, width + 1), flat(l1), flat(l2)
            )
            trial[go] = step.reshape(len(go), k, width + 1)
        stuck = held[np.abs(trial[held] - base[held]).reshape(len(held), -1).max(axis=1) < 1e-12] if len(held) else held
        open_ = np.setdiff1d(np.concatenate([held, go]), stuck)
        if not len(open_):
            break
    return base


def _scores(weights: np.ndarray, by_fold: dict[int, int], n_classes: int, width: int):
    """For each row the probabilities of every combination, by the model that did not see the row's fold."""
    combos = weights.shape[0] // max(len(by_fold), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, fold in _arrays(batch, width):
                out = np.zeros((len(y), combos, n_classes))
                for f in np.unique(fold):
                    at = np.flatnonzero(fold == f)
                    start = by_fold[int(f)] * combos
                    p = chances(x[at], weights[start : start + combos])
                    out[at] = np.concatenate([1 - p, p], axis=2) if n_classes == 2 else p
                yield pa.RecordBatch.from_pydict(
                    {
                        "label": pa.array(y.astype(np.float64)), "fold": pa.array(fold, pa.int32()),
                        "scores": pa.array(list(out.reshape(len(y), -1)), pa.list_(pa.float64())),
                    }
                )

    return run


def out_of_fold_scores(
    blocks: DataFrame, weights: np.ndarray, folds: Sequence[int], n_classes: int, width: int, positive: int
) -> DataFrame:
    """Prediction table of all combinations from one scan; ``model`` is the combination's number."""
    scored = blocks.mapInArrow(
        _scores(weights, {f: i for i, f in enumerate(folds)}, n_classes, width), "label double, fold int, scores array<double>"
    )
    combos = len(weights) // len(folds)
    each = F.transform(
        F.sequence(F.lit(0), F.lit(combos - 1)), lambda i: F.slice("scores", i * n_classes + 1, F.lit(n_classes))
    )
    rows = scored.select("label", "fold", F.posexplode(each).alias("model", "scores"))
    return rows.select(
        "model", "label", "fold", "scores", F.get("scores", F.lit(positive)).alias("score"),
        (F.array_position("scores", F.array_max("scores")) - 1).cast("double").alias("prediction"),
    )


def fits(width: int, n_classes: int) -> bool:
    """Is the curvature of one point within what a task may hold?"""
    return (1 if n_classes == 2 else n_classes) * (width + 1) ** 2 <= FIGURES


def as_points(estimator: LogisticRegression, maps: Sequence[dict]) -> list[Point]:
    """Points of a parameter grid; a weight column in a map, or set, asks for class weights."""
    out = []
    for m in maps:
        get = lambda p: m.get(p, estimator.getOrDefault(p))  # noqa: B023, E731
        balanced = bool(m.get(estimator.weightCol, estimator.isSet(estimator.weightCol)))
        out.append(Point(float(get(estimator.regParam)), float(get(estimator.elasticNetParam)), balanced))
    return out


def _model(weights: np.ndarray, point: Point) -> LinearScores:
    return LinearScores(json.dumps(weights.tolist()), point.reg, point.l1)


def fit(rows: DataFrame, point: Point, width: int, n_classes: int) -> LinearScores:
    """One fit on all rows."""
    blocks = blocks_of(rows, width)
    by_class = class_weights([point], class_counts(blocks, n_classes) if point.balanced else {}, n_classes)
    weights = fit_points(blocks, [point], width, n_classes, by_class)
    blocks.unpersist()
    return _model(weights[0], point)


def search(
    rows: DataFrame, estimator: LogisticRegression, maps: list[dict], width: int, n_classes: int,
    n_rows: int, metric: str = "roc_auc", positive: int = 1,
) -> tuple[PathSearch, dict[Point, LinearScores]]:
    """Cross-validate all points on the folds of ``rows``; also every fold's fit by point."""
    combos = as_points(estimator, maps)
    blocks = blocks_of(rows, width)
    counts = class_counts(blocks, n_classes)
    folds = sorted(counts)
    points = [Point(c.reg, c.l1, c.balanced, f) for f in [*folds, ALL_ROWS] for c in combos]
    weights = fit_points(blocks, points, width, n_classes, class_weights(points, counts, n_classes))
    held = len(folds) * len(combos)
    pred = out_of_fold_scores(blocks, weights[:held], folds, n_classes, width, positive)
    if n_classes == 2:
        means = cross_validated(pred, float(positive), rows=n_rows * len(combos))
    else:
        means = cross_validated_classes(pred, n_classes, rows=n_rows * len(combos))
    by_model = {r["model"]: r for r in means.collect()}  # one row a combination
    column = {"roc_auc": "mean_auc", "accuracy": "mean_accuracy"}[metric]
    scores = [float(by_model[i][column] or 0.0) if i in by_model else 0.0 for i in range(len(combos))]
    blocks.unpersist()
    models = [_model(w, p) for w, p in zip(weights, points)]
    return PathSearch(list(maps), scores, models[held:]), dict(zip(points, models))
