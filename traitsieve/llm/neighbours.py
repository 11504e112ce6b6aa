"""Approximate nearest neighbours by learned partitions.

On a bounded sample (``SAMPLE`` vectors at most, in the order of a hash) the neighbour graph
is cut into ``2 ** LEVELS`` parts of equal size by recursive bisection along the graph's slow
direction with exchanges across the cut.  A small network then learns, from a vector, which
parts its neighbours lie in.  Every row is indexed in its most probable part; a
query goes to its most probable parts, whose vectors are ranked by exact distance.  How many parts
is measured: the fewest that hold ``TARGET`` of the true neighbours of held-out vectors.  Vectors in
clusters need one or two; vectors without structure need most parts, as with any exact or
approximate index.

A part grows with the table and may hold many more rows than others (thousands of copies of
one vector), so it is stored as blocks of about ``BLOCK_ROWS`` rows by a hash; a query meets
each block of its parts and takes ``k`` rows along from each.  Blocks and queries meet in one
grouping by block; queries of a block are worked on ``QUERIES_AT_ONCE`` at a time.

Defined results: null, zero and non-finite vectors take no part; equal distances go by the smaller
vec_id; a query finds every candidate if there are at most ``k``; a table of up to ``2 ** LEVELS``
vectors is one part; rows of one vec_id are the same vector, of which the smallest values are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitsieve.llm.tables import written
from traitsieve.llm.vectors import matrix, usable, width_of

SAMPLE = 4_096
GRAPH_NEIGHBOURS = 10
LEVELS = 5
#: Share of true neighbours that the probed parts must hold, on held-out vectors of the sample.
TARGET = 0.95
#: One vector of the sample in this many is held out of learning to set the number of probes.
HELD_OUT = 4
HIDDEN = 64
EPOCHS = 40
BLOCK_ROWS = 4_000
QUERIES_AT_ONCE = 64


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each vector's ``k`` nearest others."""
    out = np.empty((len(x), k), dtype=np.int64)
    norms = (x**2).sum(axis=1)
    for i in range(0, len(x), 512):
        d = norms[None, :] - 2 * x[i : i + 512] @ x.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i : i + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, levels: int, seed: int = 3) -> np.ndarray:
    """Part of each node: ``levels`` rounds of halving each part with few edges cut."""
    rng = np.random.default_rng(seed)
    n, k = graph.shape
    heads = np.concatenate([np.repeat(np.arange(n), k), graph.ravel()])
    tails = np.concatenate([graph.ravel(), np.repeat(np.arange(n), k)])
    part = np.zeros(n, dtype=np.int64)
    for _ in range(levels):
        same = part[heads] == part[tails]
        a, b = heads[same], tails[same]
        degree = np.maximum(np.bincount(a, minlength=n), 1)
        value = rng.normal(size=n)
        count = np.bincount(part)
        for _ in range(120):  # the slow direction of a lazy walk, within each part
            value = 0.5 * value + 0.5 * np.bincount(a, weights=value[b], minlength=n) / degree
            value -= (np.bincount(part, weights=value * degree) / np.bincount(part, weights=degree))[part]
            value /= np.sqrt(np.bincount(part, weights=value**2) / count)[part] + 1e-12
        side = _upper_half(value, part)
        for _ in range(8):  # exchange the same number each way while edges across get fewer
            away = np.bincount(a, weights=side[a] != side[b], minlength=n)
            gain = 2 * away - np.bincount(a, minlength=n)
            moved = _exchange(gain, side, part)
            if not moved.any():
                break
            trial = side ^ moved
            if (trial[a] != trial[b]).sum() >= (side[a] != side[b]).sum():
                break
            side = trial
        part = part * 2 + side
    return part


def _upper_half(value: np.ndarray, part: np.ndarray) -> np.ndarray:
    order = np.lexsort((value, part))
    sizes = np.bincount(part)
    place = np.arange(len(part)) - (np.cumsum(sizes) - sizes)[part[order]]
    side = np.zeros(len(part), dtype=np.int64)
    side[order] = place >= sizes[part[order]] // 2
    return side


def _exchange(gain: np.ndarray, side: np.ndarray, part: np.ndarray) -> np.ndarray:
    moved = np.zeros(len(part), dtype=np.int64)
    for p in np.unique(part):
        ways = [np.flatnonzero((part == p) & (side == s) & (gain > 0)) for s in (0, 1)]
        n = min(map(len, ways)) // 2
        for nodes in ways:
            moved[nodes[np.argsort(-gain[nodes], kind="stable")[:n]]] = 1
    return moved


class Router:
    """One hidden layer from a vector to the probabilities of the parts."""

    def __init__(self, parts: int, weights: dict[str, np.ndarray] | None) -> None:
        self.parts, self.weights = parts, weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros((len(x), 1))
        w = self.weights
        h = np.maximum(((x - w["mean"]) / w["scale"]) @ w["A"] + w["a"], 0)
        return h @ w["B"] + w["b"]


def learn(x: np.ndarray, levels: int = LEVELS, seed: int = 5) -> Router:
    """Fit on the sample: targets are the parts of a vector and its neighbours."""
    k = min(GRAPH_NEIGHBOURS, len(x) - 1)
    if len(x) <= 2**levels or k < 1:
        return Router(1, None)
    graph = neighbour_graph(x, k)
    part = balanced_parts(graph, levels)
    n_parts = 2**levels
    target = np.zeros((len(x), n_parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), k), part[graph].ravel()), 1.0)
    np.add.at(target, (np.arange(len(x)), part), 1.0)
    target /= target.sum(axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0).max() + 1e-9
    z = (x - mean) / scale
    w = {
        "A": rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), "a": np.zeros(HIDDEN),
        "B": rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, n_parts)), "b": np.zeros(n_parts),
    }
    first = {n: np.zeros_like(v) for n, v in w.items()}
    second = {n: np.zeros_like(v) for n, v in w.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 128):
            rows = order[i : i + 128]
            h = np.maximum(z[rows] @ w["A"] + w["a"], 0)
            out = h @ w["B"] + w["b"]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            d = (out / out.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            dh = (d @ w["B"].T) * (h > 0)
            grads = {"A": z[rows].T @ dh, "a": dh.sum(axis=0), "B": h.T @ d, "b": d.sum(axis=0)}
            step += 1
            for n, g in grads.items():
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                w[n] = w[n] - 0.003 * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    return Router(n_parts, {**w, "mean": mean, "scale": scale})


def probes_for(router: Router, x: np.ndarray, held: np.ndarray, k: int, target: float = TARGET) -> int:
    """Fewest most probable parts that hold ``target`` of the held-out vectors' neighbours."""
    if router.weights is None or not len(held):
        return router.parts
    scores = router.scores(x)
    home = scores.argmax(axis=1)
    near = neighbour_graph(x, min(k, len(x) - 1))[held]
    rank = np.argsort(np.argsort(-scores[held], axis=1, kind="stable"), axis=1)
    at = np.sort(np.take_along_axis(rank, home[near], axis=1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(target * len(at))) - 1)]) + 1


def _routes(router, width: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = router.value.scores(matrix(batch.column("embedding"), width))
            best = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column("vec_id"),
                    "embedding": batch.column("embedding"),
                    "parts": pa.array(best.tolist(), pa.list_(pa.int32())),
                }
            )

    return run


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances from the differences themselves."""
    return np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))


def _nearest_in_block(k: int, width: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            rows = rows.sort_values("vec_id", kind="stable")
            ids = rows["vec_id"].to_numpy()
            x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
            norms = (x**2).sum(axis=1)
            for i in range(0, len(queries), QUERIES_AT_ONCE):
                some = queries.iloc[i : i + QUERIES_AT_ONCE]
                q = np.stack(some["embedding"].to_numpy()).astype(np.float64)
                squares = norms[None, :] - 2 * q @ x.T + (q**2).sum(axis=1)[:, None]
                for j, query in enumerate(some["vec_id"].to_numpy()):
                    own = squares[j]
                    own[ids == query] = np.inf
                    n = min(k, int((ids != query).sum()))
                    if not n:
                        continue
                    # squares have rounding errors: all that may be among the k are measured exactly
                    limit = np.partition(own, n - 1)[n - 1]
                    near = np.flatnonzero(own <= limit + 1e-9 * (1 + abs(limit) + norms.max()))
                    exact = distances(q[j : j + 1], x[near])[0]
                    order = np.lexsort((ids[near], exact))[:n]
                    out.append(pd.DataFrame({"query_id": query, "vec_id": ids[near][order], "score": exact[order]}))
        if not out:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return pd.concat(out)

    return run


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, probes: int | None = None, levels: int = LEVELS) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` nearest; queries: vec_id divisible by ``every``."""
    spark = vectors.sparkSession
    rows = usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null"))
    width = width_of(rows)
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
    points = np.array([r[0] for r in sample], dtype=np.float64).reshape(len(sample), width)
    held = np.arange(len(points)) % HELD_OUT == 0
    router = learn(points[~held], levels)
    probes = probes or probes_for(router, points, np.flatnonzero(held), k)
    shared = spark.sparkContext.broadcast(router)
    routed = "vec_id long, embedding array<float>, parts array<int>"
    kind = rows.schema["embedding"].dataType.simpleString()
    routed = routed.replace("array<float>", kind)
    index = written(
        rows.mapInArrow(_routes(shared, width, 1), routed).select("vec_id", "embedding", F.col("parts")[0].alias("part")), "index"
    )
    sizes = index.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))  # one row per part
    sizes = F.broadcast(sizes)
    stored = index.join(sizes, "part").select(
        "part", F.pmod(F.xxhash64("vec_id"), "blocks").alias("block"), "vec_id", "embedding"
    )
    queries = rows.where(F.col("vec_id") % every == 0).mapInArrow(_routes(shared, width, probes), routed)
    asked = (
        queries.select("vec_id", "embedding", F.explode("parts").alias("part"))
        .join(sizes, "part")
        .select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "vec_id", "embedding")
    )
    found = (
        asked.groupBy("part", "block")
        .cogroup(stored.groupBy("part", "block"))
        .applyInPandas(_nearest_in_block(k, width), "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
