"""Hard negatives by spanning trees over the anchors.

Anchors are dealt into blocks of near ones (by nearest pivot, then by hash); the anchors of one
label in a block are joined by a minimum spanning tree.  In a task a block meets a part of the
rows.  At the root of a tree the scores of all rows of the part are computed.  Below, a row's
score at the parent plus or minus the length of the edge times the norm of the row bounds its
score at the child; only rows whose bounds overlap what the child looks for are scored, the
others hand their bounds on.  A child looks for rows above its fifth best (positives, rows of
its own label) or inside the window of one of its positives (negatives, rows of other labels).
Every step is exact, so where vectors have no structure the bounds rule out little and the work
is that of all anchors against all rows.

A block holds about ``BLOCK`` anchors and a part about ``PART`` rows, whatever the table holds;
a hot label is many blocks and parts.  Tasks hand on a few rows an anchor, ranked in a window.

Defined results: rows without a vec_id or label, without a vector, or with null or non-finite
components take no part; an empty vector scores 0 with all, a shorter one counts as padded with
zeros; rows of one vec_id are one row, of which the smallest values are kept; a positive with a
score below 0 has no window; scores beyond 64 bits fail the query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitsieve.llm.tables import written

#: Anchors: vec_id divisible by this; relabelled rows: vec_id divisible by ``SHIFT``.
EVERY, SHIFT, CLASSES = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies within these hundredths of the positive's.
LOW, HIGH = 50, 95
SCALE = 256

BLOCK = 2_048
PIVOTS = 256
PART = 65_536
#: Rows a tree is walked with at a time.
ROWS_AT_ONCE = 4_096


def prepared(vectors: DataFrame) -> DataFrame:
    """Rows that take part, relabelled; one row a vec_id."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    shifted = F.when(F.col("vec_id") % SHIFT == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label"))
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null").where(fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), shifted.cast("long").alias("label"), "embedding")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.*")


def whole_numbers(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Components as whole numbers (in doubles), shorter vectors padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths(), dtype=np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = np.floor(SCALE * flat)
    return out


def products(rows: np.ndarray, anchor: np.ndarray, largest: float) -> np.ndarray:
    """Inner products; by whole numbers of any size where doubles would round."""
    if largest < 2.0**53:
        return rows @ anchor
    exact = [sum(int(a) * int(b) for a, b in zip(row, anchor)) for row in rows]
    if exact and max(map(abs, exact)) >= 2**63:
        raise ValueError("scores beyond 64 bits")
    return np.array(exact, dtype=object)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order from the root, parent's place in it (-1 at the root), and length of the edge to the parent."""
    n = len(points)
    near = np.sqrt(((points - points.mean(axis=0)) ** 2).sum(axis=1))
    node = int(near.argmin())
    best, parent = np.full(n, np.inf), np.full(n, -1)
    place = np.full(n, -1)
    order, parents, edges = [], [], []
    for i in range(n):
        place[node] = i
        order.append(node)
        parents.append(place[parent[node]] if i else -1)
        edges.append(best[node] if i else 0.0)
        away = np.sqrt(((points - points[node]) ** 2).sum(axis=1))
        closer = (away < best) & (place < 0)
        best[closer], parent[closer] = away[closer], node
        open_ = np.where(place < 0, best, np.inf)
        node = int(open_.argmin())
    return np.array(order), np.array(parents), np.array(edges)


TREE = "block int, vec_id long, label long, place int, parent int, edge double, embedding array<double>"


def _plant(width: int):
    """The trees of a block, one a label; places go on from tree to tree."""

    def run(table: pa.Table) -> pa.Table:
        points = whole_numbers(table.column("embedding"), width)
        labels = table.column("label").to_numpy()
        ids = table.column("vec_id").to_numpy()
        rows, parents, edges = [], [], []
        for label in np.unique(labels):
            own = np.flatnonzero(labels == label)
            own = own[np.argsort(ids[own])]
            order, parent, edge = spanning_tree(points[own])
            parents.append(np.where(parent < 0, -1, parent + sum(map(len, rows))))
            rows.append(own[order])
            edges.append(edge)
        at = np.concatenate(rows)
        return pa.table(
            {
                "block": table.column("block").take(pa.array(at)),
                "vec_id": pa.array(ids[at]), "label": pa.array(labels[at]),
                "place": pa.array(np.arange(len(at)), pa.int32()),
                "parent": pa.array(np.concatenate(parents), pa.int32()),
                "edge": pa.array(np.concatenate(edges)),
                "embedding": table.column("embedding").take(pa.array(at)).cast(pa.list_(pa.float64())),
            }
        )

    return run


def walk(
    anchors: np.ndarray,
    parent: np.ndarray,
    edge: np.ndarray,
    rows: np.ndarray,
    wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray],
    found: Callable[[int, np.ndarray, np.ndarray], None],
) -> int:
    """Go down the trees; ``found`` gets the scored rows of each anchor.  Returns how many were scored."""
    width = max(rows.shape[1], 1)
    largest = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * width
    norms = np.sqrt((rows**2).sum(axis=1))
    waiting = np.bincount(parent[parent >= 0], minlength=len(anchors))
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    scored = 0
    for j in range(len(anchors)):
        p = parent[j]
        if p < 0:
            at = np.arange(len(rows))
            low = high = np.zeros(len(rows))
        else:
            slack = edge[j] * norms * (1 + 1e-9) + 1e-6 + largest * 1e-12
            low, high = kept[p][0] - slack, kept[p][1] + slack
            at = np.flatnonzero(wanted(j, low, high))
            waiting[p] -= 1
            if not waiting[p]:
                del kept[p]
        if 2 * len(at) > len(rows):
            scores = products(rows, anchors[j], largest)[at]
        else:
            scores = products(rows[at], anchors[j], largest)
        scored += len(at)
        found(j, at, scores)
        if waiting[j]:
            low, high = low.copy(), high.copy()
            low[at] = high[at] = scores.astype(np.float64)
            kept[j] = (low, high)
    return scored


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id."""
    if len(scores) > 4 * k and scores.dtype != object:
        least = -np.partition(-scores, k - 1)[k - 1]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    if scores.dtype == object:
        return np.array(sorted(at.tolist(), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    return at[np.lexsort((ids[at], -scores[at]))][:k]


class Best:
    """The ``k`` best rows seen so far for each of some keys."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.scores = [np.zeros(0)] * n
        self.ids = [np.zeros(0, np.int64)] * n

    def least(self, i: int) -> float:
        """No row below this can enter."""
        return float(self.scores[i][-1]) if len(self.scores[i]) == self.k else -np.inf

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        fine = scores >= self.least(i)
        if fine.any():
            scores, ids = np.r_[self.scores[i], scores[fine]], np.r_[self.ids[i], ids[fine]]
            keep = best(scores, ids, self.k)
            self.scores[i], self.ids[i] = scores[keep], ids[keep]


def _chunks(rows: np.ndarray, ids: np.ndarray):
    for i in range(0, len(rows), ROWS_AT_ONCE):
        yield rows[i : i + ROWS_AT_ONCE], ids[i : i + ROWS_AT_ONCE]


def _trees(table: pa.Table, width: int):
    """Trees of a block by label: vectors, parents within the tree, edges and the table's places."""
    table = table.sort_by("place")
    points = whole_numbers(table.column("embedding"), width)
    labels = table.column("label").to_numpy()
    parent, edge = table.column("parent").to_numpy(), table.column("edge").to_numpy()
    for label in np.unique(labels):
        at = np.flatnonzero(labels == label)
        own = parent[at].astype(np.int64)
        yield int(label), at, points[at], np.where(own < 0, -1, own - at[0]), edge[at]


FOUND = "anchor_id long, other_id long, score long"


def _near(width: int, k: int):
    """The ``k`` best rows of its own label for each anchor of a block, from a part."""

    def run(trees: pa.Table, rows: pa.Table) -> pa.Table:
        anchor_ids = trees.sort_by("place").column("vec_id").to_numpy()
        out: list[tuple[int, int, int]] = []
        if len(trees) and len(rows):
            x, ids = whole_numbers(rows.column("embedding"), width), rows.column("vec_id").to_numpy()
            row_labels = rows.column("label").to_numpy()
            for label, at, points, parent, edge in _trees(trees, width):
                own = row_labels == label
                top = Best(len(at), k)
                for some, some_ids in _chunks(x[own], ids[own]):

                    def found(j, hit, scores, some_ids=some_ids):
                        other = some_ids[hit] != anchor_ids[at[j]]
                        top.add(j, scores[other], some_ids[hit][other])

                    walk(points, parent, edge, some, lambda j, low, high: high >= top.least(j), found)
                for j in range(len(at)):
                    out += [(int(anchor_ids[at[j]]), int(i), int(s)) for i, s in zip(top.ids[j], top.scores[j])]
        return _table(out, ("anchor_id", "other_id", "score"))

    return run


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})


MINED = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _windows(width: int, k: int, low: int, high: int):
    """The ``k`` best rows of other labels in the window of each anchor's positives, from a part."""

    def run(trees: pa.Table, rows: pa.Table) -> pa.Table:
        trees = trees.sort_by("place")
        anchor_ids = trees.column("vec_id").to_numpy()
        positives = trees.column("positives").to_pylist()
        out: list[tuple] = []
        if len(trees) and len(rows):
            x, ids = whole_numbers(rows.column("embedding"), width), rows.column("vec_id").to_numpy()
            row_labels = rows.column("label").to_numpy()
            for label, at, points, parent, edge in _trees(trees, width):
                own = row_labels != label
                pairs = [[(p["score"], p["other_id"]) for p in positives[i] or [] if p["score"] >= 0] for i in at]
                spans = [[(-(-low * s // 100), high * s // 100) for s, _ in of] for of in pairs]
                first = np.cumsum([0] + [len(of) for of in pairs])
                top = Best(int(first[-1]), k)

                def wanted(j, low_, high_):
                    hit = np.zeros(len(low_), dtype=bool)
                    for i, (a, b) in enumerate(spans[j]):
                        hit |= (high_ >= max(a, top.least(first[j] + i))) & (low_ <= b)
                    return hit

                for some, some_ids in _chunks(x[own], ids[own]):

                    def found(j, hit, scores, some_ids=some_ids):
                        for i, (a, b) in enumerate(spans[j]):
                            inside = (scores >= a) & (scores <= b)
                            top.add(first[j] + i, scores[inside], some_ids[hit][inside])

                    walk(points, parent, edge, some, wanted, found)
                for j, of in enumerate(pairs):
                    for i, (s, positive) in enumerate(of):
                        t = first[j] + i
                        out += [
                            (int(anchor_ids[at[j]]), positive, s, int(n), int(v)) for n, v in zip(top.ids[t], top.scores[t])
                        ]
        return _table(out, ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"))

    return run


def _nearest_pivot(pivots: np.ndarray, width: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = whole_numbers(batch.column("embedding"), width)
                away = (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(away.argmin(axis=1), pa.int32())], names=[*batch.schema.names, "pivot"]
                )

    return run


def _dealt(anchors: DataFrame, n: int, width: int, size: int) -> tuple[DataFrame, int]:
    """Anchors with the number of their block, and the number of blocks."""
    wanted = -(-n // size)
    if wanted > 1:
        some = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(PIVOTS, wanted)).select("embedding").toArrow()
        pivots = whole_numbers(some.column("embedding"), width)
        kind = anchors.schema["embedding"].dataType.simpleString()
        schema = f"vec_id long, label long, embedding {kind}, pivot int"
        anchors = anchors.mapInArrow(_nearest_pivot(pivots, width), schema)
    else:
        anchors = anchors.withColumn("pivot", F.lit(0))
    counts = {r["pivot"]: r["count"] for r in anchors.groupBy("pivot").count().collect()}  # PIVOTS rows at most
    starts, shares, total = [], [], 0
    for pivot in range(max(counts, default=0) + 1):
        shares.append(max(1, -(-counts.get(pivot, 0) // size)))
        starts.append(total)
        total += shares[-1]
    at = F.col("pivot") + 1
    start = F.element_at(F.array(*map(F.lit, starts)), at)
    share = F.element_at(F.array(*map(F.lit, shares)), at)
    block = start + F.pmod(F.xxhash64("vec_id"), share)
    return anchors.withColumn("block", block.cast("int")).drop("pivot"), total


def mine(
    vectors: DataFrame,
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block: int = BLOCK,
    part: int = PART,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    rows = written(prepared(vectors), "vectors")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    anchors = rows.where(F.col("vec_id") % every == 0)
    anchors, blocks = _dealt(anchors, anchors.count(), width, block)
    trees = written(anchors.groupBy("block").applyInArrow(_plant(width), TREE), "trees")
    parts = max(1, -(-n // part), -(-spark.sparkContext.defaultParallelism // blocks))

    def cells(table: DataFrame, there: str, number: int) -> DataFrame:
        return table.withColumn(there, F.explode(F.sequence(F.lit(0), F.lit(number - 1))))

    stored = cells(rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")), "block", blocks)
    stored = stored.groupBy("block", "part")
    near = cells(trees, "part", parts).groupBy("block", "part").cogroup(stored).applyInArrow(_near(width, positives), FOUND)
    order = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "other_id")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    near = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct("score", "other_id")).alias("positives")  # a few rows an anchor
    )
    asked = written(trees.join(near, "vec_id", "left"), "positives")
    mined = (
        cells(asked, "part", parts)
        .groupBy("block", "part")
        .cogroup(stored)
        .applyInArrow(_windows(width, negatives, low, high), MINED)
    )
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
