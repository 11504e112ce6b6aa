"""Exact nearest neighbours and the classifier that votes among them.

Training rows are grouped around pivots; a query visits only the groups that the
triangle inequality cannot rule out (Lu et al., VLDB 2012).  Rows in clusters visit
few groups; on wide data without structure (64 independent dimensions) the
inequality rules out nothing and exact search compares all pairs of blocks.  Groups are cut into
blocks of bounded size, which spreads a crowded group over many tasks.

The blocks are written once, and a task passes a part of the query blocks over a part of the
training blocks (a replicated nested loop: nothing but the two parts is read, nothing shuffled).  It keeps the k
nearest of each of its queries, so what is shuffled are k rows for each query and part.
A block pair is first compared roughly (squares by a matrix product, absolute differences in
single precision); what the rounding error cannot rule out is worked out exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitsieve.functions.session import scratch_path, written
from traitsieve.table import FeatureTable

NEIGHBOURS = 5
BLOCK_NUMBERS = 1_000_000
ROWS_PER_PIVOT = 2048
MAX_PIVOTS = 256
PIVOT_NUMBERS = 2_000_000
SLACK = 1e-9
#: Bytes of packed rows in a part of the training blocks and of the query blocks.
TRAIN_PART = 64_000_000
QUERY_PART = 16_000_000
#: A small table's queries still go to so many parts, if they have so many blocks.
QUERY_PARTS = 96
#: Bytes of the pairs of blocks that a task's Python gets at a time.
BATCH_BYTES = 32_000_000
#: Pairs whose exact distances are worked out at a time.
EXACT_NUMBERS = 2_000_000


def _distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Pairwise Minkowski distances, a few rows of ``a`` at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        gap = np.abs(a[i : i + step, None, :] - b[None, :, :])
        out[i : i + step] = gap.sum(-1) if p == 1 else np.sqrt((gap * gap).sum(-1))
    return out


def _whole(table: FeatureTable) -> FeatureTable:
    """The table; a missing cell fails the query, for a distance to it has no meaning."""
    missing = F.raise_error(F.lit("missing cell: impute before searching neighbours")).cast("double")
    return table.with_values(F.transform("values", lambda v: F.coalesce(F.nanvl(v, F.lit(None)), missing)))


def _pivot_count(rows: int, width: int) -> int:
    return max(1, min(rows // ROWS_PER_PIVOT, MAX_PIVOTS, PIVOT_NUMBERS // max(1, width)))


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    values = table.column("values").combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


def _by_key(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[("row_id", "ascending")], null_placement="at_start"))


def _one_list(column: pa.ChunkedArray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column.combine_chunks())


def _packed(width: int):
    """A block of training rows as one row, sorted by key."""

    def run(table: pa.Table) -> pa.Table:
        rows = _by_key(table)
        return pa.table(
            {
                "cell": rows.column("cell").slice(0, 1),
                "t_ids": _one_list(rows.column("row_id")),
                "t_labels": _one_list(rows.column("label")),
                "t_values": pa.array([_matrix(rows, width).tobytes()], pa.binary()),
            }
        )

    return run


def _packed_queries(width: int, visits):
    """A block of queries as one row, with the groups it visits."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        values = _matrix(table, width)
        return pa.table(
            {
                "q_cell": pa.array([key[0].as_py()], pa.int32()),
                "q_part": pa.array([key[1].as_py()], pa.int32()),
                "visits": pa.array([visits(values).tolist()], pa.list_(pa.int32())),
                "q_ids": _one_list(table.column("row_id")),
                "q_values": pa.array([values.tobytes()], pa.binary()),
            }
        )

    return run


def _rough(q: np.ndarray, t: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances (squares for ``p`` = 2) and, by query, how far rounding may have moved them."""
    width = q.shape[1]
    if p == 2:
        q2, t2 = (q * q).sum(axis=1), (t * t).sum(axis=1)
        out = q @ t.T
        out *= -2
        out += t2
        out += q2[:, None]
        return out, (width + 8) * 2.0**-50 * (q2 + t2.max(initial=0.0))
    q1, t1 = np.abs(q).sum(axis=1), np.abs(t).sum(axis=1).max(initial=0.0)
    if not np.all(q1 + t1 < 1e30):
        return _distances(q, t, 1), np.zeros(len(q))
    single, turned = q.astype(np.float32), np.ascontiguousarray(t.T.astype(np.float32))
    out, gap, ones = np.empty((len(q), len(t)), np.float32), np.empty_like(turned), np.ones(width, np.float32)
    for i in range(len(q)):
        np.subtract(turned, single[i][:, None], out=gap)
        np.abs(gap, out=gap)
        np.dot(ones, gap, out=out[i])
    return out, (width + 8) * 2.0**-22 * (q1 + t1) + 1e-30


class _Best:
    """The k nearest of a block of queries so far."""

    def __init__(self, ids: pa.ListScalar, values: bytes, width: int, k: int, p: int) -> None:
        # a copy: a slice would hold the whole batch that it came in
        self.ids, self.k, self.p = pa.array(ids.as_py(), ids.type.value_type), k, p
        self.q = np.frombuffer(values).reshape(-1, width)
        n = len(self.q)
        self.distance = np.full((n, k), np.nan)
        self.count = np.zeros(n, dtype=np.int64)
        self.near = np.full((n, k), None, dtype=object)
        self.label = np.full((n, k), None, dtype=object)

    def add(self, ids: pa.ListScalar, labels: pa.ListScalar, values: bytes) -> None:
        t = np.frombuffer(values).reshape(-1, self.q.shape[1])
        rough, slack = _rough(self.q, t, self.p)
        # not above the k-th of this block, nor above the k-th so far
        limit = np.full(len(self.q), np.inf)
        full = self.count == self.k
        if len(t) > self.k and not full.all():
            limit[~full] = np.partition(rough[~full], self.k - 1, axis=1)[:, self.k - 1] + slack[~full]
        known = self.distance[full, -1]
        limit[full] = (known * known if self.p == 2 else known) * (1 + SLACK)
        # a distance that is no number is kept here too
        row, col = np.nonzero(~(rough > (limit + slack)[:, None]))
        if not len(row):
            return
        distance = np.empty(len(row))
        step = max(1, EXACT_NUMBERS // self.q.shape[1])
        for i in range(0, len(row), step):
            gap = np.abs(self.q[row[i : i + step]] - t[col[i : i + step]])
            distance[i : i + step] = gap.sum(-1) if self.p == 1 else np.sqrt((gap * gap).sum(-1))
        order = np.lexsort((col, distance, row))  # the block is sorted by key, so ties go by key
        row, col, distance = row[order], col[order], distance[order]
        first = _place(row) < self.k
        row, col, distance = row[first], col[first], distance[first]
        touched = np.zeros(len(self.q), dtype=bool)
        touched[row] = True
        old = np.arange(self.k) < np.where(touched, self.count, 0)[:, None]
        names = np.empty(len(t), dtype=object)
        names[:] = ids.as_py()
        classes = np.empty(len(t), dtype=object)
        classes[:] = labels.as_py()
        row = np.concatenate([np.nonzero(old)[0], row])
        distance = np.concatenate([self.distance[old], distance])
        name, label = np.concatenate([self.near[old], names[col]]), np.concatenate([self.label[old], classes[col]])
        order = np.lexsort((distance, row))
        same = (row[order][1:] == row[order][:-1]) & ~(distance[order][1:] != distance[order][:-1])
        if same.any():
            by_key = sorted(range(len(name)), key=lambda i: (name[i] is not None, name[i]))
            rank = np.empty(len(name), dtype=np.int64)
            rank[by_key] = np.arange(len(name))
            order = np.lexsort((rank, distance, row))
        order = order[_place(row[order]) < self.k]
        row = row[order]
        at = row, _place(row)
        self.distance[at], self.near[at], self.label[at] = distance[order], name[order], label[order]
        self.count[touched] = np.bincount(row, minlength=len(self.q))[touched]

    def rows(self, id_type: pa.DataType, label_type: pa.DataType) -> pa.RecordBatch:
        held = np.arange(self.k) < self.count[:, None]
        return pa.RecordBatch.from_arrays(
            [
                self.ids.take(pa.array(np.nonzero(held)[0])),
                pa.array(self.near[held].tolist(), id_type),
                pa.array(self.label[held].tolist(), label_type),
                pa.array(self.distance[held]),
            ],
            names=["row_id", "neighbour_id", "neighbour_label", "distance"],
        )


def _place(row: np.ndarray) -> np.ndarray:
    """Place of each entry among those of the same row; rows are sorted."""
    if not len(row):
        return np.zeros(0, dtype=np.int64)
    start = np.r_[True, row[1:] != row[:-1]]
    return np.arange(len(row)) - np.flatnonzero(start)[np.cumsum(start) - 1]


def _nearest_of_pairs(width: int, k: int, p: int):
    """The k nearest of each query among the training blocks that it meets in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], _Best] = {}
        types = None
        for batch in batches:
            types = [batch.schema.field(c).type.value_type for c in ("t_ids", "t_labels")]
            keys = zip(batch.column("q_cell").to_pylist(), batch.column("q_part").to_pylist())
            for i, key in enumerate(keys):
                if key not in best:
                    best[key] = _Best(batch.column("q_ids")[i], batch.column("q_values")[i].as_py(), width, k, p)
                best[key].add(batch.column("t_ids")[i], batch.column("t_labels")[i], batch.column("t_values")[i].as_py())
        for found in best.values():
            yield found.rows(*types)

    return run


def _over_pairs(q: DataFrame, t: DataFrame, run, rows: int, schema: str) -> DataFrame:
    """``run`` over the pairs of blocks that meet, in batches of ``rows`` pairs.

    Batches are limited by rows, of which a session has one number; pairs are wide, so they
    get a session of their own, and its result is read back from the shared folder.
    """
    spark = q.sparkSession
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    q, t = (own.read.schema(x.schema).parquet(*x.inputFiles()) for x in (q, t))
    pairs = q.join(t.hint("shuffle_replicate_nl"), F.array_contains("visits", F.col("cell")))
    path = scratch_path(spark, "neighbour-found")
    pairs.drop("visits", "cell").mapInArrow(run, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def nearest_neighbours(
    train: FeatureTable,
    queries: FeatureTable,
    k: int = NEIGHBOURS,
    p: int = 2,
    pivots: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """``row_id, position, neighbour_id, neighbour_label, distance``, k per query.

    Equal distances go to the smaller neighbour key.
    """
    width = train.width
    train, queries = _whole(train), _whole(queries)
    if block_rows is None:
        # A block is one row of a few megabytes, however wide the table.
        block_rows = max(16, min(1024, BLOCK_NUMBERS // width))
    n_train = train.df.count()
    count = _pivot_count(n_train, width) if pivots is None else min(pivots, n_train)
    # Pivots and group figures are capped in number, whatever the data size.
    chosen = train.df.orderBy(F.xxhash64("row_id"), "row_id").select("values").limit(count).collect()
    centres = np.array([r["values"] for r in chosen], dtype=float).reshape(-1, width)

    @F.pandas_udf("cell int, reach double")
    def place(values: pd.Series) -> pd.DataFrame:
        d = _distances(np.stack(values.to_numpy()), centres, p)
        cell = d.argmin(1)
        return pd.DataFrame({"cell": cell.astype("int32"), "reach": d[np.arange(len(d)), cell]})

    # Of equal rows only the k smallest keys can be among anyone's k nearest; each
    # task drops the others before the shuffle, so a crowd of copies stays small.
    copy = F.row_number().over(Window.partitionBy("values").orderBy("row_id"))
    useful = (
        train.df.select("row_id", "label", "values", copy.alias("_copy"))
        .filter(F.col("_copy") <= k)
        .drop("_copy")
    )
    placed = useful.select("row_id", "label", "values", place("values").alias("at")).select(
        "row_id", "label", "values", "at.cell", "at.reach"
    )
    placed = written(placed, "neighbour-rows")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius")).collect()
    closest = Window.partitionBy("cell").orderBy("reach")
    near = (
        placed.select("cell", "reach", F.row_number().over(closest).alias("pos"))
        .filter(F.col("pos") <= k)
        .collect()
    )
    radius = np.full(len(centres), -np.inf)
    blocks = [1] * len(centres)
    for r in sizes:
        radius[r["cell"]] = r["radius"]
        blocks[r["cell"]] = -(-r["n"] // block_rows)
    near_cell = np.array([r["cell"] for r in near], dtype=int)
    near_reach = np.array([r["reach"] for r in near])

    asked = queries.df.select("row_id", "values", place("values")["cell"].alias("cell"))
    asked_blocks = [1] * len(centres)
    n_queries = 0
    for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        asked_blocks[r["cell"]] = -(-r["n"] // block_rows)
        n_queries += r["n"]

    def visits(values: np.ndarray) -> np.ndarray:
        """Groups that some of these queries must visit."""
        d = _distances(values, centres, p)
        # Every known point lies within (distance to its pivot) + (its reach).
        bound = d[:, near_cell] + near_reach
        limit = np.partition(bound, k - 1, axis=1)[:, k - 1] if bound.shape[1] >= k else np.full(len(d), np.inf)
        keep = ~(d - radius > (limit * (1 + SLACK) + SLACK)[:, None])
        return np.flatnonzero((keep & np.isfinite(radius)).any(axis=0))

    id_type, label_type = dict(train.df.dtypes)["row_id"], dict(train.df.dtypes)["label"]
    query_type = dict(queries.df.dtypes)["row_id"]

    def block(per_cell: list[int]):
        return F.pmod(F.xxhash64("row_id"), F.get(F.lit(per_cell), F.col("cell"))).cast("int")

    train_blocks = placed.groupBy("cell", block(blocks).alias("part")).applyInArrow(
        _packed(width), f"cell int, t_ids array<{id_type}>, t_labels array<{label_type}>, t_values binary"
    )
    query_blocks = asked.groupBy("cell", block(asked_blocks).alias("part")).applyInArrow(
        _packed_queries(width, visits), f"q_cell int, q_part int, visits array<int>, q_ids array<{query_type}>, q_values binary"
    )
    held = -(-n_queries * width * 8 // QUERY_PART)
    train_blocks = train_blocks.repartition(max(1, -(-n_train * width * 8 // TRAIN_PART)))
    query_blocks = query_blocks.repartition(max(1, held, min(QUERY_PARTS, sum(asked_blocks))))
    t, q = written(train_blocks, "neighbour-train"), written(query_blocks, "neighbour-queries")
    found = _over_pairs(
        q, t, _nearest_of_pairs(width, k, p), max(1, BATCH_BYTES // (16 * width * block_rows)),
        f"row_id {query_type}, neighbour_id {id_type}, neighbour_label {label_type}, distance double",
    )
    nearest = Window.partitionBy("row_id").orderBy("distance", "neighbour_id")
    return (
        found.withColumn("position", F.row_number().over(nearest))
        .filter(F.col("position") <= k)
        .select("row_id", "position", "neighbour_id", "neighbour_label", "distance")
    )


def knn_votes(neighbours: DataFrame, weights: str = "uniform") -> DataFrame:
    """``row_id, class, share``: vote of the neighbours per class.

    With ``distance`` a vote weighs 1/distance; neighbours at distance 0, if any,
    vote alone.
    """
    if weights not in ("uniform", "distance"):
        raise ValueError(f"unknown weights {weights!r}")
    query = Window.partitionBy("row_id")
    if weights == "uniform":
        weight = F.lit(1.0)
    else:
        touching = F.max((F.col("distance") == 0).cast("int")).over(query) == 1
        alone = (F.col("distance") == 0).cast("double")
        weight = F.when(touching, alone).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
    per_class = (
        neighbours.select("row_id", F.col("neighbour_label").alias("class"), weight.alias("w"))
        .groupBy("row_id", "class")
        .agg(F.sum("w").alias("w"))
    )
    return per_class.select("row_id", "class", (F.col("w") / F.sum("w").over(query)).alias("share"))


def knn_classify(
    train: FeatureTable,
    queries: FeatureTable,
    k: int = NEIGHBOURS,
    weights: str = "uniform",
    p: int = 2,
    **options,
) -> DataFrame:
    """``row_id, prediction, share``; equal votes go to the smaller label."""
    votes = knn_votes(nearest_neighbours(train, queries, k, p, **options), weights)
    order = Window.partitionBy("row_id").orderBy(F.desc(F.round("share", 12)), "class")
    return (
        votes.withColumn("_pos", F.row_number().over(order))
        .filter("_pos = 1")
        .select("row_id", F.col("class").alias("prediction"), "share")
    )
