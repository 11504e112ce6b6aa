"""Embedding near-duplicates by counting collisions of one-dimensional projections.

Vectors are taken to length 1, where a cosine of ``cosine`` is a distance of
``sqrt(2 - 2 cosine)``.  ``TABLES`` x ``SORTED`` random projections are made of each.  Two
vectors collide in a projection when the second lies in the window of ``WINDOW``
distances around the first.  A pair whose collisions, over all projections, reach the
calibrated count is verified by its exact cosine; the count is the largest that a
pair at the threshold reaches with probability ``RECALL`` (binomial law; a projection of a
difference is normal).

Counting pairs inside windows of single projections would meet a fixed share of all pairs.
So windows are taken in tables: a table sorts the vectors by one projection within cells of
its other projections (a grid with a shift of its own), and pairs are counted where they meet
in the sorted window of a cell.  The chance to meet in no table is part of the recall
(``miss_chance``); a pair that several tables find is taken from the first.

Equal vectors of a label are one representative with a number of copies; their cosine is 1.
A cell of a table with more than ``CELL_ROWS`` representatives is cut along the sorted
projection into ranges, each with the window beyond its end, so no task gets all of a dense spot.
A task gives per vector the number of its links and a spanning forest of them, never the pairs.

Defined results: vectors that are null, zero or not finite, and rows without a label, link with
nothing; so do rows without vec_id, which have no component; repeated rows are copies; rows of
one vec_id with different vectors are one vector of the result, with the links of them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, exp, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitsieve.functions.session import cut_lineage
from traitsieve.llm.components import components, spanning_forest
from traitsieve.llm.kernels import mix
from traitsieve.llm.tables import written
from traitsieve.llm.vectors import matrix, usable, width_of

COSINE = 0.93
TABLES = 24
#: Projections of a table: one is sorted, the others make its cells.
SORTED = 8
WINDOW = 2.5
CELL = 5.0
RECALL = 0.9999
CELL_ROWS = 2_000
#: Rows of cells that one task works on together.
BUCKET_ROWS = 8_000
#: Pairs whose collisions are counted together.
PAIRS_AT_ONCE = 20_000


def _inside(half_width: float) -> float:
    """Chance that a standard normal value is that near to 0."""
    return erf(half_width / sqrt(2))


def _same_cell(width: float) -> float:
    """Chance that two points at normal distance are in one cell ``width`` distances wide."""
    return erf(width / sqrt(2)) - 2 / (sqrt(2 * pi) * width) * (1 - exp(-width * width / 2))


def miss_chance(tables: int = TABLES, size: int = SORTED, window: float = WINDOW, cell: float = CELL) -> float:
    """Chance that a pair at the threshold meets in no table."""
    return (1 - _inside(window) * _same_cell(cell) ** (size - 1)) ** tables


def least_count(m: int, window: float = WINDOW, recall: float = RECALL) -> int:
    """Largest count that a pair at the threshold reaches with probability ``recall``."""
    p, below = _inside(window), 0.0
    for count in range(m + 1):
        below += comb(m, count) * p**count * (1 - p) ** (m - count)
        if below > 1 - recall:
            return count
    return m


def directions(width: int, tables: int = TABLES, size: int = SORTED, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Projections (tables x size of them) and the grids' shifts, from the seed."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(width, tables * size)), rng.random((tables, size - 1))


def _cells(x: np.ndarray, radius: float, tables: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Projections of unit vectors in units of ``radius``, and the cell of each table."""
    lines, shifts = directions(x.shape[1], tables, size)
    values = x @ lines / radius
    keys = np.zeros((len(x), tables), dtype=np.uint64)
    for t in range(tables):
        grid = np.floor(values[:, t * size + 1 : (t + 1) * size] / CELL + shifts[t]).astype(np.int64)
        for j in range(size - 1):
            keys[:, t] = mix(keys[:, t] ^ grid[:, j].astype(np.uint64))
    return values, keys


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _spread(width: int, radius: float, tables: int, size: int):
    """A row per vector and table: its cell and its place in the sorted projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, keys = _cells(_unit(matrix(batch.column("embedding"), width)), radius, tables, size)
            for t in range(tables):
                yield pa.RecordBatch.from_pydict(
                    {
                        "label": batch.column("label"),
                        "tab": pa.array(np.full(len(keys), t, dtype=np.int32)),
                        "cell": pa.array(keys[:, t].astype(np.int64)),
                        "place": pa.array(values[:, t * size]),
                        "rep": batch.column("rep"),
                    }
                )

    return run


def _windows(group: np.ndarray, place: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (sorted by group and place) of which the second is in the first one's window."""
    line = group * 1e4 + place
    ends = np.where(own, np.searchsorted(line, line + WINDOW + 1e-6, side="right"), 0)
    counts = np.maximum(ends - np.arange(len(line)) - 1, 0)
    total = np.cumsum(counts)
    low = 0
    while low < len(line):
        high = max(int(np.searchsorted(total, (total[low - 1] if low else 0) + PAIRS_AT_ONCE, side="right")), low + 1)
        some = counts[low:high]
        i = np.repeat(np.arange(low, high), some)
        j = np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some) + i + 1
        for q in range(0, len(i), PAIRS_AT_ONCE):
            x, y = i[q : q + PAIRS_AT_ONCE], j[q : q + PAIRS_AT_ONCE]
            near = place[y] - place[x] <= WINDOW
            yield x[near], y[near]
        low = high


def _links(width: int, cosine: float, radius: float, tables: int, size: int):
    least = least_count(tables * size)

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        of = ["label", "tab", "cell", "part", "one", "two"]
        cells = cells.sort_values([*of, "place", "rep"], kind="stable")
        group = cells.groupby(of, sort=False).ngroup().to_numpy()
        block, across = cells["block"].to_numpy(), (cells["one"] != cells["two"]).to_numpy()
        x = _unit(np.stack(cells["embedding"].to_numpy()).astype(np.float64))
        rep, tab, copies = (cells[c].to_numpy() for c in ("rep", "tab", "copies"))
        values, keys = _cells(x, radius, tables, size)
        values32 = values.astype(np.float32)
        lead = values[:, ::size]
        links = np.zeros(len(x), dtype=np.int64)
        parent, edges = np.arange(len(x)), []
        for i, j in _windows(group, cells["place"].to_numpy(), cells["own"].to_numpy()):
            apart = ~across[i] | (block[i] != block[j])  # pairs inside a block are counted in its own group
            i, j = i[apart], j[apart]
            near = (np.abs(values32[i] - values32[j]) <= WINDOW + 1e-4).sum(axis=1, dtype=np.int32) >= least
            i, j = i[near], j[near]
            met = (keys[i] == keys[j]) & (np.abs(lead[i] - lead[j]) <= WINDOW)
            first = ~(met & (np.arange(tables) < tab[i][:, None])).any(axis=1)
            i, j = i[first], j[first]
            same = (x[i] * x[j]).sum(axis=1) >= cosine
            i, j = i[same], j[same]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            spanning_forest(i, j, parent, edges)
        some = np.flatnonzero(links)
        ends = np.array(edges, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame(
            {
                "a": np.concatenate([rep[some], rep[ends[:, 0]]]),
                "b": np.concatenate([rep[some], rep[ends[:, 1]]]),
                "links": np.concatenate([links[some], np.zeros(len(ends), dtype=np.int64)]),
            }
        )

    return run


def _blocked(ranged: DataFrame, key: list[str]) -> tuple[DataFrame, int]:
    """Rows with their block in the range, once for each pair (one, two) of blocks; how many more these are."""
    sizes = ranged.where("ranges > 1").groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS)
    dense = written(sizes.select(*key, "n", F.ceil(F.col("n") / CELL_ROWS).alias("blocks")), "dense")
    more = dense.agg(F.sum(F.col("n") * (F.col("blocks") - 1))).first()[0] or 0
    rows = ranged.drop("ranges").join(dense.drop("n"), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).drop("blocks")
    pairs = rows.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    return pairs.drop("other"), int(more)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, size: int = SORTED) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    live = usable(rows).where("label is not null and vec_id is not null")
    width = width_of(live)
    radius = sqrt(2 - 2 * cosine)
    # equal vectors of a label: one representative; the text form of a vector is its key
    keyed = live.select("vec_id", "label", "embedding", F.xxhash64("embedding").alias("h1"), F.md5(F.col("embedding").cast("string")).alias("h2"))
    groups = keyed.groupBy("label", "h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.min("embedding").alias("embedding")
    )
    reps = written(groups, "reps")
    placed = reps.select("label", "rep", "embedding").mapInArrow(
        _spread(width, radius, tables, size), f"{_label(reps)}, tab int, cell long, place double, rep long"
    )
    key = ["label", "tab", "cell"]
    placed = written(placed, "cells")
    counts = placed.groupBy(*key).agg(F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high"))
    counts = counts.where("n > 1").withColumn("ranges", F.ceil(F.col("n") / CELL_ROWS))
    span = F.greatest((F.col("high") - F.col("low")) / F.col("ranges"), F.lit(WINDOW))
    ranged = placed.join(counts.withColumn("span", span).drop("high"), key)
    at = F.floor((F.col("place") - F.col("low")) / F.col("span"))
    # the range a vector is in, and those before it whose windows reach it
    reach = F.floor((F.col("place") - WINDOW - F.col("low")) / F.col("span"))
    ranged = ranged.withColumn("own_range", at).withColumn(
        "part", F.explode(F.sequence(F.greatest(reach, F.lit(0).cast("long")), at))
    )
    ranged = ranged.select(*key, "part", "rep", "place", (F.col("part") == F.col("own_range")).alias("own"), "ranges")
    blocked, n_placed = _blocked(ranged, [*key, "part"])
    full = blocked.join(reps.select("rep", F.col("label").alias("rep_label"), "embedding", "copies"), "rep")
    full = full.where("label = rep_label").drop("rep_label")
    buckets = max(1, -(-(placed.count() + n_placed) // BUCKET_ROWS))
    full = full.withColumn("bucket", F.pmod(F.xxhash64(*key, "part", "one", "two"), F.lit(buckets)))
    found = written(
        full.groupBy("bucket").applyInPandas(_links(width, cosine, radius, tables, size), "a long, b long, links long"), "links"
    )
    copies = keyed.join(reps.select("label", "h1", "h2", "rep", "copies"), ["label", "h1", "h2"])
    edges = copies.where("vec_id > rep").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))
    joined = components(cut_lineage(edges.union(found.where("a <> b").select("a", "b"))))
    of_rep = found.where("a = b").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep")
    linked = (
        copies.select("vec_id", "rep", "copies").distinct().join(of_rep, "rep", "left")
        .groupBy("vec_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    out = rows.select("vec_id").join(linked, "vec_id", "left").join(joined, rows.vec_id == joined.node, "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _label(reps: DataFrame) -> str:
    return f"label {reps.schema['label'].dataType.simpleString()}"
