"""Operators over vectors beside brute force, with the awkward cases."""

import numpy as np
import pytest
from helpers import groups
from pyspark.sql import functions as F

from traitsieve.llm import neighbours, vector_dedup
from traitsieve.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, part string"


def made_vectors(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    for k in range(0, n // 3):  # near copies in chains
        x[k + n // 3] = x[k] + 0.06 * rng.normal(size=16).astype(np.float32)
    x[n - copies :] = x[0]
    return x


def frame(spark, x, labels):
    rows = [(i, [float(v) for v in r], int(c), 1, "x") for i, (r, c) in enumerate(zip(x, labels))]
    awkward = [
        (9001, None, 1, 1, "x"), (9002, [0.0] * 16, 1, 1, "x"), (9003, [float("nan")] * 16, 1, 1, "x"),
        (9004, [1.0] * 15 + [None], 1, 1, "x"), (9005, [float("inf")] * 16, 1, 1, "x"), (9006, rows[0][1], None, 1, "x"),
        (None, rows[0][1], rows[0][2], 1, "x"),
    ]
    return spark.createDataFrame(rows + awkward, SCHEMA)


@pytest.mark.parametrize("cell_rows", [vector_dedup.CELL_ROWS, 20])
def test_near_vectors(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(vector_dedup, "CELL_ROWS", cell_rows)
    x, labels = made_vectors(300, 1, copies=40), np.arange(300) % 2
    labels[-40:] = 0
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= vector_dedup.COSINE) & (labels[:, None] == labels[None, :]) & ~np.eye(300, dtype=bool)
    component = groups(range(300), zip(*np.nonzero(near)))
    got = {r["vec_id"]: r for r in vector_dedup.near_duplicates(frame(spark, x, labels)).collect()}
    assert len(got) == 307
    for i in range(300):
        assert (got[i]["n_links"], got[i]["component_id"]) == (near[i].sum(), component[i])
        assert got[i]["kept"] == (component[i] == i)
    for i in range(9001, 9007):
        assert tuple(got[i]) == (i, 0, i, True)
    assert tuple(got[None]) == (None, 0, None, True)


def test_jittered_copies_are_dealt_to_bounded_groups(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CELL_ROWS", 20)
    monkeypatch.setattr(vector_dedup, "BUCKET_ROWS", 20)
    seen, whole = spark.sparkContext.accumulator(0), vector_dedup._links

    def watched(*options):
        run = whole(*options)

        def counted(cells):
            largest = cells.groupby(["label", "tab", "cell", "part", *[c for c in ("one", "two") if c in cells]]).size().max()
            seen.add(int(largest > 70))
            return run(cells)

        return counted

    monkeypatch.setattr(vector_dedup, "_links", watched)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 16)).astype(np.float32)
    x[:120] = x[0] + 0.002 * rng.normal(size=(120, 16)).astype(np.float32)
    got = {r["vec_id"]: r for r in vector_dedup.near_duplicates(frame(spark, x, np.zeros(240))).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= vector_dedup.COSINE) & ~np.eye(240, dtype=bool)
    component = groups(range(240), zip(*np.nonzero(near)))
    for i in range(240):
        assert (got[i]["n_links"], got[i]["component_id"]) == (near[i].sum(), component[i])
    assert seen.value == 0


def test_calibration_of_projections():
    assert vector_dedup.miss_chance() < 1e-3
    rng = np.random.default_rng(0)
    m = vector_dedup.TABLES * vector_dedup.SORTED
    counts = (np.abs(rng.normal(size=(20_000, m))) <= vector_dedup.WINDOW).sum(axis=1)
    assert (counts >= vector_dedup.least_count(m)).mean() > 0.999


def test_nearest_in_clusters(spark):
    rng = np.random.default_rng(3)
    centres = 6 * rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16))).astype(np.float32)
    x[700:760] = x[0]  # ties go by id
    rows = frame(spark, x, np.zeros(1500))
    got = neighbours.nearest(rows).collect()
    usable = np.vstack([x, x[:1]]).astype(float)
    ids = np.r_[np.arange(1500), 9006]
    hits = total = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((usable - x[q].astype(float)) ** 2).sum(axis=1))
        order = np.lexsort((ids, d))
        order = order[ids[order] != q][:10]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        exact = {i: v for i, v in zip(ids, d)}
        assert all(r["score"] == exact[r["vec_id"]] for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(ids[order].tolist()))
        total += 10
        if q in (0, 700):
            assert [r["vec_id"] for r in mine] == ids[order].tolist()
    assert hits / total >= 0.9 and {r["query_id"] for r in got} == set(range(0, 1500, 100))


def test_probes_are_few_where_vectors_cluster():
    rng = np.random.default_rng(3)
    x = 6 * rng.normal(size=(32, 16))[rng.integers(0, 32, 2000)] + rng.normal(size=(2000, 16))
    held = np.arange(2000) % 4 == 0
    router = neighbours.learn(x[~held], 4)
    assert router.parts == 16 and neighbours.probes_for(router, x, np.flatnonzero(held), 10) <= 8


def test_parts_are_balanced():
    x = np.random.default_rng(0).normal(size=(500, 8))
    sizes = np.bincount(neighbours.balanced_parts(neighbours.neighbour_graph(x, 8), 3))
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 3


def test_few_and_no_vectors(spark):
    x = made_vectors(6, 2)
    some = frame(spark, x, np.zeros(6)).withColumn("vec_id", F.col("vec_id") * 100)
    got = neighbours.nearest(some).collect()
    assert {r["query_id"] for r in got} >= {0, 100, 500} and max(r["rank"] for r in got) == 6
    none = frame(spark, x, np.zeros(6)).where("false")
    assert neighbours.nearest(none).count() == 0 and vector_dedup.near_duplicates(none).count() == 0


def test_components_of_long_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 3)]
    got = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    want = groups({x for p in pairs for x in p}, pairs)
    assert all(got[n] == want[n] for n in got) and len(got) == len(want)
