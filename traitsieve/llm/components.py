"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitsieve.functions.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b): the smallest node reachable.

    A round takes each node's smallest neighbouring label, then the label of that
    label; rounds grow with the logarithm of a component's width.  Both directions of
    an edge are shuffled by node, minima are combined before the shuffle, and each
    round's labels go to the checkpoint folder.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.where("a <> b").distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy("a")
            .agg(F.min("label").alias("least"))
            .withColumnRenamed("a", "node")
        )
        met = labels.join(near, "node").select("node", F.least("label", "least").alias("met"), "label")
        up = labels.select(F.col("node").alias("met"), F.col("label").alias("up"))
        after = cut_lineage(
            met.join(up, "met", "left").select("node", F.least("met", F.coalesce("up", "met")).alias("new"), "label")
        )
        if after.where("new <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = after.select("node", F.col("new").alias("label"))


def spanning_forest(a: np.ndarray, b: np.ndarray, parent: np.ndarray, edges: list) -> None:
    """Add links to a spanning forest: by rounds of labels, without a step per link."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            return
        high, low = np.maximum(ra, rb), np.minimum(ra, rb)
        _, first = np.unique(high, return_index=True)
        edges.extend(zip(a[first].tolist(), b[first].tolist()))
        parent[high[first]] = low[first]
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
