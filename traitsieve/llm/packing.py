"""Best-fit packing under conflicts: no bin holds two pieces of one source or duplicate cluster.

Documents become pieces of at most ``capacity`` words.  Within a shard the pieces go, longest
first, to the open bin that they fill best.  Bins stand in lists by residual; each carries a
bitmap of its sources and one of its clusters.  The search starts at the piece's length and
walks to the next larger residual until a bin without conflict is found, else opens one.

Shards are ranges of a hash of the row, of about ``SHARD_PIECES`` pieces, so any table is
packed by many tasks with bounded memory; a shard wastes one part of a bin per conflict class
at most.  Only ids, lengths, sources and cluster hashes are shuffled, not texts.
Documents that have a slot in a schedule (``slot``) are packed in its order instead: shards are
consecutive ranges of slots, numbered in that order, and a slot of more than ``SHARD_PIECES``
pieces is cut by the hash.

Defined results: null, empty and blank texts are one piece of 0 words, with a bin like any
other piece; null sources conflict with nothing; a document's own pieces conflict as their source and
cluster are the same; texts are in a cluster when they are equal after trimming and lower-casing
(null and empty ones in none); repeated rows are documents of their own.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitsieve.llm.tables import written

CAPACITY = 2_048
SHARD_PIECES = 10_000
#: Slots whose pieces one task adds up.
SLOTS_A_RANGE = 4_096


class Bins:
    """Open bins by residual, each with its source and cluster bitmaps."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.residuals: list[int] = []  # residuals that have bins, ascending
        self.at: dict[int, list[int]] = {}
        self.common: dict[int, int] = {}  # sources that all bins of a residual hold, or fewer
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.left: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset for a piece; ``source`` and ``cluster`` are bits (0: no conflict)."""
        k = bisect_left(self.residuals, size)
        while k < len(self.residuals):
            residual = self.residuals[k]
            for b in () if self.common[residual] & source else self.at[residual]:
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    self._move(b, residual, size, source, cluster)
                    return b, self.capacity - residual
            k += 1
        self.left.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        b = len(self.left) - 1
        self._add(b, self.capacity)
        self._move(b, self.capacity, size, source, cluster)
        return b, 0

    def _add(self, b: int, residual: int) -> None:
        if residual not in self.at:
            self.at[residual] = []
            self.common[residual] = -1
            insort(self.residuals, residual)
        self.common[residual] &= self.sources[b]
        insort(self.at[residual], b)

    def _move(self, b: int, residual: int, size: int, source: int, cluster: int) -> None:
        bins = self.at[residual]
        bins.pop(bisect_left(bins, b))
        if not bins:
            del self.at[residual], self.common[residual]
            self.residuals.pop(bisect_left(self.residuals, residual))
        self.left[b] = residual - size
        self.sources[b] |= source
        self.clusters[b] |= cluster
        if self.left[b] > 0:
            self._add(b, self.left[b])


def _pack(capacity: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(
            ["size", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], na_position="last", kind="stable"
        )
        bins = Bins(capacity)
        # a cluster with one piece here cannot conflict and needs no bit
        shard["cluster"] = shard["cluster"].where(shard["cluster"].duplicated(keep=False))
        sources: dict = {}
        clusters: dict = {}
        bin_no, offset = [], []
        for size, source, cluster in zip(shard["size"], shard["source"], shard["cluster"]):
            one = 0 if pd.isna(source) else 1 << sources.setdefault(source, len(sources))
            two = 0 if pd.isna(cluster) else 1 << clusters.setdefault(cluster, len(clusters))
            b, o = bins.place(int(size), one, two)
            bin_no.append(b)
            offset.append(o)
        return shard.assign(bin_no=bin_no, offset=offset)[["doc_id", "piece", "size", "source", "slot", "shard", "bin_no", "offset"]]

    return run


def _slot_starts(items: DataFrame) -> DataFrame:
    """Per slot: its pieces, and the pieces of all slots before it, summed in two levels."""
    sums = items.groupBy("slot").agg(F.sum("pieces").alias("slot_pieces")).withColumn("range", F.floor(F.col("slot") / SLOTS_A_RANGE))
    ranges = sums.groupBy("range").agg(F.sum("slot_pieces").alias("n"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(earlier.orderBy("range")), F.lit(0)).alias("range_start"))
    inside = F.coalesce(F.sum("slot_pieces").over(earlier.partitionBy("range").orderBy("slot")), F.lit(0))
    sums = sums.withColumn("inside", inside).join(ranges, "range")
    return sums.select(F.col("slot").alias("of_slot"), "slot_pieces", (F.col("range_start") + F.col("inside")).alias("before"))


def pack(docs: DataFrame, capacity: int = CAPACITY, slot: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, n_words, source, bin_id, bin_offset; with ``slot`` also the slot."""
    text = F.coalesce("text", F.lit(""))
    folded = F.lower(F.trim(text))
    items = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"),
        F.when(folded != "", F.xxhash64(folded)).alias("cluster"),
        (F.col(slot) if slot else F.lit(None)).cast("long").alias("slot"),
    )
    items = items.withColumn("pieces", F.greatest(F.ceil(F.col("words") / capacity), F.lit(1)))
    key = F.xxhash64("doc_id", "cluster", "words")
    if slot:
        items = written(items, "slotted")
        starts = _slot_starts(items)
        items = items.join(starts, items.slot.eqNullSafe(starts.of_slot))
        cuts = F.ceil(F.col("slot_pieces") / SHARD_PIECES)
        items = items.withColumn("shard", F.floor(F.col("before") / SHARD_PIECES) + F.pmod(key, cuts))
        items = items.drop("of_slot", "slot_pieces", "before")
    else:
        total = items.agg(F.sum("pieces")).first()[0] or 0
        shards = max(1, -(-int(total) // SHARD_PIECES))
        items = items.withColumn("shard", F.pmod(key, F.lit(shards)))
    pieces = items.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("pieces") - 1).cast("long"))))
    pieces = pieces.withColumn("size", F.least(F.col("words") - F.col("piece") * capacity, F.lit(capacity))).drop("words", "pieces")
    packed = pieces.groupBy("shard").applyInPandas(
        _pack(capacity), "doc_id long, piece long, size long, source string, slot long, shard long, bin_no long, offset long"
    )
    return packed.select(
        "doc_id", "piece", F.col("size").alias("n_words"), "source",
        F.concat_ws("-", "shard", "bin_no").alias("bin_id"), F.col("offset").alias("bin_offset"),
        *([F.col("slot").alias(slot)] if slot else []),
    )
