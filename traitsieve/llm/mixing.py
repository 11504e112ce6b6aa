"""Mixing sources to target weights by Pfair scheduling of blocks.

Each source's documents, in the order of a hash of their ids, are laid end to end and
cut into blocks of ``block`` bytes.  A source of weight w gives its block i the release
``floor(i / w)`` and the deadline ``ceil((i + 1) / w)``, in slots; each slot takes, of the
released blocks, the one with the earliest deadline (ties: the larger source first).  Weights
are fractions of whole numbers, never rounded to a frame, so at every slot of any schedule a
source is less than one block away from its share.  When a source has no blocks left the
others go on: from there a new phase has their weights only and counts from zero.

The schedule is one pass over the blocks in one task, which holds a line per source and writes
its slots to a table.  By default a block is 64 KB, or a ``SLOTS_MOST``-th of the bytes where that
is more, so that pass has the same bound on a table of any size.  The ``SOURCES_MOST`` largest
sources are scheduled one by one; what all others hold is one more source, of their summed
weight, within which the hash order mixes them.

The running length of a source is made in two levels: sums of hash ranges, then sums
inside a range, so that a source with a third of all rows is not one task's work.

Defined results: null sources are a source of their own, null texts have length 0, empty
ones too; a document belongs to the block in which it begins, empty ones at the end of a source to its last;
sources that given weights do not name have weight 0 and follow after all others, in one hash order; repeated rows stay.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traitsieve.llm.tables import written

BLOCK = 65_536
#: Blocks of the schedule where the block is not given (a source's last block may be one more).
SLOTS_MOST = 1 << 20
#: Documents of a source that one task adds up.
RANGE_DOCS = 2_000
#: Sources scheduled one by one; those beyond share the slots of one.
SOURCES_MOST = 4_000
#: Group of the documents of all other sources.
OTHERS = -1
#: Default weights are whole numbers of these parts.
PARTS = 1_000_000
#: Slots handed on at a time.
BATCH = 65_536


def whole_weights(weights: dict) -> dict:
    """The same proportions in whole numbers; only positive ones."""
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0}
    common = lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * common) for s, w in exact.items()}


def schedule(blocks: dict, weights: dict) -> Iterator[tuple]:
    """Source and block of each slot, earliest deadline first among released blocks.

    ``blocks`` counts the blocks of each source; ``weights`` are whole numbers and their order
    breaks ties.  A phase ends with the last block of a source.
    """
    left = {s: blocks[s] for s in weights if blocks.get(s, 0) > 0}
    ranks = {s: i for i, s in enumerate(left)}
    start = dict.fromkeys(left, 0)
    while left:
        total = sum(weights[s] for s in left)
        share = {s: weights[s] for s in left}
        done = dict.fromkeys(left, 0)
        ready = [(-(-total // w), ranks[s], s) for s, w in share.items()]  # every first block is released at once
        heapq.heapify(ready)
        later: list[tuple] = []
        now, ended = 0, None
        while ended is None:
            while later and later[0][0] <= now:
                _, rank, s = heapq.heappop(later)
                heapq.heappush(ready, (-(-(done[s] + 1) * total // share[s]), rank, s))
            _, rank, s = heapq.heappop(ready)
            yield s, start[s] + done[s]
            done[s] += 1
            now += 1
            if done[s] == left[s]:
                ended = s
            else:
                heapq.heappush(later, (done[s] * total // share[s], rank, s))
        for s, n in done.items():
            start[s] += n
            left[s] -= n
        del left[ended]


def _slots(spark: SparkSession, blocks: dict, weights: dict) -> DataFrame:
    """The schedule as a table: group, block, slot.  A lost task makes the same slots again."""

    def run(frames):
        for frame in frames:
            if not len(frame):
                continue
            rows: list[tuple] = []
            for slot, (group, block) in enumerate(schedule(blocks, weights)):
                rows.append((group, block, slot))
                if len(rows) == BATCH:
                    yield pd.DataFrame(rows, columns=["p_group", "p_block", "p_slot"])
                    rows = []
            yield pd.DataFrame(rows, columns=["p_group", "p_block", "p_slot"])

    one = spark.range(0, 1, 1, 1)
    return written(one.mapInPandas(run, "p_group long, p_block long, p_slot long"), "slots")


def _groups(docs: DataFrame, weights: dict | None, power: float) -> tuple[list[dict], dict]:
    """Sources scheduled one by one, and what all others hold together: bytes, documents, weight."""
    n = F.coalesce(F.sum(F.octet_length(F.coalesce("text", F.lit("")))), F.lit(0))
    per = docs.groupBy(F.col("source").cast("string").alias("source")).agg(n.cast("long").alias("bytes"), F.count("*").alias("docs"))
    flat = F.round(F.pow(F.greatest("bytes", F.lit(1)), F.lit(power)) * PARTS).cast("decimal(38,0)")
    per = written(per.withColumn("weight", flat), "sources")
    if weights is None:
        listed = per.orderBy(F.desc("bytes"), "source").limit(SOURCES_MOST)
    else:
        wanted = {None if s is None else str(s): w for s, w in weights.items() if w > 0}
        named = F.col("source").isin([s for s in wanted if s is not None])
        listed = per.where(F.coalesce(named, F.lit(None in wanted))).orderBy(F.desc("bytes"), "source")
    found = [r.asDict() for r in listed.collect()]  # SOURCES_MOST rows, or one for each given weight
    whole = per.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bytes", "docs", "weight"))).first().asDict()
    others = {c: int(whole[c]) - sum(int(r[c]) for r in found) for c in whole}
    if weights is None:
        return found, others
    return [{**r, "weight": wanted[r["source"]]} for r in found], {**others, "weight": 0}


def mix(
    docs: DataFrame, weights: dict | None = None, power: float = 0.7, block: int | None = None, columns: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``mix_block`` (of its source), ``mix_slot`` and ``mix_place`` (byte at which it begins).

    ``weights`` are targets by source; by default each source's bytes to ``power``.
    ``columns`` are those of ``docs`` to carry along (all by default); without the text only
    lengths are shuffled.  ``mix_bytes`` is a document's length.
    """
    columns = docs.columns if columns is None else columns
    spark = docs.sparkSession
    found, others = _groups(docs, weights, power)
    block = block or max(BLOCK, -(-(sum(r["bytes"] for r in found) + others["bytes"]) // SLOTS_MOST))
    numbered = dict(enumerate(found)) | ({OTHERS: others} if others["docs"] else {})
    blocks = {g: max(1, -(-r["bytes"] // block)) for g, r in numbered.items()}
    shares = whole_weights({g: r["weight"] for g, r in numbered.items()})
    most = max((r["docs"] for r in numbered.values()), default=1)
    ranges = max(1, -(-most // RANGE_DOCS))

    names = spark.createDataFrame([(g, r["source"], blocks[g]) for g, r in enumerate(found)], "g long, g_source string, g_blocks long")
    key = F.xxhash64("doc_id", "text")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    packed = docs.select("doc_id", "source", "text", F.struct(F.lit(0).alias("0"), *columns).alias("mix_row"))
    placed = packed.withColumns({"mix_key": key, "mix_size": size}).drop("text")
    # one short row for each source scheduled by itself: SOURCES_MOST, or the given weights
    placed = placed.join(F.broadcast(names), placed.source.cast("string").eqNullSafe(names.g_source), "left").select(
        "doc_id", "mix_row", "mix_key", "mix_size",
        F.coalesce("g", F.lit(OTHERS)).alias("mix_group"),
        F.coalesce("g_blocks", F.lit(blocks.get(OTHERS, 1))).alias("mix_blocks"),
        F.pmod(F.shiftrightunsigned("mix_key", 40), F.lit(ranges)).alias("mix_range"),
    )
    sums = placed.groupBy("mix_group", "mix_range").agg(F.sum("mix_size").alias("mix_sum"))
    before = Window.partitionBy("mix_group").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("mix_sum").over(before), F.lit(0)).alias("mix_before")
    sums = written(sums.select("mix_group", "mix_range", start), "ranges")

    inside = Window.partitionBy("mix_group", "mix_range").orderBy("mix_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("mix_size").over(inside), F.lit(0))
    rows = placed.withColumn("mix_within", within).join(sums, ["mix_group", "mix_range"])
    rows = rows.withColumn("mix_place", F.col("mix_before") + F.col("mix_within"))
    rows = rows.withColumn("mix_block", F.least(F.floor(F.col("mix_place") / block), F.col("mix_blocks") - 1))
    slots = _slots(spark, blocks, shares)
    end = sum(blocks[g] for g in shares)
    rows = rows.join(slots, (rows.mix_group == slots.p_group) & (rows.mix_block == slots.p_block), "left")
    carried = [F.col("mix_row")[c].alias(c) for c in columns]
    slot = F.coalesce("p_slot", F.lit(end) + F.col("mix_block")).alias("mix_slot")
    return rows.select(*carried, "mix_block", slot, "mix_place", F.col("mix_size").alias("mix_bytes"))


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs``, rows in the order of the schedule."""
    names = docs.columns
    whole = docs.select("doc_id", "text", "source", F.struct(F.lit(0).alias("0"), *names).alias("row"))
    rows = mix(whole, columns=["doc_id", "row"], **options)
    return rows.orderBy("mix_slot", "mix_place", "doc_id").select(*(F.col("row")[c].alias(c) for c in names))
