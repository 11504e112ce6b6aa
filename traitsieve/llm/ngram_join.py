"""Jaccard join of documents on word shingles, split into light and heavy sets by size.

Two sets link when ``100 * |both| >= 80 * |either|``.  Then both hold at least
``ceil(0.8 s)`` common shingles, s their own size, so under one order of all shingles
their first ``s - ceil(0.8 s) + c`` share at least ``c`` (or all common ones, if fewer).

* Light sets enumerate all subsets of ``SUBSET`` shingles of that leading part; one
  equal subset makes a candidate.
* Heavy sets put their leading part for ``overlap(s)`` common shingles into inverted lists;
  scanning the lists counts common shingles per pair, and a pair of sizes s and t is a candidate
  with as many as any link of these sizes has there (``_common_needed``).
* The boundary is the size at which the records of both kinds are fewest, from the
  histogram of sizes.  Sets near below it do both, for their heavier partners.

The order puts shingles seen often first in no list: they rank last, the others by hash.
Which shingles count as frequent changes the cost, never the result.

Equal sets are one class, held by its smallest document.  A list of up to ``SMALL``
classes gives all its pairs; they are verified on whole sets once enough lists have named them.
A longer list gives none: its sets join the group of the list's centre, the set that most
others share shingles with.  A set is written as its difference from the centre, and the
task of a group compares differences: sets that link with the centre are one component
already, so only the others are compared with all.  Groups of more than ``GROUP_SETS``
are cut into pairs of blocks.  Tasks give spanning forests of the links, so no list
of pairs grows with the square of a group.  Shingles are compared by 63-bit hashes.

Defined results: null or empty texts and texts of separators have no shingles and link with
nothing; rows without doc_id link with nothing and have no component; rows that share a
doc_id are one document's; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitsieve.functions.session import broadcast_if_small, cut_lineage
from traitsieve.llm import kernels as K
from traitsieve.llm.components import components, spanning_forest
from traitsieve.llm.packets import Outbox, bucket_count, to_buckets, unpack
from traitsieve.llm.tables import written

SHINGLE = 5
PERCENT = 80
SUBSET = 2
#: Common shingles that leading parts are made for: a few, and a share of the set, so that a
#: passage that two long texts share is not enough to make them a candidate.
OVERLAP_LEAST = 8
OVERLAP_SHARE = 16
SMALL = 8
#: Sets of a group that one task compares, in two blocks.
GROUP_SETS = 8_000
#: Sets of all groups in a bucket, about.
BUCKET_SETS = 10_000
#: Sets compared with their group together.
ROWS_AT_ONCE = 256
#: Weight of an equal subset, which needs no second witness.
SURE = 1 << 20
#: Bits of the map of texts whose sets are wanted (8 MB).
BITS = 1 << 26
#: Largest light size that is considered.
LIGHT_MOST = 64
#: Frequent shingles that are named to all tasks, at most (8 bytes each).
FREQUENT_MOST = 500_000
#: Shingles of a map task that are counted together.
COUNTED_TOGETHER = 3_000_000

POSTING = {"key": "<u8", "rid": "<i8", "size": "<u4"}


def shingle_sets(texts: K.Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted by text and value, and their bounds."""
    words = K.Words(texts, K.SPACES)
    codes = K.word_hashes(texts, words, fold=True)
    grams = K.gram_hashes(codes, k)
    ok = K.whole_windows(words.bounds, k, len(grams))
    docs = words.text_of()[: len(grams)][ok]
    grams = grams[ok]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        whole = [K.gram_hashes(codes[words.bounds[d] : words.bounds[d + 1]], int(words.counts[d])) for d in short]
        lengths = words.counts[short].astype(np.uint64)
        grams = np.concatenate([grams, K.mix(np.concatenate(whole) + lengths)])
        docs = np.concatenate([docs, short])
    grams = grams >> K.U64(1)
    order = np.lexsort((grams, docs))
    grams, docs = grams[order], docs[order]
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (docs[1:] != docs[:-1])
    grams, docs = grams[new], docs[new]
    return grams, np.searchsorted(docs, np.arange(len(texts) + 1))


def _needed(size):
    """Common shingles that any link of a set of this size has."""
    return -(-PERCENT * size // 100)


def overlap(size):
    """Common shingles for which a heavy set of this size lists its leading part."""
    return OVERLAP_LEAST + size // OVERLAP_SHARE


def _sizes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, a, b = [], [], []
            for texts in K.slices(batch.column("text")):
                grams, bounds = shingle_sets(texts, k)
                for out, salt in ((a, 1), (b, 0x5851F42D4C957F2D)):
                    sums = K.running(K.mix(grams ^ K.U64(salt)))
                    out.append((sums[bounds[1:]] - sums[bounds[:-1]]).astype(np.int64))
                counts.append(np.diff(bounds))
            yield pa.RecordBatch.from_pydict(
                {
                    "rid": batch.column("rid"),
                    "size": pa.array(np.concatenate(counts), pa.int64()),
                    "sig_a": pa.array(np.concatenate(a), pa.int64()),
                    "sig_b": pa.array(np.concatenate(b), pa.int64()),
                }
            )

    return run


def _counts(k: int, least: int):
    """Shingles that texts taken together in a task repeat, with their number of texts."""

    def tally(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= least
        return pa.RecordBatch.from_pydict(
            {"shingle": pa.array(values[often].astype(np.int64)), "n": pa.array(counts[often].astype(np.int64))}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for texts in K.slices(batch.column("text")):
                held.append(shingle_sets(texts, k)[0])
                if sum(map(len, held)) >= COUNTED_TOGETHER:
                    yield tally(held)
                    held = []
        if held:
            yield tally(held)

    return run


def frequent_shingles(texts: DataFrame, k: int) -> np.ndarray:
    """Shingles to rank last: a bounded list of those that tasks saw repeated most."""
    rows = (
        texts.mapInArrow(_counts(k, 3), "shingle long, n long")
        .groupBy("shingle")
        .agg(F.sum("n").alias("n"))
        .where("n >= 24")
        .orderBy(F.desc("n"), "shingle")
        .limit(FREQUENT_MOST)
        .toPandas()
    )
    return np.sort(rows["shingle"].to_numpy(dtype=np.uint64))


def light_boundary(sizes: dict[int, int]) -> int:
    """Size up to which enumerating subsets makes fewer records than inverted lists."""

    def subsets(s: int) -> int:
        lead = s - _needed(s) + SUBSET
        return lead * (lead - 1) // 2

    best, cost = 0, None
    for x in range(LIGHT_MOST + 1):
        records = sum(n * subsets(s) for s, n in sizes.items() if 2 <= s <= x)
        records += sum(n * min(s, s - _needed(s) + overlap(s)) for s, n in sizes.items() if s > x or s >= _needed(x + 1))
        if cost is None or records < cost:
            best, cost = x, records
    return best


def _post(n: int, k: int, boundary: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = frequent.value
        box = Outbox(n, POSTING)
        for batch in batches:
            rids = batch.column("rid").to_numpy()
            for texts in K.slices(batch.column("text")):
                grams, bounds = shingle_sets(texts, k)
                sizes = np.diff(bounds)
                docs = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((grams, K.member(grams, last), docs))
                grams = grams[order]
                place = np.arange(len(grams)) - bounds[docs]
                own = sizes[docs]
                heavy = ((own > boundary) | (own >= _needed(boundary + 1))) & (place < own - _needed(own) + overlap(own))
                key = K.mix(grams[heavy]) << K.U64(1)
                box.add(K.mix(key) % K.U64(n), key=key, rid=rids[texts.first + docs[heavy]], size=own[heavy])
                for s in range(2, boundary + 1):
                    these = np.flatnonzero(sizes == s)
                    if not len(these):
                        continue
                    lead = grams[bounds[these][:, None] + np.arange(s - _needed(s) + SUBSET)]
                    lead = np.sort(lead, axis=1)
                    i, j = np.triu_indices(lead.shape[1], 1)
                    key = (K.mix(lead[:, i] * K.U64(K.BASE) + lead[:, j]) << K.U64(1) | K.U64(1)).ravel()
                    box.add(K.mix(key) % K.U64(n), key=key, rid=np.repeat(rids[texts.first + these], len(i)), size=np.uint32(s))
                if box.full():
                    yield from box.flush()
        yield from box.flush()

    return run


LISTS = "print long, weight long, n long, rids binary, sizes binary"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inverted lists of two or more sets; equal lists of a bucket become one with a weight."""
    got = unpack(batches, POSTING)
    order = np.lexsort((got["rid"], got["size"], got["key"]))
    key, rid, size = got["key"][order], got["rid"][order], got["size"][order]
    if not len(key):
        return
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[at[1:], len(key)]
    sums = K.running(K.mix(rid.astype(np.uint64)))
    prints = K.mix(sums[ends] - sums[at])
    lengths = ends - at
    keep = np.flatnonzero(lengths > 1)
    weight = np.where(key[at] & K.U64(1), SURE, 1)
    found: dict[tuple[int, int], list[int]] = {}
    for g in keep:
        entry = found.setdefault((int(prints[g]), int(lengths[g])), [g, 0])
        entry[1] += int(weight[g])
    rows = list(found.items())
    for part in range(0, len(rows), 20_000):
        some = rows[part : part + 20_000]
        spans = [(at[g], ends[g]) for _, (g, _) in some]
        yield pa.RecordBatch.from_pydict(
            {
                "print": pa.array(np.array([p for (p, _), _ in some], dtype=np.uint64).astype(np.int64)),
                "weight": pa.array([w for _, (_, w) in some], pa.int64()),
                "n": pa.array([m for (_, m), _ in some], pa.int64()),
                "rids": pa.array([rid[a:b].tobytes() for a, b in spans], pa.binary()),
                "sizes": pa.array([size[a:b].tobytes() for a, b in spans], pa.binary()),
            }
        )


def _common_needed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shingles of both leading parts that a link of sets of these sizes has at least."""
    link = -(-PERCENT * (x + y) // (100 + PERCENT))
    beyond = [np.maximum(_needed(s) - overlap(s), 0) for s in (x, y)]
    return link - np.maximum(*beyond)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of short lists whose sizes allow a link."""
    for batch in batches:
        for r, s, w in zip(*(batch.column(c).to_pylist() for c in ("rids", "sizes", "weight"))):
            rid, size = np.frombuffer(r, "<i8"), np.frombuffer(s, "<u4").astype(np.int64)
            a, b = np.triu_indices(len(rid), 1)
            near = 100 * np.minimum(size[a], size[b]) >= PERCENT * np.maximum(size[a], size[b])
            a, b = a[near], b[near]
            x, y = rid[a], rid[b]
            yield pa.RecordBatch.from_pydict(
                {
                    "a": pa.array(np.minimum(x, y)),
                    "b": pa.array(np.maximum(x, y)),
                    "weight": pa.array(np.full(len(x), w, dtype=np.int64)),
                    "need": pa.array(_common_needed(size[a], size[b])),
                }
            )


PAIRS = "a long, b long, weight long, need long"


def _candidates(found: DataFrame) -> DataFrame:
    summed = found.groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.min("need").alias("need"))
    return summed.where("weight >= need").select("a", "b")


def _whole_sets(k: int, bits):
    """Sets of the texts whose bit is set; the bits hold all that are asked for, and a few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("bit").to_numpy()
            asked = (bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            batch = batch.filter(pa.array(asked))
            out = []
            for texts in K.slices(batch.column("text")):
                grams, bounds = shingle_sets(texts, k)
                out.extend(grams[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:]))
            yield pa.RecordBatch.from_pydict({"rid": batch.column("rid"), "grams": pa.array(out, pa.binary())})

    return run


def _sets_of(ids: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """rid, grams of the texts that ``ids`` names, without a shuffle of texts.

    A map of ``BITS`` bits, the same size whatever the input, goes to all tasks and keeps
    texts that are not asked for from being worked on; the joins drop those it lets through.
    """
    spark = texts.sparkSession
    bit = F.pmod(F.xxhash64("rid"), F.lit(BITS))
    parts = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part"))
    held = np.zeros(BITS // 8 + 4096, dtype=np.uint8)
    for row in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).toLocalIterator():
        # bucket 1 begins at value 1; bucket 0 holds the value 0 alone
        start = (row["part"] - 1) * 32_768 + 1 if row["part"] else 0
        values = np.flatnonzero(np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")) + start
        np.bitwise_or.at(held, values >> 3, (1 << (values & 7)).astype(np.uint8))
    bits = spark.sparkContext.broadcast(held)
    made = texts.withColumn("bit", bit).mapInArrow(_whole_sets(k, bits), "rid long, grams binary")
    return written(made, "sets").dropDuplicates(["rid"])


def _links(both, x, y):
    return 100 * both >= PERCENT * (x + y - both)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, dtype=bool)
        for i, (x, y) in enumerate(zip(batch.column("grams_a").to_pylist(), batch.column("grams_b").to_pylist())):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            small, large = (x, y) if len(x) < len(y) else (y, x)
            keep[i] = _links(int(K.member(small, large).sum()), len(x), len(y))
        yield batch.filter(pa.array(keep)).select(["a", "b"])


DIFFERENCES = "z long, rid long, size long, within binary, beyond binary, linked boolean"


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A set as the centre's shingles that it has (bits) and its others."""
    for batch in batches:
        size, within, beyond, linked = [], [], [], []
        for x, z in zip(batch.column("grams_b").to_pylist(), batch.column("grams_a").to_pylist()):
            x, z = np.frombuffer(x, "<u8"), np.frombuffer(z, "<u8")
            has = K.member(z, x)
            size.append(len(x))
            within.append(np.packbits(has).tobytes())
            beyond.append(x[~K.member(x, z)].tobytes())
            linked.append(bool(_links(int(has.sum()), len(x), len(z))))
        yield pa.RecordBatch.from_pydict(
            {
                "z": batch.column("a"),
                "rid": batch.column("b"),
                "size": pa.array(size, pa.int64()),
                "within": pa.array(within, pa.binary()),
                "beyond": pa.array(beyond, pa.binary()),
                "linked": pa.array(linked),
            }
        )


def _shared_beyond(left: list[bytes], right: list[bytes], out: np.ndarray) -> None:
    """Add to ``out`` the common shingles of every two rows, outside the centre."""
    a, b = (np.frombuffer(b"".join(rows), "<u8") for rows in (left, right))
    of_a, of_b = (np.repeat(np.arange(len(rows)), [len(r) // 8 for r in rows]) for rows in (left, right))
    order = np.argsort(b, kind="stable")
    b, of_b = b[order], of_b[order]
    low, high = np.searchsorted(b, a, side="left"), np.searchsorted(b, a, side="right")
    for q in range(0, len(a), 4096):
        counts = (high - low)[q : q + 4096]
        rows = np.repeat(of_a[q : q + 4096], counts)
        within = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        np.add.at(out, (rows, of_b[np.repeat(low[q : q + 4096], counts) + within]), 1)


def _group_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Spanning forests of the links in a bucket's groups (z, i, j): block i with block j."""
    found = [np.zeros((0, 2), dtype=np.int64)]
    for (_, i, j), group in rows.groupby(["z", "i", "j"], sort=False):
        rid, size = group["rid"].to_numpy(), group["size"].to_numpy()
        out, block = ~group["linked"].to_numpy(), group["block"].to_numpy()
        beyond = group["beyond"].tolist()
        bits = np.unpackbits(np.frombuffer(b"".join(group["within"]), np.uint8).reshape(len(group), -1), axis=1)
        bits = bits.astype(np.float32)
        parent, edges = np.arange(len(group)), []
        for first, second in ((i, j), (j, i)) if i != j else ((i, j),):
            left, right = np.flatnonzero(out & (block == first)), np.flatnonzero(block == second)
            others = [beyond[r] for r in right]
            for q in range(0, len(left), ROWS_AT_ONCE):
                some = left[q : q + ROWS_AT_ONCE]
                both = bits[some] @ bits[right].T
                _shared_beyond([beyond[r] for r in some], others, both)
                a, b = np.nonzero(_links(both, size[some][:, None], size[right][None, :]))
                a, b = some[a], right[b]
                apart = a != b
                spanning_forest(a[apart], b[apart], parent, edges)
        if edges:
            found.append(rid[np.array(edges, dtype=np.int64)])
    ends = np.concatenate(found)
    return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    with_b = pairs.join(sets.select(F.col("rid").alias("b"), F.col("grams").alias("grams_b")), "b")
    return with_b.join(sets.select(F.col("rid").alias("a"), F.col("grams").alias("grams_a")), "a")


def least_needed(size):
    """Lower bound of ``_common_needed`` over all partners of a set of this size."""
    return np.minimum(overlap(size) - 2, _needed(size))


def _groups(lists: DataFrame) -> DataFrame:
    """(a, b): a is the centre of a long list, b one of its sets.

    A set whose lists together are fewer than any link needs has no link.
    """
    members = lists.mapInArrow(_exploded, "print long, n long, weight long, rid long, least long")
    known = members.groupBy("rid").agg(
        F.sum("weight").alias("shared"),
        F.sum(F.least("weight", F.lit(OVERLAP_LEAST)) * (F.col("n") - 1)).alias("met"),
        F.max("least").alias("least"),
    )
    known = known.where("shared >= least").select("rid", "met")
    long_lists = members.where(F.col("n") > SMALL).select(F.xxhash64("print", "n").alias("list"), "rid")
    long_lists = long_lists.join(known, "rid")
    centres = long_lists.groupBy("list").agg(F.max_by("rid", F.struct("met", -F.col("rid"))).alias("a"))
    return long_lists.select("list", "rid").join(centres, "list").select("a", F.col("rid").alias("b")).distinct()


def _in_groups(differences: DataFrame) -> DataFrame:
    """Links of the groups: with the centre, and those of sets that do not link with it.

    Only such outside sets have links left to find.  They have blocks of their own, which meet each
    other and the blocks of the linked sets; linked sets do not meet, so a group with few outside
    sets is copied a few times whatever its size.
    """
    counts = differences.groupBy("z").agg(F.count("*").alias("n"), F.sum((~F.col("linked")).cast("long")).alias("outside"))
    small = F.col("n") * 2 <= GROUP_SETS  # one block for all
    counts = counts.where("outside > 0").select(
        "z",
        F.when(small, 1).otherwise(F.ceil(F.col("outside") * 2 / GROUP_SETS)).alias("apart"),
        F.when(small, 0).otherwise(F.ceil((F.col("n") - F.col("outside")) * 2 / GROUP_SETS)).alias("inner"),
        "outside",
        (F.col("n") - F.col("outside")).alias("linked_n"),
    )
    copies = F.col("linked_n") * F.col("apart") + F.col("outside") * (F.col("apart") + F.col("inner"))
    groups, total = counts.agg(F.count("*"), F.coalesce(F.sum(copies), F.lit(0))).first()
    buckets = max(1, -(-int(total) // BUCKET_SETS))
    rows = differences.join(broadcast_if_small(counts.select("z", "apart", "inner"), groups), "z")
    linked_block = F.col("apart") + F.pmod(F.xxhash64("rid"), F.greatest("inner", F.lit(1)))
    inside = F.col("linked") & (F.col("inner") > 0)
    rows = rows.withColumn("block", F.when(inside, linked_block).otherwise(F.pmod(F.xxhash64("rid"), "apart")))
    last = F.when(inside, F.col("apart")).otherwise(F.col("apart") + F.col("inner")) - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "apart", "inner")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("z", "i", "j"), F.lit(buckets)))
    inner = rows.groupBy("bucket").applyInPandas(_group_links, "a long, b long")
    return inner.union(differences.where("linked and z <> rid").select(F.col("z").alias("a"), F.col("rid").alias("b")))


def jaccard_components(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    n = bucket_count(spark)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("rid"), "text")
    sized = written(
        docs.select(F.col("doc_id").cast("long").alias("rid"), "text")
        .mapInArrow(_sizes(k), "rid long, size long, sig_a long, sig_b long"),
        "sizes",
    )
    some = sized.where("rid is not null and size > 0")
    # a document whose rows differ is left to itself: each of its sets is compared
    classes = some.groupBy("sig_a", "sig_b", "size").agg(F.min("rid").alias("first"), F.max("rid").alias("last"))
    several = classes.where("first < last").drop("last")
    copies = some.join(several, ["sig_a", "sig_b", "size"]).where("rid > first").select(F.col("first").alias("a"), F.col("rid").alias("b"))
    histogram = {
        r["size"]: r["count"]
        for r in classes.where(F.col("size") <= LIGHT_MOST * 2).groupBy("size").count().collect()
    }
    boundary = light_boundary(histogram)
    frequent = spark.sparkContext.broadcast(frequent_shingles(texts, k))
    lone = some.join(copies.select(F.col("b").alias("rid")).distinct(), "rid", "left_anti").select("rid").distinct()
    dealt = texts.repartition(n, "rid")
    posted = dealt.join(lone, "rid").select("rid", "text").mapInArrow(
        _post(n, k, boundary, frequent), Outbox(n, POSTING).schema()
    )
    lists = written(
        to_buckets(posted, n)
        .mapInArrow(_lists, LISTS)
        .groupBy("print", "n")
        .agg(F.sum("weight").alias("weight"), F.first("rids").alias("rids"), F.first("sizes").alias("sizes")),
        "lists",
    )
    short = lists.where(F.col("n") <= SMALL).select("rids", "sizes", "weight")
    pairs = cut_lineage(_candidates(short.mapInArrow(_pairs, PAIRS)))
    groups = cut_lineage(_groups(lists))
    both = pairs.union(groups)
    sets = _sets_of(both.select(F.col("a").alias("rid")).union(both.select(F.col("b").alias("rid"))), texts, k)
    linked = _with_sets(pairs, sets).mapInArrow(_linked, "a long, b long")
    differences = written(_with_sets(groups, sets).mapInArrow(_differences, DIFFERENCES), "differences")
    found = components(cut_lineage(copies.union(linked).union(_in_groups(differences))))
    out = sized.join(found, sized.rid == found.node, "left")
    return out.select(
        F.col("rid").alias("doc_id"),
        F.col("size").alias("n_shingles"),
        F.coalesce("component", "rid").alias("component_id"),
    )


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rids, sizes = batch.column("rids").to_pylist(), batch.column("sizes").to_pylist()
        lengths = [len(r) // 8 for r in rids]
        out = {c: np.repeat(batch.column(c).to_numpy(), lengths) for c in ("print", "n", "weight")}
        size = np.frombuffer(b"".join(sizes), "<u4").astype(np.int64)
        yield pa.RecordBatch.from_pydict(
            {k: pa.array(v) for k, v in out.items()}
            | {"rid": pa.array(np.frombuffer(b"".join(rids), "<i8")), "least": pa.array(least_needed(size))}
        )
