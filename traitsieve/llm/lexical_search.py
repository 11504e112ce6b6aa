"""Ranked lexical search with hashed max-sketches.

Each document gets a sketch: its terms are hashed to ``WIDTH`` coordinates and a coordinate holds
the largest number of occurrences of the terms that fell on it.  A term's impact grows with its
occurrences within one document, so the impact of that maximum is the maximum of the impacts, and
a query's sum over the coordinates of its terms is an upper bound of its score.  Only occupied
coordinates are stored (five bytes each), which keeps wide sketches small: a narrow one would let
frequent terms fall on the coordinates of rare ones, and bounds of most documents would be loose.

A search then takes three passes over the sketches and the few texts they point at:

1. bounds of all documents for all items, of which each task keeps the ``k`` highest an item; the
   best ``k`` overall are scored exactly, which gives each item a score that ``k`` documents reach;
2. bounds again; documents whose bound reaches that score (no other can rank) are the candidates;
3. candidates are scored exactly from their texts, each distinct text once.

Statistics of all documents (``N``, ``L``, ``df`` of the items' terms) come from the pass that
writes the sketches.  Items are worked on in blocks of about ``BLOCK_TERMS`` terms, so what is
broadcast has a bound at any number of items.  Candidates meet their texts by doc_id and digest:
by broadcast up to a checked number of rows, by a shuffle beyond.

Defined results: null texts and texts without terms match nothing; a missing doc_id ranks after
all others at equal scores; every row is a document, so repeated rows rank next to each other and
each row of ``benchmark`` is ranked by itself; an item without terms gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitsieve.functions.session import MAX_BROADCAST_ROWS
from traitsieve.llm.packets import NO_ID
from traitsieve.llm.tables import doc_id_of, written

#: Documents returned for each item.
K = 50
#: Coordinates of a sketch, and of the table that sorts out most of them before they are looked up.
WIDTH, COARSE = 1 << 24, 1 << 16
#: A coordinate's largest count is held in a byte; this value stands for itself and everything above.
MOST = 255
#: Terms of the items worked on at once (with repeats between items).
BLOCK_TERMS = 500_000
#: Bytes of a text whose terms are counted at a time.
PIECE = 4_000_000
#: Products of documents and item terms whose bounds are computed at a time.
CELLS = 2_000_000
#: Candidates a task holds before it hands them out.
HELD = 200_000
#: Fixed values of the score.
BASE, SLOPE, SCALE, STEP, DAMP = 50, 50, 1_000_000_000, 1_000, 20

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def term_counts(text: bytes, piece: int = PIECE) -> Counter:
    """Occurrences of each term of a text, piece by piece so that long texts stay small."""
    if len(text) <= piece:
        return Counter(TERM.findall(text.lower()))
    counts, start = Counter(), 0
    while start < len(text):
        cut = GAP.search(text, min(start + piece, len(text)))
        end = cut.end() if cut else len(text)
        counts.update(TERM.findall(text[start:end].lower()))
        start = end
    return counts


def sketch(counts: Counter, width: int = WIDTH) -> tuple[bytes, bytes]:
    """Occupied coordinates in rising order and the largest count on each."""
    at = np.fromiter(map(crc32, counts), np.uint32, len(counts)) & np.uint32(width - 1)
    much = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), MOST)
    order = np.lexsort((-much, at))
    at, much = at[order], much[order]
    first = np.r_[True, at[1:] != at[:-1]]
    return at[first].astype("<u4").tobytes(), much[first].astype(np.uint8).tobytes()


def damping(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The share of a document's length in its score, times 100."""
    return 100 - SLOPE + (BASE * n * documents) // terms


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (SCALE * tf) // (STEP * tf + DAMP * m)


@dataclass
class Block:
    """Some items: their terms numbered, and what the corpus says of them."""

    items: list[int]
    terms: dict[bytes, int]
    #: Term numbers of all items one after the other, and where each item starts.
    term_of: np.ndarray
    starts: np.ndarray
    width: int = WIDTH
    documents: int = 0
    total: int = 0
    weights: np.ndarray | None = None

    def weigh(self, documents: int, total: int, df: np.ndarray) -> None:
        self.documents, self.total = documents, total
        ratio = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df]
        self.weights = np.array(ratio, dtype=np.int64)

    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coordinates of the terms in rising order, the place of each term's among them, and a table of low bits."""
        at = np.array([crc32(t) & (self.width - 1) for t in self.terms], dtype=np.uint32)
        used, slot = np.unique(at, return_inverse=True)
        low = np.zeros(COARSE, dtype=bool)
        low[used & np.uint32(COARSE - 1)] = True
        return used, slot, low


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        terms = [sorted(term_counts(texts[i].as_py() or b"")) for i in range(len(texts))]
        yield pa.RecordBatch.from_pydict(
            {"item_id": batch.column("item_id"), "q": batch.column("q"), "terms": pa.array(terms, pa.list_(pa.binary()))}
        )


def _blocks(items: DataFrame, limit: int, width: int) -> Iterator[Block]:
    """The items in blocks of about ``limit`` terms."""
    total = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // limit))
    for b in range(blocks):
        rows = items.where((F.pmod(F.xxhash64("q"), F.lit(blocks)) == b) & (F.size("terms") > 0)).collect()
        if not rows:
            continue
        numbers: dict[bytes, int] = {}
        term_of = [numbers.setdefault(bytes(t), len(numbers)) for r in rows for t in r["terms"]]
        starts = np.cumsum([0] + [len(r["terms"]) for r in rows])[:-1]
        yield Block([r["q"] for r in rows], numbers, np.array(term_of, np.int64), starts.astype(np.int64), width)


INDEX = (
    "rid long, digest binary, n long, spots binary, most binary,"
    " documents long, total long, terms array<int>, holders array<long>"
)


def _index(block, sketches: bool):
    """Sketches of the documents, and at the end of a task one row with its share of the statistics."""

    def row(rid=None, digest=None, n=None, spots=None, most=None, documents=None, total=None, terms=None, holders=None):
        return (rid, digest, n, spots, most, documents, total, terms, holders)

    names = [part.split()[0] for part in INDEX.split(", ")]
    kinds = [
        pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(),
        pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()),
    ]

    def packed(rows):
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = block.value.terms
        holders = np.zeros(len(numbers), dtype=np.int64)
        documents = total = held = 0
        out = []
        for batch in batches:
            rids, texts = batch.column("rid"), batch.column("text").cast(pa.large_binary())
            for i in range(batch.num_rows):
                text = texts[i].as_py() or b""
                counts = term_counts(text)
                if not counts:
                    continue
                n = sum(counts.values())
                documents, total = documents + 1, total + n
                found = [numbers[t] for t in counts.keys() & numbers.keys()]
                holders[found] += 1
                if sketches:
                    spots, most = sketch(counts, block.value.width)
                    out.append(row(rids[i].as_py(), hashlib.md5(text).digest(), n, spots, most))
                    held += 3 * len(counts) + 40
                    if held > PIECE:
                        yield packed(out)
                        out, held = [], 0
        if out:
            yield packed(out)
        seen = np.flatnonzero(holders)
        yield packed([row(documents=documents, total=total, terms=seen.tolist(), holders=holders[seen].tolist())])

    return run


def _statistics(index: DataFrame, block: Block) -> None:
    """Sums of the tasks' shares; the number of rows is that of the block's terms at most."""
    shares = index.where("documents is not null")
    documents, total = shares.agg(F.sum("documents"), F.sum("total")).first()
    df = np.zeros(len(block.terms), dtype=np.int64)
    pairs = shares.select(F.explode(F.arrays_zip("terms", "holders")).alias("p"))
    for term, n in pairs.groupBy("p.terms").agg(F.sum("p.holders")).collect():
        df[term] = n
    block.weigh(documents or 0, max(total or 0, 1), df)


def _bounds(block: Block, slots: tuple[np.ndarray, np.ndarray, np.ndarray], batch: pa.RecordBatch) -> np.ndarray:
    """Upper bounds, documents x items, from the sketches of a batch."""
    spots = [np.frombuffer(s, "<u4") for s in batch.column("spots").to_pylist()]
    most = np.frombuffer(b"".join(batch.column("most").to_pylist()), np.uint8)
    used, slot, low = slots
    doc = np.repeat(np.arange(len(spots)), [len(s) for s in spots])
    spot = np.concatenate(spots)
    may = np.flatnonzero(low[spot & np.uint32(COARSE - 1)])
    at = np.minimum(np.searchsorted(used, spot[may]), len(used) - 1)
    met = used[at] == spot[may]
    may, at = may[met], at[met]
    doc, tf = doc[may], most[may].astype(np.int64)
    m = damping(batch.column("n").to_numpy().astype(np.int64), block.documents, block.total)
    value = np.where(tf < MOST, impacts(tf, m[doc]), SCALE // STEP)
    grid = np.zeros((len(spots), len(used)), dtype=np.int64)
    grid[doc, at] = value
    return np.add.reduceat(grid[:, slot[block.term_of]] * block.weights[block.term_of], block.starts, axis=1)


FOUND = "q int, bound long, rid long, digest binary"


def _found(q, bound, rid, digest) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "q": pa.array(q, pa.int32()), "bound": pa.array(bound, pa.int64()),
            "rid": pa.array(rid, pa.int64()), "digest": pa.array(digest, pa.binary()),
        }
    )


def _first_of(keys: list[np.ndarray], group: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group in the order of ``keys`` (most significant first)."""
    order = np.lexsort((*reversed(keys), group))
    sorted_group = group[order]
    heads = np.flatnonzero(np.r_[True, sorted_group[1:] != sorted_group[:-1]])
    place = np.arange(len(order)) - np.repeat(heads, np.diff(np.r_[heads, len(order)]))
    return order[place < k]


def _pieces(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    n = max(1, CELLS // len(block.term_of))
    for batch in batches:
        for i in range(0, batch.num_rows, n):
            yield batch.slice(i, n)


def _highest(block, k: int):
    """The ``k`` highest bounds of each item in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        slots = b.slots()
        least = np.ones(len(b.items), dtype=np.int64)
        q, bound, rid, digest = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, object))
        for batch in _pieces(batches, b):
            bounds = _bounds(b, slots, batch)
            doc, item = np.nonzero(bounds >= least)
            q, bound = np.r_[q, item], np.r_[bound, bounds[doc, item]]
            rid = np.r_[rid, batch.column("rid").to_numpy()[doc]]
            digest = np.r_[digest, np.array(batch.column("digest").to_pylist(), dtype=object)[doc]]
            if len(q) > 4 * k * len(b.items):
                keep = _first_of([-bound, rid], q, k)
                q, bound, rid, digest = q[keep], bound[keep], rid[keep], digest[keep]
                full = np.bincount(q, minlength=len(b.items)) >= k
                lowest = np.full(len(b.items), np.iinfo(np.int64).max)
                np.minimum.at(lowest, q, bound)
                least = np.where(full, lowest, least)
        if len(q):
            keep = _first_of([-bound, rid], q, k)
            yield _found(q[keep], bound[keep], rid[keep], digest[keep])

    return run


def _reaching(block, limits, k: int):
    """Documents whose bound reaches the item's limit; of one text the ``k`` smallest ids of a task are enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        slots = b.slots()
        least, last = limits.value
        held: list[tuple[np.ndarray, ...]] = []

        def pruned():
            q, bound, rid, digest = (np.concatenate(c) for c in zip(*held))
            texts, text = np.unique(digest, return_inverse=True)
            keep = _first_of([rid], q * len(texts) + text, k)
            return q[keep], bound[keep], rid[keep], digest[keep]

        for batch in _pieces(batches, b):
            bounds = _bounds(b, slots, batch)
            rids = batch.column("rid").to_numpy()
            doc, item = np.nonzero(bounds >= least)
            bound = bounds[doc, item]
            fine = (bound > least[item]) | (rids[doc] <= last[item])
            doc, item, bound = doc[fine], item[fine], bound[fine]
            digest = np.array(batch.column("digest").to_pylist(), dtype=object)
            held.append((item, bound, rids[doc], digest[doc]))
            if sum(len(h[0]) for h in held) > HELD:
                held = [pruned()]
                if len(held[0][0]) > HELD // 2:
                    yield _found(*held.pop())
        if held:
            yield _found(*pruned())

    return run


ASKED = "digest binary, q int, score long"


def _rescored(block):
    """Exact scores of the asked items from a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        terms = list(b.terms)
        ends = np.r_[b.starts[1:], len(b.term_of)]
        for batch in batches:
            digests, items, scores = [], [], []
            texts, asked = batch.column("text").cast(pa.large_binary()), batch.column("items")
            for i in range(batch.num_rows):
                counts = term_counts(texts[i].as_py())
                m = int(damping(np.int64(sum(counts.values())), b.documents, b.total))
                digest = batch.column("digest")[i].as_py()
                for q in asked[i].as_py():
                    score = 0
                    for t in b.term_of[b.starts[q] : ends[q]]:
                        tf = counts.get(terms[t])
                        if tf:
                            score += int(b.weights[t]) * ((SCALE * tf) // (STEP * tf + DAMP * m))
                    if score > 0:
                        digests.append(digest), items.append(q), scores.append(score)
            yield pa.RecordBatch.from_pydict(
                {
                    "digest": pa.array(digests, pa.binary()), "q": pa.array(items, pa.int32()),
                    "score": pa.array(scores, pa.int64()),
                }
            )

    return run


def _scored(found: DataFrame, docs: DataFrame, block) -> DataFrame:
    """``q, rid, digest, score`` of found documents; a text is read and scored once for all its rows and items."""
    reps = found.groupBy("digest").agg(F.min("rid").alias("rid"), F.array_sort(F.collect_set("q")).alias("items"))
    reps = written(reps, "search-texts")
    few = reps.count() <= MAX_BROADCAST_ROWS // 10
    texts = docs.where("text is not null").select("rid", "text").withColumn("digest", F.unhex(F.md5("text")))
    met = texts.join(F.broadcast(reps) if few else reps, ["rid", "digest"]).select("digest", "text", "items")
    scores = met.mapInArrow(_rescored(block), ASKED).distinct()
    return found.join(scores, ["q", "digest"]).select("q", "rid", "digest", "score")


def _best(rows: DataFrame, k: int, by: str) -> DataFrame:
    """First ``k`` rows of each item by ``by`` falling and rid, chosen in two steps so that no task gets them all."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("rid", "digest"), F.lit(64)))
    order = [F.col(by).desc(), F.col("rid")]
    part = F.row_number().over(Window.partitionBy("q", "salt").orderBy(*order))
    firsts = salted.withColumn("place", part).where(F.col("place") <= k).drop("place", "salt")
    return firsts.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS, width: int = WIDTH) -> DataFrame:
    """item_id, rank, doc_id, score of each item's ``k`` highest-scoring documents; ``width`` is a power of two."""
    spark = docs.sparkSession
    rid = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("rid")
    docs = docs.select(rid, "text")
    kind = items.schema["item_id"].dataType.simpleString()
    asked = items.select("item_id", "text", F.monotonically_increasing_id().alias("q"))
    asked = written(asked.mapInArrow(_item_terms, f"item_id {kind}, q long, terms array<binary>"), "items")
    sketches, results = None, []
    for block in _blocks(asked, block_terms, width):
        shared = spark.sparkContext.broadcast(block)
        index = written(docs.mapInArrow(_index(shared, sketches is None), INDEX), "sketches")
        _statistics(index, block)
        if sketches is None:
            sketches = index.where("spots is not null").select("rid", "digest", "n", "spots", "most")
        shared = spark.sparkContext.broadcast(block)
        highest = _best(sketches.mapInArrow(_highest(shared, k), FOUND), k, "bound").drop("rank")
        firsts = _best(_scored(written(highest, "search-first"), docs, shared), k, "score")
        least, last = np.ones(len(block.items), dtype=np.int64), np.full(len(block.items), NO_ID)
        for row in firsts.where(F.col("rank") == k).collect():  # one row an item of the block
            least[row["q"]], last[row["q"]] = row["score"], row["rid"]
        limits = spark.sparkContext.broadcast((least, last))
        candidates = written(sketches.mapInArrow(_reaching(shared, limits, k), FOUND), "search-candidates")
        ranked = _best(_scored(candidates, docs, shared), k, "score")
        names = spark.createDataFrame(list(enumerate(block.items)), "q int, item long")
        results.append(written(ranked.join(F.broadcast(names), "q").select("item", "rank", "rid", "score"), "search"))
    if not results:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    ranked = reduce(DataFrame.unionByName, results)
    return ranked.join(asked.select("item_id", F.col("q").alias("item")), "item").select(
        "item_id", "rank", doc_id_of(), "score"
    )
