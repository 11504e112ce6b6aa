"""Repeated byte strings over suffix arrays made by external induced sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too.

1. Every string of LENGTH bytes has an anchor, the ``GRAM`` bytes with the smallest hash in
   it.  Equal strings have equal anchors, so strings whose anchor stands once cannot repeat.
2. The strings that share an anchor's place, one after the other, are one stretch of text.
   Stretches go to the bucket of their anchor, so all places of a string meet in one bucket;
   equal stretches are merged within each map task already.  An anchor with more than
   ``GROUP`` places ships no text: each of its strings goes by its own hash, with its anchor's offset.
   Within ``STRINGS_AT_ONCE`` strings of a map task equal ones are decided, and leave as ranges to
   any bucket; one stands for them, so no bucket gets all places of a string.
3. A bucket's stretches are one text, whose suffixes are sorted by induction (see
   ``induced_sort``: bucket queues that spill to disk).  Neighbours that agree for
   LENGTH bytes are the repeats.  Prefixes in common are compared by hash of LENGTH bytes,
   not carried through the induction.
4. Texts lose the bytes under their repeats.

Texts that stand more than once are known from their digest: all their bytes go (if they
have LENGTH), and one of them represents the others in 2 and 3.

Defined results: null texts are empty; texts below LENGTH bytes stay whole; matches do not cross
documents; every row is a document of its own, whether it has a doc_id, shares it, or
repeats another row (then both lose what they share).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitsieve.llm import kernels as K
from traitsieve.llm.induced_sort import suffix_array
from traitsieve.llm.packets import NO_ID, Outbox, bucket_count, joined, to_buckets, unpack
from traitsieve.llm.tables import doc_id_of

LENGTH = 400
GRAM = 32
GROUP = 4_000
CUT = 32
#: Strings of frequent anchors that a map task compares before it ships them.
STRINGS_AT_ONCE = 1_000_000
#: Buckets of strings for each bucket of stretches.
STRING_BUCKETS = 4
#: Bytes of text whose anchors are found together (a dozen arrays of 8 bytes each).
SLICE = 500_000
#: Stretches of a bucket that are sorted together.
PART_BYTES = 1_000_000
#: Bits of an anchor's order that are its place; the others are its hash.
PLACE_BITS = 31

ANCHOR = {"key": "<u8", "rid": "<i8", "tid": "<i8"}


def _anchors(texts: K.Texts, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every start of a string of ``length``: place and hash of its anchor, and if it stays in its text."""
    sums = K.prefix_hashes(texts.data)
    n = len(texts.data) - gram + 1
    if len(texts.data) < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none.astype(bool)
    starts = np.arange(n)
    hashes = K.span_hashes(sums, starts, starts + gram)
    low = K.U64((1 << PLACE_BITS) - 1)
    best = K.window_minima((hashes & ~low) | starts.astype(np.uint64), length - gram + 1)
    places = (best & low).astype(np.int64)
    ok = np.ones(len(places), dtype=bool)
    # starts whose string reaches over a text's end
    for end in texts.offsets[1:-1]:
        ok[max(0, end - length + 1) : end] = False
    return places, hashes[places], ok


def _rows_of(texts: K.Texts, starts: np.ndarray) -> np.ndarray:
    return np.searchsorted(texts.offsets, starts, side="right") - 1


def _name_anchors(n: int, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = Outbox(n, ANCHOR)
        for batch in batches:
            rids, tids = batch.column("rid").to_numpy(), batch.column("tid").to_numpy()
            for texts in K.slices(batch.column("text"), SLICE):
                places, hashes, ok = _anchors(texts, length, gram)
                at = np.flatnonzero(ok)
                at = at[np.r_[True, places[at[1:]] != places[at[:-1]]]] if len(at) else at
                rows = texts.first + _rows_of(texts, at)
                box.add((hashes[at] >> K.U64(1)) % K.U64(n), key=hashes[at], rid=rids[rows], tid=tids[rows])
                if box.full():
                    yield from box.flush()
        yield from box.flush()

    return run


PER_ROW = "rid long, tid long, packed binary"


def _per_row(rid: np.ndarray, tid: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((tid, rid))
    rid, tid, values = rid[order], tid[order], values[order]
    new = np.ones(len(rid), dtype=bool)
    new[1:] = (rid[1:] != rid[:-1]) | (tid[1:] != tid[:-1])
    at = np.flatnonzero(new)
    ends = np.r_[at[1:], len(rid)].astype(np.int64)
    return pa.RecordBatch.from_pydict(
        {
            "rid": pa.array(rid[at].astype(np.int64)),
            "tid": pa.array(tid[at].astype(np.int64)),
            "packed": pa.array([values[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
        }
    )


def _repeated_anchors(group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = unpack(batches, ANCHOR)
        order = np.argsort(got["key"], kind="stable")
        key = got["key"][order]
        if not len(key):
            return
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[at, len(key)])
        count = np.repeat(count, count)
        many = count > 1
        flagged = (key[many] & ~K.U64(1)) | (count[many] > group).astype(np.uint64)
        yield _per_row(got["rid"][order][many], got["tid"][order][many], flagged)

    return run


class _Stretches:
    """Stretches of a map task by bucket; equal ones are merged, and so decided, at once."""

    def __init__(self, n: int, fields: dict, length: int) -> None:
        self.box = Outbox(n, fields)
        self.length = length
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, key, text, starts, rid, tid, at) -> None:
        if len(key):
            bucket, sub = key % K.U64(self.box.n), (key >> K.U64(40)).astype(np.uint8)
            self.parts.append((bucket, sub, text, starts, rid, tid, at))
            self.held += text.nbytes

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        bucket, sub, text, starts, rid, tid, at = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.held = [], 0
        print_ = _prints(text)
        order = np.lexsort((starts, print_, bucket))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (
            (bucket[order][1:] == bucket[order][:-1])
            & (print_[order][1:] == print_[order][:-1])
            & (starts[order][1:] == starts[order][:-1])
        )
        run = np.cumsum(~same) - 1
        several = np.bincount(run)[run] > 1
        first = order[~same]
        self.box.add(bucket[first], text=text[first], sub=sub[first], starts=starts[first], several=several[~same], rid=rid[first], tid=tid[first], at=at[first])
        rest = order[several]
        # decided: only the range travels, in the same bucket rows
        self.box.add(bucket[rest], text=np.uint8(0), sub=sub[rest], starts=starts[rest], several=np.uint8(2), rid=rid[rest], tid=tid[rest], at=at[rest])
        yield from self.box.flush()


def _prints(text: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(text).view("<u8")
    out = np.zeros(len(text), dtype=np.uint64)
    for j in range(words.shape[1]):
        out = out * K.U64(K.BASE) + K.mix(words[:, j] + K.U64(j + 1))
    return K.mix(out)


def _fields(length: int, gram: int) -> dict:
    span = -(-(2 * length - gram) // 8) * 8
    return {"text": ("u1", (span,)), "sub": "u1", "starts": "<u2", "several": "u1", "rid": "<i8", "tid": "<i8", "at": "<i8"}


def _kinds(texts: K.Texts, lists: list, kept: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Per start: 0 if its anchor stands once, 1 if it repeats, 2 or more if it is frequent."""
    state = np.zeros(len(kept), dtype=np.int8)
    for d in range(len(texts)):
        if lists[texts.first + d]:
            mine = np.unique(joined(lists[texts.first + d]))
            a, b = texts.offsets[d], min(texts.offsets[d + 1], len(kept))
            state[a:b] = K.member(kept[a:b], mine) + 2 * K.member(kept[a:b] | K.U64(1), mine)
    state[~ok] = 0
    return state


def _ship(n: int, length: int, gram: int):
    fields = _fields(length, gram)
    span = fields["text"][1][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Stretches(n, fields, length)
        for batch in batches:
            rids, tids = batch.column("rid").to_numpy(), batch.column("tid").to_numpy()
            lists = batch.column("anchors").to_pylist()
            for texts in K.slices(batch.column("text"), SLICE):
                places, hashes, ok = _anchors(texts, length, gram)
                if not len(places):
                    continue
                kept = hashes & ~K.U64(1)
                state = _kinds(texts, lists, kept, ok)
                at = np.flatnonzero(state == 1)
                if not len(at):
                    continue
                joint = np.ones(len(at), dtype=bool)
                joint[1:] = (np.diff(at) != 1) | (places[at[1:]] != places[at[:-1]])
                heads = at[joint]
                sizes = np.diff(np.r_[np.flatnonzero(joint), len(at)])
                key = kept[heads] >> K.U64(1)
                for q in range(0, len(heads), 1024):
                    some, size = heads[q : q + 1024], sizes[q : q + 1024]
                    place = some[:, None] + np.arange(span)
                    text = texts.data[np.minimum(place, len(texts.data) - 1)]
                    text[np.arange(span) >= (size + length - 1)[:, None]] = 0
                    rows = _rows_of(texts, some)
                    out.add(
                        key[q : q + 1024], text, size.astype("<u2"), rids[texts.first + rows],
                        tids[texts.first + rows], some - texts.offsets[rows],
                    )
                    if out.held > 4_000_000:
                        yield from out.flush()
        yield from out.flush()

    return run


STRING = {"hash": "<u8", "offset": "<u2", "mark": "u1", "rid": "<i8", "tid": "<i8", "at": "<i8", "starts": "<i8"}


def _runs(hash_: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal strings together, and the number of each one's group in it."""
    order = np.lexsort((offset, hash_))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hash_[order][1:] != hash_[order][:-1]) | (offset[order][1:] != offset[order][:-1])
    return order, np.cumsum(new) - 1


def _compared(box: Outbox, parts: list[tuple]) -> None:
    """Strings of a map task: one of each goes to its bucket; the others of equal ones are decided."""
    hash_, offset, rid, tid, at = (np.concatenate(x) for x in zip(*parts))
    order, run = _runs(hash_, offset)
    first = np.r_[True, run[1:] != run[:-1]]
    several = (np.bincount(run) > 1)[run]
    ones = order[first]
    n = K.U64(box.n)
    box.add(
        hash_[ones] % n, hash=hash_[ones], offset=offset[ones], mark=several[first].astype(np.uint8),
        rid=rid[ones], tid=tid[ones], at=at[ones], starts=1,
    )
    rest = np.sort(order[~first])  # places in one text stand together, ascending
    if len(rest):
        joint = np.ones(len(rest), dtype=bool)
        joint[1:] = (rid[rest[1:]] != rid[rest[:-1]]) | (tid[rest[1:]] != tid[rest[:-1]]) | (np.diff(at[rest]) != 1)
        heads = rest[joint]
        long = np.diff(np.r_[np.flatnonzero(joint), len(rest)])
        where = K.mix(tid[heads].astype(np.uint64) ^ K.mix(rid[heads].astype(np.uint64))) % n
        box.add(where, hash=0, offset=0, mark=2, rid=rid[heads], tid=tid[heads], at=at[heads], starts=long)


def _strings(n: int, length: int, gram: int):
    """Strings of frequent anchors, without their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box, parts, held = Outbox(n, STRING), [], 0
        for batch in batches:
            some = [bool(blobs) and bool((joined(blobs) & K.U64(1)).any()) for blobs in batch.column("anchors").to_pylist()]
            batch = batch.filter(pa.array(some, pa.bool_()))
            rids, tids = batch.column("rid").to_numpy(), batch.column("tid").to_numpy()
            lists = batch.column("anchors").to_pylist()
            for texts in K.slices(batch.column("text"), SLICE):
                places, hashes, ok = _anchors(texts, length, gram)
                if not len(places):
                    continue
                at = np.flatnonzero(_kinds(texts, lists, hashes & ~K.U64(1), ok) >= 2)
                if not len(at):
                    continue
                rows = _rows_of(texts, at)
                parts.append((
                    K.span_hashes(K.prefix_hashes(texts.data), at, at + length), (places[at] - at).astype(np.uint16),
                    rids[texts.first + rows], tids[texts.first + rows], (at - texts.offsets[rows]).astype(np.int64),
                ))
                held += len(at)
                if held >= STRINGS_AT_ONCE:
                    _compared(box, parts)
                    parts, held = [], 0
                    yield from box.flush()
        if parts:
            _compared(box, parts)
            yield from box.flush()

    return run


def _repeated_strings(length: int):
    """Byte ranges to remove, per row, from a bucket's strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = unpack(batches, STRING)
        live = np.flatnonzero(got["mark"] < 2)
        order, group = _runs(got["hash"][live], got["offset"][live])
        order = live[order]
        known = (np.bincount(group) > 1) | (np.bincount(group, weights=got["mark"][order]) > 0)
        rows = np.r_[np.flatnonzero(got["mark"] == 2), order[known[group]]]
        if len(rows):
            yield _per_row(*_ranges(got, rows, np.zeros(len(rows), np.int64), got["starts"][rows], length))

    return run


def _repeats(length: int, gram: int):
    """Byte ranges to remove, per row, from a bucket's stretches."""
    fields = _fields(length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = unpack(batches, fields)
        # strings that are equal have one sub-bucket, so the bucket is worked on in small parts
        order = np.argsort(bucket["sub"], kind="stable")
        ends = np.searchsorted(bucket["sub"][order], np.arange(256), side="right")
        low = 0
        for k, high in enumerate(ends):
            if high > low and (k == 255 or (ends[k + 1] - low) * fields["text"][1][0] > PART_BYTES):
                yield part({name: v[order[low:high]] for name, v in bucket.items()})
                low = high

    def part(got: dict[str, np.ndarray]) -> pa.RecordBatch:
        starts, several = got["starts"].astype(np.int64), got["several"]
        decided = np.flatnonzero(several == 2)
        live = np.flatnonzero(several < 2)
        text, counts = got["text"][live], starts[live]
        # equal stretches of several map tasks: one stands for all, and all their strings repeat
        print_ = _prints(text) + counts.astype(np.uint64)
        _, first, which, times = np.unique(print_, return_index=True, return_inverse=True, return_counts=True)
        known = (times > 1) | (np.bincount(which, weights=several[live] == 1) > 0)
        ranges = [_ranges(got, decided, np.zeros(len(decided), np.int64), starts[decided], length)]
        all_known = live[known[which]]
        ranges.append(_ranges(got, all_known, np.zeros(len(all_known), np.int64), starts[all_known], length))
        if len(first):
            body, counts = text[first], counts[first]
            sizes = counts + length - 1
            # symbols: 0 ends the whole, 1 ends a stretch, bytes follow
            place = np.arange(body.shape[1] + 1)
            cells = np.ones((len(body), len(place)), dtype=np.int16)
            cells[:, :-1] = body
            cells[:, :-1] += 2
            cells[np.arange(len(body)), sizes] = 1
            flat = np.append(cells[place <= sizes[:, None]], np.int16(0))
            del cells
            begins = np.cumsum(sizes + 1) - (sizes + 1)
            order = suffix_array(flat, 258, length)
            owner = np.full(len(flat), -1, dtype=np.int32)
            of = np.repeat(np.arange(len(counts)), counts)
            offset = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            owner[begins[of] + offset] = of
            order = order[owner[order] >= 0]
            sums = K.mix(np.arange(7, 265, dtype=np.uint64))[flat]
            sums *= K.powers(K.BASE, len(flat))
            sums = K.running(sums)
            prefix = (sums[order + length] - sums[order]) * K.powers(K.BASE_INVERSE, len(flat))[order]
            same = np.r_[False, prefix[1:] == prefix[:-1]]
            node = np.cumsum(~same) - 1
            repeated = (np.bincount(node) > 1)[node]
            at = np.sort(order[repeated])
            if len(at):
                joint = np.r_[True, (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])]
                heads = at[joint]
                long = np.diff(np.r_[np.flatnonzero(joint), len(at)])
                who = owner[heads]
                fresh = ~known[who]
                rows = live[first[who[fresh]]]
                ranges.append(_ranges(got, rows, (heads - begins[who])[fresh], long[fresh], length))
        rid, tid, spans = (np.concatenate(x) for x in zip(*ranges))
        return _per_row(rid, tid, spans)

    return run


def _ranges(got: dict, rows: np.ndarray, shift: np.ndarray, starts: np.ndarray, length: int):
    low = got["at"][rows] + shift
    return got["rid"][rows], got["tid"][rows], np.stack([low, low + starts + length - 1], axis=1).astype("<i8")


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans (low, high) as maximal runs."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.r_[True, spans[1:, 0] > reach[:-1]]
    at = np.flatnonzero(fresh)
    return np.stack([spans[at, 0], reach[np.r_[at[1:] - 1, len(spans) - 1]]], axis=1)


def _apply(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, digests, kept = [], [], [], [], []
            whole = batch.column("whole").to_numpy(zero_copy_only=False)
            lists = batch.column("spans").to_pylist()
            for texts in K.slices(batch.column("text"), SLICE):
                for d in range(len(texts)):
                    raw = texts.data[texts.offsets[d] : texts.offsets[d + 1]]
                    blobs = lists[texts.first + d]
                    if whole[texts.first + d] and len(raw) >= length:
                        runs = np.array([[0, len(raw)]])
                    elif blobs:
                        runs = merged(joined(blobs, "<i8").reshape(-1, 2))
                    else:
                        runs = np.zeros((0, 2), dtype=np.int64)
                    edges = np.r_[0, runs.ravel(), len(raw)]
                    rest = b"".join(raw[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2]))
                    n_bytes.append(len(raw))
                    n_removed.append(len(raw) - len(rest))
                    n_spans.append(len(runs))
                    digests.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest)
            yield pa.RecordBatch.from_pydict(
                {
                    "rid": batch.column("rid"),
                    "n_bytes": pa.array(n_bytes, pa.int64()),
                    "n_removed": pa.array(n_removed, pa.int64()),
                    "n_spans": pa.array(n_spans, pa.int64()),
                    "kept_sha256": pa.array(digests, pa.string()),
                    "kept": pa.array(kept, pa.binary()),
                }
            )

    return run


APPLIED = "rid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def repeated_texts(rows: DataFrame) -> DataFrame:
    """rid, tid of texts that stand in more than one row; ``later``: another row represents them."""
    keyed = rows.select("rid", "tid", F.md5("text").alias("digest"))
    groups = keyed.groupBy("digest").agg(F.min("rid").alias("least"), F.count("*").alias("n")).where("n > 1")
    return (
        keyed.join(groups, "digest")
        .groupBy("rid", "tid")
        .agg((F.min("least") < F.col("rid")).alias("later"), F.lit(True).alias("whole"))
    )


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, cut: int = CUT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    ``cut`` has no effect any more: strings of frequent anchors go one by one.
    """
    n = bucket_count(docs.sparkSession)
    rid = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("rid")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(rid, text.alias("text")).withColumn("tid", F.xxhash64("text"))
    texts = rows.repartition(n, "rid", "tid")
    base = texts.join(repeated_texts(rows), ["rid", "tid"], "left")
    base = base.select("rid", "tid", "text", F.coalesce("later", F.lit(False)).alias("later"), F.coalesce("whole", F.lit(False)).alias("whole"))
    named = base.where("not later").select("rid", "tid", "text").mapInArrow(
        _name_anchors(n, length, gram), Outbox(n, ANCHOR).schema()
    )
    repeated = (
        to_buckets(named, n)
        .mapInArrow(_repeated_anchors(group), PER_ROW)
        .groupBy("rid", "tid")
        .agg(F.collect_list("packed").alias("anchors"))
    )
    held = base.where("not later").join(repeated, ["rid", "tid"]).select("rid", "tid", "text", "anchors")
    shipped = held.mapInArrow(_ship(n, length, gram), Outbox(n, _fields(length, gram)).schema())
    many = n * STRING_BUCKETS
    strings = held.mapInArrow(_strings(many, length, gram), Outbox(many, STRING).schema())
    spans = (
        to_buckets(shipped, n)
        .mapInArrow(_repeats(length, gram), PER_ROW)
        .union(to_buckets(strings, many).mapInArrow(_repeated_strings(length), PER_ROW))
        .groupBy("rid", "tid")
        .agg(F.collect_list("packed").alias("spans"))
    )
    out = base.join(spans, ["rid", "tid"], "left").select("rid", "text", "whole", "spans").mapInArrow(_apply(length), APPLIED)
    return out.select(doc_id_of(), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
