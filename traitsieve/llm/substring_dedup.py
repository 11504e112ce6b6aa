"""Substring deduplication over words with prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words.  Suffixes are cut at a window's length: a
repeated window is an internal node at least that deep, and longer repeats are runs
of such nodes.  The work is split by *variable-length prefixes*: a suffix's prefix
reaches up to its anchor, the ``GRAM`` words with the smallest hash among the window's,
so it is GRAM to WINDOW words long, and equal windows have equal prefixes.

1. Each text names its anchors.  Buckets of anchors count the texts that have each;
   suffixes whose anchor stands in one text only cannot repeat and go no further.
2. The other suffixes go to their prefix's bucket, those that share an anchor as one
   record of its surrounding words.  Where an anchor is in more than ``GROUP`` texts, the
   prefix is taken to its full length, the window, so that one bucket never gets them
   all; equal windows are then merged within each map task.
3. A bucket sorts its suffixes, compares neighbours and has the tree's deep nodes; every
   leaf but those of the smallest doc_id is a window to remove.
4. Each text removes the words under its windows.

Later copies of a whole text are known from its digest and take no part in 1 to 3.
Words travel as 32 bits of their hash; a false match needs thirteen such words equal
in place and one of them a different word.

Defined results: null and empty texts have no words; texts below WINDOW words keep
all; rows without doc_id count as later than all others and equal to each other; rows
that share a doc_id are judged against other ids only; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from traitsieve.llm import kernels as K
from traitsieve.llm.packets import Outbox, bucket_count, joined, per_document, to_buckets, unpack
from traitsieve.llm.tables import doc_id_of, keyed_texts, later_copies

WINDOW = 13
GRAM = 6
#: Texts that may share an anchor before its suffixes are split by whole windows.
GROUP = 4_000

ANCHOR = {"key": "<u8", "rid": "<i8"}


def _codes(texts: K.Texts, words: K.Words) -> np.ndarray:
    return K.word_hashes(texts, words, fold=False) >> K.U64(32)


def _windows(codes: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """Anchor of each window start, and which starts stay inside their text."""
    anchors = K.window_minima(K.gram_hashes(codes, gram), window - gram + 1)
    return anchors, K.whole_windows(bounds, window, len(anchors))


def _name_anchors(n: int, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = Outbox(n, ANCHOR)
        for batch in batches:
            rids = batch.column("rid").to_numpy()
            for texts in K.slices(batch.column("text")):
                words = K.Words(texts, K.SPACES)
                anchors, ok = _windows(_codes(texts, words), words.bounds, window, gram)
                docs = words.text_of()[: len(anchors)][ok]
                anchors = anchors[ok]
                order = np.lexsort((anchors, docs))
                anchors, docs = anchors[order], docs[order]
                new = np.ones(len(docs), dtype=bool)
                new[1:] = (anchors[1:] != anchors[:-1]) | (docs[1:] != docs[:-1])
                anchors, docs = anchors[new], docs[new]
                box.add(anchors % K.U64(n), key=anchors, rid=rids[texts.first + docs])
                if box.full():
                    yield from box.flush()
        yield from box.flush()

    return run


def _repeated_anchors(group: int):
    """Per document its anchors that other documents have; the lowest bit marks big groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = unpack(batches, ANCHOR)
        order = np.argsort(got["key"], kind="stable")
        key, rid = got["key"][order], got["rid"][order]
        if not len(key):
            return
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[at, len(key)])
        count = np.repeat(count, count)
        many = count > 1
        flagged = (key[many] & ~K.U64(1)) | (count[many] > group).astype(np.uint64)
        yield per_document(rid[many], flagged)

    return run


def _ship(n: int, window: int, gram: int, fields: dict):
    span = window + (window - gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = Outbox(n, fields)
        for batch in batches:
            rids, lists = batch.column("rid").to_numpy(), batch.column("anchors").to_pylist()
            for texts in K.slices(batch.column("text")):
                words = K.Words(texts, K.SPACES)
                codes = _codes(texts, words)
                anchors, ok = _windows(codes, words.bounds, window, gram)
                if not len(anchors):
                    continue
                kept = anchors & ~K.U64(1)
                state = np.zeros(len(anchors), dtype=np.int8)  # 1: repeats, 2: in a big group
                for d in range(len(texts)):
                    blobs = lists[texts.first + d]
                    if blobs:
                        mine = np.sort(joined(blobs))
                        a, b = words.bounds[d], min(words.bounds[d + 1], len(anchors))
                        part = kept[a:b]
                        state[a:b] = K.member(part, mine) + 2 * K.member(part | K.U64(1), mine)
                state[~ok] = 0
                docs = rids[texts.first + words.text_of()]
                padded = np.concatenate([codes, np.zeros(span, np.uint64)]).astype("<u4")
                view = np.lib.stride_tricks.sliding_window_view(padded, span)
                # runs of starts with one anchor become one record
                live = state == 1
                begins = live.copy()
                begins[1:] &= ~(live[:-1] & (kept[1:] == kept[:-1]) & (docs[1 : len(live)] == docs[: len(live) - 1]))
                at = np.flatnonzero(live)
                heads = np.flatnonzero(begins)
                run_of = np.cumsum(begins)[at] - 1
                place = at - heads[run_of]
                limit = window - gram + 1
                heads = at[place % limit == 0]
                sizes = np.diff(np.r_[np.flatnonzero(place % limit == 0), len(at)])
                box.add((kept[heads] >> K.U64(1)) % K.U64(n), words=view[heads], starts=sizes.astype(np.uint8), rid=docs[heads])
                # big groups: the prefix is the whole window; of equal ones the smallest document goes
                at = np.flatnonzero(state == 2)
                if len(at):
                    whole = K.gram_hashes(codes, window)[at]
                    order = np.lexsort((docs[at], whole))
                    at, whole = at[order], whole[order]
                    first = np.r_[True, whole[1:] != whole[:-1]]
                    least = docs[at[first]][np.cumsum(first) - 1]
                    later = docs[at] > least
                    box.add(docs[at[later]].astype(np.uint64) % K.U64(n), words=view[at[later]], starts=np.uint8(0), rid=docs[at[later]])
                    box.add(whole[first] % K.U64(n), words=view[at[first]], starts=np.uint8(1), rid=docs[at[first]])
                if box.full():
                    yield from box.flush()
        yield from box.flush()

    return run


def sorted_suffixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of word rows, and how many leading words each shares with the one before."""
    order = np.lexsort(rows.T[::-1])
    ranked = rows[order]
    same = np.zeros(ranked.shape, dtype=bool)
    same[1:] = ranked[1:] == ranked[:-1]
    common = np.where(same.all(axis=1), rows.shape[1], (~same).argmax(axis=1))
    return order, common


def _trees(window: int, gram: int, fields: dict):
    """Windows to remove, per document, from a bucket's suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = unpack(batches, fields)
        words, starts, rid = got["words"], got["starts"].astype(np.int64), got["rid"]
        decided = starts == 0
        which = np.repeat(np.arange(len(starts)), starts)
        shift = np.arange(len(which)) - np.repeat(np.cumsum(starts) - starts, starts)
        suffixes = words[which[:, None], shift[:, None] + np.arange(window)] if len(which) else np.zeros((0, window), "<u4")
        docs = rid[which]
        order, common = sorted_suffixes(suffixes)
        deep = common >= window
        node = np.cumsum(~deep) - 1
        least = np.minimum.reduceat(docs[order], np.flatnonzero(~deep)) if len(order) else docs
        gone = order[docs[order] > least[node]] if len(order) else order
        rows = np.concatenate([suffixes[gone], words[decided][:, :window]])
        hashes = _row_hashes(rows)
        yield per_document(np.concatenate([docs[gone], rid[decided]]), hashes)

    return run


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    out = rows[:, 0].astype(np.uint64)
    for j in range(1, rows.shape[1]):
        out = out * K.U64(K.BASE) + rows[:, j]
    return K.mix(out)


def _kept_words(batch: pa.RecordBatch, window: int):
    """For each row: its text as bytes, its words' spans, and which words stay."""
    copies = batch.column("copy").to_numpy(zero_copy_only=False)
    lists = batch.column("windows").to_pylist()
    for texts in K.slices(batch.column("text")):
        words = K.Words(texts, K.SPACES)
        codes = None
        for d in range(len(texts)):
            a, b = words.bounds[d], words.bounds[d + 1]
            count = int(b - a)
            keep = np.ones(count, dtype=bool)
            if count >= window and copies[texts.first + d]:
                keep[:] = False
            elif count >= window and lists[texts.first + d]:
                if codes is None:
                    codes = _codes(texts, words)
                gone = np.sort(joined(lists[texts.first + d]))
                hit = K.member(K.gram_hashes(codes[a:b], window), gone)
                keep = ~K.covered(np.flatnonzero(hit), window, count)
            low, high = texts.offsets[d], texts.offsets[d + 1]
            raw = texts.data[low:high].tobytes()
            yield raw, words.starts[a:b] - low, words.ends[a:b] - low, keep


def _digests(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests = [], [], []
            for raw, starts, ends, keep in _kept_words(batch, window):
                pieces = [raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist())]
                n_words.append(len(keep))
                n_removed.append(len(keep) - len(pieces))
                digests.append(hashlib.sha256(b" ".join(pieces)).hexdigest())
            yield pa.RecordBatch.from_pydict(
                {
                    "rid": batch.column("rid"),
                    "n_words": pa.array(n_words, pa.int64()),
                    "n_removed": pa.array(n_removed, pa.int64()),
                    "kept_sha256": pa.array(digests, pa.string()),
                }
            )

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for raw, starts, ends, keep in _kept_words(batch, window):
                if keep.all():
                    kept.append(raw)
                    continue
                # a kept run goes up to the start of the next word, so spacing inside it stays
                edge = np.flatnonzero(np.diff(np.r_[False, keep, False].astype(np.int8)))
                kept.append(b" ".join(raw[starts[i] : ends[j - 1]] for i, j in zip(edge[::2], edge[1::2])))
            texts = pa.array(kept, pa.binary()).cast(pa.string())
            nulls = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            texts = pa.array([None if z else t for z, t in zip(nulls, texts.to_pylist())], pa.string()) if nulls.any() else texts
            names = [c for c in batch.schema.names if c not in ("copy", "windows")]
            yield pa.RecordBatch.from_arrays([texts if c == "text" else batch.column(c) for c in names], names)

    return run


def _removal(docs: DataFrame, window: int, gram: int, group: int, others: tuple[str, ...] = ()) -> DataFrame:
    """rid, text, other columns, whether the row is a later copy, and the windows to remove."""
    n = bucket_count(docs.sparkSession)
    span = window + (window - gram)
    fields = {"words": ("<u4", (span,)), "starts": "u1", "rid": "<i8"}
    texts = keyed_texts(docs, n, others)
    copies = later_copies(docs)
    base = texts.join(copies, "rid", "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    named = base.where("not copy").select("rid", "text").mapInArrow(
        _name_anchors(n, window, gram), Outbox(n, ANCHOR).schema()
    )
    repeated = (
        to_buckets(named, n)
        .mapInArrow(_repeated_anchors(group), "rid long, packed binary")
        .groupBy("rid")
        .agg(F.collect_list("packed").alias("anchors"))
    )
    shipped = (
        base.where("not copy")
        .join(repeated, "rid")
        .select("rid", "text", "anchors")
        .mapInArrow(_ship(n, window, gram, fields), Outbox(n, fields).schema())
    )
    windows = (
        to_buckets(shipped, n)
        .mapInArrow(_trees(window, gram, fields), "rid long, packed binary")
        .groupBy("rid")
        .agg(F.collect_list("packed").alias("windows"))
    )
    return base.join(windows, "rid", "left")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by spaces)."""
    rows = _removal(docs, window, gram, group).select("rid", "text", "copy", "windows")
    out = rows.mapInArrow(_digests(window), "rid long, n_words long, n_removed long, kept_sha256 string")
    return out.select(doc_id_of(), "n_words", "n_removed", "kept_sha256")


def cut_texts(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``docs`` with the repeated words cut out of ``text``; the text between other words is unchanged."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("0"), *[F.col(c) for c in others]).alias("others"))
    rows = _removal(packed, window, gram, group, ("others",)).select("rid", "text", "others", "copy", "windows")
    kept = StructType([f for f in rows.schema.fields if f.name not in ("copy", "windows")])
    out = rows.mapInArrow(_cut(window), kept)
    own = {"doc_id": doc_id_of(), "text": F.col("text")}
    return out.select(*[own.get(c, F.col("others")[c].alias(c)) for c in docs.columns])
