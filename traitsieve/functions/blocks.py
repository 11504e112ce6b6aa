"""Wide tables as blocks: cells of some features and some rows in one array.

A table of thousands of features has too many cells for a row each.  Here a batch of rows is
transposed and cut into blocks of ``FEATURES`` features, and statistics are worked out on whole
blocks; what a task hands on is an array per block of features, of the size of its figures.

Order statistics (medians, quantiles, the edges of equal bins) come by radix selection: a number
is a key of 64 bits whose order is that of the numbers; a scan counts the next digit of the keys
that share the digits found so far, for all features and ranks at once, and a rank moves into the
cell that holds it.  Once cells are small their numbers are fetched and ranked; equal numbers
never leave one cell, and after the last digit the cell itself is the number.  Nothing is sorted
that is larger than a cell of ``CELL`` numbers.

Missing cells are nulls and take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = 128
#: Bytes of figures a task holds before it hands them on.
HELD_BYTES = 32_000_000
BITS = 11
#: Cells with no more numbers than this are fetched and ranked.
CELL = 1_000


def _transposed(width: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("values").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = x.reshape(batch.num_rows, width)
            coded = batch.column("label").dictionary_encode()
            codes = coded.indices.fill_null(len(coded.dictionary)).to_numpy()
            kinds = pa.concat_arrays([coded.dictionary, pa.nulls(1, coded.dictionary.type)])
            for code in np.unique(codes):
                own = x[codes == code]
                at = range(0, width, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        kinds.take(pa.array([int(code)] * len(at))),
                        pa.array([a // size for a in at], pa.int32()),
                        pa.array([len(own)] * len(at), pa.int32()),
                        pa.array([np.ascontiguousarray(own[:, a : a + size].T).tobytes() for a in at], pa.binary()),
                    ],
                    names=["label", "block", "n", "cells"],
                )

    return run


def feature_blocks(df: DataFrame, width: int, by_label: bool = False, size: int = FEATURES) -> DataFrame:
    """``label, block, n, cells``: rows of one label (null without ``by_label``), features x rows."""
    label = F.col("label") if by_label else F.lit(None).cast("string")
    rows = df.select(label.alias("label"), "values").where("values is not null")
    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(_transposed(width, size), f"label {kind}, block int, n int, cells binary")


def _cells(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """Place in the batch, block and features x rows of each row."""
    for i, (block, n) in enumerate(zip(batch.column("block").to_pylist(), batch.column("n").to_pylist())):
        yield i, block, np.frombuffer(batch.column("cells")[i].as_py()).reshape(-1, n)


def _folded(made: Callable, add: Callable, key: tuple[str, ...]):
    """A task's figures by key, added up and handed on when many are held.

    ``made`` gives (key, figures) of a batch's rows; figures are arrays of doubles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds: dict[str, pa.DataType] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], kinds[c]) for i, c in enumerate(key)]
            packed = pa.array([np.ascontiguousarray(v, np.float64).tobytes() for v in held.values()], pa.binary())
            return pa.RecordBatch.from_arrays([*columns, packed], names=[*key, "figures"])

        for batch in batches:
            kinds = {c: batch.schema.field(c).type for c in key}
            for k, figures in made(batch):
                held[k] = add(held[k], figures) if k in held else figures
            if sum(v.nbytes for v in held.values()) > HELD_BYTES:
                yield out()
                held.clear()
        if held:
            yield out()

    return run


def _sums(blocks: DataFrame, made: Callable, add: Callable, key: tuple[str, ...]) -> DataFrame:
    """Figures by key over all rows: added in the tasks, then where equal keys meet."""
    schema = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in key) + ", figures binary"

    def again(batch: pa.RecordBatch):
        keys = zip(*[batch.column(c).to_pylist() for c in key])
        for k, packed in zip(keys, batch.column("figures")):
            yield k, np.frombuffer(packed.as_py())

    flat = lambda a, b: add(a.ravel(), b.ravel())
    return (
        blocks.mapInArrow(_folded(made, flat, key), schema)
        .repartition(*key)
        .mapInArrow(_folded(again, flat, key), schema)
    )


# --- moments -------------------------------------------------------------------------


def _moments_of(x: np.ndarray) -> np.ndarray:
    """Rows, cells, mean and squares around the mean of each feature."""
    known = ~np.isnan(x)
    n = known.sum(axis=1)
    safe = np.where(known, x, 0.0)
    mean = safe.sum(axis=1) / np.maximum(n, 1)
    squares = (np.where(known, safe - mean[:, None], 0.0) ** 2).sum(axis=1)
    return np.stack([np.full(len(x), float(x.shape[1])), n.astype(float), mean, squares])


def _added_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    (ra, na, ma, sa), (rb, nb, mb, sb) = a.reshape(4, -1), b.reshape(4, -1)
    n = na + nb
    share = nb / np.maximum(n, 1)
    gap = mb - ma
    return np.stack([ra + rb, n, ma + gap * share, sa + sb + gap**2 * na * share])


def block_moments(df: DataFrame, width: int, by_label: bool = False, size: int = FEATURES) -> DataFrame:
    """``[label,] feature_idx, rows, n, mean, variance``; mean and variance are null without cells."""

    def made(batch: pa.RecordBatch):
        labels = batch.column("label").to_pylist()
        for i, block, x in _cells(batch):
            yield (block, labels[i]), _moments_of(x)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, packed in enumerate(batch.column("figures")):
                rows, n, mean, squares = np.frombuffer(packed.as_py()).reshape(4, -1)
                block = batch.column("block")[i].as_py()
                yield pa.RecordBatch.from_pydict(
                    {
                        "label": pa.concat_arrays([batch.column("label").slice(i, 1)] * len(n)),
                        "feature_idx": pa.array(block * size + np.arange(len(n)), pa.int32()),
                        "rows": pa.array(rows.astype(np.int64)),
                        "n": pa.array(n.astype(np.int64)),
                        "mean": pa.array(mean, mask=n == 0),
                        "variance": pa.array(squares / np.maximum(n - 1, 1), mask=n < 2),
                    }
                )

    blocks = feature_blocks(df, width, by_label, size)
    kind = blocks.schema["label"].dataType.simpleString()
    sums = _sums(blocks, made, _added_moments, ("block", "label"))
    found = sums.mapInArrow(spread, f"label {kind}, feature_idx int, rows long, n long, mean double, variance double")
    return found if by_label else found.drop("label")


# --- order statistics ----------------------------------------------------------------


def keys_of(x: np.ndarray) -> np.ndarray:
    """Unsigned keys in the order of the numbers; the two zeros are one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def numbers_of(keys: np.ndarray) -> np.ndarray:
    bits = np.where(keys >> np.uint64(63), keys ^ np.uint64(1 << 63), ~keys)
    return bits.view(np.float64)


def _digit(keys: np.ndarray, known: int, bits: int) -> np.ndarray:
    """The ``bits`` after the first ``known`` ones (fewer at the end)."""
    left = 64 - known
    part = keys << np.uint64(known) if known else keys
    return (part >> np.uint64(64 - min(bits, left))).astype(np.int64)


def _same(keys: np.ndarray, prefix: np.ndarray, known: int) -> np.ndarray:
    if not known:
        return np.ones(keys.shape, dtype=bool)
    shift = np.uint64(64 - known)
    return (keys >> shift) == (prefix >> shift)


def order_statistics(
    df: DataFrame, width: int, ranks_of: Callable[[np.ndarray], np.ndarray], cell: int = CELL, size: int = FEATURES
) -> tuple[np.ndarray, np.ndarray]:
    """Numbers at the wanted ranks, features x ranks, and the cells of each feature.

    ``ranks_of`` gives, from the numbers of cells, the ranks (from 0) of each feature.  What comes
    to the driver is a number per feature and rank.  Features without cells give NaN.
    """
    blocks = feature_blocks(df, width, size=size).persist(StorageLevel.MEMORY_AND_DISK)

    def collected(made, add, closing, figures: int) -> np.ndarray:
        """Figures of all features, after ``closing`` was applied to each block's sums."""

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                packed = [
                    np.ascontiguousarray(closing(block, np.frombuffer(f.as_py())), np.float64).tobytes()
                    for block, f in zip(batch.column("block").to_pylist(), batch.column("figures"))
                ]
                yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(packed, pa.binary())], names=["block", "figures"])

        out = np.zeros((width, figures))
        for r in _sums(blocks, made, add, ("block",)).mapInArrow(close, "block int, figures binary").collect():
            part = np.frombuffer(bytes(r["figures"])).reshape(-1, figures)
            out[r["block"] * size : r["block"] * size + len(part)] = part
        return out

    def counted(batch: pa.RecordBatch):
        for _, block, x in _cells(batch):
            yield (block,), (~np.isnan(x)).sum(axis=1).astype(float)

    n = collected(counted, np.add, lambda _, f: f, 1)[:, 0].astype(np.int64)
    rank = np.maximum(np.asarray(ranks_of(n), dtype=np.int64), 0)
    wanted = rank.shape[1]
    prefix, found = np.zeros((width, wanted), dtype=np.uint64), np.full((width, wanted), np.nan)
    inside = np.repeat(n[:, None], wanted, axis=1)
    known = 0
    while known < 64 and inside.max(initial=0) > cell:
        size_of = 1 << min(BITS, 64 - known)

        def histogram(batch: pa.RecordBatch, prefix=prefix, known=known, size_of=size_of):
            for _, block, x in _cells(batch):
                own = prefix[block * size : block * size + len(x)]
                keys, here = keys_of(x), ~np.isnan(x)
                digit = _digit(keys, known, BITS)
                counts = np.zeros((len(x), wanted, size_of))
                for t in range(wanted):
                    feature, row = np.nonzero(here & _same(keys, own[:, t, None], known))
                    flat = np.bincount(feature * size_of + digit[feature, row], minlength=len(x) * size_of)
                    counts[:, t] = flat.reshape(len(x), size_of)
                yield (block,), counts

        def chosen(block: int, figures: np.ndarray, rank=rank, size_of=size_of) -> np.ndarray:
            counts = figures.reshape(-1, wanted, size_of)
            own = rank[block * size : block * size + len(counts)]
            upto = counts.cumsum(axis=2)
            digit = np.minimum((upto <= own[:, :, None]).sum(axis=2), size_of - 1)
            at = digit[:, :, None]
            held = np.take_along_axis(counts, at, axis=2)[:, :, 0]
            before = np.take_along_axis(upto, at, axis=2)[:, :, 0] - held
            return np.stack([digit, own - before, held], axis=2)

        state = collected(histogram, np.add, chosen, 3 * wanted).reshape(width, wanted, 3)
        shift = np.uint64(64 - known - min(BITS, 64 - known))
        prefix = prefix | (state[:, :, 0].astype(np.uint64) << shift)
        rank, inside = state[:, :, 1].astype(np.int64), state[:, :, 2].astype(np.int64)
        known += min(BITS, 64 - known)
    if known == 64:
        found = numbers_of(prefix)
    else:

        def fetched(batch: pa.RecordBatch):
            """Numbers of the cells as triples: feature in the block, rank's place, number."""
            for _, block, x in _cells(batch):
                own = prefix[block * size : block * size + len(x)]
                keys, here = keys_of(x), ~np.isnan(x)
                for t in range(wanted):
                    feature, row = np.nonzero(here & _same(keys, own[:, t, None], known))
                    yield (block,), np.stack([feature, np.full(len(feature), t), x[feature, row]], axis=1)

        def ranked(block: int, figures: np.ndarray) -> np.ndarray:
            feature, t, number = figures.reshape(-1, 3).T
            here = min(size, width - block * size)
            out = np.full((here, wanted), np.nan)
            order = np.lexsort((number, t, feature))
            group = (feature * wanted + t)[order].astype(np.int64)
            starts = np.searchsorted(group, np.arange(here * wanted)).reshape(here, wanted)
            at = starts + rank[block * size : block * size + here]
            fine = at < len(order)
            fine[fine] = group[at[fine]] == np.flatnonzero(fine.ravel())
            out[fine] = number[order][at[fine]]
            return out

        found = collected(fetched, lambda a, b: np.concatenate([a, b]), ranked, wanted)
    blocks.unpersist()
    found = np.where((n > 0)[:, None], found, np.nan)
    return found, n


def quantiles(df: DataFrame, width: int, share: float, cell: int = CELL, size: int = FEATURES) -> np.ndarray:
    """Linear-interpolated quantile of each feature; NaN without cells."""

    def ranks(n: np.ndarray) -> np.ndarray:
        at = np.maximum(n - 1, 0) * share
        return np.stack([np.floor(at), np.ceil(at)], axis=1)

    found, n = order_statistics(df, width, ranks, cell, size)
    part = np.maximum(n - 1, 0) * share
    return found[:, 0] + (part - np.floor(part)) * (found[:, 1] - found[:, 0])


def bin_counts(df: DataFrame, width: int, bins: int, cell: int = CELL, size: int = FEATURES) -> DataFrame:
    """``feature_idx, label, bin, c`` on equal-frequency bins; equal numbers share a bin.

    A number's bin follows from how many are smaller: it is past the edge of bin j if the number
    of rank j/bins is smaller than it.
    """
    steps = np.arange(1, bins)
    edges, _ = order_statistics(df, width, lambda n: -(-steps[None, :] * n[:, None] // bins) - 1, cell, size)

    def made(batch: pa.RecordBatch):
        labels = batch.column("label").to_pylist()
        for i, block, x in _cells(batch):
            own = edges[block * size : block * size + len(x)]
            place = np.zeros(x.shape, dtype=np.int64)
            for j in range(bins - 1):
                place += x > own[:, j, None]
            feature, row = np.nonzero(~np.isnan(x))
            flat = np.bincount(feature * bins + place[feature, row], minlength=len(x) * bins)
            yield (block, labels[i]), flat.astype(float)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, packed in enumerate(batch.column("figures")):
                counts = np.frombuffer(packed.as_py()).reshape(-1, bins)
                feature, place = np.nonzero(counts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "feature_idx": pa.array(batch.column("block")[i].as_py() * size + feature, pa.int32()),
                        "label": batch.column("label").take(pa.array([i] * len(feature), pa.int64())),
                        "bin": pa.array(place, pa.int64()),
                        "c": pa.array(counts[feature, place].astype(np.int64)),
                    }
                )

    blocks = feature_blocks(df, width, by_label=True, size=size)
    kind = blocks.schema["label"].dataType.simpleString()
    sums = _sums(blocks, made, np.add, ("block", "label"))
    return sums.mapInArrow(spread, f"feature_idx int, label {kind}, bin long, c long")
