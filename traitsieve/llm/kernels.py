"""Array kernels over a batch of texts: words, rolling hashes, window minima.

Texts arrive as one UTF-8 buffer with offsets (an Arrow string column), so a batch
is worked on as a few long arrays.  ``slices`` keeps the buffers small: texts are
taken together up to ``SLICE_BYTES``; a longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)

#: Word alphabets of the operators, as the bytes that separate words.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_WORD = np.zeros(256, dtype=bool)
for low, high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    NOT_WORD[low : high + 1] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))


@lru_cache(maxsize=4)
def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    size = SLICE_BYTES + 2
    while size < n:
        size *= 2
    return _powers_of(base, size)[:n]


class Texts:
    """Some texts of a batch as one byte array; nulls are empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int) -> None:
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of an Arrow string column in slices of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offs, raw = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


class Words:
    """Word spans of some texts: start and end byte, text index, first word of each text."""

    def __init__(self, texts: Texts, separators: np.ndarray) -> None:
        data, offsets = texts.data, texts.offsets
        inside = np.empty(len(data) + 1, dtype=bool)
        inside[:-1] = ~separators[data]
        inside[-1] = False
        before = np.empty(len(data) + 1, dtype=bool)
        before[0] = False
        before[1:] = inside[:-1]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        self.starts = np.flatnonzero(inside & (~before | cut))
        self.ends = np.flatnonzero(before & (~inside | cut))
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums: any span's hash is a difference times an inverse power."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    raw = (sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(sums))[starts]
    return mix(raw + (ends - starts).astype(np.uint64))


def word_hashes(texts: Texts, words: Words, fold: bool) -> np.ndarray:
    data = LOWER[texts.data] if fold else texts.data
    return span_hashes(prefix_hashes(data), words.starts, words.ends)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive word hashes (one shorter array by k - 1)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= U64(BASE)
        out += words[j : j + n]
    return mix(out)


def whole_windows(bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """For ``n`` window starts of length ``k``: True if the window stays inside one text."""
    ok = np.ones(max(n, 0), dtype=bool)
    for b in range(1, k):  # the k - 1 starts before each inner boundary cross it
        at = bounds[1:-1] - b
        at = at[(at >= 0) & (at < n)]
        ok[at] = False
    return ok


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    best, span = values, 1
    while span * 2 <= width:
        best = np.minimum(best[: len(best) - span], best[span:])
        span *= 2
    rest = width - span
    return np.minimum(best[:n], best[rest : rest + n]) if rest else best[:n]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Of ``n`` places, those within ``width`` after one of ``starts``."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:-1]) > 0


def member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values


def running(values: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2, ... of some 64-bit values, wrapping round."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def lowered(texts: Texts) -> Texts:
    """The texts with A-Z in lower case."""
    return Texts(LOWER[texts.data], texts.offsets, texts.first)
