"""Suffix sorting by induction with bucket queues that spill to disk.

The order of a few suffixes (leftmost of their type, "seeds") decides that of all others:
a scan through the buckets of first symbols, smallest first, puts each suffix's larger-type
predecessor into a later bucket's queue; a scan back does it for the other type.  Seeds are
sorted by the same two scans and named, and the string of names is sorted recursively.

Within a bucket the queue is first in, first out, because suffixes are inserted in the order
of what follows their first symbol.  So a priority queue over (symbol, rank) is one queue per
symbol, worked on as arrays.  Queues beyond ``memory`` positions are appended to files, one
per symbol, in a folder of the task that goes with the task.

Names of the recursion have large alphabets; once a string of names has at most ``memory``
symbols it is sorted in memory by doubled prefixes, up to ``depth`` symbols of the text:
suffixes that share a longer prefix may come in any order.
"""

from __future__ import annotations

import tempfile
from pathlib import Path

import numpy as np

from traitsieve.llm.kernels import BASE, U64, mix, powers

MEMORY = 1 << 24
#: Alphabets above this are sorted in memory: a scan has a step for each symbol.
ALPHABET_MOST = 1 << 15


class Queues:
    """A queue of positions for each symbol."""

    def __init__(self, sigma: int, memory: int, folder: str) -> None:
        self.held: list[list[np.ndarray]] = [[] for _ in range(sigma)]
        self.memory, self.count = memory, 0
        self.files = [Path(folder, f"{id(self)}-{s}") for s in range(sigma)]
        self.spilled = np.zeros(sigma, dtype=bool)

    def put(self, symbols: np.ndarray, positions: np.ndarray) -> None:
        if not len(positions):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, positions = symbols[order], positions[order]
        at = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        ends = np.r_[at[1:], len(symbols)]
        for a, b in zip(at.tolist(), ends.tolist()):
            self.held[symbols[a]].append(positions[a:b])
        self.count += len(positions)
        if self.count > self.memory:
            self._spill()

    def _spill(self) -> None:
        for s, parts in enumerate(self.held):
            if parts:
                with self.files[s].open("ab") as file:
                    for part in parts:
                        part.tofile(file)
                self.spilled[s] = True
                self.held[s] = []
        self.count = 0

    def take(self, symbol: int, kind: np.dtype) -> np.ndarray:
        parts, self.held[symbol] = self.held[symbol], []
        self.count -= sum(map(len, parts))
        if self.spilled[symbol]:
            parts.insert(0, np.fromfile(self.files[symbol], dtype=kind))
            self.files[symbol].unlink()
            self.spilled[symbol] = False
        return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


def small_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last, the smallest symbol, is."""
    n = len(text)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = (text[1:] > text[:-1]).view(np.int8) - (text[1:] < text[:-1]).view(np.int8)
    step[-1] = 1
    # equal neighbours take the type of the run's end
    last = np.arange(n, dtype=np.int32 if n < 2**31 - 1 else np.int64)
    last[step == 0] = n
    last = np.minimum.accumulate(last[::-1])[::-1]
    return step[last] > 0


def _scans(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, sigma: int, memory: int, folder: str) -> np.ndarray:
    """All suffixes in the order that ``seeds``, sorted within buckets, induce."""
    kind = seeds.dtype
    of_seed = text[seeds]
    order = np.argsort(of_seed, kind="stable")
    seeds, bounds = seeds[order], np.searchsorted(of_seed[order], np.arange(sigma + 1))
    queues = Queues(sigma, memory, folder)
    large_parts: list[np.ndarray] = []

    def before(batch: np.ndarray, want_small: bool) -> tuple[np.ndarray, np.ndarray]:
        prev = batch[batch > 0] - 1
        prev = prev[small[prev] == want_small]
        return text[prev], prev

    for c in range(sigma):
        parts = []
        batch = queues.take(c, kind)
        while len(batch):
            parts.append(batch)
            symbols, prev = before(batch, False)
            queues.put(symbols, prev)
            batch = queues.take(c, kind)
        large_parts.append(np.concatenate(parts) if parts else seeds[:0])
        queues.put(*before(seeds[bounds[c] : bounds[c + 1]], False))
    out: list[np.ndarray] = []
    for c in range(sigma - 1, -1, -1):
        parts = []
        batch = queues.take(c, kind)
        if c == text[-1]:
            batch = np.concatenate([batch, np.array([len(text) - 1], dtype=kind)])
        while len(batch):
            parts.append(batch)
            symbols, prev = before(batch, True)
            queues.put(symbols, prev)
            batch = queues.take(c, kind)
        large = large_parts.pop()
        queues.put(*before(large[::-1], True))
        out.extend([*(p[::-1] for p in parts), large])
    return np.concatenate(out[::-1])



def doubled(ranks: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``ranks`` by their first ``depth`` symbols at least."""
    n = len(ranks)
    rank = np.unique(ranks, return_inverse=True)[1].astype(np.int64) + 1
    span = 1
    while True:
        follow = np.zeros(n, dtype=np.int64)
        follow[: max(n - span, 0)] = rank[span:]
        key = rank * (n + 2) + follow
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.r_[True, ranked[1:] != ranked[:-1]]
        rank[order] = np.cumsum(fresh)
        span *= 2
        if fresh.all() or span >= depth:
            return order


def suffix_array(text: np.ndarray, sigma: int, depth: int, memory: int = MEMORY) -> np.ndarray:
    """Suffixes of ``text`` in order; its last symbol is 0 and stands nowhere else."""
    with tempfile.TemporaryDirectory(prefix="traitsieve-queues-") as folder:
        return _sorted(text, sigma, depth, memory, folder)


def _sorted(text: np.ndarray, sigma: int, depth: int, memory: int, folder: str) -> np.ndarray:
    kind = np.int32 if len(text) < 2**31 - 1 else np.int64
    small = small_types(text)
    is_seed = np.zeros(len(text), dtype=bool)
    is_seed[1:] = small[1:] & ~small[:-1]
    seeds = np.flatnonzero(is_seed).astype(kind)
    if len(seeds) <= 1:
        return _scans(text, small, seeds, sigma, memory, folder)
    order = _scans(text, small, seeds, sigma, memory, folder)
    ranked = order[is_seed[order]]
    # a seed's stretch reaches to the next seed, whose symbol it includes
    ends = np.full(len(text), len(text) - 1, dtype=kind)
    ends[seeds[:-1]] = seeds[1:]
    sums = np.zeros(len(text) + 1, dtype=np.uint64)
    np.take(mix(np.arange(1, sigma + 1, dtype=np.uint64)), text, out=sums[1:])
    sums[1:] *= powers(BASE, len(text))
    np.cumsum(sums[1:], out=sums[1:])
    inverse = powers(pow(BASE, -1, 1 << 64), len(text))
    high = ends[ranked] + 1
    print_ = (sums[high] - sums[ranked]) * inverse[ranked]
    del sums, inverse, ends
    length = high - ranked
    fresh = np.r_[True, (print_[1:] != print_[:-1]) | (length[1:] != length[:-1])]
    names = np.empty(len(text), dtype=kind)
    names[ranked] = np.cumsum(fresh) - 1
    string = names[seeds]
    n_names = int(fresh.sum())
    if n_names == len(seeds):
        return _scans(text, small, ranked, sigma, memory, folder)
    if len(string) <= memory or n_names > ALPHABET_MOST:
        inner = doubled(string, depth)
    else:
        inner = _sorted(string, n_names, depth, memory, folder)
    return _scans(text, small, seeds[inner], sigma, memory, folder)
