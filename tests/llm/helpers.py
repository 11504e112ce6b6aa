"""Plain versions of the operators, over rows in Python."""

import hashlib
import re
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LICENSED = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def without_repeated_words(rows, window=13):
    words = [(i, SPACED.findall(t or "")) for i, t in rows]
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, ws in words:
        for s in range(len(ws) - window + 1):
            key = tuple(ws[s : s + window])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, ws in words:
        gone = set()
        for s in range(len(ws) - window + 1):
            if first[tuple(ws[s : s + window])] < order(i):
                gone.update(range(s, s + window))
        kept = [w for k, w in enumerate(ws) if k not in gone]
        out.append((i, len(ws), len(gone), sha(" ".join(kept).encode())))
    return out


def without_repeated_bytes(rows, length=400):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + length] for _, b in raw for s in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = set()
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone.update(range(s, s + length))
        spans = sum(1 for k in gone if k - 1 not in gone)
        out.append((i, len(b), len(gone), spans, sha(bytes(c for k, c in enumerate(b) if k not in gone))))
    return out


def shingles(text, k=5):
    words = SPACED.findall(lower(text))
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def groups(nodes, linked):
    """Smallest node reachable over the pairs of ``linked``."""
    label = {n: n for n in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def jaccard_components(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    linked = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    label = groups(ids, linked)
    return [(i, len(sets[i]), label[i]) for i in ids]
