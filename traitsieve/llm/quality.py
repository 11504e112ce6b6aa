"""Quality classifier: attention-based multiple-instance learning over passages.

A text is a bag of passages of ``PASSAGE`` words.  Each passage is described by counts of
its bytes and of its byte pairs' classes and by word statistics, encoded by a learned layer,
and weighted by gated attention ``w . (tanh(V h) * sigmoid(U h))``, whose softmax over the
text's passages makes the text's representation.  Encoder, attention and the final logistic
unit learn together from document labels.

The fit takes a bounded sample: labelled texts in the order of a hash of their ids until
``SAMPLE_DOCS`` texts (``SAMPLE_PASSAGES`` passages at most) are together, less those
held out.  All texts are scored, whole, with passages in bounded blocks: the softmax is
summed up over the blocks of a long text.

Defined results: null and empty texts are one passage without words and get a score like
any other; without labelled rows, or with labels of one kind, every score is the share
of label 1 (0.5 with none); labels other than 0 and 1 and repeated labels of a
document that disagree are not learned from; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from traitsieve.llm import kernels as K

PASSAGE = 64
HIDDEN = 24
GATE = 12
EPOCHS = 60
RATE = 0.01
SAMPLE_DOCS = 4_000
SAMPLE_PASSAGES = 60_000
THRESHOLD = 0.3
#: One document in this many is held out of learning.
FOLDS = 5
PAIRS = 16 * 16
WIDTH = 256 + PAIRS + 6

#: Sixteen classes of bytes, for pairs of neighbours.
CLASSES = np.full(256, 15, dtype=np.int64)
for _value, _members in enumerate(
    (b" ", b"\n", b"aeiou", b"bcdfghjklm", b"npqrstvwxyz", b"AEIOU", b"BCDFGHJKLM", b"NPQRSTVWXYZ", b"0123456789",
     b".,;:", b"!?", b"'\"()-", b"|/\\_", b"*#$%&@+=<>^~", bytes(range(0x80, 0xC0)))
):
    CLASSES[list(_members)] = _value


def passages(texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Descriptions of all passages, and the text of each; a text without words has one."""
    words = K.Words(texts, K.SPACES)
    counts = np.maximum(-(-words.counts // PASSAGE), 1)
    base = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(texts)), counts)
    total = int(counts.sum())
    of_text = words.text_of()
    inner = np.arange(len(of_text)) - words.bounds[of_text]
    of_word = base[of_text] + inner // PASSAGE
    heads = np.flatnonzero(inner % PASSAGE == 0)
    # a byte belongs to the passage of the last word that began before it
    start = np.where(np.arange(total) == base[doc], texts.offsets[doc], 0)
    start[of_word[heads]] = np.where(inner[heads] == 0, texts.offsets[of_text[heads]], words.starts[heads])
    ends = np.r_[start[1:], len(texts.data)]
    of_byte = np.repeat(np.arange(total), ends - start)
    x = np.empty((total, WIDTH), dtype=np.float32)
    length = np.maximum(ends - start, 1)[:, None]
    x[:, :256] = np.bincount(of_byte * 256 + texts.data, minlength=total * 256).reshape(total, 256) / length
    kinds = CLASSES[texts.data]
    pairs = (of_byte * PAIRS)[:-1] + kinds[:-1] * 16 + kinds[1:] if len(kinds) else np.zeros(0, np.int64)
    x[:, 256 : 256 + PAIRS] = np.bincount(pairs, minlength=total * PAIRS).reshape(total, PAIRS) / length
    x[:, :-6] = np.sqrt(x[:, :-6])
    n = np.maximum(np.bincount(of_word, minlength=total), 1)
    hashes = K.word_hashes(texts, words, fold=True)
    order = np.lexsort((hashes, of_word))
    ranked, place = hashes[order], of_word[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (ranked[1:] != ranked[:-1]) | (place[1:] != place[:-1])
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
    size = (words.ends - words.starts).astype(np.float64)
    mean = np.bincount(of_word, weights=size, minlength=total) / n
    x[:, -6] = np.bincount(place[fresh], minlength=total) / n
    x[:, -5] = np.bincount(of_word[same], minlength=total) / n
    x[:, -4] = mean / 10
    x[:, -3] = np.sqrt(np.maximum(np.bincount(of_word, weights=size**2, minlength=total) / n - mean**2, 0)) / 10
    x[:, -2] = np.log1p(n) / 4
    x[:, -1] = np.bincount(of_word, minlength=total) == 0
    return x, doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Standardiser, encoder, gated attention and logistic unit."""

    def __init__(self, share: float, weights: dict[str, np.ndarray] | None = None) -> None:
        self.share, self.weights = share, weights

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights
        h = np.tanh(((x - w["mean"]) / w["scale"]) @ w["E"] + w["e"])
        gate = np.tanh(h @ w["V"]) * _sigmoid(h @ w["U"])
        return h, gate @ w["w"]

    def scores(self, x: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        if self.weights is None:
            return np.full(n, self.share)
        total, mass = np.zeros((n, HIDDEN)), np.zeros(n)
        for i in range(0, len(x), 8192):
            h, a = self.hidden(x[i : i + 8192])
            a = np.exp(np.clip(a, -30, 30))
            d = doc[i : i + 8192]
            np.add.at(mass, d, a)
            np.add.at(total, d, h * a[:, None])
        return _sigmoid(total / mass[:, None] @ self.weights["c"] + self.weights["b"])


def fit(x: np.ndarray, doc: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Adam over whole bags; ``doc`` is sorted and counts from 0."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        return Model(share)
    rng = np.random.default_rng(seed)
    w = {
        "E": rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), "e": np.zeros(HIDDEN),
        "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)),
        "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "b": np.array(np.log(share / (1 - share))),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.02
    x = ((x - mean) / scale).astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    begins = np.searchsorted(doc, np.arange(len(y) + 1))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 256):
            bags = order[i : i + 256]
            rows = np.concatenate([np.arange(begins[d], begins[d + 1]) for d in bags])
            of = np.repeat(np.arange(len(bags)), begins[bags + 1] - begins[bags])
            at = np.r_[0, np.flatnonzero(np.diff(of)) + 1]
            xb = x[rows]
            h = np.tanh(xb @ w["E"] + w["e"])
            t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
            a = (t * s) @ w["w"]
            a = np.exp(a - np.maximum.reduceat(a, at)[of])
            a = (a / np.add.reduceat(a, at)[of])[:, None]
            z = np.add.reduceat(h * a, at, axis=0)
            out = (_sigmoid(z @ w["c"] + w["b"]) - y[bags]) / len(bags)
            dz = out[:, None] * w["c"]
            da = (h * dz[of]).sum(axis=1, keepdims=True)
            da = a * (da - np.add.reduceat(a * da, at, axis=0)[of])
            dt, ds = da * w["w"] * s * (1 - t * t), da * w["w"] * t * s * (1 - s)
            dh = (dz[of] * a + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
            grads = {
                "E": xb.T @ dh + 1e-4 * w["E"], "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds,
                "w": ((t * s) * da).sum(axis=0), "c": z.T @ out, "b": out.sum(),
            }
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(share, {**w, "mean": mean, "scale": scale})


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for texts in K.slices(batch.column("text")):
            x, doc = passages(texts)
            bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
            out.extend(x[a:b].astype("<f2").tobytes() for a, b in zip(bounds[:-1], bounds[1:]))
        yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "x": pa.array(out, pa.binary())})


def held_out(doc_id: str = "doc_id") -> "F.Column":
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on the sample; held-out documents are never in it."""
    known = (
        labels.where(~held_out() & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(label).alias("y"), F.max(label).alias("top"))
        .where("y = top")
        .select("doc_id", "y")
    )
    words = F.greatest(F.ceil(F.length(F.coalesce("text", F.lit(""))) / (4 * PASSAGE)), F.lit(1))
    chosen = (
        docs.select("doc_id", words.alias("size"))
        .join(known, "doc_id")
        .groupBy("doc_id", "y")
        .agg(F.max("size").alias("size"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE_DOCS)
        .collect()
    )
    kept, room = [], SAMPLE_PASSAGES
    for row in chosen:
        if row["size"] <= room:
            kept.append((row["doc_id"], int(row["y"])))
            room -= row["size"]
    if not kept:
        return Model(0.5)
    spark = docs.sparkSession
    sample = F.broadcast(spark.createDataFrame(kept, "doc_id long, y int"))
    rows = (
        docs.select("doc_id", "text").join(sample, "doc_id").dropDuplicates(["doc_id"])
        .mapInArrow(_describe_with_id, "doc_id long, y int, x binary").collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    bags = [np.frombuffer(r["x"], "<f2").reshape(-1, WIDTH) for r in rows]
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    return fit(np.concatenate(bags).astype(np.float32), doc, np.array([r["y"] for r in rows], dtype=np.float32))


def _describe_with_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for out in _describe([batch]):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "y": out.column("y"), "x": out.column("x")})


def _score(model) -> "callable":
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for texts in K.slices(batch.column("text"), 500_000):
                x, doc = passages(texts)
                scores.append(model.value.scores(x, doc, len(texts)))
            rest = [batch.column(i) for i in range(batch.num_columns)]
            names = list(batch.schema.names)
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.concatenate(scores), pa.float64())], [*names, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with one more column ``score``; the table has a column ``text`` and none of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    return docs.mapInArrow(_score(shared), schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def crc_fold(doc_id: int) -> int:
    """The fold of a document, as plain Python has it."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS
