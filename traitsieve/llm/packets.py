"""Rows of packed arrays that go to numbered buckets.

Millions of small records (a hash and a document) cost less as a few long arrays
than as rows.  A map task collects records in an ``Outbox``; it hands out one row
per bucket and flush, whose binary columns hold the records' fields.  Buckets are
shuffle partitions: ``to_buckets`` sends a row to the partition of its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A map task holds at most about this much before it hands rows out.
FLUSH_BYTES = 24_000_000
#: Stands for a missing doc_id while documents are compared: after all others.
NO_ID = 2**63 - 1


def bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def to_buckets(packed: DataFrame, n: int) -> DataFrame:
    return packed.repartitionById(n, packed["bucket"])


class Outbox:
    """Records by bucket; ``names`` and their types are the packed columns."""

    def __init__(self, n: int, fields: dict[str, np.dtype | str | tuple]) -> None:
        self.n, self.dtype = n, np.dtype([(k, *v) if isinstance(v, tuple) else (k, v) for k, v in fields.items()])
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, buckets: np.ndarray, **fields: np.ndarray) -> None:
        if not len(buckets):
            return
        records = np.empty(len(buckets), dtype=self.dtype)
        for k, v in fields.items():
            records[k] = v
        self.parts.append((buckets, records))
        self.held += records.nbytes

    def full(self) -> bool:
        return self.held >= FLUSH_BYTES

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        buckets = np.concatenate([b for b, _ in self.parts])
        records = np.concatenate([r for _, r in self.parts])
        self.parts, self.held = [], 0
        order = np.argsort(buckets.astype(np.uint32), kind="stable")
        buckets, records = buckets[order], records[order]
        at = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
        ends = np.r_[at[1:], len(buckets)]
        columns = {"bucket": pa.array(buckets[at].astype(np.int32))}
        for name in self.dtype.names:
            field = np.ascontiguousarray(records[name])
            columns[name] = pa.array([field[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())
        yield pa.RecordBatch.from_pydict(columns)

    def schema(self) -> str:
        return "bucket int, " + ", ".join(f"{k} binary" for k in self.dtype.names)


def unpack(batches: Iterator[pa.RecordBatch], fields: dict[str, np.dtype | str | tuple]) -> dict[str, np.ndarray]:
    """All records of a bucket, field by field."""
    parts: dict[str, list[bytes]] = {k: [] for k in fields}
    for batch in batches:
        for k in fields:
            parts[k].extend(batch.column(k).to_pylist())
    out = {}
    for k, v in fields.items():
        kind, shape = (v[0], v[1]) if isinstance(v, tuple) else (v, None)
        flat = np.frombuffer(b"".join(parts[k]), dtype=kind)
        out[k] = flat.reshape(-1, *shape) if shape else flat
    return out


def per_document(docs: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """One row per document with its values as packed bytes."""
    order = np.argsort(docs, kind="stable")
    docs, values = docs[order], values[order]
    at = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.zeros(0, np.int64)
    ends = np.r_[at[1:], len(docs)].astype(np.int64)
    return pa.RecordBatch.from_pydict(
        {
            "rid": pa.array(docs[at].astype(np.int64)),
            "packed": pa.array([values[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
        }
    )


def joined(blobs: list[bytes] | None, dtype: str = "<u8") -> np.ndarray:
    return np.frombuffer(b"".join(blobs or []), dtype=dtype)
