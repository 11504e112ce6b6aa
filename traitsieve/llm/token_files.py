"""Token ids in files of fixed-width bit packing, with random access to blocks.

A table of texts becomes one file per range of doc_id.  Ids take the fewest bits that hold
the vocabulary, lowest bit first, in blocks of ``BLOCK`` ids that begin at whole bytes:

    magic "TSBITS1\\n"
    blocks of packed ids
    block offsets      uint64 each, from the file's start; one more for the end
    documents          int64 doc_id, uint8 "has an id", int64 ids before it in the file
    trailer            uint64 x 6: bits, block, ids, blocks, documents, start of block offsets

Any id range is read with one seek: its blocks' offsets are known, and a block unpacks as
one array operation.  ``TokenFile`` reads; ``write_tokens`` and ``read_tokens`` are the Spark side.

Texts are encoded with the tokenizers library.  Encoding does not look across ASCII white
space, so a text of common letters is encoded word by word, from a cache; the cache's entries
come from the library's model.  Other texts are encoded whole.

Files are written to the folder under a name of their own and then renamed, so a repeated task
leaves the same file.  The folder is one that all executors reach, as a local or mounted path
or any store pyarrow opens.

Defined results: null texts are empty and have the end id only; rows without doc_id come first;
rows that share a doc_id follow each other in the order of their texts.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traitsieve.functions.session import scratch_path
from traitsieve.llm.packets import bucket_count
from traitsieve.llm.tables import written

MAGIC = b"TSBITS1\n"
BLOCK = 4_096
END_ID = 1
CACHE_MOST = 600_000
#: Documents that a reader hands out together.
READ_TOGETHER = 2_000

# Characters whose normal form, lower case and class are the same in every library here, and
# whose lower case is among them too; texts with others go to the tokenizer whole.
SIMPLE = re.compile("[ -~\\t-\\rÀ-įı-ſ]*")
LETTERS = "a-zÀ-ÖØ-öø-ſ"
# The tokenizer's own pattern, for those characters; runs of letters come first, since
# only the contractions and the last class begin with the same character.
PRETOKEN = re.compile(f"[{LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\s0-9{LETTERS}]+")


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for
    themselves, the rest for 256 and up in their order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as little-endian bytes of ``width`` each."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.model = self.tokenizer.model
        self.kind, self.code = ("<u2", "H") if self.size <= 1 << 16 else ("<u4", "I")
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.special = [t["content"] for t in said.get("added_tokens", [])]
        kinds = [n["type"] for n in (said.get("normalizer") or {}).get("normalizers", [])]
        split = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
        known = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        self.by_word = (
            kinds == ["NFC", "Replace", "Lowercase"]
            and [p["type"] for p in split] == ["Split", "ByteLevel"]
            and split[0]["pattern"] == {"Regex": known}
        )
        letters = byte_letters()
        self.letters = str.maketrans({chr(b): c for b, c in letters.items()})
        self.words = _Words(self)

    def plain(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.kind).tobytes()

    def part(self, text: str) -> bytes:
        """Ids of one piece of the tokenizer's pattern, from the library's model."""
        spelled = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def encode(self, text: str) -> bytes:
        if self.by_word and SIMPLE.fullmatch(text) and not any(s in text for s in self.special):
            if len(self.words) > CACHE_MOST:
                self.words.clear()
            return b"".join(map(self.words.__getitem__, text.split()))
        return self.plain(self.tokenizer.encode(text, add_special_tokens=False).ids)


class _Words(dict):
    """Ids by word; a word's pieces are words too, since each is its own only piece."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        low = word.lower()
        parts = [low] if low.isalpha() else PRETOKEN.findall(low)
        if parts == [word]:
            found = self.encoder.part(word)
        else:
            found = b"".join(map(self.__getitem__, parts))
        self[word] = found
        return found


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    places = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(places.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    places = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return (places.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    store, inner = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return store, inner


class Writer:
    """Writes one file; ``add`` takes a document's ids."""

    def __init__(self, stream, bits: int, block: int = BLOCK) -> None:
        self.stream, self.bits, self.block = stream, bits, block
        self.offsets, self.at, self.total = [len(MAGIC)], len(MAGIC), 0
        self.pending: list[np.ndarray] = []
        self.held = 0
        self.documents: list[tuple[int, bool, int]] = []
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append((doc_id or 0, doc_id is not None, self.total))
        self.total += len(ids)
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= 64 * self.block:
            self._blocks(self.held // self.block * self.block)

    def _blocks(self, n: int) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        for i in range(0, n, self.block):
            data = pack_bits(ids[i : min(i + self.block, n)], self.bits)
            self.stream.write(data)
            self.at += len(data)
            self.offsets.append(self.at)
        self.pending, self.held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._blocks(self.held)
        docs = np.array(self.documents, dtype=[("id", "<i8"), ("has", "u1"), ("first", "<i8")])
        start = self.at
        self.stream.write(np.array(self.offsets, dtype="<u8").tobytes())
        for field in docs.dtype.names:
            self.stream.write(np.ascontiguousarray(docs[field]).tobytes())
        self.stream.write(struct.pack("<6Q", self.bits, self.block, self.total, len(self.offsets) - 1, len(docs), start))
        self.stream.close()


class TokenFile:
    """Random access to one file; ids are read block by block."""

    def __init__(self, path: str) -> None:
        store, inner = opened(path)
        self.stream = store.open_input_file(inner)
        size = self.stream.size()
        self.bits, self.block, self.total, blocks, docs, start = struct.unpack("<6Q", self._read(size - 48, 48))
        if self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        self.offsets = np.frombuffer(self._read(start, 8 * (blocks + 1)), "<u8")
        at = start + 8 * (blocks + 1)
        self.doc_ids = np.frombuffer(self._read(at, 8 * docs), "<i8")
        self.has_id = np.frombuffer(self._read(at + 8 * docs, docs), "u1").astype(bool)
        self.firsts = np.append(np.frombuffer(self._read(at + 9 * docs, 8 * docs), "<i8"), self.total)

    def _read(self, at: int, n: int) -> bytes:
        return self.stream.read_at(n, at)

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids ``first`` to ``end`` of the file."""
        if end <= first:
            return np.zeros(0, np.uint32)
        low, high = first // self.block, -(-end // self.block)
        data = self._read(int(self.offsets[low]), int(self.offsets[high] - self.offsets[low]))
        base = int(self.offsets[low])
        out = [
            unpack_bits(
                data[int(self.offsets[b]) - base : int(self.offsets[b + 1]) - base], self.bits,
                min(self.block, self.total - b * self.block),
            )
            for b in range(low, high)
        ]
        return np.concatenate(out)[first - low * self.block : end - low * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.firsts[k]), int(self.firsts[k + 1]))

    def close(self) -> None:
        self.stream.close()


def _write(folder: str, vocabulary: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = store = None
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if writer is None:
                    enc = encoder(vocabulary)
                    bits = max(1, (max(enc.size, END_ID + 1) - 1).bit_length())
                    store, inner = opened(folder)
                    store.create_dir(inner, recursive=True)
                    temporary = f"{inner}/_{uuid.uuid4().hex}"
                    writer = Writer(store.open_output_stream(temporary), bits, block)
                    lead = doc_id, text.as_py()
                ids = np.frombuffer(enc.encode(text.as_py() or ""), dtype=enc.kind).astype(np.uint32)
                writer.add(doc_id, np.append(ids, np.uint32(END_ID)))
                last = doc_id
        if writer is not None:
            writer.close()
            # ranges of ids do not overlap, so their first row names the file
            name = f"{'none' if lead[0] is None else lead[0]}-{zlib.crc32((lead[1] or '').encode()):08x}.bits"
            store.move(temporary, f"{inner}/{name}")
            yield pa.RecordBatch.from_pydict(
                {
                    "file": pa.array([f"{folder}/{name}"]),
                    "first_id": pa.array([lead[0]], pa.int64()),
                    "last_id": pa.array([last], pa.int64()),
                    "n_docs": pa.array([len(writer.documents)], pa.int64()),
                    "n_ids": pa.array([writer.total], pa.int64()),
                }
            )

    return run


FILES = "file string, first_id long, last_id long, n_docs long, n_ids long"


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, block: int = BLOCK) -> DataFrame:
    """Encode and write; the list of files, with ``start``: ids in the files before."""
    n = bucket_count(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    files = written(dealt.mapInArrow(_write(folder, vocabulary, block), FILES), "token-files")
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))  # one row per file


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
            file = TokenFile(path)
            for low in range(0, len(file.doc_ids), READ_TOGETHER):
                high = min(low + READ_TOGETHER, len(file.doc_ids))
                crcs = [zlib.crc32(file.document(k).astype("<u4").tobytes()) for k in range(low, high)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(file.doc_ids[low:high], mask=~file.has_id[low:high]),
                        "start": pa.array(file.firsts[low:high] + start),
                        "n_tokens": pa.array(file.firsts[low + 1 : high + 1] - file.firsts[low:high]),
                        "ids_crc32": pa.array(crcs, pa.int64()),
                    }
                )
            file.close()


def read_tokens(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    n = bucket_count(files.sparkSession)
    return files.select("file", "start").repartition(n, "file").mapInArrow(
        _read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_files(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Write ``docs`` to token files in ``folder`` (one in the shared folder, unless given) and read them back."""
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, vocabulary, folder))


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def session_vocabulary(spark: SparkSession) -> str:
    """The vocabulary file a session names in ``spark.traitsieve.vocabulary``, or the public one."""
    return spark.conf.get("spark.traitsieve.vocabulary", None) or public_vocabulary()
