"""Operators over texts beside their plain versions, with the awkward cases."""

import random
import re
import zlib

import numpy as np
import pytest
from helpers import (
    LICENSED,
    jaccard_components,
    without_repeated_bytes,
    without_repeated_words,
)
from pyspark.sql import functions as F

from traitsieve.llm import (
    byte_dedup,
    license_scan,
    mixing,
    ngram_join,
    packing,
    quality,
    substring_dedup,
    token_files,
)
from traitsieve.llm.induced_sort import suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, size long, key string"


def vocabulary(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def made_texts():
    rng = random.Random(4)
    words = vocabulary(300, 1)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = text(70), text(20)
    texts = [text(rng.randint(1, 150)) for _ in range(25)]
    texts += [texts[3], texts[3], texts[5].upper(), text(40) + " " + passage + "\n" + text(9), passage, passage + " end"]
    base = text(120).split(" ")
    for k in range(30):  # near copies, each with a word of its own
        copy = list(base)
        copy[(k * 7) % 120] = f"edit{k}"
        texts.append(" ".join(copy))
    texts += [line + " " + text(30) for _ in range(12)]
    texts += ["", None, " \n\t ", "one", "one two three four", "one two three four", "a" * 900, "ab" * 600]
    texts += [text(2500), "Released under the MIT License. CC BY-NC 4.0", "GNU  General\nPublic license"]
    return texts


@pytest.fixture(scope="module")
def rows():
    texts = made_texts()
    random.Random(2).shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    full = [(i, t, "en", f"src{(i or 0) % 4}" if i is None or i % 5 else None, len(t or ""), 1, 2, "x") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).persist()


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("group", [substring_dedup.GROUP, 1])
def test_word_windows(docs, rows, group):
    got = plain(substring_dedup.dedup_substrings(docs, group=group))
    assert got == sorted(without_repeated_words(rows), key=repr)


def test_word_windows_of_rows_without_or_with_one_id(spark, rows):
    some = rows[:30] + [(None, rows[0][1]), (None, "lone words " * 9), rows[1], rows[1], (rows[2][0], rows[3][1])]
    got = plain(substring_dedup.dedup_substrings(frame(spark, some)))
    assert got == sorted(without_repeated_words(some), key=repr)


def test_cut_texts_keep_their_columns_and_spacing(docs, rows):
    cut = {r["doc_id"]: r for r in substring_dedup.cut_texts(docs).collect()}
    want = {i: n for i, _, n, _ in without_repeated_words(rows)}
    for i, text in rows:
        assert cut[i]["lang"] == "en" and cut[i]["key"] == "x"
        if want[i] == 0:
            assert cut[i]["text"] == text


@pytest.mark.parametrize("group, cut, length", [(byte_dedup.GROUP, 32, 400), (1, 7, 400), (2, 32, 100)])
def test_byte_strings(docs, rows, group, cut, length):
    got = plain(byte_dedup.dedup_bytes(docs, length, group=group, cut=cut).drop("kept"))
    assert got == sorted(without_repeated_bytes(rows, length), key=repr)


def test_frequent_strings_meet_without_their_texts(spark, monkeypatch):
    rng = random.Random(8)
    made = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = made(430)
    some = [(i, made(rng.randint(0, 300)) + passage + made(rng.randint(0, 300))) for i in range(120)]
    monkeypatch.setattr(byte_dedup, "STRINGS_AT_ONCE", 5_000)
    docs = frame(spark, some)
    got = plain(byte_dedup.dedup_bytes(docs, group=10).drop("kept"))
    assert got == sorted(without_repeated_bytes(some), key=repr)
    raw = [t.encode() for _, t in some]
    box, parts = byte_dedup.Outbox(4, byte_dedup.STRING), []
    for i, b in enumerate(raw):  # one string in all texts: one record goes to its bucket
        at = b.index(passage.encode()) + np.arange(2)
        parts.append((np.array([7, 9], np.uint64), np.array([1, 0], np.uint16), np.full(2, i), np.full(2, i), at))
    byte_dedup._compared(box, parts)
    records = np.concatenate([r for _, r in box.parts])
    assert (records["mark"] == 1).sum() == 2 and (records["starts"][records["mark"] == 2] == 2).sum() == len(raw) - 1
    assert records.dtype.itemsize < 64


def test_byte_strings_of_repeated_rows(spark, rows):
    some = rows[:20] + [rows[1], (rows[2][0], rows[3][1]), (None, rows[4][1]), (None, rows[4][1])]
    got = plain(byte_dedup.dedup_bytes(frame(spark, some)).drop("kept"))
    assert got == sorted(without_repeated_bytes(some), key=repr)


def test_suffix_array_spills_and_recurses():
    rng = np.random.default_rng(0)
    for _ in range(60):
        text = np.r_[rng.integers(1, 4, rng.integers(1, 60)), 0].astype(np.int32)
        want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        for memory in (1 << 20, 3):
            assert suffix_array(text, 4, 1 << 20, memory).tolist() == want


@pytest.mark.parametrize("small, block", [(ngram_join.SMALL, ngram_join.GROUP_SETS), (1, 8)])
def test_jaccard_links(docs, rows, monkeypatch, small, block):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "GROUP_SETS", block)
    assert plain(ngram_join.jaccard_components(docs)) == sorted(jaccard_components(rows), key=repr)


def test_jaccard_of_rows_without_or_with_one_id(spark):
    text = "a b c d e f g h i j k"
    some = [(1, text), (2, text), (2, text), (None, text), (3, None), (4, "x"), (5, "x"), (6, "")]
    got = plain(ngram_join.jaccard_components(frame(spark, some)))
    assert got == sorted([(1, 7, 1), (2, 7, 1), (2, 7, 1), (None, 7, None), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 0, 6)], key=repr)


def test_least_needed_is_a_lower_bound():
    for s in range(4, 1500, 7):
        partners = np.arange(-(-8 * s // 10), s * 10 // 8 + 1)
        assert ngram_join._common_needed(np.full(len(partners), s), partners).min() >= ngram_join.least_needed(s)


def test_licenses(docs, rows):
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    for i, text in rows:
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        words = [w.decode() for w in LICENSED.findall(raw)]
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            found = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(sorted(labels)))
        assert (r["first_word"], r["last_word"]) == (min(places, default=None), max(places, default=None))
        assert labels <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_license_spans_bear_a_changed_word(spark):
    words = license_scan.TEMPLATES[6][1].split()
    changed = " ".join(["so", *words[:9], "indeed", *words[9:], "x"])
    got = license_scan.scan_licenses(frame(spark, [(1, changed), (1, changed), (2, " ".join(words[:9]))])).collect()
    assert sorted((r["doc_id"], r["labels"]) for r in got) == [(1, "mit-notice"), (1, "mit-notice"), (2, "")]


def test_token_files(docs, rows, spark, tmp_path):
    from tokenizers import Tokenizer

    path = token_files.public_vocabulary()
    plain_tokenizer = Tokenizer.from_file(path)
    texts = [*rows, (None, "no id, Σας ΟΔΟΣ İx"), (1, "It's  the''s <|endoftext|>\x1cx\xa0y"), (1, "twice")]
    files = token_files.write_tokens(frame(spark, texts), path, str(tmp_path / "tokens"))
    got = sorted(token_files.read_tokens(files).collect(), key=lambda r: r["start"])
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for (i, text), r in zip(order, got, strict=True):
        ids = np.array([*plain_tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    one = token_files.TokenFile(files.orderBy(F.desc("n_ids")).first()["file"])
    whole = one.ids(0, one.total)
    assert (one.ids(5, one.total - 3) == whole[5 : one.total - 3]).all() and one.bits == 16


@pytest.mark.parametrize("bits", [1, 3, 13, 16, 17])
def test_packed_bits(bits):
    ids = np.random.default_rng(0).integers(0, 1 << bits, 1000)
    assert (token_files.unpack_bits(token_files.pack_bits(ids, bits), bits, 1000) == ids).all()


def test_packing_breaks_no_rule(docs, rows):
    pieces = [r.asDict() for r in packing.pack(docs, capacity=200).collect()]
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows}
    clusters = {i: (t or "").strip(" ").lower() for i, t in rows}
    assert {i: sum(p["n_words"] for p in pieces if p["doc_id"] == i) for i in words} == words
    bins = {}
    for p in pieces:
        bins.setdefault(p["bin_id"], []).append(p)
    for held in bins.values():
        held.sort(key=lambda p: p["bin_offset"])
        ends = [p["bin_offset"] + p["n_words"] for p in held]
        assert ends[-1] <= 200 and all(p["bin_offset"] >= e for p, e in zip(held[1:], ends))
        for key in (lambda p: p["source"], lambda p: clusters[p["doc_id"]] or None):
            named = [key(p) for p in held if key(p) is not None]
            assert len(named) == len(set(named))


def test_best_fit_takes_the_tightest_bin_without_conflict():
    bins = packing.Bins(10)
    assert [bins.place(7, 1, 0), bins.place(5, 2, 0), bins.place(3, 1, 0)] == [(0, 0), (1, 0), (1, 5)]
    assert bins.place(3, 4, 0) == (0, 7) and bins.place(2, 4, 0) == (1, 8) and bins.place(2, 0, 0) == (2, 0)


def test_quality_finds_shouting(spark):
    rng = random.Random(0)
    words = vocabulary(200, 3)
    texts, labels = [], []
    for i in range(240):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(30, 200)))
        labels.append((i, i % 2, 0))
        texts.append((i, text if i % 2 else text.upper() + "!!"))
    texts += [(1000, None), (1001, ""), (1001, "same id"), (None, "no id")]
    got = quality.score_documents(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = got.collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and quality.crc_fold(r["doc_id"]) == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 240]
    assert len(held) > 20 and all(r["predicted"] == r["doc_id"] % 2 for r in held)


def test_gradient_of_the_attention_model_lowers_the_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, quality.WIDTH)).astype(np.float32)
    doc = np.repeat(np.arange(200), 3)
    y = (np.arange(200) % 2).astype(np.float32)
    x[doc % 2 == 1, 0] += 3 * (rng.random((doc % 2 == 1).sum()) < 0.6)
    score = quality.fit(x, doc, y).scores(x, doc, 200)
    assert score[y == 1].mean() > 0.9 > 0.1 > score[y == 0].mean()


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert substring_dedup.dedup_substrings(none).count() == 0
    assert substring_dedup.cut_texts(none).count() == 0
    assert byte_dedup.dedup_bytes(none).count() == 0
    assert license_scan.scan_licenses(none).count() == 0
    assert ngram_join.jaccard_components(none).count() == 0
    assert packing.pack(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert quality.score_documents(none, labels).count() == 0
    assert quality.score_documents(frame(spark, [(1, "x")]), labels).first()["score"] == 0.5
    assert token_files.token_files(none, token_files.public_vocabulary()).count() == 0
