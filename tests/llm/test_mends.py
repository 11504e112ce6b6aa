"""Token ids letter by letter, remaining texts of the byte query, and large groups with outside sets."""

import random

import numpy as np
import pytest
from helpers import groups, jaccard_components
from pyspark.sql import functions as F

from traitsieve.llm import ngram_join, queries, token_files


@pytest.fixture(scope="module")
def encoder():
    return token_files.Encoder(token_files.public_vocabulary())


def by_library(encoder, text):
    return encoder.plain(encoder.tokenizer.encode(text, add_special_tokens=False).ids)


def test_every_simple_letter_inside_a_word(encoder):
    simple = [chr(c) for c in range(0x250) if token_files.SIMPLE.fullmatch(chr(c))]
    assert len(simple) > 250 and not token_files.SIMPLE.fullmatch("Ɓ")
    for letter in simple:
        for text in (f"ab{letter}cd", letter, f"{letter}{letter.upper()} x{letter}", f"'{letter}s 1{letter}2"):
            assert encoder.encode(text) == by_library(encoder, text), repr(text)


def test_words_and_pieces_share_a_cache(monkeypatch):
    """A piece is kept and asked for once, and a word of letters needs no pattern."""
    enc = token_files.Encoder(token_files.public_vocabulary())
    cut, asked, pattern, part = [], [], token_files.PRETOKEN, enc.part

    class Counted:
        findall = staticmethod(lambda text: cut.append(text) or pattern.findall(text))

    monkeypatch.setattr(token_files, "PRETOKEN", Counted)
    monkeypatch.setattr(enc, "part", lambda text: asked.append(text) or part(text))
    text = "Straße straße STRAßE. don't strasse strasse."
    assert enc.encode(text) == by_library(enc, text)
    assert sorted(asked) == sorted({*asked}) == sorted(["straße", ".", "don", "'t", "strasse"])
    assert not any(w.isalpha() for w in cut)
    assert {*enc.words} == {*text.split(), *asked} and not hasattr(enc, "pretokens")


@pytest.mark.parametrize("low, high", [(0x20, 0x7F), (0xC0, 0x180), (0x180, 0x250), (0x20, 0x500)])
def test_random_strings(encoder, low, high):
    rng = random.Random(low + high)
    for _ in range(1_500):
        text = "".join(chr(rng.choice([rng.randrange(low, high), 32, rng.randrange(97, 123)])) for _ in range(rng.randint(1, 24)))
        assert encoder.encode(text) == by_library(encoder, text), repr(text)


@pytest.mark.parametrize("text", ["Ʒȡ", "DAƁO", "Ɔkyeame AƆ", "ǅ Ǆ ǆ", "ŉ ſ K Å", "İstanbul ı I", ""])
def test_known_strings(encoder, text):
    assert encoder.encode(text) == by_library(encoder, text)


def test_byte_query_returns_the_remaining_text(spark, tmp_path):
    passage = "é" * 210  # 420 bytes, an odd start leaves half a letter
    rows = [(1, "xa" + passage + " end", "en", "s", 1), (2, "yb" + passage + "z", "en", "s", 1), (3, "short é", "en", "s", 1), (4, None, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    got = {r["doc_id"]: r for r in queries.op4_byte_dedup(spark, str(tmp_path)).collect()}
    assert (got[1]["text"], got[2]["text"], got[3]["text"], got[4]["text"]) == ("xa end", "ybz", "short é", "")


def near_copies(n, outside, seed):
    """A group around one text; some of its texts link only with each other."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(n):
        own = list(words)
        own[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own)))
    for i in range(outside):
        own = list(words)
        for k in range(0, 18, 6):
            own[k] = f"y{k}"
        own[60 + 6 * (i % 5)] = f"z{i}"
        rows.append((n + i, " ".join(own)))
    return rows


def test_groups_with_outside_sets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_SETS", 12)
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    rows = near_copies(90, 25, 1)
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect())
    assert got == jaccard_components(rows)


def test_linked_sets_are_copied_to_outside_blocks_only(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_SETS", 20)
    sent = []
    whole = ngram_join._group_links
    rows = [(0, i, 8, b"\xff", b"", i < 200) for i in range(203)]
    diff = spark.createDataFrame(rows, ngram_join.DIFFERENCES)
    seen = spark.sparkContext.accumulator(0)

    def counted(frame):
        seen.add(len(frame))
        return whole(frame)

    monkeypatch.setattr(ngram_join, "_group_links", counted)
    found = ngram_join._in_groups(diff).collect()
    assert seen.value <= 200 + 3 * 21 and not sent
    label = groups(range(203), [(r["a"], r["b"]) for r in found])
    assert set(label.values()) == {0}
