"""License scan by diagonal voting.

All rolling ``GRAM``-word hashes of a text are joined with the template positions that
have them.  A hit at word p of the text and word q of the template votes for the diagonal
p - q of the text and template.  Votes are gathered by diagonal, diagonals at most ``DRIFT``
apart (a word more or less in the text) are merged, and a merged span counts if the
template words under its hits are ``COVER`` of the template and its length is near the
template's.  The label of the template is then the text's.

Base phrases are counted beside: every place where a phrase's words stand one after
the other gives the phrase's label.

The join is a Spark join with the template table, which is fixed and has a few hundred
rows, so it is broadcast.  A text's votes are those of its hits only; the words of a line that
every text has vote within their own text.

Defined results: null and empty texts have no words, no labels and score 0; the score is 1 with a
base phrase, else the best coverage of a merged span (0 to 1); repeated rows each get
the result; rows of one doc_id with different texts are scanned on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitsieve.llm import kernels as K
from traitsieve.llm.packets import NO_ID
from traitsieve.llm.tables import doc_id_of

GRAM = 3
DRIFT = 2
COVER = 0.8

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices in common use, and the labels they give.
TEMPLATES = [
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license as published by the free software foundation"),
    ("lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu "
     "lesser general public license as published by the free software foundation"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files to deal in the software without restriction"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
]


def _hashes(text: str) -> np.ndarray:
    texts = next(K.slices(pa.array([text])))
    return K.word_hashes(texts, K.Words(texts, K.NOT_WORD), fold=False)


def template_positions(templates: list[tuple[str, str]], k: int) -> list[tuple[int, int, int, int, str]]:
    """(hash, template, position, template words, label) of every template gram."""
    rows = []
    for t, (label, text) in enumerate(templates):
        words = _hashes(text)
        grams = K.gram_hashes(words, k).astype(np.int64).tolist()
        rows.extend((g, t, q, len(words), label) for q, g in enumerate(grams))
    return rows


BASE = "rid long, digest long, n_words long, n_base long, first_word long, last_word long, base array<string>"


def _base(phrases: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [(label, _hashes(p)) for p, label in phrases.items()]
        for batch in batches:
            n_words, n_base, first, last, labels = [], [], [], [], []
            for texts in map(K.lowered, K.slices(batch.column("text"))):
                words = K.Words(texts, K.NOT_WORD)
                codes = K.word_hashes(texts, words, fold=False)
                of = words.text_of()
                n = len(texts)
                count = np.zeros(n, dtype=np.int64)
                low, high = np.full(n, 2**62), np.full(n, -1)
                found: list[set] = [set() for _ in range(n)]
                for label, phrase in wanted:
                    m = len(phrase)
                    at = np.flatnonzero(codes == phrase[0])
                    at = at[at + m <= len(codes)]
                    for j in range(1, m):
                        at = at[codes[at + j] == phrase[j]]
                    at = at[of[at] == of[at + m - 1]]
                    docs, place = of[at], at - words.bounds[of[at]]
                    np.add.at(count, docs, 1)
                    np.minimum.at(low, docs, place)
                    np.maximum.at(high, docs, place)
                    for d in np.unique(docs).tolist():
                        found[d].add(label)
                n_words.append(words.counts)
                n_base.append(count)
                first.append(low)
                last.append(high)
                labels.extend(sorted(f) for f in found)
            none = np.concatenate(n_base) == 0
            yield pa.RecordBatch.from_pydict(
                {
                    "rid": batch.column("rid"),
                    "digest": batch.column("digest"),
                    "n_words": pa.array(np.concatenate(n_words), pa.int64()),
                    "n_base": pa.array(np.concatenate(n_base), pa.int64()),
                    "first_word": pa.array(np.concatenate(first), pa.int64(), mask=none),
                    "last_word": pa.array(np.concatenate(last), pa.int64(), mask=none),
                    "base": pa.array(labels, pa.list_(pa.string())),
                }
            )

    return run


def _rolling(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in map(K.lowered, K.slices(batch.column("text"))):
                words = K.Words(texts, K.NOT_WORD)
                grams = K.gram_hashes(K.word_hashes(texts, words, fold=False), k).astype(np.int64)
                counts = np.maximum(words.counts - k + 1, 0)
                # of each text the grams that stay inside it; those after them belong to the joint
                ok = K.whole_windows(words.bounds, k, len(grams))
                flat = pa.array(grams[ok])
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                part = slice(texts.first, texts.first + len(texts))
                yield pa.RecordBatch.from_pydict(
                    {
                        "rid": batch.column("rid")[part],
                        "digest": batch.column("digest")[part],
                        "grams": pa.ListArray.from_arrays(offsets, flat),
                    }
                )

    return run


def license_spans(texts: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = GRAM) -> DataFrame:
    """Spans of templates in texts (rid, digest, text): label, start_word, end_word, cover."""
    spark = texts.sparkSession
    table = spark.createDataFrame(
        template_positions(templates, k), "gram long, template int, q int, template_words int, label string"
    )
    rolled = texts.mapInArrow(_rolling(k), "rid long, digest long, grams array<long>")
    placed = rolled.select("rid", "digest", F.posexplode("grams").alias("p", "gram"))
    hits = placed.join(F.broadcast(table), "gram").withColumn("diagonal", F.col("p") - F.col("q"))
    key = ["rid", "digest", "template"]
    votes = hits.groupBy(*key, "diagonal").agg(
        F.collect_set("q").alias("q"), F.first("label").alias("label"), F.first("template_words").alias("template_words")
    )
    by_diagonal = Window.partitionBy(*key).orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(by_diagonal)
    merged = votes.withColumn("fresh", (gap.isNull() | (gap > DRIFT)).cast("int"))
    merged = merged.withColumn("span", F.sum("fresh").over(by_diagonal))
    spans = merged.groupBy(*key, "span").agg(
        F.first("label").alias("label"),
        F.first("template_words").alias("template_words"),
        F.array_distinct(F.flatten(F.collect_list("q"))).alias("q"),
        F.min(F.col("diagonal") + F.array_min("q")).alias("start_word"),
        F.max(F.col("diagonal") + F.array_max("q") + k).alias("end_word"),
    )
    under = F.array_distinct(F.flatten(F.transform("q", lambda q: F.sequence(q, q + (k - 1)))))
    cover = F.size(under) / F.col("template_words")
    length = F.col("end_word") - F.col("start_word")
    return spans.select(
        "rid", "digest", "label", "start_word", "end_word", cover.alias("cover"),
        ((cover >= COVER) & (length <= F.col("template_words") + 2 * DRIFT)).alias("verified"),
    )


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("rid"), F.xxhash64("text").alias("digest"), "text"
    )
    base = texts.mapInArrow(_base(phrases), BASE)
    spans = license_spans(texts, templates).groupBy("rid", "digest").agg(
        F.collect_set(F.when(F.col("verified"), F.col("label"))).alias("own"), F.max("cover").alias("cover")
    )
    out = base.join(spans, ["rid", "digest"], "left")
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base", F.coalesce("own", none)))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.coalesce("cover", F.lit(0.0)), F.lit(1.0)))
    return out.select(
        doc_id_of(), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )
