"""The pipeline beside its stages in plain Python, and the queries' registration."""

from collections import Counter

import pytest
from helpers import jaccard_components, without_repeated_words
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from traitsieve.llm import mixing, packing, quality, queries


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    folder, kept = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(folder / name))
        kept[name] = docs = spark.read.parquet(str(folder / name))
    return kept


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_return_documents(stages, spark, sf):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == columns
    assert len(corpus_pipeline.STAGES) == 5


def test_classifier_keeps_good_documents(stages, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = stages["quality_classifier"].select("doc_id", F.lit(1).alias("kept"))
    judged = labels.join(kept, "doc_id", "left").where(F.crc32(F.col("doc_id").cast("string")) % quality.FOLDS == 0)
    rows = judged.collect()
    assert all(r["kept"] == 1 for r in rows if r["quality"] == 1)
    assert sum(r["kept"] is None for r in rows if r["quality"] == 0) >= 0.5 * sum(r["quality"] == 0 for r in rows)


def test_one_of_each_group_and_no_window_twice(stages):
    before = texts(stages["quality_classifier"])
    found = jaccard_components(before)
    assert {i for i, _ in texts(stages["ngram_jaccard_join"])} == {i for i, _, c in found if i == c}
    words = {i: n - gone for i, n, gone, _ in without_repeated_words(texts(stages["ngram_jaccard_join"]))}
    cut = {i: len((t or "").split()) for i, t in texts(stages["substring_dedup"])}
    assert cut == words


def test_mixing_and_packing_keep_everything(stages):
    cut = {i: len((t or "").split()) for i, t in texts(stages["substring_dedup"])}
    assert sorted(texts(stages["source_mixing"])) == sorted(texts(stages["substring_dedup"]))
    packed = stages["best_fit_packing"].groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == cut


def test_bins_follow_the_schedule(stages, spark, sf, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 8)
    mixed = stages["source_mixing"]
    packed = corpus_pipeline.best_fit_packing(spark, mixed, sf).collect()
    slots = {r["doc_id"]: r["mix_slot"] for r in mixing.mix(mixed).collect()}
    assert all(r["mix_slot"] == slots[r["doc_id"]] for r in packed) and {r["doc_id"] for r in packed} == set(slots)
    per_slot = Counter(r["mix_slot"] for r in packed)
    assert len(per_slot) > 1 and max(per_slot.values()) > 8  # slots that are cut, too
    shards = {}
    for r in packed:
        shards.setdefault(int(r["bin_id"].split("-")[0]), []).append(r["mix_slot"])
    ordered = [shards[k] for k in sorted(shards)]
    assert len(ordered) > 3 and all(max(a) <= min(b) for a, b in zip(ordered, ordered[1:]))
    assert max(len(s) for s in ordered) <= 32


def test_every_operator_has_its_query():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(queries.ORACLE) <= set(queries.QUERIES)


def test_queries_that_the_other_tests_do_not_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    mixed = queries.op7_pfair_mixing(spark, sf)
    assert mixed.count() == docs and mixed.columns == ["doc_id", "source", "n_bytes", "block", "place", "slot"]
    assert queries.op3_best_fit_packing(spark, sf).select("doc_id").distinct().count() == docs
