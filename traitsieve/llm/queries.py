"""Catalogue queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitsieve.llm import (
    byte_dedup,
    hard_negatives,
    html_text,
    lexical_search,
    license_scan,
    mixing,
    neighbours,
    ngram_join,
    packing,
    quality,
    substring_dedup,
    token_files,
    vector_dedup,
)
from traitsieve.llm.tables import table


def op1_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = byte_dedup.dedup_bytes(table(spark, sf_dir, "documents"))
    # a removed string may start or end inside a character, whose rest is no UTF-8 any more
    return cut.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, columns=["doc_id", "source"])
    return mixed.select(
        "doc_id",
        "source",
        F.col("mix_bytes").alias("n_bytes"),
        F.col("mix_block").alias("block"),
        F.col("mix_place").alias("place"),
        F.col("mix_slot").alias("slot"),
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), token_files.session_vocabulary(spark))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_mil": op1_quality_mil,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_byte_dedup": op4_byte_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_pfair_mixing": op7_pfair_mixing,
    "op8_token_files": op8_token_files,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_nearest": op10_nearest,
    "op11_lexical_search": op11_lexical_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_html_text": op13_html_text,
}

ORACLE: dict[str, str] = {}

ORACLE["op2_substring_dedup"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
starts AS (
    SELECT r, doc_id, words, unnest(range(1, len(words) - 11)) AS s FROM docs
),
windows AS (
    SELECT r, doc_id, s, array_to_string(words[s : s + 12], ' ') AS phrase FROM starts
),
later AS (
    SELECT r, s FROM windows
    QUALIFY min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY phrase) < coalesce(doc_id, 9223372036854775807)
),
gone AS (
    SELECT DISTINCT r, unnest(range(s, s + 13)) AS k FROM later
),
placed AS (
    SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM docs
),
kept AS (
    SELECT r, count(gone.k) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY k) FILTER (WHERE gone.k IS NULL), '') AS rest
    FROM placed LEFT JOIN gone USING (r, k) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

ORACLE["op6_embedding_dedup"] = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93
),
reached AS (
    SELECT DISTINCT a AS vec_id, a AS other FROM links
    UNION
    SELECT reached.vec_id, links.b FROM reached JOIN links ON reached.other = links.a
),
components AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
degrees AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id)::BIGINT AS component_id,
       vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN components USING (vec_id) LEFT JOIN degrees USING (vec_id)
"""

ORACLE["op9_jaccard_join"] = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS words
    FROM documents
),
starts AS (
    SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS s FROM docs WHERE len(words) > 0
),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(words[s : s + 4], ' ') AS shingle FROM starts
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
),
links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)
),
reached AS (
    SELECT DISTINCT a AS doc_id, a AS other FROM links
    UNION
    SELECT reached.doc_id, links.b FROM reached JOIN links ON reached.other = links.a
),
components AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id)::BIGINT AS component_id
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN components USING (doc_id)
"""

ORACLE["op11_lexical_search"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
),
totals AS (
    SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs WHERE len(terms) > 0
),
tf AS (
    SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term
),
asked AS (
    SELECT DISTINCT item_id, unnest(
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
),
weights AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM tf CROSS JOIN totals WHERE term IN (SELECT term FROM asked) GROUP BY term, n_docs
),
damped AS (
    SELECT r, doc_id, 50 + (50 * len(terms) * n_docs) // n_terms AS m FROM docs CROSS JOIN totals WHERE len(terms) > 0
),
scores AS (
    SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
    FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN damped USING (r) GROUP BY item_id, doc_id, r
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r)::INTEGER AS rank
    FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

ORACLE["op12_hard_negatives"] = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           list_inner_product(a.v, b.v)::BIGINT AS score
    FROM usable a JOIN usable b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
