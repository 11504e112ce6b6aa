"""The catalogue's results stated in SQL, from the definitions, for a check elsewhere."""

from __future__ import annotations

CTES = {
    "emb": """SELECT vec_id AS row_id, label, CAST(i - 1 AS INTEGER) AS feature_idx,
        CAST(embedding[i] AS DOUBLE) AS value
        FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
    "bin_label": """SELECT vec_id AS row_id,
        CAST(CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE) > 0 AS INTEGER) AS label
        FROM embeddings""",
    "bin_test": """SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(row_id || '|42'))
        <= round(CAST(0.2 AS DOUBLE) * count(*) OVER (PARTITION BY label)) AS is_test FROM bin_label""",
    "emb_bin": "SELECT e.row_id, b.label, e.feature_idx, e.value FROM emb e JOIN bin_label b USING (row_id)",
    "miss": """SELECT row_id, label, feature_idx,
        CASE WHEN row_id % 17 <> feature_idx % 17 THEN value END AS value FROM emb""",
    "miss7": """SELECT row_id, label, feature_idx,
        CASE WHEN row_id % 7 <> feature_idx % 7 THEN value END AS value FROM emb""",
    "flawed": """SELECT row_id, label, feature_idx, 'f' || feature_idx AS feature, value FROM emb
        UNION ALL SELECT row_id, label, 64, 'f0_zero', value * 0 FROM emb WHERE feature_idx = 0
        UNION ALL SELECT row_id, label, 65, 'f0_small', value * CAST(0.01 AS DOUBLE) FROM emb WHERE feature_idx = 0""",
    "docs": """SELECT doc_id, quality, lang, source, CAST(n_chars AS DOUBLE) AS n_chars,
        spaces + 1.0 AS n_words, n_lines, digits / size AS digit_share,
        1.0 - letters / size AS non_letter_share, upper / size AS upper_share,
        (size - spaces) / (spaces + 1.0) AS mean_word_length
        FROM (SELECT doc_id, lang, source, n_chars,
            CAST(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS DOUBLE) AS letters,
            CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS DOUBLE) AS digits,
            CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS DOUBLE) AS upper,
            CAST(length(regexp_replace(text, '[^ \\n]', '', 'g')) AS DOUBLE) AS spaces,
            CAST(length(regexp_replace(text, '[^\\n]', '', 'g')) + 1 AS DOUBLE) AS n_lines,
            CAST(greatest(length(text), 1) AS DOUBLE) AS size
            FROM documents) JOIN labels USING (doc_id)""",
    "doc_long": """SELECT doc_id AS row_id, quality AS label, feature_idx, feature, value FROM docs,
        LATERAL (VALUES (0, 'n_chars', n_chars), (1, 'n_words', n_words), (2, 'n_lines', n_lines),
        (3, 'digit_share', digit_share), (4, 'non_letter_share', non_letter_share),
        (5, 'upper_share', upper_share), (6, 'mean_word_length', mean_word_length))
        AS v(feature_idx, feature, value)""",
    "line": """SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CAST(l_extendedprice AS DECIMAL(18,2)))) AS row_id, * FROM lineitem""",
    "line_long": """SELECT row_id, l_returnflag AS label, feature_idx, feature, value FROM line,
        LATERAL (VALUES (0, 'l_quantity', l_quantity), (1, 'l_extendedprice', l_extendedprice),
        (2, 'l_discount', l_discount), (3, 'l_tax', l_tax)) AS v(feature_idx, feature, value)""",
    "cust": """SELECT c_custkey AS row_id, c_mktsegment AS label, r_name AS "Dataset" FROM customer
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "pred": """SELECT model, doc_id AS row_id, quality AS label,
        CAST(score >= cut AS INTEGER) AS prediction, score FROM docs,
        LATERAL (VALUES ('letters', 1.0 - non_letter_share, CAST(0.75 AS DOUBLE)),
        ('calm', 1.0 - digit_share - upper_share, CAST(0.95 AS DOUBLE))) AS v(model, score, cut)""",
    "pred_fold": """SELECT p.*, f.fold FROM pred p JOIN (SELECT doc_id AS row_id,
        ntile(3) OVER (PARTITION BY quality ORDER BY md5(doc_id || '|42')) - 1 AS fold FROM docs) f USING (row_id)""",
    "by_class": """SELECT 'rule' AS model, l_returnflag AS label,
        CASE WHEN l_discount > CAST(0.05 AS DOUBLE) THEN 'A' WHEN l_extendedprice > 30000 THEN 'N' ELSE 'R' END AS prediction,
        l_extendedprice AS score FROM lineitem""",
    "emb_test": """SELECT vec_id AS row_id, label,
        row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || '|42'))
        <= round(CAST(0.2 AS DOUBLE) * count(*) OVER (PARTITION BY label)) AS is_test FROM embeddings""",
    "variances": """SELECT feature_idx, feature, var_samp(value) AS variance FROM flawed GROUP BY ALL""",
    # Feature lists over the planted label.
    "bin_var": "SELECT feature_idx, var_samp(value) AS score FROM emb_bin GROUP BY 1",
    "bin_bins": """SELECT feature_idx, label, floor((rank() OVER (PARTITION BY feature_idx ORDER BY value) - 1)
        * CAST(10 AS DOUBLE) / count(*) OVER (PARTITION BY feature_idx)) AS bin FROM emb_bin""",
    "selection": """SELECT method, feature_idx, 'f' || feature_idx AS feature, CAST(rank AS INTEGER) AS rank, score FROM (
        SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, feature_idx) AS rank FROM (
        SELECT 'variance' AS method, feature_idx, score FROM bin_var UNION ALL
        SELECT 'f_test', feature_idx, score FROM ({f:emb_bin}) UNION ALL
        SELECT 'binned_mi', feature_idx, score FROM ({mi:bin_bins}))) WHERE rank <= 20""",
    "oof": """SELECT s.method AS model, e.label, e.value AS score, CAST(e.value > 0 AS INTEGER) AS prediction, f.fold
        FROM emb_bin e JOIN selection s ON s.feature_idx = e.feature_idx AND s.rank = 1
        JOIN (SELECT row_id, ntile(3) OVER (PARTITION BY label ORDER BY md5(row_id || '|42')) - 1 AS fold
        FROM bin_label) f ON f.row_id = e.row_id""",
    "method_scores": """SELECT model AS method, avg(auc) AS auc, avg(accuracy) AS accuracy
        FROM ({auc:oof:model, fold:1}) JOIN (SELECT model, fold,
        avg(CAST(label = prediction AS INTEGER)) AS accuracy FROM oof GROUP BY ALL) USING (model, fold)
        GROUP BY ALL""",
    "class_parts": """SELECT model, class, sum(support) AS support, sum(said) AS said, sum(tp) AS tp FROM (
        SELECT model, label AS class, 1 AS support, 0 AS said, CAST(label = prediction AS INTEGER) AS tp FROM by_class
        UNION ALL SELECT model, prediction, 0, 1, 0 FROM by_class) GROUP BY ALL""",
    "class_rows": """SELECT model, class, coalesce(tp / nullif(said, 0), 0) AS precision,
        coalesce(tp / nullif(support, 0), 0) AS recall,
        coalesce(2 * tp / nullif(said + support, 0), 0) AS f1, CAST(support AS BIGINT) AS support FROM class_parts""",
    "two_class": """SELECT model, avg(CAST(label = prediction AS INTEGER)) AS accuracy,
        coalesce(sum(label * prediction) / nullif(sum(label), 0), 0) AS sensitivity,
        coalesce(sum((1 - label) * (1 - prediction)) / nullif(sum(1 - label), 0), 0) AS specificity,
        coalesce(sum(label * prediction) / nullif(sum(prediction), 0), 0) AS precision,
        coalesce(2 * sum(label * prediction) / nullif(sum(label) + sum(prediction), 0), 0) AS f1_score
        FROM pred GROUP BY model""",
    "six": """SELECT model, accuracy, auc, sensitivity, specificity, precision, f1_score
        FROM two_class JOIN ({auc:pred:model:1}) USING (model)""",
}


def _f_scores(source: str) -> str:
    """One-way ANOVA F by its definition: sums of squared deviations."""
    return f"""SELECT feature_idx, (sum(power(class_mean - grand, 2)) / (max(k) - 1))
        / (sum(power(value - class_mean, 2)) / (count(*) - max(k))) AS score FROM (
        SELECT feature_idx, value, avg(value) OVER (PARTITION BY feature_idx, label) AS class_mean,
        avg(value) OVER (PARTITION BY feature_idx) AS grand,
        count(DISTINCT label) OVER (PARTITION BY feature_idx) AS k
        FROM {source} WHERE value IS NOT NULL) GROUP BY feature_idx"""


def _binned_mi(source: str) -> str:
    """Plug-in MI as H(bin) + H(label) - H(bin, label)."""
    def entropy(by: str) -> str:
        return f"""SELECT feature_idx, -sum(p * ln(p)) AS h FROM (SELECT feature_idx,
            count(*) / CAST(sum(count(*)) OVER (PARTITION BY feature_idx) AS DOUBLE) AS p
            FROM {source} GROUP BY feature_idx, {by}) GROUP BY feature_idx"""

    return f"""SELECT feature_idx, greatest(b.h + l.h - j.h, 0) AS score FROM ({entropy("bin")}) b
        JOIN ({entropy("label")}) l USING (feature_idx) JOIN ({entropy("bin, label")}) j USING (feature_idx)"""


def _auc(source: str, keys: str, positive: str) -> str:
    """Mann-Whitney: mean ranks of the positives."""
    return f"""SELECT {keys}, (sum(CASE WHEN hit THEN mid END) - max(p) * (max(p) + 1) / 2)
        / nullif(max(p) * (count(*) - max(p)), 0) AS auc FROM (
        SELECT *, CAST(rank() OVER (PARTITION BY {keys} ORDER BY score) AS DOUBLE)
        + (count(*) OVER (PARTITION BY {keys}, score) - 1) / CAST(2 AS DOUBLE) AS mid,
        CAST(count_if(hit) OVER (PARTITION BY {keys}) AS DOUBLE) AS p
        FROM (SELECT *, label = {positive} AS hit FROM {source})) GROUP BY {keys}"""


def _neighbour_mi(source: str) -> str:
    """Nearest-neighbour MI by brute force over all pairs of a feature."""
    return f"""
      , pts AS (SELECT row_id, feature_idx, label, value, least(3, count(*) OVER (PARTITION BY feature_idx, label) - 1) AS k,
        count(*) OVER (PARTITION BY feature_idx, label) AS nc FROM {source})
      , used AS (SELECT * FROM pts WHERE nc > 1)
      , radius AS (SELECT row_id, feature_idx, d AS r FROM (
        SELECT a.row_id, a.feature_idx, a.k, abs(a.value - b.value) AS d,
        row_number() OVER (PARTITION BY a.row_id, a.feature_idx ORDER BY abs(a.value - b.value)) AS pos
        FROM used a JOIN used b ON a.feature_idx = b.feature_idx AND a.label = b.label AND a.row_id <> b.row_id)
        WHERE pos = k)
      , inside AS (SELECT a.row_id, a.feature_idx, count(*) AS m FROM used a
        JOIN radius r ON r.row_id = a.row_id AND r.feature_idx = a.feature_idx
        JOIN used b ON b.feature_idx = a.feature_idx
        AND (abs(a.value - b.value) < r.r OR a.value = b.value) GROUP BY ALL)
      , psi AS (SELECT n, coalesce(sum(1 / CAST(n - 1 AS DOUBLE)) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
        - CAST(0.5772156649015328606 AS DOUBLE) AS psi
        FROM (SELECT i AS n FROM range(2, 2 + (SELECT count(DISTINCT row_id) FROM {source})) t(i)))
      , psi1 AS (SELECT * FROM psi UNION ALL SELECT 1, CAST(-0.5772156649015328606 AS DOUBLE))
      , mi AS (SELECT u.feature_idx, greatest(max(pn.psi) + avg(pk.psi) - avg(pc.psi) - avg(pm.psi), 0) AS score
        FROM (SELECT *, count(*) OVER (PARTITION BY feature_idx) AS n FROM used) u
        JOIN inside i ON i.row_id = u.row_id AND i.feature_idx = u.feature_idx
        JOIN psi1 pn ON pn.n = u.n JOIN psi1 pk ON pk.n = u.k
        JOIN psi1 pc ON pc.n = u.nc JOIN psi1 pm ON pm.n = i.m GROUP BY u.feature_idx)"""


def _r(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 6) + 0.0 AS {name or expr}"


def _expand(sql: str) -> str:
    """Fill the ``{f:..}``, ``{mi:..}`` and ``{auc:..}`` placeholders."""
    out = sql
    while "{" in out:
        start = out.index("{")
        end = out.index("}", start)
        kind, *args = out[start + 1 : end].split(":")
        made = {"f": _f_scores, "mi": _binned_mi, "auc": _auc}[kind](*args)
        out = out[:start] + made + out[end + 1 :]
    return out


def _needed(sql: str, seen: list[str]) -> None:
    """Names of the shared parts a statement uses, dependencies first."""
    import re

    for word in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", sql)):
        if word in CTES and word not in seen:
            body = _expand(CTES[word])
            _needed(body, seen)
            if word not in seen:
                seen.append(word)


def _sql(body: str, more: str = "") -> str:
    main, extra = _expand(body), _expand(more)
    seen: list[str] = []
    _needed(main + " " + extra, seen)
    ctes = ",\n".join(f"{n} AS ({_expand(CTES[n])})" for n in seen)
    return f"WITH {ctes}{extra}\n{main}" if seen else main


def _cells(source: str, value: str = "value") -> str:
    return f"SELECT row_id, feature_idx, {_r(value, 'value')} FROM {source}"


def _ranked(source: str, name: str = "'f' || feature_idx") -> str:
    return f"""SELECT feature_idx, {name} AS feature, {_r('score')},
        CAST(row_number() OVER (ORDER BY score DESC, feature_idx) AS INTEGER) AS rank FROM {source}"""


ORACLE: dict[str, str] = {
    "separate_features": f"SELECT o_orderkey, o_custkey, {_r('o_totalprice')}, o_orderstatus FROM orders",
    "drop_metadata_columns": f"SELECT o_orderkey, {_r('o_totalprice')}, o_orderpriority FROM orders",
    "project_selected_features": _sql(
        f"""SELECT e.row_id, 'f' || e.feature_idx AS feature, CAST(v.rank - 1 AS INTEGER) AS feature_idx, {_r('e.value', 'value')}
        FROM emb e JOIN (SELECT feature_idx, row_number() OVER (ORDER BY var_samp(value) DESC, feature_idx) AS rank
        FROM emb GROUP BY feature_idx) v USING (feature_idx) WHERE v.rank <= 5"""
    ),
    "align_common_features": _sql(
        f"SELECT row_id, 'f' || (feature_idx + 10) AS feature, {_r('value')} FROM emb WHERE feature_idx + 10 < 64"
    ),
    "narrow_numeric_types": """WITH r AS (
        SELECT 'l_orderkey' AS c, 'bigint' AS t, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem UNION ALL
        SELECT 'l_partkey', 'bigint', min(l_partkey), max(l_partkey) FROM lineitem UNION ALL
        SELECT 'l_suppkey', 'bigint', min(l_suppkey), max(l_suppkey) FROM lineitem UNION ALL
        SELECT 'l_linenumber', 'int', min(l_linenumber), max(l_linenumber) FROM lineitem UNION ALL
        SELECT 'l_quantity', 'double', min(l_quantity), max(l_quantity) FROM lineitem UNION ALL
        SELECT 'l_extendedprice', 'double', min(l_extendedprice), max(l_extendedprice) FROM lineitem UNION ALL
        SELECT 'l_discount', 'double', min(l_discount), max(l_discount) FROM lineitem UNION ALL
        SELECT 'l_tax', 'double', min(l_tax), max(l_tax) FROM lineitem)
        SELECT c AS "column", t AS data_type, CASE
        WHEN t = 'double' THEN CASE WHEN lo > -65504 AND hi < 65504 THEN 'float' ELSE t END
        WHEN lo > -128 AND hi < 127 THEN 'tinyint' WHEN lo > -32768 AND hi < 32767 THEN 'smallint'
        WHEN lo > -2147483648 AND hi < 2147483647 THEN 'int' ELSE t END AS new_type FROM r""",
    "predefined_split": """SELECT doc_id AS row_id, lang AS label,
        CASE WHEN source IN ('src4', 'src5') THEN 'test' ELSE 'train' END AS split
        FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5')""",
    "predefined_split_fallback": """SELECT doc_id AS row_id, lang AS label,
        CASE WHEN source = (SELECT source FROM documents ORDER BY doc_id LIMIT 1) THEN 'train' ELSE 'test' END AS split
        FROM documents""",
    "two_feature_projection": f"""SELECT vec_id AS row_id, label, {_r('CAST(embedding[1] AS DOUBLE)', 'x')},
        {_r('CAST(embedding[2] AS DOUBLE)', 'y')} FROM embeddings""",
    "missing_fraction": _sql(
        f"""SELECT 'f' || feature_idx AS feature, CAST(count(*) - count(value) AS BIGINT) AS n_missing,
        {_r('1 - count(value) / CAST(count(*) AS DOUBLE)', 'missing_fraction')} FROM miss GROUP BY feature_idx"""
    ),
    "missing_fraction_gate": _sql(
        f"""SELECT 'f' || feature_idx AS "column", CAST(count(*) - count(value) AS BIGINT) AS n_missing,
        {_r('1 - count(value) / CAST(count(*) AS DOUBLE)', 'missing_fraction')} FROM miss7 GROUP BY feature_idx
        HAVING 1 - count(value) / CAST(count(*) AS DOUBLE) > 0.1"""
    ),
    "constant_features": _sql(
        "SELECT feature_idx, feature FROM flawed GROUP BY ALL HAVING count(DISTINCT value) <= 1"
    ),
    "target_checks": """WITH c AS (SELECT quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1)
        SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_missing, count(*) AS n_classes,
        min(n) AS smallest, max(n) AS largest,
        false AS error_missing, count(*) < 2 AS error_one_class, count(*) > 10 AS warn_many_classes,
        min(n) < 5 AS warn_small_class, max(n) / min(n) > 10 AS warn_imbalance FROM c""",
    "dataset_gate": _sql(
        """SELECT n_rows, CAST(64 AS INTEGER) AS n_features, n_classes, too_missing,
        CAST((SELECT count(*) FROM (SELECT feature_idx FROM miss7 GROUP BY 1 HAVING count(DISTINCT value) <= 1)) AS BIGINT) AS n_constant,
        n_rows >= 10 AS enough_samples, n_classes > 10 AS warn_many_classes, smallest < 5 AS warn_small_class,
        largest / smallest > 10 AS warn_imbalance, n_rows > 0 AND too_missing = '' AND n_classes >= 2 AS passes
        FROM (SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_classes, min(n) AS smallest, max(n) AS largest
        FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)),
        (SELECT coalesce(string_agg(f, ',' ORDER BY f), '') AS too_missing FROM (SELECT 'f' || feature_idx AS f
        FROM miss7 GROUP BY feature_idx HAVING 1 - count(value) / CAST(count(*) AS DOUBLE) > 0.1))"""
    ),
    "train_test_compatibility": """SELECT CAST(64 AS INTEGER) AS n_train_features, CAST(50 AS INTEGER) AS n_common,
        true AS warn_few_common, count(*) AS n_unknown_classes,
        string_agg(CAST(label AS VARCHAR), ',' ORDER BY label) AS unknown_classes FROM (
        SELECT DISTINCT label FROM embeddings WHERE label >= 6 EXCEPT SELECT label FROM embeddings WHERE label <= 7)""",
    "quality_report": _sql(
        f"""SELECT section, item, {_r('value')} FROM (
        SELECT 'total' AS section, 'samples' AS item, CAST(count(*) AS DOUBLE) AS value FROM embeddings UNION ALL
        SELECT 'total', 'features', count(*) FROM variances UNION ALL
        SELECT 'total', 'missing_cells', 0 UNION ALL
        SELECT 'total', 'constant_features', count_if(variance = 0) FROM variances UNION ALL
        SELECT 'total', 'low_variance_features', count_if(variance < 0.01) FROM variances UNION ALL
        SELECT 'class', CAST(label AS VARCHAR), count(*) FROM embeddings GROUP BY label UNION ALL
        SELECT 'type', feature || ' double', 1 FROM variances UNION ALL
        SELECT 'type', unnest(['row_id bigint', 'label int']), 1 UNION ALL
        SELECT 'missing', feature, 0 FROM variances UNION ALL
        SELECT 'constant', feature, 1 FROM variances WHERE variance = 0 UNION ALL
        SELECT 'low_variance', feature, 1 FROM variances WHERE variance < 0.01)"""
    ),
    "class_distribution_by_split": _sql(
        """SELECT is_test, label, count(*) AS n FROM (SELECT l_returnflag AS label,
        CAST('0x' || substr(md5(row_id || '|42'), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) < 0.2 AS is_test
        FROM line) GROUP BY ALL"""
    ),
    "impute_mean": _sql(
        _cells("(SELECT row_id, feature_idx, coalesce(value, avg(value) OVER (PARTITION BY feature_idx)) AS value FROM miss)")
    ),
    "impute_median": _sql(
        _cells("""(SELECT m.row_id, m.feature_idx, coalesce(m.value, q.med) AS value FROM miss m
        JOIN (SELECT feature_idx, median(value) AS med FROM miss GROUP BY 1) q USING (feature_idx))""")
    ),
    "drop_incomplete_rows": _sql(
        _cells("(SELECT e.* FROM emb e WHERE row_id % 3 <> 0 OR row_id NOT IN (SELECT row_id FROM miss WHERE value IS NULL))")
    ),
    "impute_zero": _sql(_cells("miss", "coalesce(value, 0)")),
    "standardise_train_test": _sql(
        _cells("""(SELECT row_id, feature_idx, (value - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS value FROM (
        SELECT row_id, feature_idx, value, avg(value) FILTER (WHERE NOT is_test) OVER (PARTITION BY feature_idx) AS m,
        stddev_pop(value) FILTER (WHERE NOT is_test) OVER (PARTITION BY feature_idx) AS s
        FROM flawed JOIN emb_test USING (row_id)))""")
    ),
    "encode_target": _sql(
        """SELECT row_id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM cust"""
    ),
    "binary_target": _sql("""SELECT row_id, l_linestatus AS label, CAST(l_linestatus =
        (SELECT max(l_linestatus) FROM lineitem) AS INTEGER) AS target FROM line"""),
    "decode_predictions": _sql(
        "SELECT row_id, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code, label AS code_label FROM cust"
    ),
    "preprocess_train_test": _sql(
        f"""SELECT row_id, CASE WHEN is_test THEN 'test' ELSE 'train' END AS part, label, feature_idx,
        {_r('(filled - m) / s', 'value')} FROM (
        SELECT f.*, avg(CASE WHEN NOT is_test THEN filled END) OVER w AS m,
        stddev_pop(CASE WHEN NOT is_test THEN filled END) OVER w AS s FROM (
        SELECT miss.row_id, CAST(dense_rank() OVER (ORDER BY miss.label) - 1 AS INTEGER) AS label, feature_idx, is_test,
        coalesce(value, avg(CASE WHEN NOT is_test THEN value END) OVER (PARTITION BY feature_idx)) AS filled
        FROM miss JOIN emb_test USING (row_id)) f WINDOW w AS (PARTITION BY feature_idx))"""
    ),
    "min_max_scores": _sql(
        f"""SELECT model, row_id, {_r('(score - lo) / (hi - lo + CAST(1e-8 AS DOUBLE))', 'score')} FROM (
        SELECT model, row_id, score, min(score) OVER (PARTITION BY model) AS lo,
        max(score) OVER (PARTITION BY model) AS hi FROM pred)"""
    ),
    "balanced_class_weights": _sql(
        f"""SELECT doc_id AS row_id, quality AS label, {_r('n / (k * nc)', 'weight')} FROM (
        SELECT doc_id, quality, count(*) OVER (PARTITION BY quality) AS nc, CAST(count(*) OVER () AS DOUBLE) AS n,
        (SELECT count(DISTINCT quality) FROM docs) AS k FROM docs)"""
    ),
    "stratified_split": _sql("SELECT row_id, label, is_test FROM emb_test"),
    "validation_split": """SELECT vec_id AS row_id, label, row_number() OVER (ORDER BY md5(vec_id || '|7'))
        <= round(CAST(0.25 AS DOUBLE) * count(*) OVER ()) AS is_test FROM embeddings""",
    "stratified_folds": """SELECT vec_id AS row_id, label,
        CAST(ntile(5) OVER (PARTITION BY label ORDER BY md5(vec_id || '|42')) - 1 AS INTEGER) AS fold FROM embeddings""",
    "hash_split": """SELECT vec_id AS row_id, label,
        CAST('0x' || substr(md5(vec_id || '|42'), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) < 0.2 AS is_test
        FROM embeddings""",
    "feature_variance": _sql(
        f"SELECT feature_idx, 'f' || feature_idx AS feature, {_r('var_samp(value)', 'variance')} FROM miss GROUP BY feature_idx"
    ),
    "variance_threshold": _sql(
        f"SELECT feature_idx, feature, {_r('variance')} FROM variances WHERE variance >= 0.01"
    ),
    "top_variance_features": _sql(
        f"""SELECT feature_idx, feature, {_r('v', 'variance')}, CAST(rank AS INTEGER) AS rank FROM (
        SELECT feature_idx, feature, variance AS v, row_number() OVER (ORDER BY variance DESC, feature_idx) AS rank
        FROM variances) WHERE rank <= 20"""
    ),
    "variance_summary": _sql(
        f"""SELECT count(*) AS total_features, {_r('avg(variance)', 'mean_variance')},
        {_r('median(variance)', 'median_variance')}, {_r('min(variance)', 'min_variance')},
        {_r('max(variance)', 'max_variance')}, CAST(count_if(variance < 0.01) AS BIGINT) AS features_below_threshold,
        CAST(count_if(variance = 0) AS BIGINT) AS zero_variance_features,
        CAST(count_if(variance < 0.01) AS BIGINT) AS low_variance_features FROM variances"""
    ),
    "problem_features": _sql(
        """SELECT feature_idx, feature, problem FROM (
        SELECT feature_idx, feature, CASE WHEN variance = 0 THEN 'zero_variance'
        WHEN variance < 0.01 THEN 'low_variance'
        WHEN variance > (SELECT quantile_cont(variance, 0.99) FROM variances) THEN 'very_high_variance' END AS problem
        FROM variances) WHERE problem IS NOT NULL"""
    ),
    "variance_histogram": _sql(
        """SELECT CAST(least(floor((variance - lo) * 50 / (hi - lo)) + 1, 50) AS INTEGER) AS bin, count(*) AS n_features
        FROM variances, (SELECT min(variance) AS lo, max(variance) AS hi FROM variances) GROUP BY 1"""
    ),
    "log_variance_box": _sql(
        "SELECT " + ", ".join(
            _r(f"quantile_cont(log10(variance + CAST(1e-10 AS DOUBLE)), {q})", n)
            for q, n in ((0, "minimum"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1, "maximum"))
        ) + " FROM variances"
    ),
    "anova_f_scores": _sql(
        f"SELECT feature_idx, 'f' || feature_idx AS feature, {_r('score')} FROM ({{f:miss}})"
    ),
    "f_test_on_line_items": _sql(
        _ranked("({f:line_long}) JOIN (SELECT DISTINCT feature_idx, feature FROM line_long) USING (feature_idx)", "feature")
    ),
    "mutual_information": _sql(
        f"SELECT feature_idx, 'f' || feature_idx AS feature, {_r('score')} FROM mi", _neighbour_mi("emb")
    ),
    "mutual_information_ties": _sql(
        f"SELECT feature_idx, feature, {_r('score')} FROM mi JOIN (SELECT DISTINCT feature_idx, feature FROM doc_long) USING (feature_idx)",
        _neighbour_mi("doc_long"),
    ),
    "binned_mutual_information": _sql(
        f"""SELECT feature_idx, feature, {_r('score')} FROM ({{mi:line_bins}})
        JOIN (SELECT DISTINCT feature_idx, feature FROM line_long) USING (feature_idx)""",
        """, line_bins AS (SELECT feature_idx, label, floor((rank() OVER (PARTITION BY feature_idx ORDER BY value) - 1)
        * CAST(10 AS DOUBLE) / count(*) OVER (PARTITION BY feature_idx)) AS bin FROM line_long)""",
    ),
    "separating_features": _sql(
        f"""SELECT feature_idx, 'f' || feature_idx AS feature, {_r('s', 'score')}, {_r('v', 'variance')}, CAST(rank AS INTEGER) AS rank FROM (
        SELECT feature_idx, f.score AS s, w.v, row_number() OVER (ORDER BY f.score DESC, feature_idx) AS rank
        FROM ({{f:emb}}) f JOIN (SELECT feature_idx, var_samp(value) AS v FROM emb GROUP BY 1
        ORDER BY v DESC, feature_idx LIMIT 48) w USING (feature_idx)) WHERE rank <= 20"""
    ),
    "stacked_feature_lists": _sql(f"SELECT method, feature_idx, feature, rank, {_r('score')} FROM selection"),
    "feature_rankings": _sql(_ranked("({f:emb_bin})")),
    "combined_feature_set": _sql(
        """SELECT feature, CAST(row_number() OVER (ORDER BY feature) AS INTEGER) AS rank
        FROM (SELECT DISTINCT feature FROM selection)"""
    ),
    "pairwise_overlap": _sql(
        f"""SELECT method_a, method_b, CAST(len(list_intersect(fa, fb)) AS BIGINT) AS n_common,
        {_r('len(list_intersect(fa, fb)) / CAST(len(list_distinct(list_concat(fa, fb))) AS DOUBLE)', 'jaccard')} FROM (
        SELECT method AS method_a, list(feature) AS fa FROM selection GROUP BY 1),
        (SELECT method AS method_b, list(feature) AS fb FROM selection GROUP BY 1)"""
    ),
    "feature_method_map": _sql(
        f"""SELECT feature, method, rank, {_r('auc', 'method_score')}
        FROM selection JOIN method_scores USING (method)"""
    ),
    "method_scoreboard": _sql(
        f"""SELECT method, n_features, {_r('a', 'auc')}, {_r('acc', 'accuracy')}, CAST(pos AS INTEGER) AS rank, pos = 1 AS is_best FROM (
        SELECT method, count(*) AS n_features, max(auc) AS a, max(accuracy) AS acc,
        row_number() OVER (ORDER BY max(auc) DESC, CASE method WHEN 'f_test' THEN 1 WHEN 'binned_mi' THEN 2 ELSE 3 END) AS pos
        FROM selection JOIN method_scores USING (method) GROUP BY method)"""
    ),
    "unknown_classes": """SELECT DISTINCT label FROM embeddings WHERE label >= 6
        EXCEPT SELECT label FROM embeddings WHERE label <= 7""",
    "concat_train_test_rows": _sql(f"SELECT doc_id, quality, {_r('n_chars')} FROM docs"),
    "concat_feature_target_columns": _sql(
        f"SELECT doc_id AS row_id, {_r('n_chars')}, {_r('mean_word_length')}, toxic FROM docs JOIN labels USING (doc_id)"
    ),
    "accuracy": _sql(
        f"SELECT model, {_r('avg(CAST(label = prediction AS INTEGER))', 'accuracy')} FROM pred GROUP BY model"
    ),
    "confusion_matrix": _sql(
        """SELECT 'rule' AS model, a.label, b.label AS prediction, (SELECT count(*) FROM by_class c
        WHERE c.label = a.label AND c.prediction = b.label) AS n FROM
        (SELECT DISTINCT label FROM by_class) a, (SELECT DISTINCT label FROM by_class) b"""
    ),
    "binary_metrics": _sql(
        "SELECT model, " + ", ".join(_r(m) for m in ("accuracy", "sensitivity", "specificity", "precision", "f1_score"))
        + " FROM two_class"
    ),
    "weighted_metrics": _sql(
        "SELECT model, " + ", ".join(
            _r(f"sum({m} * support) / sum(support)", f"weighted_{m}") for m in ("precision", "recall", "f1")
        ) + " FROM class_rows GROUP BY model"
    ),
    "roc_curve": _sql(
        f"""SELECT DISTINCT model, {_r('score', 'threshold')},
        {_r('sum(1 - label) OVER w / CAST(sum(1 - label) OVER (PARTITION BY model) AS DOUBLE)', 'fpr')},
        {_r('sum(label) OVER w / CAST(sum(label) OVER (PARTITION BY model) AS DOUBLE)', 'tpr')}
        FROM pred WINDOW w AS (PARTITION BY model ORDER BY score DESC RANGE UNBOUNDED PRECEDING)"""
    ),
    "auc": _sql(f"SELECT model, {_r('auc')} FROM ({{auc:pred:model:1}})"),
    "auc_on_line_items": _sql(f"SELECT model, {_r('auc')} FROM ({{auc:by_class:model:'R'}})"),
    "class_report": _sql(
        f"""SELECT model, class, {_r('precision')}, {_r('recall')}, {_r('f1')}, support FROM class_rows UNION ALL
        SELECT model, 'macro avg', {_r('avg(precision)', 'precision')}, {_r('avg(recall)', 'recall')}, {_r('avg(f1)', 'f1')},
        CAST(sum(support) AS BIGINT) FROM class_rows GROUP BY model UNION ALL
        SELECT model, 'weighted avg', {_r('sum(precision * support) / sum(support)', 'precision')},
        {_r('sum(recall * support) / sum(support)', 'recall')}, {_r('sum(f1 * support) / sum(support)', 'f1')},
        CAST(sum(support) AS BIGINT) FROM class_rows GROUP BY model"""
    ),
    "model_scoreboard": _sql(
        "SELECT model, " + ", ".join(
            _r(f"six.{m}", m) for m in ("accuracy", "auc", "sensitivity", "specificity", "precision", "f1_score")
        ) + f""", CAST(row_number() OVER (ORDER BY six.accuracy DESC, model) AS INTEGER) AS rank,
        row_number() OVER (ORDER BY six.accuracy DESC, model) = 1 AS is_best,
        {_r('cv_score')}, 'rule=' || model AS best_params FROM six JOIN (SELECT model, avg(accuracy) AS cv_score FROM (
        SELECT model, fold, avg(CAST(label = prediction AS INTEGER)) AS accuracy FROM pred_fold GROUP BY ALL)
        GROUP BY model) USING (model)"""
    ),
    "feature_set_comparison": _sql(
        f"""SELECT 'rule' AS model, a.metric, {_r('a.v', 'all_features')}, {_r('t.v', 'top_features')},
        CASE WHEN a.v > t.v THEN 'all_features' WHEN t.v > a.v THEN 'top_features' ELSE 'equal' END AS higher
        FROM tall a JOIN tall t ON a.metric = t.metric WHERE a.model = 'letters' AND t.model = 'calm'""",
        """, tall AS (SELECT model, metric, v FROM six, LATERAL (VALUES ('accuracy', accuracy), ('auc', auc),
        ('sensitivity', sensitivity), ('specificity', specificity), ('precision', precision),
        ('f1_score', f1_score)) AS t(metric, v))""",
    ),
    "cross_validated_metrics": _sql(
        f"""SELECT model, count(*) AS folds, {_r('avg(accuracy)', 'mean_accuracy')},
        {_r('stddev_pop(accuracy)', 'std_accuracy')}, {_r('avg(auc)', 'mean_auc')}, {_r('stddev_pop(auc)', 'std_auc')}
        FROM (SELECT model, fold, avg(CAST(label = prediction AS INTEGER)) AS accuracy FROM pred_fold GROUP BY ALL)
        JOIN ({{auc:pred_fold:model, fold:1}}) USING (model, fold) GROUP BY model"""
    ),
    "target_distribution": "SELECT l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 1",
    "target_by_cohort": _sql(
        """SELECT "Dataset", count_if(label = 'AUTOMOBILE') AS "AUTOMOBILE", count_if(label = 'BUILDING') AS "BUILDING",
        count_if(label = 'FURNITURE') AS "FURNITURE", count_if(label = 'HOUSEHOLD') AS "HOUSEHOLD",
        count_if(label = 'MACHINERY') AS "MACHINERY" FROM cust GROUP BY 1"""
    ),
    "nearest_neighbours": _sql(
        f"""SELECT row_id, CAST(pos AS INTEGER) AS position, neighbour_id, neighbour_label, {_r('d', 'distance')} FROM (
        SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, neighbour_id) AS pos FROM dist) WHERE pos <= 5""",
        """, dist AS (SELECT q.row_id, t.row_id AS neighbour_id, t.label AS neighbour_label,
        sqrt(sum(power(q.value - t.value, 2))) AS d FROM emb q JOIN emb_test a ON a.row_id = q.row_id AND a.is_test
        JOIN emb t ON t.feature_idx = q.feature_idx JOIN emb_test b ON b.row_id = t.row_id AND NOT b.is_test
        GROUP BY ALL)""",
    ),
    "knn_classification": _sql(
        f"""SELECT row_id, CAST(label AS INTEGER) AS prediction, {_r('share')} FROM (
        SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY share DESC, label) AS place FROM (
        SELECT DISTINCT row_id, label, sum(1 / d) OVER (PARTITION BY row_id, label) / sum(1 / d) OVER (PARTITION BY row_id) AS share
        FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, neighbour_id) AS pos FROM dist)
        WHERE pos <= 7)) WHERE place = 1""",
        """, dist AS (SELECT q.row_id, t.row_id AS neighbour_id, b.label, sum(abs(q.value - t.value)) AS d
        FROM emb q JOIN bin_test a ON a.row_id = q.row_id AND a.is_test
        JOIN emb t ON t.feature_idx = q.feature_idx JOIN bin_test b ON b.row_id = t.row_id AND NOT b.is_test
        GROUP BY ALL)""",
    ),
    "k_nearest_model": _sql(
        f"""SELECT 'KNN' AS model, row_id, CAST(label AS DOUBLE) AS label,
        CAST(score > CAST(0.5 AS DOUBLE) AS DOUBLE) AS prediction, {_r('score')} FROM (
        SELECT row_id, any_value(own) AS label, avg(label) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, neighbour_id) AS pos FROM dist)
        WHERE pos <= 5 GROUP BY row_id)""",
        """, scaled AS (SELECT feature_idx, avg(value) AS m, stddev_pop(value) AS s FROM emb JOIN bin_test USING (row_id)
        WHERE NOT is_test GROUP BY feature_idx),
        dist AS (SELECT q.row_id, a.label AS own, t.row_id AS neighbour_id, b.label,
        sum(power((q.value - t.value) / s.s, 2)) AS d
        FROM emb q JOIN bin_test a ON a.row_id = q.row_id AND a.is_test
        JOIN emb t ON t.feature_idx = q.feature_idx JOIN bin_test b ON b.row_id = t.row_id AND NOT b.is_test
        JOIN scaled s ON s.feature_idx = q.feature_idx GROUP BY ALL)""",
    ),
    "load_csv_table": _sql(_cells("miss")),
    "load_train_test_pair": _sql(
        f"""SELECT row_id, label, {_r('total')} FROM (SELECT row_id, label, total,
        row_number() OVER (PARTITION BY label ORDER BY md5(row_id || '|7'))
        <= round(CAST(0.2 AS DOUBLE) * count(*) OVER (PARTITION BY label)) AS held FROM (
        SELECT row_id, label, sum(value) AS total FROM emb WHERE feature_idx BETWEEN 4 AND 59 GROUP BY ALL)) WHERE held"""
    ),
    "export_ml_ready": _sql(
        f"""SELECT f.of || CASE WHEN is_test THEN 'test' ELSE 'train' END AS part, e.row_id, e.label,
        CAST(f.pos - 1 AS INTEGER) AS feature_idx, {_r('e.value', 'value')} FROM emb e JOIN emb_test s USING (row_id)
        JOIN chosen f ON f.feature_idx = e.feature_idx""",
        """, train_rows AS (SELECT e.* FROM emb e JOIN emb_test s USING (row_id) WHERE NOT s.is_test),
        by_f AS (SELECT feature_idx FROM ({f:train_rows}) QUALIFY row_number() OVER (ORDER BY score DESC, feature_idx) <= 5),
        by_v AS (SELECT feature_idx FROM train_rows GROUP BY 1
        QUALIFY row_number() OVER (ORDER BY var_samp(value) DESC, feature_idx) <= 5),
        chosen AS (SELECT '' AS of, feature_idx, row_number() OVER (ORDER BY score DESC, feature_idx) AS pos
        FROM ({f:train_rows}) QUALIFY pos <= 5 UNION ALL
        SELECT 'all_', feature_idx, row_number() OVER (ORDER BY 'f' || feature_idx) AS pos
        FROM (SELECT * FROM by_f UNION SELECT * FROM by_v))""",
    ),
    "export_result_tables": _sql(
        """SELECT feature, rank, 'best' AS list FROM selection WHERE method = 'f_test' UNION ALL
        SELECT feature, CAST(row_number() OVER (ORDER BY feature) AS INTEGER), 'combined'
        FROM (SELECT DISTINCT feature FROM selection)"""
    ),
    "export_run_summary": _sql(
        """SELECT (SELECT count(*) FROM embeddings) AS samples, (SELECT count(DISTINCT label) FROM embeddings) AS classes,
        (SELECT string_agg('f' || feature_idx, ',' ORDER BY score DESC, feature_idx) FROM (
        SELECT * FROM ({f:emb}) ORDER BY score DESC, feature_idx LIMIT 3)) AS selected,
        CAST(42 AS BIGINT) AS seed, 'label' AS target"""
    ),
}


# --- fits: the rows they must give, and what holds for any right fit ----------------


def _fits(model: str) -> str:
    return _sql(
        f"""SELECT '{model}' AS model, row_id, CAST(label AS DOUBLE) AS label, TRUE AS score_in_range,
        TRUE AS prediction_fits_scores, TRUE AS better_than_chance FROM bin_test WHERE is_test"""
    )


def _ranks(*flags: str, size: int = 20) -> str:
    said = "".join(f", TRUE AS {f}" for f in flags)
    return f"SELECT CAST(i AS INTEGER) AS rank{said} FROM range(1, {size + 1}) AS r(i)"


def _names(column: str, names: list[str], *flags: str) -> str:
    values = ", ".join(f"('{n}')" for n in names)
    return f"SELECT {column}{''.join(f', TRUE AS {f}' for f in flags)} FROM (VALUES {values}) AS v({column})"


_SELECTORS = [
    "univariate_f_test", "mutual_information", "random_forest_importance", "rfe_random_forest",
    "lasso_regularization", "gradient_boosting_importance",
]
_MODELS = ["RandomForest", "GradientBoosting", "AdaBoost", "SVM", "LinearSVM", "LogisticRegression", "KNN"]
_FIGURES = ["accuracy", "auc", "sensitivity", "specificity", "precision", "f1_score"]

ORACLE |= {
    "random_forest_model": _fits("RandomForest"),
    "gradient_boosting_model": _fits("GradientBoosting"),
    "ada_boost_model": _fits("AdaBoost"),
    "logistic_regression_model": _fits("LogisticRegression"),
    "linear_svm_model": _fits("LinearSVM"),
    "rbf_svm_model": _fits("SVM"),
    "logistic_regression_multiclass": _sql(
        """SELECT 'LogisticRegression' AS model, row_id,
        CAST((SELECT count(DISTINCT label) FROM embeddings e WHERE e.label < t.label) AS DOUBLE) AS label,
        TRUE AS scores_in_range, TRUE AS a_score_per_class, TRUE AS prediction_fits_scores
        FROM emb_test t WHERE is_test"""
    ),
    "forest_importance_selection": _ranks("planted_first", "falling", "positive"),
    "boosting_importance_selection": _ranks("planted_first", "falling", "positive"),
    "forest_elimination_selection": _ranks("planted_first", "falling", "positive"),
    "logistic_elimination_selection": _ranks("planted_first", "falling", "positive"),
    "top_model_features": _ranks("planted_first", "falling", "positive"),
    "lasso_selection_multiclass": _ranks("falling", "positive"),
    "lasso_selection": "SELECT CAST(i AS INTEGER) AS feature_idx, TRUE AS optimal, TRUE AS listed_if_large FROM range(64) AS r(i)",
    "model_feature_importance": """SELECT CAST(i AS INTEGER) AS feature_idx, 'f' || i AS feature,
        TRUE AS sums_to_one FROM range(64) AS r(i)""",
    "pca_scores": """SELECT vec_id AS row_id, label, TRUE AS centred, TRUE AS uncorrelated, TRUE AS within_row
        FROM embeddings""",
    "pca_explained_variance": """SELECT CAST(i AS INTEGER) AS component, TRUE AS is_variance_of_scores,
        TRUE AS above_even_share FROM range(1, 3) AS r(i)""",
    "evaluate_selection_methods": _names(
        "method", _SELECTORS, "auc_in_range", "accuracy_in_range", "std_auc_in_range", "std_accuracy_in_range"
    ),
    "plain_method_scores": _names(
        "method", ["univariate_f_test", "mutual_information", "random_forest_importance", "lasso_regularization"],
        "accuracy_in_range",
    ),
    "model_grid_search": """SELECT CAST(i AS INTEGER) AS point, TRUE AS score_in_range, TRUE AS refit_with_best
        FROM range(18) AS r(i)""",
    "regularisation_path": """SELECT c, CAST(f AS INTEGER) AS fold, CAST(i AS INTEGER) AS feature_idx, TRUE AS optimal
        FROM (VALUES (0.001), (0.01), (0.1), (1.0), (10.0), (100.0)) AS v(c0), LATERAL (SELECT CAST(c0 AS DOUBLE) AS c),
        range(-1, 3) AS r(f), range(65) AS s(i)""",
    "tuned_selections": """SELECT method, CAST(i AS INTEGER) AS rank, TRUE AS planted_first, TRUE AS falling, TRUE AS tuned
        FROM (VALUES ('gradient_boosting_importance'), ('lasso_regularization'), ('random_forest_importance')) AS v(method),
        range(1, 3) AS r(i)""",
    "train_and_score_models": "SELECT *, model = 'LogisticRegression' AS searched FROM ("
    + _names(
        "model", _MODELS, "first_is_best", "best_is_named", "falling", "auc_in_range",
        "sensitivity_in_range", "specificity_in_range",
    )
    + ")",
    "predict_with_best_model": _sql(
        """SELECT row_id, CAST(label AS DOUBLE) AS label, TRUE AS same_prediction, TRUE AS same_score,
        label AS label_label FROM bin_test WHERE is_test"""
    ),
    "predict_named_pair": _sql(
        """SELECT row_id, CAST(label = 'IS' AS DOUBLE) AS label, TRUE AS same_prediction, TRUE AS same_score,
        TRUE AS score_of_ir, label AS label_label FROM pair_test WHERE is_test""",
        """, pair_test AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(row_id || '|42'))
        <= round(CAST(0.2 AS DOUBLE) * count(*) OVER (PARTITION BY label)) AS is_test
        FROM (SELECT row_id, CASE WHEN label = 1 THEN 'IR' ELSE 'IS' END AS label FROM bin_label))""",
    ),
    "save_and_load_models": _sql(
        """SELECT row_id, TRUE AS same_label, TRUE AS same_score, TRUE AS label_is_known FROM emb_test WHERE is_test"""
    ),
    "models_on_top_features": _names(
        "model", ["LogisticRegression", "RandomForest"], "accuracy_in_range", "auc_in_range",
        "sensitivity_in_range", "specificity_in_range",
    ),
    "all_against_top_features": "SELECT 'LogisticRegression' AS model, * FROM ("
    + _names("metric", _FIGURES, "fits", "all_features_in_range", "top_features_in_range") + ")",
    "all_against_top_features_multiclass": "SELECT 'LogisticRegression' AS model, * FROM ("
    + _names(
        "metric", ["accuracy", "auc", "weighted_precision", "weighted_recall", "weighted_f1"],
        "fits", "all_features_in_range", "top_features_in_range",
    ) + ")",
    "test_check_of_best_features": _names("model", ["plain", "tuned"], "better_than_chance"),
}
