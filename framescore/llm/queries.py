"""The corpus operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import centroids, exact_dedup, language_id, licenses, mixing, packing, private_data, quality_classifier, quality_rules, simhash, spelling, token_counts, toxicity
from .common import LOWER, UPPER, WORD, table


def op1_offset_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_paragraph_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_neighbour_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_boosted_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.find_private_data(table(spark, sf_dir, "documents")).drop("found")


def op7_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_segment_popcount_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_block_naming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def op10_line_first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("clean_text")


_Q = quality_rules


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM d),
l AS (
  SELECT *, list_filter(lines, lambda x: regexp_matches(x, '{_quoted(_Q.TERMINAL)}')
    AND len(regexp_extract_all(x, '{_Q.SYMBOLS}|!!')) <= {_Q.MAX_SYMBOL_SHARE} * length(x)
    AND len(regexp_extract_all(x, '{_Q.SEPARATORS}')) < 2
    AND NOT regexp_matches(lower(x), '{_quoted(_Q.ALONE_LINE)}') AND NOT regexp_matches(lower(x), '{_quoted(_Q.WITHIN_LINE)}')) AS stay
  FROM w),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
x AS (
  SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '{_Q.SYMBOLS}')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(stay) AS BIGINT) AS n_lines_removed,
    CAST(length(array_to_string(w, '')) - length(regexp_replace(array_to_string(stay, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS chars_removed
  FROM l LEFT JOIN c USING (doc_id))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND chars_removed <= {_Q.MAX_LOST} * word_chars AS kept
FROM x
"""


def op11_vantage_point_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def _op11_sql() -> str:
    """The start, ten rounds and the last assignment as a chain of common tables."""
    k = centroids.CLUSTERS
    far = "list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - c.c[i]) * (x.v[i] - c.c[i])))"
    assign = f"SELECT r, v, min({far} * {k} + k) AS dk FROM kept AS x, c{{n}} AS c GROUP BY r, v"
    parts = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id)) - 1 AS k, v AS c FROM kept QUALIFY k < {k})",
    ]
    for n in range(centroids.ROUNDS):
        parts += [
            f"a{n} AS MATERIALIZED ({assign.format(n=n)})",
            f"m{n} AS (SELECT k, list((s - ((s % n + n) % n)) // n ORDER BY i) AS c FROM (SELECT dk % {k} AS k, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{n}, range(1, 65) AS t(i) GROUP BY ALL) GROUP BY k)",
            f"c{n + 1} AS MATERIALIZED (SELECT c{n}.k, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} ON c{n}.k = m{n}.k)",
        ]
    n = centroids.ROUNDS
    parts.append(f"a{n} AS MATERIALIZED ({assign.format(n=n)})")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(dk % {k} AS INTEGER) AS cluster, CAST(dk // {k} AS BIGINT) AS distance, CAST(sum(dk // {k}) OVER (PARTITION BY dk % {k}) AS BIGINT) AS cluster_inertia,
  CAST(sum(dk // {k}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{n} JOIN kept USING (r) JOIN c{n} ON c{n}.k = dk % {k}"""


OP11_SQL = _op11_sql()


def op12_sorted_list_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("features")


QUERIES = {"op1_offset_token_counts": op1_offset_token_counts, "op2_concatenate_and_cut": op2_concatenate_and_cut, "op5_boosted_private_data": op5_boosted_private_data, "op3_paragraph_licenses": op3_paragraph_licenses, "op4_neighbour_voting": op4_neighbour_voting, "op6_partial_matching": op6_partial_matching, "op7_subset_sum_mix": op7_subset_sum_mix, "op8_segment_popcount_simhash": op8_segment_popcount_simhash, "op9_block_naming_dedup": op9_block_naming_dedup, "op10_line_first_rules": op10_line_first_rules, "op11_vantage_point_clusters": op11_vantage_point_clusters, "op12_sorted_list_variants": op12_sorted_list_variants, "op13_boosted_toxicity": op13_boosted_toxicity}
ORACLES = {"op9_block_naming_dedup": OP9_SQL, "op10_line_first_rules": OP10_SQL, "op11_vantage_point_clusters": OP11_SQL}
