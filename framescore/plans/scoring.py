"""Queries of argument scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from framescore.operators import align as A
from framescore.operators import scores as S
from framescore.operators.stages import written

from .identity import SQL_OLD
from .registry import once, query
from .tables import CLASS

K = ", ".join(CLASS)
#: Further common table expressions: aligned cells of each system and class.
ALIGN = f""", resp AS (SELECT r.*, canon, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS old_id FROM (SELECT *, CAST({SQL_OLD} AS BIGINT) AS h FROM responses) r JOIN canonical USING (doc_id, cas, cas_start, cas_end)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system_id, {K} ORDER BY confidence DESC, old_id DESC, response_id DESC) AS rn FROM resp) WHERE rn = 1),
keyrows AS (SELECT a.*, canon FROM assessments a JOIN canonical USING (doc_id, cas, cas_start, cas_end) WHERE is_assessed),
keyc AS (SELECT {K} FROM keyrows WHERE response_id IN (SELECT response_id FROM correct) GROUP BY ALL),
wanted AS (SELECT system_id, {K} FROM keyc, (SELECT DISTINCT system_id FROM responses)),
bestx AS (SELECT system_id, {K}, b.response_id IN (SELECT response_id FROM keyrows) AS known, b.response_id IN (SELECT response_id FROM correct) AS is_right FROM best b),
align0 AS (SELECT system_id, {K}, w.in_key, known, is_right FROM (SELECT *, 1 AS in_key FROM wanted) w FULL JOIN bestx USING (system_id, {K})),
aligned AS (SELECT system_id, {K}, unnest(CASE WHEN in_key IS NULL THEN ['FP'] WHEN is_right IS NULL THEN ['FN'] WHEN is_right THEN ['TP'] WHEN known THEN ['FP', 'FN'] ELSE ['unassessed'] END) AS cell FROM align0),
doc_counts AS (SELECT system_id, doc_id, count(*) FILTER (cell = 'TP') AS tp, count(*) FILTER (cell IN ('FP', 'unassessed')) AS fp, count(*) FILTER (cell = 'FN') AS fn FROM aligned GROUP BY ALL)"""
COUNTS = "count(*) FILTER (cell = 'TP') AS tp, count(*) FILTER (cell IN ('FP', 'unassessed')) AS fp, count(*) FILTER (cell = 'FN') AS fn"
PRF = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1"


@once
def _aligned(t):
    return A.align_judged(t.judged, CLASS, t.systems)


def counts_by(t, by: list[str]):
    return A.counted_judged(t.judged, CLASS, by, t.systems)


def doc_counts(t):
    return counts_by(t, ["doc_id"])


@once
def written_counts(t):
    """doc_counts, written once for all steps of a query that read them."""
    return written(doc_counts(t))


@query("sco1_trfr_alignment", f"{ALIGN} SELECT system_id, {K}, cell FROM aligned")
def sco1(t):
    return _aligned(t)


@query("wn1_best_response", f"{ALIGN} SELECT system_id, {K}, response_id, confidence FROM best")
def wn1(t):
    return A.best_response(A.canonicalised(t.responses, t.canonical), ["system_id", *CLASS]).select("system_id", *CLASS, "response_id", "confidence")


@query("ag1_confusion_cells", f"{ALIGN} SELECT system_id, cell, count(*) AS n FROM aligned GROUP BY ALL")
def ag1(t):
    return _aligned(t).groupBy("system_id", "cell").agg(F.count(F.lit(1)).alias("n"))


GENRE = "CASE WHEN doc_id LIKE 'D1%' THEN 'newswire' WHEN doc_id LIKE 'D2%' THEN 'forum' ELSE 'other' END"


@query(
    "ag2_breakdown",
    f"""{ALIGN}, k AS (SELECT system_id, cell, unnest([{{'kind': 'Aggregate', 'key': ''}}, {{'kind': 'Type', 'key': event_type}}, {{'kind': 'TypeRole', 'key': event_type || '.' || role}},
    {{'kind': 'Genre', 'key': {GENRE}}}, {{'kind': 'DocId', 'key': doc_id}}, {{'kind': 'Realis', 'key': realis}}]) AS k FROM aligned)
    SELECT system_id, k.kind AS kind, k.key AS "key", {COUNTS} FROM k GROUP BY ALL""",
)
def ag2(t):
    genre = F.when(F.col("doc_id").startswith("D1"), "newswire").when(F.col("doc_id").startswith("D2"), "forum").otherwise("other")
    kinds = {"Aggregate": F.lit(""), "Type": F.col("event_type"), "TypeRole": F.concat_ws(".", "event_type", "role"), "Genre": genre, "DocId": F.col("doc_id"), "Realis": F.col("realis")}
    return S.breakdown(_aligned(t), kinds)


@query("ag3_precision_recall_f", f"{ALIGN}, c AS (SELECT system_id, event_type, {COUNTS} FROM aligned GROUP BY ALL) SELECT *, {PRF} FROM c")
def ag3(t):
    return S.with_f(counts_by(t, ["event_type"])).orderBy(F.desc(F.col("fp") + F.col("fn")))


_GROUP = "CASE WHEN event_type LIKE 'Life%' THEN 'Life' WHEN event_type LIKE 'Contact%' THEN 'Contact' ELSE 'Other' END"


@query("ag4_doc_f_by_group", f"{ALIGN}, c AS (SELECT system_id, doc_id, {_GROUP} AS type_group, {COUNTS} FROM aligned GROUP BY ALL) SELECT *, {PRF} FROM c")
def ag4(t):
    group = F.when(F.col("event_type").startswith("Life"), "Life").when(F.col("event_type").startswith("Contact"), "Contact").otherwise("Other")
    return S.with_f(A.cells(_aligned(t).withColumn("type_group", group), ["system_id", "doc_id", "type_group"]))


@query("ag5_linear_score_2016", f"{ALIGN} SELECT system_id, 100 * sum(greatest(tp - 0.25e0 * fp, 0)) / greatest(sum(tp + fn), 1) AS linear FROM doc_counts GROUP BY ALL")
def ag5(t):
    return S.linear_score_2016(doc_counts(t))


@query("ag5_doc_linear_score_2016", f"{ALIGN} SELECT system_id, doc_id, 100 * greatest(tp - 0.25e0 * fp, 0) / greatest(tp + fn, 1) AS linear FROM doc_counts")
def ag5d(t):
    return S.doc_linear_score_2016(doc_counts(t))


@query(
    "argument_score",
    f"{ALIGN} SELECT system_id, 100 * sum(greatest(tp - 0.25e0 * fp, 0)) / sum(tp + fn) AS score, 100 * sum(tp) / sum(tp + fp) AS precision, 100 * sum(tp) / sum(tp + fn) AS recall FROM doc_counts GROUP BY ALL",
)
def ag6(t):
    return S.argument_score_2015(doc_counts(t))


@query("ag6_doc_argument_score_2015", f"{ALIGN} SELECT system_id, doc_id, tp - 0.25e0 * fp AS score, CASE WHEN tp + fn > 0 THEN (tp - 0.25e0 * fp) / (tp + fn) END AS scaled FROM doc_counts")
def ag6d(t):
    return S.doc_argument_score_2015(doc_counts(t))


@query(
    "ag11_argument_score_by_type",
    f"{ALIGN}, c AS (SELECT system_id, event_type, doc_id, {COUNTS} FROM aligned GROUP BY ALL) SELECT system_id, event_type, 100 * sum(greatest(tp - 0.25e0 * fp, 0)) / sum(tp + fn) AS score FROM c GROUP BY ALL",
)
def ag11(t):
    c = counts_by(t, ["event_type", "doc_id"])
    gained = F.sum(F.greatest(F.col("tp") - 0.25 * F.col("fp"), F.lit(0.0)))
    return c.groupBy("system_id", "event_type").agg((100 * gained / F.sum(F.col("tp") + F.col("fn"))).alias("score"))


@query(
    "ag28_what_if",
    f"""{ALIGN}, c AS (SELECT system_id, event_type AS k, {COUNTS} FROM aligned GROUP BY ALL), s AS (SELECT system_id, sum(tp) a, sum(fp) b, sum(fn) c FROM c GROUP BY ALL)
    SELECT c.system_id, c.k AS "key", 2 * a / (2 * a + b - fp + s.c) - 2 * a / (2 * a + b + s.c) AS perfect_precision, 2 * (a + fn) / (2 * (a + fn) + b + s.c - fn) - 2 * a / (2 * a + b + s.c) AS perfect_recall,
    2 * (a + fn) / (2 * (a + fn) + b - fp + s.c - fn) - 2 * a / (2 * a + b + s.c) AS perfect_both FROM c JOIN s USING (system_id)""",
)
def ag28(t):
    return S.what_if(counts_by(t, ["event_type"]).withColumnRenamed("event_type", "key"))


#: As many as the reference's document-level and corpus-level scorers take.
SAMPLES = 1000
DRAWN = f""", units AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM doc_counts)),
drawn AS (SELECT sample, doc_id, count(*) AS times FROM (SELECT sample, CAST('0x' || substr(md5('0|' || sample || '|' || k), 1, 8) AS BIGINT) % (SELECT max(n) FROM units) AS ordinal
  FROM range({SAMPLES}) s(sample), (SELECT unnest(range((SELECT max(n) FROM units))) AS k)) JOIN units USING (ordinal) GROUP BY ALL)"""
DRAWS = f"""{DRAWN}, boot AS (SELECT sample, system_id, sum(times * tp) AS tp, sum(times * fp) AS fp, sum(times * fn) AS fn, 100 * sum(times * greatest(tp - 0.25e0 * fp, 0)) / sum(times * (tp + fn)) AS score FROM doc_counts JOIN drawn USING (doc_id) GROUP BY ALL)"""


@once
def _boot(t):
    counts = written_counts(t)
    drawn = S.drawn_samples(counts.select("doc_id").distinct(), "doc_id", SAMPLES)
    w = lambda c: F.sum(F.col("times") * c)
    gained = w(F.greatest(F.col("tp") - 0.25 * F.col("fp"), F.lit(0.0)))
    return S.bootstrapped(counts, drawn, "doc_id", ["system_id"], {"tp": w(F.col("tp")), "fp": w(F.col("fp")), "fn": w(F.col("fn")), "score": 100 * gained / w(F.col("tp") + F.col("fn"))})


@query("ag14_bootstrap", f"{ALIGN}{DRAWS} SELECT sample, system_id, tp, fp, fn, score, {PRF} FROM boot")
def ag14(t):
    return S.with_f(_boot(t))


_POINTS = [0.005, 0.025, 0.25, 0.5, 0.75, 0.975, 0.995]


@query(
    "ag16_nist_percentiles",
    f"""{ALIGN}{DRAWS}, v AS (SELECT system_id, list_sort(list(score)) AS v, count(*) AS n FROM boot GROUP BY ALL), p AS (SELECT system_id, v, n, unnest(CAST({_POINTS} AS DOUBLE[])) AS p FROM v),
    q AS (SELECT *, least(greatest(p * (n + 1), 1.0), n) AS r FROM p)
    SELECT system_id, p, v[CAST(floor(r) AS INT)] + (r - floor(r)) * (v[least(CAST(floor(r) AS INT) + 1, n)] - v[CAST(floor(r) AS INT)]) AS "value" FROM q""",
)
def ag16(t):
    return S.percentiles(_boot(t), ["system_id"], "score", _POINTS)
