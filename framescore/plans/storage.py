"""Queries over stores, coreference, validation and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framescore.functions import scalars as X
from framescore.operators import align as A
from framescore.operators import coref as C
from framescore.operators import reports as R
from framescore.operators import scores as SC
from framescore.operators import stores as S
from framescore.operators import validate as V
from framescore.operators.ranks import with_ordinal

from .registry import query
from .scoring import ALIGN, _aligned, doc_counts
from .tables import CLASS

_FIELDS = ", ".join(R.FIELDS)


@query("so1_pool_max_score", "SELECT doc_id, response_id, max(confidence) AS confidence, 'm' || min(CAST(system_id[4:4] AS INT)) FILTER (confidence = m) AS metadata FROM (SELECT *, max(confidence) OVER (PARTITION BY response_id) AS m FROM responses) GROUP BY ALL")
def so1(t):
    n = F.substring("system_id", 4, 1)
    stores = t.responses.select("doc_id", "response_id", "confidence", F.concat(F.lit("m"), n).alias("metadata"), n.cast("int").alias("store_ordinal"))
    return S.pool(stores, ["doc_id"])


@query("so3_merge_stores", ", a AS (SELECT * FROM responses WHERE CAST(doc_id[2:] AS BIGINT) % 3 <> 0), b AS (SELECT * REPLACE ('new' || system_id AS system_id) FROM responses WHERE CAST(doc_id[2:] AS BIGINT) % 3 <> 1) SELECT doc_id, response_id, system_id FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b) UNION ALL SELECT doc_id, response_id, system_id FROM b")
def so3(t):
    """Two stores of all systems that share a third of the documents; the second replaces those of the first."""
    n = F.substring("doc_id", 2, 18).cast("long") % 3
    a, b = t.responses.filter(n != 0), t.responses.filter(n != 1).withColumn("system_id", F.concat(F.lit("new"), "system_id"))
    return S.merge_disjoint(a, b, overwrite=True)[0].select("doc_id", "response_id", "system_id")


@query(
    "so3_fresh_corpus_frames",
    """, a AS (SELECT * FROM corpus_linking WHERE system_id IN ('sys0', 'sys2')), b AS (SELECT * FROM corpus_linking WHERE system_id IN ('sys1', 'sys3')),
    c AS (SELECT corpus_frame_id, hex(65536 + row_number() OVER (ORDER BY corpus_frame_id)) AS new_id FROM (SELECT DISTINCT corpus_frame_id FROM b WHERE corpus_frame_id IN (SELECT corpus_frame_id FROM a)))
    SELECT coalesce(new_id, b.corpus_frame_id) AS corpus_frame_id, doc_id, frame_id FROM b LEFT JOIN c USING (corpus_frame_id)""",
)
def so3f(t):
    a, b = t.corpus_linking.filter("system_id IN ('sys0', 'sys2')"), t.corpus_linking.filter("system_id IN ('sys1', 'sys3')")
    return S.fresh_corpus_frames(a, b).select("corpus_frame_id", "doc_id", "frame_id")


@query("so4_add_unassessed", ", k AS (SELECT * FROM assessments WHERE event_type <> 'Contact.Meet') SELECT response_id, is_assessed FROM k UNION ALL SELECT DISTINCT response_id, false FROM responses WHERE response_id NOT IN (SELECT response_id FROM k)")
def so4(t):
    return S.add_unassessed(t.assessments.filter("event_type <> 'Contact.Meet'"), t.responses)


@query("so5_fallback_key", f"SELECT response_id, {_FIELDS} FROM assessments WHERE is_assessed UNION ALL SELECT response_id, {_FIELDS} FROM second_assessments WHERE is_assessed AND response_id NOT IN (SELECT response_id FROM assessments WHERE is_assessed)")
def so5(t):
    pick = lambda d: d.select("response_id", "is_assessed", *R.FIELDS)
    return S.with_fallback(pick(t.assessments), pick(t.second_assessments)).select("response_id", *R.FIELDS)


@query("so6_merge_assessments", f"SELECT response_id, CASE WHEN a.is_assessed THEN true ELSE b.is_assessed END AS is_assessed, CASE WHEN a.is_assessed THEN a.aet WHEN b.is_assessed THEN b.aet END AS aet FROM assessments a JOIN second_assessments b USING (response_id)")
def so6(t):
    pick = lambda d: d.select("response_id", "is_assessed", "aet")
    return S.merge_assessments(pick(t.assessments), pick(t.second_assessments))


@query("so10_unannotated_copy", "SELECT response_id, false AS is_assessed, CAST(NULL AS VARCHAR) AS aet FROM assessments")
def so10(t):
    return t.assessments.select("response_id", F.lit(False).alias("is_assessed"), F.lit(None).cast("string").alias("aet"))


@query("jn2_missing_from_key", "SELECT DISTINCT response_id FROM responses WHERE response_id NOT IN (SELECT response_id FROM assessments WHERE is_assessed)")
def jn2(t):
    return t.responses.select("response_id").distinct().join(t.assessments.filter("is_assessed").select("response_id"), "response_id", "left_anti")


@query("jn3_canonical_cas", "SELECT DISTINCT response_id, canon FROM responses JOIN canonical USING (doc_id, cas, cas_start, cas_end)")
def jn3(t):
    return A.canonicalised(t.responses, t.canonical).select("response_id", "canon").distinct()


@query("jn3_canonical_cas_lax", ", c AS (SELECT * FROM canonical WHERE coref_id LIKE 'c1%') SELECT DISTINCT response_id, coalesce(canon, r.cas || '@' || r.cas_start || '-' || r.cas_end) AS canon FROM responses r LEFT JOIN c USING (doc_id, cas, cas_start, cas_end)")
def jn3l(t):
    return A.canonicalised(t.responses, t.canonical.filter("coref_id LIKE 'c1%'"), "lax").select("response_id", "canon").distinct()


@query("jn6_two_sided_alignment", """, l AS (SELECT doc_id, event_type, string_agg(DISTINCT role, ',' ORDER BY role) AS x FROM responses WHERE system_id IN ('sys0', 'sys2') GROUP BY ALL), r AS (SELECT doc_id, event_type, string_agg(DISTINCT role, ',' ORDER BY role) AS y FROM responses WHERE system_id IN ('sys1', 'sys3') GROUP BY ALL)
    SELECT doc_id, event_type, coalesce(x, '') AS left_items, coalesce(y, '') AS right_items, CASE WHEN y IS NULL THEN 'left' WHEN x IS NULL THEN 'right' ELSE 'both' END AS sides FROM l FULL JOIN r USING (doc_id, event_type)""")
def jn6(t):
    return A.two_sided(t.responses.filter("system_id IN ('sys0', 'sys2')"), t.responses.filter("system_id IN ('sys1', 'sys3')"), ["doc_id", "event_type"], "role")


@query("jn22_import_foreign_ids", "SELECT system_id, doc_id, frame_id, response_id FROM linking WHERE response_id NOT LIKE '0%'")
def jn22(t):
    ids = t.responses.filter("response_id NOT LIKE '0%'").select("system_id", F.concat(F.lit("x"), F.reverse("response_id")).alias("foreign_id"), "response_id")
    foreign = t.linking.withColumn("response_id", F.concat(F.lit("x"), F.reverse("response_id")))
    return S.import_ids(foreign, ids)[0].select("system_id", "doc_id", "frame_id", "response_id")


@query(
    "jn22_import_corpus_linking",
    """, l AS (SELECT * FROM linking UNION ALL SELECT system_id, doc_id, 'a1', response_id FROM linking WHERE frame_id = 'f1' AND doc_id LIKE '%4'), s AS (SELECT system_id, doc_id, frame_id, list_sort(list(DISTINCT response_id)) AS m FROM l GROUP BY ALL),
    n AS (SELECT system_id, doc_id, frame_id, min(frame_id) OVER (PARTITION BY system_id, doc_id, m) AS new_id FROM s), c AS (SELECT * REPLACE (CASE WHEN doc_id LIKE '%9' THEN 'lost' ELSE frame_id END AS frame_id) FROM corpus_linking)
    SELECT DISTINCT system_id, corpus_frame_id, doc_id, coalesce(new_id, 'unknown: ' || c.frame_id) AS frame_id FROM c LEFT JOIN n USING (system_id, doc_id, frame_id)""",
)
def jn22_corpus(t):
    double = t.linking.filter("frame_id = 'f1' AND doc_id LIKE '%4'").withColumn("frame_id", F.lit("a1"))
    corpus = t.corpus_linking.withColumn("frame_id", F.when(F.col("doc_id").like("%9"), "lost").otherwise(F.col("frame_id")))
    here, unknown = S.import_corpus_linking(corpus, S.collapsed_frames(t.linking.unionByName(double)))
    return here.unionByName(unknown.distinct().withColumn("frame_id", F.concat(F.lit("unknown: "), "frame_id")))


@query("jn23_prune_corpus_linking", "SELECT * FROM corpus_linking WHERE (system_id, doc_id, frame_id) IN (SELECT system_id, doc_id, frame_id FROM linking l WHERE response_id IN (SELECT response_id FROM correct))")
def jn23(t):
    alive = t.linking.join(t.correct.select("response_id"), "response_id", "left_semi").select("system_id", "doc_id", "frame_id").distinct()
    return t.corpus_linking.join(alive, ["system_id", "doc_id", "frame_id"], "left_semi").select(*t.corpus_linking.columns)


@query("jn25_intersect_stores", "SELECT response_id FROM assessments WHERE is_assessed AND response_id IN (SELECT response_id FROM second_assessments WHERE is_assessed)")
def jn25(t):
    return t.assessments.filter("is_assessed").join(t.second_assessments.filter("is_assessed").select("response_id"), "response_id", "left_semi").select("response_id")


@query("cf1_singletons", "SELECT doc_id, cas, cas_start, cas_end, CASE WHEN coref_id LIKE 't:%' THEN 's' || md5(doc_id || '|' || cas || '|' || cas_start || '|' || cas_end) ELSE coref_id END AS coref_id FROM coref")
def cf1(t):
    loose = t.coref.withColumn("coref_id", F.when(~F.col("coref_id").startswith("t:"), F.col("coref_id")))
    return C.singletons(loose).select("doc_id", "cas", "cas_start", "cas_end", "coref_id")


@query(
    "cf2_merge_coref",
    """, base AS (SELECT DISTINCT doc_id, cas, coref_id AS b FROM coref WHERE cas_start % 75 <> 0), more AS (SELECT doc_id, cas, min('x' || (cas_start % 50) || coref_id[1:1]) AS c FROM coref GROUP BY ALL),
    bb AS (SELECT doc_id, cas, min(b) AS b FROM base GROUP BY ALL), j AS (SELECT m.doc_id, m.cas, c, b FROM more m LEFT JOIN bb USING (doc_id, cas)),
    v AS (SELECT doc_id, c, b AS t FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, c ORDER BY n DESC, b) AS rn FROM (SELECT doc_id, c, b, count(*) AS n FROM j WHERE b IS NOT NULL GROUP BY ALL)) WHERE rn = 1),
    f AS (SELECT doc_id, c, 'new' || (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1) AS t FROM (SELECT doc_id, c, min(cas) AS first FROM j WHERE b IS NULL AND (doc_id, c) NOT IN (SELECT doc_id, c FROM v) GROUP BY ALL))
    SELECT doc_id, cas, b AS coref_id FROM bb UNION ALL SELECT j.doc_id, j.cas, t FROM j JOIN (SELECT * FROM v UNION ALL SELECT * FROM f) USING (doc_id, c) WHERE b IS NULL""",
)
def cf2(t):
    """Two annotators' clusters of every document: the second, who sees all CASes, clusters them differently."""
    first = t.coref.filter("cas_start % 75 <> 0").select("doc_id", "cas", "coref_id").distinct()
    second = t.coref.select("doc_id", "cas", F.concat(F.lit("x"), (F.col("cas_start") % 50).cast("string"), F.substring("coref_id", 1, 1)).alias("coref_id"))
    return C.merge(first, second)


@query("cf3_inconsistent_coref", "SELECT doc_id, cas, CAST(count(DISTINCT coref_id) AS BIGINT) AS ids FROM (SELECT doc_id, 'r' || (cas_start % 10) AS cas, coref_id FROM coref) GROUP BY ALL HAVING count(DISTINCT coref_id) > 1")
def cf3(t):
    d = t.coref.withColumn("cas", F.concat(F.lit("r"), (F.col("cas_start") % 10).cast("string")))
    return C.inconsistent(d, ["doc_id", "cas"]).select("doc_id", "cas", "ids")


@query("va2_invalid_roles", "SELECT system_id, doc_id, response_id, 'role' AS \"check\", 'error' AS severity FROM responses WHERE event_type = 'Contact.Meet' AND role = 'Victim'")
def va2(t):
    return V.violations(t.responses, "role", (F.col("event_type") == "Contact.Meet") & (F.col("role") == "Victim"))


@query(
    "va3_span_past_end",
    """, d AS (SELECT 'D' || doc_id AS doc_id, length(text) AS n FROM documents) SELECT system_id, r.doc_id, response_id, 'span past end' AS "check", 'error' AS severity FROM responses r LEFT JOIN d USING (doc_id)
    WHERE n IS NULL OR greatest(cas_end, bf_end, list_max(list_transform(pj, lambda s: s.end)), coalesce(list_max(list_transform(aaj, lambda s: s.end)), 0)) >= n""",
)
def va3(t):
    lengths = t.parquet("documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("doc_id"), F.char_length("text").alias("n"))
    return V.span_past_end(t.responses, lengths)


@query("va5_filler_outside_justification", "SELECT system_id, doc_id, response_id, 'filler outside justification' AS \"check\", 'warning' AS severity FROM responses WHERE len(list_filter(pj, lambda s: s.start <= bf_start AND bf_end <= s.end)) = 0")
def va5(t):
    return V.filler_outside_justification(t.responses)


@query("va6_linked_set", ", l AS (SELECT * FROM linking WHERE response_id NOT LIKE '1%') SELECT DISTINCT system_id, doc_id, response_id, 'not linked' AS \"check\" FROM responses WHERE realis <> 'Generic' AND (system_id, response_id) NOT IN (SELECT system_id, response_id FROM l)")
def va6(t):
    return V.unlinked(t.responses, t.linking.filter("response_id NOT LIKE '1%'"))


_LINKABLE = [("Life.Die", "Life.Injure"), ("Life.Die", "Conflict.Attack"), ("Life.Injure", "Conflict.Attack")]


@query(
    "va7_unlinkable_types",
    f""", t AS (SELECT DISTINCT l.system_id, l.doc_id, l.frame_id, event_type FROM linking l JOIN responses r ON r.system_id = l.system_id AND r.response_id = l.response_id)
    SELECT a.system_id, a.doc_id, a.frame_id, a.event_type AS type_a, b.event_type AS type_b FROM t a JOIN t b USING (system_id, doc_id, frame_id) WHERE a.event_type < b.event_type
    AND (a.event_type, b.event_type) NOT IN (VALUES {', '.join(f"('{min(x)}', '{max(x)}')" for x in _LINKABLE)})""",
)
def va7(t):
    linkable = t.spark.createDataFrame(_LINKABLE, "type_a string, type_b string")
    return V.unlinkable_types(t.linking, t.responses, linkable, ["system_id", "doc_id", "frame_id"]).select("system_id", "doc_id", "frame_id", "type_a", "type_b")


@query("va8_missing_frames", "SELECT system_id, corpus_frame_id, doc_id, frame_id FROM corpus_linking WHERE (system_id, doc_id, frame_id) NOT IN (SELECT system_id, doc_id, frame_id FROM linking WHERE response_id LIKE '%a')")
def va8(t):
    frames = t.linking.filter("response_id LIKE '%a'").select("system_id", "doc_id", "frame_id").distinct()
    return t.corpus_linking.join(frames, ["system_id", "doc_id", "frame_id"], "left_anti").select(*t.corpus_linking.columns)


@query("va9_key_invariants", "SELECT response_id FROM assessments a WHERE cas_ok IN ('C', 'I') AND (doc_id, cas, cas_start, cas_end) NOT IN (SELECT doc_id, cas, cas_start, cas_end FROM coref WHERE coref_id NOT LIKE 'c2%')")
def va9(t):
    clustered = t.coref.filter("coref_id NOT LIKE 'c2%'")
    return t.assessments.filter(F.coalesce(F.col("cas_ok").isin("C", "I"), F.lit(False))).join(clustered, ["doc_id", "cas", "cas_start", "cas_end"], "left_anti").select("response_id")


@query("va12_first_violations", "SELECT system_id, doc_id, response_id, 'filler outside justification' AS \"check\", 'warning' AS severity FROM responses WHERE len(list_filter(pj, lambda s: s.start <= bf_start AND bf_end <= s.end)) = 0 ORDER BY system_id, doc_id, response_id LIMIT 200")
def va12(t):
    return V.at_most(V.filler_outside_justification(t.responses), 200)


PAIRS = f", pairs AS (SELECT response_id, {', '.join(f'l.{f} AS l_{f}, r.{f} AS r_{f}' for f in R.FIELDS)} FROM assessments l JOIN second_assessments r USING (response_id) WHERE l.is_assessed AND r.is_assessed)"
_LONG = ", long AS (SELECT f.* FROM (SELECT unnest([" + ", ".join(f"{{'field': '{f}', 'left_label': l_{f}, 'right_label': r_{f}}}" for f in R.FIELDS) + "]) AS f FROM pairs) WHERE f.left_label IS NOT NULL AND f.right_label IS NOT NULL)"


@query("ag21_annotator_confusion", f"{PAIRS}{_LONG} SELECT field, left_label, right_label, count(*) AS n FROM long GROUP BY ALL")
def ag21(t):
    return R.confusion(R.annotator_pairs(t.assessments, t.second_assessments))


@query("sco10_annotator_agreement", f"{PAIRS}{_LONG} SELECT field, CAST(count(*) AS BIGINT) AS n, count(*) FILTER (left_label = right_label) / count(*) AS accuracy FROM long GROUP BY ALL")
def sco10(t):
    return R.agreement(ag21(t))


@query("jn26_annotator_pairs", f"{PAIRS} SELECT * FROM pairs WHERE response_id NOT IN (SELECT response_id FROM gold_linking)")
def jn26(t):
    return R.annotator_pairs(t.assessments, t.second_assessments, t.gold_linking)


@query("tr22_disagreements", f"{PAIRS} SELECT response_id, l_aet, r_aet FROM pairs WHERE l_aet <> r_aet")
def tr22(t):
    return R.annotator_pairs(t.assessments, t.second_assessments).filter("l_aet <> r_aet").select("response_id", "l_aet", "r_aet")


@query("ag22_overlap_counts", """SELECT count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS left_only, count(*) FILTER (b AND NOT a) AS right_only FROM (SELECT l.is_assessed AS a, r.is_assessed AS b FROM assessments l JOIN second_assessments r USING (response_id))""")
def ag22(t):
    return R.overlap_counts(t.assessments.filter("is_assessed"), t.second_assessments.filter("is_assessed"), "response_id")


_FOUND = ", found AS (SELECT DISTINCT system_id, doc_id || event_type || role || realis || canon AS item FROM aligned WHERE cell = 'TP'), teams AS (SELECT item, count(DISTINCT system_id) AS teams FROM found GROUP BY ALL)"


def _found(t):
    return _aligned(t).filter("cell = 'TP'").select("system_id", F.concat(*CLASS).alias("item"))


def _found_classes(t):
    """What _found has, with a class's columns in place of their concatenation: rows stay where their document lies."""
    return _aligned(t).filter("cell = 'TP'").select("system_id", *CLASS)


@query("ag23_system_overlap", f"{ALIGN}{_FOUND} SELECT system_id, count(*) AS total, count(*) FILTER (teams = 1) AS sole, count(*) FILTER (contains(item, 'Life')) AS with_human, count(*) FILTER (teams > 1) AS other_team FROM found JOIN teams USING (item) GROUP BY ALL")
def ag23(t):
    return R.system_overlap(_found_classes(t), F.concat(*CLASS).contains("Life"), 4, CLASS)


@query("ag24_found_by_teams", f"{ALIGN}{_FOUND} SELECT teams, count(*) AS n FROM teams GROUP BY ALL")
def ag24(t):
    return R.found_by_teams(_found_classes(t), 4, CLASS)


@query("sk12_true_and_false_ids", f"{ALIGN} SELECT DISTINCT system_id, cell, doc_id || event_type || role || realis || canon AS item FROM aligned WHERE cell IN ('TP', 'FP')")
def sk12(t):
    return _aligned(t).filter(F.col("cell").isin("TP", "FP")).select("system_id", "cell", F.concat(*CLASS).alias("item")).distinct()


_SCORE = f"{ALIGN}, sc AS (SELECT system_id, 100 * sum(greatest(tp - 0.25e0 * fp, 0)) / sum(tp + fn) AS score FROM doc_counts GROUP BY ALL)"


def _scores(t):
    return SC.argument_score_2015(doc_counts(t)).select("system_id", "score")


@query("wn7_leaderboard", f"{_SCORE}, b AS (SELECT score AS b FROM sc WHERE system_id = 'sys1') SELECT system_id, score, row_number() OVER (ORDER BY score DESC, system_id) AS rank, CASE WHEN score > b THEN score - b END AS lead FROM sc, b")
def wn7(t):
    return R.leaderboard(_scores(t), "sys1")


@query("wn4_team_medians", f"{_SCORE} SELECT system_id AS team, system_id, score AS best, n > 3 AND (rn = (n + 1) // 2 OR rn = (n + 2) // 2) AS median FROM (SELECT *, row_number() OVER (ORDER BY score, system_id) AS rn, count(*) OVER () AS n FROM sc)")
def wn4(t):
    return R.team_summary(_scores(t), 4)


@query("ag18_event_type_counts", "SELECT event_type, count(DISTINCT response_id) AS args, count(DISTINCT (doc_id, gold_frame)) AS frames FROM ided WHERE realis <> 'Generic' GROUP BY ALL")
def ag18(t):
    return t.ided.filter("realis <> 'Generic'").groupBy("event_type").agg(F.count_distinct("response_id").alias("args"), F.count_distinct("doc_id", "gold_frame").alias("frames")).orderBy(F.desc("args"), "event_type")


@query(
    "ag19_corpus_statistics",
    """, k AS (SELECT c.*, canon FROM correct c JOIN canonical USING (doc_id, cas, cas_start, cas_end)), u AS (SELECT DISTINCT doc_id, event_type, role, realis, canon FROM k)
    SELECT 'type_role' AS what, event_type || '.' || role AS "key", count(*) AS n FROM u GROUP BY ALL UNION ALL SELECT 'realis', realis, count(*) FROM u GROUP BY ALL UNION ALL SELECT 'docs', event_type, count(DISTINCT doc_id) FROM u GROUP BY ALL""",
)
def ag19(t):
    u = A.canonicalised(t.correct, t.canonical).select(*CLASS).distinct()
    count = lambda what, key, n: u.groupBy(key.alias("key")).agg(n.alias("n")).select(F.lit(what).alias("what"), "key", "n")
    one = F.count(F.lit(1))
    return count("type_role", F.concat_ws(".", "event_type", "role"), one).union(count("realis", F.col("realis"), one)).union(count("docs", F.col("event_type"), F.count_distinct("doc_id")))


@query(
    "ag25_recall_analysis",
    """, k AS (SELECT DISTINCT doc_id, event_type, role, canon, a_realis FROM correct JOIN canonical USING (doc_id, cas, cas_start, cas_end)), s AS (SELECT DISTINCT system_id, r.doc_id, event_type, role, canon, realis FROM responses r JOIN canonical USING (doc_id, cas, cas_start, cas_end))
    SELECT k.doc_id, k.event_type, k.role, k.canon, a_realis, """
    + ", ".join(f"coalesce(string_agg(DISTINCT realis, ',' ORDER BY realis) FILTER (system_id = 'sys{i}'), 'N') AS sys{i}" for i in range(4))
    + " FROM k LEFT JOIN s USING (doc_id, event_type, role, canon) GROUP BY ALL",
)
def ag25(t):
    on = ["doc_id", "event_type", "role", "canon"]
    key = A.canonicalised(t.correct, t.canonical).select(*on, "a_realis").distinct()
    found = A.canonicalised(t.responses, t.canonical).groupBy("system_id", *on).agg(F.array_join(F.array_sort(F.collect_set("realis")), ",").alias("r"))
    wide = found.groupBy(*on).pivot("system_id", [f"sys{i}" for i in range(4)]).agg(F.first("r"))
    return key.join(wide, on, "left").na.fill("N", [f"sys{i}" for i in range(4)])


@query("ag20_failures_by_type", "SELECT event_type, role, count(DISTINCT response_id) AS n FROM responses WHERE response_id NOT IN (SELECT response_id FROM correct) GROUP BY ALL")
def ag20(t):
    return t.responses.join(t.correct.select("response_id"), "response_id", "left_anti").groupBy("event_type", "role").agg(F.count_distinct("response_id").alias("n"))


@query("ag27_submission_summary", f"{ALIGN} SELECT system_id, sum(tp) / sum(tp + fp) AS precision, sum(tp) / sum(tp + fn) AS recall, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM doc_counts GROUP BY ALL")
def ag27(t):
    c = doc_counts(t).groupBy("system_id").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    return SC.with_f(c).drop("f1")


def class_places(t):
    """(doc_id, event_type, role, cas, realis, place): the classes of every document in order."""
    from pyspark.sql import Window

    order = ["event_type", "role", "cas", "realis"]
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)).cast("long")
    return t.responses.select("doc_id", *order).distinct().withColumn("place", place)


@query("sl2_class_order", "SELECT DISTINCT event_type, role, cas, realis, dense_rank() OVER (ORDER BY event_type, role, cas, realis) AS place FROM responses")
def sl2(t):
    """The classes of all documents in one order."""
    order = ["event_type", "role", "cas", "realis"]
    return with_ordinal(t.responses.select(*order).distinct(), order, "n").select(*order, (F.col("n") + 1).alias("place"))


@query("sl2_class_order_by_document", "SELECT DISTINCT doc_id, event_type, role, cas, realis, dense_rank() OVER (PARTITION BY doc_id ORDER BY event_type, role, cas, realis) AS place FROM responses")
def sl2_by_document(t):
    return class_places(t)


@query("wn3_earliest_justification", "SELECT event_type, role, cas, doc_id, min(pj[1].start) AS first_start FROM responses GROUP BY ALL")
def wn3(t):
    return t.responses.groupBy("event_type", "role", "cas", "doc_id").agg(F.min(F.get("pj", F.lit(0))["start"]).alias("first_start"))


@query("sl5_seeded_sample", "SELECT system_id, doc_id, frame_id FROM (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY md5('0|' || doc_id || '|' || frame_id)) AS rn FROM (SELECT DISTINCT system_id, doc_id, frame_id FROM linking)) WHERE rn <= 45")
def sl5(t):
    from pyspark.sql import Window

    frames = t.linking.select("system_id", "doc_id", "frame_id").distinct()
    w = Window.partitionBy("system_id").orderBy(F.md5(F.concat(F.lit("0|"), "doc_id", F.lit("|"), "frame_id")))
    return frames.withColumn("n", F.row_number().over(w)).filter("n <= 45").drop("n")


@query("fn8_genre", "SELECT DISTINCT doc_id, CASE WHEN doc_id LIKE 'D12%' THEN 'a' WHEN doc_id LIKE 'D1%' THEN 'b' ELSE 'other' END AS genre FROM rows1")
def fn8(t):
    return t.rows.select("doc_id", X.first_prefix(F.col("doc_id"), [("D12", "a"), ("D1", "b")], "other").alias("genre")).distinct()


_PREFIXES = ["CNN_CF", "CNN_IP_", "CNN_", "CNNHL", "bolt-", "rec.", "NYT_", "OIADVANTAGE", "fsh_", "zz"]
_NAMED = "CASE doc_no % 10 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(_PREFIXES)) + " END || doc_id"
_OF = ["Broadcast conversation", "Broadcast conversation", "Broadcast News", "Broadcast News", "Forum", "Forum", "Newswire", "Blog", "Speech", "Unknown"]


@query("fn8_genre_of_names", f"SELECT DISTINCT {_NAMED} AS name, CASE doc_no % 10 " + " ".join(f"WHEN {k} THEN '{g}'" for k, g in enumerate(_OF)) + " END AS genre FROM rows1")
def fn8_names(t):
    d = t.rows.select(F.expr(_NAMED).alias("name")).distinct()
    return d.select("name", X.genre(F.col("name")).alias("genre"))
