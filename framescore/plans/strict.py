"""Queries of invariants: what breaks them, results under them, and counters taken in the pass of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F

from framescore.operators import align as A
from framescore.operators import filters as FI
from framescore.operators import invariants as I  # noqa: E741
from framescore.operators import linking as L
from framescore.operators import pipelines as P
from framescore.operators import stores as ST
from framescore.sources import scans

from .files import _CQ, _QR, _frames, _query_responses, _ranked
from .links import LIFT, _rows, lifted
from .registry import query


_FIELDS = ", ".join(I.ASSESSMENT)
_SET = f"{{{', '.join(f"'{f}': {f}" for f in I.ASSESSMENT)}}}"
_BOTH = f", both_ AS (SELECT response_id, {_FIELDS} FROM assessments UNION ALL SELECT response_id, {_FIELDS} FROM assessments UNION ALL SELECT response_id, {_FIELDS} FROM second_assessments)"


def _both(t):
    """The key twice, and the other annotator's."""
    pick = lambda d: d.select("response_id", *I.ASSESSMENT)
    return pick(t.assessments).unionByName(pick(t.assessments)).unionByName(pick(t.second_assessments))


@query("jn1_conflicting_assessments", f"{_BOTH} SELECT response_id, count(DISTINCT {_SET}) AS assessments FROM both_ GROUP BY ALL HAVING count(DISTINCT {_SET}) > 1")
def jn1_conflicts(t):
    return I.conflicting_assessments(_both(t))


@query("jn1_one_assessment", f"SELECT system_id, r.response_id, {_FIELDS} FROM responses r LEFT JOIN assessments a USING (response_id)")
def jn1_one(t):
    """A key that repeats every row: equal rows are one assessment."""
    twice = t.assessments.select("response_id", *I.ASSESSMENT)
    return I.assessed_responses(t.responses.select("system_id", "response_id"), twice.unionByName(twice), "left", strict=True)


@query("jn2_completely_assessed", "SELECT system_id, response_id FROM responses SEMI JOIN (SELECT response_id FROM assessments WHERE is_assessed) USING (response_id)")
def jn2(t):
    """Responses that the key assesses are complete under it."""
    some = I.completely_assessed(t.responses, t.assessments, strict=False)
    return I.completely_assessed(some, t.assessments).select("system_id", "response_id")


@query("jn3_canonical_cas_optional", ", c AS (SELECT * FROM canonical WHERE coref_id LIKE 'c1%') SELECT DISTINCT response_id, canon FROM responses JOIN c USING (doc_id, cas, cas_start, cas_end)")
def jn3(t):
    return A.canonicalised(t.responses, t.canonical.filter("coref_id LIKE 'c1%'"), "optional").select("response_id", "canon").distinct()


@query("sc6_known_responses", ", known AS (SELECT DISTINCT response_id FROM responses WHERE role <> 'Place') SELECT system_id || '/' || doc_id AS path, CASE frame_id WHEN 'f0' THEN 'INCOMPLETE' ELSE frame_id[2:] END AS frame_id, response_id FROM linking SEMI JOIN known USING (response_id)")
def sc6(t):
    """Linking files that name responses of all roles, read against those of other roles than Place."""
    line = F.when(F.col("line_no") == 0, F.regexp_replace("line", "^f0", "INCOMPLETE")).otherwise(F.regexp_replace("line", "^f.\t", ""))
    frames, rest = scans.linking_2015(_frames(t).withColumn("line", line), t.responses.filter("role <> 'Place'"), strict=False)
    return frames.unionByName(rest.select("path", F.lit("INCOMPLETE").alias("frame_id"), "response_id"))


@query("so3_disjoint_stores", "SELECT doc_id, response_id, system_id FROM responses")
def so3(t):
    """All responses as two stores without a common document."""
    odd = F.crc32("doc_id") % 2 == 1
    return ST.merge_disjoint(t.responses.filter(odd), t.responses.filter(~odd), strict=True)[0].select("doc_id", "response_id", "system_id")


_RANKS = "CASE {a} WHEN 1 THEN 'ET_MATCH' WHEN 2 THEN 'WRONG' WHEN 3 THEN 'CORRECT' END"
#: A second store of query responses: later query responses are missing, some systems are others, and one in three documents is assessed anew.
_TWO = f"""{_QR}, one AS (SELECT query_id, doc_id, s, unnest(systems) AS system_id, {_RANKS.format(a='a')} AS assessment FROM qr),
two AS (SELECT query_id, doc_id, s, 'x' || system_id AS system_id, CASE WHEN doc_no3 THEN {_RANKS.format(a='(a + 1) % 4')} ELSE {_RANKS.format(a='a')} END AS assessment FROM (SELECT *, unnest(systems) AS system_id, CAST(doc_id[2:] AS BIGINT) % 3 = 0 AS doc_no3 FROM qr) WHERE s < 280),
merged2 AS (SELECT query_id, doc_id, s, list_sort(list(DISTINCT system_id)) AS systems, list_sort(list(DISTINCT assessment) FILTER (assessment IS NOT NULL)) AS given FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY ALL)"""


def _two_stores(t):
    d = _query_responses(t).withColumn("system_id", F.explode("systems"))
    name = lambda a: F.when(a == 1, "ET_MATCH").when(a == 2, "WRONG").when(a == 3, "CORRECT")
    one = d.select("query_id", "doc_id", "s", "system_id", name(F.col("a")).alias("assessment"))
    anew = F.substring("doc_id", 2, 18).cast("long") % 3 == 0
    two = d.filter("s < 280").select("query_id", "doc_id", "s", F.concat(F.lit("x"), "system_id").alias("system_id"), F.when(anew, name((F.col("a") + 1) % 4)).otherwise(name(F.col("a"))).alias("assessment"))
    return one.unionByName(two)


@query("so7_conflicting_stores", f"{_TWO} SELECT query_id, doc_id, s, array_to_string(given, ',') AS given FROM merged2 WHERE len(given) > 1")
def so7_conflicts(t):
    return ST.merge_query_responses(_two_stores(t), ["query_id", "doc_id", "s"])[1].select("query_id", "doc_id", "s", F.array_join("given", ",").alias("given"))


@query("so7_merged_stores", f"{_TWO} SELECT query_id, doc_id, s, array_to_string(systems, ',') AS systems, coalesce(given[1], 'UNASSESSED') AS assessment FROM merged2 WHERE coalesce(len(given), 0) < 2")
def so7_merged(t):
    """Both stores without what they disagree on, under the invariant."""
    keys = ["query_id", "doc_id", "s"]
    stores = _two_stores(t)
    agreed = stores.join(ST.merge_query_responses(stores, keys)[1].select(*keys), keys, "left_anti")
    return ST.merge_query_responses(agreed, keys, strict=True)[0]


@query("sco3_outside_gold", f"{LIFT} SELECT DISTINCT l.system_id, l.doc_id, c.item FROM linking l JOIN cls c USING (response_id) WHERE (l.doc_id, c.item) NOT IN (SELECT doc_id, item FROM glift)")
def sco3(t):
    every = L.lift(_rows(t).filter("realis <> 'Generic'"), None, ["system_id", "doc_id", "frame_id"])
    return I.outside_gold(lifted(t)[0], every, ["system_id", "doc_id"])


@query("sco3_strict_link_f1", f"{LIFT} SELECT * FROM linkf")
def sco3_strict(t):
    return L.link_f1(*lifted(t), t.systems, strict=True)


@query("sco7_assessed_only", f"{_CQ.replace('FROM merged)', 'FROM merged WHERE a > 0)')} SELECT * FROM cq")
def sco7(t):
    """Queries and systems with an assessed response; none is unassessed."""
    return P.corpus_score(_ranked(t).filter("a > 0"), 3, drop_unassessed=False, strict=True)[0]


def _counted(t, rows: DataFrame, counts: Observation) -> DataFrame:
    """(counter, n) of an observation, after rows have been read once."""
    rows.write.format("noop").mode("overwrite").save()
    return t.spark.createDataFrame([Row(counter=k, n=v) for k, v in counts.get.items()], "counter string, n long")


@query(
    "sc4_counts_in_the_pass",
    """, k AS (SELECT CASE WHEN cas_start % 50 = 0 THEN NULL ELSE aet END AS aet, aer, CASE WHEN role = 'Agent' THEN NULL ELSE cas_ok END AS cas_ok, bf_ok, a_realis, mention_type, is_assessed, coref_id LIKE 't:%' AS alone FROM assessments JOIN canonical USING (doc_id, cas, cas_start, cas_end)),
    j AS (SELECT *, coalesce(aet <> 'W', false) AS g1, coalesce(aer <> 'W', false) AS g2, (cas_ok IS NULL OR bf_ok IS NULL OR a_realis IS NULL OR mention_type IS NULL) AS lacking, coalesce(cas_ok, bf_ok, a_realis, mention_type) IS NOT NULL AS more FROM k),
    r AS (SELECT *, CASE WHEN is_assessed AND (aet IS NULL OR (g1 AND aer IS NULL) OR (g1 AND g2 AND lacking)) THEN 1 WHEN is_assessed AND NOT (g1 AND g2) AND more THEN 2 ELSE 0 END AS repair FROM j)
    SELECT 'made_unassessed' AS counter, count(*) FILTER (repair = 1) AS n FROM r UNION ALL SELECT 'fields_removed', count(*) FILTER (repair = 2) FROM r UNION ALL SELECT 'singletons', count(*) FILTER (repair = 0 AND alone AND cas_ok <> 'W') FROM r""",
)
def sc4(t):
    on = ["doc_id", "cas", "cas_start", "cas_end"]
    own = F.when(~F.col("coref_id").like("t:%"), F.col("coref_id"))
    broken = t.assessments.join(t.canonical.select(*on, own.alias("coref_id")), on).withColumn("aet", F.when(F.col("cas_start") % 50 != 0, F.col("aet"))).withColumn("cas_ok", F.when(F.col("role") != "Agent", F.col("cas_ok")))
    counts = Observation()
    return _counted(t, scans.recovered(broken, counts), counts)


@query("so4_counts_in_the_pass", ", k AS (SELECT * FROM assessments WHERE event_type <> 'Contact.Meet') SELECT 'known' AS counter, count(*) AS n FROM k UNION ALL SELECT 'added', count(DISTINCT response_id) FROM responses WHERE response_id NOT IN (SELECT response_id FROM k)")
def so4(t):
    counts = Observation()
    return _counted(t, ST.add_unassessed(t.assessments.filter("event_type <> 'Contact.Meet'"), t.responses, counts), counts)


@query(
    "pf14_counts_in_the_pass",
    """, k AS (SELECT doc_id, event_type, is_assessed AND doc_id LIKE '%7' AS is_assessed FROM assessments), m AS (SELECT CASE WHEN doc_id NOT LIKE 'D1%' THEN 'unlisted' WHEN bool_or(is_assessed) OVER (PARTITION BY doc_id) THEN 'assessed' WHEN event_type NOT IN ('Life.Die', 'Contact.Meet') THEN 'other_type' ELSE 'kept' END AS why FROM k)
    SELECT 'rows' AS counter, count(*) AS n FROM m UNION ALL SELECT why, count(*) FROM m GROUP BY ALL""",
)
def pf14(t):
    key = t.assessments.withColumn("is_assessed", F.col("is_assessed") & F.col("doc_id").endswith("7"))
    docs = t.rows.select("doc_id").filter(F.col("doc_id").startswith("D1")).distinct()
    counts = Observation()
    return _counted(t, FI.restrict(key, docs, ["Life.Die", "Contact.Meet"], counts), counts)
