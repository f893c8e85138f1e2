"""Queries of filters, scalar functions and rewritings."""

from __future__ import annotations

from pyspark.sql import functions as F

from framescore.functions import ident
from framescore.functions import scalars as X
from framescore.operators import align as A
from framescore.operators import filters as P
from framescore.operators import transforms as T

from .registry import query
from .tables import CLASS, RESPONSE, SQL_ID

_OK = "is_assessed AND a_realis = realis AND aet IN ('C', 'I') AND aer IN ('C', 'I') AND cas_ok IN ('C', 'I') AND bf_ok IN ('C', 'I')"
_VALID = r"regexp_full_match(cas, '([0-9]{4}|[0-9]{3}[Xx]|[0-9]{2}[Xx]{2}|[0-9][Xx]{3})-([0-9]{2}|[0-9][Xx]|[Xx]{2})-([0-9]{2}|[0-9][Xx]|[Xx]{2})')"
_LESS = """[x for x in list_distinct([day1, day2, mon1, mon2, yr1, yr2, yr3]) if x <> cas]"""


@query("pf1_temporal", "SELECT DISTINCT response_id FROM responses WHERE role IN ('TIME', 'Time')")
def pf1(t):
    return t.responses.filter(X.is_temporal(F.col("role"))).select("response_id").distinct()


@query("pf2_pf3_correctness", f"SELECT response_id, coalesce({_OK}, false) AS up_to_inexact, coalesce({_OK} AND cas_ok = 'C' AND bf_ok = 'C' AND aet = 'C' AND aer = 'C', false) AS complete FROM assessments")
def pf2(t):
    return t.assessments.select("response_id", P.correct_up_to_inexact().alias("up_to_inexact"), P.completely_correct().alias("complete"))


@query("pf4_filter_key", ", kept AS (SELECT * FROM assessments WHERE (is_assessed AND aet = 'C' AND role = 'Place') OR (NOT is_assessed AND role = 'Agent')) SELECT * FROM coref WHERE (doc_id, cas, cas_start, cas_end) IN (SELECT doc_id, cas, cas_start, cas_end FROM kept)")
def pf4(t):
    return P.filter_key(t.assessments, t.coref, F.coalesce((F.col("aet") == "C") & (F.col("role") == "Place"), F.lit(False)), F.col("role") == "Agent")[1]


@query("pf5_linkable", f"SELECT response_id, coalesce({_OK} AND realis IN ('Actual', 'Other'), false) AS for_gold, realis IN ('Actual', 'Other') AS for_system FROM assessments")
def pf5(t):
    return t.assessments.select("response_id", P.linkable_for_gold().alias("for_gold"), P.linkable_for_system().alias("for_system"))


@query("pf6_probable_inference", "SELECT DISTINCT system_id, response_id FROM responses WHERE len(aaj) > 0 OR len(pj) > 1")
def pf6(t):
    return t.responses.filter(P.probable_inference()).select("system_id", "response_id")


_ROLES = [("Life.Die", "Victim"), ("Life.Die", "Agent"), ("Life.Injure", "Victim"), ("Conflict.Attack", "Agent"), ("Contact.Meet", "Agent")]
_ROLE_SQL = "(" + " UNION ALL ".join(f"SELECT '{a}' AS event_type, '{b}' AS role" for a, b in _ROLES) + ")"


@query(
    "pf7_type_and_role_validity",
    f""", ok AS (SELECT * FROM {_ROLE_SQL} UNION SELECT DISTINCT event_type, unnest(['Time', 'Place']) FROM {_ROLE_SQL})
    SELECT system_id, response_id, (event_type, role) IN (SELECT event_type, role FROM ok) AS valid FROM responses""",
)
def pf7(t):
    roles = t.spark.createDataFrame(_ROLES, "event_type string, role string")
    good = P.valid_types_and_roles(t.responses, roles, ["Time", "Place"]).select("system_id", "response_id", F.lit(True).alias("valid"))
    return good.unionByName(P.valid_types_and_roles(t.responses, roles, ["Time", "Place"], keep=False).select("system_id", "response_id", F.lit(False).alias("valid")))


@query("pf12_drop_unannotated", "SELECT system_id, response_id FROM responses WHERE response_id IN (SELECT response_id FROM assessments WHERE is_assessed)")
def pf12(t):
    return t.responses.join(t.assessments.filter("is_assessed").select("response_id"), "response_id", "left_semi").select("system_id", "response_id")


@query("pf13_annotated_rows", "SELECT response_id, aet, aer, cas_ok, bf_ok, a_realis, mention_type FROM assessments WHERE is_assessed")
def pf13(t):
    return t.assessments.filter("is_assessed").select("response_id", "aet", "aer", "cas_ok", "bf_ok", "a_realis", "mention_type")


@query(
    "pf14_restrict_docs_and_types",
    ", k AS (SELECT doc_id, event_type, response_id, is_assessed AND doc_id LIKE '%7' AS is_assessed FROM assessments) SELECT doc_id, event_type, response_id FROM k WHERE doc_id LIKE 'D1%' AND event_type IN ('Life.Die', 'Contact.Meet') AND doc_id IN (SELECT doc_id FROM k GROUP BY doc_id HAVING NOT bool_or(is_assessed))",
)
def pf14(t):
    key = t.assessments.withColumn("is_assessed", F.col("is_assessed") & F.col("doc_id").endswith("7"))
    docs = t.rows.select("doc_id").filter(F.col("doc_id").startswith("D1")).distinct()
    return P.restrict(key, docs, ["Life.Die", "Contact.Meet"]).select("doc_id", "event_type", "response_id")


@query("pf15_sequester", "SELECT DISTINCT doc_id FROM responses WHERE doc_id NOT IN (SELECT DISTINCT doc_id FROM rows1 WHERE doc_no % 7 = 3)")
def pf15(t):
    return t.responses.select("doc_id").distinct().join(t.rows.filter("doc_no % 7 = 3").select("doc_id").distinct(), "doc_id", "left_anti")


@query(
    "pf16_suspicious_assessments",
    f""", k AS (SELECT *, CASE WHEN role = 'Time' AND ent % 3 = 0 THEN replace(cas, '-', '/') WHEN ent % 5 = 0 THEN cas || ' and e1' ELSE cas END AS cas2 FROM (SELECT *, CAST(cas_start / 25 AS INT) AS ent FROM correct)),
    j AS (SELECT * EXCLUDE (cas, cas2), cas2 AS cas FROM k)
    SELECT response_id, 'conjunction' AS reason FROM j WHERE list_has_any(string_split(cas, ' '), ['and', 'or', 'both', 'And', 'Or']) UNION ALL
    SELECT response_id, 'invalid time' FROM j WHERE role = 'Time' AND NOT {_VALID} UNION ALL SELECT response_id, 'inexact place' FROM j WHERE role = 'Place' AND cas_ok = 'I'""",
)
def pf16(t):
    ent = F.expr("cas_start div 25")
    cas = F.when((F.col("role") == "Time") & (ent % 3 == 0), F.replace(F.col("cas"), F.lit("-"), F.lit("/"))).when(ent % 5 == 0, F.concat("cas", F.lit(" and e1"))).otherwise(F.col("cas"))
    return P.suspicious(t.assessments.withColumn("cas", cas)).select("response_id", "reason")


@query("pf17_filtered_copy", "SELECT system_id, response_id, confidence FROM responses WHERE confidence >= 0.5e0")
def pf17(t):
    return t.responses.filter("confidence >= 0.5").select("system_id", "response_id", "confidence")


@query("pf21_split_by_suffix", "SELECT system_id, CASE WHEN doc_id LIKE '%1' THEN '1' WHEN doc_id LIKE '%2' THEN '2' END AS suffix, regexp_replace(doc_id, '[12]$', '') AS doc_id, response_id FROM responses WHERE doc_id LIKE '%1' OR doc_id LIKE '%2'")
def pf21(t):
    suffix = F.when(F.col("doc_id").endswith("1"), "1").when(F.col("doc_id").endswith("2"), "2")
    return t.responses.withColumn("suffix", suffix).filter("suffix IS NOT NULL").select("system_id", "suffix", F.regexp_replace("doc_id", "[12]$", "").alias("doc_id"), "response_id")


@query("pf20_doc_id_rewrite", f", r AS (SELECT * EXCLUDE (doc_id, response_id), 'X' || doc_id AS doc_id FROM responses) SELECT system_id, doc_id, {SQL_ID} AS response_id FROM r")
def pf20(t):
    renamed = t.responses.withColumn("doc_id", F.concat(F.lit("X"), "doc_id"))
    return renamed.select("system_id", "doc_id", ident.response_id().alias("response_id"))


@query("fn2_normalise_filler", "SELECT part.p_partkey, lower(trim(regexp_replace(p_name, ' +', ' ', 'g'))) AS filler FROM part")
def fn2(t):
    return t.parquet("part").select("p_partkey", X.normalise_filler(F.col("p_name")).alias("filler"))


@query("fn1_normalise_cas", "SELECT doc_id, trim(regexp_replace(text, '\\r\\n|\\n|\\t', ' ', 'g'), ' ') AS cas FROM documents")
def fn1(t):
    return t.parquet("documents").select("doc_id", X.normalise_cas(F.col("text")).alias("cas"))


@query("fn7_text_at_span", ", r AS (SELECT DISTINCT doc_no, cas_start, cas_end FROM rows1) SELECT doc_no, cas_start, cas_end, CASE WHEN cas_end < length(text) THEN substr(text, cas_start + 1, 6) END AS covered FROM r JOIN documents d ON d.doc_id = doc_no")
def fn7(t):
    r = t.rows.select("doc_no", "cas_start", "cas_end").distinct()
    d = t.parquet("documents").select(F.col("doc_id").alias("doc_no"), "text")
    return r.join(d, "doc_no").select("doc_no", "cas_start", "cas_end", X.text_at(F.col("text"), F.col("cas_start"), F.col("cas_end")).alias("covered"))


@query("fn4_valid_times", f"SELECT DISTINCT cas, {_VALID} AS valid FROM rows1")
def fn4(t):
    return t.rows.select("cas", X.is_timex(F.col("cas")).alias("valid")).distinct()


_STEPS = """, t0 AS (SELECT DISTINCT doc_id, event_type, role, realis, cas, cas AS c0 FROM {src} WHERE role = 'Time'),
t1 AS (SELECT *, regexp_replace(c0, '^(.{{8}}[0-9])[0-9]$', '\\1X') AS c1 FROM t0), t2 AS (SELECT *, regexp_replace(c1, '^(.{{8}})[0-9]X$', '\\1XX') AS c2 FROM t1),
t3 AS (SELECT *, regexp_replace(c2, '^(.{{6}})[0-9]-XX$', '\\1X-XX') AS c3 FROM t2), t4 AS (SELECT *, regexp_replace(c3, '^(.{{5}})[0-9]X-XX$', '\\1XX-XX') AS c4 FROM t3),
t5 AS (SELECT *, regexp_replace(c4, '^(.{{3}})[0-9]-XX-XX$', '\\1X-XX-XX') AS c5 FROM t4), t6 AS (SELECT *, regexp_replace(c5, '^(.{{2}})[0-9]X-XX-XX$', '\\1XX-XX-XX') AS c6 FROM t5),
t7 AS (SELECT *, regexp_replace(c6, '^(.)[0-9]XX-XX-XX$', '\\1XXX-XX-XX') AS c7 FROM t6),
less AS (SELECT DISTINCT doc_id, event_type, role, realis, cas AS own, u AS cas FROM (SELECT *, unnest([c1, c2, c3, c4, c5, c6, c7]) AS u FROM t7) WHERE u <> cas)"""


@query("fn5_less_specific_times", _STEPS.format(src="rows1") + " SELECT DISTINCT own, cas FROM less")
def fn5(t):
    return t.rows.filter(X.is_temporal(F.col("role"))).select(F.col("cas").alias("own")).distinct().select("own", F.explode(X.less_specific_times(F.col("own"))).alias("cas"))


@query("tr3_fix_masks", "SELECT DISTINCT doc_id, CASE WHEN role = 'Time' THEN upper(cas) ELSE cas END AS cas FROM rows1")
def tr3(t):
    lowered = t.rows.withColumn("cas", F.when(F.col("role") == "Time", F.lower("cas")).otherwise(F.col("cas")))
    return T.fix_lowercase_masks(lowered).select("doc_id", "cas").distinct()


@query(
    "tr4_broken_times",
    f", k AS (SELECT * EXCLUDE (cas), CASE WHEN role = 'Time' AND cas_start % 3 = 0 THEN replace(cas, '-', '/') ELSE cas END AS cas FROM assessments) SELECT response_id, CASE WHEN role = 'Time' AND cas_ok IN ('C', 'I') AND NOT {_VALID} THEN 'W' ELSE cas_ok END AS cas_ok FROM k",
)
def tr4(t):
    broken = F.when((F.col("role") == "Time") & (F.col("cas_start") % 3 == 0), F.replace(F.col("cas"), F.lit("-"), F.lit("/"))).otherwise(F.col("cas"))
    return T.broken_times_wrong(t.assessments.withColumn("cas", broken)).select("response_id", "cas_ok")


_C = "doc_id, role, realis, canon"


@query(
    "tr5_injure_implied_by_die",
    f""", k AS (SELECT a.*, canon FROM assessments a JOIN canonical USING (doc_id, cas, cas_start, cas_end)),
    ban AS (SELECT DISTINCT {_C} FROM k WHERE event_type = 'Life.Die' AND {_OK}) SELECT response_id FROM k WHERE NOT (event_type = 'Life.Injure' AND ({_C}) IN (SELECT {_C} FROM ban))""",
)
def tr5(t):
    key = A.canonicalised(t.assessments, t.canonical)
    return key.join(T.implied_injuries(key, CLASS), CLASS, "left_anti").select("response_id")


@query("tr6_most_specific_time", _STEPS.format(src="(SELECT * FROM assessments WHERE cas_ok IN ('C', 'I'))") + " SELECT response_id FROM assessments WHERE (doc_id, event_type, role, realis, cas) NOT IN (SELECT doc_id, event_type, role, realis, cas FROM less)")
def tr6(t):
    return t.assessments.join(T.less_specific(t.assessments), ["doc_id", "event_type", "role", "realis", "cas"], "left_anti").select("response_id")


@query("tr7_all_actual", "SELECT system_id, doc_id, event_type, role, cas, cas_start, cas_end, bf_start, bf_end, max(confidence) AS confidence, len(pj) AS n_pj FROM responses GROUP BY system_id, doc_id, event_type, role, cas, cas_start, cas_end, bf_start, bf_end, pj, aaj")
def tr7(t):
    merged = t.responses.withColumn("realis", F.lit("Actual")).groupBy("system_id", *RESPONSE).agg(F.max("confidence").alias("confidence"))
    return merged.select("system_id", "doc_id", "event_type", "role", "cas", "cas_start", "cas_end", "bf_start", "bf_end", "confidence", F.size("pj").cast("long").alias("n_pj"))


@query("tr10_expand_from_realis", """, copies AS (SELECT DISTINCT doc_id, event_type, role, cas, cas_start, cas_end, bf_start, bf_end, pj, aaj, a_realis AS realis FROM assessments WHERE is_assessed AND a_realis <> realis),
    x AS (SELECT doc_id, event_type, role, cas, cas_start, cas_end, bf_start, bf_end, pj, aaj, realis FROM assessments UNION SELECT * FROM copies) SELECT doc_id, event_type, role, realis, count(*) AS n FROM x GROUP BY ALL""")
def tr10(t):
    return T.expand_from_realis(t.assessments, RESPONSE).groupBy("doc_id", "event_type", "role", "realis").agg(F.count(F.lit(1)).alias("n"))


@query(
    "tr11_transport_variants",
    f""", k AS (SELECT * EXCLUDE (role), CASE role WHEN 'Victim' THEN 'Artifact' WHEN 'Agent' THEN 'Vehicle' ELSE role END AS role FROM assessments),
    r AS (SELECT *, unnest(['Person', 'Artifact']) AS kind FROM k WHERE event_type = 'Movement.Transport' AND role <> 'Price' AND (NOT is_assessed OR ({_OK})))
    SELECT DISTINCT doc_id, cas, cas_start, cas_end, realis, 'Movement.Transport-' || kind AS event_type, CASE WHEN role = 'Artifact' AND kind = 'Person' THEN 'Person' WHEN role = 'Vehicle' THEN 'Instrument' ELSE role END AS role FROM r""",
)
def tr11(t):
    role = F.when(F.col("role") == "Victim", "Artifact").when(F.col("role") == "Agent", "Vehicle").otherwise(F.col("role"))
    return T.transport_variants(t.assessments.withColumn("role", role))


#: Documents with quotes: one at the end, nested ones for every third, a stray closer before every fifth.
QUOTED = """, quoted AS (SELECT 'D' || doc_id AS doc_id, CASE WHEN doc_id % 5 = 0 THEN '</quote>' ELSE '' END || text || CASE WHEN doc_id % 3 = 0 THEN ' <quote>a<quote orig="b">' || substr(text, 1, 20) || '</quote></quote> tail'
  ELSE ' <quote>' || substr(text, 1, 20) || '</quote> tail' END AS text, length(text) + CASE WHEN doc_id % 5 = 0 THEN 8 ELSE 0 END + 1 AS s,
  length(text) + CASE WHEN doc_id % 5 = 0 THEN 8 ELSE 0 END + 1 + least(20, length(text)) + CASE WHEN doc_id % 3 = 0 THEN 7 + 1 + 16 + 8 + 8 ELSE 7 + 8 END - 1 AS e FROM documents)"""


def quoted(t):
    d = t.parquet("documents")
    head = F.substring("text", 1, 20)
    plain = F.concat(F.lit(" <quote>"), head, F.lit("</quote> tail"))
    nested = F.concat(F.lit(' <quote>a<quote orig="b">'), head, F.lit("</quote></quote> tail"))
    stray = F.when(F.col("doc_id") % 5 == 0, "</quote>").otherwise("")
    return d.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("doc_id"), F.concat(stray, "text", F.when(F.col("doc_id") % 3 == 0, nested).otherwise(plain)).alias("text"))


@query("tr9_quote_regions", f"{QUOTED} SELECT doc_id, CAST(s AS INT) AS start, CAST(e AS INT) AS \"end\", true AS closed FROM quoted")
def tr9(t):
    return T.quote_regions(quoted(t))


@query("tr8_quote_filter", f"{QUOTED} SELECT system_id, response_id FROM responses r WHERE NOT EXISTS (SELECT 1 FROM quoted q WHERE q.doc_id = r.doc_id AND (bf_start BETWEEN s AND e OR bf_end BETWEEN s AND e OR cas_start BETWEEN s AND e OR cas_end BETWEEN s AND e))")
def tr8(t):
    return T.in_quotes(t.responses, T.quote_regions(quoted(t))).select("system_id", "response_id")


_MAP = "cas_start % 2 = 1 AND event_type = 'Life.Die'"
_DEL = "event_type = 'Contact.Meet' AND role = 'Agent'"


def _mapping(t):
    ids = t.responses.select("response_id", "event_type", "role", "cas_start").distinct()
    return ids.filter(_MAP).select("response_id", F.concat(F.lit("n"), F.substring("response_id", 1, 2)).alias("new_id")), ids.filter(_DEL).select("response_id")


@query("tr1a_map_outputs", f"SELECT system_id, doc_id, CASE WHEN {_MAP} THEN 'n' || response_id[1:2] ELSE response_id END AS response_id, max(confidence) AS confidence FROM responses WHERE NOT ({_DEL}) GROUP BY ALL")
def tr1a(t):
    return T.map_outputs(t.responses.select("system_id", "doc_id", "response_id", "confidence"), *_mapping(t), ["system_id", "doc_id"])


@query(
    "tr1a_map_outputs_with_metadata",
    f"SELECT system_id, doc_id, new_id AS response_id, max(confidence) AS confidence, arg_max('m' || old, {{'a': confidence, 'b': -rn}}) AS metadata FROM (SELECT system_id, doc_id, response_id AS old, CASE WHEN {_MAP} THEN 'n' || response_id[1:2] ELSE response_id END AS new_id, confidence, row_number() OVER (PARTITION BY system_id, doc_id, CASE WHEN {_MAP} THEN 'n' || response_id[1:2] ELSE response_id END ORDER BY response_id) AS rn FROM responses WHERE NOT ({_DEL})) GROUP BY ALL",
)
def tr1a_metadata(t):
    noted = t.responses.select("system_id", "doc_id", "response_id", "confidence", F.concat(F.lit("m"), "response_id").alias("metadata"))
    return T.map_outputs(noted, *_mapping(t), ["system_id", "doc_id"])


@query(
    "tr1c_map_linking",
    f""", m AS (SELECT DISTINCT response_id, CASE WHEN {_MAP} THEN 'n' || response_id[1:2] ELSE response_id END AS new_id FROM responses WHERE NOT ({_DEL})),
    l AS (SELECT DISTINCT doc_id, frame_id, new_id FROM gold_linking JOIN m USING (response_id)), s AS (SELECT doc_id, frame_id, list_sort(list(new_id)) AS members FROM l GROUP BY ALL),
    f AS (SELECT doc_id, min(frame_id) AS frame_id, members FROM s GROUP BY doc_id, members), u AS (SELECT doc_id, frame_id, unnest(members) AS response_id FROM f)
    SELECT * FROM u UNION ALL SELECT DISTINCT doc_id, 'INCOMPLETE', new_id FROM incomplete JOIN m USING (response_id) WHERE (doc_id, new_id) NOT IN (SELECT doc_id, response_id FROM u)""",
)
def tr1c(t):
    frames, rest = T.map_linking(t.gold_linking, t.incomplete, *_mapping(t), ["doc_id"])
    return frames.select("doc_id", "frame_id", "response_id").unionByName(rest.select("doc_id", F.lit("INCOMPLETE").alias("frame_id"), "response_id"))


@query(
    "tr1b_map_key",
    f""", m AS (SELECT *, response_id AS old, CASE WHEN {_MAP} THEN 'n' || response_id[1:2] ELSE response_id END AS new_id, ({_MAP}) AS mapped FROM assessments WHERE NOT ({_DEL}))
    SELECT new_id AS response_id, is_assessed, aet, aer, cas_ok FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY CASE WHEN is_assessed AND mapped THEN 0 WHEN is_assessed THEN 1 ELSE 2 END, old) AS rn FROM m) WHERE rn = 1""",
)
def tr1b(t):
    return T.map_key(t.assessments, *_mapping(t)).select("response_id", "is_assessed", "aet", "aer", "cas_ok")
