"""Queries over the text layouts: lines are made from the logical tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from framescore.sources import scans, sinks

from .registry import query
from .tables import RESPONSE

_SPANS = "CASE WHEN len({0}) = 0 THEN 'NIL' ELSE array_to_string(list_transform({0}, lambda s: s.start || '-' || s.end), ',') END"


def _lines(t, confidence=True):
    """Argument lines of each system and document, with a comment before every response of the role Place."""
    made = sinks.argument_lines(t.responses).join(t.responses.select("system_id", "response_id", "role"), ["system_id", "response_id"])
    both = F.when(F.col("role") == "Place", F.array(F.concat(F.lit("#about "), "response_id"), F.col("line"))).otherwise(F.array("line"))
    return made.select(F.concat_ws("/", "system_id", "doc_id").alias("path"), "response_id", F.posexplode(both).alias("k", "line")).selectExpr(
        "path", "row_number() OVER (PARTITION BY path ORDER BY response_id, k) - 1 AS line_no", "line"
    )


@query(
    "sk1_argument_lines",
    f"""SELECT system_id, doc_id, response_id, concat_ws(chr(9), response_id, doc_id, event_type, role, cas, cas_start || '-' || cas_end, {_SPANS.format('pj')}, bf_start || '-' || bf_end, {_SPANS.format('aaj')}, realis) AS line FROM responses""",
)
def sk1(t):
    d = sinks.argument_lines(t.responses)
    return d.select("system_id", "doc_id", "response_id", F.substring_index("line", "\t", 10).alias("line"))


@query("sc1_argument_scan", "SELECT split_part(system_id, '/', 1) AS system_id, doc_id, event_type, role, cas, cas_start, bf_end, len(pj) AS n_pj, realis, confidence, CASE WHEN role = 'Place' THEN 'about ' || response_id END AS metadata FROM responses")
def sc1(t):
    d = scans.argument_output(_lines(t), ["path", *RESPONSE])
    return d.select(F.substring_index("path", "/", 1).alias("system_id"), "doc_id", "event_type", "role", "cas", "cas_start", "bf_end", F.size("pj").cast("long").alias("n_pj"), "realis", "confidence", "metadata")


def _store(t):
    key = t.assessments.join(t.coref, ["doc_id", "cas", "cas_start", "cas_end"], "left")
    return sinks.annotation_lines(key)


@query("sc2_annotation_scan", "SELECT response_id, is_assessed, aet, aer, cas_ok, bf_ok, coref_id, a_realis, mention_type FROM assessments JOIN coref USING (doc_id, cas, cas_start, cas_end)")
def sc2(t):
    from framescore.functions import ident

    lines = _store(t).select(F.col("doc_id").alias("path"), F.col("response_id").alias("line_no"), "line")
    d = scans.annotation_store(lines.withColumn("line_no", F.monotonically_increasing_id()))
    return d.select(ident.response_id().alias("response_id"), "is_assessed", "aet", "aer", "cas_ok", "bf_ok", "coref_id", "a_realis", "mention_type")


@query("sk2_annotation_order", "SELECT doc_id, CAST(NOT is_assessed AS INT) AS place, response_id FROM assessments")
def sk2(t):
    return _store(t).select("doc_id", "place", "response_id")


_BROKEN = """, k AS (SELECT * EXCLUDE (aer, cas_ok), CASE WHEN role = 'Agent' AND aet = 'C' AND cas_start % 50 = 0 THEN NULL ELSE aer END AS aer, CASE WHEN cas_start % 75 = 0 THEN 'C' ELSE cas_ok END AS cas_ok FROM assessments),
    f AS (SELECT *, coalesce(aet <> 'W', false) AS t, coalesce(aer <> 'W', false) AS r, cas_ok IS NOT NULL AND bf_ok IS NOT NULL AND a_realis IS NOT NULL AND mention_type IS NOT NULL AS has_all,
    cas_ok IS NOT NULL OR bf_ok IS NOT NULL OR a_realis IS NOT NULL OR mention_type IS NOT NULL AS has_any FROM k)"""


def _broken(t):
    aer = F.when((F.col("role") == "Agent") & (F.col("aet") == "C") & (F.col("cas_start") % 50 == 0), None).otherwise(F.col("aer"))
    return t.assessments.withColumn("aer", aer).withColumn("cas_ok", F.when(F.col("cas_start") % 75 == 0, "C").otherwise(F.col("cas_ok")))


@query(
    "sc3_strict_violations",
    f"{_BROKEN} SELECT response_id, 'role assessment missing' AS rule FROM f WHERE is_assessed AND t AND aer IS NULL UNION ALL SELECT response_id, 'filler assessment missing' FROM f WHERE is_assessed AND t AND r AND NOT has_all UNION ALL SELECT response_id, 'filler assessment not expected' FROM f WHERE is_assessed AND NOT (t AND r) AND has_any",
)
def sc3(t):
    return scans.strictness(_broken(t)).select("response_id", "rule")


@query(
    "sc4_recovery",
    f"""{_BROKEN}, m AS (SELECT *, CASE WHEN is_assessed AND ((t AND aer IS NULL) OR (t AND r AND NOT has_all)) THEN 'made unassessed' WHEN is_assessed AND NOT (t AND r) AND has_any THEN 'fields removed' END AS repair FROM f)
    SELECT response_id, repair, is_assessed AND coalesce(repair <> 'made unassessed', true) AS is_assessed, CASE WHEN repair IS NULL THEN cas_ok END AS cas_ok FROM m""",
)
def sc4(t):
    return scans.recovered(_broken(t)).select("response_id", "repair", "is_assessed", "cas_ok")


def _frames(t):
    lines = t.linking.groupBy("system_id", "doc_id", "frame_id").agg(F.concat_ws(" ", F.sort_array(F.collect_set("response_id"))).alias("m"))
    return lines.select(F.concat_ws("/", "system_id", "doc_id").alias("path"), F.substring("frame_id", 2, 9).cast("int").alias("line_no"), F.concat_ws("\t", "frame_id", "m").alias("line"))


@query("sc7_linking_scan_2016", ", s AS (SELECT system_id, doc_id, frame_id, list_sort(list(response_id)) AS m FROM linking GROUP BY ALL) SELECT path, frame_id, unnest(m) AS response_id FROM (SELECT system_id || '/' || doc_id AS path, min(frame_id) AS frame_id, m FROM s GROUP BY ALL)")
def sc7(t):
    return scans.linking_2016(_frames(t))[0]


@query("sc6_linking_scan_2015", "SELECT system_id || '/' || doc_id AS path, frame_id[2:] AS frame_id, response_id FROM linking WHERE frame_id <> 'f0' UNION ALL SELECT system_id || '/' || doc_id, 'INCOMPLETE', response_id FROM linking WHERE frame_id = 'f0'")
def sc6(t):
    line = F.when(F.col("line_no") == 0, F.regexp_replace("line", "^f0", "INCOMPLETE")).otherwise(F.regexp_replace("line", "^f.\t", ""))
    frames, rest = scans.linking_2015(_frames(t).withColumn("line", line))
    return frames.unionByName(rest.select("path", F.lit("INCOMPLETE").alias("frame_id"), "response_id"))


@query("sc8_corpus_linking_scan", "SELECT system_id || corpus_frame_id AS corpus_frame_id, doc_id || '-x' AS doc_id, frame_id FROM corpus_linking")
def sc8(t):
    ref = F.concat(F.col("doc_id"), F.lit("-x-"), F.col("frame_id"))
    lines = t.corpus_linking.groupBy(F.concat("system_id", "corpus_frame_id").alias("c")).agg(F.concat_ws(" ", F.sort_array(F.collect_set(ref))).alias("m"))
    return scans.corpus_linking(lines.select(F.concat_ws("\t", "c", "m").alias("line")))


_Q = "'Q' || (doc_no % 25)"


def _entry_points(t):
    d = t.rows.filter("final AND role <> 'Time' AND doc_no % 10 = 0")
    e = F.concat(F.lit("E"), (F.col("ent") % 25).cast("string"))
    return d.select(F.concat(F.lit("Q"), (F.col("doc_no") % 25).cast("string")).alias("query_id"), "doc_id", "hopper_id", "role", e.alias("entity_id")).distinct()


@query("sc9_query_scan", f"SELECT DISTINCT {_Q} AS query_id, doc_id, hopper_id, role, 'E' || (ent % 25) AS entity_id FROM rows1 WHERE final AND role <> 'Time' AND doc_no % 10 = 0")
def sc9(t):
    return scans.queries(sinks.query_lines(_entry_points(t)).withColumn("line_no", F.lit(0))).drop("ep_ordinal")


@query("sk5_query_lines", f"SELECT DISTINCT concat_ws(chr(9), {_Q}, doc_id, hopper_id, role, 'E' || (ent % 25)) AS line FROM rows1 WHERE final AND role <> 'Time' AND doc_no % 10 = 0")
def sk5(t):
    return sinks.query_lines(_entry_points(t))


_QR = """, qr AS (SELECT 'Q' || (doc_no % 25) AS query_id, doc_id, "at" AS s, "at" + 60 AS e, list_sort(list(DISTINCT system_id)) AS systems, max(part4) AS a FROM rows1 GROUP BY ALL)"""


def _query_responses(t):
    d = t.rows.groupBy(F.concat(F.lit("Q"), (F.col("doc_no") % 25).cast("string")).alias("query_id"), "doc_id", F.col("at").alias("s"), (F.col("at") + 60).alias("e"))
    return d.agg(F.array_sort(F.collect_set("system_id")).alias("systems"), F.max("part4").alias("a"))


_NAMES = ("UNASSESSED", "ET_MATCH", "WRONG", "CORRECT")


@query("sc10_query_assessment_scan", f"{_QR} SELECT query_id, doc_id, array_to_string(systems, ',') AS systems, s, e, CASE a WHEN 1 THEN 'ET_MATCH' WHEN 2 THEN 'WRONG' WHEN 3 THEN 'CORRECT' END AS assessment, CASE WHEN a = 2 THEN ' note ' || doc_id END AS metadata FROM qr")
def sc10(t):
    d = _query_responses(t)
    name = F.element_at(F.array(*map(F.lit, _NAMES)), F.col("a").cast("int") + 1)
    line = F.concat_ws("\t", "query_id", "doc_id", F.concat_ws(",", "systems"), F.concat_ws("-", F.col("s").cast("string"), F.col("e").cast("string")), name)
    made = d.select(F.concat_ws("/", "query_id", "doc_id", F.col("s").cast("string")).alias("path"), F.posexplode(F.when(F.col("a") == 2, F.array(F.concat(F.lit("# note "), "doc_id"), line)).otherwise(F.array(line))).alias("line_no", "line"))
    got = scans.query_assessments(made)
    return got.select("query_id", "doc_id", F.array_join("systems", ",").alias("systems"), F.get("pj", F.lit(0))["start"].alias("s"), F.get("pj", F.lit(0))["end"].alias("e"), "assessment", "metadata")


@query("so7_merge_query_responses", f"{_QR} SELECT query_id, doc_id, s, array_to_string(systems, ',') AS systems, CASE a WHEN 1 THEN 'ET_MATCH' WHEN 2 THEN 'WRONG' WHEN 3 THEN 'CORRECT' ELSE 'UNASSESSED' END AS assessment FROM qr")
def so7(t):
    from framescore.operators.stores import merge_query_responses

    d = _query_responses(t).select("query_id", "doc_id", "s", F.explode("systems").alias("system_id"), F.when(F.col("a") > 0, F.element_at(F.array(*map(F.lit, _NAMES)), F.col("a").cast("int") + 1)).alias("assessment"))
    return merge_query_responses(d, ["query_id", "doc_id", "s"])[0]


_RANKED = f"{_QR}, per AS (SELECT query_id, doc_id, unnest(systems) AS system_id, a FROM qr), merged AS (SELECT query_id, doc_id, system_id, max(a) AS a FROM per GROUP BY ALL)"


def _ranked(t):
    d = _query_responses(t).select("query_id", "doc_id", F.explode("systems").alias("system_id"), "a")
    return d.groupBy("query_id", "doc_id", "system_id").agg(F.max("a").alias("a"))


@query("tr20_neutralised_query_responses", f"{_QR} SELECT query_id, doc_id, CAST(max(a) AS BIGINT) AS assessment_rank, count(DISTINCT s) AS n_pj FROM qr GROUP BY ALL")
def tr20(t):
    return _query_responses(t).groupBy("query_id", "doc_id").agg(F.max("a").alias("assessment_rank"), F.count_distinct("s").alias("n_pj"))


_CQ = f"""{_RANKED}, gold AS (SELECT DISTINCT query_id, doc_id FROM merged WHERE a = 3), sq AS (SELECT * FROM (SELECT DISTINCT query_id FROM merged), (SELECT DISTINCT system_id FROM merged)),
    hit AS (SELECT query_id, system_id, count(*) FILTER (a = 3) AS tp, count(*) FILTER (a <> 3) AS fp FROM merged WHERE a > 0 GROUP BY ALL), g AS (SELECT query_id, count(*) AS n FROM gold GROUP BY ALL),
    cq AS (SELECT sq.system_id, sq.query_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(n, 0) - coalesce(tp, 0) AS fn FROM sq LEFT JOIN hit USING (query_id, system_id) LEFT JOIN g USING (query_id))"""


def _query_counts(t):
    from framescore.operators.corpus import query_counts

    return query_counts(_ranked(t), 3)


@query("ag26_system_query_counts", f"{_CQ} SELECT * FROM cq")
def ag26(t):
    return _query_counts(t)


@query("ag12_corpus_linear_score", f"{_CQ} SELECT system_id, avg(greatest((tp - 0.25e0 * fp) / greatest(tp + fn, 1), 0)) AS linear FROM cq GROUP BY ALL")
def ag12(t):
    from framescore.operators.corpus import linear_score

    return linear_score(_query_counts(t))


@query("ag13_corpus_f", f"{_CQ}, s AS (SELECT system_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM cq GROUP BY ALL) SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM s")
def ag13(t):
    from framescore.operators.scores import with_f

    c = _query_counts(t).groupBy("system_id").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    return with_f(c)


@query("sc11_quote_scan", ", r AS (SELECT DISTINCT doc_no, doc_id FROM rows1) SELECT doc_id, CAST(doc_no + 4 AS INT) AS start, CAST(doc_no + 60 AS INT) AS \"end\" FROM r UNION ALL SELECT doc_id, CAST(doc_no + 67 AS INT), CAST(doc_no + 88 AS INT) FROM r")
def sc11(t):
    n = lambda k: (F.col("doc_no") + k).cast("string")
    regions = F.concat(n(4), F.lit("-"), n(60), F.lit(" "), n(67), F.lit("-"), n(88))
    lines = t.rows.select("doc_no", "doc_id").distinct().select(F.col("doc_id").alias("path"), F.posexplode(F.array(F.lit("1"), F.col("doc_id"), regions)).alias("line_no", "line"))
    return scans.quote_file(lines)


_KB = """, kb0 AS (SELECT DISTINCT doc_id, hopper_id, ent, role, realis, lower(event_type) AS et, pj, cas, cas_start, cas_end FROM rows1)"""


def _kb_lines(t):
    d = t.rows.select("doc_id", "hopper_id", "ent", "role", "realis", F.lower("event_type").alias("et"), "cas", "cas_start", "cas_end").distinct()
    entity, event = F.concat(F.lit(":Entity_"), F.col("ent").cast("string")), F.concat(F.lit(":Event_"), "doc_id", "hopper_id")
    span = F.concat("doc_id", F.lit(":"), F.col("cas_start").cast("string"), F.lit("-"), (F.col("cas_end") + F.when(F.col("ent") == 3, 400).otherwise(0)).cast("string"))
    line = F.explode(
        F.array(
            F.concat_ws("\t", entity, F.lit("type"), F.lit("PER"), F.lit("0.900")),
            F.concat_ws("\t", entity, F.lit("mention"), F.concat(F.lit('"say \\"'), "cas", F.lit('\\""')), span, F.lit("0.500")),
            F.concat_ws("\t", event, F.concat("et", F.lit(":"), F.lower("role"), F.lit("."), F.lower("realis")), entity, F.concat(span, F.lit(";"), span), F.lit("0.25")),
        )
    )
    return d.select(line.alias("line")).withColumn("line_no", F.monotonically_increasing_id() + 1)


@query(
    "sc12_kb_scan",
    f"""{_KB}, a AS (SELECT *, ':Entity_' || ent AS e, doc_id || ':' || cas_start || '-' || (cas_end + CASE WHEN ent = 3 THEN 400 ELSE 0 END) AS p FROM kb0)
    SELECT DISTINCT 'type' AS kind, e AS subject, 'type' AS predicate, 'PER' AS object, NULL AS mention, NULL AS realis, NULL AS provenance, 0.9e0 AS confidence FROM a
    UNION ALL SELECT DISTINCT 'mention', e, 'mention', NULL, 'say "' || cas || '"', NULL, p, 0.5e0 FROM a
    UNION ALL SELECT DISTINCT 'event argument', ':Event_' || doc_id || hopper_id, et || ':' || lower(role), e, NULL, lower(realis), p || ';' || p, 0.25e0 FROM a""",
)
def sc12(t):
    return scans.kb_assertions(_kb_lines(t)).drop("line_no")


@query(
    "sc13_kb_provenance",
    f"{_KB}, s AS (SELECT DISTINCT ent, doc_id, cas, cas_start, cas_end + CASE WHEN ent = 3 THEN 400 ELSE 0 END AS e FROM kb0) SELECT doc_id, cas_start AS start, CASE WHEN e - cas_start >= 200 THEN cas_start + 199 ELSE e END AS \"end\", e - cas_start >= 200 AS trimmed FROM s",
)
def sc13(t):
    got = scans.kb_assertions(_kb_lines(t)).filter("kind = 'mention'")
    return scans.kb_provenance(got).select("doc_id", "start", "end", "trimmed")


@query("sc14_kb_mention_kinds", f"{_KB} SELECT DISTINCT ':Entity_' || ent AS subject, 'say \"' || cas || '\"' AS mention, 'entity mention' AS mention_kind FROM kb0")
def sc14(t):
    got = scans.kb_assertions(_kb_lines(t)).filter("kind = 'mention'")
    return got.select("subject", "mention", scans.kb_mention_kind(F.col("predicate"), F.col("subject"), F.col("realis")).alias("mention_kind")).distinct()


@query(
    "sk9_kb_lines",
    f"""{_KB}, a AS (SELECT *, ':Entity_' || ent AS e, doc_id || ':' || cas_start || '-' || (cas_end + CASE WHEN ent = 3 THEN 400 ELSE 0 END) AS p FROM kb0)
    SELECT DISTINCT e AS subject, 0 AS place, concat_ws(chr(9), e, 'type', 'PER', '0.900000') AS line FROM a UNION ALL SELECT DISTINCT e, 3, concat_ws(chr(9), e, 'mention', '"say \\"' || cas || '\\""', p, '0.500000') FROM a
    UNION ALL SELECT DISTINCT ':Event_' || doc_id || hopper_id, 5, concat_ws(chr(9), ':Event_' || doc_id || hopper_id, et || ':' || lower(role) || '.' || lower(realis), e, p || ';' || p, '0.250000') FROM a""",
)
def sk9(t):
    d = scans.kb_assertions(_kb_lines(t))
    kind = F.when(F.col("kind") == "mention", scans.kb_mention_kind(F.col("predicate"), F.col("subject"), F.col("realis"))).otherwise(F.col("kind"))
    return sinks.kb_lines(d.withColumn("mention_kind", kind))
