"""Queries over the lines of whole files, as they are written."""

from __future__ import annotations

from pyspark.sql import functions as F

from framescore.operators import kb
from framescore.operators import transforms as T
from framescore.sources import scans, sinks

from .files import _KB, _NAMES, _QR, _SPANS, _kb_lines, _query_responses
from .registry import query
from .rewrites import QUOTED, quoted

_LINE = f"concat_ws(chr(9), response_id, doc_id, event_type, role, cas, cas_start || '-' || cas_end, {_SPANS.format('pj')}, bf_start || '-' || bf_end, {_SPANS.format('aaj')}, realis)"


def _noted(t):
    """Responses with metadata for the role Place."""
    return t.responses.withColumn("metadata", F.when(F.col("role") == "Place", F.concat(F.lit("about "), "response_id")))


@query(
    "sk1_argument_files",
    f""", x AS (SELECT system_id, doc_id, response_id, unnest(CASE WHEN role = 'Place' THEN [{{'k': 0, 'line': '#about ' || response_id}}, {{'k': 1, 'line': {_LINE}}}] ELSE [{{'k': 0, 'line': {_LINE}}}] END) AS u FROM responses)
    SELECT system_id, doc_id, row_number() OVER (PARTITION BY system_id, doc_id ORDER BY response_id, u.k) - 1 AS line_no, u.line AS line FROM x""",
)
def sk1(t):
    d = sinks.argument_file(_noted(t))
    # a double has other digits in the two engines; the confidence is the last field
    return d.select("system_id", "doc_id", "line_no", F.when(F.col("line").startswith("#"), F.col("line")).otherwise(F.substring_index("line", "\t", 10)).alias("line"))


@query(
    "sk3_linking_files",
    """, s AS (SELECT system_id, doc_id, frame_id, list_sort(list(response_id)) AS m FROM linking WHERE frame_id <> 'f0' GROUP BY ALL), r AS (SELECT system_id, doc_id, string_agg(response_id, chr(9) ORDER BY response_id) AS r FROM linking WHERE frame_id = 'f0' GROUP BY ALL),
    d AS (SELECT DISTINCT system_id, doc_id FROM linking), x AS (SELECT system_id, doc_id, 0 AS last, m, frame_id, frame_id || chr(9) || array_to_string(m, ' ') AS line FROM s UNION ALL SELECT system_id, doc_id, 1, CAST([] AS VARCHAR[]), '', 'INCOMPLETE' || chr(9) || coalesce(r, '') FROM d LEFT JOIN r USING (system_id, doc_id))
    SELECT system_id, doc_id, row_number() OVER (PARTITION BY system_id, doc_id ORDER BY last, m, frame_id) - 1 AS line_no, line FROM x""",
)
def sk3(t):
    return sinks.linking_file(t.linking.filter("frame_id <> 'f0'"), t.linking.filter("frame_id = 'f0'").drop("frame_id"))


@query(
    "sk3_linking_files_2015",
    """, s AS (SELECT system_id, doc_id, frame_id, list_sort(list(response_id)) AS m FROM linking GROUP BY ALL), x AS (SELECT system_id, doc_id, 0 AS last, m, frame_id, array_to_string(m, chr(9)) AS line FROM s UNION ALL SELECT DISTINCT system_id, doc_id, 1, CAST([] AS VARCHAR[]), '', 'INCOMPLETE' || chr(9) FROM s)
    SELECT system_id, doc_id, row_number() OVER (PARTITION BY system_id, doc_id ORDER BY last, m, frame_id) - 1 AS line_no, line FROM x""",
)
def sk3_2015(t):
    return sinks.linking_file(t.linking, t.linking.filter(F.lit(False)).drop("frame_id"), "2015")


@query(
    "sk6_query_store_file",
    f"""{_QR}, x AS (SELECT query_id, doc_id, s, e, CASE WHEN a = 2 THEN 'note ' || doc_id END AS md, concat_ws(chr(9), query_id, doc_id, array_to_string(systems, ','), s || '-' || e, CASE a WHEN 1 THEN 'ET_MATCH' WHEN 2 THEN 'WRONG' WHEN 3 THEN 'CORRECT' ELSE 'UNASSESSED' END) AS line FROM qr),
    y AS (SELECT *, row_number() OVER (ORDER BY query_id, doc_id, s, e) - 1 AS place FROM x) SELECT 2 * place AS line_no, '#' || md AS line FROM y WHERE md IS NOT NULL UNION ALL SELECT 2 * place + CASE WHEN md IS NULL THEN 0 ELSE 1 END, line FROM y""",
)
def sk6(t):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), F.col("a").cast("int") + 1)
    d = _query_responses(t).select(
        "query_id", "doc_id", "systems", F.array(F.struct(F.col("s").cast("int").alias("start"), F.col("e").cast("int").alias("end"))).alias("pj"), F.when(name != "UNASSESSED", name).alias("assessment"),
        F.when(F.col("a") == 2, F.concat(F.lit("note "), "doc_id")).alias("metadata"),
    )
    return sinks.query_store_file(d)


@query(
    "sk7_quote_file",
    f"""{QUOTED}, r AS (SELECT doc_id, string_agg(s || '-' || e, ' ' ORDER BY s, e) AS regions FROM quoted GROUP BY ALL), n AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM r)
    SELECT 0 AS line_no, CAST(count(*) AS VARCHAR) AS line FROM r UNION ALL SELECT 2 * place + 1, doc_id FROM n UNION ALL SELECT 2 * place + 2, regions FROM n""",
)
def sk7(t):
    return sinks.quote_file(T.quote_regions(quoted(t)))


@query("sc22_gold_ids_and_mismatches", "SELECT DISTINCT doc_id, doc_id LIKE '%7' AS mismatch FROM rows1")
def sc22(t):
    named = t.rows.select("doc_id").distinct().withColumn("requested", F.when(F.col("doc_id").like("%7"), F.lit("D0")).otherwise(F.concat("doc_id", F.lit(".kbp")))).withColumn("doc_id", F.concat("doc_id", F.lit("-kbp")))
    wrong = scans.gold_ids(scans.id_mismatches(named)).select("doc_id", F.lit(True).alias("mismatch"))
    return scans.gold_ids(named).select("doc_id").join(wrong, "doc_id", "left").withColumn("mismatch", F.coalesce("mismatch", F.lit(False)))


@query("sc4_repair_counts", """, k AS (SELECT * REPLACE (CASE WHEN cas_start % 50 = 0 THEN NULL ELSE aet END AS aet) FROM assessments) SELECT 'made unassessed' AS repair, count(*) AS n FROM k WHERE is_assessed AND aet IS NULL HAVING count(*) > 0""")
def sc4(t):
    broken = t.assessments.withColumn("aet", F.when(F.col("cas_start") % 50 == 0, None).otherwise(F.col("aet")))
    return scans.repair_counts(scans.recovered(broken).filter("repair = 'made unassessed'"))


def _kb(t):
    """Assertions in which every mention of an entity with an even number is its canonical one."""
    even = F.col("line").rlike("^:Entity_[0-9]*[02468]\tmention\t")
    lines = _kb_lines(t).withColumn("line", F.when(even, F.replace("line", F.lit("\tmention\t"), F.lit("\tcanonical_mention\t"))).otherwise(F.col("line")))
    return scans.kb_assertions(lines)


@query("jn28_node_types", f"{_KB} SELECT DISTINCT ':Entity_' || ent AS node, 'PER' AS type FROM kb0")
def jn28_types(t):
    return kb.node_types(_kb(t))


@query("jn28_canonical_mentions", f"{_KB} SELECT DISTINCT doc_id, ':Entity_' || ent AS node, 'say \"' || cas || '\"' AS mention FROM kb0 WHERE ent % 2 = 0")
def jn28_canonical(t):
    return kb.canonical_mentions(_kb(t))


@query("jn28_mentions_of_nodes", f"{_KB} SELECT DISTINCT ':Entity_' || ent AS node, doc_id, CASE WHEN ent % 2 = 0 THEN 'entity canonical mention' ELSE 'entity mention' END AS mention_kind, 'say \"' || cas || '\"' AS mention FROM kb0")
def jn28_mentions(t):
    return kb.mentions_of_nodes(_kb(t))
