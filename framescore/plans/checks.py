"""Queries of validation over all of the checks, with faults put into the logical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from framescore.operators import linking as L
from framescore.operators import validate as V
from framescore.sources import scans

from .registry import query

#: Lines of a roles file, and roles that every type may have.
ROLE_LINES = ["Life.Die\tVictim\tAgent", "Life.Injure\tVictim Agent", "Conflict.Attack\tAgent", "Contact.Meet\tAgent"]
ALWAYS = ["Time", "Place"]
_ROLE_PAIRS = [(x.split()[0], r) for x in ROLE_LINES for r in x.split()[1:]]
_VALID = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _ROLE_PAIRS) + ")"
#: Lines of a file of linkable types; a pair must be there in both directions.
LINK_LINES = ["Life.Die\tLife.Die Life.Injure Conflict.Attack", "Life.Injure\tLife.Injure Life.Die", "Conflict.Attack\tConflict.Attack", "Contact.Meet\tLife.Die", "Movement.Transport\tMovement.Transport"]
_LINK_PAIRS = [(x.split()[0], r) for x in LINK_LINES for r in x.split()[1:]]
_MUTUAL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _LINK_PAIRS if (b, a) in _LINK_PAIRS) + ")"


def _multimap(t, lines: list[str], key: str, value: str):
    return scans.symbol_multimap(t.spark.createDataFrame([(x,) for x in lines], "line string")).select(F.col("key").alias(key), F.col("value").alias(value))


@query("sc15_roles_of_responses", f"SELECT event_type, role, count(*) AS n FROM responses WHERE (event_type, role) IN {_VALID} GROUP BY ALL")
def sc15(t):
    return t.responses.join(_multimap(t, ROLE_LINES, "event_type", "role"), ["event_type", "role"]).groupBy("event_type", "role").agg(F.count(F.lit(1)).alias("n"))


@query(
    "va2_outside_ontology",
    f"""SELECT system_id, doc_id, response_id, 'unknown type' AS "check", 'error' AS severity FROM responses WHERE event_type NOT IN (SELECT col0 FROM {_VALID})
    UNION ALL SELECT system_id, doc_id, response_id, 'role not of the type', 'error' FROM responses WHERE event_type IN (SELECT col0 FROM {_VALID}) AND role NOT IN ('Time', 'Place') AND (event_type, role) NOT IN {_VALID}""",
)
def va2(t):
    return V.outside_ontology(t.responses, _multimap(t, ROLE_LINES, "event_type", "role"), ALWAYS)


@query(
    "va4_documents_outside",
    """, c AS (SELECT 'D' || doc_id AS doc_id FROM documents WHERE doc_id % 2 = 0), a AS (SELECT DISTINCT system_id, doc_id FROM responses WHERE doc_id NOT LIKE '%7'), l AS (SELECT DISTINCT system_id, doc_id FROM linking)
    SELECT *, 'arguments outside corpus' AS "check" FROM a WHERE doc_id NOT IN (SELECT doc_id FROM c) UNION ALL SELECT *, 'linking outside corpus' FROM l WHERE doc_id NOT IN (SELECT doc_id FROM c)
    UNION ALL SELECT *, 'linking without arguments' FROM l WHERE (system_id, doc_id) NOT IN (SELECT system_id, doc_id FROM a)""",
)
def va4(t):
    corpus = t.parquet("documents").filter("doc_id % 2 = 0").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("doc_id"))
    return V.outside_documents(t.responses.filter("doc_id NOT LIKE '%7'"), t.linking, corpus)


@query(
    "va5_warnings",
    r""", d AS (SELECT 'D' || doc_id AS doc_id, text FROM documents), w AS (SELECT r.*, CASE WHEN cas_end < length(text) THEN regexp_replace(substr(text, cas_start + 1, cas_end - cas_start + 1), '[ \t\n\x0B\f\r]+', ' ', 'g') END AS shown FROM responses r JOIN d USING (doc_id) WHERE role <> 'Time')
    SELECT system_id, doc_id, response_id, 'text is not at its span' AS "check", 'warning' AS severity FROM w WHERE shown IS NOT NULL AND NOT contains(shown, cas)
    UNION ALL SELECT system_id, doc_id, response_id, 'filler outside justification', 'warning' FROM responses WHERE len(list_filter(pj, lambda s: s.start <= bf_start AND bf_end <= s.end)) = 0
    UNION ALL SELECT system_id, doc_id, response_id, 'ignored place', 'warning' FROM responses WHERE event_type = 'Movement.Transport' AND role = 'Place'""",
)
def va5(t):
    texts = t.parquet("documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    return V.text_mismatch(t.responses, texts).unionByName(V.filler_outside_justification(t.responses)).unionByName(V.ignored_place(t.responses))


def _all_frames(t):
    """Frames in which generic responses have not been left out."""
    return t.ided.select("system_id", "doc_id", "frame_id", "response_id").distinct()


def _validators(t) -> dict:
    return {"generic in linking": V.no_generic, "not linkable": V.only_linkable(_multimap(t, LINK_LINES, "type_a", "type_b"))}


def _pairs(types: str, keys: str) -> str:
    return f"""SELECT DISTINCT {keys}, event_type AS type_a, event_type AS type_b, 'generic in linking' AS "check" FROM {types} WHERE realis = 'Generic'
    UNION ALL SELECT {keys}, a.event_type, b.event_type, 'not linkable' FROM (SELECT DISTINCT {keys}, event_type FROM {types}) a JOIN (SELECT DISTINCT {keys}, event_type FROM {types}) b USING ({keys}) WHERE a.event_type <= b.event_type AND (a.event_type, b.event_type) NOT IN {_MUTUAL}"""


@query("va7_linking_validators", ", ft AS (SELECT DISTINCT system_id, doc_id, frame_id, event_type, realis FROM ided) " + _pairs("ft", "system_id, doc_id, frame_id"))
def va7(t):
    keys = ["system_id", "doc_id", "frame_id"]
    return V.linking_violations(V.linked_types(_all_frames(t), t.responses, keys), keys, _validators(t))


@query("va8_across_documents", ", ft AS (SELECT DISTINCT c.system_id, corpus_frame_id, event_type, realis FROM corpus_linking c JOIN ided i USING (system_id, doc_id, frame_id)) " + _pairs("ft", "system_id, corpus_frame_id"))
def va8(t):
    keys = ["system_id", "corpus_frame_id"]
    framed = t.corpus_linking.join(_all_frames(t), ["system_id", "doc_id", "frame_id"]).select(*keys, "response_id").distinct()
    return V.linking_violations(V.linked_types(framed, t.responses, keys), keys, _validators(t))


_CASNAME = "cas || '@' || cas_start || '-' || cas_end"


@query(
    "va9_all_key_invariants",
    f""", k AS (SELECT * FROM assessments WHERE event_type <> 'Contact.Meet'), c AS (SELECT doc_id, cas, cas_start, cas_end, CASE WHEN coref_id NOT LIKE 'c2%' THEN coref_id END AS coref_id FROM coref WHERE coref_id NOT LIKE 'c1%'),
    u AS (SELECT response_id FROM assessments WHERE NOT is_assessed OR response_id LIKE '0%')
    SELECT DISTINCT doc_id, {_CASNAME} AS item, 'coref without response' AS "check" FROM c WHERE (doc_id, cas, cas_start, cas_end) NOT IN (SELECT doc_id, cas, cas_start, cas_end FROM k)
    UNION ALL SELECT DISTINCT doc_id, {_CASNAME}, 'response without coref' FROM k WHERE (doc_id, cas, cas_start, cas_end) NOT IN (SELECT doc_id, cas, cas_start, cas_end FROM c)
    UNION ALL SELECT doc_id, response_id, 'acceptable CAS without cluster' FROM k WHERE is_assessed AND cas_ok IN ('C', 'I') AND (doc_id, cas, cas_start, cas_end) NOT IN (SELECT doc_id, cas, cas_start, cas_end FROM c WHERE coref_id IS NOT NULL)
    UNION ALL SELECT doc_id, response_id, 'assessed and unassessed' FROM k WHERE is_assessed AND response_id IN (SELECT response_id FROM u)
    UNION ALL SELECT DISTINCT doc_id, response_id, 'confidence out of range' FROM responses WHERE confidence + 0.1e0 > 1""",
)
def va9(t):
    coref = t.coref.filter("coref_id NOT LIKE 'c1%'").withColumn("coref_id", F.when(~F.col("coref_id").like("c2%"), F.col("coref_id")))
    rest = t.assessments.filter("NOT is_assessed OR response_id LIKE '0%'")
    return V.key_invariants(t.assessments.filter("event_type <> 'Contact.Meet'"), rest, coref, t.responses.withColumn("confidence", F.col("confidence") + 0.1))


@query(
    "va11_linking_invariants",
    """, f AS (SELECT doc_id, CASE WHEN doc_id LIKE '%3' THEN frame_id || '-x' ELSE frame_id END AS frame_id, response_id FROM gold_linking UNION ALL SELECT doc_id, 'copy', response_id FROM gold_linking WHERE frame_id = 'g1' AND doc_id LIKE '%5'),
    i AS (SELECT doc_id, response_id FROM incomplete UNION ALL SELECT DISTINCT doc_id, response_id FROM gold_linking WHERE response_id LIKE '1%'), r AS (SELECT DISTINCT doc_id, response_id FROM responses WHERE role <> 'Place'),
    s AS (SELECT doc_id, frame_id, list_sort(list(DISTINCT response_id)) AS m FROM f GROUP BY ALL)
    SELECT doc_id, response_id AS item, 'no argument of the document' AS "check" FROM (SELECT doc_id, response_id FROM f UNION SELECT doc_id, response_id FROM i) WHERE (doc_id, response_id) NOT IN (SELECT doc_id, response_id FROM r)
    UNION ALL SELECT DISTINCT doc_id, response_id, 'incomplete and linked' FROM i WHERE (doc_id, response_id) IN (SELECT doc_id, response_id FROM f) UNION ALL SELECT DISTINCT doc_id, frame_id, 'frame id with dash or tab' FROM f WHERE frame_id LIKE '%-%'
    UNION ALL SELECT doc_id, min(frame_id), 'several frames of these members' FROM s GROUP BY doc_id, m HAVING count(*) > 1""",
)
def va11(t):
    g = t.gold_linking
    named = g.withColumn("frame_id", F.when(F.col("doc_id").like("%3"), F.concat("frame_id", F.lit("-x"))).otherwise(F.col("frame_id")))
    frames = named.unionByName(g.filter("frame_id = 'g1' AND doc_id LIKE '%5'").withColumn("frame_id", F.lit("copy")))
    rest = t.incomplete.unionByName(g.filter("response_id LIKE '1%'").select("doc_id", "response_id").distinct())
    return V.linking_invariants(frames, rest, t.responses.filter("role <> 'Place'"))


@query("ud9_linking_strategy", ", ft AS (SELECT DISTINCT system_id, doc_id, event_type AS frame_id, event_type, realis FROM responses WHERE realis <> 'Generic') " + _pairs("ft", "system_id, doc_id, frame_id"))
def ud9(t):
    """A linking strategy, checked by composed validators."""
    keys = ["system_id", "doc_id", "frame_id"]
    return V.linking_violations(V.linked_types(L.linked(t.responses, L.same_type_frames), t.responses, keys), keys, _validators(t))
