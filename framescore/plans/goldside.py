"""Queries of document-level scoring against gold events, and of corpus queries."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from framescore.functions.scalars import gold_realis, less_specific_times
from framescore.operators import align as A
from framescore.operators import gold as G
from framescore.operators import linking as L
from framescore.operators import queries as Q
from framescore.operators import scores as S
from framescore.operators.stages import written
from framescore.sources import scans
from framescore.sources.sinks import node_name

from .registry import once, query
from .scoring import COUNTS, DRAWN, PRF, SAMPLES

ARG = G.ARG
_A = ", ".join(ARG)
KEYED = ["system_id", *ARG]
_KA = ", ".join(KEYED)
TYPES = ("Life.Die", "Life.Injure", "Conflict.Attack", "Contact.Meet")
#: Ontology lines by kind: source and target. Movement.Transport is outside it.
ONTOLOGY = {
    "type": ["life\tLife", "conflict\tConflict", "contact\tContact", "movement\tMovement"],
    "subtype": ["die\tDie", "injure\tInjure", "attack\tAttack", "meet\tMeet"],
    "role": ["victim\tVictim", "agent\tAgent", "place\tPlace", "time\tTime"],
}
_ONTOLOGY_SQL = ", ".join("('{}', '{}', '{}')".format(k, *x.split("\t")) for k, lines in ONTOLOGY.items() for x in lines)
#: Less specific forms of a date with whole fields masked, as a list in SQL.
LESS = """[CASE WHEN {c} NOT LIKE '%X%' THEN {c}[1:9] || 'X' END, CASE WHEN {c} NOT LIKE '%X%' THEN {c}[1:8] || 'XX' END, CASE WHEN {c} NOT LIKE '%XX-XX' THEN {c}[1:6] || 'X-XX' END,
    CASE WHEN {c} NOT LIKE '%XX-XX' THEN {c}[1:5] || 'XX-XX' END, {c}[1:3] || 'X-XX-XX', {c}[1:2] || 'XX-XX-XX', {c}[1:1] || 'XXX-XX-XX']"""
#: Gold tables, matches and document-level arguments in SQL.
GOLD = f""", mentions AS (SELECT DISTINCT doc_id, 'E' || (ent % 25) AS entity_id, ent AS mention_ordinal, CASE ent % 3 WHEN 0 THEN 'NAM' WHEN 1 THEN 'NOM' ELSE 'PRO' END AS mtype,
    CASE WHEN ent % 10 = 9 THEN ent * 25 + 1 ELSE ent * 25 END AS ext_start, CASE WHEN ent % 10 = 9 THEN ent * 25 + 5 ELSE ent * 25 + 12 END AS ext_end,
    CASE WHEN ent % 7 <> 0 AND ent % 10 <> 9 THEN CASE WHEN ent % 10 = 3 THEN ent * 25 + 1 ELSE ent * 25 END END AS head_start, CASE WHEN ent % 7 <> 0 AND ent % 10 <> 9 THEN ent * 25 + 5 END AS head_end FROM rows1 WHERE ent % 13 <> 5),
fillers AS (SELECT DISTINCT doc_id, 'F' || ent AS filler_id, ent AS filler_ordinal, ent * 25 AS ext_start, ent * 25 + 12 AS ext_end, CAST(NULL AS VARCHAR) AS normalized_time FROM rows1 WHERE ent % 13 = 5
  UNION ALL SELECT DISTINCT doc_id, 'T' || ent || '.' || cas, 100 + ent, CASE WHEN ent % 11 = 3 THEN ent * 25 ELSE ent * 25 + 1000 END, CASE WHEN ent % 11 = 3 THEN ent * 25 + 5 ELSE ent * 25 + 1005 END, cas FROM rows1 WHERE final AND role = 'Time'),
gargs AS (SELECT DISTINCT doc_id, hopper_id, lower(split_part(event_type, '.', 1)) AS ere_type, lower(split_part(event_type, '.', 2)) AS ere_subtype, lower(role) AS ere_role, realis, line <> 3 AS arg_realis,
    CASE WHEN role <> 'Time' AND ent % 13 <> 5 THEN 'E' || (ent % 25) END AS entity_id, CASE WHEN role = 'Time' THEN 'T' || ent || '.' || cas WHEN ent % 13 = 5 THEN 'F' || ent END AS filler_id,
    CASE WHEN role = 'Time' AND ent % 11 <> 3 THEN ent * 25 + 1000 WHEN role <> 'Time' AND ent % 13 <> 5 AND ent % 10 = 9 THEN ent * 25 + 1 ELSE ent * 25 END AS ext_start,
    CASE WHEN role = 'Time' THEN CASE WHEN ent % 11 = 3 THEN ent * 25 + 5 ELSE ent * 25 + 1005 END WHEN ent % 13 <> 5 AND ent % 10 = 9 THEN ent * 25 + 5 ELSE ent * 25 + 12 END AS ext_end, "at" + 5 AS trig_start, "at" + 12 AS trig_end FROM rows1 WHERE final),
ontology(kind, source, target) AS (VALUES {_ONTOLOGY_SQL}),
gmap AS (SELECT g.*, a.target || '.' || b.target AS event_type, c.target AS role FROM gargs g JOIN ontology a ON a.kind = 'type' AND a.source = ere_type JOIN ontology b ON b.kind = 'subtype' AND b.source = ere_subtype JOIN ontology c ON c.kind = 'role' AND c.source = ere_role),
hoppers AS (SELECT doc_id, hopper_id, event_type, list(DISTINCT {{'start': "at" + 5, 'end': "at" + 12}}) AS triggers FROM rows1 WHERE final GROUP BY ALL),
regions AS (SELECT DISTINCT doc_id, 90 AS s, 130 AS e FROM rows1 WHERE doc_no % 6 = 0),
heads AS (SELECT DISTINCT doc_id, ent * 25 AS hs, ent * 25 + 5 AS he, ent * 25 + 1 AS a, ent * 25 + 5 AS b FROM rows1 WHERE ent % 4 = 1 UNION ALL SELECT DISTINCT doc_id, ent * 25, ent * 25 + 12, CASE WHEN ent % 14 = 7 THEN ent * 25 + 1 ELSE ent * 25 END, ent * 25 + 5 FROM rows1 WHERE ent % 7 = 0),
plays AS (SELECT DISTINCT doc_id, filler_id IS NOT NULL AS is_filler, coalesce(filler_id, entity_id) AS object_id, event_type, role FROM gmap),
rank0 AS (SELECT doc_id, entity_id, max(CASE mtype WHEN 'NAM' THEN 2 WHEN 'NOM' THEN 1 ELSE 0 END) AS rank FROM mentions GROUP BY ALL),
cand0 AS (SELECT doc_id, CASE mtype WHEN 'NAM' THEN 'Name' WHEN 'NOM' THEN 'Nominal' ELSE 'Pronoun' END AS kind, entity_id AS object_id, 0 AS late, mention_ordinal AS ordinal, ext_start AS xs, ext_end AS xe, coalesce(head_start, ext_start) AS ds, coalesce(head_end, ext_end) AS de FROM mentions
  UNION ALL SELECT doc_id, 'Filler', filler_id, 1, filler_ordinal, ext_start, ext_end, ext_start, ext_end FROM fillers),
cand AS (SELECT c.*, coalesce(a, ds) AS ks, coalesce(b, de) AS ke FROM cand0 c LEFT JOIN heads h ON h.doc_id = c.doc_id AND h.hs = ds AND h.he = de),
rs AS (SELECT DISTINCT system_id, doc_id, response_id, event_type, role, realis, cas, cas_start, cas_end FROM responses),
m0 AS (SELECT r.*, coalesce(a, cas_start) AS rhs, coalesce(b, cas_end) AS rhe FROM rs r LEFT JOIN heads h ON h.doc_id = r.doc_id AND h.hs = cas_start AND h.he = cas_end),
m1 AS (SELECT m0.*, kind, object_id, late, ordinal, CASE WHEN xs = cas_start AND xe = cas_end THEN 1 WHEN ds = cas_start AND de = cas_end THEN 2 WHEN ks = cas_start AND ke = cas_end THEN 3 WHEN xs = rhs AND xe = rhe THEN 4 WHEN ds = rhs AND de = rhe THEN 5 WHEN ks = rhs AND ke = rhe THEN 6
  WHEN xs <= cas_start AND cas_end <= xe AND ((cas_start <= ds AND de <= cas_end AND cas_start <= rhs AND rhe <= cas_end) OR (xs <= rhs AND rhe <= xe AND xs <= ds AND de <= xe)) THEN 7 END AS rule FROM m0 JOIN cand USING (doc_id)),
matched AS (SELECT * FROM (SELECT m1.*, row_number() OVER (PARTITION BY system_id, response_id ORDER BY rule, CASE WHEN p.doc_id IS NULL THEN 1 ELSE 0 END, late, ordinal, m1.kind, m1.object_id) AS rn
  FROM m1 LEFT JOIN plays p ON p.doc_id = m1.doc_id AND p.is_filler = (m1.kind = 'Filler') AND p.object_id = m1.object_id AND p.event_type = m1.event_type AND p.role = m1.role WHERE rule IS NOT NULL) WHERE rn = 1),
sargs AS (SELECT rs.system_id, rs.doc_id, rs.event_type, rs.role, rs.realis, rs.response_id, CASE WHEN rs.role = 'Time' THEN 'Time-' || rs.cas WHEN object_id IS NOT NULL THEN kind || '-' || object_id
  ELSE 'AlignmentFailure-' || rs.cas_start || '-' || rs.cas_end END AS coref_id FROM rs LEFT JOIN matched m ON m.system_id = rs.system_id AND m.response_id = rs.response_id),
garg AS (SELECT DISTINCT g.doc_id, hopper_id, event_type, role, CASE WHEN realis = 'Generic' THEN 'Generic' WHEN NOT arg_realis THEN 'Other' ELSE realis END AS realis,
  CASE WHEN ere_role = 'time' THEN 'Time-' || normalized_time WHEN g.filler_id IS NOT NULL THEN 'Filler-' || g.filler_id ELSE CASE rank WHEN 2 THEN 'Name' WHEN 1 THEN 'Nominal' ELSE 'Pronoun' END || '-' || g.entity_id END AS coref_id
  FROM gmap g LEFT JOIN rank0 r ON r.doc_id = g.doc_id AND r.entity_id = g.entity_id LEFT JOIN fillers f ON f.doc_id = g.doc_id AND f.filler_id = g.filler_id
  WHERE NOT EXISTS (SELECT 1 FROM regions q WHERE q.doc_id = g.doc_id AND (g.ext_start BETWEEN s AND e OR g.ext_end BETWEEN s AND e OR trig_start BETWEEN s AND e OR trig_end BETWEEN s AND e))),
gsc0 AS (SELECT * FROM garg WHERE event_type IN {TYPES} AND role <> 'Place'), ssc0 AS (SELECT * FROM sargs WHERE event_type IN {TYPES} AND role <> 'Place'),
inj AS (SELECT DISTINCT doc_id, 'Life.Injure' AS event_type, role, realis, coref_id FROM gsc0 WHERE event_type = 'Life.Die'),
gsc AS (SELECT * FROM gsc0 WHERE ({_A}) NOT IN (SELECT {_A} FROM inj)), ssc AS (SELECT * FROM ssc0 WHERE ({_A}) NOT IN (SELECT {_A} FROM inj)),
vague AS (SELECT DISTINCT system_id, doc_id, event_type, role, realis, 'Time-' || u AS coref_id FROM (SELECT *, unnest({LESS.format(c="tm")}) AS u FROM (SELECT *, substr(coref_id, 6) AS tm FROM gsc WHERE role = 'Time')) JOIN (SELECT DISTINCT system_id, doc_id, event_type FROM ssc WHERE role = 'Time') USING (doc_id, event_type) WHERE u IS NOT NULL),
systems AS (SELECT DISTINCT system_id FROM responses),
gfin AS (SELECT * FROM gsc, systems WHERE ({_KA}) NOT IN (SELECT {_KA} FROM vague)), sfin AS (SELECT * FROM ssc WHERE ({_KA}) NOT IN (SELECT {_KA} FROM vague)),
gset AS (SELECT DISTINCT {_KA} FROM gfin), sset AS (SELECT DISTINCT {_KA} FROM sfin),
dall AS (SELECT {_KA}, CASE WHEN g IS NULL THEN 'FP' WHEN s IS NULL THEN 'FN' ELSE 'TP' END AS cell FROM (SELECT *, 1 AS g FROM gset) FULL JOIN (SELECT *, 1 AS s FROM sset) USING ({_KA})),
dnone AS (SELECT system_id, doc_id, event_type, role, coref_id, CASE WHEN g IS NULL THEN 'FP' WHEN s IS NULL THEN 'FN' ELSE 'TP' END AS cell FROM (SELECT DISTINCT system_id, doc_id, event_type, role, coref_id, 1 AS g FROM gset) FULL JOIN (SELECT DISTINCT system_id, doc_id, event_type, role, coref_id, 1 AS s FROM sset) USING (system_id, doc_id, event_type, role, coref_id)),
dboth AS (SELECT 'withRealis' AS mode, system_id, doc_id, event_type, role, coref_id, cell FROM dall UNION ALL SELECT 'noRealis', * FROM dnone)"""
_KNOWN = "ent % 7 <> 0 AND ent % 10 <> 9"


def _small(t, rows: list[tuple], *names: str):
    """A table of a few given rows, of known size."""
    return t.spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, row, strict=True)]) for row in rows])))


class Gold:
    """The gold tables of a Tables object, and both sides' document-level arguments."""

    def __init__(self, t):
        self.t, self.keep = t, ["system_id", "response_id"]
        used = ["doc_no", "doc_id", "event_type", "role", "realis", "ent", "cas", "hopper_id", "line", "final", "at"]
        t.in_buckets()
        rows = t.dealt.select(*used)
        at = "CASE WHEN ent % 10 = 9 THEN ent * 25 + 1 ELSE ent * 25 END"
        end = "CASE WHEN ent % 10 = 9 THEN ent * 25 + 5 ELSE ent * 25 + 12 END"
        time_at = "CASE WHEN ent % 11 = 3 THEN ent * 25 ELSE ent * 25 + 1000 END"
        named = lambda **c: [F.expr(x).alias(k) for k, x in c.items()]
        # the kinds of a table's rows, each with its condition, from one scan
        each = lambda *kinds: rows.select("doc_id", F.inline(F.array_compact(F.array(*[F.when(F.expr(where), F.struct(*named(**c))) for where, c in kinds])))).distinct()
        self.mentions = rows.filter("ent % 13 <> 5").select("doc_id", *named(
            entity_id="concat('E', ent % 25)", mention_ordinal="ent", mtype="CASE ent % 3 WHEN 0 THEN 'NAM' WHEN 1 THEN 'NOM' ELSE 'PRO' END", ext_start=at, ext_end=end,
            head_start=f"CASE WHEN {_KNOWN} THEN CASE WHEN ent % 10 = 3 THEN ent * 25 + 1 ELSE ent * 25 END END", head_end=f"CASE WHEN {_KNOWN} THEN ent * 25 + 5 END",
        )).distinct()
        self.fillers = each(
            ("ent % 13 = 5", dict(filler_id="concat('F', ent)", filler_ordinal="ent", ext_start="ent * 25", ext_end="ent * 25 + 12", normalized_time="CAST(NULL AS STRING)")),
            ("final AND role = 'Time'", dict(filler_id="concat('T', ent, '.', cas)", filler_ordinal="100 + ent", ext_start=time_at, ext_end=f"{time_at} + 5", normalized_time="cas")),
        )
        self.arguments = rows.filter("final").select("doc_id", "hopper_id", *named(
            ere_type="lower(split_part(event_type, '.', 1))", ere_subtype="lower(split_part(event_type, '.', 2))", ere_role="lower(role)", realis="realis", arg_realis="line <> 3",
            entity_id="CASE WHEN role <> 'Time' AND ent % 13 <> 5 THEN concat('E', ent % 25) END", filler_id="CASE WHEN role = 'Time' THEN concat('T', ent, '.', cas) WHEN ent % 13 = 5 THEN concat('F', ent) END",
            ext_start=f"CASE WHEN role = 'Time' THEN {time_at} WHEN ent % 13 = 5 THEN ent * 25 ELSE {at} END", ext_end=f"CASE WHEN role = 'Time' THEN {time_at} + 5 WHEN ent % 13 = 5 THEN ent * 25 + 12 ELSE {end} END",
            trig_start="at + 5", trig_end="at + 12",
        )).distinct()
        trigger = F.struct((F.col("at") + 5).alias("start"), (F.col("at") + 12).alias("end"))
        self.hoppers = rows.filter("final").groupBy("doc_id", "hopper_id", "event_type").agg(F.collect_set(trigger).alias("triggers"))
        self.heads = t.kept(each(
            ("ent % 4 = 1", dict(start="ent * 25", end="ent * 25 + 5", head_start="ent * 25 + 1", head_end="ent * 25 + 5")),
            ("ent % 7 = 0", dict(start="ent * 25", end="ent * 25 + 12", head_start="CASE WHEN ent % 14 = 7 THEN ent * 25 + 1 ELSE ent * 25 END", head_end="ent * 25 + 5")),
        ))
        self.quotes = rows.filter("doc_no % 6 = 0").select("doc_id", F.lit(90).alias("start"), F.lit(130).alias("end")).distinct()
        lines = _small(t, [(k, x) for k, v in ONTOLOGY.items() for x in v], "kind", "line")
        self.ontology = scans.ontology_map(lines)
        self.mapped = G.in_ontology(self.arguments, self.ontology)
        self.plays = t.kept(G.roles_played(self.arguments, self.ontology))
        self.candidates = G.candidates(self.mentions, self.fillers)
        self.own = t.kept(t.responses.select("system_id", "doc_id", "response_id", "event_type", "role", "realis", "cas", "cas_start", "cas_end"))
        self.gargs = G.gold_arguments(self.arguments, self.mentions, self.fillers, self.ontology, self.quotes)

    @functools.cached_property
    def spans(self):
        return self.t.kept(G.match_spans(self.own, self.candidates, self.plays, self.heads, self.t.kept))

    @functools.cached_property
    def matched(self):
        return self.own.select(*self.keep, *G.MATCH).join(self.spans, G.MATCH).select(*self.keep, "rule", "kind", "object_id")

    @functools.cached_property
    def sargs(self):
        return G.response_coref(self.own, self.spans, G.MATCH)

    @functools.cached_property
    def scope(self):
        """(gold, system, vague): both sides' rows in scope, gold's once for all systems, and times that do not count."""
        types, kept = _small(self.t, [(x,) for x in TYPES], "event_type"), self.t.kept
        gold = kept(G.in_scope(self.gargs, types, ["Place"]))
        system = kept(G.without_implied_injuries(G.in_scope(self.sargs, types, ["Place"]), gold, ARG).select("system_id", "response_id", *ARG))
        gold = kept(G.without_implied_injuries(gold, gold, ARG))
        return gold, system, kept(G.vague_times(gold, system))  # all three are read several times

    @functools.cached_property
    def sides(self):
        """Rows of the document-level scorer: gold ones (with hopper_id) for each system, the system's (with response_id)."""
        gold, system, vague = self.scope
        return gold.crossJoin(F.broadcast(self.t.systems)).join(vague, KEYED, "left_anti"), system.join(vague, KEYED, "left_anti")

    def document_counts(self):
        return G.document_counts(*self.scope, self.t.systems)

    def scoped(self):
        gold, system = self.sides
        return gold.select(*KEYED).distinct(), system.select(*KEYED).distinct()

    def frames(self):
        """(gold, system) frames of document-level arguments; generic ones are not linked."""
        gold, system = self.sides
        gold = gold.withColumn("frame_id", F.col("hopper_id"))
        system = self.t.linking.join(system, ["system_id", "doc_id", "response_id"])
        return gold.select(*KEYED, "frame_id"), system.select(*KEYED, "frame_id")


@once
def gold(t) -> Gold:
    return Gold(t)


@query("jn10_entity_match", f"{GOLD} SELECT system_id, response_id, rule, kind, object_id FROM matched")
def jn10(t):
    return gold(t).matched


@query("jn12_span_heads", f"{GOLD} SELECT DISTINCT r.doc_id, cas_start, cas_end, coalesce(a, cas_start) AS head_start, coalesce(b, cas_end) AS head_end FROM rows1 r LEFT JOIN heads h ON h.doc_id = r.doc_id AND hs = cas_start AND he = cas_end")
def jn12(t):
    return G.with_heads(t.rows.select("doc_id", "cas_start", "cas_end").distinct(), gold(t).heads, "cas_start", "cas_end").select("doc_id", "cas_start", "cas_end", "head_start", "head_end")


@query("jn13_roles_played", f"{GOLD} SELECT c.doc_id, kind, c.object_id, ordinal, string_agg(DISTINCT event_type || '.' || role, ',' ORDER BY event_type || '.' || role) AS roles FROM cand c LEFT JOIN plays p ON p.doc_id = c.doc_id AND p.object_id = c.object_id AND p.is_filler = (kind = 'Filler') GROUP BY ALL")
def jn13(t):
    g = gold(t)
    ordinal = F.col("ordinal") - F.when(F.col("kind") == "Filler", G.AFTER_MENTIONS).otherwise(0)
    found = g.candidates.select("doc_id", "kind", "object_id", (F.col("kind") == "Filler").alias("is_filler"), ordinal.alias("ordinal"))
    joined = found.join(g.plays, ["doc_id", "is_filler", "object_id"], "left")
    r = F.when(F.col("role").isNotNull(), F.concat_ws(".", "event_type", "role"))
    return joined.groupBy("doc_id", "kind", "object_id", "ordinal").agg(F.nullif(F.array_join(F.array_sort(F.collect_set(r)), ","), F.lit("")).alias("roles"))


_ONT = [("type", "Life.Die", "life.die"), ("type", "Conflict.Attack", "conflict.attack"), ("type", "Contact.Meet", "contact.meet")]


@query("jn14_ontology_mapping", "SELECT DISTINCT response_id, lower(event_type) AS event_type FROM responses WHERE event_type IN ('Life.Die', 'Conflict.Attack', 'Contact.Meet')")
def jn14(t):
    ontology = t.spark.createDataFrame(_ONT, "kind string, source string, target string")
    return G.mapped_types(t.responses, ontology, "type", "event_type")[0].select("response_id", "event_type").distinct()


@query("jn14_outside_ontology", f"{GOLD}, u AS (SELECT unnest([{{'kind': 'type', 'v': ere_type}}, {{'kind': 'subtype', 'v': ere_subtype}}, {{'kind': 'role', 'v': ere_role}}]) AS u FROM gargs) SELECT u.kind AS kind, u.v AS \"value\", count(*) AS n FROM u WHERE (u.kind, u.v) NOT IN (SELECT kind, source FROM ontology) GROUP BY ALL")
def jn14_outside(t):
    return G.outside_ontology(gold(t).arguments, gold(t).ontology)


@query("sc16_ontology_scan", f"{GOLD} SELECT kind, source, target, count(*) AS n FROM ontology JOIN (SELECT unnest([{{'kind': 'type', 'v': ere_type}}, {{'kind': 'subtype', 'v': ere_subtype}}, {{'kind': 'role', 'v': ere_role}}]) AS u FROM gargs) g ON g.u.kind = kind AND g.u.v = source GROUP BY ALL")
def sc16(t):
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("source")) for c, k in G.ERE_KINDS.items()])
    return gold(t).arguments.select(F.inline(pairs)).join(gold(t).ontology, ["kind", "source"]).groupBy("kind", "source", "target").agg(F.count(F.lit(1)).alias("n"))


@query("tr13_gold_arguments", f"{GOLD} SELECT * FROM garg")
def tr13(t):
    return gold(t).gargs


@query("fn10_gold_realis", f"{GOLD} SELECT DISTINCT realis, arg_realis, CASE WHEN realis = 'Generic' THEN 'Generic' WHEN NOT arg_realis THEN 'Other' ELSE realis END AS resolved FROM gargs")
def fn10(t):
    return gold(t).arguments.select("realis", "arg_realis", gold_realis(F.col("realis"), F.col("arg_realis")).alias("resolved")).distinct()


@query("tr14_system_arguments", f"{GOLD} SELECT DISTINCT system_id, {_A} FROM sargs")
def tr14(t):
    return gold(t).sargs.select("system_id", *ARG).distinct()


@query("tr14_system_frames", f"{GOLD} SELECT DISTINCT l.system_id, l.doc_id, frame_id, s.event_type, s.role, coref_id FROM linking l JOIN sargs s ON s.system_id = l.system_id AND s.response_id = l.response_id")
def tr14f(t):
    return t.linking.join(gold(t).sargs.drop("doc_id"), ["system_id", "response_id"]).select("system_id", "doc_id", "frame_id", "event_type", "role", "coref_id").distinct()


@query("pf9_tr15_scoped_arguments", f"{GOLD} SELECT 'gold' AS side, {_KA} FROM gset UNION ALL SELECT 'system', {_KA} FROM sset")
def pf9(t):
    g, s = gold(t).scoped()
    return g.select(F.lit("gold").alias("side"), *KEYED).unionByName(s.select(F.lit("system").alias("side"), *KEYED))


def _doc_alignment(t, neutral=False):
    g, s = gold(t).scoped()
    if neutral:
        g, s = G.neutralised(g, KEYED), G.neutralised(s, KEYED)
    return A.exact_match(g, s, KEYED)


def _both_modes(t):
    mode = lambda m, neutral: _doc_alignment(t, neutral).withColumn("mode", F.lit(m))
    return mode("withRealis", False).unionByName(mode("noRealis", True))


@query("jn5_exact_match", f"{GOLD} SELECT {_KA}, cell FROM dall")
def jn5(t):
    return _doc_alignment(t)


_LINEAR = "100 * sum(greatest(tp - 0.25e0 * fp, 0)) / greatest(sum(tp + fn), 1) AS linear"


@query(
    "sco5_document_scores",
    f"{GOLD}, c AS (SELECT mode, system_id, doc_id, {COUNTS} FROM dboth GROUP BY ALL), s AS (SELECT mode, system_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, {_LINEAR} FROM c GROUP BY ALL) SELECT *, {PRF} FROM s",
)
def sco5(t):
    """Arguments with realis and without, over all documents."""
    c = gold(t).document_counts()
    return S.with_f(S.linear_score_2016(c, by=["mode", "system_id"], counts=True))


_KIND = "CASE WHEN coref_id LIKE '%Name%' THEN 'Name' WHEN coref_id LIKE '%Nominal%' THEN 'Nominal' WHEN coref_id LIKE '%Pronoun%' THEN 'Pronoun' WHEN coref_id LIKE '%Filler%' THEN 'Filler' WHEN coref_id LIKE '%Time%' THEN 'Time' ELSE 'Other' END"


def mention_kind():
    """By substring tests in a fixed order, over the whole coref id."""
    c, found = F.col("coref_id"), None
    for kind in ("Name", "Nominal", "Pronoun", "Filler", "Time"):
        found = F.when(c.contains(kind), kind) if found is None else found.when(c.contains(kind), kind)
    return found.otherwise("Other")


@query(
    "sco5_breakdowns",
    f"""{GOLD}, k AS (SELECT mode, system_id, cell, unnest([{{'kind': 'EventType', 'key': event_type}}, {{'kind': 'EventTypeRole', 'key': event_type || '/' || role}}, {{'kind': 'MentionType', 'key': {_KIND}}}]) AS k FROM dboth),
    c AS (SELECT mode, system_id, k.kind AS kind, k.key AS "key", {COUNTS} FROM k GROUP BY ALL) SELECT *, {PRF} FROM c""",
)
def sco5_breakdowns(t):
    kinds = {"EventType": F.col("event_type"), "EventTypeRole": F.concat_ws("/", "event_type", "role"), "MentionType": mention_kind()}
    return S.with_f(S.breakdown(_both_modes(t), kinds, by=["mode", "system_id"]))


@query(
    "sco5_bootstrapped_arguments",
    f"""{GOLD}, doc_counts AS (SELECT mode, system_id, doc_id, {COUNTS} FROM dboth GROUP BY ALL){DRAWN} SELECT sample, mode, system_id, 100 * sum(times * greatest(tp - 0.25e0 * fp, 0)) / greatest(sum(times * (tp + fn)), 1) AS linear FROM doc_counts JOIN drawn USING (doc_id) GROUP BY ALL""",
)
def sco5_bootstrap(t):
    counts = written(gold(t).document_counts())
    w = lambda c: F.sum(F.col("times") * c)
    linear = 100 * w(F.greatest(F.col("tp") - 0.25 * F.col("fp"), F.lit(0.0))) / F.greatest(w(F.col("tp") + F.col("fn")), F.lit(1))
    return S.bootstrapped(counts, S.drawn_samples(counts.select("doc_id").distinct(), "doc_id", SAMPLES), "doc_id", ["mode", "system_id"], {"linear": linear})


def _link_sql(name: str, realis: str, by: str = "") -> str:
    """Link scores in SQL of the frames of gfin and sfin; by: a further key, as ', event_type'."""
    item = f"event_type || '|' || role || '|' || {realis}coref_id"
    k, on = f"system_id, doc_id{by}", f"system_id, doc_id{by}, item"
    return f""", {name}g AS (SELECT DISTINCT system_id, doc_id, event_type, hopper_id AS frame_id, {item} AS item FROM gfin WHERE realis IN ('Other', 'Actual')),
{name}s AS (SELECT DISTINCT s.system_id, s.doc_id, s.event_type, l.frame_id, {item} AS item FROM sfin s JOIN linking l ON l.system_id = s.system_id AND l.response_id = s.response_id WHERE realis IN ('Other', 'Actual') AND (s.system_id, s.doc_id, {item}) IN (SELECT system_id, doc_id, item FROM {name}g)),
{name}gn AS (SELECT DISTINCT {k}, a.item, b.item AS other FROM {name}g a JOIN {name}g b USING ({k}, frame_id) WHERE a.item <> b.item), {name}sn AS (SELECT DISTINCT {k}, a.item, b.item AS other FROM {name}s a JOIN {name}s b USING ({k}, frame_id) WHERE a.item <> b.item),
{name}p AS (SELECT DISTINCT {on} FROM {name}s), {name}x AS (SELECT {on}, count(*) FILTER (g = 1 AND p = 1) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM (SELECT {on}, other, 1 AS g FROM {name}p JOIN {name}gn USING ({on})) FULL JOIN (SELECT *, 1 AS p FROM {name}sn) USING ({on}, other) GROUP BY ALL),
{name}v AS (SELECT {k}, CASE WHEN tp + fp + fn = 0 THEN 1.0e0 WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fp + fn = 0 THEN 1.0e0 WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r, CASE WHEN tp + fp + fn = 0 THEN 1.0e0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f
  FROM (SELECT {on}, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM {name}p LEFT JOIN {name}x USING ({on}))),
{name} AS (SELECT {k}, n_gold, coalesce(n, 0) AS n_predicted, coalesce(p / n, 0) AS precision, coalesce(r / n_gold, 0) AS recall, coalesce(f / n_gold, 0) AS link_f1 FROM (SELECT {k}, count(DISTINCT item) AS n_gold FROM {name}g GROUP BY ALL) LEFT JOIN (SELECT {k}, count(*) AS n, sum(p) AS p, sum(r) AS r, sum(f) AS f FROM {name}v GROUP BY ALL) USING ({k}))"""


_SUMS = "sum(precision * n_predicted) / sum(n_gold) AS link_precision, sum(recall * n_gold) / sum(n_gold) AS link_recall, sum(link_f1 * n_gold) / sum(n_gold) AS link_f1"
LINKS = _link_sql("lw", "realis || '|' || ") + _link_sql("ln", "")
LINKS_BY_TYPE = _link_sql("lw", "realis || '|' || ", ", event_type") + _link_sql("ln", "", ", event_type")


@once
def doc_links(t):
    """Link scores of each document in both modes."""
    mode = lambda m, neutral: L.link_f1(*map(t.kept, G.linkable(*gold(t).frames(), neutral)), lies=True).withColumn("mode", F.lit(m))
    return mode("withRealis", False).unionByName(mode("noRealis", True))


@query("sco5_document_links", f"{GOLD}{LINKS} SELECT 'withRealis' AS mode, * FROM lw UNION ALL SELECT 'noRealis', * FROM ln")
def sco5_document_links(t):
    return doc_links(t)


@query("sco5_linking_scores", f"{GOLD}{LINKS} SELECT 'withRealis' AS mode, system_id, {_SUMS} FROM lw GROUP BY ALL UNION ALL SELECT 'noRealis', system_id, {_SUMS} FROM ln GROUP BY ALL")
def sco5_linking(t):
    return L.link_aggregate_2016(doc_links(t), ["mode", "system_id"])


@query("sco5_linking_by_type", f"{GOLD}{LINKS_BY_TYPE} SELECT 'withRealis' AS mode, system_id, event_type, {_SUMS} FROM lw GROUP BY ALL UNION ALL SELECT 'noRealis', system_id, event_type, {_SUMS} FROM ln GROUP BY ALL")
def sco5_linking_by_type(t):
    mode = lambda m, neutral: L.link_f1(*map(t.kept, G.linkable(*gold(t).frames(), neutral)), by=["doc_id", "event_type"], lies=True).withColumn("mode", F.lit(m))
    return L.link_aggregate_2016(mode("withRealis", False).unionByName(mode("noRealis", True)), ["mode", "system_id", "event_type"])


@query(
    "sco5_bootstrapped_links",
    f"""{GOLD}{LINKS}, lb AS (SELECT 'withRealis' AS mode, * FROM lw UNION ALL SELECT 'noRealis', * FROM ln), doc_counts AS (SELECT DISTINCT doc_id FROM lb){DRAWN}
    SELECT sample, mode, system_id, sum(times * precision * n_predicted) / sum(times * n_gold) AS link_precision, sum(times * recall * n_gold) / sum(times * n_gold) AS link_recall, sum(times * link_f1 * n_gold) / sum(times * n_gold) AS link_f1 FROM lb JOIN drawn USING (doc_id) GROUP BY ALL""",
)
def sco5_bootstrapped_links(t):
    links = written(doc_links(t))
    drawn = S.drawn_samples(links.select("doc_id").distinct(), "doc_id", SAMPLES)
    return S.bootstrapped(links, drawn, "doc_id", ["mode", "system_id"], L.link_measures_2016(F.col("times")))


@query("fn12_neutralised_scores", f"{GOLD}, c AS (SELECT system_id, event_type, {COUNTS} FROM dnone GROUP BY ALL) SELECT *, {PRF} FROM c")
def fn12(t):
    return S.with_f(A.cells(_doc_alignment(t, neutral=True), ["system_id", "event_type"]))


@query("ag4_by_mention_type", f"{GOLD}, c AS (SELECT system_id, {_KIND} AS mention_kind, {COUNTS} FROM dall GROUP BY ALL) SELECT *, {PRF} FROM c")
def ag4m(t):
    return S.with_f(A.cells(_doc_alignment(t).withColumn("mention_kind", mention_kind()), ["system_id", "mention_kind"]))


@query("fn11_objects_of_ids", f"{GOLD} SELECT DISTINCT coref_id, split_part(coref_id, '-', 1) AS kind, substr(coref_id, length(split_part(coref_id, '-', 1)) + 2) AS object_id FROM sargs WHERE coref_id NOT LIKE 'AlignmentFailure%'")
def fn11(t):
    d = gold(t).sargs.select("coref_id").distinct().withColumn("o", G.object_of(F.col("coref_id"))).filter("o IS NOT NULL")
    return d.select("coref_id", "o.kind", "o.object_id")


@query("ag20_alignment_failures", f"{GOLD} SELECT system_id, event_type, role, count(DISTINCT response_id) AS failed FROM sargs WHERE coref_id LIKE 'AlignmentFailure%' GROUP BY ALL")
def ag20(t):
    return gold(t).sargs.filter("coref_id LIKE 'AlignmentFailure%'").groupBy("system_id", "event_type", "role").agg(F.count_distinct("response_id").alias("failed"))


@query("jn27_argument_hoppers", f"{GOLD} SELECT DISTINCT event_type, role, entity_id, doc_id, hopper_id FROM gmap WHERE entity_id IS NOT NULL")
def jn27(t):
    return gold(t).mapped.filter("entity_id IS NOT NULL").select("event_type", "role", "entity_id", "doc_id", "hopper_id").distinct()


@query("tr17_linkable_arguments", GOLD + _link_sql("lw", "realis || '|' || ") + " SELECT DISTINCT system_id, doc_id, frame_id, item FROM lws")
def tr17(t):
    return G.linkable(*gold(t).frames())[1].select("system_id", "doc_id", "frame_id", "item").distinct()


@query(
    "tr16_time_specificity",
    """, g AS (SELECT DISTINCT doc_id, event_type, realis, cas FROM rows1 WHERE role = 'Time' AND final), l AS (SELECT DISTINCT doc_id, event_type, realis, u AS cas FROM (SELECT *, unnest([
    CASE WHEN cas NOT LIKE '%X%' THEN cas[1:9] || 'X' END, CASE WHEN cas NOT LIKE '%X%' THEN cas[1:8] || 'XX' END, CASE WHEN cas NOT LIKE '%XX-XX' THEN cas[1:6] || 'X-XX' END, CASE WHEN cas NOT LIKE '%XX-XX' THEN cas[1:5] || 'XX-XX' END,
    cas[1:3] || 'X-XX-XX', cas[1:2] || 'XX-XX-XX', cas[1:1] || 'XXX-XX-XX']) AS u FROM g) WHERE u IS NOT NULL)
    SELECT DISTINCT system_id, doc_id, event_type, realis, cas FROM responses WHERE role = 'Time' AND (doc_id, event_type, realis, cas) NOT IN (SELECT doc_id, event_type, realis, cas FROM l)""",
)
def tr16(t):
    g = t.rows.filter("role = 'Time' AND final").select("doc_id", "event_type", "realis", "cas").distinct()
    ban = g.select("doc_id", "event_type", "realis", F.explode(less_specific_times(F.col("cas"))).alias("cas")).distinct()
    own = t.responses.filter("role = 'Time'").select("system_id", "doc_id", "event_type", "realis", "cas").distinct()
    return own.join(ban, ["doc_id", "event_type", "realis", "cas"], "left_anti").select(*own.columns)


#: Corpus queries in SQL.
CORPUS = f"""{GOLD}, ep AS (SELECT DISTINCT 'Q' || (doc_no % 25) AS query_id, CAST(doc_no AS INT) AS ep_ordinal, doc_id, hopper_id, role, 'E' || (ent % 25) AS entity_id FROM rows1 WHERE final AND role <> 'Time' AND doc_no % 10 = 0),
qm0 AS (SELECT *, CASE mtype WHEN 'NAM' THEN 2 WHEN 'NOM' THEN 1 ELSE 0 END AS rank FROM ep JOIN mentions USING (doc_id, entity_id)),
qm AS (SELECT * FROM (SELECT *, max(rank) OVER (PARTITION BY query_id, doc_id, hopper_id, role, entity_id) AS b FROM qm0) WHERE rank = b),
qp AS (SELECT q.*, h.event_type, r.system_id, r.response_id, r.cas_start, r.cas_end, CASE WHEN r.cas_start = ext_start AND r.cas_end = ext_end THEN 1 WHEN mtype = 'NAM' AND ext_start <= r.cas_start AND r.cas_end <= ext_end THEN 2
  WHEN mtype = 'NAM' AND r.cas_start <= ext_start AND ext_end <= r.cas_end THEN 3 WHEN mtype = 'NOM' AND ((ext_start <= r.cas_start AND r.cas_end <= ext_end AND (head_start IS NULL OR (r.cas_start <= head_start AND head_end <= r.cas_end)) AND r.cas_end - r.cas_start + 1 >= 0.3e0 * (ext_end - ext_start + 1))
  OR (r.cas_start <= ext_start AND ext_end <= r.cas_end AND ext_end - ext_start + 1 >= 0.3e0 * (r.cas_end - r.cas_start + 1))) THEN 4 END AS rule
  FROM qm q JOIN hoppers h USING (doc_id, hopper_id) JOIN responses r ON r.doc_id = q.doc_id AND r.event_type = h.event_type AND r.role = q.role
  WHERE EXISTS (SELECT 1 FROM (SELECT unnest(r.pj) AS p) x, (SELECT unnest(h.triggers) AS g) y WHERE greatest(p.start - 20, 0) <= g.start AND g.end <= p.end + 20)),
qmatch AS (SELECT DISTINCT query_id, system_id, doc_id, response_id FROM (SELECT *, rank() OVER (PARTITION BY system_id, query_id, ep_ordinal ORDER BY rule) AS rk FROM qp WHERE rule IS NOT NULL) WHERE rk = 1),
qown AS (SELECT DISTINCT query_id, m.system_id, m.doc_id, frame_id FROM qmatch m JOIN linking l ON l.system_id = m.system_id AND l.response_id = m.response_id),
qcf AS (SELECT DISTINCT query_id, system_id, corpus_frame_id FROM qown JOIN corpus_linking USING (system_id, doc_id, frame_id)),
qframes AS (SELECT * FROM qown UNION SELECT query_id, system_id, doc_id, frame_id FROM qcf JOIN corpus_linking USING (system_id, corpus_frame_id))"""


def entry_points(t):
    d = t.rows.filter("final AND role <> 'Time' AND doc_no % 10 = 0")
    return d.select(F.concat(F.lit("Q"), (F.col("doc_no") % 25).cast("string")).alias("query_id"), F.col("doc_no").cast("int").alias("ep_ordinal"), "doc_id", "hopper_id", "role", F.concat(F.lit("E"), (F.col("ent") % 25).cast("string")).alias("entity_id")).distinct()


def _matches(t):
    g = gold(t)
    return Q.matching_responses(entry_points(t), g.mentions, t.responses, g.hoppers, slack=20)


@query("jn19_query_mentions", f"{CORPUS} SELECT query_id, doc_id, hopper_id, role, entity_id, mention_ordinal, rank FROM qm")
def jn19(t):
    return Q.query_mentions(entry_points(t), gold(t).mentions).select("query_id", "doc_id", "hopper_id", "role", "entity_id", "mention_ordinal", "rank")


@query("jn16_query_matches", f"{CORPUS} SELECT * FROM qmatch")
def jn16(t):
    return _matches(t)


@query("sco6_corpus_queries", f"{CORPUS} SELECT * FROM qframes")
def sco6(t):
    return Q.execute(_matches(t), t.linking, t.corpus_linking)


@query("wn5_capped_sample", f"{CORPUS} SELECT system_id, query_id, doc_id, frame_id FROM qframes WHERE (system_id, query_id, doc_id) IN (SELECT system_id, query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY system_id, query_id ORDER BY md5('0|' || doc_id)) AS rn FROM (SELECT DISTINCT system_id, query_id, doc_id FROM qframes)) WHERE rn <= 3)")
def wn5(t):
    return Q.capped(sco6(t), 3)


@query("sco9_query_responses", f"{CORPUS}, x AS (SELECT DISTINCT q.system_id, query_id, q.doc_id, unnest(r.pj) AS p FROM qframes q JOIN linking l USING (system_id, doc_id, frame_id) JOIN responses r ON r.system_id = l.system_id AND r.response_id = l.response_id) SELECT system_id, query_id, doc_id, count(DISTINCT p) AS n_pj, min(p.start) AS first_start FROM x GROUP BY ALL")
def sco9(t):
    d = Q.collapsed(sco6(t), t.linking, t.responses)
    return d.select("system_id", "query_id", "doc_id", F.size("pj").cast("long").alias("n_pj"), F.get("pj", F.lit(0))["start"].alias("first_start"))


@query("sco8_derived_entry_points", f"{GOLD}, f AS (SELECT DISTINCT m.system_id, g.doc_id, g.hopper_id FROM matched m JOIN gmap g ON g.doc_id = m.doc_id AND g.entity_id = m.object_id AND g.event_type = m.event_type AND g.role = m.role WHERE m.kind <> 'Filler') SELECT doc_id, hopper_id FROM f GROUP BY ALL HAVING count(DISTINCT system_id) = (SELECT count(DISTINCT system_id) FROM rs)")
def sco8(t):
    n = t.systems.agg(F.count(F.lit(1)).alias("all"))
    return _found_points(t).groupBy("doc_id", "hopper_id").agg(F.count_distinct("system_id").alias("n")).join(F.broadcast(n), F.col("n") == F.col("all")).select("doc_id", "hopper_id")


def _found_points(t):
    """Hoppers with the responses that were matched with one of their entities."""
    g = gold(t)
    m = g.matched.filter("kind <> 'Filler'").withColumnRenamed("object_id", "entity_id").join(g.own.select("system_id", "response_id", "doc_id", "event_type", "role"), ["system_id", "response_id"])
    hoppers = g.mapped.select("doc_id", "hopper_id", "entity_id", "event_type", "role").distinct()
    return m.join(hoppers, ["doc_id", "entity_id", "event_type", "role"]).select("system_id", "doc_id", "hopper_id", "event_type", "role", "entity_id")


def _in(names) -> str:
    return "(" + ", ".join(f"'{x}'" for x in names) + ")"


@query(
    "sco8_derived_queries",
    f"""{GOLD}, f AS (SELECT DISTINCT m.system_id, doc_id, hopper_id, event_type, role, entity_id FROM (SELECT system_id, doc_id, event_type, role, object_id AS entity_id FROM matched WHERE kind <> 'Filler') m JOIN gmap g USING (doc_id, entity_id, event_type, role) WHERE role IN {_in(Q.ENTRY_ROLES)} AND event_type NOT IN {_in(Q.BANNED_EVENTS)}),
    h AS (SELECT DISTINCT system_id, doc_id, hopper_id, event_type, md5('0|' || doc_id || '|' || hopper_id || '|' || event_type) AS k FROM f),
    c AS (SELECT doc_id, hopper_id, event_type, k FROM h GROUP BY ALL HAVING count(DISTINCT system_id) = (SELECT count(DISTINCT system_id) FROM h)),
    q AS (SELECT 'COMMON_' || lpad(CAST(n AS VARCHAR), 4, '0') AS query_id, doc_id, hopper_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY k, doc_id, hopper_id, event_type) - 1 AS n FROM c) WHERE n < 140
      UNION ALL SELECT 'SINGLE_SYS_' || system_id || '_' || lpad(CAST(n AS VARCHAR), 4, '0'), doc_id, hopper_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY k, doc_id, hopper_id, event_type) - 1 AS n FROM h WHERE (doc_id, hopper_id, event_type) NOT IN (SELECT doc_id, hopper_id, event_type FROM c)) WHERE n < 45)
    SELECT DISTINCT query_id, doc_id, hopper_id, role, entity_id FROM q JOIN f USING (doc_id, hopper_id, event_type)""",
)
def sco8_queries(t):
    return Q.derived_entry_points(_found_points(t))


@query("sk10_node_names", f"{GOLD} SELECT DISTINCT entity_id, CASE WHEN mtype = 'NAM' THEN ':' || entity_id ELSE ':Entity_' || md5('7|' || mention_ordinal) END AS node FROM mentions")
def sk10(t):
    name = F.when(F.col("mtype") == "NAM", F.concat(F.lit(":"), "entity_id"))
    return gold(t).mentions.select("entity_id", node_name(name, 7, F.col("mention_ordinal")).alias("node")).distinct()
