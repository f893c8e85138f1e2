"""Queries of orders, percentiles and summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framescore.functions import ident
from framescore.operators import align as A
from framescore.operators import linking as L
from framescore.operators import preprocess as PP
from framescore.operators import reports as R
from framescore.operators import scores as S
from framescore.operators import stores as ST
from framescore.operators.stages import written

from .goldside import LESS
from .identity import SQL_OLD
from .links import LIFT, link_scores
from .registry import query
from .rewrites import _OK
from .scoring import ALIGN, COUNTS, DRAWN, DRAWS, PRF, SAMPLES, _aligned, _boot, counts_by, written_counts
from .storage import _FOUND, _LONG, PAIRS, _found, ag21
from .tables import CLASS, RESPONSE, SQL_ID, is_correct

POINTS = [0.25, 0.5, 0.75]
_K = ", ".join(CLASS)


def nist_sql(samples: str, by: str, value: str, points: list[float]) -> str:
    """A table of percentiles (by, p, value) of a table of samples, as a subquery."""
    return f"""(SELECT {by}, p, v[CAST(floor(r) AS INT)] + (r - floor(r)) * (v[least(CAST(floor(r) AS INT) + 1, n)] - v[CAST(floor(r) AS INT)]) AS "value" FROM (SELECT *, least(greatest(p * (n + 1), 1.0), n) AS r
    FROM (SELECT {by}, list_sort(list({value})) AS v, count(*) AS n, unnest(CAST({points} AS DOUBLE[])) AS p FROM {samples} GROUP BY {by})))"""


_LINKBOOT = ", lboot AS (SELECT sample, system_id, sum(times * link_f1 * n_gold) / sum(times * n_gold) AS link_score FROM linkf JOIN drawn USING (doc_id) GROUP BY ALL)"


@query(
    "ag15_percentiles",
    f"""{ALIGN}{LIFT}{DRAWS}{_LINKBOOT} SELECT 'argument F1' AS metric, * FROM {nist_sql(f"(SELECT *, {PRF} FROM boot)", 'system_id', 'f1', POINTS)} UNION ALL SELECT 'link score', * FROM {nist_sql('lboot', 'system_id', 'link_score', POINTS)}""",
)
def ag15(t):
    w = lambda c: F.sum(F.col("times") * c)
    drawn = written(S.drawn_samples(written_counts(t).select("doc_id").distinct(), "doc_id", SAMPLES))
    links = S.bootstrapped(written(link_scores(t)), drawn, "doc_id", ["system_id"], {"link_score": w(F.col("link_f1") * F.col("n_gold")) / w(F.col("n_gold"))})
    of = lambda d, value, name: S.percentiles(d, ["system_id"], value, POINTS).withColumn("metric", F.lit(name))
    return of(S.with_f(_boot(t)), "f1", "argument F1").unionByName(of(links, "link_score", "link score"))


@query(
    "ag15_by_type",
    f"""{ALIGN}{DRAWN}, tc AS (SELECT system_id, event_type, doc_id, {COUNTS} FROM aligned GROUP BY ALL), tb AS (SELECT sample, system_id, event_type, 100 * sum(times * greatest(tp - 0.25e0 * fp, 0)) / nullif(sum(times * (tp + fn)), 0) AS score FROM tc JOIN drawn USING (doc_id) GROUP BY ALL)
    SELECT * FROM {nist_sql('(SELECT * FROM tb WHERE score IS NOT NULL)', 'system_id, event_type', 'score', POINTS)}""",
)
def ag15_by_type(t):
    counts = written(counts_by(t, ["event_type", "doc_id"]))
    w = lambda c: F.sum(F.col("times") * c)
    drawn = S.drawn_samples(counts.select("doc_id").distinct(), "doc_id", SAMPLES)
    score = 100 * w(F.greatest(F.col("tp") - 0.25 * F.col("fp"), F.lit(0.0))) / F.nullif(w(F.col("tp") + F.col("fn")), F.lit(0).cast("long"))
    boot = S.bootstrapped(counts, drawn, "doc_id", ["system_id", "event_type"], {"score": score})
    return S.percentiles(boot.filter("score IS NOT NULL"), ["system_id", "event_type"], "score", POINTS)


@query(
    "ag27_full_submission_summary",
    f"""{ALIGN}{DRAWS}, pp AS {nist_sql('boot', 'system_id', 'score', POINTS)}, c AS (SELECT system_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, 100 * sum(greatest(tp - 0.25e0 * fp, 0)) / sum(tp + fn) AS official FROM doc_counts GROUP BY ALL)
    SELECT c.*, {PRF}, p25, p50, p75 FROM c JOIN (SELECT system_id, max("value") FILTER (p = 0.25) AS p25, max("value") FILTER (p = 0.5) AS p50, max("value") FILTER (p = 0.75) AS p75 FROM pp GROUP BY ALL) USING (system_id)""",
)
def ag27(t):
    c = written_counts(t)
    total = S.with_f(c.groupBy("system_id").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")]))
    official = S.argument_score_2015(c).select("system_id", F.col("score").alias("official"))
    points = S.percentiles(_boot(t), ["system_id"], "score", POINTS).withColumn("name", F.concat(F.lit("p"), (100 * F.col("p")).cast("int").cast("string")))
    return total.join(official, "system_id").join(points.groupBy("system_id").pivot("name", ["p25", "p50", "p75"]).agg(F.max("value")), "system_id")


@query(
    "ag19_mention_types_and_frames",
    f""", k AS (SELECT c.*, canon, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS old_id FROM (SELECT *, CAST({SQL_OLD} AS BIGINT) AS h FROM correct) c JOIN canonical USING (doc_id, cas, cas_start, cas_end)),
    r AS (SELECT role, arg_max(mention_type, {{'a': old_id, 'b': response_id}}) AS mt FROM k GROUP BY {_K}), ft AS (SELECT doc_id, frame_id, min(event_type) AS event_type FROM gold_linking JOIN (SELECT DISTINCT response_id, event_type FROM responses) USING (response_id) GROUP BY ALL HAVING count(DISTINCT event_type) = 1)
    SELECT 'mention_type' AS what, CASE WHEN role = 'Time' THEN 'Time' ELSE mt END AS "key", count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'frames', event_type, count(*) FROM ft GROUP BY ALL""",
)
def ag19(t):
    """Mention types by the correct response of a class with the greatest old identifier, and frames of a single type."""
    k = A.canonicalised(t.correct, t.canonical).withColumn("old", ident.old_id())
    r = k.groupBy(*CLASS).agg(F.max_by("mention_type", F.struct("old", "response_id")).alias("mt"))
    kinds = r.groupBy(F.when(F.col("role") == "Time", "Time").otherwise(F.col("mt")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    frames = R.single_type_frames(t.gold_linking, t.responses).withColumnRenamed("event_type", "key")
    return kinds.select(F.lit("mention_type").alias("what"), "key", "n").unionByName(frames.select(F.lit("frames").alias("what"), "key", "n"))


@query(
    "ag21_label_scores",
    f"""{PAIRS}{_LONG}, x AS (SELECT field, unnest(CASE WHEN left_label = right_label THEN [{{'label': left_label, 'cell': 'TP'}}] ELSE [{{'label': left_label, 'cell': 'FN'}}, {{'label': right_label, 'cell': 'FP'}}] END) AS u FROM long),
    c AS (SELECT field, u.label AS label, count(*) FILTER (u.cell = 'TP') AS tp, count(*) FILTER (u.cell = 'FP') AS fp, count(*) FILTER (u.cell = 'FN') AS fn FROM x GROUP BY ALL) SELECT *, {PRF} FROM c""",
)
def ag21_labels(t):
    return S.with_f(R.label_scores(ag21(t)))


_TEAMS = "CASE WHEN system_id IN ('sys0', 'sys1') THEN 'a' WHEN system_id = 'sys2' THEN 'b' ELSE 'c' END || system_id"


def _teamed(d):
    """Systems under names that begin with their team."""
    return d.withColumn("system_id", F.expr(_TEAMS))


@query(
    "ag23_overlap_partition",
    f"""{ALIGN}{_FOUND}, fx AS (SELECT {_TEAMS} AS sys, item FROM found), hu AS (SELECT DISTINCT doc_id || event_type || role || realis || canon AS item FROM keyc WHERE event_type LIKE 'Life%'), al AS (SELECT item FROM fx UNION SELECT item FROM hu), s AS (SELECT DISTINCT sys FROM fx),
    g AS (SELECT s.sys, al.item, bool_or(fx.sys IS NOT NULL AND fx.sys = s.sys) AS t, bool_or(fx.sys IS NOT NULL AND fx.sys[1:1] <> s.sys[1:1]) AS o, bool_or(fx.sys IS NOT NULL AND fx.sys <> s.sys AND fx.sys[1:1] = s.sys[1:1]) AS same, max(CASE WHEN hu.item IS NULL THEN 0 ELSE 1 END) = 1 AS h
      FROM s CROSS JOIN al LEFT JOIN fx ON fx.item = al.item LEFT JOIN hu ON hu.item = al.item GROUP BY ALL)
    SELECT sys AS system_id, count(*) FILTER (t AND NOT h AND NOT o) AS own, count(*) FILTER (t AND h AND NOT o) AS own_human, count(*) FILTER (t AND o AND NOT h) AS own_other, count(*) FILTER (t AND o AND h) AS own_human_other, count(*) FILTER (same AND NOT t AND NOT o AND NOT h) AS same_team,
    count(*) FILTER (h AND o AND NOT t) AS human_other, count(*) FILTER (o AND NOT t AND NOT h) AS other, count(*) FILTER (h AND NOT t AND NOT o) AS human FROM g GROUP BY ALL""",
)
def ag23(t):
    human = A.key_classes(t.judged.filter("right AND event_type LIKE 'Life%'"), CLASS).select(F.concat(*CLASS).alias("item"))
    return R.overlap_partition(_teamed(_found(t)), human, 1)


@query(
    "wn4_team_bootstrap",
    f"""{ALIGN}{DRAWS}, m AS (SELECT {_TEAMS} AS sys, "value" AS median FROM {nist_sql('boot', 'system_id', 'score', [0.5])}), b AS (SELECT sys[1:1] AS team, max(median) AS best, arg_max(sys, {{'a': median, 'b': sys}}) AS system_id FROM m GROUP BY ALL)
    SELECT team, system_id, best, false AS median FROM b""",
)
def wn4(t):
    """The best submission of each team by its bootstrap median; three teams are too few for medians of their own."""
    medians = S.percentiles(_boot(t), ["system_id"], "score", [0.5]).select("system_id", F.col("value").alias("score"))
    return R.team_summary(_teamed(medians), 1)


@query(
    "wn7_leaderboards",
    f"""{ALIGN}, k AS (SELECT system_id, cell, unnest([{{'kind': 'type', 'key': event_type}}, {{'kind': 'role', 'key': role}}]) AS k FROM aligned), c AS (SELECT system_id, k.kind AS kind, k.key AS "key", {COUNTS} FROM k GROUP BY ALL), f AS (SELECT system_id, kind, "key", f1 FROM (SELECT *, {PRF} FROM c))
    SELECT f.*, row_number() OVER (PARTITION BY f.kind, f."key" ORDER BY f.f1 DESC, f.system_id) AS rank, CASE WHEN f.f1 > b.f1 THEN f.f1 - b.f1 END AS lead FROM f LEFT JOIN (SELECT * FROM f WHERE system_id = 'sys1') b USING (kind, "key")""",
)
def wn7(t):
    f = S.with_f(S.breakdown(_aligned(t), {"type": F.col("event_type"), "role": F.col("role")}))
    return R.leaderboards(f.select("system_id", "kind", "key", "f1"), ["kind", "key"], "sys1", "f1")


_FIRST = "{'pj': list_sort(pj), 'a': bf_start, 'b': bf_end, 'c': cas_start, 'd': cas_end, 'e': CASE realis WHEN 'Actual' THEN 0 WHEN 'Generic' THEN 1 ELSE 2 END}"


@query(
    "wn3_justification_order",
    f""", f AS (SELECT doc_id, event_type, role, realis, canon, min({_FIRST}) AS x FROM (SELECT DISTINCT doc_id, event_type, role, realis, pj, bf_start, bf_end, cas, cas_start, cas_end FROM responses) JOIN canonical USING (doc_id, cas, cas_start, cas_end) GROUP BY ALL)
    SELECT {_K}, row_number() OVER (PARTITION BY doc_id ORDER BY x.pj, x.a, x.b, x.c, x.d, x.e, event_type, role, realis, canon) AS place FROM f""",
)
def wn3(t):
    return A.by_justification(A.canonicalised(t.responses, t.canonical), CLASS)


@query(
    "sl1_response_orders",
    f""", h AS (SELECT *, CAST({SQL_OLD} AS BIGINT) AS h0 FROM responses), o AS (SELECT *, CASE WHEN h0 >= 2147483648 THEN h0 - 4294967296 ELSE h0 END AS old FROM h)
    SELECT system_id, response_id, row_number() OVER (PARTITION BY system_id, doc_id ORDER BY event_type, response_id) AS by_event, row_number() OVER (PARTITION BY system_id, doc_id ORDER BY role, response_id) AS by_role, row_number() OVER (PARTITION BY system_id, doc_id ORDER BY bf_start, bf_end, response_id) AS by_filler,
    row_number() OVER (PARTITION BY system_id, doc_id ORDER BY cas, cas_start, cas_end, response_id) AS by_cas, row_number() OVER (PARTITION BY system_id, doc_id ORDER BY old, response_id) AS by_old_id, row_number() OVER (PARTITION BY system_id, doc_id ORDER BY response_id) AS by_id FROM o""",
)
def sl1(t):
    within = ["system_id", "doc_id"]
    places = [F.row_number().over(Window.partitionBy(*within).orderBy(*order, "response_id")).cast("long").alias(f"by_{name}") for name, order in A.response_orders().items()]
    return t.responses.select("system_id", "response_id", *places)


@query("pf22_converted_identifiers", f", h AS (SELECT DISTINCT response_id, CAST({SQL_OLD} AS BIGINT) AS h0 FROM responses) SELECT response_id, CAST(CASE WHEN h0 >= 2147483648 THEN h0 - 4294967296 ELSE h0 END AS VARCHAR) AS old_response_id FROM h")
def pf22(t):
    """Rows under their old identifiers, converted."""
    old = t.responses.withColumn("response_id", ident.old_id().cast("string")).drop("system_id", "confidence").distinct()
    return ST.converted_ids(old).select("response_id", "old_response_id")


@query(
    "pf20_doc_ids_of_key_and_coref",
    "SELECT 'key' AS side, 'N' || doc_id AS doc_id, count(*) AS n, count(DISTINCT cas) AS cases FROM assessments GROUP BY ALL UNION ALL SELECT 'coref', 'N' || doc_id, count(*), count(DISTINCT cas) FROM coref GROUP BY ALL",
)
def pf20(t):
    names = t.assessments.select("doc_id").distinct().withColumn("new_id", F.concat(F.lit("N"), "doc_id"))
    key, coref = ST.renamed_documents(t.assessments, names), ST.renamed_documents(t.coref, names)
    some = lambda d, side: d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cas").alias("cases")).withColumn("side", F.lit(side))
    return some(key, "key").unionByName(some(coref, "coref"))


@query(
    "ud6_result_writers",
    f"""{ALIGN}{DRAWN}, x AS (SELECT 0 AS sample, doc_id, 1 AS times FROM units UNION ALL SELECT sample + 1, doc_id, times FROM drawn) SELECT sample, system_id, 100 * sum(times * greatest(tp - 0.25e0 * fp, 0)) / sum(times * (tp + fn)) AS score, CAST(sum(times * tp) AS BIGINT) AS tp FROM doc_counts JOIN x USING (doc_id) GROUP BY ALL""",
)
def ud6(t):
    """Two writers over plain results (sample 0) and over bootstrap samples (from 1)."""
    counts = written_counts(t)
    w = lambda c: F.sum(F.col("times") * c)
    gained = w(F.greatest(F.col("tp") - 0.25 * F.col("fp"), F.lit(0.0)))
    by = ["sample", "system_id"]
    writers = {
        "score": lambda d: d.groupBy(*by).agg((100 * gained / w(F.col("tp") + F.col("fn"))).alias("score")),
        "tp": lambda d: d.groupBy(*by).agg(w(F.col("tp")).alias("tp")),
    }
    drawn = written(S.drawn_samples(counts.select("doc_id").distinct(), "doc_id", SAMPLES).withColumn("samples", F.transform("samples", lambda x: x + 1)))
    plain, boot = R.results(counts, writers), R.results(counts, writers, drawn)
    one = lambda r: r["score"].join(r["tp"], by)
    return one(plain).unionByName(one(boot))


@query("ud7_observers", f"{ALIGN} SELECT 'cells' AS observer, cell AS \"key\", count(*) AS n FROM aligned GROUP BY ALL UNION ALL SELECT 'missed roles', role, count(*) FROM aligned WHERE cell = 'FN' GROUP BY ALL")
def ud7(t):
    count = lambda d, key: d.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    found = R.observed(_aligned(t), {"cells": lambda d: count(d, "cell"), "missed roles": lambda d: count(d.filter("cell = 'FN'"), "role")})
    out = [d.select(F.lit(name).alias("observer"), "key", "n") for name, d in found.items()]
    return out[0].unionByName(out[1])


def _inputs(t) -> dict:
    t.in_buckets()
    return {"responses": t.responses.select("system_id", *RESPONSE, "response_id", "confidence"), "key": t.assessments, "linking": t.linking, "canonical": t.canonical}


def _shouted(t) -> dict:
    """The inputs with small masks in the times of every other entity."""
    small = lambda d: d.withColumn("cas", F.when((F.col("role") == "Time") & (F.col("cas_start") % 50 == 0), F.translate("cas", "X", "x")).otherwise(F.col("cas"))).withColumn("response_id", ident.response_id())
    inputs = _inputs(t)
    moved = small(inputs["responses"].withColumn("old", F.col("response_id")))
    ids = moved.select("doc_id", "old", "response_id").distinct()
    linking = inputs["linking"].withColumnRenamed("response_id", "old").join(ids, ["doc_id", "old"]).drop("old")
    return inputs | {"responses": moved.drop("old"), "key": small(inputs["key"]), "linking": linking}


_CHAIN = f""", n_resp AS (SELECT *, {SQL_ID} AS response_id FROM (SELECT system_id, {', '.join(c for c in RESPONSE if c != 'realis')}, 'Actual' AS realis, max(confidence) AS confidence FROM rows1 GROUP BY ALL)),
n_key AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY NOT is_assessed, old = response_id, old) AS rn FROM (SELECT *, {SQL_ID} AS response_id FROM (SELECT * EXCLUDE (response_id) REPLACE ('Actual' AS realis, CASE WHEN a_realis IS NOT NULL THEN 'Actual' END AS a_realis), response_id AS old FROM assessments))) WHERE rn = 1),
n_kx AS (SELECT n.*, canon FROM n_key n JOIN canonical USING (doc_id, cas, cas_start, cas_end)),
n_ban AS (SELECT DISTINCT doc_id, role, realis, canon FROM n_kx WHERE event_type = 'Life.Die' AND {_OK}),
n_k1 AS (SELECT * FROM n_kx WHERE NOT (event_type = 'Life.Injure' AND (doc_id, role, realis, canon) IN (SELECT doc_id, role, realis, canon FROM n_ban))),
n_vague AS (SELECT DISTINCT doc_id, event_type, role, realis, u AS cas FROM (SELECT *, unnest({LESS.format(c='cas')}) AS u FROM n_k1 WHERE role = 'Time' AND cas_ok IN ('C', 'I')) WHERE u IS NOT NULL),
n_k2 AS (SELECT * FROM n_k1 WHERE (doc_id, event_type, role, realis, cas) NOT IN (SELECT doc_id, event_type, role, realis, cas FROM n_vague)),
n_ids AS (SELECT DISTINCT r.response_id AS old, n.response_id FROM ided r JOIN n_resp n USING (doc_id, event_type, role, cas, cas_start, cas_end, bf_start, bf_end, pj, aaj)),
n_l0 AS (SELECT DISTINCT system_id, doc_id, frame_id, i.response_id FROM linking l JOIN n_ids i ON i.old = l.response_id), n_l1 AS (SELECT system_id, doc_id, frame_id, list_sort(list(response_id)) AS m FROM n_l0 GROUP BY ALL),
n_l AS (SELECT system_id, doc_id, frame_id, unnest(m) AS response_id FROM (SELECT system_id, doc_id, m, min(frame_id) AS frame_id FROM n_l1 GROUP BY ALL))"""


@query(
    "sco2p_preprocessing_2014",
    f"""{_CHAIN} SELECT 'key' AS side, '' AS system_id, response_id, coalesce({_OK}, false) AS is_right FROM n_k2 UNION ALL SELECT 'system', system_id, response_id, NULL FROM n_resp WHERE response_id IN (SELECT response_id FROM n_k2)
    UNION ALL SELECT 'linking', system_id || '|' || doc_id || '|' || frame_id, response_id, NULL FROM n_l WHERE response_id IN (SELECT response_id FROM n_k2)""",
)
def sco2p(t):
    """All steps but the neutralised coreference, from inputs with small masks."""
    d = PP.applied(_shouted(t), PP.chain(2014, neutralise_realis=True), t.kept)
    none = F.lit(None).cast("boolean")
    key = d["key"].select(F.lit("key").alias("side"), F.lit("").alias("system_id"), "response_id", F.coalesce(is_correct(), F.lit(False)).alias("is_right"))
    own = d["responses"].select(F.lit("system").alias("side"), "system_id", "response_id", none.alias("is_right"))
    links = d["linking"].select(F.lit("linking").alias("side"), F.concat_ws("|", "system_id", "doc_id", "frame_id").alias("system_id"), "response_id", none.alias("is_right"))
    return key.unionByName(own).unionByName(links)


@query(
    "sco2p_neutralised_coref",
    f"""{_CHAIN}, n_right AS (SELECT * FROM n_k2 WHERE {_OK}), n_w AS (SELECT response_id, doc_id, event_type, role, bf_start, bf_end FROM n_k2 WHERE bf_ok IN ('C', 'I') AND cas_ok = 'W'),
    n_a AS (SELECT doc_id, event_type, role, bf_start, bf_end, min(response_id) AS a FROM n_right GROUP BY ALL), n_b AS (SELECT doc_id, event_type, role, min(response_id) AS b FROM n_right GROUP BY ALL),
    n_m AS (SELECT response_id, coalesce(a, b) AS new_id FROM n_w LEFT JOIN n_a USING (doc_id, event_type, role, bf_start, bf_end) LEFT JOIN n_b USING (doc_id, event_type, role))
    SELECT system_id, CASE WHEN m.response_id IS NULL THEN r.response_id ELSE new_id END AS response_id, max(confidence) AS confidence FROM n_resp r LEFT JOIN n_m m USING (response_id) WHERE r.response_id IN (SELECT response_id FROM n_k2) AND (m.response_id IS NULL OR new_id IS NOT NULL) GROUP BY ALL""",
)
def sco2p_coref(t):
    d = PP.applied(_inputs(t), PP.chain(2015, neutralise_realis=True, neutralise_coref=True), t.kept)
    return d["responses"].select("system_id", "response_id", "confidence")
