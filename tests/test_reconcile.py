"""Merged clusters against a walk in order, stores with their clusters, recall pivots, extraction and knowledge-base rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from framescore.operators import coref, kb, reports, stores, transforms, validate
from framescore.operators import queries as Q
from framescore.sources import scans, sinks

COREF = "doc_id string, cas string, coref_id string"


def walked(base: dict, more: dict) -> dict:
    """Each further CAS in order joins the cluster of most of its clustermates so far, else a new one."""
    ids = {c: i for c, i in base.items() if i is not None}
    fresh = max([int(i[3:]) for i in ids.values() if i.startswith("new") and i[3:].isdigit()], default=-1) + 1
    for c in sorted(c for c, i in more.items() if i is not None):
        if c not in ids:
            votes = [ids[m] for m, i in more.items() if i == more[c] and m in ids]
            if votes:
                ids[c] = min(set(votes), key=lambda i: (-votes.count(i), i))
            else:
                ids[c] = f"new{fresh}"
                fresh += 1
    return {c: ids.get(c) for c in {*base, *more}}


def test_coref_merge_as_a_walk(spark):
    r = random.Random(5)
    base, more, want = [], [], {}
    for d in range(40):
        pick = lambda ids, share: {f"c{k:02}": r.choice(ids) for k in range(14) if r.random() < share}
        b, m = pick(["a", "b", "c", "new3", None], 0.5), pick(["x", "y", "z", None], 0.8)
        base += [(f"d{d}", c, i) for c, i in b.items()]
        more += [(f"d{d}", c, i) for c, i in m.items()]
        want |= {(f"d{d}", c): i for c, i in walked(b, m).items()}
    got = coref.merge(spark.createDataFrame(base, COREF), spark.createDataFrame(more, COREF)).collect()
    assert len(got) == len(want) and {(x.doc_id, x.cas): x.coref_id for x in got} == want
    none = spark.createDataFrame([], COREF)
    assert coref.merge(none, none).count() == 0
    assert [x.coref_id for x in coref.merge(none, spark.createDataFrame([("d", "a", "x"), ("d", "b", "x")], COREF)).collect()] == ["new0", "new0"]


CAS = "doc_id string, cas string, cas_start int, cas_end int"


def test_stores_keep_their_clusters(spark):
    key = lambda *rows: spark.createDataFrame([("d", c, 0, 1, i, a, "C" if a else None) for c, i, a in rows], f"{CAS}, response_id string, is_assessed boolean, aet string")
    ids = lambda **c: spark.createDataFrame([("d", k, 0, 1, v) for k, v in c.items()], f"{CAS}, coref_id string")
    base, more = key(("a", "1", True), ("b", "2", False)), key(("b", "2", True), ("c", "3", True), ("e", "4", True))
    own, other = ids(a="k"), ids(a="x", b="x", c="y", e="y")
    fields = ["response_id", "is_assessed", "aet"]
    got = {x.response_id: (x.is_assessed, x.coref_id) for x in stores.merge_stores(base, more, own, other, fields).collect()}
    assert got == {"1": (True, "k"), "2": (True, "k"), "3": (True, "new0"), "4": (True, "new0")}
    got = {x.response_id: x.coref_id for x in stores.fallback_store(base, more, own, other, fields).collect()}
    assert got == {"1": "k", "2": "x", "3": "y", "4": "y"}


def test_merged_assessments_by_rank(spark):
    """Every pair of a baseline's and an additional store's rows of one id, against the rules told one by one."""
    states = [None, (True,), (False,), (True, True), (False, True), (False, False)]
    base, more, want = [], [], []
    for i, b in enumerate(states):
        for j, m in enumerate(states):
            rows = [[(f"{i}{j}", a, f"{side}{k}") for k, a in enumerate(s or ())] for side, s in (("b", b), ("m", m))]
            base, more = base + rows[0], more + rows[1]
            right = [r for r in rows[0] if r[1]] or [r for r in rows[1] if r[1]]
            want += right or rows[0] or rows[1]
    lone = [(None, True, "b"), (None, False, "b")]
    make = lambda rows: spark.createDataFrame(rows, "response_id string, is_assessed boolean, aet string")
    got = stores.merge_assessments(make(base + lone + [("x", None, "b")]), make(more + lone))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want + lone + lone))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_merged_stores_join_once(spark):
    from framescore.plans.catalog import QUERIES

    plan = QUERIES["so6_merged_stores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1


def test_mapped_rows_bring_fresh_clusters(spark):
    key = spark.createDataFrame([("d", "a", 0, 1, "1", True), ("d", "b", 5, 6, "2", False), ("d", "c", 8, 9, "3", True)], f"{CAS}, response_id string, is_assessed boolean")
    known = spark.createDataFrame([("d", "a", 0, 1, "k"), ("d", "c", 8, 9, None)], f"{CAS}, coref_id string")
    mapping = spark.createDataFrame([("1", "1n"), ("2", "2n")], "response_id string, new_id string")
    there = spark.createDataFrame([("1n", "d", "aa", 0, 2), ("2n", "d", "bb", 5, 7)], f"response_id string, {CAS}")
    moved, after = transforms.map_store(key, known, mapping, key.select("response_id").limit(0), there)
    assert {(x.response_id, x.cas, x.cas_end, x.is_assessed) for x in moved.collect()} == {("1n", "aa", 2, True), ("2n", "bb", 7, False), ("3", "c", 9, True)}
    ids = {x.cas: x.coref_id for x in after.collect()}
    assert set(ids) == {"a", "aa", "c"} and ids["a"] == "k" and ids["c"] is None and ids["aa"].startswith("s")  # unassessed bb brings none


def test_recall_pivot_takes_systems_from_the_data(spark):
    key = spark.createDataFrame([("d", "Actual", "x"), ("d", "Actual", "y"), ("e", "Other", "z")], "doc_id string, a_realis string, cas string")
    found = spark.createDataFrame([("alpha", "d", "Actual", "x"), ("alpha", "d", "Other", "y"), ("b.2", "d", "Actual", "y"), ("b.2", "f", "Actual", "q")], "system_id string, doc_id string, realis string, cas string")
    got = {r.doc_id: r.asDict() for r in reports.recall_pivot(key, found, ["doc_id"]).collect()}
    assert got == {
        "d": {"doc_id": "d", "a_realis": "Actual", "cases": "x|y", "alpha": "Actual,Other", "alpha_cas": "x|y", "b.2": "Actual", "b.2_cas": "y"},
        "e": {"doc_id": "e", "a_realis": "Other", "cases": "z", "alpha": "N", "alpha_cas": "", "b.2": "N", "b.2_cas": ""},
    }
    assert reports.recall_pivot(key, found.limit(0), ["doc_id"]).columns == ["doc_id", "a_realis", "cases"]


def test_extraction_is_capped_and_unassessed(spark):
    matches = spark.createDataFrame([("q", "s", f"d{k}", f"r{k}") for k in range(6)], "query_id string, system_id string, doc_id string, response_id string")
    linking = matches.select("system_id", "doc_id", F.lit("f").alias("frame_id"), "response_id")
    corpus = linking.select("system_id", F.col("doc_id").alias("corpus_frame_id"), "doc_id", "frame_id")
    responses = matches.select("system_id", "response_id", F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end"))).alias("pj"))
    got = Q.extracted(matches, linking, corpus, responses, 4).collect()
    assert len(got) == 4 and {r.assessment for r in got} == {"UNASSESSED"} and {tuple(r.pj[0]) for r in got} == {(1, 3)}
    assert Q.extracted(matches, linking, corpus, responses, 99).count() == 6


NODES = [":Entity_1\ttype\tPER", ':Entity_1\tmention\t"x"\td:1-2', ":Event_1\ttype\tdie", ':Event_1\tmention.actual\t"x"\td:1-2', ":String_1\ttype\tSTRING", ':String_1\tmention\t"x"\td:1-2']
ARG = ":Event_1\tlife.die:victim.actual\t"


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        ([f"{ARG}:Entity_1\td:1-2;d:1-2,d:3-4;NIL\t0.5"], []), ([f"{ARG}:String_1\td:1-2;d:1-2;d:1-2\t1.0"], []),
        (["nonsense"], ["unknown shape"]), ([f"{ARG}:Entity_1\td:1-2;d:1-2\t1.01"], ["confidence out of range"]), ([f"{ARG}:Entity_1\td:1-2;d:1-2\t0.0"], ["confidence out of range"]),
        ([':Entity_1\tmention\t""\td:1-2'], ["empty mention"]), ([f"{ARG}:Event_1\td:1-2;d:1-2"], ["argument neither entity nor string"]),
        ([f"{ARG}:String_1\td:1-2;d:1-2"], ["not 1 to 3 predicate justifications", "string argument without filler string"]), ([f"{ARG}:Entity_1\td:1-2;d:1-2;d:1-2;NIL"], ["filler string without string argument"]),
        ([f"{ARG}:Entity_1\td:1-2;d:1-2,d:2-3,d:3-4,d:4-5"], ["not 1 to 3 predicate justifications"]), ([f"{ARG}:Entity_1\td:1-2"], ["not 1 to 3 predicate justifications"]),
        ([f"{ARG}:Entity_1\td:1-2;e:1-2"], ["several documents"]), ([f"{ARG}:Entity_1\td:1-2;d:9-2"], ["span ends before it starts"]),
        ([":Entity_1\ttype\tORG"], ["several types"]), ([f"{ARG}:Entity_2\td:1-2;d:1-2"], ["no mention", "no type"]),
    ],
)
def test_rules_of_a_knowledge_base(spark, lines, want):
    d = spark.createDataFrame([("f", k, x) for k, x in enumerate(["run", *NODES, *lines])], "path string, line_no int, line string")
    assert sorted(r.check for r in kb.violations(scans.kb_assertions(d)).collect()) == want


def test_query_invariants(spark):
    points = spark.createDataFrame([("q1", "d", "h"), ("q1", "d", "h"), ("q2", "d", "h"), ("q2", "e", "h")], "query_id string, doc_id string, hopper_id string")
    responses = spark.createDataFrame([("q1", "d", "s"), ("q1", "e", " "), ("q2", "e", None)], "query_id string, doc_id string, system_id string")
    assert sorted(map(tuple, validate.query_invariants(points, responses).collect())) == [("q1/e", "system without a name"), ("q2", "query id of several hoppers"), ("q2/e", "system without a name")]


def test_score_tables_on_disk(spark, tmp_path):
    scores = spark.createDataFrame([("b", 1, 2.5), ("a", 3, None)], "system_id string, tp long, linear double")
    sinks.write_scores({"scores": sinks.scores_long(scores, ["tp", "linear"])}, f"{tmp_path}/t")
    want = [("a", "linear", None), ("a", "tp", 3.0), ("b", "linear", 2.5), ("b", "tp", 1.0)]
    assert sorted(map(tuple, scans.score_table(spark, f"{tmp_path}/t/scores").collect())) == want
    assert spark.read.option("header", True).csv(f"{tmp_path}/t/scores.csv").columns == ["system_id", "metric", "value"]


def test_summaries_make_document_counts_once(spark, monkeypatch):
    from framescore.operators import align
    from framescore.plans.catalog import QUERIES

    made, counted = [], align.counted_judged
    monkeypatch.setattr(align, "counted_judged", lambda *a: made.append(a) or counted(*a))
    QUERIES["ag27_full_submission_summary"](spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def test_leaderboard_makes_scores_once(spark):
    from framescore.operators import reports
    from framescore.plans.catalog import QUERIES

    plan = QUERIES["wn7_leaderboard"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1
    d = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "system_id string, score double")
    assert [tuple(r) for r in reports.leaderboard(d, "b").orderBy("rank").collect()] == [("a", 3.0, 1, 1.0), ("b", 2.0, 2, None), ("c", 1.0, 3, None)]
    assert [r.lead for r in reports.leaderboard(d, "none").collect()] == [None] * 3
