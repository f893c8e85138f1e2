"""Each invariant of the scorers, stores and scans: strict results fail with its name, lenient ones go on."""

from __future__ import annotations

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from framescore.operators import align as A
from framescore.operators import filters, linking, pipelines, stores
from framescore.operators import invariants as I  # noqa: E741
from framescore.sources import scans

KEY = "response_id string, is_assessed boolean, aet string, aer string"


def fails(df, *words):
    with pytest.raises(Exception) as e:  # noqa: PT011
        df.collect()
    assert "USER_RAISED_EXCEPTION" in str(e.value) and all(w in str(e.value) for w in words), str(e.value)[:500]


def test_enforced_counts_and_shows_violations(spark):
    rows = spark.range(5)
    bad = spark.createDataFrame([("b", 2), ("a", 1)], "doc_id string, n int")
    fails(I.enforced(rows, bad, "nothing is bad"), "nothing is bad: 2 violations, first", '"doc_id":"a"')
    fails(I.enforced(rows, bad, "nothing is bad").groupBy().count(), "nothing is bad")
    assert I.enforced(rows, bad, "nothing is bad", strict=False).count() == 5
    fine = I.enforced(rows, bad.filter("n > 2"), "nothing is bad")
    assert fine.columns == ["id"] and [r.id for r in fine.orderBy("id").collect()] == [0, 1, 2, 3, 4]


def test_one_assessment_a_response(spark):
    key = spark.createDataFrame([("a", True, "C", "C"), ("a", True, "C", "C"), ("b", False, None, None), ("b", True, "W", None)], KEY)
    assert [tuple(r) for r in I.conflicting_assessments(key).collect()] == [("b", 2)]
    responses = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c")], "system_id string, response_id string")
    fails(I.assessed_responses(responses, key), "one assessment a response: b")
    got = {r.response_id: (r.is_assessed, r.aet) for r in I.assessed_responses(responses, key, "left", strict=False).collect()}
    assert got == {"a": (True, "C"), "b": (True, "W"), "c": (None, None)}
    assert I.assessed_responses(responses, key.filter("response_id = 'a'")).count() == 1


def test_every_response_is_assessed(spark):
    key = spark.createDataFrame([("a", True, "C", "C"), ("b", False, None, None)], KEY)
    responses = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "b")], "system_id string, response_id string")
    fails(I.completely_assessed(responses, key), "every response is assessed: 1 violations", '"response_id":"b"')
    assert [r.response_id for r in I.completely_assessed(responses, key, strict=False).collect()] == ["a"]
    assert I.completely_assessed(responses.filter("response_id = 'a'"), key).count() == 1


def test_every_cas_has_a_cluster(spark):
    schema = "doc_id string, cas string, cas_start int, cas_end int"
    rows = spark.createDataFrame([("d", "x", 0, 1), ("d", "y", 5, 9)], schema)
    canonical = rows.filter("cas = 'x'").withColumn("canon", F.lit("x@0-1"))
    fails(A.canonicalised(rows, canonical), "every CAS has a cluster", '"cas":"y"')
    assert [r.canon for r in A.canonicalised(rows, canonical, "optional").collect()] == ["x@0-1"]
    assert sorted(r.canon for r in A.canonicalised(rows, canonical, "lax").collect()) == ["x@0-1", "y@5-9"]
    with pytest.raises(ValueError, match="strict, optional or lax"):
        A.canonicalised(rows, canonical, "loose")


def test_linking_files_name_known_responses(spark):
    lines = spark.createDataFrame([("f", 0, "a\tb"), ("f", 1, "INCOMPLETE\tc"), ("f", 2, "a\tz")], "path string, line_no int, line string")
    known = spark.createDataFrame([("a",), ("b",)], "response_id string")
    frames, rest = scans.linking_2015(lines, known)
    fails(frames, "every linked id is a response", '"response_id":"z"')
    fails(rest, "every linked id is a response", '"response_id":"c"')
    frames, rest = scans.linking_2015(lines, known, strict=False)
    assert sorted((r.frame_id, r.response_id) for r in frames.collect()) == [("0", "a"), ("0", "b"), ("2", "a")] and rest.count() == 0
    assert scans.linking_2015(lines)[0].count() == 4
    assert scans.linking_2015(lines.filter("line_no = 0"), known)[0].count() == 2


def test_stores_have_no_document_in_common(spark):
    d = lambda *ids: spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "doc_id string, n int")
    fails(stores.merge_disjoint(d("a", "b"), d("b", "c"), strict=True)[0], "stores have no document in common", '"doc_id":"b"')
    assert stores.merge_disjoint(d("a", "b"), d("b", "c"), overwrite=True, strict=True)[0].count() == 3
    assert stores.merge_disjoint(d("a"), d("b", "c"), strict=True)[0].count() == 3
    assert stores.merge_disjoint(d("a", "b"), d("b", "c"))[0].count() == 4


def test_one_assessment_a_query_response(spark):
    rows = [("q", "d1", "s", "CORRECT"), ("q", "d1", "t", None), ("q", "d2", "s", "CORRECT"), ("q", "d2", "t", "WRONG"), ("q", "d3", "s", None)]
    d = spark.createDataFrame(rows, "query_id string, doc_id string, system_id string, assessment string")
    fails(stores.merge_query_responses(d, ["query_id", "doc_id"], strict=True)[0], "one assessment a query response", '"doc_id":"d2"')
    merged, conflicts = stores.merge_query_responses(d, ["query_id", "doc_id"])
    assert {(r.doc_id, r.systems, r.assessment) for r in merged.collect()} == {("d1", "s,t", "CORRECT"), ("d2", "s,t", "CORRECT"), ("d3", "s", "UNASSESSED")}
    assert [r.given for r in conflicts.collect()] == [["CORRECT", "WRONG"]]
    assert stores.merge_query_responses(d.filter("doc_id <> 'd2'"), ["query_id", "doc_id"], strict=True)[0].count() == 2


def test_predicted_items_are_gold_s(spark):
    gold = spark.createDataFrame([("d", "g", "x"), ("d", "g", "y")], "doc_id string, frame_id string, item string")
    predicted = spark.createDataFrame([("s", "d", "p", "x"), ("s", "d", "p", "z")], "system_id string, doc_id string, frame_id string, item string")
    fails(linking.link_f1(gold, predicted, strict=True), "predicted items are gold's", '"item":"z"')
    assert linking.link_f1(gold, predicted.filter("item = 'x'"), strict=True).count() == 1
    assert linking.link_f1(gold, predicted).first().n_gold == 2


def test_linkings_are_complete(spark):
    cols = "system_id string, doc_id string, response_id string, confidence double, k string, frame_id string"
    rows = spark.createDataFrame([("s", "d", "a", 0.5, "x", "f"), ("s", "d", "b", 0.7, "y", "f")], cols)
    full = rows.withColumns({c: F.lit(0) for c in ("cas_start", "cas_end", "bf_start", "bf_end")} | {c: F.lit("Actual") for c in ("event_type", "role", "realis", "cas")} | {c: F.array().cast("array<struct<start:int,end:int>>") for c in ("pj", "aaj")})
    assessed = full.select("doc_id", "response_id", "k").withColumn("right", F.lit(True))
    gold = spark.createDataFrame([("d", "g", "x"), ("d", "g", "y")], "doc_id string, frame_id string, item string")
    classes = full.select("response_id", F.col("k").alias("item"))
    score = lambda rest: pipelines.score_2015(full.drop("frame_id"), assessed, rows.select("system_id", "doc_id", "frame_id", "response_id"), gold, classes, ["doc_id", "k"], rest)
    left = spark.createDataFrame([("d", "c")], "doc_id string, response_id string")
    fails(score(left), "linkings are complete: 1 violations", '"response_id":"c"')
    for rest in (None, left.filter("doc_id = 'e'")):
        r = score(rest).first()
        assert (r.arg, r.link, r.overall) == (1.0, 1.0, 1.0)


def test_every_query_response_is_assessed(spark):
    found = spark.createDataFrame([("q", "d", "s", 3), ("q", "e", "s", 0)], "query_id string, doc_id string, system_id string, a int")
    fails(pipelines.corpus_score(found, 3, drop_unassessed=False, strict=True)[0], "every query response is assessed", '"doc_id":"e"')
    assert pipelines.corpus_score(found, 3, strict=True)[0].count() == 1
    assert pipelines.corpus_score(found, 3, drop_unassessed=False)[1].count() == 1


def test_counters_in_the_pass(spark):
    schema = "doc_id string, response_id string, is_assessed boolean, aet string, aer string, cas_ok string, bf_ok string, a_realis string, mention_type string, cas string, cas_start int, cas_end int, coref_id string"
    row = lambda i, *f, coref="c": ("d", i, True, *f, "x", 0, 1, coref)
    key = spark.createDataFrame([row("a", "C", "C", "C", "C", "Actual", "NAME"), row("b", "C", "C", "C", "C", "Actual", "NAME", coref=None), row("c", "C", None, None, None, None, None), row("e", "W", None, "C", None, None, None), row("f", "W", None, None, None, None, None)], schema)
    counts = Observation()
    got = scans.recovered(key, counts).collect()
    assert counts.get == {"made_unassessed": 1, "fields_removed": 1, "singletons": 1} and len(got) == 5 and "_alone" not in got[0].asDict()
    assert {r.repair: r.n for r in scans.repair_counts(scans.recovered(key)).collect()} == {"made unassessed": 1, "fields removed": 1}
    counts = Observation()
    assert stores.add_unassessed(key, spark.createDataFrame([("a",), ("new",), ("new",)], "response_id string"), counts).count() == 6
    assert counts.get == {"known": 5, "added": 1}
    key = spark.createDataFrame([("d1", "T", False), ("d1", "U", False), ("d2", "T", True), ("d2", "T", False), ("d3", "T", False)], "doc_id string, event_type string, is_assessed boolean")
    docs = spark.createDataFrame([("d1",), ("d2",)], "doc_id string")
    counts = Observation()
    assert filters.restrict(key, docs, ["T"], counts).collect() == filters.restrict(key, docs, ["T"]).collect()
    assert counts.get == {"rows": 5, "unlisted": 1, "assessed": 2, "other_type": 1, "kept": 1}
