"""Gold alignment, document-level arguments, link scores and validators, on hand-made cases."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from framescore.operators import align as A
from framescore.operators import gold as G
from framescore.operators import linking as L
from framescore.operators import queries as Q
from framescore.operators import reports as R
from framescore.operators import scores as S
from framescore.operators import stores as ST
from framescore.operators import validate as V
from framescore.operators.ranks import with_ordinal

MENTIONS = "doc_id string, entity_id string, mention_ordinal int, mtype string, ext_start int, ext_end int, head_start int, head_end int"
FILLERS = "doc_id string, filler_id string, filler_ordinal int, ext_start int, ext_end int, normalized_time string"
ARGUMENTS = "doc_id string, hopper_id string, ere_type string, ere_subtype string, ere_role string, realis string, arg_realis boolean, entity_id string, filler_id string, ext_start int, ext_end int, trig_start int, trig_end int"
OWN = "system_id string, doc_id string, response_id string, event_type string, role string, realis string, cas string, cas_start int, cas_end int"
HEADS = "doc_id string, start int, end int, head_start int, head_end int"
ONTOLOGY = [("type", "life", "Life"), ("subtype", "die", "Die"), ("subtype", "injure", "Injure"), ("role", "victim", "Victim"), ("role", "time", "Time"), ("role", "place", "Place")]


@pytest.fixture(scope="module")
def gold(spark):
    mentions = spark.createDataFrame([
        ("D", "player", 0, "NAM", 0, 20, 5, 9), ("D", "player", 1, "NOM", 100, 120, None, None), ("D", "other", 2, "NOM", 5, 7, None, None), ("D", "other", 3, "PRO", 200, 210, None, None),
        ("D", "twin", 4, "NAM", 300, 305, None, None), ("D", "second", 5, "NAM", 300, 305, None, None), ("D", "headed", 6, "NAM", 400, 430, None, None), ("D", "long", 7, "NAM", 1000, 1900, 1001, 1002),
    ], MENTIONS)
    fillers = spark.createDataFrame([("D", "f1", 0, 500, 510, None), ("D", "t1", 1, 600, 610, "1990-05-03"), ("D", "broken", 2, 620, 630, None)], FILLERS)
    arguments = spark.createDataFrame([
        ("D", "h1", "life", "die", "victim", "Actual", True, "player", None, 0, 20, 50, 55), ("D", "h1", "life", "die", "time", "Actual", True, None, "t1", 600, 610, 50, 55),
        ("D", "h1", "life", "die", "place", "Actual", False, None, "f1", 500, 510, 50, 55), ("D", "h2", "life", "die", "victim", "Generic", True, "second", None, 300, 305, 50, 55),
        ("D", "h3", "life", "marry", "victim", "Actual", True, "player", None, 0, 20, 50, 55), ("D", "h4", "life", "injure", "victim", "Actual", True, "other", None, 5, 7, 700, 705),
        ("D", "h5", "life", "injure", "victim", "Actual", True, "other", None, 200, 210, 50, 55), ("D", "h5", "life", "injure", "time", "Actual", True, None, "broken", 620, 630, 50, 55),
        ("D", "h6", "life", "injure", "victim", "Actual", True, "ghost", None, 1, 2, 50, 55),
    ], ARGUMENTS)
    return mentions, fillers, arguments, spark.createDataFrame(ONTOLOGY, "kind string, source string, target string")


def matched(spark, gold, spans):
    mentions, fillers, arguments, ontology = gold
    own = spark.createDataFrame([("s", "D", str(k), "Life.Die", "Victim", "Actual", "x", a, b) for k, (a, b) in enumerate(spans)], OWN)
    heads = spark.createDataFrame([("D", 400, 430, 410, 412), ("D", 405, 420, 410, 412), ("D", 305, 309, 300, 305)], HEADS)
    found = G.match_entities(own, G.candidates(mentions, fillers), G.roles_played(arguments, ontology), heads, ["system_id", "response_id"])
    by = {int(r.response_id): (r.rule, r.kind, r.object_id) for r in found.collect()}
    return [by.get(k) for k in range(len(spans))]


def test_rules_go_before_role_players(spark, gold):
    got = matched(spark, gold, [(5, 7), (0, 20), (5, 9), (100, 120), (300, 305), (410, 412), (405, 420), (305, 309), (2, 12), (500, 510), (6, 6), (800, 801), (1800, 1810), (201, 205)])
    assert got == [
        (1, "Nominal", "other"),  # an exact match of a non-player, though a player contains it
        (1, "Name", "player"), (2, "Name", "player"), (1, "Nominal", "player"),
        (1, "Name", "second"),  # of two equal candidates the one that plays the role, though it comes later
        (3, "Name", "headed"), (6, "Name", "headed"), (4, "Name", "second"), (7, "Name", "player"), (1, "Filler", "f1"),
        (7, "Name", "player"),  # contained in both: the player first
        None, (7, "Name", "long"), (7, "Pronoun", "other"),
    ]


def test_gold_arguments(spark, gold):
    quotes = spark.createDataFrame([("D", 702, 710), ("E", 0, 999)], "doc_id string, start int, end int")
    got = Counter(tuple(r) for r in G.gold_arguments(*gold[2:3], *gold[:2], gold[3], quotes).collect())
    assert got == Counter([
        ("D", "h1", "Life.Die", "Victim", "Actual", "Name-player"), ("D", "h1", "Life.Die", "Time", "Actual", "Time-1990-05-03"), ("D", "h1", "Life.Die", "Place", "Other", "Filler-f1"),
        ("D", "h2", "Life.Die", "Victim", "Generic", "Name-second"), ("D", "h5", "Life.Injure", "Victim", "Actual", "Nominal-other"),
    ])
    assert {tuple(r) for r in G.outside_ontology(gold[2], gold[3]).collect()} == {("subtype", "marry", 1)}


def test_coref_ids_of_responses(spark):
    own = spark.createDataFrame([("s", "D", "1", "T", "Time", "Actual", "1990-XX-XX", 0, 3), ("s", "D", "2", "T", "Victim", "Actual", "a", 0, 3), ("s", "D", "3", "T", "Victim", "Actual", "a", 7, 9)], OWN)
    found = spark.createDataFrame([("s", "2", 1, "Name", "E-1")], "system_id string, response_id string, rule int, kind string, object_id string")
    d = G.response_coref(own, found, ["system_id", "response_id"])
    assert {r.response_id: r.coref_id for r in d.collect()} == {"1": "Time-1990-XX-XX", "2": "Name-E-1", "3": "AlignmentFailure-7-9"}
    o = {r.coref_id: r.o for r in d.select("coref_id", G.object_of(F.col("coref_id")).alias("o")).collect()}
    assert o["AlignmentFailure-7-9"] is None and tuple(o["Name-E-1"]) == ("Name", "E-1") and tuple(o["Time-1990-XX-XX"]) == ("Time", "1990-XX-XX")


def test_vague_times_go_where_both_sides_have_times(spark):
    arg = "doc_id string, event_type string, role string, realis string, coref_id string"
    gold = spark.createDataFrame([("D", "A", "Time", "Actual", "Time-1990-05-03"), ("D", "B", "Time", "Actual", "Time-1991-XX-XX"), ("D", "A", "Victim", "Actual", "Name-1")], arg)
    system = spark.createDataFrame([("s", "D", "A", "Time", "Actual", "Time-1990-05-XX"), ("s", "D", "A", "Time", "Other", "Time-1990-05-XX"), ("u", "D", "C", "Time", "Actual", "Time-1990-05-XX")], f"system_id string, {arg}")
    vague = G.vague_times(gold, system)
    left = system.join(vague, ["system_id", *G.ARG], "left_anti")
    assert {(r.system_id, r.realis) for r in left.collect()} == {("s", "Other"), ("u", "Actual")}
    assert {r.event_type for r in vague.collect()} == {"A"} and vague.filter("coref_id = 'Time-1990-05-03'").isEmpty()


def test_link_scores_of_silent_systems(spark):
    gold = spark.createDataFrame([("D", "g", "a"), ("D", "g", "b"), ("E", "g", "c")], "doc_id string, frame_id string, item string")
    predicted = spark.createDataFrame([("s", "D", "f", "a"), ("s", "D", "f", "b")], "system_id string, doc_id string, frame_id string, item string")
    systems = spark.createDataFrame([("s",), ("silent",)], "system_id string")
    links = L.link_f1(gold, predicted, systems)
    got = {(r.system_id, r.doc_id): (r.n_gold, r.n_predicted, r.precision, r.recall, r.link_f1) for r in links.collect()}
    assert got == {("s", "D"): (2, 2, 1, 1, 1), ("s", "E"): (1, 0, 0, 0, 0), ("silent", "D"): (2, 0, 0, 0, 0), ("silent", "E"): (1, 0, 0, 0, 0)}
    total = {r.system_id: (r.link_precision, r.link_recall, r.link_f1) for r in L.link_aggregate_2016(links, ["system_id"]).collect()}
    assert total["s"] == pytest.approx((2 / 3, 2 / 3, 2 / 3)) and total["silent"] == (0, 0, 0)
    own = gold.crossJoin(systems)
    assert sorted(map(str, L.link_f1(own, predicted).select(*links.columns).collect())) == sorted(map(str, links.collect()))


def test_linkable_frames(spark):
    row = "system_id string, doc_id string, event_type string, role string, realis string, coref_id string, frame_id string"
    gold = spark.createDataFrame([("s", "D", "A", "r", "Actual", "1", "h"), ("s", "D", "A", "r", "Generic", "2", "h")], row)
    system = spark.createDataFrame([("s", "D", "A", "r", "Other", "1", "f"), ("s", "D", "A", "r", "Generic", "2", "f"), ("s", "D", "A", "r", "Actual", "3", "f")], row)
    assert G.linkable(gold, system)[1].count() == 0
    g, p = G.linkable(gold, system, neutral=True)
    assert [r.item for r in g.collect()] == [r.item for r in p.collect()] == ["A|r|1"]


def test_query_criteria(spark):
    cols = "name string, mtype string, cas_start int, cas_end int, ext_start int, ext_end int, head_start int, head_end int"
    rows = [
        ("exact pronoun", "PRO", 0, 9, 0, 9, None, None), ("within name", "NAM", 2, 3, 0, 9, None, None), ("around name", "NAM", 0, 9, 2, 3, None, None), ("within pronoun", "PRO", 0, 8, 0, 9, None, None),
        ("within nominal", "NOM", 0, 5, 0, 9, 1, 2), ("headless", "NOM", 0, 5, 0, 9, None, None), ("misses head", "NOM", 0, 5, 0, 9, 4, 7), ("small", "NOM", 0, 1, 0, 9, 0, 1), ("around nominal", "NOM", 0, 9, 5, 9, 5, 20),
    ]
    got = {r.name: r.rule for r in spark.createDataFrame(rows, cols).withColumn("rule", Q.cas_rule()).collect()}
    assert got == {"exact pronoun": 1, "within name": 2, "around name": 3, "within pronoun": None, "within nominal": 4, "headless": 4, "misses head": None, "small": None, "around nominal": 4}
    only = {r.name for r in spark.createDataFrame(rows, cols).filter(Q.cas_rule([Q.name_contained, Q.exact]) == 1).collect()}
    assert only == {"around name"}


def test_ordinals_and_draws(spark):
    d = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("unit"))
    got = with_ordinal(d, ["unit"], "n").orderBy("unit").collect()
    assert [r.n for r in got] == list(range(1000))
    drawn = S.draws(d, "unit", 3)
    assert {r.sample: r["sum(times)"] for r in drawn.groupBy("sample").sum("times").collect()} == {0: 1000, 1: 1000, 2: 1000}
    assert S.draws(d.limit(0), "unit", 3).count() == 0
    import hashlib

    units = sorted(r.unit for r in d.collect())
    want = Counter((b, units[int(hashlib.md5(f"0|{b}|{k}".encode()).hexdigest()[:8], 16) % 1000]) for b in range(3) for k in range(1000))
    assert Counter({(r.sample, r.unit): r.times for r in drawn.collect()}) == want


def test_validators(spark):
    types = spark.createDataFrame([("f1", "A", "Actual"), ("f1", "B", "Actual"), ("f2", "B", "Other"), ("f3", "A", "Generic"), ("f4", "C", "Actual")], "frame_id string, event_type string, realis string")
    linkable = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("C", "A")], "type_a string, type_b string")
    got = {tuple(r) for r in V.linking_violations(types, ["frame_id"], {"generic": V.no_generic, "types": V.only_linkable(linkable)}).collect()}
    assert got == {("f1", "A", "B", "types"), ("f3", "A", "A", "generic"), ("f4", "C", "C", "types")}


def test_overlap_partition(spark):
    found = spark.createDataFrame([("a1", 1), ("a1", 2), ("a2", 2), ("a2", 3), ("b1", 2), ("b1", 4), ("a1", 5), ("b1", 6)], "system_id string, item int")
    human = spark.createDataFrame([(5,), (6,), (7,)], "item int")
    got = {r.system_id: tuple(r[p] for p in R.PARTS) for r in R.overlap_partition(found, human, 1).collect()}
    assert got["a1"] == (1, 1, 1, 0, 1, 1, 1, 1) and got["b1"] == (1, 1, 1, 0, 0, 1, 2, 1)


def test_class_order_by_justification(spark):
    rows = [("D", "A", [(5, 9)], 1, 2, "Actual", 0), ("D", "B", [(0, 3), (9, 9)], 1, 2, "Actual", 0), ("D", "C", [(0, 3)], 1, 2, "Actual", 0), ("D", "E", [(5, 9)], 1, 2, "Actual", 1), ("D", "A", [(7, 9)], 0, 0, "Actual", 0)]
    d = spark.createDataFrame(rows, "doc_id string, event_type string, pj array<struct<start:int,end:int>>, bf_start int, bf_end int, realis string, cas_start int").withColumn("cas_end", F.col("cas_start"))
    assert [r.event_type for r in A.by_justification(d, ["doc_id", "event_type"]).orderBy("place").collect()] == ["C", "B", "A", "E"]


def test_renamed_documents(spark):
    d = spark.createDataFrame([("D1", "x"), ("D2", "y")], "doc_id string, cas string")
    names = spark.createDataFrame([("D1", "N1")], "doc_id string, new_id string")
    assert {tuple(r) for r in ST.renamed_documents(d, names).collect()} == {("N1", "x"), ("D2", "y")}


def test_document_counts_by_difference(spark):
    """Both modes from one pass, against cells of a full comparison; a time that is vague for one system only."""
    import random

    r = random.Random(7)
    draw = lambda: (r.choice("dD"), r.choice("ABC"), r.choice(["Agent", "Time"]), r.choice(["Actual", "Other"]), r.choice("xyz"))
    cols = ", ".join(f"{c} string" for c in G.ARG)
    for _ in range(3):
        gold, system, vague = {draw() for _ in range(25)}, {(r.choice("st"), *draw()) for _ in range(40)}, {(r.choice("st"), *draw()) for _ in range(12)}
        vague = {v for v in vague if v[3] == "Time"}
        d = lambda rows, more="": spark.createDataFrame(sorted(rows), f"{more}{cols}")
        got = G.document_counts(d(gold), d(system, "system_id string, "), d(vague, "system_id string, "), spark.createDataFrame([("s",), ("t",), ("u",)], "system_id string"))
        want = {}
        for s in "stu":
            g, p = {x for x in gold if (s, *x) not in vague}, {x[1:] for x in system if x[0] == s and x not in vague}
            for mode, cut in (("withRealis", lambda x: x), ("noRealis", lambda x: (*x[:3], x[4]))):
                a, b = set(map(cut, g)), set(map(cut, p))
                for doc in "dD":
                    cells = tuple(len({x for x in k if x[0] == doc}) for k in (a & b, b - a, a - b))
                    if sum(cells):
                        want[mode, s, doc] = cells
        assert {(x.mode, x.system_id, x.doc_id): (x.tp, x.fp, x.fn) for x in got.collect()} == want


def test_counted_equals_cells_of_the_alignment(spark):
    import random

    from framescore.operators import align as A

    r = random.Random(3)
    of = {k: (r.choice("de"), r.choice("abcdef")) for k in range(60)}  # a response's class is its own
    rows = [(s, f"r{k}", *of[k], r.random()) for k in range(60) for s in "st" if r.random() < 0.6]
    base = spark.createDataFrame(rows, "system_id string, response_id string, doc_id string, k string, confidence double")
    full = base.withColumns({c: F.lit(0) for c in ("cas_start", "cas_end", "bf_start", "bf_end")} | {c: F.lit("Actual") for c in ("event_type", "role", "realis", "cas")} | {c: F.array().cast("array<struct<start:int,end:int>>") for c in ("pj", "aaj")})
    judged = {i: (d, k, r.random() < 0.5) for _, i, d, k, _ in rows if r.random() < 0.7} | {f"only{n}": (r.choice("de"), r.choice("abcdefg"), True) for n in range(4)}
    assessed = spark.createDataFrame([(i, *x) for i, x in judged.items()], "response_id string, doc_id string, k string, right boolean")
    for by in (["doc_id"], ["doc_id", "k"], []):
        want = A.cells(A.align(full, assessed, F.col("right"), ["doc_id", "k"]), ["system_id", *by])
        got = A.counted(full, assessed, F.col("right"), ["doc_id", "k"], by)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_judged_responses_align_without_joins(spark):
    """Responses with their judgements give what responses and assessments give; repeated rows change nothing."""
    import random

    r = random.Random(5)
    of = {f"r{k}": (r.choice("de"), r.choice("abcdefgh"), r.random() < 0.7, r.random() < 0.5) for k in range(60)}
    rows = [(s, i, of[i][0], of[i][1], r.choice((0.1, 0.5, 0.9))) for i in of for s in "st" if r.random() < 0.6]
    base = spark.createDataFrame(rows, "system_id string, response_id string, doc_id string, k string, confidence double")
    full = base.withColumns({c: F.lit(0) for c in ("cas_start", "cas_end", "bf_start", "bf_end")} | {c: F.lit("Actual") for c in ("event_type", "role", "realis", "cas")} | {c: F.array().cast("array<struct<start:int,end:int>>") for c in ("pj", "aaj")})
    had = {i for _, i, *_ in rows}
    key = spark.createDataFrame([(i, d, k, x) for i, (d, k, known, x) in of.items() if known and i in had], "response_id string, doc_id string, k string, right boolean")
    marks = spark.createDataFrame([(i, known, known and x) for i, (_, _, known, x) in of.items()], "response_id string, known boolean, right boolean")
    judged, systems = full.join(marks, "response_id"), spark.createDataFrame([("s",), ("t",), ("silent",)], "system_id string")
    twice = judged.unionByName(judged.filter("k < 'd'"))
    heard = systems.filter("system_id <> 'silent'")
    got, want = A.align_judged(twice, ["doc_id", "k"], heard), A.align(full, key, F.col("right"), ["doc_id", "k"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    for by in (["doc_id"], ["k"], ["doc_id", "k"], []):
        got, want = A.counted_judged(twice, ["doc_id", "k"], by, systems), A.counted(full, key, F.col("right"), ["doc_id", "k"], by, systems)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_alignment_shuffles_the_rows_once(spark):
    from framescore.plans.catalog import QUERIES

    for name in ("sco1_trfr_alignment", "ag4_doc_f_by_group", "ag5_doc_linear_score_2016"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" not in plan
        assert plan.count("Exchange hashpartitioning(doc_id") == 1


def test_overlap_groups_ids_where_their_documents_lie(spark):
    from framescore.plans.catalog import QUERIES

    for name in ("ag23_system_overlap", "ag24_found_by_teams"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" not in plan
        assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "hashpartitioning(item" not in plan


def test_overlap_by_condition_equals_overlap_by_table(spark):
    rows = [("a1", "D1", "x"), ("a1", "D1", "x"), ("a2", "D1", "x"), ("b1", "D1", "y"), ("a1", "D1", "y"), ("b1", "D2", "x"), ("b1", "D2", "z")]
    d = spark.createDataFrame(rows, "system_id string, doc_id string, k string")
    human, joined = F.col("k") == "x", d.withColumn("item", F.concat("doc_id", "k"))
    got = sorted(map(tuple, R.system_overlap(d, human, 1, ["doc_id", "k"]).collect()))
    assert got == [("a1", 2, 1, 1, 1), ("a2", 1, 1, 1, 0), ("b1", 3, 2, 1, 1)]
    assert got == sorted(map(tuple, R.system_overlap(joined, joined.filter(human), 1).collect()))
    assert sorted(map(tuple, R.found_by_teams(d, 1, ["doc_id", "k"]).collect())) == [(1, 3), (2, 1)]


def test_lifting_shuffles_the_rows_once(spark, monkeypatch):
    from framescore.plans import links
    from framescore.plans.tables import Tables

    monkeypatch.setattr(links, "written", lambda d: d)
    for d in links.lifted(Tables(spark, "/root/testdata/sf0.001")):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_preprocessing_has_classes_without_joining_clusters(spark):
    import re

    from framescore.plans.catalog import QUERIES

    plan = QUERIES["tr2_rule_on_everything"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert keys and not [k for k in keys if "cas_start" in k]


def test_gold_side_shuffles_nothing_but_the_rows(spark):
    """Both sides' arguments and frames come from tables in buckets by document; only the systems' names are shuffled."""
    import re

    from framescore.operators import gold as G
    from framescore.plans.goldside import gold
    from framescore.plans.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    for d in (*gold(t).scope, gold(t).spans, gold(t).sargs, *gold(t).scoped(), *G.linkable(*gold(t).frames())):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "Exchange SinglePartition" not in plan
        assert not [k for k in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if not re.match(r"system_id#\d+, \d+$", k)]


def test_link_scores_in_buckets_shuffle_no_items(spark):
    import re

    from framescore.plans import links
    from framescore.plans.tables import Tables

    plan = links.link_scores(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or "BroadcastHashJoin" in plan
    assert not re.search(r"Exchange hashpartitioning\([^)]*\), REPARTITION", plan)
