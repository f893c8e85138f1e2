"""Known score values, identifiers and text functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from framescore.functions import ident, scalars
from framescore.functions.measures import nist_percentile
from framescore.operators import align, coref, linking, scores, stores, transforms
from framescore.sources import scans, sinks

SPANS = "array<struct<start:int,end:int>>"


def lines_of(spark, *lines, path="f"):
    return spark.createDataFrame([(path, k, x) for k, x in enumerate(lines)], "path string, line_no long, line string")


def test_identifiers(spark):
    line = "x\tNYT_ENG_20130506.0130\tLife.Die\tTime\t2013-05-06\t289-294\t252-413\t289-294\tNIL\tActual\t0.587"
    other = "x\tAFP_ENG_20091024.0206\tJustice.Sentence\tAdjudicator\tjudge\t741-750\t722-842\t741-750\tNIL\tActual\t1.0"
    d = scans.argument_rows(lines_of(spark, line, other)).select("role", ident.response_id().alias("id"), ident.old_id().alias("old"))
    got = {r.role: r for r in d.collect()}
    assert got["Time"].id == "24cbdd4a0ec502f4ef39868640e2ab6abbc95f88"
    assert got["Adjudicator"].old == -1983753613


def link(spark, key, system):
    g = spark.createDataFrame([("d", f"k{k}", x) for k, s in enumerate(key) for x in s], "doc_id string, frame_id string, item string")
    p = spark.createDataFrame([("s", "d", f"p{k}", x) for k, s in enumerate(system) for x in s if any(x in y for y in key)], "system_id string, doc_id string, frame_id string, item string")
    r = linking.link_f1(g, p).collect()
    return r[0].link_f1 * r[0].n_gold if r else 0.0


@pytest.mark.parametrize(
    ("key", "system", "wanted"),
    [
        (["xya"], ["xyz"], 4 / 3), (list("abcd"), list("abcd"), 4), (list("abcd"), ["abcd"], 0), (["abcd"], list("abcd"), 0), (["abcd"], ["abcd"], 4), (["ab", "cd"], ["ab", "cd"], 4),
        (["abc", "de", "f"], ["abd", "g"], 1), (["abc", "de", "f"], ["ab", "c", "g"], 4 / 3), (["abc", "de", "f"], ["de", "dea"], 4 / 3), (["abc", "ce", "c"], ["c"], 0),
    ],
)
def test_link_f1(spark, key, system, wanted):
    assert link(spark, key, system) == pytest.approx(wanted)


def test_align_and_argument_score(spark):
    schema = "system_id string, doc_id string, event_type string, role string, cas string, cas_start int, cas_end int, bf_start int, bf_end int, pj " + SPANS + ", aaj " + SPANS + ", realis string, confidence double, response_id string, canon string"
    row = lambda x, c=0.5: ("s", "d", "T", "R", x, 1, 2, 1, 2, [(0, 9)], [], "Actual", c, x, x[0])
    responses = spark.createDataFrame([row("a"), row("b"), row("g"), row("c1", 0.9), row("c2", 0.1), row("u")], schema)
    key = spark.createDataFrame([("d", x, x[0]) for x in ("a", "b", "c1", "c2", "e", "g")], "doc_id string, response_id string, canon string")
    correct = key.filter("response_id IN ('a', 'b', 'c2', 'e')")
    cells = {r.canon: set() for r in responses.select("canon").union(key.select("canon")).collect()}
    aligned = align.align(responses, key, correct, ["doc_id", "canon"])
    for r in aligned.collect():
        cells[r.canon].add(r.cell)
    assert cells == {"a": {"TP"}, "b": {"TP"}, "c": {"FP", "FN"}, "e": {"FN"}, "g": {"FP"}, "u": {"FP"}}
    counts = align.cells(aligned, ["system_id", "doc_id"])
    r = counts.first()
    assert (r.tp, r.fp, r.fn) == (2, 3, 2)
    assert scores.argument_score_2015(counts).first().score == pytest.approx(100 * (2 - 0.75) / 4)


def test_times(spark):
    got = spark.createDataFrame([("1982-12-31",), ("1982-12-XX",), ("198X-XX-XX",), ("XXXX-12-31",), ("1982-1X-31",)], "t string").select("t", scalars.is_timex(F.col("t")).alias("ok"), scalars.less_specific_times(F.col("t")).alias("less")).collect()
    assert [r.ok for r in got] == [True, True, True, False, True]
    assert sorted(got[0].less) == ["1982-12-3X", "1982-12-XX", "1982-1X-XX", "1982-XX-XX", "198X-XX-XX", "19XX-XX-XX", "1XXX-XX-XX"]
    assert sorted(got[2].less) == ["19XX-XX-XX", "1XXX-XX-XX"]


def test_quote_regions(spark):
    text = "xx</quote>ab<quote>c<quote orig=\"x\">d</quote>e</quote>f <quote>g</quote> <quote>open"
    got = sorted(transforms.quote_regions(spark.createDataFrame([("d", text), ("e", ""), ("n", None)], "doc_id string, text string")).collect())
    assert [(r.start, r.end, r.closed) for r in got] == [(12, 53, True), (56, 71, True), (73, None, False)]
    assert text[12:54].startswith("<quote>") and text[12:54].endswith("</quote>")


def test_nist_percentiles(spark):
    d = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([7.0],)], "v array<double>")
    assert [r[0] for r in d.select(nist_percentile(F.col("v"), 0.5)).collect()] == [2.5, 7.0]
    assert d.select(nist_percentile(F.col("v"), 0.005), nist_percentile(F.col("v"), 0.995), nist_percentile(F.col("v"), 0.25)).first() == (1.0, 4.0, 1.25)


def test_bootstrap_draws_as_many_as_there_are(spark):
    units = spark.createDataFrame([(f"d{k}",) for k in range(7)], "doc_id string")
    d = scores.draws(units, "doc_id", 20)
    assert {r.n for r in d.groupBy("sample").agg(F.sum("times").alias("n")).collect()} == {7}


def test_argument_layout_round_trip(spark):
    text = ["#about the next", "x\td\tLife.Die\tVictim\ta\tb".replace("a\tb", "a b") + "\t5-9\t30-40,1-20\t5-9\t50-60\tOther\t0.25", "", "x\td\tLife.Die\tVictim\ta b\t5-9\t1-20,30-40\t5-9\t50-60\tOther\t0.75"]
    rows = scans.argument_output(lines_of(spark, *text), ["doc_id", "event_type", "role", "cas", "cas_start", "cas_end", "bf_start", "bf_end", "pj", "aaj", "realis"])
    r = rows.first()
    assert rows.count() == 1 and r.confidence == 0.75 and r.metadata is None and [tuple(x) for x in r.pj] == [(1, 20), (30, 40)]
    line = sinks.argument_lines(rows.withColumn("system_id", F.lit("s")).withColumn("response_id", ident.response_id())).first().line
    again = scans.argument_rows(lines_of(spark, line)).first()
    assert (again.cas, again.pj, again.aaj, again.realis, again.confidence) == (r.cas, r.pj, r.aaj, r.realis, r.confidence)


def test_linking_layouts(spark):
    frames, rest = scans.linking_2016(lines_of(spark, "f2\ta b", "f1\tb a", "f3\tc", "INCOMPLETE\td"))
    assert sorted((r.frame_id, r.response_id) for r in frames.collect()) == [("f1", "a"), ("f1", "b"), ("f3", "c")]
    assert [r.response_id for r in rest.collect()] == ["d"]
    frames, rest = scans.linking_2015(lines_of(spark, "a\tb", "INCOMPLETE\td"))
    assert sorted(r.response_id for r in frames.collect()) == ["a", "b"] and rest.count() == 1
    got = scans.corpus_linking(lines_of(spark, "C1\tA-B-f1 D-f2")).collect()
    assert sorted((r.doc_id, r.frame_id) for r in got) == [("A-B", "f1"), ("D", "f2")]


def test_knowledge_base_lines(spark):
    text = [
        "run", ":Event_0\ttype\tCONFLICT.ATTACK\t0.900", ":Event_0\tmention.actual\t\"say \\\"x\\\"\"\tdocID:5-12\t0.5", ":Entity1\tper:dislikes\t:Entity2\tdocID:5-12",
        ":Event_0\tlife.die:victim.actual\t:Entity_0\tdocID:5-12;docID:10-15;docID:5-312", ":Event_0\ttype\tCONFLICT.ATTACK\t0.100", "nonsense",
    ]
    d = scans.kb_assertions(lines_of(spark, *text))
    got = {r.line_no: r for r in d.collect()}
    assert [got[k].kind for k in (1, 2, 3, 4)] == ["type", "mention", "sentiment", "event argument"] and 5 not in got and got[6].kind is None
    assert got[2].mention == 'say "x"' and got[2].realis == "actual" and got[1].confidence == 0.9
    spans = sorted((r.group_no, r.start, r.end, r.trimmed) for r in scans.kb_provenance(d.filter("line_no = 4")).collect())
    assert spans == [(0, 5, 12, False), (1, 10, 15, False), (2, 5, 204, True)]


def test_coref_merge(spark):
    base = spark.createDataFrame([("d", "a", "1"), ("d", "b", "1"), ("d", "c", "2")], "doc_id string, cas string, coref_id string")
    more = spark.createDataFrame([("d", "a", "x"), ("d", "b", "x"), ("d", "c", "x"), ("d", "e", "x"), ("d", "m", "y"), ("d", "n", "y")], base.schema)
    got = {r.cas: r.coref_id for r in coref.merge(base, more).collect()}
    assert got == {"a": "1", "b": "1", "c": "2", "e": "1", "m": "new0", "n": "new0"}


def test_response_mapping_on_linkings(spark):
    frames = spark.createDataFrame([("d", "f1", "a"), ("d", "f1", "b"), ("d", "f2", "c"), ("d", "f2", "b"), ("d", "f3", "x")], "doc_id string, frame_id string, response_id string")
    rest = spark.createDataFrame([("d", "a"), ("d", "z")], "doc_id string, response_id string")
    mapping = spark.createDataFrame([("c", "a"), ("z", "a")], "response_id string, new_id string")
    got, left = transforms.map_linking(frames, rest, mapping, spark.createDataFrame([("x",)], "response_id string"), ["doc_id"])
    assert sorted((r.frame_id, r.response_id) for r in got.collect()) == [("f1", "a"), ("f1", "b")] and left.count() == 0


def test_presence_rules(spark):
    schema = "response_id string, is_assessed boolean, aet string, aer string, cas_ok string, bf_ok string, a_realis string, mention_type string"
    key = spark.createDataFrame([("1", True, "C", "C", "C", "C", "Actual", "NAME"), ("2", True, "C", None, None, None, None, None), ("3", True, "W", None, "C", None, None, None), ("4", True, "C", "I", "C", None, "Actual", "NAME"), ("5", False, *[None] * 6)], schema)
    assert {(r.response_id, r.rule) for r in scans.strictness(key).collect()} == {("2", "role assessment missing"), ("3", "filler assessment not expected"), ("4", "filler assessment missing")}
    got = {r.response_id: (r.repair, r.is_assessed, r.cas_ok) for r in scans.recovered(key).collect()}
    assert got == {"1": (None, True, "C"), "2": ("made unassessed", False, None), "3": ("fields removed", True, None), "4": ("made unassessed", False, None), "5": (None, False, None)}


def test_pool_and_percent(spark):
    s = spark.createDataFrame([("d", "a", 0.5, "x", 0), ("d", "a", 0.5, "y", 1), ("d", "b", 0.1, "x", 0), ("d", "b", 0.9, "y", 1)], "doc_id string, response_id string, confidence double, metadata string, store_ordinal int")
    assert {(r.response_id, r.confidence, r.metadata) for r in stores.pool(s, ["doc_id"]).collect()} == {("a", 0.5, "x"), ("b", 0.9, "y")}


def test_registered_queries_have_sql():
    from framescore.plans import catalog

    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) - set(catalog.ORACLES) <= {"cf2_merge_coref", "wn6_representative_documents"}


def test_import_without_the_corpus_operators(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parent.parent
    shutil.copytree(root / "framescore", tmp_path / "framescore", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout.split()[0]) > 50, done.stderr


def test_representative_documents_by_aggregates(spark):
    import random
    import statistics

    from framescore.operators import pipelines

    r = random.Random(5)
    rows = [(r.choice("ab"), f"D{k}", r.randint(1, 30), r.sample(["t1", "t2", "t3", "t4", *[f"x{j}" for j in range(12)]], r.randint(0, 3))) for k in range(80)]
    rows += [("c", f"E{k}", k, [f"f{k}"]) for k in range(30)] + [("d", "F0", 3, [])]
    d = spark.createDataFrame(rows, "genre string, doc_id string, size long, features array<string>")
    want = []
    for genre in "abcd":
        own = [x for x in rows if x[0] == genre]
        middle = statistics.median(x[2] for x in own)
        own.sort(key=lambda x: (abs(x[2] - middle), x[1]))
        covered, chosen = set(), []
        for _, i, _, features in own:
            if len(chosen) < 25 and not set(features) <= covered:
                covered |= set(features)
                chosen.append(i)
        chosen += [x[1] for x in own if x[1] not in chosen][: 25 - len(chosen)]
        want += [(genre, i, k) for k, i in enumerate(chosen)]
    found = pipelines.representative_documents(d)
    assert sorted(tuple(x) for x in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "WindowGroupLimit" in plan


def test_class_order_of_all_documents(spark):
    from types import SimpleNamespace

    from framescore.plans import storage
    from framescore.plans.registry import ORACLES, QUERIES

    rows = [("s1", f"D{k % 3}", t, role, f"e{k % 4}", "Actual") for k in range(24) for t, role in [("Life.Die", "Victim"), ("Contact.Meet", "Place")]]
    t = SimpleNamespace(responses=spark.createDataFrame(rows, "system_id string, doc_id string, event_type string, role string, cas string, realis string"))
    got = sorted(tuple(r) for r in storage.sl2_by_document(t).collect())
    classes = sorted({r[1:] for r in rows})
    assert got == [(*c, 1 + sum(x[0] == c[0] and x < c for x in classes)) for c in classes] and {r[0] for r in got} == {"D0", "D1", "D2"}
    assert sorted(tuple(r) for r in storage.sl2(t).collect()) == [r[1:] for r in got if r[0] == "D1"]
    assert "sl2_class_order_by_document" in QUERIES and "WHERE doc_id" not in ORACLES["sl2_class_order_by_document"].split("\n")[-1]


def test_derived_entry_points(spark):
    from framescore.operators import queries

    both, one, other, banned = ("D1", "h1", "Life.Die"), ("D1", "h2", "Life.Die"), ("D2", "h1", "Contact.Meet"), ("D3", "h1", "Contact.Contact")
    rows = [("s1", *both, "Victim", "E1"), ("s2", *both, "Victim", "E1"), ("s2", *both, "Agent", "E2"), ("s1", *one, "Victim", "E3"), ("s1", *one, "Position", "E4"), ("s2", *other, "Place", "E5")]
    rows += [(s, *banned, "Place", "E6") for s in ("s1", "s2")] + [("s1", "D4", f"h{k}", "Life.Die", "Agent", "E7") for k in range(4)]
    d = spark.createDataFrame(rows, "system_id string, doc_id string, hopper_id string, event_type string, role string, entity_id string")
    got = {tuple(r) for r in queries.derived_entry_points(d).collect()}
    by = {}
    for q, *rest in got:
        by.setdefault(q, set()).add(tuple(rest))
    assert by["COMMON_0000"] == {("D1", "h1", "Victim", "E1"), ("D1", "h1", "Agent", "E2")}
    assert by["SINGLE_SYS_s2_0000"] == {("D2", "h1", "Place", "E5")}
    singles = [x for q, x in by.items() if q.startswith("SINGLE_SYS_s1_")]
    assert sorted(by) == ["COMMON_0000", *[f"SINGLE_SYS_s1_{k:04d}" for k in range(5)], "SINGLE_SYS_s2_0000"]
    assert {("D1", "h2", "Victim", "E3")} in singles and set().union(*singles) == {("D1", "h2", "Victim", "E3"), *[("D4", f"h{k}", "Agent", "E7") for k in range(4)]}
    few = {r.query_id for r in queries.derived_entry_points(d, common=0, single=2).collect()}
    assert few == {"SINGLE_SYS_s1_0000", "SINGLE_SYS_s1_0001", "SINGLE_SYS_s2_0000"}


def test_justification_within_a_trigger(spark):
    from framescore.operators import queries

    d = spark.sql("SELECT array(named_struct('start', s, 'end', e)) AS pj, array(named_struct('start', 10, 'end', 20)) AS triggers FROM VALUES (10, 20), (12, 15), (9, 15), (5, 30) AS v(s, e)")
    assert [r[0] for r in d.select(queries.pj_matches(within_trigger=True)).collect()] == [True, True, False, False]
    assert [r[0] for r in d.select(queries.pj_matches(slack=0)).collect()] == [True, False, False, True]


@pytest.mark.parametrize("layout", ["parquet", "json"])
def test_score_table(spark, tmp_path, layout):
    from framescore.sources import scans

    rows, points = [("s1", "tp", 3.0), ("s1", "fn", 0.25), ("s2", "tp", None)], [("s1", 0.05, 0.2), ("s1", 0.95, 0.4)]
    spark.createDataFrame(rows, "system_id string, metric string, value double").write.format(layout).save(f"{tmp_path}/scores")
    spark.createDataFrame(points, "system_id string, p double, value double").write.format(layout).save(f"{tmp_path}/percentiles")
    assert sorted(map(tuple, scans.score_table(spark, f"{tmp_path}/scores", layout).collect()), key=str) == sorted(rows, key=str)
    assert sorted(map(tuple, scans.score_table(spark, f"{tmp_path}/percentiles", layout, percentiles=True).collect())) == points
