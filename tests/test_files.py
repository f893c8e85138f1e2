"""Layouts written to files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from framescore.functions import ident
from framescore.sources import scans, sinks

RESPONSES = "system_id string, doc_id string, event_type string, role string, cas string, cas_start int, cas_end int, bf_start int, bf_end int, pj array<struct<start:int,end:int>>, aaj array<struct<start:int,end:int>>, realis string, confidence double, metadata string"
ROWS = [
    ("s1", "D1", "Life.Die", "Victim", "a\tb", 0, 2, 0, 1, [(5, 9), (0, 3)], [], "Actual", 0.5, "first"),
    ("s1", "D1", "Life.Die", "Agent", "c", 4, 5, 4, 5, [(0, 9)], [(7, 8)], "Other", 0.25, None),
    ("s1", "D2", "Contact.Meet", "Time", "1990-XX-XX", 4, 5, 4, 5, [(0, 9)], [], "Generic", 1.0, "# odd"),
    ("s2", "D1", "Life.Die", "Place", "é", 1, 1, 1, 1, [(1, 1)], [], "Actual", 0.0, None),
]


def responses(spark):
    d = spark.createDataFrame(ROWS, RESPONSES).withColumn("pj", F.array_sort("pj"))
    return d.withColumn("response_id", ident.response_id())


def test_argument_files(spark, tmp_path):
    d, path = responses(spark), f"{tmp_path}/arguments"
    sinks.write_lines(sinks.argument_file(d), path, ["line_no"], ["system_id", "doc_id"])
    lines = scans.numbered_lines(spark, f"{path}/*/*/*.txt")
    own = ["doc_id", "event_type", "role", "cas", "cas_start", "cas_end", "bf_start", "bf_end", "pj", "aaj", "realis"]
    got = scans.argument_output(lines, own).select(*own, "confidence", "metadata")
    want = d.withColumn("cas", F.translate("cas", "\t", " ")).select(*own, "confidence", "metadata")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    text = {r.path: [] for r in lines.collect()}
    for r in lines.orderBy("line_no").collect():
        text[r.path].append(r.line)
    first = next(v for k, v in text.items() if "system_id=s1/doc_id=D1/" in k)
    ids = [x.split("\t")[0] for x in first if x and not x.startswith("#")]
    assert ids == sorted(ids) and first[first.index("#first") + 1].split("\t")[3] == "Victim"


def test_linking_files(spark, tmp_path):
    frames = spark.createDataFrame([("s1", "D1", f, r) for f, r in (("f1", "b"), ("f1", "a"), ("f2", "c"), ("f2", "a"))] + [("s2", "D1", "f9", "x")], "system_id string, doc_id string, frame_id string, response_id string")
    rest = spark.createDataFrame([("s1", "D1", "z"), ("s1", "D1", "y"), ("s1", "D2", "q")], "system_id string, doc_id string, response_id string")
    for layout, scan in (("2016", scans.linking_2016), ("2015", scans.linking_2015)):
        path = f"{tmp_path}/linking{layout}"
        sinks.write_lines(sinks.linking_file(frames, rest, layout), path, ["line_no"], ["system_id", "doc_id"])
        own = lambda d, *c: sorted((*r.path.split("/")[-3:-1], *(r[x] for x in c)) for r in d.collect())
        lines = scans.numbered_lines(spark, f"{path}/*/*/*.txt")
        got, left = scan(lines)
        assert own(left, "response_id") == [("system_id=s1", "doc_id=D1", "y"), ("system_id=s1", "doc_id=D1", "z"), ("system_id=s1", "doc_id=D2", "q")]
        members = {}
        for s, d, f, r in own(got, "frame_id", "response_id"):
            members.setdefault((s, d, f), []).append(r)
        assert sorted(members.values()) == [["a", "b"], ["a", "c"], ["x"]]
        if layout == "2016":
            assert {f for _, _, f in members} == {"f1", "f2", "f9"}
    assert [r.line for r in sinks.linking_file(frames, rest).filter("doc_id = 'D2'").collect()] == ["INCOMPLETE\tq"]


def test_query_store_file(spark, tmp_path):
    rows = [("Q1", "D1", ["s2", "s1"], [(5, 9), (0, 3)], "CORRECT", None), ("Q1", "D1", ["s1"], [(0, 3)], None, "note"), ("Q0", "D9", ["s1"], [(1, 1)], "WRONG", None)]
    d = spark.createDataFrame(rows, "query_id string, doc_id string, systems array<string>, pj array<struct<start:int,end:int>>, assessment string, metadata string")
    sinks.write_file(sinks.query_store_file(d), f"{tmp_path}/store")
    lines = scans.numbered_lines(spark, f"{tmp_path}/store/*.txt")
    text = [r.line for r in lines.orderBy("path", "line_no").collect() if r.line]
    assert text == ["Q0\tD9\ts1\t1-1\tWRONG", "#note", "Q1\tD1\ts1\t0-3\tUNASSESSED", "Q1\tD1\ts1,s2\t0-3,5-9\tCORRECT"]
    got = {(r.query_id, len(r.pj)): (r.assessment, r.metadata, r.systems) for r in scans.query_assessments(lines).collect()}
    assert got == {("Q0", 1): ("WRONG", None, ["s1"]), ("Q1", 1): (None, "note", ["s1"]), ("Q1", 2): ("CORRECT", None, ["s1", "s2"])}


def test_quote_file(spark, tmp_path):
    regions = [("D2", 4, 60), ("D2", 67, 88), ("D10", 1, 2)]
    sinks.write_file(sinks.quote_file(spark.createDataFrame(regions, "doc_id string, start int, end int")).coalesce(1), f"{tmp_path}/quotes")
    lines = scans.numbered_lines(spark, f"{tmp_path}/quotes/*.txt")
    assert [r.line for r in lines.orderBy("path", "line_no").collect() if r.line] == ["2", "D10", "1-2", "D2", "4-60 67-88"]
    one = spark.createDataFrame([("f", k, x) for k, x in enumerate(["2", "D10", "1-2", "D2", "4-60 67-88"])], "path string, line_no int, line string")
    assert sorted(tuple(r) for r in scans.quote_file(one).collect()) == sorted(regions)


def test_vocabularies(spark, tmp_path):
    lines = lambda *x: spark.createDataFrame([(y,) for y in x], "line string")
    assert sorted(r.symbol for r in scans.symbols(lines("a", " b ", "", "a")).collect()) == ["a", "b"]
    pairs = scans.symbol_map(lines("D1\t/x/D1.txt", "D2\t/y", "D1\t/z"))
    assert {(r.key, r.value) for r in pairs.collect()} == {("D1", "/x/D1.txt"), ("D2", "/y"), ("D1", "/z")}
    assert [tuple(r) for r in scans.repeated_keys(pairs).collect()] == [("D1", 2)]
    assert {tuple(r) for r in scans.symbol_multimap(lines("T a b", "U")).collect()} == {("T", "a"), ("T", "b")}
    kinds = spark.createDataFrame([("type", "life\tLife"), ("type", "")], "kind string, line string")
    assert [tuple(r) for r in scans.ontology_map(kinds).collect()] == [("type", "life", "Life")]


def test_raw_texts_and_equivalence_ids(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "D1.txt").write_text("one\ntwo")
    (tmp_path / "raw" / "D2.txt").write_text("")
    assert {(r.doc_id, r.text) for r in scans.raw_texts(spark, f"{tmp_path}/raw", r"\.txt").collect()} == {("D1", "one\ntwo")}  # an empty file has no row
    for system, tp, fp in (("s1", "a\nb\n", "c\n"), ("s2", "a\n", "")):
        (tmp_path / "ids" / system / "Standard").mkdir(parents=True)
        (tmp_path / "ids" / system / "Standard" / "TruePositives.ids.txt").write_text(tp)
        (tmp_path / "ids" / system / "Standard" / "FalsePositive.ids.txt").write_text(fp)
    assert {tuple(r) for r in scans.equivalence_ids(spark, f"{tmp_path}/ids").collect()} == {("s1", "TP", "a"), ("s1", "TP", "b"), ("s1", "FP", "c"), ("s2", "TP", "a")}


def test_gold_ids(spark):
    d = spark.createDataFrame([("D1-kbp", "D1.kbp"), ("D2", "D2"), ("D3-kbp", "D4")], "doc_id string, requested string")
    assert [r.doc_id for r in scans.gold_ids(d).orderBy("requested").collect()] == ["D1", "D2", "D3"]
    assert [tuple(r) for r in scans.id_mismatches(d).collect()] == [("D4", "D3-kbp")]


def test_recovery_of_assessments(spark):
    cols = "doc_id string, cas string, cas_start int, cas_end int, is_assessed boolean, aet string, aer string, cas_ok string, bf_ok string, a_realis string, mention_type string, coref_id string"
    rows = [
        ("D", "fine", 0, 1, True, "C", "C", "C", "C", "Actual", "NAME", "7"), ("D", "alone", 0, 1, True, "C", "C", "I", "C", "Actual", "NAME", None),
        ("D", "lacks", 0, 1, True, "C", None, None, None, None, None, "7"), ("D", "extra", 0, 1, True, "W", None, "C", None, None, None, None), ("D", "none", 0, 1, False, None, None, None, None, None, None, None),
    ]
    got = {r.cas: r for r in scans.recovered(spark.createDataFrame(rows, cols)).collect()}
    assert got["fine"].repair is None and got["fine"].coref_id == "7" and got["alone"].coref_id.startswith("s")
    lost = got["lacks"]
    assert lost.repair == "made unassessed" and not lost.is_assessed and {lost.aet, lost.aer, lost.cas_ok} == {None} and lost.coref_id == "7"
    assert got["extra"].repair == "fields removed" and got["extra"].aet == "W" and got["extra"].cas_ok is None and got["extra"].coref_id is None
    assert {tuple(r) for r in scans.repair_counts(scans.recovered(spark.createDataFrame(rows, cols))).collect()} == {("made unassessed", 1), ("fields removed", 1)}


def test_mentions_do_not_depend_on_line_numbers(spark):
    """Lines whose numbers differ with each reading."""
    import random

    from framescore.operators import kb
    from framescore.sources import scans

    number = F.udf(lambda: random.getrandbits(40) + 1, "long").asNondeterministic()
    lines = spark.createDataFrame([(f':Entity_{k}\tcanonical_mention\t"m{k}"\tD{k}:1-5,E{k}:2-3,D{k}:8-9\t0.5',) for k in range(50)], "line string")
    told = scans.kb_assertions(lines.withColumn("line_no", number()))
    want = {(f"{d}{k}", f":Entity_{k}", f"m{k}") for k in range(50) for d in "DE"}
    assert {tuple(r) for r in kb.canonical_mentions(told).collect()} == want
    assert {(r.doc_id, r.node, r.mention) for r in kb.mentions_of_nodes(told).collect()} == want


def test_kb_lines_are_matched_once_each(spark):
    """Conditions on an assertion's columns add no pattern to the plan, and fields are parted as by the plain pattern."""
    import re

    lines = spark.createDataFrame([(1, "x")], "line_no long, line string")
    got = scans.kb_assertions(lines)
    patterns = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")
    assert patterns(got) == patterns(got.filter("kind = 'mention' AND provenance <> 'NIL'")) == len(scans.KB_SHAPES)
    texts = ["a\tb\tc", "a\t\"b\tc\"\td", "a\t\"b\\\"\tc\"\td", "a\t\"b\tc", "a\\\tb\tc", "\t\t", "a\t\"\"\tb\\", "q\"\t\"\t" + "x" * 3000 + "\ty"]
    plain = r"\t(?=(?:[^\"\\]|\\.|\"(?:[^\"\\]|\\.)*\")*$)"
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.split("t", scans.QUOTED_FIELDS).alias("f"))
    assert {r.t: r.f for r in d.collect()} == {t: re.split(plain, t) for t in texts}
