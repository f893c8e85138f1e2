"""Scans of the tab-separated layouts. Each takes lines (path, line_no, line) or a path, and returns logical tables.

`numbered_lines` reads whole files, since line order matters where a comment belongs to the line after it; a file holds
one document, so that is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from framescore.functions.scalars import kb_unescape, parse_span, parse_spans
from framescore.operators.invariants import required
from framescore.operators.ranks import with_ordinal

UNANNOTATED = "UNANNOTATED"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text files, one document a file."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def _field(n: int) -> Column:
    return F.trim(F.get("f", F.lit(n)))


def with_metadata(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor comments, with the comment just before them as metadata."""
    before = F.lag("line").over(Window.partitionBy("path").orderBy("line_no"))
    d = lines.withColumn("metadata", F.when(before.startswith("#"), F.substring(before, 2, 1 << 20)))
    return d.filter((F.trim("line") != "") & ~F.col("line").startswith("#")).withColumn("f", F.split("line", "\t"))


def argument_rows(lines: DataFrame) -> DataFrame:
    """The eleven columns. The identifier column is not trusted; ids are computed anew."""
    cas, bf = parse_span(_field(5)), parse_span(_field(7))
    return with_metadata(lines).select(
        "path", "line_no", _field(1).alias("doc_id"), _field(2).alias("event_type"), _field(3).alias("role"), _field(4).alias("cas"),
        cas["start"].alias("cas_start"), cas["end"].alias("cas_end"), bf["start"].alias("bf_start"), bf["end"].alias("bf_end"),
        F.array_sort(F.array_distinct(parse_spans(_field(6)))).alias("pj"), F.array_sort(F.array_distinct(parse_spans(_field(8)))).alias("aaj"),
        _field(9).alias("realis"), _field(10).cast("double").alias("confidence"), "metadata", "f",
    )


def argument_output(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Argument output: repeated responses keep the highest confidence and its metadata."""
    return argument_rows(lines).groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.max_by("metadata", F.struct("confidence", -F.col("line_no"))).alias("metadata"))


def annotation_store(lines: DataFrame) -> DataFrame:
    """The eleven columns and seven of assessment; NIL is null, and any UNANNOTATED field makes a row unassessed."""
    d = argument_rows(lines)
    raw = {n: _field(k) for n, k in zip(("aet", "aer", "cas_ok", "bf_ok", "coref_id", "a_realis", "mention_type"), range(11, 18), strict=True)}
    known = ~F.arrays_overlap(F.transform(F.slice("f", 12, 7), lambda x: F.trim(x)), F.array(F.lit(UNANNOTATED)))
    clean = lambda c: F.when(~F.coalesce(c, F.lit("")).isin("", "NIL", UNANNOTATED), c)
    cols = [clean(c).alias(n) if n == "coref_id" else F.when(known, clean(c)).alias(n) for n, c in raw.items()]
    return d.select("*", known.alias("is_assessed"), *cols).drop("f")


def strictness(key: DataFrame) -> DataFrame:
    """Rows whose fields break the rules of presence, with the rule."""
    good = lambda c: F.coalesce(F.col(c) != "W", F.lit(False))
    rest = ["cas_ok", "bf_ok", "a_realis", "mention_type"]
    have = [F.col(c).isNotNull() for c in rest]
    all_, any_ = have[0] & have[1] & have[2] & have[3], have[0] | have[1] | have[2] | have[3]
    rules = F.filter(
        F.array(
            F.when(good("aet") & F.col("aer").isNull(), "role assessment missing"),
            F.when(good("aet") & good("aer") & ~all_, "filler assessment missing"),
            F.when(~(good("aet") & good("aer")) & any_, "filler assessment not expected"),
        ),
        lambda x: x.isNotNull(),
    )
    return key.filter("is_assessed").select("*", F.explode(rules).alias("rule"))


def recovered(key: DataFrame, counts: Observation | None = None) -> DataFrame:
    """The key with broken rows mended: fields that may not be there are nulled, and a row that lacks one becomes
    unassessed, without any field. An acceptable CAS without a cluster gets one of its own, named by what it is, where the
    key has coref_id. `repair` names what was done to the fields, or is null. counts gets, in the same pass, how often each
    was done: `made_unassessed`, `fields_removed`, and `singletons` where the key has coref_id."""
    good = lambda c: F.coalesce(F.col(c) != "W", F.lit(False))
    rest = ["cas_ok", "bf_ok", "a_realis", "mention_type"]
    full = good("aet") & good("aer")
    lacking = F.lit(False)
    extra = F.lit(False)
    for c in rest:
        lacking, extra = lacking | F.col(c).isNull(), extra | F.col(c).isNotNull()
    missing = F.col("aet").isNull() | (good("aet") & F.col("aer").isNull()) | (full & lacking)
    repair = F.when(F.col("is_assessed") & missing, "made unassessed").when(F.col("is_assessed") & ~full & extra, "fields removed")
    d = key.withColumn("repair", repair)
    gone = F.coalesce(F.col("repair") == "made unassessed", F.lit(False))
    keep = lambda c: F.when(gone | ((F.col("repair").isNotNull()) if c in rest else F.lit(False)), None).otherwise(F.col(c))
    d = d.select(*[c for c in d.columns if c not in ("aet", "aer", *rest)], *[keep(c).alias(c) for c in ("aet", "aer", *rest)])
    d = d.withColumn("is_assessed", F.col("is_assessed") & ~gone)
    if "coref_id" in d.columns:
        own = F.concat(F.lit("s"), F.md5(F.concat_ws("|", "doc_id", "cas", "cas_start", "cas_end")))
        alone = F.col("coref_id").isNull() & F.coalesce(F.col("cas_ok") != "W", F.lit(False))
        d = d.withColumn("_alone", alone).withColumn("coref_id", F.when(F.col("_alone"), own).otherwise(F.col("coref_id")))
    if counts is not None:
        done = [F.count_if(F.col("repair") == r).alias(r.replace(" ", "_")) for r in ("made unassessed", "fields removed")]
        d = d.observe(counts, *done, *[F.count_if("_alone").alias("singletons")] * ("_alone" in d.columns))
    return d.drop("_alone")


def repair_counts(mended: DataFrame) -> DataFrame:
    """(repair, n) of what `recovered` did."""
    return mended.filter("repair IS NOT NULL").groupBy("repair").agg(F.count(F.lit(1)).alias("n"))


def linking_2015(lines: DataFrame, responses: DataFrame | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(frames, incomplete): a line a frame, numbered in order; INCOMPLETE begins the line of unlinked responses. With
    responses (response_id), either table fails when read where a line names an unknown one (strict), or is without it."""
    d = lines.filter("trim(line) <> ''").withColumn("ids", F.filter(F.split("line", r"[\t ]+"), lambda x: x != ""))
    first = F.get("ids", F.lit(0)) == "INCOMPLETE"
    frames = d.filter(~first).select("path", F.col("line_no").cast("string").alias("frame_id"), F.explode("ids").alias("response_id"))
    incomplete = d.filter(first).select("path", F.explode(F.slice("ids", 2, 1 << 30)).alias("response_id"))
    if responses is None:
        return frames, incomplete
    known = responses.select("response_id").distinct().withColumn("_known", F.lit("y"))

    def checked(d: DataFrame) -> DataFrame:
        if not strict:
            return d.join(known, "response_id", "left_semi").select(*d.columns)
        return d.join(known, "response_id", "left").filter(required(F.col("_known"), "every linked id is a response", "path", "response_id") == "y").select(*d.columns)

    return checked(frames), checked(incomplete)


def linking_2016(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, incomplete) where each line begins with a frame id; equal sets collapse to the first id in order."""
    d = lines.filter("trim(line) <> ''").withColumn("ids", F.filter(F.split("line", r"[\t ]+"), lambda x: x != ""))
    first = F.get("ids", F.lit(0))
    sets = d.filter(first != "INCOMPLETE").select("path", first.alias("frame_id"), F.array_sort(F.array_distinct(F.slice("ids", 2, 1 << 30))).alias("members"))
    frames = sets.groupBy("path", "members").agg(F.min("frame_id").alias("frame_id")).select("path", "frame_id", F.explode("members").alias("response_id"))
    return frames, d.filter(first == "INCOMPLETE").select("path", F.explode(F.slice("ids", 2, 1 << 30)).alias("response_id"))


def unknown_ids(frames: DataFrame, responses: DataFrame) -> DataFrame:
    return frames.join(responses.select("response_id").distinct(), "response_id", "left_anti")


def corpus_linking(lines: DataFrame) -> DataFrame:
    """(corpus_frame_id, doc_id, frame_id), after system_id where lines have it; a reference splits at its last dash."""
    d = lines.filter("trim(line) <> ''").withColumn("f", F.split("line", "\t"))
    own = ["system_id"] if "system_id" in lines.columns else []
    refs = d.select(*own, _field(0).alias("corpus_frame_id"), F.explode(F.split(_field(1), " +")).alias("ref")).filter("ref <> ''")
    part = lambda n: F.regexp_extract("ref", "^(.*)-([^-]*)$", n)
    return refs.select(*own, "corpus_frame_id", part(1).alias("doc_id"), part(2).alias("frame_id"))


def queries(lines: DataFrame) -> DataFrame:
    d = lines.filter("trim(line) <> ''").withColumn("f", F.split("line", "\t"))
    return d.select(_field(0).alias("query_id"), _field(1).alias("doc_id"), _field(2).alias("hopper_id"), _field(3).alias("role"), _field(4).alias("entity_id"), F.col("line_no").alias("ep_ordinal"))


def query_assessments(lines: DataFrame) -> DataFrame:
    """(query_id, doc_id, systems, pj, assessment, metadata); UNASSESSED is null."""
    d = with_metadata(lines)
    spans = F.array_sort(parse_spans(_field(3)))
    return d.select(_field(0).alias("query_id"), _field(1).alias("doc_id"), F.array_sort(F.split(_field(2), ",")).alias("systems"), spans.alias("pj"), F.when(_field(4) != "UNASSESSED", _field(4)).alias("assessment"), "metadata")


def quote_file(lines: DataFrame) -> DataFrame:
    """(doc_id, start, end) of a count line and pairs of lines: a document, its regions."""
    after = F.lead("line").over(Window.partitionBy("path").orderBy("line_no"))
    d = lines.withColumn("regions", after).filter("line_no % 2 = 1 AND trim(line) <> ''")
    spans = d.select(F.trim("line").alias("doc_id"), F.explode(F.filter(F.split("regions", " "), lambda x: x != "")).alias("s"))
    return spans.select("doc_id", parse_span(F.col("s"))["start"].alias("start"), parse_span(F.col("s"))["end"].alias("end"))


def symbol_multimap(lines: DataFrame) -> DataFrame:
    """(key, value) of lines with a key and its values."""
    return lines.filter("trim(line) <> ''").withColumn("f", F.filter(F.split("line", r"[\t ]+"), lambda x: x != "")).select(F.get("f", F.lit(0)).alias("key"), F.explode(F.slice("f", 2, 1 << 30)).alias("value"))


#: Shapes of knowledge-base lines in the order in which they are tried; each needs a name and a pattern.
_CONF = r"(?:\t(?<c>[0-9.]+))?$"
KB_SHAPES = {
    "type": r"^(:\S+)\ttype\t(\S+)",
    "link": r"^(:\S+)\tlink\t(\S+)",
    "mention": r"^(:\S+)\t((?:canonical_|nominal_|pronominal_|normalized_)?mention(?:\.(?:actual|generic|other))?)\t\"((?:[^\"\\]|\\.)*)\"\t(\S+)",
    "sentiment": r"^(:\S+)\t(\w+:(?:dis)?likes)\t(:\S+)\t(\S+)",
    "event argument": r"^(:Event\S*)\t(\w+\.[\w-]+:\w+\.(?:actual|generic|other))\t(:\S+)\t(\S+)",
    "inverse event argument": r"^(:\S+)\t(\w+:\w+\.[\w-]+_\w+\.(?:actual|generic|other))\t(:\S+)\t(\S+)",
    "relation": r"^(:\S+)\t(\w+:\w+_of|\w+:\w+s)\t(:Entity\S*)\t(\S+)",
    "slot filler": r"^(:\S+)\t(\w+:\w+)\t(:\S+)\t(\S+)",
}


#: A tab outside of quoted text. What is matched after it never needs to be given back, so nothing is tried twice.
QUOTED_FIELDS = r"\t(?=(?:[^\"\\]++|\\.|\"(?:[^\"\\]++|\\.)*+\")*+$)"


def kb_assertions(lines: DataFrame) -> DataFrame:
    """(line_no, kind, subject, predicate, object, mention, realis, provenance, confidence); repeats keep the first.

    The first line is the run's name. kind is null for a line of no known shape.
    """
    d = lines.filter("line_no > 0 AND trim(line) <> ''").withColumn("line", F.trim(F.regexp_replace("line", r"\s*#[^\"]*$", "")))
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(KB_SHAPES.items()):
        kind = F.when(F.col("line").rlike(pattern), name).otherwise(kind)
    plain = ~F.contains("line", F.lit('"')) & ~F.contains("line", F.lit("\\"))  # then every tab parts fields
    f = F.when(plain, F.split("line", "\t")).otherwise(F.split("line", QUOTED_FIELDS))
    # a generator, so that conditions on kind and fields are not rewritten into ones on the line, which would match its patterns again for each
    d = d.select("line_no", F.inline(F.array(F.struct(kind.alias("kind"), f.alias("f")))))
    at = lambda n: F.get("f", F.lit(n))
    short = F.col("kind").isin("type", "link")
    prov = F.when(~short, at(3))
    conf = F.when(short, at(3)).otherwise(at(4)).cast("double")
    out = d.select(
        "line_no", "kind", at(0).alias("subject"), F.regexp_replace(at(1), r"\.(actual|generic|other)$", "").alias("predicate"),
        F.when(F.col("kind") == "mention", None).otherwise(at(2)).alias("object"), F.when(F.col("kind") == "mention", kb_unescape(F.regexp_extract(at(2), '^"(.*)"$', 1))).alias("mention"),
        F.nullif(F.regexp_extract(at(1), r"\.(actual|generic|other)$", 1), F.lit("")).alias("realis"), prov.alias("provenance"), conf.alias("confidence"),
    )
    keys = ["kind", "subject", "predicate", "object", "mention", "realis", "provenance"]
    # an aggregation, as repeats go before anything is shuffled
    return out.groupBy(*keys).agg(F.min("line_no").alias("line_no"), F.min_by("confidence", "line_no").alias("confidence")).select(*out.columns)


def kb_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((run), assertions) of a knowledge base, one file or the parts of one in the order of their names, in which lines are
    numbered throughout: the first of them names the run, and of repeated assertions the first in the whole file stays."""
    lines = with_ordinal(spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row_id"), F.col("value").alias("line")), ["file_path", "file_block_start", "row_id"], "line_no")
    return lines.filter("line_no = 0").select(F.trim("line").alias("run")), kb_assertions(lines.select("line_no", "line"))


MAX_SPAN = 200


def kb_provenance(assertions: DataFrame) -> DataFrame:
    """(line_no, group_no, doc_id, start, end, trimmed): spans of 200 characters and more end at start + 199."""
    d = assertions.filter("provenance IS NOT NULL AND provenance <> 'NIL'").select("line_no", F.posexplode(F.split("provenance", ";")).alias("group_no", "g"))
    d = d.select("line_no", "group_no", F.explode(F.split("g", ",")).alias("p"))
    doc, span = F.regexp_extract("p", "^(.*):", 1), parse_span(F.regexp_extract("p", "([0-9]+-[0-9]+)$", 1))
    d = d.select("line_no", "group_no", doc.alias("doc_id"), span["start"].alias("start"), span["end"].alias("end"))
    long = F.col("end") - F.col("start") >= MAX_SPAN
    return d.select("line_no", "group_no", "doc_id", "start", F.when(long, F.col("start") + MAX_SPAN - 1).otherwise(F.col("end")).alias("end"), long.alias("trimmed"))


def kb_mention_kind(predicate: Column, subject: Column, realis: Column) -> Column:
    """Kind of a mention by its form, its node and whether it has a realis; null where they do not go together."""
    entity, event, string = subject.startswith(":Entity"), subject.startswith(":Event"), subject.startswith(":String")
    no = realis.isNull()
    return (
        F.when((predicate == "mention") & entity & no, "entity mention").when((predicate == "canonical_mention") & entity & no, "entity canonical mention")
        .when((predicate == "mention") & event & ~no, "event mention").when((predicate == "canonical_mention") & event & ~no, "event canonical mention")
        .when((predicate == "mention") & string & no, "string mention").when((predicate == "canonical_mention") & string & no, "string canonical mention")
        .when((predicate == "nominal_mention") & entity & no, "nominal mention").when((predicate == "pronominal_mention") & entity & no, "pronominal mention")
        .when((predicate == "normalized_mention") & string & no, "normalized mention")
    )


def score_table(spark: SparkSession, path: str, layout: str = "parquet", percentiles: bool = False) -> DataFrame:
    """(system_id, metric, value) of a stored score table, or (system_id, p, value) of bootstrap percentiles. layout:
    parquet or json."""
    return spark.read.schema(f"system_id string, {'p double' if percentiles else 'metric string'}, value double").format(layout).load(path)


def ontology_map(lines: DataFrame) -> DataFrame:
    """(kind, source, target) of lines (kind, line) with a source and its target."""
    f = F.split("line", r"\t")
    return lines.filter("trim(line) <> ''").select("kind", F.trim(F.get(f, 0)).alias("source"), F.trim(F.get(f, 1)).alias("target")).distinct()


def symbols(lines: DataFrame) -> DataFrame:
    """(symbol) of lines with one symbol each."""
    return lines.select(F.trim("line").alias("symbol")).filter("symbol <> ''").distinct()


def symbol_map(lines: DataFrame) -> DataFrame:
    """(key, value) of lines with a key and one value, as of documents and their paths, or systems and their teams."""
    f = F.split("line", r"\t", 2)
    return lines.filter("trim(line) <> ''").select(F.trim(F.get(f, 0)).alias("key"), F.trim(F.get(f, 1)).alias("value"))


def repeated_keys(mapping: DataFrame) -> DataFrame:
    """Keys of a map with several values, which are an error."""
    return mapping.groupBy("key").agg(F.count_distinct("value").alias("n")).filter("n > 1").select("key", "n")


def raw_texts(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(doc_id, text) of text files, one document a file, named after it. Spark's readers pass over files without a byte, so
    an empty document has no row; a left join from the list of documents reads it as empty."""
    name = F.regexp_replace(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1), f"{suffix}$", "")
    return spark.read.text(path, wholetext=True).select(name.alias("doc_id"), F.col("value").alias("text"))


#: Files of equivalence-class identifiers by the cell that they list.
CELL_FILES = {"TP": "TruePositives.ids.txt", "FP": "FalsePositive.ids.txt"}


def equivalence_ids(spark: SparkSession, path: str) -> DataFrame:
    """(system_id, cell, item) of the identifier files of every system's Standard folder under path."""
    parts = F.split(F.input_file_name(), "/")
    d = spark.read.text([f"{path}/*/Standard/{f}" for f in CELL_FILES.values()]).select(F.element_at(parts, -3).alias("system_id"), F.element_at(parts, -1).alias("file"), F.col("value").alias("item"))
    cell = F.when(F.col("file") == CELL_FILES["TP"], "TP").otherwise("FP")
    return d.filter("item <> ''").select("system_id", cell.alias("cell"), "item").distinct()


def gold_ids(gold: DataFrame) -> DataFrame:
    """gold with doc_id without the marks that the annotators' tools add."""
    return gold.withColumn("doc_id", F.replace("doc_id", F.lit("-kbp"), F.lit("")))


def id_mismatches(files: DataFrame) -> DataFrame:
    """(requested, doc_id) where a file's own id is not the one that it was asked for under, marks aside."""
    own, asked = F.replace("doc_id", F.lit("-kbp"), F.lit("")), F.replace("requested", F.lit(".kbp"), F.lit(""))
    return files.filter(own != asked).select("requested", "doc_id")
