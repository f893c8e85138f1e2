"""Lines of the text layouts, and their writing: one file a system and document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescore.functions.scalars import format_span, format_spans, kb_escape
from framescore.operators.ranks import with_ordinal

from .scans import kb_mention_kind


def argument_line() -> Column:
    clean = F.regexp_replace("cas", "[\t\r\n]+", " ")
    cols = ["response_id", "doc_id", "event_type", "role", clean, format_span(F.col("cas_start"), F.col("cas_end")), format_spans(F.col("pj")), format_span(F.col("bf_start"), F.col("bf_end")), format_spans(F.col("aaj")), "realis", F.col("confidence").cast("string")]
    return F.concat_ws("\t", *cols)


def argument_lines(responses: DataFrame) -> DataFrame:
    return responses.select("system_id", "doc_id", "response_id", argument_line().alias("line"))


def with_comments(rows: DataFrame, keys: list[str], order: list, line: Column) -> DataFrame:
    """(*keys, line_no, line): each row's line, after a comment line with its metadata where it has any, in order."""
    both = F.when(F.col("metadata").isNotNull(), F.array(F.concat(F.lit("#"), "metadata"), line)).otherwise(F.array(line))
    at = Window.partitionBy(*keys).orderBy(*order, "_k")
    d = rows.select(*keys, *order, F.posexplode(both).alias("_k", "line"))
    return d.select(*keys, (F.row_number().over(at) - 1).alias("line_no"), "line")


def argument_file(responses: DataFrame, order: str = "response_id") -> DataFrame:
    """(system_id, doc_id, line_no, line) of argument files: rows by identifier, or by old_id for the old layout."""
    return with_comments(responses, ["system_id", "doc_id"], [order], argument_line())


def linking_file(frames: DataFrame, incomplete: DataFrame, layout: str = "2016") -> DataFrame:
    """(system_id, doc_id, line_no, line) of linking files: a line a frame, by the members, then INCOMPLETE.

    2016: frame id, tab, members apart by blanks; 2015: members apart by tabs. A document with frames or incomplete
    responses has one INCOMPLETE line, which may be empty.
    """
    keys = ["system_id", "doc_id"]
    sets = frames.groupBy(*keys, "frame_id").agg(F.array_sort(F.collect_set("response_id")).alias("m"))
    line = F.concat_ws("\t", "frame_id", F.array_join("m", " ")) if layout == "2016" else F.array_join("m", "\t")
    rest = incomplete.groupBy(*keys).agg(F.array_sort(F.collect_set("response_id")).alias("m"))
    docs = frames.select(*keys).unionByName(incomplete.select(*keys)).distinct().join(rest, keys, "left")
    last = docs.select(*keys, F.lit(1).alias("last"), F.array().cast("array<string>").alias("m"), F.lit("").alias("frame_id"), F.concat(F.lit("INCOMPLETE\t"), F.coalesce(F.array_join("m", "\t"), F.lit(""))).alias("line"))
    d = sets.select(*keys, F.lit(0).alias("last"), "m", "frame_id", line.alias("line")).unionByName(last)
    at = Window.partitionBy(*keys).orderBy("last", "m", "frame_id")
    return d.select(*keys, (F.row_number().over(at) - 1).alias("line_no"), "line")


def corpus_linking_file(corpus: DataFrame) -> DataFrame:
    """(system_id, line_no, line) of corpus-linking files: a frame's id, tab, its references apart by blanks; by id."""
    refs = F.concat_ws("-", "doc_id", "frame_id")
    lines = corpus.groupBy("system_id", "corpus_frame_id").agg(F.concat_ws("\t", F.col("corpus_frame_id"), F.array_join(F.array_sort(F.collect_set(refs)), " ")).alias("line"))
    return lines.select("system_id", (F.row_number().over(Window.partitionBy("system_id").orderBy("corpus_frame_id")) - 1).alias("line_no"), "line")


def query_store_file(responses: DataFrame) -> DataFrame:
    """(line_no, line) of the one query-response file: query_id, doc_id, systems, pj, assessment or null, metadata or null;
    by query, document and justifications, a shorter list before a longer one that begins like it."""
    d = responses.withColumn("pj", F.array_sort("pj"))
    line = F.concat_ws("\t", "query_id", "doc_id", F.array_join(F.array_sort("systems"), ","), format_spans("pj", ""), F.coalesce("assessment", F.lit("UNASSESSED")))
    d = d.select("query_id", "doc_id", "pj", F.when(F.col("metadata").isNotNull(), F.concat(F.lit("#"), "metadata", F.lit("\n"), line)).otherwise(line).alias("line"))
    numbered = with_ordinal(d, ["query_id", "doc_id", "pj"], "place")
    return numbered.select("place", F.posexplode(F.split("line", "\n")).alias("k", "line")).select((2 * F.col("place") + F.col("k")).alias("line_no"), "line")


def quote_file(regions: DataFrame) -> DataFrame:
    """(line_no, line) of a quote file: the number of documents, then for each its id and its regions."""
    docs = regions.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda x: format_span(x["start"], x["end"])), " ").alias("regions"))
    lines = with_ordinal(docs, ["doc_id"], "place").select("place", F.posexplode(F.array("doc_id", "regions")).alias("k", "line"))
    count = docs.agg(F.lit(0).cast("long").alias("line_no"), F.count(F.lit(1)).cast("string").alias("line"))
    return count.unionByName(lines.select((2 * F.col("place") + F.col("k") + 1).alias("line_no"), "line"))


def annotation_lines(key: DataFrame) -> DataFrame:
    """(doc_id, place, line): assessed rows first, then unassessed ones with fillers, each by id."""
    shown = lambda c: F.when(F.col("is_assessed"), F.coalesce(F.col(c), F.lit("NIL"))).otherwise(F.lit("UNANNOTATED"))
    fields = [shown("aet"), shown("aer"), shown("cas_ok"), shown("bf_ok"), F.coalesce("coref_id", F.lit("NIL")), shown("a_realis"), shown("mention_type")]
    line = F.concat_ws("\t", argument_line(), *fields)
    return key.withColumn("confidence", F.lit(1.0)).select("doc_id", (~F.col("is_assessed")).cast("int").alias("place"), "response_id", line.alias("line"))


def query_lines(entry_points: DataFrame) -> DataFrame:
    cols = ["query_id", "doc_id", "hopper_id", "role", "entity_id"]
    return entry_points.select(*cols).orderBy(*cols).select(F.concat_ws("\t", *cols).alias("line"))


def write_lines(lines: DataFrame, path: str, order: list[str], by: list[str]) -> None:
    """Text files under path, one for each value of the columns `by`, in order. Rows of a file are sorted within one task."""
    lines.repartition(*by).sortWithinPartitions(*by, *order).select(*by, "line").write.partitionBy(*by).text(path)


def write_file(lines: DataFrame, path: str, order: str = "line_no") -> None:
    """Text files under path that are one file's lines in order, read in the order of their names; dealt by ranges."""
    lines.repartitionByRange(order).sortWithinPartitions(order).select("line").write.text(path)


KIND_RANK = {"type": 0, "entity canonical mention": 1, "event canonical mention": 2, "entity mention": 3, "link": 4}


def kb_lines(assertions: DataFrame) -> DataFrame:
    """(subject, place, line): confidences with six digits, 1e-6 at least; mentions quoted and escaped."""
    rank = F.lit(5)
    for k, v in KIND_RANK.items():
        rank = F.when(F.col("mention_kind") == k, v).otherwise(rank)
    conf = F.when(F.col("confidence").isNotNull(), F.format_string("%.6f", F.greatest("confidence", F.lit(1e-6))))
    predicate = F.concat_ws(".", "predicate", "realis")
    middle = F.coalesce("object", F.concat(F.lit('"'), kb_escape(F.col("mention")), F.lit('"')))
    return assertions.select("subject", rank.alias("place"), F.concat_ws("\t", "subject", predicate, middle, "provenance", conf).alias("line"))


def kb_file(assertions: DataFrame, run: str) -> DataFrame:
    """(line_no, line) of a knowledge-base file: the run's name, then its assertions by node, kind and text. assertions: as
    `scans.kb_assertions` returns them."""
    kind = F.when(F.col("kind") == "mention", kb_mention_kind(F.col("predicate"), F.col("subject"), F.col("realis"))).otherwise(F.col("kind"))
    lines = with_ordinal(kb_lines(assertions.withColumn("mention_kind", kind)), ["subject", "place", "line"], "at")
    first = assertions.sparkSession.createDataFrame([(0, run)], "line_no long, line string")
    return first.unionByName(lines.select((F.col("at") + 1).alias("line_no"), "line"))


def node_name(name: Column, seed: int, ordinal: Column, kind: str = "Entity") -> Column:
    """The node's name, or a seeded one."""
    return F.coalesce(name, F.concat(F.lit(f":{kind}_"), F.md5(F.concat(F.lit(f"{seed}|"), ordinal.cast("string")))))


def scores_long(scores: DataFrame, metrics: list[str], by: str = "system_id") -> DataFrame:
    """(by, metric, value) of a score table with a column for each metric."""
    return scores.select(by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(by, metrics, "metric", "value")


def write_scores(tables: dict[str, DataFrame], path: str) -> None:
    """Score tables by name under path, each once as parquet and once as CSV with a header, in order of all its columns."""
    for name, d in tables.items():
        ordered = d.repartitionByRange(*d.columns).sortWithinPartitions(*d.columns)
        ordered.write.parquet(f"{path}/{name}")
        ordered.write.option("header", True).csv(f"{path}/{name}.csv")
