"""Checks; each returns the rows that violate it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescore.functions.scalars import text_at


def violations(rows: DataFrame, check: str, bad: Column, severity: str = "error") -> DataFrame:
    return rows.filter(F.coalesce(bad, F.lit(True))).select("system_id", "doc_id", "response_id", F.lit(check).alias("check"), F.lit(severity).alias("severity"))


def span_past_end(responses: DataFrame, lengths: DataFrame) -> DataFrame:
    """Responses with a span at or past their document's end, or without a document. lengths: (doc_id, n)."""
    last = F.greatest("cas_end", "bf_end", F.array_max(F.transform("pj", lambda s: s["end"])), F.coalesce(F.array_max(F.transform("aaj", lambda s: s["end"])), F.lit(0)))
    return violations(responses.join(lengths, "doc_id", "left"), "span past end", F.col("n").isNull() | (last >= F.col("n")))


def filler_outside_justification(responses: DataFrame) -> DataFrame:
    held = F.exists("pj", lambda s: (s["start"] <= F.col("bf_start")) & (F.col("bf_end") <= s["end"]))
    return violations(responses, "filler outside justification", ~held, "warning")


def unlinked(responses: DataFrame, linking: DataFrame) -> DataFrame:
    """Non-generic responses in no frame, and linked ids that are no such response."""
    on = ["system_id", "doc_id", "response_id"]
    must = responses.filter("realis <> 'Generic'").select(*on).distinct()
    has = linking.select(*on).distinct()
    return must.join(has, on, "left_anti").withColumn("check", F.lit("not linked")).unionByName(has.join(must, on, "left_anti").withColumn("check", F.lit("linked but not to be")))


def outside_ontology(responses: DataFrame, valid: DataFrame, always: list[str]) -> DataFrame:
    """Responses of an unknown event type, and those whose role is neither their type's nor always valid. valid:
    (event_type, role)."""
    types = valid.select("event_type").distinct().withColumn("_t", F.lit(True))
    d = responses.join(types, "event_type", "left").join(valid.distinct().withColumn("_r", F.lit(True)), ["event_type", "role"], "left")
    strange = d.filter("_t IS NULL")
    return violations(strange, "unknown type", F.lit(True)).unionByName(violations(d.filter("_t"), "role not of the type", F.col("_r").isNull() & ~F.col("role").isin(*always)))


def outside_documents(arguments: DataFrame, linking: DataFrame, corpus: DataFrame) -> DataFrame:
    """(system_id, doc_id, check) of documents outside the corpus, on either side, and of linked ones without arguments."""
    key = ["system_id", "doc_id"]
    own, linked = arguments.select(*key).distinct(), linking.select(*key).distinct()
    out = lambda d, other, on, check: d.join(other, on, "left_anti").select(*key, F.lit(check).alias("check"))
    found = out(own, corpus, "doc_id", "arguments outside corpus").unionByName(out(linked, corpus, "doc_id", "linking outside corpus"))
    return found.unionByName(out(linked, own, key, "linking without arguments"))


def text_mismatch(responses: DataFrame, texts: DataFrame) -> DataFrame:
    """Warns of a CAS that is not in the text at its span, white space squeezed; times are exempt. texts: (doc_id, text)."""
    shown = F.regexp_replace(text_at(F.col("text"), F.col("cas_start"), F.col("cas_end")), r"[ \t\n\x0B\f\r]+", " ")
    d = responses.filter("role <> 'Time'").join(texts, "doc_id")
    return violations(d, "text is not at its span", F.coalesce(~F.contains(shown, F.col("cas")), F.lit(False)), "warning")


def ignored_place(responses: DataFrame) -> DataFrame:
    return violations(responses, "ignored place", (F.col("event_type") == "Movement.Transport") & (F.col("role") == "Place"), "warning")


def linked_types(linking: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, event_type, realis) that frames have; all that link validators look at, however large a frame is."""
    return linking.join(responses.select("system_id", "response_id", "event_type", "realis").distinct(), ["system_id", "response_id"]).select(*keys, "event_type", "realis").distinct()


def no_generic(types: DataFrame, keys: list[str]) -> DataFrame:
    """A link validator: (*keys, type_a, type_b) of frames with a generic argument."""
    return types.filter("realis = 'Generic'").select(*keys, F.col("event_type").alias("type_a"), F.col("event_type").alias("type_b")).distinct()


def only_linkable(linkable: DataFrame):
    """A link validator for a map of linkable types (type_a, type_b), which must hold in both directions, also for a type
    with itself."""
    both = linkable.join(linkable.select(F.col("type_b").alias("type_a"), F.col("type_a").alias("type_b")), ["type_a", "type_b"], "left_semi").distinct()

    def validator(types: DataFrame, keys: list[str]) -> DataFrame:
        t = types.select(*keys, "event_type").distinct()
        pairs = t.withColumnRenamed("event_type", "type_a").join(t.withColumnRenamed("event_type", "type_b"), keys).filter("type_a <= type_b")
        return pairs.join(both, ["type_a", "type_b"], "left_anti").select(*keys, "type_a", "type_b")

    return validator


def linking_violations(types: DataFrame, keys: list[str], validators: dict) -> DataFrame:
    """(*keys, type_a, type_b, check): what any of the named validators objects to; a linking is valid if none does."""
    found = None
    for name, validator in validators.items():
        one = validator(types, keys).withColumn("check", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found


def unlinkable_types(linking: DataFrame, responses: DataFrame, linkable: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of different event types that share a frame and may not. Frames are first reduced to their distinct types."""
    types = linking.join(responses.select("system_id", "response_id", "event_type").distinct(), ["system_id", "response_id"]).select(*keys, "event_type").distinct()
    a, b = types.withColumnRenamed("event_type", "type_a"), types.withColumnRenamed("event_type", "type_b")
    pairs = a.join(b, keys).filter("type_a < type_b")
    allowed = linkable.select(F.least("type_a", "type_b").alias("type_a"), F.greatest("type_a", "type_b").alias("type_b")).distinct()
    return pairs.join(allowed, ["type_a", "type_b"], "left_anti")


def key_invariants(key: DataFrame, unassessed: DataFrame, coref: DataFrame, confidences: DataFrame) -> DataFrame:
    """(doc_id, item, check): CASes with coreference but no response and the other way round, acceptable CASes without a
    cluster, responses both assessed and unassessed, and confidences outside 0 to 1.

    coref: (doc_id, cas, cas_start, cas_end, coref_id), coref_id null for a CAS outside all clusters.
    """
    cas = ["doc_id", "cas", "cas_start", "cas_end"]
    name = F.concat_ws("@", "cas", F.concat_ws("-", F.col("cas_start").cast("string"), F.col("cas_end").cast("string")))
    told = lambda d, item, check: d.select("doc_id", item.alias("item"), F.lit(check).alias("check")).distinct()
    own, known = key.select(*cas).distinct(), coref.select(*cas).distinct()
    good = key.filter("is_assessed AND cas_ok IN ('C', 'I')")
    parts = [
        told(known.join(own, cas, "left_anti"), name, "coref without response"), told(own.join(known, cas, "left_anti"), name, "response without coref"),
        told(good.join(coref.filter("coref_id IS NOT NULL").select(*cas), cas, "left_anti"), F.col("response_id"), "acceptable CAS without cluster"),
        told(key.filter("is_assessed").join(unassessed.select("response_id"), "response_id", "left_semi"), F.col("response_id"), "assessed and unassessed"),
        told(confidences.filter("confidence IS NULL OR confidence < 0 OR confidence > 1"), F.col("response_id"), "confidence out of range"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def linking_invariants(frames: DataFrame, incomplete: DataFrame, responses: DataFrame) -> DataFrame:
    """(doc_id, item, check): linked or incomplete responses that are no argument of the document, incomplete ones that are
    linked, frame ids with a dash or a tab, and frames with the very members of another."""
    on = ["doc_id", "response_id"]
    own, linked, rest = responses.select(*on).distinct(), frames.select(*on).distinct(), incomplete.select(*on).distinct()
    told = lambda d, item, check: d.select("doc_id", F.col(item).alias("item"), F.lit(check).alias("check")).distinct()
    sets = frames.groupBy("doc_id", "frame_id").agg(F.array_sort(F.collect_set("response_id")).alias("m"))
    twice = sets.groupBy("doc_id", "m").agg(F.min("frame_id").alias("frame_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    out = told(linked.union(rest).distinct().join(own, on, "left_anti"), "response_id", "no argument of the document")
    out = out.unionByName(told(rest.join(linked, on, "left_semi"), "response_id", "incomplete and linked"))
    out = out.unionByName(told(frames.filter(F.col("frame_id").rlike(r"[-\t]")), "frame_id", "frame id with dash or tab"))
    return out.unionByName(told(twice, "frame_id", "several frames of these members"))


def query_invariants(entry_points: DataFrame, responses: DataFrame) -> DataFrame:
    """(item, check): query ids that several hoppers share, and query responses whose system has no name. entry_points:
    (query_id, doc_id, hopper_id); responses: (query_id, doc_id, system_id)."""
    several = entry_points.select("query_id", "doc_id", "hopper_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blank = responses.filter("system_id IS NULL OR trim(system_id) = ''").select(F.concat_ws("/", "query_id", "doc_id").alias("item")).distinct()
    return several.select(F.col("query_id").alias("item"), F.lit("query id of several hoppers").alias("check")).unionByName(blank.withColumn("check", F.lit("system without a name")))


def at_most(found: DataFrame, n: int) -> DataFrame:
    """The first n violations of each check."""
    from pyspark.sql import Window

    return found.withColumn("_n", F.row_number().over(Window.partitionBy("check").orderBy("system_id", "doc_id", "response_id"))).filter(F.col("_n") <= n).drop("_n")
