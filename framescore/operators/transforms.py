"""Row- and group-level rewritings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framescore.functions.scalars import is_temporal, is_timex, less_specific_times

from .coref import registered
from .filters import acceptable, correct_up_to_inexact


def map_outputs(responses: DataFrame, mapping: DataFrame, deleted: DataFrame, keys: list[str]) -> DataFrame:
    """Responses renamed by mapping (response_id, new_id), minus deleted ones; equals keep the higher confidence, with its
    metadata where there is such a column; of equal confidences that of the smaller old id."""
    left = responses.join(deleted.select("response_id"), "response_id", "left_anti").join(mapping, "response_id", "left")
    named = left.withColumn("_old", F.col("response_id")).withColumn("response_id", F.coalesce("new_id", "response_id"))
    told = [F.max_by("metadata", F.struct("confidence", "_place")).alias("metadata")] if "metadata" in responses.columns else []
    if told:
        place = F.row_number().over(Window.partitionBy(*keys, "response_id").orderBy(F.desc("_old")))
        named = named.withColumn("_place", place)
    return named.groupBy(*keys, "response_id").agg(F.max("confidence").alias("confidence"), *told)


def map_linking(linking: DataFrame, incomplete: DataFrame, mapping: DataFrame, deleted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Frames and incompletes under a mapping: empty frames vanish, equal ones merge under the smallest id, incompletes
    that are now linked go."""
    from .linking import same_sets

    def renamed(d: DataFrame) -> DataFrame:
        d = d.join(deleted.select("response_id"), "response_id", "left_anti").join(mapping, "response_id", "left")
        return d.withColumn("response_id", F.coalesce("new_id", "response_id")).drop("new_id")

    frames = same_sets(renamed(linking), keys, "frame_id", "response_id")
    rest = renamed(incomplete).select(*keys, "response_id").distinct()
    return frames, rest.join(frames, [*keys, "response_id"], "left_anti")


def map_key(key: DataFrame, mapping: DataFrame, deleted: DataFrame) -> DataFrame:
    """Assessments under a mapping. Of rows that meet, a replaced assessed one comes first, then an assessed one."""
    d = key.join(deleted.select("response_id"), "response_id", "left_anti").join(mapping, "response_id", "left")
    d = d.withColumn("_rank", F.when(F.col("is_assessed") & F.col("new_id").isNotNull(), 0).when(F.col("is_assessed"), 1).otherwise(2))
    d = d.withColumn("_old", F.col("response_id")).withColumn("response_id", F.coalesce("new_id", "response_id"))
    first = Window.partitionBy("response_id").orderBy("_rank", "_old")
    return d.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_rank", "_old", "new_id")


def map_store(key: DataFrame, coref: DataFrame, mapping: DataFrame, deleted: DataFrame, replacements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, coref) under a mapping (response_id, new_id): rows take the content of their replacement, map_key decides
    between rows that meet, and a CAS that is new to the store gets a cluster of its own where its row is assessed.

    replacements: (response_id, doc_id, cas, cas_start, cas_end, and what else rows hold of a response) of each new_id.
    """
    mapped = map_key(key, mapping, deleted)
    content = [c for c in replacements.columns if c != "response_id"]
    there = replacements.select("response_id", *[F.col(c).alias(f"_r_{c}") for c in content], F.lit(True).alias("_r"))
    d = mapped.join(there, "response_id", "left")
    moved = d.select(*[F.when(F.col("_r"), F.col(f"_r_{c}")).otherwise(F.col(c)).alias(c) if c in content else F.col(c) for c in mapped.columns])
    return moved, registered(coref, moved)


def fix_lowercase_masks(rows: DataFrame) -> DataFrame:
    """Temporal CASes with lower-case masks get capital ones."""
    fixed = F.regexp_replace("cas", "x", "X")
    return rows.withColumn("cas", F.when(is_temporal(F.col("role")) & F.col("cas").contains("x"), fixed).otherwise(F.col("cas")))


def broken_times_wrong(key: DataFrame) -> DataFrame:
    """Acceptable temporal CASes that are no valid time become wrong."""
    broken = is_temporal(F.col("role")) & acceptable("cas_ok") & ~is_timex(F.col("cas"))
    return key.withColumn("cas_ok", F.when(broken, "W").otherwise(F.col("cas_ok")))


def implied_injuries(key: DataFrame, keys: list[str]) -> DataFrame:
    """Classes (keys) of Life.Injure that a correct Life.Die of the same filler bans. key holds the keys."""
    died = key.filter(correct_up_to_inexact() & (F.col("event_type") == "Life.Die"))
    return died.withColumn("event_type", F.lit("Life.Injure")).select(*keys).distinct()


def less_specific(key: DataFrame) -> DataFrame:
    """(doc_id, event_type, role, realis, cas): times banned by a more specific acceptable one."""
    times = key.filter(is_temporal(F.col("role")) & acceptable("cas_ok") & is_timex(F.col("cas")))
    return times.select("doc_id", "event_type", "role", "realis", F.explode(less_specific_times(F.col("cas"))).alias("cas")).distinct()


def expand_from_realis(key: DataFrame, keys: list[str]) -> DataFrame:
    """The key with a copy of each assessed row under its assessed realis, unless that row is there."""
    copies = key.filter("is_assessed AND a_realis IS NOT NULL AND a_realis <> realis").withColumn("realis", F.col("a_realis"))
    first = Window.partitionBy(*keys).orderBy("aet", "aer", "cas_ok", "bf_ok", "response_id")
    copies = copies.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return key.unionByName(copies.join(key.select(*keys), keys, "left_anti"))


def transport_variants(key: DataFrame) -> DataFrame:
    """(doc_id, event_type, role, cas, cas_start, cas_end, realis) of the two newer types of Movement.Transport."""
    rows = key.filter((F.col("event_type") == "Movement.Transport") & (F.col("role") != "Price") & (~F.col("is_assessed") | correct_up_to_inexact()))
    variant = lambda kind: F.struct(
        F.lit(f"Movement.Transport-{kind}").alias("event_type"),
        F.when((F.col("role") == "Artifact") & F.lit(kind == "Person"), "Person").when(F.col("role") == "Vehicle", "Instrument").otherwise(F.col("role")).alias("role"),
    )
    both = rows.select("doc_id", "cas", "cas_start", "cas_end", "realis", F.inline(F.array(variant("Person"), variant("Artifact"))))
    return both.distinct()


def quote_regions(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, closed): outermost quoted regions, tags included, ends inclusive; a closing tag without an
    open quote is ignored, closed is false for a quote that never ends.

    Tags are the marks of one document, whose rows are few; depth is a running sum kept from going below zero.
    """
    parts = docs.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(text, "(?=<quote>|<quote |</quote>)")).alias("n", "part"))
    upto = Window.partitionBy("doc_id").orderBy("n")
    step = F.when(F.col("part").rlike("^<quote[ >]"), 1).when(F.col("part").startswith("</quote>"), -1).otherwise(0)
    d = parts.select("doc_id", "n", step.alias("step"), F.char_length("part").alias("len"), F.when(step == -1, 8).otherwise(0).alias("tag"))
    d = d.withColumn("at", F.sum("len").over(upto) - F.col("len")).withColumn("run", F.sum("step").over(upto))
    d = d.withColumn("depth", F.col("run") - F.least(F.lit(0), F.min("run").over(upto)))
    d = d.withColumn("before", F.coalesce(F.lag("depth").over(upto), F.lit(0)))
    edges = d.filter("(before = 0 AND depth = 1) OR (before = 1 AND depth = 0)")
    edges = edges.withColumn("close", F.lead(F.col("at") + F.col("tag") - 1).over(upto))
    return edges.filter("depth = 1").select("doc_id", F.col("at").cast("int").alias("start"), F.col("close").cast("int").alias("end"), F.col("close").isNotNull().alias("closed"))


def in_quotes(responses: DataFrame, regions: DataFrame, keep: bool = False) -> DataFrame:
    """Responses without (keep=True: with) an end of base filler or CAS inside a quoted region of their document."""
    r = regions.select(F.col("doc_id").alias("_doc"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    inside = lambda c: F.col(c).between(F.col("_s"), F.col("_e"))
    hit = inside("bf_start") | inside("bf_end") | inside("cas_start") | inside("cas_end")
    return responses.join(r, (responses["doc_id"] == F.col("_doc")) & hit, "left_semi" if keep else "left_anti")
