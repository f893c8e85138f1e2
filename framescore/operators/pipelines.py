"""Composite operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import align, cells
from .filters import acceptable
from .invariants import enforced
from .linking import keep_best, lift, link_f1
from .stages import written
from .transforms import implied_injuries, less_specific


def preprocessed(rows: DataFrame, key: DataFrame, keys: list[str]) -> DataFrame:
    """rows without injuries that a correct death implies and without times that a more specific one covers. rows and
    key hold the class columns; the rules come from the key and apply to key and output alike."""
    rows = rows.join(implied_injuries(key, keys), keys, "left_anti")
    return rows.join(less_specific(key), ["doc_id", "event_type", "role", "realis", "cas"], "left_anti")


def project_linking(frames: DataFrame, classes: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, incomplete) of a linking of classes carried to another key's responses.

    frames: (doc_id, frame_id, item); classes: the other key's (doc_id, response_id, item); other: its linkable items.
    Frames without a response there vanish; linkable items in no frame are incomplete.
    """
    there = frames.join(classes, ["doc_id", "item"]).select("doc_id", "frame_id", "response_id").distinct()
    linked = frames.join(classes.select("doc_id", "item").distinct(), ["doc_id", "item"], "left_semi")
    return there, other.join(linked, ["doc_id", "item"], "left_anti")


def neutralise_coref_errors(responses: DataFrame, key: DataFrame, correct: DataFrame, ids: list[str] = ("response_id",)) -> tuple[DataFrame, DataFrame]:
    """(mapping, deleted) for responses whose filler is right and whose CAS is wrong: to the first correct response of the
    same type, role and filler, else of the same type and role, else deleted. ids: what names a response, with doc_id where
    tables lie by document; both tables have these columns."""
    wrong = key.filter(acceptable("bf_ok") & (F.col("cas_ok") == "W")).select(*ids)
    d = responses.join(wrong, [*ids], "left_semi").select("response_id", "doc_id", "event_type", "role", "bf_start", "bf_end").distinct()
    near, far = ["doc_id", "event_type", "role", "bf_start", "bf_end"], ["doc_id", "event_type", "role"]
    first = correct.groupBy(*near).agg(F.min("response_id").alias("_a"))
    second = correct.groupBy(*far).agg(F.min("response_id").alias("_b"))
    found = d.join(first, near, "left").join(second, far, "left").select(*ids, F.coalesce("_a", "_b").alias("new_id"))
    return found.filter("new_id IS NOT NULL"), found.filter("new_id IS NULL").select(*ids)


def difference_context(spans: DataFrame, texts: DataFrame, width: int = 100) -> DataFrame:
    """(response_id, context): a response's spans widened and united, their texts joined by a mark.

    spans: (response_id, doc_id, start, end), a handful a response; texts: (doc_id, text).
    """
    w = Window.partitionBy("response_id", "doc_id").orderBy("a", "b")
    d = spans.select("response_id", "doc_id", F.greatest(F.col("start") - width, F.lit(0)).alias("a"), (F.col("end") + width).alias("b"))
    d = d.withColumn("reach", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("island", F.sum((F.col("reach").isNull() | (F.col("a") > F.col("reach"))).cast("int")).over(w))
    d = d.groupBy("response_id", "doc_id", "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).join(texts, "doc_id")
    d = d.withColumn("part", F.substring("text", F.col("a") + 1, F.col("b") - F.col("a") + 1))
    return d.groupBy("response_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("island", "part"))), lambda x: x["part"]), "[.....]").alias("context"))


def representative_documents(docs: DataFrame, per_genre: int = 25) -> DataFrame:
    """(genre, doc_id, place): greedy cover of the event types and annotators of each genre by documents whose size is
    nearest the genre's median, then filled up by nearness.

    A document joins the cover exactly if it is the nearest to hold one of its features, so the cover is a minimum for
    each feature, and no genre is gathered in one task.

    docs: (genre, doc_id, size, features array<string>).
    """
    middle = docs.groupBy(F.col("genre").alias("_g")).agg(F.median("size").alias("_m"))
    d = docs.join(middle, F.col("genre").eqNullSafe(F.col("_g"))).withColumn("off", F.abs(F.col("size") - F.col("_m")))
    cover = d.select("genre", "off", "doc_id", F.explode("features").alias("feature")).groupBy("genre", "feature").agg(F.min(F.struct("off", "doc_id")).alias("x"))
    near = F.row_number().over(Window.partitionBy("genre").orderBy("off", "doc_id"))
    rest = d.select("genre", "off", "doc_id", near.alias("n")).filter(F.col("n") <= per_genre)
    both = cover.select("genre", "x.off", "x.doc_id", F.lit(0).alias("turn")).unionByName(rest.drop("n").withColumn("turn", F.lit(1)))
    both = both.groupBy("genre", "off", "doc_id").agg(F.min("turn").alias("turn"))
    n = F.row_number().over(Window.partitionBy("genre").orderBy("turn", "off", "doc_id"))
    return both.withColumn("n", n).filter(F.col("n") <= per_genre).select("genre", "doc_id", (F.col("n") - 1).cast("long").alias("place"))


def corpus_score(found: DataFrame, correct: int, drop_unassessed: bool = True, skip_unanswered: bool = False, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(counts by system and query, rows without an assessment). The second must be empty unless they are dropped: strict,
    reading the counts fails where it is not."""
    from .corpus import query_counts

    counts = query_counts(found, correct)
    if skip_unanswered:
        counts = counts.join(found.filter(F.col("a") == correct).select("query_id").distinct(), "query_id", "left_semi")
    open_ = found.filter("a = 0").limit(0) if drop_unassessed else found.filter("a = 0")
    return enforced(counts, open_, "every query response is assessed", strict and not drop_unassessed), open_


def score_2015(responses: DataFrame, assessed: DataFrame, linking: DataFrame, gold: DataFrame, classes: DataFrame, keys: list[str], incomplete: DataFrame | None = None, beta: float = 0.25, weight: float = 0.5, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(system_id, arg, link, overall) in the style of 2015.

    responses and assessed hold the class columns `keys`; assessed has `right`, whether a row is correct. linking: the
    systems' frames of responses; gold: (doc_id, frame_id, item), frames of classes; classes: (response_id, item) of correct
    responses. Each system keeps the best response of each frame and class, and its frames are restricted to gold's
    items. incomplete: responses that either side leaves out of its linking, which must be empty: reading the scores
    fails where it is not. keep: `stages.bucketed` by document where all inputs lie so, and classes have doc_id; then
    nothing but counts is shuffled.
    """
    ids = ["doc_id", "response_id"] if keep else ["response_id"]
    own = ["system_id", *ids]
    kept = (keep or written)(keep_best(responses, linking, keys)).select(*own)
    counts = cells(align(responses.join(kept, own, "left_semi"), assessed, F.col("right"), keys, ids), ["system_id", "doc_id"])
    gained = F.sum(F.greatest(F.col("tp") - beta * F.col("fp"), F.lit(0.0)))
    arg = counts.groupBy("system_id").agg((gained / F.sum(F.col("tp") + F.col("fn"))).alias("arg"))
    frames = lift(linking.join(kept, own, "left_semi"), classes, ["system_id", "doc_id", "frame_id"])
    predicted = (keep or written)(frames.join(gold.select("doc_id", "item").distinct(), ["doc_id", "item"], "left_semi"))
    links = link_f1(gold, predicted, responses.select("system_id").distinct(), lies=keep is not None)
    link = links.groupBy("system_id").agg((F.sum(F.col("link_f1") * F.col("n_gold")) / F.sum("n_gold")).alias("link"))
    overall = arg.join(link, "system_id").select("system_id", "arg", "link", ((1 - weight) * F.col("arg") + weight * F.col("link")).alias("overall"))
    return overall if incomplete is None else enforced(overall, incomplete, "linkings are complete")


def kb_violations(assertions: DataFrame) -> DataFrame:
    """(subject, check): nodes with several types, nodes without a type or a mention, confidences outside (0, 1]."""
    is_ = lambda kind: F.coalesce(F.col("kind") == kind, F.lit(False))
    bad = F.coalesce((F.col("confidence") <= 0) | (F.col("confidence") > 1), F.lit(False))
    told = F.struct("subject", F.when(is_("type"), F.col("object")).alias("type"), is_("type").alias("typed"), is_("mention").alias("mentioned"), bad.alias("bad"))
    false = F.lit(False)
    named = F.when(F.col("object").startswith(":"), F.struct(F.col("object").alias("subject"), F.lit(None).cast("string").alias("type"), false.alias("typed"), false.alias("mentioned"), false.alias("bad")))
    # one pass over the assertions: each tells something of its subject, and names its object
    nodes = assertions.select(F.inline(F.array_compact(F.array(told, named)))).groupBy("subject")
    nodes = nodes.agg(F.min("type").alias("a"), F.max("type").alias("b"), *[F.max(c).alias(c) for c in ("typed", "mentioned", "bad")])
    nameless = F.col("subject").isNull()
    checks = {"several types": F.col("a") != F.col("b"), "no type": ~F.col("typed") | nameless, "no mention": ~F.col("mentioned") | nameless, "confidence out of range": F.col("bad")}
    found = F.array_compact(F.array(*[F.when(c, name) for name, c in checks.items()]))
    return nodes.select("subject", F.explode(found).alias("check"))
