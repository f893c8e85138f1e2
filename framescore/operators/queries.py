"""Corpus queries: from entry points to matching documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gold import strength


def query_mentions(entry_points: DataFrame, mentions: DataFrame, best_only: bool = True) -> DataFrame:
    """Mentions of the entry points' entities; best_only keeps names, else nominals, else pronouns of each."""
    d = entry_points.join(mentions, ["doc_id", "entity_id"]).withColumn("rank", strength(F.col("mtype")))
    if not best_only:
        return d
    best = F.max("rank").over(Window.partitionBy("query_id", "doc_id", "hopper_id", "role", "entity_id"))
    return d.withColumn("_b", best).filter("rank = _b").drop("_b")


def _inside(inner: tuple, outer: tuple) -> Column:
    return (outer[0] <= inner[0]) & (inner[1] <= outer[1])


def exact(cas: tuple, mention: tuple, head: tuple) -> Column:
    return (cas[0] == mention[0]) & (cas[1] == mention[1])


def name_contains(cas: tuple, mention: tuple, head: tuple) -> Column:
    """The query mention is a name that contains the response's CAS."""
    return (F.col("mtype") == "NAM") & _inside(cas, mention)


def name_contained(cas: tuple, mention: tuple, head: tuple) -> Column:
    """The query mention is a name that the response's CAS contains."""
    return (F.col("mtype") == "NAM") & _inside(mention, cas)


def nominals_overlap(min_fraction: float = 0.3) -> Callable:
    """The query mention is a nominal, one of it and the CAS contains the other, and the smaller is min_fraction of the
    bigger or more. A CAS within the mention must hold the mention's head, if that is known."""

    def criterion(cas: tuple, mention: tuple, head: tuple) -> Column:
        n, m = cas[1] - cas[0] + 1, mention[1] - mention[0] + 1
        within = _inside(cas, mention) & (head[0].isNull() | _inside(head, cas)) & (n >= min_fraction * m)
        around = _inside(mention, cas) & (m >= min_fraction * n)
        return (F.col("mtype") == "NOM") & (within | around)

    return criterion


#: The usual relaxations, strictest first; each is a function of (start, end) of the CAS, the mention, and its head.
CRITERIA = (exact, name_contains, name_contained, nominals_overlap())


def cas_rule(criteria: Sequence[Callable] = CRITERIA) -> Column:
    """Number, from 1, of the first criterion by which a response's CAS fits a query mention; null if none."""
    spans = [(F.col(f"{x}_start"), F.col(f"{x}_end")) for x in ("cas", "ext", "head")]
    return F.coalesce(*[F.when(c(*spans), n) for n, c in enumerate(criteria, 1)])


def pj_matches(triggers: str = "triggers", slack: int = 300, within_trigger: bool = False) -> Column:
    """Whether a justification, widened by slack, holds a trigger of the hopper; with within_trigger, whether a trigger
    holds a justification, without slack."""
    if within_trigger:
        return F.exists("pj", lambda p: F.exists(triggers, lambda t: (t["start"] <= p["start"]) & (p["end"] <= t["end"])))
    return F.exists("pj", lambda p: F.exists(triggers, lambda t: (F.greatest(p["start"] - slack, F.lit(0)) <= t["start"]) & (t["end"] <= p["end"] + slack)))


def matching_responses(entry_points: DataFrame, mentions: DataFrame, responses: DataFrame, hoppers: DataFrame, slack: int = 300, first_entry_point_only: bool = False, within_trigger: bool = False, criteria: Sequence[Callable] = CRITERIA) -> DataFrame:
    """(query_id, system_id, response_id, doc_id): responses that match an entry point by type and role, by the strictest
    CAS relaxation that hits anything for it, and by justification.

    entry_points: query_id, ep_ordinal, doc_id, hopper_id, role, entity_id; hoppers: doc_id, hopper_id, event_type,
    triggers. With first_entry_point_only a query's later entry points count only if the earlier ones found nothing.
    """
    points = query_mentions(entry_points, mentions).join(hoppers, ["doc_id", "hopper_id"])
    pairs = points.join(responses.select("system_id", "doc_id", "event_type", "role", "response_id", "cas_start", "cas_end", "pj"), ["doc_id", "event_type", "role"])
    pairs = pairs.withColumn("rule", cas_rule(criteria)).filter("rule IS NOT NULL").filter(pj_matches(slack=slack, within_trigger=within_trigger))
    by = ["query_id", "ep_ordinal"] if not first_entry_point_only else ["query_id"]
    order = [F.col("ep_ordinal"), F.col("rule")] if first_entry_point_only else [F.col("rule")]
    first = F.rank().over(Window.partitionBy("system_id", *by).orderBy(*order))
    return pairs.withColumn("_n", first).filter("_n = 1").select("query_id", "system_id", "doc_id", "response_id").distinct()


def execute(matches: DataFrame, linking: DataFrame, corpus_linking: DataFrame) -> DataFrame:
    """(query_id, system_id, doc_id, frame_id): frames of matching responses and all that share a corpus frame with them."""
    own = matches.join(linking, ["system_id", "doc_id", "response_id"]).select("query_id", "system_id", "doc_id", "frame_id").distinct()
    corpus = own.join(corpus_linking, ["system_id", "doc_id", "frame_id"]).select("query_id", "system_id", "corpus_frame_id").distinct()
    wider = corpus.join(corpus_linking, ["system_id", "corpus_frame_id"]).select("query_id", "system_id", "doc_id", "frame_id")
    return own.unionByName(wider).distinct()


def capped(frames: DataFrame, documents: int, seed: int = 0) -> DataFrame:
    """A seeded sample of at most so many documents of each system and query; all frames of a kept one stay."""
    docs = frames.select("system_id", "query_id", "doc_id").distinct()
    order = Window.partitionBy("system_id", "query_id").orderBy(F.md5(F.concat(F.lit(f"{seed}|"), "doc_id")))
    kept = docs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= documents).drop("_n")
    return frames.join(kept, ["system_id", "query_id", "doc_id"], "left_semi")


def collapsed(frames: DataFrame, linking: DataFrame, responses: DataFrame) -> DataFrame:
    """(system_id, query_id, doc_id, pj): union of the justifications of the matched frames' responses."""
    d = frames.join(linking, ["system_id", "doc_id", "frame_id"]).join(responses.select("system_id", "response_id", "pj"), ["system_id", "response_id"])
    d = d.select("system_id", "query_id", "doc_id", F.explode("pj").alias("p"))
    return d.groupBy("system_id", "query_id", "doc_id").agg(F.array_sort(F.collect_set("p")).alias("pj"))


def extracted(matches: DataFrame, linking: DataFrame, corpus_linking: DataFrame, responses: DataFrame, documents: int, seed: int = 0) -> DataFrame:
    """(system_id, query_id, doc_id, pj, assessment): query responses for assessment: the frames of matching responses and
    of their corpus frames, a seeded sample of so many documents of each system and query, one response a document with
    all its frames' justifications, none assessed yet."""
    frames = capped(execute(matches, linking, corpus_linking), documents, seed)
    return collapsed(frames, linking, responses).withColumn("assessment", F.lit("UNASSESSED"))


#: Roles and event types of derived entry points.
ENTRY_ROLES = ("Agent", "Artifact", "Attacker", "Audience", "Beneficiary", "Crime", "Destination", "Entity", "Giver", "Instrument", "Money", "Origin", "Person", "Place", "Recipient", "Target", "Thing", "Time", "Victim")
BANNED_EVENTS = ("Transaction.Transaction", "Contact.Contact", "Contact.Broadcast")


def derived_entry_points(found: DataFrame, common: int = 140, single: int = 45, seed: int = 0) -> DataFrame:
    """(query_id, doc_id, hopper_id, role, entity_id): queries from seeded draws of the hoppers that every system found,
    and, for each system, of those that it but not every system found; with all entry points that any system found.

    found: (system_id, doc_id, hopper_id, event_type, role, entity_id) of responses aligned to entities. A hopper counts
    once for each of its event types; systems without any entry point do not count.
    """
    key = ["doc_id", "hopper_id", "event_type"]
    found = found.filter(F.col("role").isin(*ENTRY_ROLES) & ~F.col("event_type").isin(*BANNED_EVENTS))
    by_system = found.select("system_id", *key).distinct().withColumn("_k", F.md5(F.concat_ws("|", F.lit(str(seed)), *key)))
    n = by_system.agg(F.count_distinct("system_id").alias("_all"))
    all_ = by_system.groupBy(*key, "_k").agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(n), F.col("_n") == F.col("_all"))
    drawn = all_.orderBy("_k", *key).limit(common)
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("_k", *key))
    drawn = drawn.select(F.format_string("COMMON_%04d", place() - 1).alias("query_id"), *key)
    some = by_system.join(all_, key, "left_anti").withColumn("_p", place("system_id")).filter(F.col("_p") <= single)
    some = some.select(F.concat(F.lit("SINGLE_SYS_"), "system_id", F.format_string("_%04d", F.col("_p") - 1)).alias("query_id"), *key)
    return drawn.unionByName(some).join(found.select(*key, "role", "entity_id").distinct(), key).select("query_id", "doc_id", "hopper_id", "role", "entity_id").distinct()
