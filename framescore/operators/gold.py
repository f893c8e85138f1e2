"""The gold side: matching responses with entities and fillers, and document-level arguments and frames.

Gold tables, all per document: mentions (entity_id, mention_ordinal, mtype, ext_*, head_* or null), fillers (filler_id,
filler_ordinal, ext_*, normalized_time or null), arguments of event mentions (hopper_id, ere_type, ere_subtype, ere_role,
realis, arg_realis, entity_id or filler_id, ext_*, trig_*), span heads (start, end, head_*).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescore.functions.scalars import contains, gold_realis, less_specific_times

from .stages import written

#: Order of mention types from weak to strong.
STRENGTH = {"PRO": 0, "NOM": 1, "NAM": 2}
KINDS = ("Pronoun", "Nominal", "Name")
#: Fillers come after all mentions in the order of candidates.
AFTER_MENTIONS = 1 << 30
#: Width in characters of the bins in which containment is looked for; mentions are mostly shorter.
BIN = 256
#: A document-level argument.
ARG = ["doc_id", "event_type", "role", "realis", "coref_id"]


def strength(mtype: Column) -> Column:
    return F.when(mtype == "NAM", 2).when(mtype == "NOM", 1).otherwise(0)


def entity_kind(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), rank + 1)


def best_types(mentions: DataFrame) -> DataFrame:
    """(doc_id, entity_id, rank): the strongest mention type of each entity."""
    return mentions.groupBy("doc_id", "entity_id").agg(F.max(strength(F.col("mtype"))).alias("rank"))


def coref_id(rank: Column, entity: Column) -> Column:
    return F.concat_ws("-", entity_kind(rank), entity)


def with_heads(rows: DataFrame, heads: DataFrame, start: str, end: str, head_start: str = "head_start", head_end: str = "head_end") -> DataFrame:
    """rows with the computed head of a span; a span without a known head is its own."""
    h = heads.select(F.col("doc_id"), F.col("start").alias(start), F.col("end").alias(end), F.col("head_start").alias("_hs"), F.col("head_end").alias("_he"))
    joined = rows.join(h, ["doc_id", start, end], "left")
    return joined.withColumn(head_start, F.coalesce("_hs", start)).withColumn(head_end, F.coalesce("_he", end)).drop("_hs", "_he")


def mapped(rows: DataFrame, ontology: DataFrame, columns: dict[str, str], how: str = "inner") -> DataFrame:
    """rows with further columns <column>_to from the ontology (kind, source, target); columns: column -> kind."""
    for column, kind in columns.items():
        m = ontology.filter(F.col("kind") == kind).select(F.col("source").alias(column), F.col("target").alias(f"{column}_to"))
        rows = rows.join(m, column, how)
    return rows


def mapped_types(rows: DataFrame, ontology: DataFrame, kind: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with column mapped, rows whose value has no mapping). ontology: (kind, source, target), an ontology's size."""
    m = ontology.filter(F.col("kind") == kind).select(F.col("source").alias(column), "target")
    return rows.join(m, column).drop(column).withColumnRenamed("target", column), rows.join(m, column, "left_anti")


ERE_KINDS = {"ere_type": "type", "ere_subtype": "subtype", "ere_role": "role"}


def in_ontology(arguments: DataFrame, ontology: DataFrame) -> DataFrame:
    """Arguments whose type, subtype and role are all in the ontology, with event_type as type.subtype, and role."""
    d = mapped(arguments, ontology, ERE_KINDS)
    return d.withColumns({"event_type": F.concat_ws(".", "ere_type_to", "ere_subtype_to"), "role": F.col("ere_role_to")}).drop(*[f"{c}_to" for c in ERE_KINDS])


def outside_ontology(arguments: DataFrame, ontology: DataFrame) -> DataFrame:
    """(kind, value, n): the types, subtypes and roles that the ontology lacks, and how many arguments have them."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("source")) for c, k in ERE_KINDS.items()])
    return arguments.select(F.inline(pairs)).join(ontology, ["kind", "source"], "left_anti").groupBy("kind", F.col("source").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def candidates(mentions: DataFrame, fillers: DataFrame) -> DataFrame:
    """(doc_id, kind, object_id, ordinal, ext_*, head_*) of all that a response can be matched with: every entity mention,
    with its own mention type as kind, then every filler, whether or not an event has it."""
    m = mentions.select("doc_id", entity_kind(strength(F.col("mtype"))).alias("kind"), F.col("entity_id").alias("object_id"), F.col("mention_ordinal").cast("long").alias("ordinal"), "ext_start", "ext_end", "head_start", "head_end")
    f = fillers.select("doc_id", F.lit("Filler").alias("kind"), F.col("filler_id").alias("object_id"), (F.lit(AFTER_MENTIONS) + F.col("filler_ordinal")).cast("long").alias("ordinal"), "ext_start", "ext_end", F.lit(None).cast("int").alias("head_start"), F.lit(None).cast("int").alias("head_end"))
    return m.unionByName(f)


def roles_played(arguments: DataFrame, ontology: DataFrame) -> DataFrame:
    """(doc_id, is_filler, object_id, event_type, role): what each entity or filler does anywhere in its document."""
    d = in_ontology(arguments, ontology)
    return d.select("doc_id", F.col("filler_id").isNotNull().alias("is_filler"), F.coalesce("filler_id", "entity_id").alias("object_id"), "event_type", "role").distinct()


#: What a response's match depends on; responses of all systems that share it are matched once.
MATCH = ["doc_id", "event_type", "role", "cas_start", "cas_end"]


def match_spans(responses: DataFrame, found: DataFrame, plays: DataFrame, heads: DataFrame, keep: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """(*MATCH, rule, kind, object_id): the best candidate of each distinct MATCH of the responses: the smallest rule that
    fits any, then candidates that play the response's type and role somewhere in the document, then candidate order.

    Rules: the response's CAS equals the candidate's extent (1), its declared head or else its extent (2), the computed
    head of that (3); the computed head of the CAS equals the same three (4, 5, 6); the extent contains the CAS, and
    either the CAS contains both heads or the extent does (7). Rules 1 to 6 are one join on the spans themselves; only
    the responses that they leave are looked for by containment, in bins of the document. keep: writes tables that are read
    twice, `stages.bucketed` by document where the inputs lie so.
    """
    r = with_heads(responses.select(*MATCH).distinct(), heads, "cas_start", "cas_end", "r_head_start", "r_head_end")
    c = found.withColumns({"d_start": F.coalesce("head_start", "ext_start"), "d_end": F.coalesce("head_end", "ext_end")})
    c = keep(with_heads(c.drop("head_start", "head_end"), heads, "d_start", "d_end", "c_start", "c_end"))
    span = lambda n, s, e: F.struct(F.lit(n).alias("n"), F.col(s).alias("start"), F.col(e).alias("end"))
    own = r.select(*MATCH, F.inline(F.array(span(0, "cas_start", "cas_end"), span(3, "r_head_start", "r_head_end")))).withColumnRenamed("n", "of_response")
    other = c.select("doc_id", "kind", "object_id", "ordinal", F.inline(F.array(span(1, "ext_start", "ext_end"), span(2, "d_start", "d_end"), span(3, "c_start", "c_end"))))
    equal = own.join(other, ["doc_id", "start", "end"]).withColumn("rule", F.col("of_response") + F.col("n"))
    names = [*MATCH, "kind", "object_id", "ordinal", "rule"]
    by_span = keep(_first(equal.select(*names), plays, MATCH))  # read twice

    left = r.join(by_span.select(*MATCH), MATCH, "left_anti").withColumn("bin", F.floor(F.col("cas_start") / BIN))
    wide = c.withColumn("bin", F.explode(F.sequence(F.floor(F.col("ext_start") / BIN), F.floor(F.col("ext_end") / BIN))))
    cas, ext, head, computed = ("cas_start", "cas_end"), ("ext_start", "ext_end"), ("d_start", "d_end"), ("r_head_start", "r_head_end")
    inside = lambda a, b: contains(F.col(a[0]), F.col(a[1]), F.col(b[0]), F.col(b[1]))
    held = inside(ext, cas) & ((inside(cas, head) & inside(cas, computed)) | (inside(ext, computed) & inside(ext, head)))
    by_containment = _first(left.join(wide, ["doc_id", "bin"]).filter(held).withColumn("rule", F.lit(7)).select(*names), plays, MATCH)
    return by_span.unionByName(by_containment)


def match_entities(responses: DataFrame, found: DataFrame, plays: DataFrame, heads: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, rule, kind, object_id) of every response that match_spans matches. responses: *keep, *MATCH."""
    own = responses.select(*keep, *[c for c in MATCH if c not in keep])
    return own.join(match_spans(responses, found, plays, heads), MATCH).select(*keep, "rule", "kind", "object_id")


def _first(pairs: DataFrame, plays: DataFrame, keep: list[str]) -> DataFrame:
    p = plays.withColumn("_p", F.lit(1))
    pairs = pairs.withColumn("is_filler", F.col("kind") == "Filler").join(p, ["doc_id", "is_filler", "object_id", "event_type", "role"], "left")
    first = Window.partitionBy(*keep).orderBy("rule", F.col("_p").isNull(), "ordinal", "kind", "object_id")
    return pairs.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*keep, "rule", "kind", "object_id")


def response_coref(responses: DataFrame, matched: DataFrame, keep: list[str]) -> DataFrame:
    """coref_id of every response: Time roles by their string, matched ones by kind and object, the rest failed."""
    d = responses.join(matched.select(*keep, "kind", "object_id"), keep, "left")
    failed = F.concat(F.lit("AlignmentFailure-"), F.col("cas_start").cast("string"), F.lit("-"), F.col("cas_end").cast("string"))
    cid = F.when(F.col("role") == "Time", F.concat(F.lit("Time-"), "cas")).when(F.col("object_id").isNotNull(), F.concat_ws("-", "kind", "object_id")).otherwise(failed)
    return d.withColumn("coref_id", cid)


def object_of(coref: Column) -> Column:
    """struct(kind, object_id) that a coref id stands for; null for failed alignments, and the time itself for Time."""
    kind = F.substring_index(coref, "-", 1)
    return F.when(kind != "AlignmentFailure", F.struct(kind.alias("kind"), F.regexp_extract(coref, "^[^-]*-(.*)$", 1).alias("object_id")))


def gold_arguments(arguments: DataFrame, mentions: DataFrame, fillers: DataFrame, ontology: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, hopper_id, event_type, role, realis, coref_id) of the gold arguments in the ontology whose extent and whose
    event's trigger begin and end outside quoted regions (doc_id, start, end).

    An entity is named by its best mention type, a filler of a time role by its normalised time, any other by its id.
    """
    region = quotes.select(F.col("doc_id"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    ends = [F.col(x).between(F.col("_s"), F.col("_e")) for x in ("ext_start", "ext_end", "trig_start", "trig_end")]
    d = arguments.join(region, (arguments["doc_id"] == region["doc_id"]) & (ends[0] | ends[1] | ends[2] | ends[3]), "left_anti")
    d = in_ontology(d, ontology)
    d = d.join(best_types(mentions), ["doc_id", "entity_id"], "left").join(fillers.select("doc_id", "filler_id", "normalized_time"), ["doc_id", "filler_id"], "left")
    filler = F.when(F.col("ere_role") == "time", F.concat(F.lit("Time-"), "normalized_time")).otherwise(F.concat(F.lit("Filler-"), "filler_id"))
    cid = F.when(F.col("filler_id").isNotNull(), filler).otherwise(coref_id(F.col("rank"), F.col("entity_id")))
    # an entity without mentions, and a time role whose filler is no time, are faults of the annotation
    known = F.when(F.col("filler_id").isNull(), F.col("rank").isNotNull()).otherwise((F.col("ere_role") != "time") | F.col("normalized_time").isNotNull())
    return d.filter(known).select("doc_id", "hopper_id", "event_type", "role", gold_realis(F.col("realis"), F.col("arg_realis")).alias("realis"), cid.alias("coref_id")).distinct()


def in_scope(rows: DataFrame, types: DataFrame, banned_roles: list[str]) -> DataFrame:
    return rows.join(types, "event_type", "left_semi").filter(~F.col("role").isin(*banned_roles))


def without_implied_injuries(rows: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Arguments of Life.Injure go where gold has the same one of Life.Die."""
    ban = gold.filter("event_type = 'Life.Die'").withColumn("event_type", F.lit("Life.Injure")).select(*keys).distinct()
    return rows.join(ban, keys, "left_anti")


def vague_times(gold: DataFrame, system: DataFrame) -> DataFrame:
    """(system_id, doc_id, event_type, role, realis, coref_id) of the less specific forms of gold times, for the event types
    that have times on both sides of a system's document."""
    time = F.col("role") == "Time"
    both = gold.filter(time).select("doc_id", "event_type").distinct().join(system.filter(time).select("system_id", "doc_id", "event_type").distinct(), ["doc_id", "event_type"])
    forms = F.transform(less_specific_times(F.regexp_extract("coref_id", "^Time-(.+)$", 1)), lambda x: F.concat(F.lit("Time-"), x))
    vague = gold.filter(time).select("doc_id", "event_type", "role", "realis", F.explode(forms).alias("coref_id")).distinct()
    return vague.join(both, ["doc_id", "event_type"]).select("system_id", *ARG)


def neutralised(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("realis", F.lit("neutralized")).select(*keys).distinct()


def linkable(gold_frames: DataFrame, system_frames: DataFrame, neutral: bool = False) -> tuple[DataFrame, DataFrame]:
    """Frames (system_id, doc_id, frame_id, item) for link scores: arguments of realis Other or Actual, without their realis
    if neutral, and of the system's only those that a gold frame has."""
    parts = ["event_type", "role", *([] if neutral else ["realis"]), "coref_id"]

    def framed(d: DataFrame) -> DataFrame:
        return d.filter(F.col("realis").isin("Other", "Actual")).select("system_id", "doc_id", "frame_id", F.concat_ws("|", *parts).alias("item"), "event_type").distinct()

    gold = framed(gold_frames)
    return gold, framed(system_frames).join(gold.select("system_id", "doc_id", "item").distinct(), ["system_id", "doc_id", "item"], "left_semi")


def document_counts(gold: DataFrame, system: DataFrame, vague: DataFrame, systems: DataFrame) -> DataFrame:
    """(mode, system_id, doc_id, tp, fp, fn) of document-level arguments with realis and without, in one pass.

    gold: ARG of every document, once for all systems; system: (system_id, ARG); vague: (system_id, ARG) that count on
    neither side, all of role Time. Each side is reduced to one row for an argument with the set of its realises, which
    serves both modes. Only gold's times differ between systems and are paired with them; of the rest, what a system
    missed is the number of gold's arguments less those that it found.
    """
    item = ["doc_id", "event_type", "role", "coref_id"]
    own, time = ["system_id", *item], F.col("role") == "Time"
    realises = lambda d, by, name: d.groupBy(*by).agg(F.collect_set("realis").alias(name))
    found = realises(system.join(vague, [*own, "realis"], "left_anti"), own, "_s")
    alike = realises(gold.filter(~time), item, "_g")
    times = gold.filter(time).select(*ARG).distinct().crossJoin(F.broadcast(systems)).join(vague, [*own, "realis"], "left_anti")
    times = realises(times, own, "_g")
    met = found.filter(~time).join(alike, item, "left").unionByName(found.filter(time).join(times, own, "left"))
    hits = F.coalesce(F.size(F.array_intersect("_s", "_g")), F.lit(0))
    total = lambda c: F.sum(c).cast("long")
    by = ["system_id", "doc_id"]
    predicted = met.groupBy(*by).agg(total(hits).alias("tw"), total(F.size("_s")).alias("sw"), total(F.col("_g").isNotNull().cast("int")).alias("tn"), F.count(F.lit(1)).alias("sn"))
    sizes = lambda a, b: [total(F.size("_g")).alias(a), F.count(F.lit(1)).alias(b)]
    wanted = alike.groupBy("doc_id").agg(*sizes("gw", "gn")).crossJoin(F.broadcast(systems)).join(times.groupBy(*by).agg(*sizes("hw", "hn")), by, "full")
    both = wanted.join(predicted, by, "full").na.fill(0)
    cells = lambda mode, g, h, s, t: F.struct(F.lit(mode).alias("mode"), F.col(t).alias("tp"), (F.col(s) - F.col(t)).alias("fp"), (F.col(g) + F.col(h) - F.col(t)).alias("fn"))
    modes = F.array(cells("withRealis", "gw", "hw", "sw", "tw"), cells("noRealis", "gn", "hn", "sn", "tn"))
    return both.select(*by, F.inline(modes)).filter("tp + fp + fn > 0").select("mode", *by, "tp", "fp", "fn")
