"""Look-ups over knowledge-base assertions, as `scans.kb_assertions` returns them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescore.sources import scans


def node_types(assertions: DataFrame) -> DataFrame:
    """(node, type) of typed nodes."""
    return assertions.filter("kind = 'type'").select(F.col("subject").alias("node"), F.col("object").alias("type")).distinct()


def _mentions(assertions: DataFrame) -> DataFrame:
    """(node, doc_id, mention, mention_kind): a row for each document that a mention is justified by. Documents come from the
    mention's own row: a line's number need not be the same when the lines are read again."""
    kind = scans.kb_mention_kind(F.col("predicate"), F.col("subject"), F.col("realis"))
    m = assertions.filter("kind = 'mention' AND provenance IS NOT NULL AND provenance <> 'NIL'").withColumn("mention_kind", kind)
    docs = F.array_distinct(F.transform(F.split("provenance", "[;,]"), lambda p: F.regexp_extract(p, "^(.*):", 1)))
    return m.select(F.col("subject").alias("node"), F.explode(docs).alias("doc_id"), "mention", "mention_kind")


def canonical_mentions(assertions: DataFrame) -> DataFrame:
    """(doc_id, node, mention): the canonical mentions of each document."""
    return _mentions(assertions).filter("mention_kind LIKE '%canonical%'").select("doc_id", "node", "mention").distinct()


def mentions_of_nodes(assertions: DataFrame) -> DataFrame:
    """(node, doc_id, mention_kind, mention): every mention of each node."""
    return _mentions(assertions).filter("mention_kind IS NOT NULL").select("node", "doc_id", "mention_kind", "mention").distinct()


MOST_JUSTIFICATIONS = 3
#: Kinds of assertions with an object that may be a string, and how many groups of provenance they have without its own.
GROUPS = {"event argument": (2, 3), "relation": (1, 1), "slot filler": (1, 1)}


def violations(assertions: DataFrame) -> DataFrame:
    """(subject, check): what breaks the rules of a knowledge base. Rules of a single assertion are an array of its faults,
    all worked out in one pass; those of nodes are one aggregation over the nodes' assertions.

    Of an assertion: unknown shape; confidence out of range; empty mention; argument neither entity nor string; string
    argument without filler string, or a filler string without string argument; not 1 to 3 predicate justifications;
    several documents; span ends before it starts. Of a node: several types; no type; no mention.
    """
    c = F.col
    parts = F.filter(F.split(F.coalesce("provenance", F.lit("")), ";"), lambda g: g != "")
    string, n = c("object").startswith(":String"), F.size(parts)
    fewest, most, pj_at = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0)
    for kind, (a, b) in GROUPS.items():
        here = c("kind") == kind
        fewest, most = F.when(here, a).otherwise(fewest), F.when(here, b).otherwise(most)
        pj_at = F.when(here, F.lit(int(kind == "event argument"))).otherwise(pj_at)
    grouped = fewest.isNotNull()
    pjs = F.size(F.split(F.get(parts, pj_at + string.cast("int")), ","))
    spans = F.filter(F.flatten(F.transform(parts, lambda g: F.split(g, ","))), lambda x: x != "NIL")
    docs = F.array_distinct(F.transform(spans, lambda x: F.regexp_extract(x, "^(.*):[0-9]+-[0-9]+$", 1)))
    reversed_ = F.exists(spans, lambda x: F.regexp_extract(x, ":([0-9]+)-[0-9]+$", 1).try_cast("int") > F.regexp_extract(x, "-([0-9]+)$", 1).try_cast("int"))
    rules = {
        "unknown shape": c("kind").isNull(),
        "confidence out of range": (c("confidence") <= 0) | (c("confidence") > 1),
        "empty mention": (c("kind") == "mention") & (c("mention") == ""),
        "argument neither entity nor string": (c("kind") == "event argument") & ~(string | c("object").startswith(":Entity")),
        "string argument without filler string": grouped & string & (n < fewest + 1),
        "filler string without string argument": grouped & ~string & (n > most),
        "not 1 to 3 predicate justifications": grouped & ~F.coalesce(pjs.between(1, MOST_JUSTIFICATIONS), F.lit(False)),
        "several documents": (c("kind") == "event argument") & (F.size(docs) > 1),
        "span ends before it starts": F.coalesce(reversed_, F.lit(False)),
    }
    faults = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    own = assertions.select("subject", F.explode(faults).alias("check"))

    typed, named = c("kind") == "type", c("kind") == "mention"
    ends = F.array(F.struct(c("subject").alias("node"), F.when(typed, c("object")).alias("type"), named.alias("named")), F.struct(F.when(~typed & c("object").startswith(":"), c("object")).alias("node"), F.lit(None).cast("string").alias("type"), F.lit(False).alias("named")))
    nodes = assertions.filter("kind IS NOT NULL").select(F.inline(ends)).filter("node IS NOT NULL")
    seen = nodes.groupBy("node").agg(F.count_distinct("type").alias("types"), F.max("named").alias("named"))
    wrong = F.filter(F.array(F.when(c("types") > 1, "several types"), F.when(c("types") == 0, "no type"), F.when(~c("named"), "no mention")), lambda x: x.isNotNull())
    return own.unionByName(seen.select(c("node").alias("subject"), F.explode(wrong).alias("check"))).distinct()
