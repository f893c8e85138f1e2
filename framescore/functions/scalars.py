"""Scalar functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Form of a partial date; digits may be masked from the right of each part.
TIMEX = r"^([0-9]{4}|[0-9]{3}[Xx]|[0-9]{2}[Xx]{2}|[0-9][Xx]{3})-([0-9]{2}|[0-9][Xx]|[Xx]{2})-([0-9]{2}|[0-9][Xx]|[Xx]{2})$"
TEMPORAL = ("TIME", "Time")


def is_temporal(role: Column) -> Column:
    return role.isin(*TEMPORAL)


def normalise_cas(text: Column) -> Column:
    """Line breaks and tabs become blanks; ends trimmed."""
    return F.trim(F.regexp_replace(text, "\r\n|\n|\t", " "))


def normalise_filler(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, " +", " ")))


def is_timex(text: Column) -> Column:
    return F.coalesce(text.rlike(TIMEX), F.lit(False))


def less_specific_times(text: Column) -> Column:
    """Every masking of one more digit from the right, day first, then month, then year down to its first digit."""
    steps = [text]
    for pattern, to in [
        (r"^(.{8}[0-9])[0-9]$", "$1X"), (r"^(.{8})[0-9]X$", "$1XX"), (r"^(.{6})[0-9]-XX$", "$1X-XX"), (r"^(.{5})[0-9]X-XX$", "$1XX-XX"),
        (r"^(.{3})[0-9]-XX-XX$", "$1X-XX-XX"), (r"^(.{2})[0-9]X-XX-XX$", "$1XX-XX-XX"), (r"^(.{1})[0-9]XX-XX-XX$", "$1XXX-XX-XX"),
    ]:
        steps.append(F.regexp_replace(steps[-1], pattern, to))
    return F.array_except(F.array_distinct(F.array(*steps)), F.array(text))


def parse_span(text: Column) -> Column:
    """`a-b` as a struct of start and end."""
    parts = F.split(text, "-")
    return F.struct(F.get(parts, 0).cast("int").alias("start"), F.get(parts, 1).cast("int").alias("end"))


def parse_spans(text: Column) -> Column:
    """Comma-joined spans; NIL and the empty string are no spans."""
    return F.when(F.trim(text).isin("", "NIL"), F.array().cast("array<struct<start:int,end:int>>")).otherwise(F.transform(F.split(text, ","), lambda x: parse_span(F.trim(x))))


def format_span(start: Column, end: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("-"), end.cast("string"))


def format_spans(spans: Column, empty: str = "NIL") -> Column:
    return F.when(F.size(spans) == 0, F.lit(empty)).otherwise(F.array_join(F.transform(spans, lambda s: format_span(s["start"], s["end"])), ","))


def contains(outer_start: Column, outer_end: Column, start: Column, end: Column) -> Column:
    """Whether an inclusive span holds another."""
    return (outer_start <= start) & (end <= outer_end)


def text_at(text: Column, start: Column, end: Column) -> Column:
    """Text of an inclusive span; null past the end."""
    return F.when(end < F.char_length(text), F.substring(text, start + 1, end - start + 1))


def first_prefix(value: Column, prefixes: list[tuple[str, str]], default: str) -> Column:
    """The name of the first prefix that a value has, in order; longer prefixes go before their beginnings."""
    chain = reduce(lambda c, p: c.when(value.startswith(p[0]), p[1]), prefixes, F.when(F.lit(False), ""))
    return chain.otherwise(default)


#: Genres by the beginning of a document's name, in the order in which they are tried.
GENRES = {
    "Broadcast conversation": ["CNN_CF", "CNN_IP"],
    "Broadcast News": ["CNN_", "CNNHL"],
    "Forum": ["bolt", "marce", "alt.", "aus.cars", "Austin-Grad", "misc.", "rec.", "seattle.", "soc.", "talk.", "uk."],
    "Newswire": ["APW", "AFP", "CNA", "NYT", "WPB", "XIN"],
    "Blog": ["AGGRESSIVEVOICEDAILY", "BACONSREBELLION", "FLOPPING_ACES", "GETTINGPOLITICAL", "HEALINGIRAQ", "MARKBACKER", "OIADVANTAGE", "TTRACY"],
    "Speech": ["fsh_"],
}


def genre(doc_id: Column) -> Column:
    return first_prefix(doc_id, [(p, name) for name, prefixes in GENRES.items() for p in prefixes], "Unknown")


def gold_realis(mention_realis: Column, argument_realis: Column) -> Column:
    """A generic mention makes its arguments generic, an irrealis argument is Other, else the mention's realis holds."""
    return F.when(mention_realis == "Generic", "Generic").when(~argument_realis, "Other").otherwise(mention_realis)


def kb_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def kb_unescape(text: Column) -> Column:
    return F.regexp_replace(text, r'\\(["\\])', "$1")
