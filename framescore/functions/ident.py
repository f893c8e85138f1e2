"""Identifiers of responses and of their equivalence classes, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order of realis in identifiers.
REALIS_ORDER = ("Actual", "Generic", "Other")
_MOD = 1 << 32


def realis_ordinal(realis: Column) -> Column:
    return reduce(lambda c, kv: c.when(realis == kv[1], kv[0]), enumerate(REALIS_ORDER), F.when(F.lit(False), -1))


def _le_hex(x: Column) -> Column:
    """A 32-bit integer as eight hexadecimal digits, lowest byte first."""
    byte = lambda n: F.shiftright(x, n).bitwiseAND(F.lit(255)).cast("bigint")
    return F.lpad(F.hex(byte(0) * (1 << 24) + byte(8) * (1 << 16) + byte(16) * (1 << 8) + byte(24)), 8, "0")


def _spans_hex(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(_le_hex(s["start"]), _le_hex(s["end"]))), "")


def _digest(text: list[str], numbers: list[Column]) -> Column:
    return F.sha1(F.concat(F.encode(F.concat(*text), "UTF-8"), F.unhex(F.concat(*numbers))))


def response_id(doc="doc_id", event_type="event_type", role="role", cas="cas") -> Column:
    """SHA-1 over names and little-endian offsets; the span sets are set apart by a 0 and a 1."""
    ints = [_le_hex(F.col(c)) for c in ("cas_start", "cas_end", "bf_start", "bf_end")]
    zero, one = F.lit("00000000"), F.lit("01000000")
    return _digest([doc, event_type, role, cas], [*ints, zero, _spans_hex(F.col("pj")), one, _spans_hex(F.col("aaj")), _le_hex(realis_ordinal(F.col("realis")))])


def trfr_id(cas="cas", cas_start="cas_start", cas_end="cas_end") -> Column:
    """SHA-1 of a type-role-filler-realis class."""
    return _digest(["doc_id", "event_type", "role", cas], [_le_hex(F.col(cas_start)), _le_hex(F.col(cas_end)), _le_hex(realis_ordinal(F.col("realis")))])


def text_hash(text: Column) -> Column:
    """Polynomial hash of a string's code points with base 31, modulo 2^32 (as bigint)."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda a, c: F.pmod(a * 31 + F.ascii(c), F.lit(_MOD)))


def _mixed(*parts: Column) -> Column:
    """Parts folded in order, from 1, with base 31."""
    return reduce(lambda a, x: F.pmod(a * 31 + x, F.lit(_MOD)), parts, F.lit(1).cast("bigint"))


def _span_hash(start: Column, end: Column) -> Column:
    return _mixed(start.cast("bigint"), end.cast("bigint"))


def _spans_hash(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, s: F.pmod(a + _span_hash(s["start"], s["end"]), F.lit(_MOD)))


def old_id() -> Column:
    """The signed 32-bit identifier of the oldest format; it breaks ties between equally confident responses."""
    cas = _mixed(text_hash(F.col("cas")), _span_hash(F.col("cas_start"), F.col("cas_end")))
    h = _mixed(text_hash(F.col("doc_id")), text_hash(F.col("event_type")), text_hash(F.col("role")), cas, _span_hash(F.col("bf_start"), F.col("bf_end")), _spans_hash(F.col("aaj")), _spans_hash(F.col("pj")), text_hash(F.col("realis")))
    return (F.pmod(h + (1 << 31), F.lit(_MOD)) - (1 << 31)).cast("int")
