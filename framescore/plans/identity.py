"""Queries over identifiers and the logical tables themselves."""

from pyspark.sql import functions as F

from framescore.functions import ident

from .registry import query
from .tables import SQL_REALIS, _le

_CHARS = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({0}, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296)"


def _fold(*parts: str) -> str:
    out = "1"
    for p in parts:
        out = f"((({out}) * 31 + {p}) % 4294967296)"
    return out


def _spans(x: str) -> str:
    return f"(coalesce(list_sum(list_transform({x}, lambda s: {_fold('s.start', 's.end')})), 0) % 4294967296)"


SQL_OLD = _fold(_CHARS.format("doc_id"), _CHARS.format("event_type"), _CHARS.format("role"), _fold(_CHARS.format("cas"), _fold("cas_start", "cas_end")), _fold("bf_start", "bf_end"), _spans("aaj"), _spans("pj"), _CHARS.format("realis"))


@query(
    "fn6_identifiers",
    f""", h AS (SELECT *, CAST({SQL_OLD} AS BIGINT) AS h FROM responses)
    SELECT system_id, response_id, confidence, CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS INT) AS old_id,
    sha1(CAST(encode(doc_id || event_type || role || cas) AS BLOB) || unhex({_le('cas_start')} || {_le('cas_end')} || {_le(SQL_REALIS)})) AS trfr_id FROM h""",
)
def fn6(t):
    return t.responses.select("system_id", "response_id", "confidence", ident.old_id().alias("old_id"), ident.trfr_id().alias("trfr_id"))


@query("jn1_response_assessment", "SELECT system_id, r.response_id, is_assessed, aet, aer, cas_ok, bf_ok, a_realis, mention_type FROM responses r JOIN assessments a USING (response_id)")
def jn1(t):
    a = t.assessments.select("response_id", "is_assessed", "aet", "aer", "cas_ok", "bf_ok", "a_realis", "mention_type")
    return t.responses.select("system_id", "response_id").join(a, "response_id")


@query("tables_linking", "SELECT * FROM (SELECT 'g' AS what, doc_id, frame_id, response_id FROM gold_linking UNION ALL SELECT system_id, doc_id, frame_id, response_id FROM linking UNION ALL SELECT 'i', doc_id, '', response_id FROM incomplete UNION ALL SELECT system_id, doc_id, frame_id, corpus_frame_id FROM corpus_linking UNION ALL SELECT '2', doc_id, coalesce(aet, 'n') || coalesce(cas_ok, 'n'), response_id FROM second_assessments)")
def tables_linking(t):
    cols = ["what", "doc_id", "frame_id", "response_id"]
    two = t.second_assessments.select(F.lit("2"), "doc_id", F.concat(F.coalesce("aet", F.lit("n")), F.coalesce("cas_ok", F.lit("n"))), "response_id")
    parts = [t.gold_linking.select(F.lit("g"), "doc_id", "frame_id", "response_id"), t.linking, t.incomplete.select(F.lit("i"), "doc_id", F.lit(""), "response_id"), t.corpus_linking.select("system_id", "doc_id", "frame_id", "corpus_frame_id"), two]
    out = parts[0].toDF(*cols)
    for p in parts[1:]:
        out = out.union(p.toDF(*cols))
    return out
