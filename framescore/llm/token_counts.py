"""Token counts by offset-mapped attribution.

Each whole document is encoded once; the byte spans of its tokens are joined with the spans of its sections by binary
search inside the task that holds the row, so nothing is shuffled and a document is never encoded in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .tokens import encoder, vocabulary_path

#: Section number of tokens that overlap no section.
OUTSIDE = -1
#: Rows of a result frame.
ROWS = 20_000


def line_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines, without their line feeds."""
    feeds = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
    return np.concatenate(([0], feeds + 1)), np.concatenate((feeds, [len(data)]))


def char_to_byte(data: bytes, at: np.ndarray) -> np.ndarray:
    """Byte offsets of code-point offsets; those past the end become the end."""
    begins = np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)
    begins = np.append(begins, len(data))
    return begins[np.minimum(at, len(begins) - 1)]


def attribute(ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and whether it overlaps more than one. Sections are disjoint and in order.

    A token goes to the section that holds most of its bytes; on a tie to the earlier one; to OUTSIDE if it overlaps
    none.
    """
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    filled = np.flatnonzero(last > first)
    if not len(filled):
        return np.full(len(ends), OUTSIDE), np.zeros(len(ends), dtype=bool)
    a, b = first[filled], last[filled]
    low = np.searchsorted(b, starts, side="right")
    high = np.searchsorted(a, ends, side="left") - 1
    crossing = high > low
    best = np.where(high < low, len(filled), low)
    for t in np.flatnonzero(crossing):
        span = np.arange(low[t], high[t] + 1)
        best[t] = span[np.argmax(np.minimum(b[span], ends[t]) - np.maximum(a[span], starts[t]))]
    return np.append(filled, OUTSIDE)[best], crossing


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """One row per section of each row of docs: doc_id, section, first_char, end_char, n_tokens, n_crossing.

    Sections are the lines, or the disjoint code-point spans of sections_col (array<struct<start,end>>, in order), as
    of fields concatenated into the text. A token goes to the section that holds most of its bytes, on a tie to the
    earlier one; n_crossing counts those of n_tokens that overlap more than one. Tokens between sections are in the row
    of section -1, given only if there are any, so that a document's counts add up to its length in tokens. Null text
    is empty: one empty line, no tokens; null sections are none. Ids may be null or repeat; an empty table gives no
    rows; further columns are ignored.
    """
    path = vocabulary or vocabulary_path()
    own = sections_col is not None
    d = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_of(text_col).alias("t"), *([F.expr(f"transform(coalesce({sections_col}, array()), x -> array(x.start, x.end))").cast("array<array<int>>").alias("sections")] if own else []))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        out, rows = [], 0
        for frame in frames:
            for doc, text, *spans in frame.itertuples(index=False, name=None):
                data = text.encode()
                if own:
                    chars = np.array([list(x) for x in spans[0]], dtype=np.int64).reshape(-1, 2)
                    first, last = char_to_byte(data, chars[:, 0]), char_to_byte(data, chars[:, 1])
                else:
                    first, last = line_spans(data)
                    if len(data) == len(text):
                        chars = np.stack((first, last), axis=1)
                    else:
                        begins = np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)
                        before = np.concatenate(([0], begins))
                        chars = np.stack((before[first], before[last]), axis=1)
                section, crossing = attribute(enc.byte_ends(enc.ids(text)), first, last)
                n = np.bincount(section + 1, minlength=len(first) + 1)
                x = np.bincount(section[crossing] + 1, minlength=len(first) + 1)
                keep = slice(0 if n[0] else 1, None)
                out.append((np.repeat(np.array([doc], dtype=object), len(n))[keep], np.arange(OUTSIDE, len(first))[keep], np.append(-1, chars[:, 0])[keep], np.append(-1, chars[:, 1])[keep], n[keep], x[keep]))
                rows += len(n)
                if rows >= ROWS:
                    yield _frame(out)
                    out, rows = [], 0
        if out:
            yield _frame(out)

    counted = d.mapInPandas(run, "doc_id string, section int, first_char long, end_char long, n_tokens long, n_crossing long")
    return counted.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def _frame(parts: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(["doc_id", "section", "first_char", "end_char", "n_tokens", "n_crossing"], map(np.concatenate, zip(*parts, strict=True)), strict=True)))
