"""Packing by concatenate and cut.

Pass 1 encodes every whole document and keeps its ids, with the running count of ids inside the partition. Prefix sums
over the partitions' totals then give each document's global offset, and pass 2 cuts the one long concatenation into
fixed windows: boundary records (document, start, length, sequence, offset). Only the last sequence of all is not full.
No row is shuffled; what is gathered is one number per partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_of
from .tokens import encoder, vocabulary_path

WINDOW = 1024
END_ID = 0
#: Partition totals are broadcast up to so many partitions (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_PARTITIONS = 1_000_000


def encode_all(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id as string, part, before, n, ids): ids as little-endian unsigned numbers with END_ID last, of 16 bits if every
    id of the vocabulary fits, else of 32; before counts the ids of earlier documents of the same partition."""
    path = vocabulary or vocabulary_path()
    d = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_of(text_col).alias("t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for frame in frames:
            ids = [np.append(enc.ids(t), END_ID).astype(enc.dtype) for t in frame["t"]]
            n = np.array([len(x) for x in ids], dtype=np.int64)
            ends = before + np.cumsum(n)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "part": part, "before": ends - n, "n": n, "ids": [x.tobytes() for x in ids]})
            before = int(ends[-1]) if len(ends) else before

    return d.mapInPandas(run, "doc_id string, part int, before long, n long, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each row of docs is a document, also where ids repeat or are null; null text is empty and gives the one id END_ID.
    An empty table gives no rows; further columns are ignored. Sequences are full but for the last one.
    """
    encoded = materialise(encode_all(docs, id_col, text_col, vocabulary))
    totals = encoded.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    base = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("part", base.alias("base"))  # one row a partition
    few = encoded.select("part").distinct().count() <= BROADCAST_PARTITIONS
    placed = encoded.join(F.broadcast(offsets) if few else offsets, "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "ids")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, at, n, raw in frame.itertuples(index=False, name=None):
                ids = np.frombuffer(raw, dtype=f"<u{len(raw) // n}").astype("<u4")
                start = 0
                while start < len(ids):
                    sequence, offset = divmod(at + start, window)
                    length = min(window - offset, len(ids) - start)
                    out.append((doc, start, length, zlib.crc32(ids[start : start + length].data), len(ids), sequence, offset))
                    start += length
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    pieces = placed.mapInPandas(cut, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
