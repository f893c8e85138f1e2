"""SimHash near-duplicates by segment-popcount embedding.

Each fingerprint is embedded as its bit counts over 32 two-bit segments. The Manhattan distance of two embeddings is a
lower bound of their Hamming distance. The grid range join uses that: segments are grouped in bands; at a distance of
K or less at most K bands differ, so two near fingerprints share a grid cell in all bands of at least one choice of
BANDS - K. Inside a cell the Manhattan bound is tested first, then the Hamming distance itself.

Only distinct fingerprints are joined. A cell of more than CELL members is split in chunks and every pair of chunks is
compared, each in a group of its own. A cell's links are given as stars, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, spread_join, stay_among, text_of
from .components import connected_components

WORDS = 4
SEED = 42
DISTANCE = 4
#: More bands make cells smaller but give more choices: 6 suit up to some 10^8 distinct fingerprints, 8 more.
BANDS = 6
CELL = 2048
#: Crowded cells are broadcast up to this number (24 bytes each), else joined by a shuffle.
BROADCAST_CELLS = 100_000
LOW = 0x5555555555555555


def fingerprint(text: str, words: int = WORDS) -> int:
    """64-bit SimHash of word shingles, repeats included; 0 without words. A bit is set if it is in over half."""
    w = text.encode().lower().split()  # bytes: folds A-Z only, splits at ASCII white space only
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, sha, fp): fp as a signed long, sha the SHA-256 of the text. Null text has no words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fp = np.array([fingerprint(t, words) for t in frame["t"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"id": frame["id"], "sha": frame["sha"], "fp": fp})

    d = docs.select(F.col(id_col).cast("string").alias("id"), _sha(text_col).alias("sha"), text_of(text_col).alias("t"))
    return d.mapInPandas(run, "id string, sha string, fp long").withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def _sha(text_col: str):
    return F.sha2(text_of(text_col), 256)


def _bands(bands: int) -> list[int]:
    """A bit mask of each band: whole segments, as even as can be."""
    ends = [2 * (32 * k // bands) for k in range(bands + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of links a-b among n nodes, for nodes that aren't that smallest one."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        while (after != (down := after[after])).any():
            after = down
        if (after == label).all():
            break
        label = after
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def _links(run: np.ndarray, fp: np.ndarray, embedded: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of near fingerprints inside runs of equal cells."""
    a, b, at, step = [], [], np.arange(len(fp)), 1
    held = 0
    while True:
        at = at[at + step < len(fp)]
        at = at[run[at] == run[at + step]]
        if not len(at):
            break
        near = at[np.bitwise_count(embedded[at] ^ embedded[at + step]) <= distance]  # Manhattan distance of the embeddings
        near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= distance]
        if len(near):
            a.append(near)
            b.append(near + step)
            held += len(near)
            if held > 1_000_000:
                x, y = _stars(len(fp), np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], 0
        step += 1
    return _stars(len(fp), np.concatenate(a), np.concatenate(b)) if a else (at, at)


def links(fps: DataFrame, distance: int = DISTANCE, bands: int = BANDS, cell: int = CELL) -> DataFrame:
    """(a, b): links that connect all fingerprints within the distance of each other, directly or through others.

    fps: distinct fp.
    """
    masks = _bands(bands)
    choices = [_signed(sum(masks[i] for i in c)) for c in combinations(range(bands), bands - distance)]
    low = F.lit(LOW)
    half = F.shiftrightunsigned("fp", 1)
    # a segment's bit count in unary: the XOR of two embeddings has as many bits as their Manhattan distance
    embedded = ((F.col("fp").bitwiseOR(half)).bitwiseAND(low)).bitwiseOR(F.shiftleft(F.col("fp").bitwiseAND(half).bitwiseAND(low), 1))
    e = fps.select("fp", embedded.alias("e"))
    cells = e.select("fp", "e", F.posexplode(F.array(*[F.col("e").bitwiseAND(F.lit(m)) for m in choices])).alias("choice", "cell"))
    crowded = materialise(cells.groupBy("choice", "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell).select("choice", "cell", F.ceil(F.col("n") / cell).cast("int").alias("chunks")))
    few = crowded.count() <= BROADCAST_CELLS
    placed = cells.join(F.broadcast(crowded) if few else crowded, ["choice", "cell"], "left")
    mine = F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1)))
    group = ["choice", "cell", "one", "two"]
    placed = placed.select("fp", "e", "choice", "cell", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for frame in frames:
            kept = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            keys = kept[group].to_numpy()
            new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if len(new):  # the last run may go on in the next frame
                yield found(kept.iloc[: new[-1]], keys[: new[-1]])
                kept = kept.iloc[new[-1] :].reset_index(drop=True)
        if kept is not None and len(kept):
            yield found(kept, kept[group].to_numpy())

    def found(frame: pd.DataFrame, keys: np.ndarray) -> pd.DataFrame:
        runs = np.concatenate(([0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))))
        fp = frame["fp"].to_numpy()
        a, b = _links(runs, fp.view(np.uint64), frame["e"].to_numpy().view(np.uint64), distance)
        return pd.DataFrame({"a": fp[a], "b": fp[b]})

    return placed.repartition(*group).sortWithinPartitions(*group).mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE, bands: int = BANDS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id.

    component_id is the smallest id reachable over links, its own included. Null or blank text has the fingerprint zero,
    linked like any other; fewer words than a shingle count as one. Rows repeating an id each count; a null id is never
    the smallest unless a component has no other. An empty table gives no rows; further columns are ignored.
    """
    own = materialise(fingerprints(docs, id_col, text_col, words).drop("sha"))
    rows = own.count()
    found = _components(own, F.struct(F.col("id").isNull().alias("void"), "id"), rows, distance, bands)
    return spread_join(own, found, ["fp"], "n", rows).select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least.id").alias("component_id"))


def _components(own: DataFrame, lead: Column, rows: int, distance: int, bands: int) -> DataFrame:
    """(fp, least, n) of each distinct fingerprint of own: the least `lead` in its component, and the rows that have it.

    Rows are reduced to one per fingerprint before anything is joined, so copies load no task.
    """
    by_fp = materialise(own.groupBy("fp").agg(F.min(lead).alias("least"), F.count(F.lit(1)).alias("n")), rows)
    found = materialise(links(by_fp.select("fp"), distance, bands), 16 * rows)
    roots = materialise(connected_components(found).filter("node <> root").select(F.col("node").alias("fp"), "root"), rows)
    rooted = materialise(by_fp.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), rows)
    groups = materialise(rooted.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("held")), rows)
    return materialise(spread_join(rooted, groups, ["root"], "held", rows).select("fp", F.col("first").alias("least"), "n"), rows)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE, bands: int = BANDS) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names: one of each component, that of the
    smallest id (null last), of several texts under that id the one first by SHA-256. Rows that repeat an id and a text
    are one document. An empty table stays empty.

    The threshold is the fingerprints' distance, as of the operator: 4-word shingles and 4 differing bits unless set
    otherwise, which is stricter than a similarity of 0.8 between sets of shingles.
    """
    own = materialise(fingerprints(docs, id_col, text_col, words))
    lead = F.struct(F.col("id").isNull().alias("void"), "id", "sha")
    found = _components(own, lead, own.count(), distance, bands)
    first = found.select(F.col("least.id").alias("id"), F.col("least.sha").alias("sha")).distinct()
    again = own.groupBy("id", "sha").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    same = first["id"].eqNullSafe(again["id"]) & (first["sha"] == again["sha"])
    stay = materialise(first.join(again, same, "left").select(first["id"], first["sha"], F.coalesce("copies", F.lit(1).cast("long")).alias("copies")))
    return stay_among(docs, stay, id_col, _sha(text_col))
