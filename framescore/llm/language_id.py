"""Language identification by prediction by partial matching.

Each language has a variable-order context tree over bytes, with frozen counts: a symbol seen in a context costs
-log2(n / (total + distinct)); an unseen one escapes, at distinct / (total + distinct), to the next shorter context, down
to a uniform choice of bytes. A text's exact code length under each tree decides. The trees' nodes are merged in one
table of costs, so that a position needs two look-ups for all languages together.

The merged table holds a row of costs, one for each language, for each context and symbol that some language has seen, a
row of escape costs for each context, and a slot for each context and symbol. It grows with the languages' contexts
times the languages and is broadcast: 5 MB for four languages, some 500 MB for sixteen; it is not meant for more.

Fitted on a bounded sample: about SAMPLE_DOCS rows of each language, of each a window of SAMPLE_BYTES that begins where a
hash says. Of each language's contexts of an order the MAX_NODES most frequent ones are kept; the others cost as in their
shorter context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_place, text_of

ORDER = 3
SAMPLE_DOCS = 250
SAMPLE_BYTES = 16_384
MAX_NODES = 20_000
FOLDS = 5
UNDETERMINED = "und"
#: Positions scored at a time.
BLOCK = 1 << 18


class Trees:
    """The merged trees of all languages.

    symbol: byte -> symbol (0: bytes of no sample). A node is a context that some language's tree has; context_of maps
    the last ORDER symbols to the longest such context, `shorter` a node to the next shorter one. slot: (node, symbol) ->
    row of `cost`, bits by language, or -1 if no language saw the symbol there; leave: bits to escape from a node.
    """

    def __init__(self, samples: dict[str, list[bytes]], max_nodes: int = MAX_NODES):
        self.languages = sorted(samples)
        data = {k: [np.frombuffer(b" " * ORDER + x, dtype=np.uint8) for x in samples[k]] for k in self.languages}
        seen = np.zeros(256, dtype=bool)
        seen[32] = True
        for x in (x for v in data.values() for x in v):
            seen[x] = True
        self.symbol = np.zeros(256, dtype=np.int64)
        self.symbol[seen] = np.arange(1, seen.sum() + 1)
        self.size = a = int(seen.sum()) + 1
        coded = {k: [self.symbol[x] for x in v] for k, v in data.items()}

        def grams(k: str, n: int) -> tuple[np.ndarray, np.ndarray]:
            """Codes and counts of contexts of n symbols with the symbol after them."""
            parts = []
            for x in coded[k]:
                code = np.zeros(len(x) - ORDER, dtype=np.int64)
                for back in range(n, -1, -1):
                    code = code * a + x[ORDER - back : len(x) - back]
                parts.append(code)
            return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.int64), np.empty(0, np.int64))

        # the root escapes to a uniform choice of 256 bytes
        slots, costs, leaves, parents = [], [], [], []
        index = np.zeros(1, dtype=np.int64)  # context code -> its node, or that of the longest shorter context
        rows = nodes = 0
        for n in range(ORDER + 1):
            found = {k: grams(k, n) for k in self.languages}
            contexts = np.unique(np.concatenate([_frequent(*g, a, max_nodes if n else 1) for g in found.values()]))
            found = {k: tuple(x[np.isin(g[0] // a, contexts)] for x in g) for k, g in found.items()}
            pairs = np.unique(np.concatenate([g for g, _ in found.values()]))
            parent = index[contexts % a ** (n - 1)] if n else np.full(len(contexts), -1)
            at = np.searchsorted(contexts, pairs // a)
            cost, leave = np.empty((len(pairs), len(self.languages))), np.empty((len(contexts), len(self.languages)))
            for j, k in enumerate(self.languages):
                g, c = found[k]
                row = np.searchsorted(contexts, g // a)
                total, distinct = np.bincount(row, weights=c, minlength=len(contexts)), np.bincount(row, minlength=len(contexts))
                # a context unseen in this language costs nothing to leave
                leave[:, j] = np.where(distinct > 0, np.log2(np.maximum(total + distinct, 1) / np.maximum(distinct, 1)), 0.0)
                cost[:, j] = leave[at, j] + (self._bits(slots, costs, leaves, parents, parent[at], pairs % a, j) if n else 8.0)
                cost[np.searchsorted(pairs, g), j] = -np.log2(c / (total + distinct)[row])
            slot = np.full((len(contexts), a), -1, dtype=np.int32)
            slot[at, pairs % a] = rows + np.arange(len(pairs))
            wider = np.tile(index, a) if n else index
            wider[contexts] = nodes + np.arange(len(contexts))
            index, rows, nodes = wider, rows + len(pairs), nodes + len(contexts)
            slots, costs, leaves, parents = [*slots, slot], [*costs, cost], [*leaves, leave], [*parents, parent]
        self.node, self.shorter = index.astype(np.int32), np.concatenate(parents).astype(np.int32)
        self.slot = np.concatenate(slots)
        self.cost, self.leave = np.concatenate(costs).astype(np.float32), np.concatenate(leaves).astype(np.float32)

    @staticmethod
    def _bits(slots: list, costs: list, leaves: list, parents: list, node: np.ndarray, symbol: np.ndarray, j: int) -> np.ndarray:
        """Bits of symbols at nodes of the orders built so far, for language j."""
        slot, cost, leave, parent = np.concatenate(slots), np.concatenate(costs)[:, j], np.concatenate(leaves)[:, j], np.concatenate(parents)
        out, node = np.zeros(len(node)), node.copy()
        open_ = np.arange(len(node))
        while len(open_):
            row = slot[node[open_], symbol[open_]]
            out[open_[row >= 0]] += cost[row[row >= 0]]
            open_ = open_[row < 0]
            out[open_] += leave[node[open_]]
            node[open_] = parent[node[open_]]
            out[open_[node[open_] < 0]] += 8.0
            open_ = open_[node[open_] >= 0]
        return out

    def bits(self, data: bytes) -> np.ndarray:
        """Code length of the whole of data under each language, in bits."""
        x = self.symbol[np.frombuffer(b" " * ORDER + data, dtype=np.uint8)]
        out = np.zeros(len(self.languages))
        for at in range(0, len(data), BLOCK):
            y = x[at : at + BLOCK + ORDER]
            context = np.zeros(len(y) - ORDER, dtype=np.int64)
            for back in range(ORDER):
                context = context * self.size + y[back : len(y) - ORDER + back]
            node, symbol = self.node[context], y[ORDER:]
            while len(node):
                row = self.slot[node, symbol]
                out += self.cost.take(row[row >= 0], axis=0).sum(axis=0, dtype=np.float64)
                node, symbol = node[row < 0], symbol[row < 0]
                out += self.leave.take(node, axis=0).sum(axis=0, dtype=np.float64)
                node = self.shorter[node]
                out += 8.0 * int((node < 0).sum())
                node, symbol = node[node >= 0], symbol[node >= 0]
        return out


def _frequent(grams: np.ndarray, counts: np.ndarray, size: int, most: int) -> np.ndarray:
    """The contexts of grams that occur most, at most so many; ties by code."""
    contexts, of = np.unique(grams // size, return_inverse=True)
    weight = np.bincount(of, weights=counts, minlength=len(contexts))
    return contexts[np.argsort(-weight, kind="stable")[:most]]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Trees | None:
    """Trees from labelled rows outside the held-out fold; None if there are none."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~_held_out(id_col))
    share = {r.lang: sample_docs / r.n for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return None
    ident = F.col(id_col).cast("string")
    drawn = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    sample = known.filter(hash_place(6, ident) < F.element_at(drawn, F.col(lang_col))).select(F.col(lang_col).alias("lang"), F.encode(text_col, "utf-8").alias("all"))
    spare = F.greatest(F.octet_length("all") - sample_bytes, F.lit(0)) + 1
    start = F.pmod(F.xxhash64(F.lit(7), "all"), spare.cast("long")).cast("int") + 1
    sample = sample.select("lang", F.substring("all", start, F.lit(sample_bytes)).alias("data"))
    sample = sample.orderBy(F.xxhash64("lang", "data"), "lang", "data").limit(2 * sample_docs * len(share))  # by hash: reruns draw the same
    texts: dict[str, list[bytes]] = {k: [] for k in share}
    for r in sample.collect():
        texts[r.lang].append(bytes(r.data))
    texts = {k: sorted(v) for k, v in texts.items() if v}
    return Trees(texts) if texts else None


def _held_out(id_col: str):
    """Null ids are never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", trees: Trees | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, bits_per_byte.

    score is the posterior of lang_pred under a uniform prior. Text that is null or has no letter is `und` with score 0
    and no code length, and so is every text if no row is labelled. On a tie the language first by code point wins. Ids
    may be null or repeat; an empty table gives no rows; further columns are ignored.
    """
    trees = trees or fit(docs, id_col, text_col, lang_col)
    d = docs.select(F.col(id_col).cast("string").alias("doc_id"), _held_out(id_col).alias("held_out"), F.when(text_of(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("t"))
    kind = docs.schema[id_col].dataType
    if trees is None:
        return d.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    sent = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by MAX_NODES and the sample, for each language

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = sent.value
        for frame in frames:
            found = []
            for text in frame["t"]:
                if text is None:
                    found.append((UNDETERMINED, 0.0, None))
                    continue
                data = text.encode()
                bits = t.bits(data)
                best = int(bits.argmin())
                found.append((t.languages[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()), bits[best] / len(data)))
            out = pd.DataFrame(found, columns=["lang_pred", "score", "bits_per_byte"])
            out.insert(0, "held_out", frame["held_out"])
            out.insert(0, "doc_id", frame["doc_id"])
            yield out

    found = d.mapInPandas(run, "doc_id string, held_out boolean, lang_pred string, score double, bits_per_byte double")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def drop_undetermined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", trees: Trees | None = None) -> DataFrame:
    """The rows of docs with a language, with all their columns and lang set to the predicted one.

    Each row is predicted where it lies, without a shuffle, so ids may be null or repeat. No row has a language if none
    is labelled.
    """
    trees = trees or fit(docs, id_col, text_col, lang_col)
    if trees is None:
        return docs.filter(F.lit(False))
    sent = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by MAX_NODES and the sample, for each language

    @F.pandas_udf("string")
    def predicted(texts: pd.Series) -> pd.Series:
        t = sent.value
        return pd.Series([t.languages[int(t.bits(x.encode()).argmin())] for x in texts], dtype=object)

    return docs.filter(text_of(text_col).rlike(r"\p{L}")).withColumn(lang_col, predicted(F.col(text_col)))
