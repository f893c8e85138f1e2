"""Groups of spelling variants: words one edit apart, found by dynamic programming over sorted lists.

A word of m letters is cut into PARTS windows. Of two words one edit apart the shorter has m letters, and the first place
where they differ lies in one window; what stands before that window and after it is the same in both. So each word is
dealt to one group for each window (for m its own length and one less), named by the rest of the word, and a pair of
near words meets in exactly one group.

In a group the windows' contents form a sorted list. It is read depth by depth: neighbours whose common prefix is longer
than the depth share one row of the edit matrix, three cells wide, for each searching word; a new row is made only where
neighbours part, from the row that they share, and a range whose shared prefix is more than one edit away is skipped
with all its words. All words of a batch search side by side.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialise

LETTERS, OCCURRENCES, RATIO, DROP_OF = 7, 2, 10, 31
PARTS = 4
#: Groups of more words are cut into chunks, and each pair of chunks is searched on its own.
CELL = 4096
#: Words a task counts before it passes them on, and words times list members that search side by side.
HELD, ABREAST = 400_000, 1 << 20
#: Crowded groups are broadcast up to this number (16 bytes each), else joined by a shuffle.
BROADCAST_CELLS = 100_000
#: Letters of the pattern stay, A-Z in lower case; any other byte of Latin-1 parts runs.
_RUNS = bytes(ord(LOWER[UPPER.index(chr(c))]) if chr(c) in UPPER else c if chr(c) in LOWER or c >= 0xC0 else 32 for c in range(256))


def _runs(text: str) -> list[bytes]:
    """Runs [A-Za-z and U+00C0 to U+00FF] of at least LETTERS, in Latin-1; further characters become question marks."""
    return [w for w in text.encode("latin-1", "replace").translate(_RUNS).split() if len(w) >= LETTERS]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_of: int = DROP_OF) -> DataFrame:
    """(word, n) of all words of at least LETTERS; of a run whose hash drop_of divides, one letter is deleted.

    Null text has none; a null id is hashed as the empty text.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, int] = {}
        for frame in frames:
            for name, text in zip(frame["id"], frame["t"], strict=True):
                start = zlib.crc32(name.encode())
                for w, n in Counter(_runs(text)).items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if not h % drop_of:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < LETTERS:
                            continue
                    held[w] = held.get(w, 0) + n
                if len(held) >= HELD:
                    yield shown(held)
                    held = {}
        yield shown(held)

    def shown(held: dict[bytes, int]) -> pd.DataFrame:
        return pd.DataFrame({"word": _plain([w.decode("latin-1") for w in held]), "n": np.fromiter(held.values(), dtype=np.int64)})

    own = docs.filter(F.col(text_col).isNotNull()).select(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("id"), F.col(text_col).alias("t"))
    return own.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _dealt(words: DataFrame, parts: int) -> DataFrame:
    """(m, part, key, mid, word, n): each word in each of its groups."""
    size = F.char_length("word")
    own = words.withColumn("m", F.explode(F.when(size > LETTERS, F.array(size - 1, size)).otherwise(F.array(size))))
    own = own.withColumn("part", F.explode(F.array(*map(F.lit, range(parts)))))
    at, end = F.floor(F.col("m") * F.col("part") / parts).cast("int"), F.floor(F.col("m") * (F.col("part") + 1) / parts).cast("int")
    own = own.withColumns({"at": at, "after": F.col("m") - end})
    key = F.concat(F.substring("word", F.lit(1), F.col("at")), F.substring("word", size - F.col("after") + 1, F.col("after")))
    return own.select("m", "part", key.alias("key"), F.substring("word", F.col("at") + 1, size - F.col("at") - F.col("after")).alias("mid"), "word", "n")


def _search(group: np.ndarray, mids: list[str], query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): rows of mids exactly one edit apart in one group, a of query. Rows are sorted by group and mid."""
    letters = np.frombuffer("".join(mids).encode("utf-32-le"), dtype="<u4")
    size = np.fromiter(map(len, mids), dtype=np.int64, count=len(mids))
    first = np.cumsum(size) - size
    letters = np.append(letters, np.zeros(1, dtype="<u4"))

    def letter(q: np.ndarray, k: int) -> np.ndarray:
        """The k-th letter of words; 0, which equals none, outside of them."""
        inside = (k < size[q]) if k >= 0 else np.zeros(len(q), dtype=bool)
        return letters[np.where(inside, first[q] + k, len(letters) - 1)]

    node = np.concatenate(([0], np.cumsum(group[1:] != group[:-1])))  # of each row, the range of rows that share its prefix
    alive, q, at, depth = np.arange(len(mids)), query, node[query], 0
    # edits from the range's prefix to the first depth - 1, depth and depth + 1 letters of the searching word; 2: beyond one
    low, mid, high = np.full(len(q), 2, dtype=np.int8), np.zeros(len(q), dtype=np.int8), np.ones(len(q), dtype=np.int8)
    a, b = [], []
    while len(q):
        nodes = node[-1] + 1
        ends = size[alive] == depth
        whole = np.full(nodes, -1)
        whole[node[ends]] = alive[ends]  # words in a range differ, so one at most ends here
        found = whole[at]
        gap = size[q] - depth
        cost = np.where(gap == 0, mid, np.where(gap == 1, high, np.where(gap == -1, low, 2)))
        near = (found >= 0) & (cost == 1)
        a.append(q[near])
        b.append(found[near])
        alive, parent = alive[~ends], node[~ends]
        if not len(alive):
            break
        c = letters[first[alive] + depth]
        new = np.append(True, (parent[1:] != parent[:-1]) | (c[1:] != c[:-1]))  # where neighbours part
        head = np.flatnonzero(new)
        below = np.bincount(parent[head], minlength=nodes)
        start = np.cumsum(below) - below
        times = below[at]
        old = np.repeat(np.arange(len(q)), times)
        child = start[at[old]] + np.arange(len(old)) - np.repeat(np.cumsum(times) - times, times)
        x, q = c[head][child], q[old]
        low, mid, high = low[old], mid[old], high[old]
        one = np.minimum(low + (letter(q, depth - 1) != x), mid + 1)
        two = np.minimum(np.minimum(mid + (letter(q, depth) != x), high + 1), one + 1)
        three = np.minimum(high + (letter(q, depth + 1) != x), two + 1)
        going = np.minimum(np.minimum(one, two), three) <= 1
        q, at = q[going], child[going]
        low, mid, high = (np.minimum(v[going], 2).astype(np.int8) for v in (one, two, three))
        node, depth = np.cumsum(new) - 1, depth + 1
    return np.concatenate(a), np.concatenate(b)


def _neighbours(frame: pd.DataFrame, parts: int) -> pd.DataFrame:
    """(word, n_near, best_n, best) of the words of whole groups, sorted by group and mid."""
    keys = frame[["m", "part", "one", "two"]].to_numpy()
    text = frame["key"].to_numpy(dtype=object)
    group = np.concatenate(([0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1) | (text[1:] != text[:-1]))))
    mids, words, n = frame["mid"].to_list(), frame["word"].to_numpy(dtype=object), frame["n"].to_numpy()
    m, part, mine = frame["m"].to_numpy(), frame["part"].to_numpy(), frame["mine"].to_numpy()
    window = m * (part + 1) // parts - m * part // parts
    longer = np.fromiter(map(len, mids), dtype=np.int64, count=len(mids)) > window
    held = np.bincount(group)[group]
    query = np.flatnonzero(~longer & (held > 1))  # pairs of two longer words are of another group
    cuts = np.flatnonzero(np.diff(np.cumsum(held[query]) // ABREAST)) + 1
    found = [_search(group, mids, q) for q in np.split(query, cuts)] if len(query) else []
    if not found:
        return pd.DataFrame({"word": _plain([]), "n_near": [], "best_n": [], "best": _plain([])})
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    good = (keys[a, 2] == keys[a, 3]) | (mine[a] != mine[b])  # words of one chunk meet in that chunk's own search
    # a longer word that only goes on behind the window is found in a later one
    late = np.fromiter((longer[y] and part[x] < parts - 1 and mids[y].startswith(mids[x]) for x, y in zip(a, b, strict=True)), dtype=bool, count=len(a))
    a, b = a[good & ~late], b[good & ~late]
    back = longer[b]
    a, b = np.concatenate((a, b[back])), np.concatenate((b, a[back]))
    rank = np.empty(len(words), dtype=np.int64)
    rank[np.argsort(words, kind="stable")] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    lead = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else a
    return pd.DataFrame({"word": _plain(words[a[lead]]), "n_near": np.diff(np.append(lead, len(a))), "best_n": n[b[lead]], "best": _plain(words[b[lead]])})


def _plain(words) -> pd.Series:
    """Texts as Python objects: a column of several Arrow chunks can't be handed back."""
    return pd.Series(words, dtype=object)


def near_words(words: DataFrame, parts: int = PARTS, cell: int = CELL) -> DataFrame:
    """(word, n_near, best_n, best) for each word and group in which it has near words. words: distinct word, n."""
    dealt = _dealt(words, parts)
    name = F.xxhash64("m", "part", "key")
    crowded = materialise(dealt.select(name.alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > cell).select("name", F.ceil(F.col("held") / cell).cast("int").alias("chunks")))
    few = crowded.count() <= BROADCAST_CELLS
    placed = dealt.withColumn("name", name).join(F.broadcast(crowded) if few else crowded, "name", "left").drop("name")
    mine = F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1)))
    group = ["m", "part", "key", "one", "two"]
    placed = placed.select("m", "part", "key", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "mine", "mid", "word", "n")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for frame in frames:
            kept = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            last = np.flatnonzero((kept[group] != kept[group].iloc[-1]).any(axis=1).to_numpy())
            if len(last):  # the last group may go on in the next frame
                yield _neighbours(kept.iloc[: last[-1] + 1], parts)
                kept = kept.iloc[last[-1] + 1 :].reset_index(drop=True)
        if kept is not None and len(kept):
            yield _neighbours(kept, parts)

    return placed.repartition(*group).sortWithinPartitions(*group, "mid").mapInPandas(run, "word string, n_near long, best_n long, best string")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: chains are followed by doubling, each round written."""
    now = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = materialise(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if after.filter("moved").isEmpty():
            return now
        now = after.drop("moved")


def variants_of_counts(counts: DataFrame, ratio: int = RATIO, parts: int = PARTS, cell: int = CELL) -> DataFrame:
    """One row per word of counts (distinct word, n): word, form, root, n, n_near, form_n."""
    own = materialise(counts)
    both = near_words(own, parts, cell).unionByName(own.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"), "n"), allowMissingColumns=True)
    best: Column = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))  # most frequent, then first by code points
    found = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("x"))
    good = -F.col("x.less") >= ratio * F.col("n")
    found = materialise(found.select("word", "n", "n_near", F.when(good, F.col("x.best")).alias("form"), F.when(good, -F.col("x.less")).alias("form_n")))
    roots = _roots(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", occurrences: int = OCCURRENCES, ratio: int = RATIO, drop_of: int = DROP_OF) -> DataFrame:
    """One row per word that occurs often enough: word, form, root, n, n_near, form_n.

    Null and empty texts have no words; a null id is hashed as the empty text; rows that repeat an id or a text each
    count. Of equally frequent near words the first in code-point order is the form. Words of any length are compared
    whole. An empty table gives no rows; further columns are ignored.
    """
    return variants_of_counts(word_counts(docs, id_col, text_col, drop_of).filter(F.col("n") >= occurrences), ratio)
