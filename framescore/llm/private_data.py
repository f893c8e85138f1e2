"""Personal data by candidate generation and boosted trees.

Base spans come from four patterns with exact checks. High-recall generators then propose further, overlapping spans;
boosted trees over format and context features, written out as SQL expressions, score them, and a threshold calibrated
for precision on held-out examples selects those that are added. All per-row expressions: no shuffle, no Python on the
executors. The trees are fitted on the driver from TRAINING_ROWS generated examples (the corpus has no labelled spans).

Offsets count code points. Each pattern runs once to extract and once to split; piece lengths give the offsets, so the
cost is linear in the text. Patterns are possessive, so no long run of digits or letters can overflow the matcher's
stack, and start only where a run starts, so long words cost no more than short ones.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

KINDS = ["email", "ip", "card", "phone", "secret", "ssn", "iban"]
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be worth running.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: High-recall generators: obfuscated addresses, long tokens with a digit, digit groups, country-prefixed accounts.
GENERATORS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++\x20?[\[({{](?:at|AT|@)[\])}}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({{](?:dot|DOT)[\])}}])\x20?[A-Za-z0-9-]++)++",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{16,}+",
    "number": r"(?<![0-9A-Za-z+.,(-])(?<![0-9]\x20)\(?[0-9]{2,4}\)?[\x20.-][0-9]{2,4}[\x20.-][0-9]{3,4}(?![\x20.-]?[0-9])(?![A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){3,7}+(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
}
GENERATOR_NEEDS = {"email": r"(?i)[\[({](at|@)[\])}]", "secret": "[0-9]", "number": "[0-9]", "iban": "[0-9]"}
#: Words before a span that tell what it is, lower case.
CUES = {
    "secret": "token|secret|password|passwd|pwd|api[_ -]?key|apikey|access[_ -]?key|bearer|credential",
    "phone": "phone|tel|call|fax|mobile|cell|whatsapp|sms",
    "ssn": "ssn|social security|tax id",
    "other": "order|version|ver|isbn|part|page|pages|date|invoice|chapter|section|build|commit|sha|checksum|md5",
}
CONTEXT = 32
TRAINING_ROWS = 4000
TREES, DEPTH, RATE, LEAST_PRECISION = 20, 3, 0.4, 0.995


#: Matches are laid out in chunks of this many, so that the cost stays linear for texts full of numbers.
CHUNK = 512
_PLACED = "array<struct<s:int,e:int,m:string,b:string>>"


def let(value: Column, body) -> Column:
    """body of value, computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def spans(text: Column, pattern: str, when: Column) -> Column:
    """array<struct<s,e,m,b>>: start, end (exclusive), match, and up to CONTEXT characters before it in lower case."""
    length = lambda y: y["lp"] + y["lm"]

    def lay(chunk: Column, start: Column) -> Column:
        one = lambda a, y: F.struct((a + y["lp"]).alias("s"), (a + length(y)).alias("e"), y["m"].alias("m"), y["b"].alias("b"))
        empty = F.struct(start.alias("at"), F.array().cast(_PLACED).alias("out"))
        return F.aggregate(chunk, empty, lambda acc, y: F.struct((acc["at"] + length(y)).alias("at"), F.array_append(acc["out"], one(acc["at"], y)).alias("out")))["out"]

    def starts(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, y: a + length(y)))
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(totals, empty, lambda acc, t: F.struct((acc["at"] + t).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]

    def placed(x: Column) -> Column:
        steps = F.transform(x["m"], lambda m, i: let(F.get(x["p"], i), lambda p: F.struct(m.alias("m"), F.lower(F.right(p, F.lit(CONTEXT))).alias("b"), F.char_length(p).alias("lp"), F.char_length(m).alias("lm"))))
        count = F.ceil(F.size(x["m"]) / CHUNK).cast("int")
        chunks = let(steps, lambda st: F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.slice(st, c * CHUNK + 1, F.lit(CHUNK))))
        return F.when(F.size(x["m"]) > 0, let(chunks, lambda ch: let(starts(ch), lambda at: F.flatten(F.transform(ch, lambda c, i: lay(c, F.get(at, i)))))))

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    return F.coalesce(F.when(when, let(found, placed)), F.array().cast(_PLACED))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Every second digit from the right counts double, less 9 above 9; the sum divides by ten."""
    value = lambda d, i: let(d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: v - F.when(v > 9, 9).otherwise(0))
    return F.aggregate(F.transform(F.split(F.reverse(_digits(m)), ""), value), F.lit(0), lambda a, v: a + v) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    count = F.char_length(_digits(m))
    if kind == "card":
        return F.when(count.between(12, 19), _luhn(m)).otherwise(False)
    if kind == "phone":
        return count.between(9, 15)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return F.lit(True)


def _found(kind: Column, x: Column) -> Column:
    return F.struct(x["s"].alias("s"), kind.alias("k"), x["e"].alias("e"))


def _kept(found: Column, passes, kind) -> Column:
    """Spans whose match passes, with the kind of their match."""
    return F.transform(F.filter(found, lambda x: passes(x["m"])), lambda x: _found(kind(x["m"]), x))


def base_spans(text: Column) -> Column:
    """array<struct<s,k,e>> of the base kinds, by start and then kind; k is the index in KINDS."""
    parts = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        when = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]")
        parts.append(_kept(spans(text, pattern, when), functools.partial(_passes, kind), lambda m: F.lit(k)))  # noqa: B023
    return F.array_sort(F.concat(*parts))


def features(m: Column, b: Column) -> dict[str, Column]:
    """Format of a candidate and the context before it, as integers."""
    count = lambda pattern: F.regexp_count(m, F.lit(pattern))
    flag = lambda c: c.cast("int")
    return {
        "length": F.char_length(m),
        "digits": count("[0-9]"),
        "upper": count("[A-Z]"),
        "lower": count("[a-z]"),
        "separators": count(r"[\x20.()-]"),
        "kinds_of_characters": F.size(F.array_distinct(F.split(m, ""))),
        "hexadecimal": flag(m.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "at_mark": flag(m.rlike(r"(?i)[\[({](at|@)[\])}]")),
        "groups_334": flag(m.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$")),
        "groups_324": flag(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        "dots_only": flag(m.rlike(r"^[0-9.]+$")),
        "account": flag(m.rlike("^[A-Z]{2}[0-9]{2}")),
        "alternations": count("[A-Za-z][0-9]|[0-9][A-Za-z]"),
        "assigned": flag(b.rlike(r"[:=]\s*[\x22']?\s*$")),
    } | {f"cue_{k}": flag(b.rlike(rf"\b({v})\b")) for k, v in CUES.items()}


def training_examples(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """(m, b, label) generated from formats by the hash of a row number; bounded by rows."""
    d = lambda n, salt: f"lpad(cast(pmod(xxhash64(id, {salt}), {10**n}) as string), {n}, '0')"
    pick = lambda salt, *of: f"element_at(array({', '.join(repr(x) for x in of)}), cast(pmod(xxhash64(id, {salt}), {len(of)}) as int) + 1)"
    plain = pick(11, "and so the ", "of a ", "dans une ", "der und die ", "que la ", "it was ", "", "he said. ")
    hexes = f"substr(sha1(cast(id as string)), 1, {pick(3, '24', '32', '40', '40')})"
    mixed = "replace(replace(base64(unhex(md5(cast(id as string)))), '=', ''), '+', 'x')"
    wordy = f"concat({pick(4, 'encheingeverlichkeit', 'understanding_of_', 'international-', 'section/paragraph/')}, {d(2, 5)})"
    secret, other = pick(6, 'token = "', "password: ", "api_key=", "secret = '", "Bearer ", "access key: "), pick(7, "commit ", "sha256 checksum ", "build ", "version ", "order no. ")
    phone, dash = pick(8, "phone: ", "call ", "tel. ", "fax ", "mobile "), pick(9, "-", " ", ".")
    us, ssn = f"concat({d(3, 1)}, {dash}, {d(3, 2)}, {dash}, {d(4, 3)})", f"concat({d(3, 1)}, '-', {d(2, 2)}, '-', {d(4, 3)})"
    iban = f"concat({pick(2, 'DE', 'FR', 'ES', 'GB', 'IT')}, {d(2, 3)}, ' ', {d(4, 4)}, ' ', {d(4, 5)}, ' ', {d(4, 6)}, ' ', {d(4, 7)}, ' ', {d(2, 8)})"
    mail = f"concat({pick(1, 'jane.doe', 'info', 'k.meier', 'a_b')}, ' [at] ', {pick(2, 'mail', 'example', 'web')}, {d(1, 3)}, ' [dot] ', {pick(4, 'com', 'org', 'de')})"
    cases = [
        (hexes, f"concat({plain}, {secret})", 1), (mixed, f"concat({plain}, {secret})", 1), (hexes, f"concat({plain}, {other})", 0), (wordy, plain, 0),
        (wordy, f"concat({plain}, {other})", 0), (f"concat('(', {d(3, 1)}, ') ', {d(3, 2)}, '-', {d(4, 3)})", plain, 1), (us, f"concat({plain}, {phone})", 1),
        (f"concat({d(4, 1)}, {dash}, {d(2, 2)}, {dash}, {d(3, 3)})", f"concat({plain}, {other})", 0), (f"concat({d(2, 1)}, '.', {d(3, 2)}, '.', {d(3, 3)})", plain, 0),
        (ssn, pick(10, "ssn: ", "social security no. ", "tax id ", "and "), 1), (ssn, f"concat({plain}, {pick(12, 'part ', 'isbn ', 'order ')})", 0), (us, f"concat({plain}, {other})", 0),
        (iban, plain, 1), (iban, f"concat({plain}, {pick(13, 'part ', 'order ')})", 0), (mail, plain, 1), (f"concat({d(4, 1)}, ' ', {d(4, 2)}, ' ', {d(4, 3)})", plain, 0),
    ]
    case = lambda i: "CASE " + " ".join(f"WHEN id % {len(cases)} = {n} THEN {c[i]}" for n, c in enumerate(cases)) + " END"
    return spark.range(rows).selectExpr("id", f"{case(0)} AS m", f"lower({case(1)}) AS b", f"{case(2)} AS label")


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
    """A regression tree on Newton steps: a leaf value, or (feature, threshold, left, right) with left for <=."""
    leaf = float(-grad.sum() / (hess.sum() + 1.0))
    if depth == 0 or len(x) < 20:
        return leaf
    score = lambda g, h: g * g / (h + 1.0)
    best, all_ = (1e-3, None, None), score(grad.sum(), hess.sum())
    for f in range(x.shape[1]):
        for t in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 12), method="lower")):
            left = x[:, f] <= t
            if 0 < left.sum() < len(x):
                gain = score(grad[left].sum(), hess[left].sum()) + score(grad[~left].sum(), hess[~left].sum()) - all_
                if gain > best[0]:
                    best = (gain, f, float(t))
    if best[1] is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], _tree(x[left], grad[left], hess[left], depth - 1), _tree(x[~left], grad[~left], hess[~left], depth - 1)


def _leaf(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, t, left, right = tree
    return np.where(x[:, f] <= t, _leaf(left, x), _leaf(right, x))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> list:
    margin, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        out.append(_tree(x, p - y, p * (1 - p), DEPTH))
        margin += RATE * _leaf(out[-1], x)
    return out


def calibrated_threshold(margin: np.ndarray, y: np.ndarray) -> float:
    """The smallest margin, 0 at least, above which held-out precision is LEAST_PRECISION or more."""
    order = np.argsort(-margin)
    precision = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.nonzero(precision >= LEAST_PRECISION)[0]
    return max(0.0, float(margin[order][good[-1]])) if len(good) else float("inf")


@functools.cache
def fitted(spark: SparkSession) -> tuple[list, float]:
    """Trees and their threshold; every fourth example is held out for the threshold."""
    made = training_examples(spark)
    rows = made.select("id", "label", *[c.alias(n) for n, c in features(F.col("m"), F.col("b")).items()]).collect()
    data = np.array(rows, dtype=float)
    x, y, held = data[:, 2:], data[:, 1], (data[:, 0] // 16) % 4 == 0
    trees = boost(x[~held], y[~held])
    return trees, calibrated_threshold(sum(RATE * _leaf(t, x[held]) for t in trees), y[held])


def _sql_tree(tree, f: Column, names: list[str]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    k, t, left, right = tree
    return F.when(f[names[k]] <= t, _sql_tree(left, f, names)).otherwise(_sql_tree(right, f, names))


def added_spans(text: Column, model: tuple[list, float]) -> Column:
    """array<struct<s,k,e>> of generated candidates whose margin reaches the threshold."""
    trees, threshold = model

    def selected(x: Column) -> Column:
        cols = features(x["m"], x["b"])
        margin = lambda f: sum((_sql_tree(t, f, list(cols)) for t in trees), start=F.lit(0.0))
        return let(F.struct(*[c.alias(n) for n, c in cols.items()]), margin) * RATE >= threshold

    parts = []
    for kind, pattern in GENERATORS.items():
        number = lambda m: F.when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), KINDS.index("ssn")).otherwise(KINDS.index("phone"))
        chosen = F.filter(spans(text, pattern, text.rlike(GENERATOR_NEEDS[kind])), selected)
        parts.append(_kept(chosen, lambda m: F.lit(True), number if kind == "number" else lambda m: F.lit(KINDS.index(kind))))  # noqa: B023
    return F.concat(*parts)


def _joined(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_private_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, found.

    Null text is empty and has no span. found is the array of (start, kind, end) behind spans; spans of different kinds
    may overlap. Ids may be null or repeat; an empty table gives no rows; further columns are ignored.
    """
    model = fitted(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    d = d.select("doc_id", base_spans(F.col("t")).alias("base"), added_spans(F.col("t"), model).alias("more"))
    d = d.withColumn("more", F.array_except("more", "base")).withColumn("found", F.array_sort(F.concat("base", "more")))
    of = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    counts = [of(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return d.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), F.size("more").cast("long").alias("n_added"), "found")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row of docs, with every character of a span replaced by a full block.

    Each row is redacted where it lies, so ids may be null or repeat. Null text stays null; overlapping spans are
    hidden once; an empty table gives no rows; further columns are ignored.
    """
    model = fitted(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    found = let(text_of("t"), lambda t: F.array_sort(F.concat(base_spans(t), added_spans(t, model))))
    d = d.withColumn("xs", found)
    # start, end and text to the left of each span beyond the ends of those before it
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def hide(acc: Column, x: Column) -> Column:
        start, end = F.greatest(acc["at"], x["s"]), F.greatest(acc["at"], x["e"])
        plain = F.substring(F.col("t"), acc["at"] + 1, start - acc["at"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(plain, F.repeat(F.lit("█"), end - start))).alias("out"))

    hidden = F.aggregate("xs", empty, hide, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("t"), acc["at"] + 1, F.char_length("t"))))
    return d.select("doc_id", F.when(F.size("xs") > 0, hidden).otherwise(F.col("t")).alias("text"))
