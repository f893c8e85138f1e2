"""Line-first cleaning: rules per line, failing lines go, documents that lose too much text are rejected.

Everything is an expression over one row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_of

#: What site furniture says in a line of its own, lower case, in English, German, French and Spanish.
ALONE = [
    "sign in", "log in", "click here", "read more", "learn more", "follow us", "back to top", "skip to content", "share on facebook", "share on twitter",
    "privacy policy", "terms of use", "terms of service", "all rights reserved",
    "anmelden", "einloggen", "hier klicken", "weiterlesen", "mehr erfahren", "folgen sie uns", "nach oben", "zum inhalt springen", "datenschutz", "impressum", "nutzungsbedingungen",
    "se connecter", "connexion", "cliquez ici", "lire la suite", "en savoir plus", "suivez-nous", "haut de page", "aller au contenu", "mentions légales", "conditions d'utilisation",
    "iniciar sesión", "haga clic aquí", "leer más", "seguir leyendo", "síguenos", "volver arriba", "saltar al contenido", "aviso legal", "política de privacidad", "condiciones de uso",
]
#: Phrases that make any line that holds them site furniture, as whole words, lower case.
WITHIN = [
    "accept cookies", "accept all cookies", "cookie policy", "enable javascript", "javascript is disabled", "lorem ipsum", "subscribe to our newsletter",
    "cookies akzeptieren", "javascript aktivieren", "abonnieren sie unseren newsletter",
    "accepter les cookies", "activer javascript", "abonnez-vous à notre newsletter",
    "aceptar cookies", "activar javascript", "suscríbete a nuestro boletín",
]
#: Characters that count as symbols, and the end of a sentence or clause.
SYMBOLS = "[#*$%&|<>]"
TERMINAL = r"[.!?:;…。！？][\x22')\]»”’]*([\x20\x09-\x0D]|\z)"
#: A line keeps its place if at most this share of its characters are symbols or repeated exclamation marks.
MAX_SYMBOL_SHARE = 0.08
#: Separators of items that make a line navigation.
SEPARATORS = r"[|»›•·]|\x20>\x20"
#: A document may lose this share of its word characters.
MAX_LOST = 0.4


def _or(words: list[str]) -> str:
    return "|".join(words)


def _by_letter(words: list[str]) -> str:
    """The same alternatives, grouped by their first letter, which the matcher turns down at once."""
    firsts = sorted({w[0] for w in words})
    return "|".join(f"{c}(?:{_or([w[1:] for w in words if w[0] == c])})" for c in firsts)


#: Patterns over a line in lower case.
ALONE_LINE = rf"^[^\p{{L}}]*({_or(ALONE)})[^\p{{L}}]*$"
WITHIN_LINE = rf"(^|[^\p{{L}}])({_or(WITHIN)})([^\p{{L}}]|$)"
#: Over a whole text: whether a line may be furniture at all.
ANYWHERE = rf"(?<!\p{{L}})(?:{_by_letter([*ALONE, *WITHIN])})(?!\p{{L}})"
#: Over a line: whether there is anything to count.
MARKED = SYMBOLS[:-1] + r"»›•·]|!!"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_lines, n_lines_removed, chars_removed, clean_text.

    A line (\\n-split, with a word) fails on punctuation (no mark that ends a sentence or clause, or too many symbols or
    doubled exclamation marks), navigation (two or more item separators) or boilerplate (a listed phrase as the whole
    line or, for unmistakable ones, as whole words anywhere in it). clean_text has the other lines. The verdict rejects documents whose failing lines hold more than max_lost of the word
    characters. Null text has no words and fails the base rules, as empty text does. Ids may be null or repeat; an
    empty table gives no rows; further columns are ignored.
    """
    word = F.lit(WORD)
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    d = d.select(
        "doc_id", "t", F.regexp_extract_all("t", word, F.lit(0)).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    bare = lambda x: F.char_length(F.regexp_replace(x, r"[\x20\x09-\x0D]+", ""))
    counted = lambda x: (F.regexp_count(x, F.lit(SYMBOLS + "|!!")) > MAX_SYMBOL_SHARE * F.char_length(x)) | (F.regexp_count(x, F.lit(SEPARATORS)) >= 2)
    furniture = lambda x: F.lower(x).rlike(ALONE_LINE) | F.lower(x).rlike(WITHIN_LINE)
    bad = lambda x, whole: ~x.rlike(TERMINAL) | (whole["marked"] & x.rlike(MARKED) & counted(x)) | (whole["furnished"] & furniture(x))
    # texts without a mark or phrase, nearly all, are not searched for them line by line; as elements of an array the two
    # findings are made once a text, where a column would be worked out anew for every line
    whole = F.array(F.struct(F.lower("t").rlike(ANYWHERE).alias("furnished"), F.col("t").rlike(MARKED).alias("marked"), F.col("lines").alias("lines")))
    stay = F.get(F.transform(whole, lambda s: F.filter(s["lines"], lambda x: ~bad(x, s))), 0)
    d = d.select(
        "doc_id",
        "w",
        "lines",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))).alias("windows"),
        stay.alias("stay"),
    )
    d = d.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _covered("windows", "w")).otherwise(F.lit(0)).cast("long"))
    d = d.withColumn("chars_removed", F.col("word_chars") - bare(F.array_join("stay", "")).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("chars_removed") <= max_lost * F.col("word_chars"))).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("stay")).cast("long").alias("n_lines_removed"),
        "chars_removed",
        F.array_join("stay", "\n").alias("clean_text"),
    )


def _covered(windows: str, words: str):
    """Words that lie in a three-word window occurring twice or more. windows: their 64-bit hashes in order, sorted here so
    that equal ones are neighbours. Neighbours with one hash are compared word by word; should two windows of different
    words ever share a hash, the text's windows are sorted by their words themselves."""
    at = lambda i: [F.get(words, i + k) for k in range(3)]
    by_hash = F.transform(windows, lambda h, i: F.struct(h.alias("g"), i.alias("i")))
    by_words = F.transform(windows, lambda h, i: F.struct(F.array(*at(i)).alias("g"), i.alias("i")))

    def repeated(pairs):
        same = lambda s, k, x: F.coalesce(F.get(s, k)["g"] == x["g"], F.lit(False))
        return F.flatten(F.transform(F.array(F.sort_array(pairs)), lambda s: F.filter(s, lambda x, k: same(s, k - 1, x) | same(s, k + 1, x))))

    def size(twice):
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def clash(twice):
        differ = lambda i, j: ~(F.array(*at(i)) == F.array(*at(j)))
        before = lambda k: F.get(twice, k - 1)
        return F.size(F.filter(twice, lambda x, k: F.coalesce((before(k)["g"] == x["g"]) & differ(before(k)["i"], x["i"]), F.lit(False)))) > 0

    counted = F.transform(F.array(repeated(by_hash)), lambda twice: F.when(clash(twice), size(repeated(by_words))).otherwise(size(twice)))
    return F.get(counted, 0)
