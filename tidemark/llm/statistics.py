"""Statistics of whole texts, as Spark columns only.

Words are ``[^\\x20\\x09-\\x0D]+``. Null, empty and wordless texts have zero for every
count and rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WHITE = r"[ \x09-\x0D]+"
WINDOW = 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATES = ["word_length", "symbol_rate", "mark_rate", "upper_rate", "digit_rate", "dup_line_rate", "repeat_rate",
         "adjacent_rate", "variety", "short_rate", "words_per_line"]


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def without(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that ``pattern`` matches, as a count."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _pairs(hashes: Column, apart: int) -> Column:
    """Hashes of each element with the one ``apart`` places later."""
    return let(hashes, lambda h: F.transform(
        F.slice(h, 1, F.greatest(F.size(h) - apart, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + apart))))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows that occur twice or more in the text, the first occurrence included.

    ``window`` is a power of two. Windows are compared by 64-bit hashes, each made of those of its halves. Only a text with a repeated window sorts them.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    n = 1
    while n < window:
        hashes = _pairs(hashes, n)
        n *= 2

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(placed, lambda s: F.filter(s, lambda x, k: (
            F.when(k > 0, F.get(s, k - 1)["h"] == x["h"]).otherwise(False)
            | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))))
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        # a window adds what the window before it has not covered
        return let(starts, lambda at: F.aggregate(
            F.transform(at, lambda p, k: F.when(k == 0, F.lit(window)).otherwise(F.least(F.lit(window), p - F.get(at, k - 1)))),
            F.lit(0), lambda n, x: n + x))

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))


def measure(docs: DataFrame, text: str, keep: list[str], into: str = "stats") -> DataFrame:
    """The columns ``keep`` and a struct ``into`` of all statistics; the counts are whole numbers."""
    words = F.filter(F.split(F.col("__text"), WHITE), lambda w: w != "")
    lines = F.filter(F.split(F.col("__text"), "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    base = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    base = base.select(*keep, "__text", words.alias("__words"), lines.alias("__lines"))
    w, t = F.col("__words"), F.col("__text")
    raw = base.select(
        *keep,
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        without(t, r"[#*$%&|<>]+").cast("bigint").alias("n_symbols"),
        F.size("__lines").cast("bigint").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(w).cast("bigint").alias("n_repeat_words"),
        without(t, r"[!?]+").alias("__marks"),
        without(t, r"\p{Lu}+").alias("__upper"),
        without(t, r"[0-9]+").alias("__digits"),
        F.size(F.array_distinct(w)).alias("__distinct"),
        F.size(F.filter(w, lambda x, k: F.when(k > 0, x == F.get(w, k - 1)).otherwise(False))).alias("__adjacent"),
        F.size(F.filter(w, lambda x: F.length(x) <= 3)).alias("__short"))
    per_word = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n_words")), F.lit(0.0))
    per_char = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("word_chars")), F.lit(0.0))
    rates = {
        "word_length": per_word("word_chars"), "symbol_rate": per_char("n_symbols"), "mark_rate": per_char("__marks"),
        "upper_rate": per_char("__upper"), "digit_rate": per_char("__digits"),
        "dup_line_rate": F.coalesce(F.try_divide(F.col("n_dup_lines"), F.col("__n_lines")), F.lit(0.0)),
        "repeat_rate": per_word("n_repeat_words"), "adjacent_rate": per_word("__adjacent"), "variety": per_word("__distinct"),
        "short_rate": per_word("__short"), "words_per_line": F.coalesce(F.try_divide(F.col("n_words"), F.col("__n_lines")), F.lit(0.0)),
    }
    return raw.select(*keep, F.struct(*[F.col(c) for c in COUNTS], *[v.alias(k) for k, v in rates.items()]).alias(into))
