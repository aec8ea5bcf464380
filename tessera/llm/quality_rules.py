"""Line-first cleaning: rules judge single lines, failing lines go, and a document that
loses too much of its text is rejected. Built-in expressions only; no shuffle.

Defined results: a null text counts as empty; an empty text has no words and fails the
base rule; repeated rows are judged one by one; an empty table gives an empty table;
other columns pass through (columns of the same names as results are replaced).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATOR_CLASS, let, text_of

SYMBOLS = "[#*$%&|<>]"
#: A line of prose ends like this; closing quotes, brackets and space may follow.
LINE_END = "[.!?:;…。！？][\"'”’»)\\]\\x20\\x09-\\x0D]*\\z"
WORDED = r"[^\x20\x09-\x0D]"
#: Three of these make a line navigation; so does a line of nothing but a site's own words.
NAVIGATION_MARKS = "^(?:[^|»›]*+[|»›]){3}"
NAVIGATION_LINE = r"^\W*(?:home|menu|next|previous|back|log ?in|log ?out|sign ?(?:in|up)|search|share|read more|click here|contact(?: us)?|about(?: us)?|skip to content)\W*\z"
BOILERPLATE = (
    "all rights reserved", "copyright", "licensed under", "licenced under", "terms of use", "terms of service", "privacy policy",
    "cookie", "javascript", "lorem ipsum", "subscribe to", "newsletter", "powered by",
)


def line_verdicts(text: Column, symbol_share: float = 0.1) -> Column:
    """array<struct<line,words_lost,failed>> in order; lines without a word never fail."""

    def judge(line):
        failed = line.rlike(WORDED) & (
            ~line.rlike(LINE_END)
            | line.rlike(NAVIGATION_MARKS)
            | (F.regexp_count(line, F.lit(SYMBOLS)) > symbol_share * F.length(line))
            | let(F.lower(line), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in BOILERPLATE], low.rlike(NAVIGATION_LINE)))
        )
        return let(
            failed,
            lambda bad: F.struct(line.alias("line"), F.when(bad, F.size(words_of(line))).otherwise(F.lit(0)).alias("words_lost"), bad.alias("failed")),
        )

    return F.transform(F.split(text, "\n", -1), judge)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATOR_CLASS + "+", -1), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more.

    Hashes with their positions are sorted to find windows that may repeat; only those
    are then compared as strings, so the count is exact and costs O(n log n) for any text.
    """
    place = (1 << 30) - 1

    def window(w, i):
        return F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def near(sorted_keys, same):
        return F.filter(
            sorted_keys,
            lambda x, j: F.coalesce(same(x, F.get(sorted_keys, j - 1)), F.lit(False))
            | F.coalesce(same(x, F.get(sorted_keys, j + 1)), F.lit(False)),
        )

    def exact(w, hashed):
        keys = F.sort_array(
            F.transform(
                hashed,
                lambda h: F.concat(window(w, h.bitwiseAND(place).cast("int")), F.lit("\t"), F.lpad(h.bitwiseAND(place).cast("string"), 10, "0")),
            )
        )
        repeated = let(keys, lambda k: near(k, lambda x, y: F.substring_index(x, "\t", 1) == F.substring_index(y, "\t", 1)))
        starts = F.transform(repeated, lambda k: F.substring_index(k, "\t", -1).cast("int"))
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))

    def count(w):
        hashes = F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(~place).bitwiseOR(i.cast("long")),
            )
        )
        alike = lambda x, y: F.shiftright(x, 30) == F.shiftright(y, 30)
        pairs = lambda h: F.exists(F.transform(h, lambda x, j: alike(x, F.get(h, j + 1))), lambda v: v)
        return let(hashes, lambda h: F.when(F.coalesce(pairs(h), F.lit(False)), let(near(h, alike), lambda c: exact(w, c))).otherwise(F.lit(0)))

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(count(w))).cast("long")


def measure(df: DataFrame, text_column: str = "text", max_lost: float = 0.5, symbol_share: float = 0.1) -> DataFrame:
    """df with the rule metrics, the cleaned text and the verdict.

    kept: the base rule holds and the failing lines hold at most max_lost of the words.
    """
    text = text_of(df, text_column)
    worded = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORDED))
    out = df.withColumns(
        {
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "_facts": let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"), F.length(F.array_join(w, "")).cast("long").alias("c"))),
            "_lines": line_verdicts(text, symbol_share),
        }
    )
    out = out.withColumns(
        {
            "n_words": F.col("_facts.n"),
            "word_chars": F.col("_facts.c"),
            "n_repeat_words": F.col("_facts.r"),
            "n_lines_removed": F.size(F.filter("_lines", lambda x: x["failed"])).cast("long"),
            "n_words_removed": F.aggregate("_lines", F.lit(0), lambda a, x: a + x["words_lost"]).cast("long"),
            "cleaned": F.array_join(F.transform(F.filter("_lines", lambda x: ~x["failed"]), lambda x: x["line"]), "\n"),
        }
    ).drop("_facts", "_lines")
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words_removed") <= max_lost * F.col("n_words")))
