"""Secrets in texts: fixed patterns, and strings that a Markov model calls random.

Two character models of order one, over the same alphabet, are trained from labelled
samples: random strings (made from digests in the alphabets that keys are written in) and
ordinary identifiers (the words of all documents, and neighbours joined as in names). What may
be judged, any long run of key characters, is no sample, so that secrets without a label do
not teach the model that they are names; a word weighs by the logarithm of its count, so that
neither copies of a document nor strings that occur once outweigh the rest. A candidate token
is a secret when the log-likelihood ratio of the models is above a threshold. The models are
tables of 65 x 65 numbers, which is all that reaches the driver and goes back in the plan.
Built-in expressions only; no shuffle but the training counts: of each different word, and of
each pair of characters that neighbours meet with.

Defined results: a null text counts as empty and has no spans; repeated rows get the same
spans; an empty table gives an empty table; other columns pass through (columns named like
results are replaced).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, match_spans, numbers, ordered_spans, replaced, stored, text_of

# Fixed values of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"  # maximal runs, so the shorter ones need not be matched first
HEX = "[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "markov"]

#: What the method looks at: long runs of key characters.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
OTHER = len(ALPHABET)
SIDE = OTHER + 1
#: Labelled rows the models are fitted on.
RANDOM_STRINGS = 4096
#: Nats by which the random model must win, in all and for each character.
MIN_RATIO = 12.0
MIN_RATIO_PER_CHARACTER = 0.45
#: Weight of single-character frequencies in a row of the models, in characters.
BACK_OFF = 10.0


def base_spans(text: Column) -> Column:
    long_value = lambda value: F.length(F.regexp_extract(value, ASSIGN, 2)) >= 12
    return F.concat(
        match_spans(text, ASSIGN, "assign", long_value), match_spans(text, ACCESS, "access"), match_spans(text, HEX, "hex")
    )


def _bigrams(token: Column) -> Column:
    """array<int>: SIDE * code of a character + code of the next."""
    # array literals are folded, so nothing here is evaluated again for each character
    code = numbers([ALPHABET.find(chr(b)) if chr(b) in ALPHABET else OTHER for b in range(128)], "int")
    codes = F.transform(F.split(token, ""), lambda c: F.coalesce(F.get(code, F.ascii(c)), F.lit(OTHER)))
    pairs = lambda own: F.transform(F.sequence(F.lit(0), F.greatest(F.size(own) - 2, F.lit(0))), lambda i: F.get(own, i) * SIDE + F.coalesce(F.get(own, i + 1), F.lit(OTHER)))
    return let(codes, pairs)


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """token: digests of counters, written in base64, base64url, capitals with digits, and hex."""
    digest = F.unhex(F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")), 256))
    b64 = F.regexp_replace(F.base64(digest), "=", "")
    return spark.range(n).select(
        F.when(F.col("id") % 4 == 0, b64)
        .when(F.col("id") % 4 == 1, F.translate(b64, "+/", "-_"))
        .when(F.col("id") % 4 == 2, F.upper(F.regexp_replace(b64, "[+/]", "")))
        .otherwise(F.lower(F.hex(digest)))
        .alias("token")
    )


#: Whole words that are no longer than words are.
WORD = "(?<![A-Za-z0-9])[A-Za-z0-9]{2,15}(?![A-Za-z0-9])"
#: How names join their words.
JOINTS = ["_", "-", "/", ""]
_EDGE = "\t"


def identifiers(df: DataFrame, text_column: str = "text") -> DataFrame:
    """(token, n): whole words of all documents and their weights; and the ends of neighbours, joined in each way names are.

    What the fixed patterns find and all candidates are cut out first. Neighbours weigh as much
    in all as the words they are of.
    """
    sample = df.select(text_of(df, text_column).alias("t"))
    clean = F.regexp_replace(F.regexp_replace(F.col("t"), ASSIGN, " "), f"{CANDIDATE}|{ACCESS}|{HEX}", " ")
    words = F.regexp_extract_all(clean, F.lit(WORD), F.lit(0))
    edges = lambda w: F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(F.lit(_EDGE), F.right(F.get(w, i), F.lit(1)), F.left(x, F.lit(1))))
    counted = sample.select(F.explode(let(words, lambda w: F.concat(w, edges(w)))).alias("token")).groupBy("token").agg(F.count("*").cast("double").alias("n"))
    is_edge, weight = F.startswith("token", F.lit(_EDGE)), 1 + F.ln("n")
    both = stored(counted, "identifiers")
    totals = both.where(~is_edge).agg(F.sum(weight).alias("weight"), F.sum("n").alias("n")).first()
    share = (totals["weight"] or 0.0) / (totals["n"] or 1.0)
    a, b = F.substring("token", 2, 1), F.substring("token", 3, 1)
    joined = F.transform(F.array(*[F.lit(j) for j in JOINTS]), lambda j: F.concat(a, j, b))
    token = F.when(is_edge, joined).otherwise(F.array("token"))
    return both.select(F.explode(token).alias("token"), F.when(is_edge, F.col("n") * share / len(JOINTS)).otherwise(weight).alias("n"))


def train(positive: DataFrame, negative: DataFrame) -> list[float]:
    """The log-likelihood ratio of each bigram as SIDE * SIDE numbers; rare ones lean on the frequency of their second character.

    positive, negative: token and n, the weight of the token (1 without that column).
    """
    weight = lambda df: F.col("n") if "n" in df.columns else F.lit(1.0)
    counted = (
        positive.select("token", weight(positive).alias("n"), F.lit(1).alias("label"))
        .unionByName(negative.select("token", weight(negative).alias("n"), F.lit(0).alias("label")))
        .select("label", "n", F.explode(_bigrams(F.col("token"))).alias("bigram"))
        .groupBy("label", "bigram")
        .agg(F.sum("n").alias("n"))
        .collect()  # at most 2 * SIDE * SIDE rows
    )
    counts = {0: [0.0] * (SIDE * SIDE), 1: [0.0] * (SIDE * SIDE)}
    for r in counted:
        counts[r["label"]][r["bigram"]] += r["n"]
    logs = []
    for label in (1, 0):
        n = counts[label]
        single = [1.0 + sum(n[b::SIDE]) for b in range(SIDE)]
        whole = sum(single)
        logs.append(
            [
                math.log((n[a * SIDE + b] + BACK_OFF * single[b] / whole) / (sum(n[a * SIDE : (a + 1) * SIDE]) + BACK_OFF))
                for a in range(SIDE)
                for b in range(SIDE)
            ]
        )
    return [p - q for p, q in zip(*logs, strict=True)]


def log_ratio(token: Column, model: list[float]) -> Column:
    table = numbers([round(x, 6) for x in model], "double")
    return F.aggregate(_bigrams(token), F.lit(0.0), lambda a, b: a + F.get(table, b))


def markov_spans(text: Column, model: list[float], min_ratio: float = MIN_RATIO, per_character: float = MIN_RATIO_PER_CHARACTER) -> Column:
    def random(token):
        return log_ratio(token, model) >= F.greatest(F.lit(min_ratio), per_character * F.length(token))

    return match_spans(text, CANDIDATE, "markov", random)


def scan(df: DataFrame, text_column: str = "text", model: list[float] | None = None) -> DataFrame:
    """df with spans: array<struct<start,rank,end,kind,value>>, by start and then kind."""
    if model is None:
        model = train(random_strings(df.sparkSession), identifiers(df, text_column))
    text = text_of(df, text_column)
    return df.withColumn("spans", ordered_spans(F.concat(base_spans(text), markov_spans(text, model)), KINDS))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every stretch that spans cover replaced by mark; spans are sorted by start."""
    return replaced(text, spans, lambda s: F.lit(mark))
