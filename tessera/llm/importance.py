"""Importance resampling: documents drawn to look like a target.

Features of a text are its words and its pairs of neighbouring words, counted in hashed
buckets. A bucket's gain is the log-ratio of its shares in the target and in all documents; a
document weighs the mean gain of its features. Gumbel noise made from a hash of the id turns
the highest scores into a draw without replacement (the log-weights' softmax). The buckets
come from a byte automaton run on Arrow buffers (automaton.py); a pass counts, another weighs,
and the driver holds only the buckets' counts. Places in the draw come from ranges of the scores.

Defined results: a null text has no words; a null id is hashed as an empty one and comes
before others among ties; rows alike in score and id are ranked in any order; an empty table
gives an empty table, an empty target is all zeros; columns of the caller pass through but for
the text (those named like results are replaced). Texts are read a stretch at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.order import numbered
from .automaton import START, advance, byte_classes, pushed, words
from .common import small_batches, stored

# Fixed values of the contract: bytes of words, buckets, least words of a drawn document, share drawn in percent, seed.
WORD_BYTES = [(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)]
BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
CLASSES = byte_classes(WORD_BYTES)
RESULTS = ["n_features", "n_words", "weight", "score", "rank"]


def feature_buckets(texts: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, bucket) of each feature and how many of them (first in the arrays) are single words, a stretch at a time."""
    last_row, last = -1, START
    for found in words(texts, CLASSES):
        alone = advance(np.full(len(found.starts), START, dtype=np.uint32), found)
        before = np.concatenate([[last], alone[:-1]]).astype(np.uint32)
        follows = np.flatnonzero(found.rows == np.concatenate([[last_row], found.rows[:-1]]))
        paired = advance(pushed(before[follows], 0x20), found, follows)
        yield np.concatenate([found.rows, found.rows[follows]]), (np.concatenate([alone, paired]) ^ START) % np.uint32(buckets), len(alone)
        last_row, last = found.rows[-1], alone[-1]


def bucket_counts(df: DataFrame, text_column: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket; a row for each bucket reaches the driver."""

    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, own, _ in feature_buckets(batch.column(0), buckets):
                total += np.bincount(own, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    small_batches(df.sparkSession)
    out = np.zeros(buckets, dtype=np.int64)
    for r in df.select(text_column).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of nats by which each bucket is likelier in the target, rounded down."""
    n = len(source)
    t_all, s_all = float(int(target.sum()) + n), float(int(source.sum()) + n)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for t, s in zip(target, source)], dtype=np.int64)


def draw_hash(doc_id: Column, seed: int = SEED) -> Column:
    """The first 32 bits of sha256('seed:id')."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def weighed(df: DataFrame, gain: np.ndarray, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED) -> DataFrame:
    """n_features, n_words, weight and score of each row, its id as doc, and its columns but the text as the struct given."""
    rest = [F.col(c) for c in df.columns if c != text_column and c not in RESULTS]
    rows = df.select(F.col(text_column).alias("text"), draw_hash(F.col(id_column), seed).alias("hash"), F.col(id_column).alias("doc"), F.struct(*rest).alias("given"))
    names = ["n_features", "n_words", "weight", "score"]
    buckets = len(gain)

    def weigh(batches):
        for batch in batches:
            n = batch.num_rows
            n_words, n_features, total = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for row, own, single in feature_buckets(batch.column(0), buckets):
                lo, hi = int(row[0]), int(row[single - 1]) + 1
                n_words[lo:hi] += np.bincount(row[:single] - lo, minlength=hi - lo)
                for at, part in ((row[:single], own[:single]), (row[single:], own[single:])):  # each in order of rows
                    if len(at):
                        first = np.flatnonzero(np.diff(at, prepend=-1))
                        total[at[first]] += np.add.reduceat(gain[part], first)
                        n_features[at[first]] += np.diff(first, append=len(at))
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in batch.column(1).to_pylist()]
            columns = [n_features, n_words, weight, weight + np.array(noise, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns] + batch.columns[2:], names=[*names, "doc", "given"])

    small_batches(df.sparkSession)
    return rows.mapInArrow(weigh, StructType([StructField(c, LongType()) for c in names] + rows.schema.fields[2:]))


def resample(df: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """df without its text, with n_features, n_words, weight, score and rank.

    rank: 1, 2, 3... over the drawn rows, highest score first, then the smaller id; null for
    others. Drawn are percent of the rows with min_words words or more.
    """
    gain = gains(bucket_counts(target, text_column), bucket_counts(df, text_column))
    facts = stored(weighed(df, gain, id_column, text_column, seed), "importance")
    enough = F.col("n_words") >= min_words
    drawn = percent * facts.where(enough).count() // 100
    placed = numbered(facts.where(enough), [F.col("score").desc(), F.col("doc"), F.col("weight"), F.col("n_features")], "place")
    every = placed.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("place").unionByName(facts.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return every.select("given.*", *RESULTS)
