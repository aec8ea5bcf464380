"""A quality classifier on graded ratings: ordinal cumulative-link regression on hashed text.

All grades share one weight for each hashed feature; ordered thresholds part the grades:
P(grade > k) = logistic(w.x - threshold[k]). Selection is by the expected grade or by the
probability of a top grade. Fitted on a bounded sample of labelled rows (MAX_LABELLED);
applied to whole texts of all rows.

Grades: 0 toxic, 1 poor, 2 good. Features: words and runs of signs in lower case, each
counted once for each document they occur in, so that a few words in a long text weigh as
much as in a short one; and how much of the text repeats itself.

Defined results: a null text counts as empty; an empty text scores by the thresholds
alone; documents labelled twice count twice; a label whose document id is null or has no
document is not used, nor is one that says neither toxic nor what quality; where several
documents have a label's id, one of them (by the hash of its text) is used; without labels of
two grades every document is kept with a null grade; an empty table gives an empty table;
other columns pass through (columns named like results are replaced).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BUCKETS = 1 << 20
#: Labelled rows used for fitting: those with the least hashes of their ids. Scoring reads all rows.
MAX_LABELLED = 8000
GRADES = 3
MIN_TAIL = 0.5
_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")
_SPACE = re.compile(r"\s")
#: Characters of a text taken apart at once.
STRETCH = 1 << 20


def features(text: str | None) -> np.ndarray:
    """Sorted hashed features, each once."""
    text = (text or "").lower()
    kinds, n, same, last = set(), 0, 0, None
    at = 0
    while at < len(text):  # a stretch at a time, cut where no token can be
        space = _SPACE.search(text, at + STRETCH)
        end = space.end() if space else len(text)
        tokens = _TOKEN.findall(text, at, end)
        if tokens:
            kinds.update(tokens)
            n += len(tokens)
            same += (tokens[0] == last) + sum(map(str.__eq__, tokens, tokens[1:]))
            last = tokens[-1]
        at = end
    # how many tokens repeat the one before, in steps of a tenth; how many are new
    facts = [f"same={10 * same // max(1, n)}", f"new={10 * len(kinds) // max(1, n) if n < 200 else 'long'}"]
    return np.unique(np.fromiter((zlib.crc32(x.encode()) % BUCKETS for x in (*kinds, *facts)), dtype=np.int64))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class OrdinalModel:
    def __init__(self, index: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.index, self.weights, self.thresholds = index, weights, thresholds

    def score(self, sets: list[np.ndarray]) -> np.ndarray:
        """w.x for each set of features."""
        dense = np.zeros(BUCKETS, dtype=np.float32)
        dense[self.index] = self.weights
        return np.array([dense[s].sum(dtype=np.float64) for s in sets])

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        return logistic(score[:, None] - self.thresholds[None, :])


def fit(sets: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES, steps: int = 300, rate: float = 0.5, l1: float = 1.5e-3, min_documents: int = 4) -> OrdinalModel:
    """Proximal gradient with momentum on the cumulative-link likelihood, weights under an L1 penalty."""
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
    seen = np.bincount(flat, minlength=BUCKETS)
    index = np.flatnonzero(seen >= min_documents)
    place = np.full(BUCKETS, -1)
    place[index] = np.arange(len(index))
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    col = place[flat]
    row, col = row[col >= 0], col[col >= 0]
    n = len(sets)
    above = np.stack([grades > k for k in range(n_grades - 1)], axis=1).astype(float)
    share = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    thresholds = -np.log(share / (1 - share))
    # a document's step is scaled by how rare a feature is, so that rare telling words move at all
    scale = 1 / np.sqrt(np.maximum(seen[index], 1) / n)
    w, look, last = np.zeros(len(index)), np.zeros(len(index)), 1.0
    reach = max(1.0, float(np.percentile(np.bincount(row, weights=scale[col] ** 2 * (seen[index][col] / n), minlength=n), 90)))
    for _ in range(steps):
        score = np.bincount(row, weights=(look * scale)[col], minlength=n)
        p = logistic(score[:, None] - thresholds)
        lo = np.concatenate([np.ones((n, 1)), p], axis=1)
        hi = np.concatenate([p, np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        mass = np.maximum(lo[at, grades] - hi[at, grades], 1e-9)
        slope = lambda q: q * (1 - q)
        pull = (slope(lo[at, grades]) - slope(hi[at, grades])) / mass
        grad_w = -np.bincount(col, weights=pull[row], minlength=len(index)) * scale / n
        grad_t = np.zeros(n_grades - 1)
        for k in range(n_grades - 1):
            grad_t[k] = (np.where(grades == k + 1, slope(p[:, k]) / mass, 0) - np.where(grades == k, slope(p[:, k]) / mass, 0)).sum() / n
        step = rate * 4 / reach * 10
        new = look - step * grad_w
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        after = (1 + np.sqrt(1 + 4 * last**2)) / 2
        look = new + (last - 1) / after * (new - w)
        w, last = new, after
        thresholds = np.sort(thresholds - rate * grad_t)
    used = w != 0
    return OrdinalModel(index[used], (w * scale)[used].astype(np.float32), thresholds)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> OrdinalModel | None:
    """Fit on at most max_labelled labelled documents, chosen by the hash of their ids."""
    small_batches(docs.sparkSession)
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality").isNotNull(), 1 + F.col("quality"))
    graded = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("int").alias("grade")).where("grade IS NOT NULL AND doc_id IS NOT NULL")
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(max_labelled).withColumn("label", F.monotonically_increasing_id())
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most max_labelled small rows
    one = joined.groupBy("label").agg(F.first("grade").alias("grade"), F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"grade": b["grade"], "features": [features(t).astype("<i4").tobytes() for t in b["text"]]})

    rows = one.select("grade", "text").mapInPandas(run, "grade int, features binary").collect()  # at most max_labelled
    if not rows or len({r["grade"] for r in rows}) < 2:
        return None
    return fit([np.frombuffer(r["features"], "<i4").astype(np.int64) for r in rows], np.array([r["grade"] for r in rows]))


def classify(docs: DataFrame, labels: DataFrame, min_tail: float = MIN_TAIL, model: OrdinalModel | None = None) -> DataFrame:
    """docs with expected_grade, top_probability (of grade 2) and kept."""
    model = model or train(docs, labels)
    small_batches(docs.sparkSession)
    docs = docs.drop("expected_grade", "top_probability", "kept")
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(None).cast("double"), "top_probability": F.lit(None).cast("double"), "kept": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast((model.index, model.weights, model.thresholds))  # bounded by BUCKETS

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = OrdinalModel(*shared.value)
        for texts in batches:
            tails = own.tails(own.score([features(t) for t in texts]))
            yield pd.DataFrame({"expected": tails.sum(axis=1), "top": tails[:, -1]})

    verdict = F.pandas_udf(scored, "expected double, top double")
    out = docs.withColumn("_v", verdict(F.col("text")))
    return out.withColumns({"expected_grade": F.col("_v.expected"), "top_probability": F.col("_v.top")}).withColumn("kept", F.col("top_probability") >= min_tail).drop("_v")
