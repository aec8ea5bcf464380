"""Benchmark passages in documents, found within an error budget.

Each test item of n characters has a budget of about n / PIECE edits and is split into one
piece more than that: if a document holds the item with at most that many edits, at least
one piece stands in it unchanged (pigeonhole). An automaton over all pieces finds exact
hits in one pass of each text; around a hit, Myers' bit-parallel algorithm gives the least
edit distance of the item to any substring. Texts are compared in lower case with every
white-space character as a space.

Items are taken in blocks of at most BLOCK_CHARACTERS, which bounds what the driver holds and
sends to each task; every block is held against all documents, in a pass of its own. Defined
results: null or empty texts hold nothing; null or empty items are in nothing; an item with a
null id is reported with a null id; rows with a null id are reported with a null id; repeated
rows give repeated results; an empty table gives an empty table; other columns of documents are
not carried.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Characters of a piece at least; shorter items must stand in a text unchanged.
PIECE = 12
BLOCK_CHARACTERS = 16_000_000
_SPACES = "\t\n\x0b\x0c\r"


def plain(text: str) -> str:
    lower = text.lower()
    # keep places: a letter whose lower case is longer stays as it is
    if len(lower) != len(text):
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for c in _SPACES:
        lower = lower.replace(c, " ")
    return lower


def budget(item: str, piece: int = PIECE) -> int:
    return max(0, len(item) // piece - 1)


def pieces(item: str, piece: int = PIECE) -> list[tuple[int, str]]:
    """budget + 1 pieces that together are the item, with their places."""
    n = budget(item, piece) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(item: str, text: str, most: int, known: dict[str, int] | None = None) -> tuple[int, int] | None:
    """(least distance of item to a substring of text, first end of such a one), or None if above most."""
    known = known or masks(item)
    n = len(item)
    high, full = 1 << (n - 1), (1 << n) - 1
    up, down, score, best = full, 0, n, None
    for end, c in enumerate(text, 1):
        same = known.get(c, 0)
        cross = (((same & up) + up) ^ up) | same | down
        plus = down | ~(cross | up) & full
        minus = up & cross
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        # the text may begin anywhere: row zero stays 0
        plus, minus = plus << 1 & full, minus << 1 & full
        vertical = same | down
        up = minus | ~(vertical | plus) & full
        down = plus & vertical
        if score <= most and (best is None or score < best[0]):
            best = (score, end)
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], piece: int = PIECE):
        import ahocorasick

        self.items = [(i, plain(t)) for i, t in items if t]
        self.masks: dict[int, dict[str, int]] = {}
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item) in enumerate(self.items):
            for at, part in pieces(item, piece):
                where.setdefault(part, []).append((k, at))
        for part, places in where.items():
            self.automaton.add_word(part, (len(part), places))
        self.budget = [budget(item, piece) for _, item in self.items]
        if where:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(number of the item, distance, end) of the best place of each item that text holds."""
        if not text or not self.items:
            return []
        text = plain(text)
        spans: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for k, at in places:
                begin = last + 1 - size - at
                reach = self.budget[k]
                spans.setdefault(k, []).append([max(0, begin - reach), min(len(text), begin + len(self.items[k][1]) + reach)])
        out = []
        for k, found in spans.items():
            item = self.items[k][1]
            known = self.masks.setdefault(k, masks(item))
            found.sort()
            joined = [found[0]]
            for a, b in found[1:]:
                if a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            best = None
            for a, b in joined:
                hit = myers(item, text[a:b], self.budget[k], known)
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], a + hit[1])
            if best:
                out.append((k, *best))
        return out


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARACTERS) -> Iterator[list[tuple[int, str]]]:
    """The items, a bounded block at a time."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL AND text <> ''").toLocalIterator():
        if held and size + len(r["text"]) > most:
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if held:
        yield held


_matchers: dict[str, Matcher] = {}


def _matcher(key: str, shared, piece: int) -> Matcher:
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(shared.value, piece)
    return _matchers[key]


def leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", piece: int = PIECE) -> DataFrame:
    """(doc_id, item_id, distance, end_at, item_length): each document with each item that it holds."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = "doc_id long, item_id long, distance int, end_at long, item_length int"
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    out = spark.createDataFrame([], schema)
    for n, items in enumerate(blocks(benchmark)):
        shared = spark.sparkContext.broadcast(items)  # bounded by BLOCK_CHARACTERS

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            # worker processes are used again, so a block's automaton is built once in each
            own = _matcher(key, shared, piece)
            ids, sizes = zip(*((i, len(t)) for i, t in own.items)) if own.items else ((), ())
            for b in batches:
                hits = [(row, *hit) for row, t in enumerate(b.column(1)) for hit in own.find(t.as_py())]
                row, item, distance, end = zip(*hits) if hits else ((), (), (), ())
                columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array([ids[k] for k in item], pa.int64()), pa.array(distance, pa.int32()), pa.array(end, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([sizes[k] for k in item], pa.int32())], names=["doc_id", "item_id", "distance", "end_at", "item_length"])

        found = source.mapInArrow(run, schema)
        out = found if n == 0 else out.unionByName(found)
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without the documents that hold an item; documents with a null id stay only if clean too."""
    small_batches(docs.sparkSession)
    columns = docs.columns
    out = docs
    for items in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # bounded by BLOCK_CHARACTERS
        out = out.where(F.pandas_udf(_clean(shared, uuid.uuid4().hex), "boolean")(F.col(text_column)))
    return out.select(*columns)


def _clean(shared, key: str):
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _matcher(key, shared, PIECE)
        for texts in batches:
            yield pd.Series([not own.find(t) for t in texts], dtype=bool)

    return clean
