"""Removal of byte strings that occur in an earlier document, by interval expansion on a
Burrows-Wheeler transform.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a
smaller id. Which strings are equal is decided in buckets: the bucket's suffixes are sorted,
and breadth-first backward extension of the transform sets common-prefix values in
increasing order, 0, 1, 2, ..., until LENGTH - 1; boundaries still unset then lie inside
intervals of one LENGTH-byte string. The least document of each interval answers for it.

To bring equal strings together, texts are anchored: in each string of LENGTH bytes, the
GRAM-byte substring of least hash is an anchor, so equal strings have equal anchors at equal
places. A first exchange of anchor hashes finds the anchors that occur in two documents or
more; a second one takes only their surroundings (all strings anchored there) to buckets.
Both exchanges run between chunks of documents, each of which sends any anchor or
surrounding once, however often it occurs: a passage that a third of all documents share
costs one entry for each chunk.

Defined results: a null text is empty; null ids come before all others; rows with one id do
not remove each other's bytes; an empty table gives an empty table; other columns are not
carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, stored
from .hashing import mix

LENGTH = 50
GRAM = 20
CHUNK_BYTES = 4_000_000
#: Strings whose anchors are sought at a time, in a chunk that one long document makes larger.
STRETCH = 1 << 23
#: Anchor hashes and surroundings that a bucket gets on average.
BUCKET_ANCHORS = 1_000_000
BUCKET_SURROUNDINGS = 40_000
PART_SURROUNDINGS = 6_000
#: Bytes of a hash that are sent; the bucket holds the rest of its information. A false match costs only work.
SENT = 5
LEFT, RIGHT = LENGTH - GRAM, LENGTH
LAST = np.iinfo(np.int64).max
FIRST = np.iinfo(np.int64).min
_P = 0x9E3779B97F4A7C15


def _sliding(x: np.ndarray, n: int, least) -> np.ndarray:
    """least over x[i : i + n], for every i with n entries from it on."""
    width, out = 1, x
    while 2 * width <= n:
        out = least(out[:-width], out[width:])
        width *= 2
    if width < n:
        out = least(out[: len(x) - n + 1], out[n - width : n - width + len(x) - n + 1])
    return out


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the gram bytes from each place on."""
    if len(data) < gram:
        return np.zeros(0, dtype=np.uint64)
    parts, power, width, whole = {1: data.astype(np.uint64) + np.uint64(1)}, _P, 1, None
    powers = {1: np.uint64(power)}
    while 2 * width <= gram:
        h = parts[width]
        parts[2 * width] = h[:-width] * powers[width] + h[width:]
        width *= 2
        power = power * power % (1 << 64)
        powers[width] = np.uint64(power)
    at = 0
    for width in sorted(parts, reverse=True):
        if gram & width:
            piece = parts[width][at : at + len(data) - gram + 1]
            whole = piece if whole is None else whole * powers[width] + piece
            at += width
    return mix(whole)


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of all strings of length bytes inside documents, a stretch of strings at a time."""
    parts = []
    for a in range(0, len(data), STRETCH):
        part = data[a : a + STRETCH + length - 1]
        places, hashes = _anchors(part, np.clip(bounds, a, a + len(part)) - a, length, gram)
        parts.append((places + a, hashes))
    if len(parts) < 2:
        return parts[0] if parts else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))
    places, first = np.unique(np.concatenate([p for p, _ in parts]), return_index=True)
    return places, np.concatenate([h for _, h in parts])[first]


def _anchors(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    if len(data) < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = gram_hashes(data, gram)
    h |= np.uint64(1)
    span = length - gram + 1
    least = _sliding(h, span, np.minimum)  # for each string's first place
    valid = np.zeros(len(data) + 1, dtype=np.int32)
    long = np.diff(bounds) >= length
    np.add.at(valid, bounds[:-1][long], 1)
    np.add.at(valid, bounds[1:][long] - length + 1, -1)
    least[np.cumsum(valid)[: len(least)] == 0] = 0
    padded = np.concatenate([np.zeros(span - 1, dtype=np.uint64), least, np.zeros(span - 1, dtype=np.uint64)])
    places = np.flatnonzero(_sliding(padded, span, np.maximum)[: len(h)] == h)
    return places, h[places]


def surroundings(data: np.ndarray, bounds: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of LEFT + RIGHT + 2 bytes, document of each): bytes about each place and how many are real on either side."""
    doc = np.searchsorted(bounds, places, side="right") - 1
    left = np.minimum(places - bounds[doc], LEFT)
    right = np.minimum(bounds[doc + 1] - places, RIGHT)
    rows = np.zeros((len(places), LEFT + RIGHT + 2), dtype=np.uint8)
    padded = np.concatenate([np.zeros(LEFT, dtype=np.uint8), data, np.zeros(RIGHT, dtype=np.uint8)])
    rows[:, :-2] = np.lib.stride_tricks.sliding_window_view(padded, LEFT + RIGHT)[places]
    for cut in np.flatnonzero((left < LEFT) | (right < RIGHT)).tolist():  # near the bounds of documents
        rows[cut, : LEFT - left[cut]] = 0
        rows[cut, LEFT + right[cut] : -2] = 0
    rows[:, -2], rows[:, -1] = left, right
    return rows, doc


def distinct_rows(rows: np.ndarray, extra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each different one, which one each row is), by extra and then a hash; checked byte by byte."""
    factors = mix(np.arange(1, rows.shape[1] + 1, dtype=np.uint64) * np.uint64(_P)) | np.uint64(1)
    h = np.zeros(len(rows), dtype=np.uint64)
    for j in range(rows.shape[1]):
        h += (rows[:, j].astype(np.uint64) + np.uint64(1)) * factors[j]
    h = mix(h)
    if extra is not None:  # keeps the order by extra in the high bits
        h = (extra.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)) if int(extra.max(initial=0)) < 1 << 20 else h
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    if not np.array_equal(rows[first][which], rows) or (extra is not None and not np.array_equal(extra[first][which], extra)):
        full = rows if extra is None else np.concatenate([extra.astype(">i8").view(np.uint8).reshape(-1, 8), rows], axis=1)
        _, first, which = np.unique(np.ascontiguousarray(full).view(np.dtype((np.void, full.shape[1]))).ravel(), return_index=True, return_inverse=True)
    elif extra is not None and int(extra.max(initial=0)) >= 1 << 20:
        order = np.argsort(extra[first], kind="stable")
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        first, which = first[order], back[which]
    return first, which


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first depth symbols or more, ties in any order; symbols up to 256."""
    n, width = len(text), 7
    padded = np.concatenate([text.astype(np.int64), np.zeros(width, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for j in range(width):
        key = key * 257 + padded[j : j + n]
    while True:
        order = np.argsort(key)
        if width >= depth:
            return order
        sorted_key = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + after
        width *= 2


def equal_intervals(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix in order, the number of its interval of equal length-symbol prefixes.

    Level by level, the intervals of all strings of one length are extended backward by
    every symbol: neighbours in the column of first symbols come from two places of the
    transform, and part where those lie in different intervals. A boundary set at level k
    has a common prefix of k symbols; levels stop before length.
    """
    n = len(text)
    transform = text[order - 1]  # the symbol before each suffix; the first suffix has the last symbol before it
    source = np.argsort(transform, kind="stable")  # where each suffix stood before it was extended
    boundary = np.zeros(n, dtype=bool)
    boundary[0] = True
    symbol = transform[source]
    boundary[1:] |= symbol[1:] != symbol[:-1]
    unset = np.flatnonzero(~boundary)
    for _ in range(1, length):
        if not len(unset):
            break
        interval = np.cumsum(boundary, dtype=np.int32)
        part = interval[source[unset]] != interval[source[unset - 1]]
        boundary[unset[part]] = True
        unset = unset[~part]
    return np.cumsum(boundary) - 1


def least_documents(rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each surrounding and each of its LEFT + 1 strings the least document that the string starts in; LAST where it has none."""
    left, right = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    size = left + right
    ends = np.cumsum(size + 1)
    starts = ends - size - 1
    text = np.zeros(int(ends[-1]), dtype=np.int16)
    column = np.arange(LEFT + RIGHT)
    real = (column >= (LEFT - left)[:, None]) & (column < (LEFT + right)[:, None])
    target = (starts[:, None] + column - (LEFT - left)[:, None])[real]
    text[target] = rows[:, :-2][real].astype(np.int16) + 1
    order = suffix_order(text, LENGTH)
    interval = np.empty(len(text), dtype=np.int64)
    interval[order] = equal_intervals(text, order, LENGTH)
    first = np.arange(LEFT + 1)
    whole = (first >= (LEFT - left)[:, None]) & (first + LENGTH <= (LEFT + right)[:, None])
    mine = interval[(starts[:, None] + first - (LEFT - left)[:, None])[whole]]
    least = np.full(int(interval.max()) + 1, LAST)
    np.minimum.at(least, mine, np.broadcast_to(docs[:, None], whole.shape)[whole])
    out = np.full(whole.shape, LAST)
    out[whole] = least[mine]
    return out


def _squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _expand(raw: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=dtype)


def _batch(schema: str, **columns) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    pairs = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], types[t]) for n, t in pairs], names=[n for n, _ in pairs])


CHUNK = "chunk long, docs binary, bounds binary, data binary"


def chunks(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Documents put together to chunks of about CHUNK_BYTES, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, docs, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            nonlocal n, held, docs, size
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
            row = _batch(
                CHUNK, chunk=[(part << 32) + n], docs=[np.asarray(docs, dtype=np.int64).tobytes()], bounds=[bounds.tobytes()],
                data=[_squeeze(np.frombuffer(b"".join(held), dtype=np.uint8))],
            )
            n, held, docs, size = n + 1, [], [], 0
            return row

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = raw or b""
                if held and size + len(raw) > CHUNK_BYTES:
                    yield flush()
                held.append(raw)
                docs.append(FIRST if doc is None else doc)
                size += len(raw)
        if held:
            yield flush()

    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.encode(F.col(text_column), "UTF-8").alias("raw")).mapInArrow(run, CHUNK)


class Chunk:
    """A chunk with its anchors, in the order in which they are sent: by bucket, then by hash."""

    def __init__(self, row: dict, buckets: int):
        self.id = row["chunk"]
        self.docs = np.frombuffer(row["docs"], dtype=np.int64)
        self.bounds = np.frombuffer(row["bounds"], dtype=np.int64)
        self.data = _expand(row["data"], np.uint8)
        self.places, self.hashes = anchors(self.data, self.bounds)
        self.keys, self.which = np.unique(self.hashes, return_inverse=True)
        bucket = (self.keys >> np.uint64(8 * SENT)) % np.uint64(buckets)
        self.order = np.argsort(bucket, kind="stable")
        self.bucket = bucket[self.order].astype(np.int64)

    def sent(self) -> Iterator[tuple[int, bytes]]:
        raw = self.keys[self.order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SENT]
        cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield int(self.bucket[a]), raw[a:b].tobytes()

    def shared(self, replies: list) -> np.ndarray:
        """The anchors that occur in two documents: those that came back, and those met twice here."""
        hit = np.zeros(len(self.keys), dtype=bool)
        at = np.concatenate([[0], np.cumsum(np.bincount(self.bucket))]) if len(self.bucket) else np.zeros(1, dtype=np.int64)
        for reply in replies or []:
            a, b = at[reply["bucket"]], at[reply["bucket"] + 1]
            bits = np.unpackbits(np.frombuffer(reply["bits"], dtype=np.uint8))[: b - a].astype(bool)
            hit[self.order[a:b][bits]] = True
        doc = np.searchsorted(self.bounds, self.places, side="right") - 1
        low, high = np.full(len(self.keys), len(self.docs)), np.full(len(self.keys), -1)
        np.minimum.at(low, self.which, doc)
        np.maximum.at(high, self.which, doc)
        return (hit | (low < high))[self.which]


class Marked:
    """A chunk with the surroundings of its shared anchors: each different one once, by bucket."""

    def __init__(self, row: dict):
        self.id = row["chunk"]
        self.docs = np.frombuffer(row["docs"], dtype=np.int64)
        self.bounds = np.frombuffer(row["bounds"], dtype=np.int64)
        self.data = _expand(row["data"], np.uint8)
        self.places = np.cumsum(_expand(row["places"], np.int32).astype(np.int64))
        self.to = _expand(row["buckets"], np.int32).astype(np.int64)
        self.rows, self.doc = surroundings(self.data, self.bounds, self.places)
        self.first, self.which = distinct_rows(self.rows, self.to)
        self.least = np.full(len(self.first), LAST)
        np.minimum.at(self.least, self.which, self.docs[self.doc])


def _joined(chunk_rows: DataFrame, replies: DataFrame) -> DataFrame:
    return chunk_rows.join(replies.groupBy("chunk").agg(F.collect_list(F.struct(*[c for c in replies.columns if c != "chunk"])).alias("replies")), "chunk", "left")


def removed_runs(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): one row for each row of df; kept is what is left, as bytes."""
    small_batches(df.sparkSession)
    total = df.agg(F.sum(F.octet_length(F.col(text_column)))).first()[0] or 0
    buckets = max(1, int(total // 12 // BUCKET_ANCHORS))
    base = stored(chunks(df, id_column, text_column), "chunks")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a row at a time: it holds a chunk
                own = Chunk(batch.slice(i, 1).to_pylist()[0], buckets)
                rows = list(own.sent())
                yield _batch("bucket long, chunk long, keys binary", bucket=[r[0] for r in rows], chunk=[own.id] * len(rows), keys=[r[1] for r in rows])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = np.array([len(k) // SENT for k in rows["keys"]], dtype=np.int64)
        raw = np.zeros((int(sizes.sum()), 8), dtype=np.uint8)
        raw[:, :SENT] = np.frombuffer(b"".join(rows["keys"]), dtype=np.uint8).reshape(-1, SENT)
        _, which, times = np.unique(raw.view("<u8").ravel(), return_inverse=True, return_counts=True)
        hit = times[which] > 1
        ends = np.cumsum(sizes)
        bits = [np.packbits(hit[b - s : b]).tobytes() for b, s in zip(ends.tolist(), sizes.tolist())]
        return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "bits": bits, "n": [int(hit[b - s : b].sum()) for b, s in zip(ends.tolist(), sizes.tolist())]})

    replies = base.mapInArrow(send, "bucket long, chunk long, keys binary").groupBy("bucket").applyInPandas(meet, "chunk long, bucket long, bits binary, n long")
    replies = stored(replies, "anchor-replies")
    common = replies.agg(F.sum("n")).first()[0] or 0
    second = max(1, int(common // BUCKET_SURROUNDINGS))
    marked = f"{CHUNK}, places binary, buckets binary"

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own = Chunk(row, buckets)
                here = own.shared(row["replies"])
                to = ((own.hashes[here] >> np.uint64(8)) % np.uint64(second)).astype(np.int32)
                yield _batch(
                    marked, chunk=[own.id], docs=[row["docs"]], bounds=[row["bounds"]], data=[row["data"]],
                    places=[_squeeze(np.diff(own.places[here], prepend=0).astype(np.int32))], buckets=[_squeeze(to)],
                )

    kept = stored(_joined(base, replies).mapInArrow(mark, marked), "marked")
    discard(base)
    discard(replies)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = Marked(batch.slice(i, 1).to_pylist()[0])
                groups = own.to[own.first]
                cuts = np.flatnonzero(np.diff(groups, prepend=-1, append=-1))
                spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                yield _batch(
                    "bucket long, chunk long, rows binary, least binary", bucket=[int(groups[a]) for a, _ in spans], chunk=[own.id] * len(spans),
                    rows=[_squeeze(own.rows[own.first[a:b]]) for a, b in spans], least=[_squeeze(own.least[a:b]) for a, b in spans],
                )

    gathered = kept.mapInArrow(gather, "bucket long, chunk long, rows binary, least binary")

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        every = [_expand(x, np.uint8).reshape(-1, LEFT + RIGHT + 2) for x in rows["rows"]]
        docs = np.concatenate([_expand(x, np.int64) for x in rows["least"]])
        sizes = [len(x) for x in every]
        every = np.concatenate(every)
        first, which = distinct_rows(every)
        least = np.full(len(first), LAST)
        np.minimum.at(least, which, docs)
        # equal strings have equal anchors, so a bucket falls into parts by anchor that fit in cache
        gram = distinct_rows(every[first][:, LEFT : LEFT + GRAM])[1]
        part = gram * max(1, len(first) // PART_SURROUNDINGS) // max(1, int(gram.max()) + 1)
        found = np.empty((len(first), LEFT + 1), dtype=np.int64)
        for k in range(int(part.max()) + 1):
            own = np.flatnonzero(part == k)
            if len(own):
                found[own] = least_documents(every[first[own]], least[own])
        ends = np.cumsum(sizes)
        return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "found": [_squeeze(found[which[b - s : b]]) for b, s in zip(ends.tolist(), sizes)]})

    answers = gathered.groupBy("bucket").applyInPandas(answer, "chunk long, bucket long, found binary")
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own = Marked(row)
                docs, bounds, data, places, which = own.docs, own.bounds, own.data, own.places, own.which
                answers = sorted(row["replies"] or [], key=lambda x: x["bucket"])
                cover = np.zeros(len(data) + 1, dtype=np.int32)
                if answers:
                    least = np.concatenate([_expand(x["found"], np.int64).reshape(-1, LEFT + 1) for x in answers])
                    at, string = np.nonzero(least[which] < docs[own.doc][:, None])
                    starts = places[at] - LEFT + string
                    cover += np.bincount(starts, minlength=len(cover)).astype(np.int32)
                    cover -= np.bincount(starts + LENGTH, minlength=len(cover)).astype(np.int32)
                gone = np.cumsum(cover[:-1]) > 0
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                begin[bounds[:-1][bounds[:-1] < len(data)]] = gone[bounds[:-1][bounds[:-1] < len(data)]]
                removed, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begin))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None if d == FIRST else d for d in docs.tolist()], pa.int64()),
                        pa.array(np.diff(bounds)),
                        pa.array(np.diff(removed[bounds])),
                        pa.array(np.diff(spans[bounds])),
                        pa.array([data[a:b][~gone[a:b]].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return _joined(kept, answers).mapInArrow(remove, result)


