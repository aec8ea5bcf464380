"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces are dealt by hash to blocks of about BLOCK_PIECES. Each block has several islands,
each a task of its own with a population of packings. Crossover injects whole well-filled
sequences of one parent into the other, drops the sequences that hold duplicates, and
best-fits the pieces that lose their place. Fewer sequences count first, then squared
filling, which drives what room is left into few sequences; an island stops early only
where neither can get better. After each epoch every island gets the elite of its
neighbour. The best packing of each block stands; pieces of its badly filled sequences are
dealt to fewer blocks and packed once more.

Defined results: a null text has only the end id; repeated rows are packed one by one; an
empty table gives an empty table; other columns are not carried.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, stored
from .tokens import encoded

CAPACITY = 4096
END_ID = 1
BLOCK_PIECES = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 5
GENERATIONS = 4
#: A sequence filled less than this goes into the second packing.
WELL_FILLED = 0.98


def pieces(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents, the longer ones cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ids, before in encoded(batch, "text", path):
                ids = np.insert(ids, before[1:], end_id)
                before = before + np.arange(len(before))
                total = np.diff(before)
                count = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, total[row] - start)
                at = before[row] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    small_batches(df.sparkSession)
    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(items: list[int], lengths: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Put items, in the order given, where least room is left; open bins where none has enough."""
    free = sorted((r, b) for b, r in enumerate(room) if r)
    for i in items:
        n = lengths[i]
        k = bisect_left(free, (n, -1))
        if k < len(free):
            r, b = free.pop(k)
            bins[b].append(i)
        else:
            b, r = len(bins), capacity
            bins.append([i])
            room.append(capacity)
        room[b] = r - n
        if room[b]:
            insort(free, (room[b], b))


def fitness(room: list[int], capacity: int) -> float:
    """The mean of squared filling: few and well filled sequences are best."""
    return sum(((capacity - r) / capacity) ** 2 for r in room) / max(1, len(room))


def seed_packing(lengths: list[int], capacity: int, rng: np.random.Generator, jitter: float) -> tuple[list[list[int]], list[int]]:
    keys = np.asarray(lengths) * (1 + jitter * rng.random(len(lengths)))
    bins: list[list[int]] = []
    room: list[int] = []
    best_fit(np.argsort(-keys, kind="stable").tolist(), lengths, bins, room, capacity)
    return bins, room


def crossover(a: tuple, b: tuple, lengths: list[int], capacity: int, rng: np.random.Generator) -> tuple[list[list[int]], list[int]]:
    """b with a stretch of a's best filled bins put in whole."""
    full = sorted(range(len(a[0])), key=lambda k: a[1][k])
    chosen = full[: max(1, int(len(full) * rng.uniform(0.2, 0.6)))]
    inside = {i for k in chosen for i in a[0][k]}
    bins, room = [list(a[0][k]) for k in chosen], [a[1][k] for k in chosen]
    loose = []
    for items, left in zip(*b, strict=True):
        if inside.isdisjoint(items):
            bins.append(list(items))
            room.append(left)
        else:
            loose += [i for i in items if i not in inside]
    loose.sort(key=lambda i: -lengths[i])
    best_fit(loose, lengths, bins, room, capacity)
    return bins, room


def mutate(a: tuple, lengths: list[int], capacity: int, rng: np.random.Generator) -> tuple[list[list[int]], list[int]]:
    """Take the worst filled bins apart and best-fit their pieces."""
    worst = set(sorted(range(len(a[0])), key=lambda k: -a[1][k])[: 1 + int(rng.integers(0, 1 + len(a[0]) // 20))])
    bins = [list(x) for k, x in enumerate(a[0]) if k not in worst]
    room = [r for k, r in enumerate(a[1]) if k not in worst]
    best_fit(sorted((i for k in worst for i in a[0][k]), key=lambda i: -lengths[i]), lengths, bins, room, capacity)
    return bins, room


def ideal(lengths: list[int], capacity: int) -> tuple[int, float]:
    """The score that no packing beats: as few sequences as the sum allows, all full but one."""
    least = -(-sum(lengths) // capacity)
    last = sum(lengths) - (least - 1) * capacity
    return least, -(least - 1 + (last / capacity) ** 2) / max(1, least)


def evolve(lengths: list[int], capacity: int, seed: list[int], migrants: list[tuple], population: int = POPULATION, generations: int = GENERATIONS) -> tuple:
    """The best packing found."""
    rng = np.random.default_rng(seed)
    best = ideal(lengths, capacity)
    people = list(migrants)
    while len(people) < population:
        people.append(seed_packing(lengths, capacity, rng, 0.05 * len(people)))
    score = lambda p: (len(p[0]), -fitness(p[1], capacity))
    for _ in range(generations):
        people.sort(key=score)
        if score(people[0]) <= best:
            break
        half = people[: max(2, population // 2)]
        children = []
        while len(half) + len(children) < population:
            i, j = rng.choice(len(half), 2, replace=False)
            children.append(mutate(crossover(half[i], half[j], lengths, capacity, rng), lengths, capacity, rng))
        people = half + children
    return min(people, key=score)


def _flat(packing: tuple, n: int) -> bytes:
    where = np.zeros(n, dtype="<i4")
    for b, items in enumerate(packing[0]):
        where[items] = b
    return where.tobytes()


def _packing(raw: bytes, lengths: list[int], capacity: int) -> tuple:
    where = np.frombuffer(raw, "<i4")
    bins: list[list[int]] = [[] for _ in range(int(where.max()) + 1)]
    room = [capacity] * len(bins)
    for i, b in enumerate(where.tolist()):
        bins[b].append(i)
        room[b] -= lengths[i]
    return bins, room


STATE = "block int, island int, epoch int, lengths array<int>, packing binary, bins int, score double"


def _epoch(state: DataFrame, capacity: int, epoch: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                lengths = [int(x) for x in r.lengths]
                known = [_packing(x, lengths, capacity) for x in (r.packing, r.migrant) if x is not None]
                best = evolve(lengths, capacity, [int(r.block), int(r.island), epoch], known)
                yield pd.DataFrame(
                    {
                        "block": [r.block], "island": [r.island], "epoch": [epoch], "lengths": [r.lengths],
                        "packing": [_flat(best, len(lengths))], "bins": [len(best[0])], "score": [fitness(best[1], capacity)],
                    }
                )

    return state.mapInPandas(run, STATE)


def pack_blocks(items: DataFrame, blocks: int, capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """items (struct column it with length) dealt to blocks, with bin and offset in their block."""
    dealt = stored(
        items.groupBy(F.pmod(F.xxhash64("it"), F.lit(blocks)).cast("int").alias("block")).agg(F.sort_array(F.collect_list("it")).alias("its")), "pack-blocks"
    )
    lengths = F.transform("its", lambda x: x["length"].cast("int"))
    state = dealt.select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), lengths.alias("lengths"), F.lit(None).cast("binary").alias("packing"), F.lit(None).cast("binary").alias("migrant")
    ).repartition(max(1, min(blocks * islands, 8 * items.sparkSession.sparkContext.defaultParallelism)), "block", "island")
    old = None
    for epoch in range(epochs):
        state = stored(_epoch(state, capacity, epoch), "pack-epoch")
        if old is not None:
            discard(old)
        old = state
        if epoch + 1 < epochs:
            elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("packing").alias("migrant"))
            state = state.select("block", "island", "lengths", "packing").join(elite, ["block", "island"], "left")
    best = state.groupBy("block").agg(F.min_by("packing", F.struct("bins", -F.col("score"), "island")).alias("packing"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                bins, _ = _packing(r.packing, [0] * (len(r.packing) // 4), 0)
                where = np.frombuffer(r.packing, "<i4")
                size = np.asarray(r.lengths, dtype=np.int64)
                order = np.argsort(where, kind="stable")
                ends = np.cumsum(size[order])
                first = np.searchsorted(where[order], np.arange(len(bins)))
                base = (ends - size[order])[first]
                offset = np.zeros(len(where), dtype=np.int64)
                offset[order] = ends - size[order] - base[where[order]]
                fill = np.bincount(where, weights=size)[where].astype(np.int64)
                yield pd.DataFrame({"block": [r.block], "bin": [where], "offset": [offset], "fill": [fill]})

    placed = best.join(dealt.select("block", lengths.alias("lengths")), "block").mapInPandas(place, "block int, bin array<int>, offset array<long>, fill array<long>")
    return (
        dealt.join(placed, "block")
        .select("block", F.explode(F.arrays_zip("its", "bin", "offset", "fill")).alias("x"))
        .select(F.col("x.its").alias("it"), "block", F.col("x.bin").alias("bin"), F.col("x.offset").alias("offset"), F.col("x.fill").alias("fill"))
    )


def pack(cut: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """The columns of pieces() with sequence_id and offset."""
    cut = stored(cut, "pieces").withColumn("_row", F.monotonically_increasing_id())
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = cut.where(F.col("length") == capacity).select(*columns, (F.col("_row") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    it = F.struct("length", "doc_id", "piece", "start", "ids_crc32", "_row").alias("it")
    rest = cut.where(F.col("length") < capacity).select(it)
    first = stored(pack_blocks(rest, max(1, -(-rest.count() // block_pieces)), capacity), "packed")
    badly = F.col("fill") < WELL_FILLED * capacity
    again = first.where(badly).select("it")
    second = pack_blocks(again, max(1, -(-again.count() // block_pieces)), capacity)
    number = lambda kind: ((F.col("block").cast("long") * (1 << 31) + F.col("bin")) * 4 + kind).alias("sequence_id")
    out = [p.select(*[F.col(f"it.{c}").alias(c) for c in columns], number(k), "offset") for k, p in ((1, first.where(~badly)), (2, second))]
    return full.unionByName(out[0]).unionByName(out[1])
