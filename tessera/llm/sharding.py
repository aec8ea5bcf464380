"""Histogram sort: rows go to shards of near-equal bytes, in key order.

Every boundary between shards starts with the whole key range as its interval. Each round
counts exact bytes and rows below evenly spaced probe keys inside the open intervals (one
map-side aggregation; only intervals x probes sums reach the driver) and narrows each
interval to the cell that holds its target. When all are narrow enough, the rows are
exchanged once. Built-in expressions only.

Order is by (key, tie, copy): tie is a hash of the row's content, so a key that holds a
third of all rows is cut inside the key; rows alike in both are told apart by copy, a spread
of their position in the stored key table. Defined results: a null key sorts first, a null
text has no bytes (size 1), an empty table gives an empty table, and other columns pass
through (columns named like results are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbers, stored

#: Rows of the ranges that a shard is ordered in, so that no task has to sort a whole shard; and how many ranges it may have.
RANGE_ROWS = 1_000_000
RANGES_PER_SHARD = (8, 128)
PROBES = 64
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def at_or_below(bounds: list[tuple], columns: list[Column]) -> Column:
    """How many of the ascending tuples lie at or below the row's columns, by halving steps over their arrays."""
    held = [numbers([b[j] for b in bounds], "bigint") for j in range(len(columns))] if bounds else []

    def step(found, width):
        reached = F.lit(True)
        for own, c in reversed(list(zip(held, columns))):
            bound = F.get(own, found + width - 1)  # null beyond the last
            reached = (bound < c) | ((bound == c) & reached)
        return F.when(reached, found + width).otherwise(found)

    widths = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(numbers(widths, "int"), F.lit(0), step) if bounds else F.lit(0)


def aims(total: int, shards: int, giants: list[tuple[int, int]]) -> list[int]:
    """Where shards begin and end, in bytes from the first key: as equal as rows larger than a shard let them be.

    giants: (bytes before it, size) of each such row, in key order. Each fills a shard of its
    own, and the stretches between them share the others; a stretch too small for one goes
    with the giant after it (the last with the one before).
    """
    starts = [0, *[b + s for b, s in giants]]
    ends = [*[b for b, _ in giants], total]
    rest, free = sum(e - s for s, e in zip(starts, ends)), shards - len(giants)
    share = [(e - s) * free / rest if rest else 0.0 for s, e in zip(starts, ends)]
    parts = [int(x) for x in share] if rest else [free] + [0] * len(giants)
    for _ in range(free - sum(parts)):
        fullest = max(range(len(parts)), key=lambda j: (ends[j] - starts[j]) / max(parts[j], 1))
        parts[fullest] += 1
    places = [0]
    for j, (s, e) in enumerate(zip(starts, ends)):
        places += [s + (e - s) * i // parts[j] for i in range(1, parts[j] + 1)]
        if j < len(giants):
            places.append(starts[j + 1])
    return [*places[:shards], total]


def splitters(df: DataFrame, columns: list[str], size: str, targets: list[int], tolerance: int, rounds: int = 64) -> list[tuple]:
    """For each target (ascending) a tuple of columns with about target bytes below it.

    columns: long columns, in sort order. A boundary is within tolerance bytes of its
    target, or else no tuple is nearer.
    """
    cols = [F.col(c) for c in columns]
    found: list[tuple | None] = [None] * len(targets)
    # an interval: (columns fixed before it, lo, hi, bytes below it), for column number len(fixed)
    first = df.agg(F.min(columns[0]), F.max(columns[0])).first()
    if first[0] is None:
        return [(LONG_MIN,) * len(columns) for _ in targets]
    if first[1] - first[0] > LONG_MAX:
        first = (LONG_MIN, LONG_MAX)
    open_: dict[int, tuple] = {i: ((), first[0], first[1], 0) for i in range(len(targets))}
    for _ in range(rounds):
        if not open_:
            break
        cells = sorted(set(open_.values()))
        filled = lambda fixed, v, rest: (*fixed, v, *[rest] * (len(columns) - len(fixed) - 1))
        nth = at_or_below([filled(f, lo, LONG_MIN) for f, lo, _, _ in cells], cols) - 1
        # what is known of the row's cell, by its number
        of = lambda values: F.get(numbers(values, "bigint"), F.col("cell"))
        tops = [filled(f, hi, LONG_MAX) for f, _, hi, _ in cells]
        past = F.lit(False)
        for j in reversed(range(len(columns))):
            top = of([t[j] for t in tops])
            past = (cols[j] > top) | ((cols[j] == top) & past)
        own = F.coalesce(*[F.when(of([len(f) for f, _, _, _ in cells]) == j, c) for j, c in enumerate(cols)])
        step = lambda lo, hi: max(1, -(-(hi - lo + 1) // PROBES))
        probe = F.when(
            of([int(hi - lo > LONG_MAX) for _, lo, hi, _ in cells]) == 1,
            # the whole range of a long: its upper six bits, sign turned
            F.shiftrightunsigned(own.bitwiseXOR(F.lit(LONG_MIN).cast("long")), 58),
        ).otherwise(F.call_function("div", own - of([lo if hi - lo <= LONG_MAX else 0 for _, lo, hi, _ in cells]), of([step(lo, hi) if hi - lo <= LONG_MAX else 1 for _, lo, hi, _ in cells])))
        placed = df.select(*columns, size, nth.alias("cell")).where(F.col("cell") >= 0).where(~past)
        sums = (
            placed.select("cell", probe.alias("probe"), F.col(size).alias("size"))
            .groupBy("cell", "probe")
            .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
            .collect()  # at most intervals x PROBES sums
        )
        by_cell: dict[int, dict[int, int]] = {}
        single = set()
        for r in sums:
            by_cell.setdefault(r["cell"], {})[r["probe"]] = r["bytes"]
            if r["rows"] == 1:
                single.add((r["cell"], r["probe"]))
        for i, at in list(open_.items()):
            fixed, lo, hi, below = at
            step = max(1, -(-(hi - lo + 1) // PROBES))
            got = by_cell.get(cells.index(at), {})
            for nth in sorted(got):
                if below + got[nth] > targets[i] or nth == max(got):
                    break
                below += got[nth]
            start, end = lo + nth * step, min(hi, lo + (nth + 1) * step - 1)
            rest = len(columns) - len(fixed) - 1
            after = below + got[nth]
            at_start = (*fixed, start, *[LONG_MIN] * rest)
            past_end = (*fixed, end + 1, *[LONG_MIN] * rest) if end < LONG_MAX else (*fixed, end, *[LONG_MAX] * rest)
            nearest = at_start if targets[i] - below <= after - targets[i] else past_end
            if targets[i] - below <= tolerance or 0 <= after - targets[i] <= tolerance:
                found[i] = nearest
            elif (cells.index(at), nth) in single:  # no tuple cuts a row
                found[i] = nearest
            elif start < end:
                open_[i] = (fixed, start, end, below)
                continue
            elif rest:
                open_[i] = ((*fixed, start), LONG_MIN, LONG_MAX, below)
                continue
            else:
                found[i] = nearest
            del open_[i]
    return [found[i] or (*open_[i][0], open_[i][1], *[LONG_MIN] * (len(columns) - len(open_[i][0]) - 1)) for i in range(len(targets))]


def histogram_shard(df: DataFrame, key: str, size: Column, tie: Column, shards: int = 8, tolerance: int | None = None) -> DataFrame:
    """df with size, shard and slot (the row's place in its shard, gapless from 0, in key order)."""
    placed = df.withColumns(
        {
            "size": size.cast("long"),
            "_key": F.coalesce(F.col(key).cast("long"), F.lit(LONG_MIN)),
            "_tie": tie.cast("long"),
            "_copy": F.xxhash64(F.monotonically_increasing_id()),
        }
    )
    placed = stored(placed, "shard-keys")
    order = ["_key", "_tie", "_copy"]
    total, count = placed.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    ranges = min(max(count // (shards * RANGE_ROWS), RANGES_PER_SHARD[0]), RANGES_PER_SHARD[1])
    n = shards * ranges
    cols = [F.col(c) for c in order]
    large = sorted(tuple(r) for r in placed.where(F.col("size") * shards > total).select(*order, "size").collect())  # fewer than shards
    giants = []
    if large:
        before_each = placed.groupBy((at_or_below([r[:3] for r in large], cols)).alias("nth")).agg(F.sum("size").alias("bytes")).collect()
        held = {r["nth"]: r["bytes"] for r in before_each}
        giants = [(sum(held.get(k, 0) for k in range(j + 1)), r[3]) for j, r in enumerate(large)]
    places = aims(total, shards, giants)
    targets = [a + (b - a) * i // ranges for a, b in zip(places, places[1:]) for i in range(ranges)][1:]
    bounds = splitters(placed, order, "size", targets, tolerance if tolerance is not None else total // (n * 1000))
    bounds = sorted(bounds)
    placed = placed.withColumn("_range", at_or_below(bounds, cols))
    rows = {r["_range"]: r["count"] for r in placed.groupBy("_range").count().collect()}  # shards x ranges rows
    before, starts = 0, []
    for i in range(n):
        before = 0 if i % ranges == 0 else before
        starts.append(before)
        before += rows.get(i, 0)
    in_range = Window.partitionBy("_range").orderBy(*order)
    return placed.withColumns(
        {
            "shard": F.floor(F.col("_range") / ranges).cast("int"),
            "slot": (F.row_number().over(in_range) - 1).cast("long") + F.get(numbers(starts, "bigint"), F.col("_range")),
        }
    ).drop("_key", "_tie", "_copy", "_range")
