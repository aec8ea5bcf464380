"""Ordered signals in chunks that know their surroundings: no task holds a block (a sample, a table).

A block's rows are numbered in their order by ranges (order.numbered). A chunk is a stretch of
so many places, stored as one array, with the values of `wing` places on either side. What a
kernel needs beyond that comes from one small row for each chunk: the last and next cut for
windows that stop at cuts, the state before it for recursions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import kernels
from ..sources.scratch import kept
from .order import numbered

#: Places of a chunk at least; with windows of more, as many as reach to one side.
CHUNK = 1 << 16
PLACE, SIZE = "_place", "_size"


def same(keys: list[str], left: str, right: str) -> Column:
    """Equal keys, nulls among them."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def with_each(df: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """df with the other columns of a table that has one row for each value of keys (or a single row)."""
    more = [c for c in one.columns if c not in keys]
    return df.alias("many").join(one.alias("one"), same(keys, "many", "one"), "left").select("many.*", *[F.col(f"one.{c}") for c in more])


def placed(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """df, stored, with _place, a row's place in its block from 0, and _size, the rows of the block."""
    rows = numbered(df, [*keys, *order], "_row")
    blocks = rows.groupBy(*keys).agg(F.min("_row").alias("_from"), F.count("*").alias(SIZE))
    out = with_each(rows, blocks, keys)
    return kept(out.withColumn(PLACE, F.col("_row") - F.col("_from")).drop("_row", "_from"), "placed")


def chunks(rows: DataFrame, keys: list[str], column: str, wing: Column) -> DataFrame:
    """keys, _chunk, _at (the place of the first value), _lo and _hi (the chunk's own places), _size, _x: the values with wing more at each side."""
    span = F.greatest(wing, F.lit(CHUNK)).cast("long")
    of = lambda place: F.call_function("div", place, F.col("_span"))
    at = rows.select(*keys, PLACE, SIZE, F.col(column).cast("double").alias("_v"), span.alias("_span"), wing.cast("long").alias("_wing"))
    first, last = of(F.greatest(F.col(PLACE) - F.col("_wing"), F.lit(0))), of(F.least(F.col(PLACE) + F.col("_wing"), F.col(SIZE) - 1))
    dealt = at.withColumn("_chunk", F.explode(F.sequence(first, last)))
    packed = dealt.groupBy(*keys, "_chunk").agg(F.first(SIZE).alias(SIZE), F.first("_span").alias("_span"), F.sort_array(F.collect_list(F.struct(F.col(PLACE).alias("p"), F.col("_v").alias("v")))).alias("_a"))
    lo = F.col("_chunk") * F.col("_span")
    out = packed.select(*keys, "_chunk", F.get("_a", F.lit(0))["p"].alias("_at"), lo.alias("_lo"), F.least(lo + F.col("_span"), F.col(SIZE)).alias("_hi"), SIZE, F.col("_a.v").alias("_x"))
    return kept(out, "chunks")


def _floats(values) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in values], dtype=float) if not isinstance(values, np.ndarray) else values.astype(float)


def each_chunk(df: DataFrame, fields: list[StructField], kernel) -> DataFrame:
    """kernel(row of df as a dict) gives the values of fields."""
    names = [f.name for f in fields]

    def run(frames):
        for frame in frames:
            made = [kernel(r) for r in frame.to_dict("records")]
            yield pd.DataFrame({n: pd.Series([m[i] for m in made], dtype=object) for i, n in enumerate(names)} | {c: frame[c] for c in frame.columns if c not in names})[out.names]

    out = StructType([f for f in df.schema.fields if f.name not in names and f.name != "_x"] + fields)
    return df.mapInPandas(run, out)


def unpacked(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, _place and the value of each place of chunks with an array of their own values."""
    return df.select(*keys, F.posexplode(name).alias("_i", name), "_lo").select(*keys, (F.col("_lo") + F.col("_i")).alias(PLACE), name)


def joined(rows: DataFrame, values: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with the values of their places, without _place and _size."""
    on = same(keys, "many", "one") & (F.col(f"many.{PLACE}") == F.col(f"one.{PLACE}"))
    out = rows.alias("many").join(values.alias("one"), on, "left")
    return out.select(*[F.col(f"many.`{c}`") for c in rows.columns if c not in (PLACE, SIZE, name)], F.col(f"one.{name}"))


def rolling_median(df: DataFrame, keys: list[str], order: list, width: float, column: str = "log2", out: str = "smoothed", gated: bool = True) -> DataFrame:
    """df with the mirrored rolling median (WIN-02) of column in order, a block of keys at a time.

    gated (WIN-03): windows stop where the signal leaves its mean; the last stretch outside
    does not count. A place is a cut if it is inside and exactly one neighbour is not; the
    mean and spread skip nulls.
    """
    rows = placed(df, keys, order)
    share, n = 2 / (1 + 9), F.col(SIZE)
    half = F.ceil(n * width * 0.5) if width < 1 else F.floor(F.least(F.lit(float(width)), n - 1) / 2)
    table = chunks(rows, keys, column, F.greatest(F.least(F.greatest(half, F.lit(3)), n - 1), F.lit(3)))
    if gated:
        facts = rows.groupBy(*keys).agg(F.avg(column).alias("_mean"), (F.stddev_samp(column) * (3 * (share / (2 - share)) ** 0.5)).alias("_reach"))
        known = with_each(rows.select(*keys, PLACE, column), facts, keys)
        outside = F.coalesce(F.abs(F.col(column) - F.col("_mean")) > F.col("_reach"), F.lit(False))
        flagged = known.select(*keys, PLACE, outside.alias("_out"))
        lasts = flagged.where("_out").groupBy(*keys).agg(F.max(PLACE).alias("_last"))
        before = with_each(flagged.where("NOT _out"), lasts, keys).where(F.col(PLACE) < F.col("_last")).groupBy(*keys).agg((F.max(PLACE) + 1).alias("_run"))
        facts = with_each(with_each(facts, lasts, keys), before, keys).withColumn("_run", F.when(F.col("_last").isNotNull(), F.coalesce("_run", F.lit(0)))).drop("_last")
        table = with_each(table, facts, keys)

    def cuts_of(r) -> np.ndarray:
        """The cuts among the chunk's own places."""
        lo, hi, at, size = int(r["_lo"]), int(r["_hi"]), int(r["_at"]), int(r[SIZE])
        found = np.zeros(hi - lo, dtype=bool)
        if gated:
            if pd.isna(r["_run"]):
                found[max(size - 1 - lo, 0) :] = size - 1 >= lo and size - 1 < hi
            else:
                x = _floats(r["_x"])
                with np.errstate(invalid="ignore"):
                    flags = np.abs(x - r["_mean"]) > r["_reach"]
                flags &= np.arange(at, at + len(x)) < r["_run"]
                flags = np.concatenate([[False], flags, [False]])
                i = np.arange(lo, hi) - at + 1
                found = ~flags[i] & (flags[i - 1] ^ flags[i + 1])
        if lo == 0:
            found[0] = True
        return lo + np.flatnonzero(found)

    def ends(r):
        own = cuts_of(r)
        return (int(own[0]), int(own[-1])) if len(own) else (None, None)

    def smooth(r):
        lo, hi, at, x = int(r["_lo"]), int(r["_hi"]), int(r["_at"]), _floats(r["_x"])
        own = cuts_of(r)
        bounds = [*([] if len(own) and own[0] == lo else [int(r["_before"])]), *own.tolist(), int(r[SIZE]) if pd.isna(r["_after"]) else int(r["_after"])]
        result = np.empty(hi - lo)
        for a, b in zip(bounds, bounds[1:]):
            i0, i1 = max(a, lo), min(b, hi)
            if b - a <= 3:
                result[i0 - lo : i1 - lo] = x[i0 - at : i1 - at]
                continue
            wing = kernels.wing_of(width, b - a)
            j = np.arange(i0 - wing, i1 + wing)
            j = np.where(j < a, 2 * a - 1 - j, np.where(j >= b, 2 * b - 1 - j, j))
            result[i0 - lo : i1 - lo] = pd.Series(x[j - at]).rolling(2 * wing + 1, 1).median().to_numpy()[2 * wing :]
        return (result.tolist(),)

    known = each_chunk(table, [StructField("_first", LongType()), StructField("_final", LongType())], ends).select(*keys, "_chunk", "_first", "_final")
    along = Window.partitionBy(*keys).orderBy("_chunk")  # a row for each chunk
    near = known.select(
        *keys, "_chunk", F.last("_final", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    table = with_each(table, near, [*keys, "_chunk"])
    values = each_chunk(table, [StructField(out, ArrayType(DoubleType()))], smooth)
    return joined(rows, unpacked(values, keys, out), keys, out)


def decaying_mean(df: DataFrame, keys: list[str], order: list, span: float, column: str = "log2", out: str = "smoothed") -> DataFrame:
    """WIN-17: df with the exponentially weighted mean of column in order, a block of keys at a time.

    The sums of weighted values and of weights are recursions x[t] = d x[t-1] + v[t], so a chunk
    maps the state before it to the one after by (d^length, own sum): these pairs combine in
    order, and each chunk then adds what comes before it. A null adds nothing and keeps the mean.
    """
    keep = 1 - 2 / (span + 1)

    def sums(r):
        x = _floats(r["_x"])[int(r["_lo"]) - int(r["_at"]) :][: int(r["_hi"]) - int(r["_lo"])]
        has = ~np.isnan(x)
        weight = (1 - keep ** np.arange(1, len(x) + 1)) / (1 - keep)  # ewm divides by it
        return tuple(pd.Series(v.astype(float)).ewm(alpha=1 - keep).mean().to_numpy() * weight for v in (np.where(has, x, 0.0), has))

    rows = placed(df, keys, order)
    table = chunks(rows, keys, column, F.lit(0))
    fields = [StructField("_value", DoubleType()), StructField("_weight", DoubleType())]
    own = kept(each_chunk(table, fields, lambda r: tuple(float(s[-1]) for s in sums(r))).select(*keys, "_chunk", (F.col("_hi") - F.col("_lo")).alias("_length"), "_value", "_weight"), "sums")
    carry: dict[tuple, tuple[float, float]] = {}
    state: dict[tuple, tuple[float, float]] = {}
    for r in own.orderBy("_chunk").collect():  # a row for each chunk
        block = tuple(r[k] for k in keys)
        value, weight = state.get(block, (0.0, 0.0))
        carry[(*block, r["_chunk"])] = value, weight
        fade = keep ** r["_length"]
        state[block] = value * fade + r["_value"], weight * fade + r["_weight"]
    spark = df.sparkSession
    schema = StructType([own.schema[k] for k in keys] + [own.schema["_chunk"], StructField("_v0", DoubleType()), StructField("_w0", DoubleType())])
    before = spark.createDataFrame([(*k, *v) for k, v in carry.items()], schema)

    def finished(r):
        value, weight = sums(r)
        fade = keep ** np.arange(1, len(value) + 1)
        value, weight = value + fade * r["_v0"], weight + fade * r["_w0"]
        with np.errstate(invalid="ignore", divide="ignore"):
            return ([None if np.isnan(v) else float(v) for v in value / weight],)

    values = each_chunk(with_each(table, before, [*keys, "_chunk"]), [StructField(out, ArrayType(DoubleType()))], finished)
    return joined(rows, unpacked(values, keys, out), keys, out)
