"""Ordered-signal operators: kernels run by sample and chromosome (or arm, or block)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import kernels
from ..functions.genome import SEED, sample_keys
from . import halo
from .order import lookup, ordered_parts
from .ranges import range_join, with_row_id
from .runs import by_arm


def grouped(df: DataFrame, keys: list[str], name: str, kernel: Callable[[pd.DataFrame], np.ndarray], kind=None) -> DataFrame:
    """df with a column made by kernel from each group's rows in order of start and end."""
    fields = [f for f in df.schema.fields if f.name != name] + [StructField(name, kind or DoubleType())]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        order = [c for c in ("chromosome", "start", "end", "row_id") if c in rows.columns]
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        rows[name] = kernel(rows)
        return rows[[f.name for f in fields]]

    return df.groupBy(*(keys or [F.lit("")])).applyInPandas(run, StructType(fields))


def _values(rows: pd.DataFrame, column: str = "log2") -> np.ndarray:
    return rows[column].to_numpy(dtype=float)


def rolling_median(df: DataFrame, width: float, gated: bool = True, column: str = "log2", out: str = "smoothed") -> DataFrame:
    """WIN-02 by chromosome."""
    return grouped(df, [*sample_keys(df), "chromosome"], out, lambda r: kernels.rolling_median(_values(r, column), width, gated))


def moving_median(df: DataFrame, wing: int, column: str = "log2", out: str = "smoothed") -> DataFrame:
    """WIN-02 without mirrored edges: built-in, any number of rows."""
    w = Window.partitionBy(*sample_keys(df), "chromosome").orderBy("start", "end", *([c for c in ("row_id",) if c in df.columns])).rowsBetween(-wing, wing)
    return df.withColumn(out, F.percentile(F.col(column), F.lit(0.5)).over(w))


def moving_quantile(df: DataFrame, wing: int, q: float, column: str = "log2", out: str = "quantile") -> DataFrame:
    """WIN-04 without mirrored edges."""
    w = Window.partitionBy(*sample_keys(df), "chromosome").orderBy("start", "end", *([c for c in ("row_id",) if c in df.columns])).rowsBetween(-wing, wing)
    return df.withColumn(out, F.percentile(F.col(column), F.lit(q)).over(w))


def rolling_quantile(df: DataFrame, width: float, q: float, column: str = "log2", out: str = "quantile") -> DataFrame:
    return grouped(df, [*sample_keys(df), "chromosome"], out, lambda r: kernels.rolling_quantile(_values(r, column), width, q))


def rolling_std(df: DataFrame, width: float, column: str = "log2", out: str = "spread") -> DataFrame:
    return grouped(df, [*sample_keys(df), "chromosome"], out, lambda r: kernels.rolling_std(_values(r, column), width))


def smooth_log2(df: DataFrame, bandwidth: float | None = None, arms: bool = True) -> DataFrame:
    """WIN-12: Savitzky-Golay by arm (or chromosome), weighted where there are weights."""
    rows = by_arm(df) if arms else df
    keys = [*sample_keys(df), "chromosome", *(["arm"] if arms else [])]

    def kernel(r):
        w = r["weight"].to_numpy(dtype=float) if "weight" in r else None
        width = bandwidth or kernels.guess_window(_values(r), w)
        return kernels.savgol(_values(r), width, w)

    return grouped(rows, keys, "smoothed", kernel).drop("arm")


def savgol(df: DataFrame, total_width: float | None = None, column: str = "log2", out: str = "smoothed") -> DataFrame:
    """WIN-05 by chromosome."""
    return grouped(df, [*sample_keys(df), "chromosome"], out, lambda r: kernels.savgol(_values(r, column), total_width))


def kaiser(df: DataFrame, width: float, column: str = "log2", out: str = "smoothed", fit_edges: bool = False) -> DataFrame:
    """WIN-07 by chromosome."""
    return grouped(df, [*sample_keys(df), "chromosome"], out, lambda r: kernels.kaiser(_values(r, column), width, None, fit_edges))


def flag_outliers(df: DataFrame, width: int = 50, factor: float = 10.0, kind: str = "quantile") -> DataFrame:
    """WIN-10 by chromosome: is_outlier."""
    return grouped(df, [*sample_keys(df), "chromosome"], "is_outlier", lambda r: kernels.rolling_outliers(_values(r), width, kind, 0.95, factor), BooleanType())


def drop_outliers(df: DataFrame, width: int = 50, factor: float = 10.0) -> DataFrame:
    """WIN-11."""
    return flag_outliers(df, width, factor).where(~F.col("is_outlier")).drop("is_outlier")


def outliers_iqr(df: DataFrame, column: str = "log2", c: float = 3.0) -> DataFrame:
    """WIN-09: is_outlier by the interquartile range of the chromosome; built-in."""
    w = Window.partitionBy(*sample_keys(df), "chromosome")
    q = F.percentile(F.col(column), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(w)
    out = df.withColumn("_q", q)
    return out.withColumn("is_outlier", F.abs(F.col(column) - F.get("_q", F.lit(1))) > c * (F.get("_q", F.lit(2)) - F.get("_q", F.lit(0)))).drop("_q")


def outliers_mad(df: DataFrame, column: str = "log2", c: float = 2.24) -> DataFrame:
    """WIN-09: is_outlier by the median absolute deviation of the chromosome; built-in."""
    w = Window.partitionBy(*sample_keys(df), "chromosome")
    out = df.withColumn("_g", F.abs(F.col(column) - F.median(column).over(w)))
    return out.withColumn("_m", F.median("_g").over(w)).withColumn("is_outlier", F.col("_g") > c * F.col("_m")).drop("_g", "_m")


def residuals(df: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """WIN-13: df with residual: from the chromosome's median, or from the segment around each bin."""
    keys = [*sample_keys(df), "chromosome"]
    if segments is None:
        return df.withColumn("residual", F.col("log2") - F.median("log2").over(Window.partitionBy(*keys)))
    if "log2" in segments.columns:
        pairs = range_join(segments, df, "inner")
        return pairs.select("s.*", (F.col("s.log2") - F.col("q.log2")).alias("residual"))
    pairs = range_join(with_row_id(segments), df)
    return pairs.select("s.*", (F.col("s.log2") - F.median("s.log2").over(Window.partitionBy("q.row_id"))).alias("residual"))


def spread_order(chromosome: str = "chromosome", start: str = "start") -> Column:
    """A number below 2^32 that puts neighbours far apart and every stretch of the genome everywhere: multiples of the golden ratio's part of 2^32, from a seeded place for each chromosome."""
    begin = F.conv(F.substring(F.md5(F.concat_ws(":", chromosome, F.lit(str(SEED)))), 1, 8), 16, 10).cast("long")
    return (F.col(start).cast("long") % (1 << 31) * 2654435769 + begin) % (1 << 32)


def center_by_window(df: DataFrame, fraction: float, sort_key: Column, block: list[str] | None = None) -> DataFrame:
    """WIN-14: log2 less its rolling median along sort_key, a block (sample) at a time; rows with equal keys in an order that leaves no stretch of the genome together."""
    rows = df.withColumns({"_key": sort_key.cast("double"), "_tie": spread_order()})
    order = [F.col("_key").asc_nulls_last(), F.col("_tie"), F.col("chromosome"), F.col("start"), F.col("end"), F.col("log2")]
    out = halo.rolling_median(rows, sample_keys(df) if block is None else block, order, fraction, "log2", "_bias")
    return out.withColumn("log2", F.col("log2") - F.col("_bias")).select(*df.columns)


def edge_bias(df: DataFrame, margin: int = 250) -> DataFrame:
    """WIN-15: df with edge_bias, what a bin gains from its neighbours' fragments less what it loses at its ends."""
    w = Window.partitionBy(*sample_keys(df), "chromosome").orderBy("start", "end", *([c for c in ("row_id",) if c in df.columns]))
    size, m = (F.col("end") - F.col("start")).cast("double"), float(margin)
    loss = m / (2 * size) - F.when(size < m, F.pow(m - size, F.lit(2.0)) / (2 * m * size)).otherwise(0.0)

    def gain(gap):
        g = F.greatest(gap, F.lit(0)).cast("double")
        over = F.when(size + g < m, F.pow(m - size - g, F.lit(2.0)) / (4 * m * size)).otherwise(0.0)
        return F.when(gap < margin, F.pow(m - g, F.lit(2.0)) / (4 * m * size) - over).otherwise(0.0)

    before, after = F.col("start") - F.lag("end").over(w), F.lead("start").over(w) - F.col("end")
    return df.withColumn("edge_bias", F.coalesce(gain(before), F.lit(0.0)) + F.coalesce(gain(after), F.lit(0.0)) - loss)


def adjust_bh(df: DataFrame, p: str = "p", out: str = "q", group: list[str] | None = None) -> DataFrame:
    """WIN-16: Benjamini-Hochberg, by sample where there are several.

    Without samples the rows are put in ranges of p; a range needs only its first rank and the
    least value of the ranges after it, so no task holds all rows.
    """
    keys = sample_keys(df) if group is None else group
    tail = [c for c in ("chromosome", "start", "end", "row_id") if c in df.columns]
    back = Window.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    if keys:
        part = Window.partitionBy(*keys)
        ranked = df.withColumns({"_n": F.count("*").over(part), "_r": F.row_number().over(part.orderBy(p, *tail))})
        least = F.min(F.col(p) * F.col("_n") / F.col("_r")).over(back.partitionBy(*keys))
        return ranked.withColumn(out, F.least(F.lit(1.0), least)).drop("_n", "_r")
    held = ordered_parts(df, [p, *tail])
    sizes = {r["_part"]: r["count"] for r in held.groupBy("_part").count().collect()}  # a row for each range
    starts, n = {}, 0
    for k in sorted(sizes):
        starts[k], n = n, n + sizes[k]
    ranked = held.withColumn("_r", lookup(starts, "long") + F.col("_at") + 1)
    value = F.col(p) * n / F.col("_r")
    lows = {r["_part"]: r["low"] for r in ranked.groupBy("_part").agg(F.min(value).alias("low")).collect()}  # likewise
    after, least = {}, None
    for k in sorted(lows, reverse=True):
        after[k] = least
        least = lows[k] if least is None or (lows[k] is not None and lows[k] < least) else least
    own = F.min(value).over(back.partitionBy("_part"))
    return ranked.withColumn(out, F.least(F.lit(1.0), own, lookup(after, "double"))).drop("_r", "_part", "_at")


def ewm(df: DataFrame, span: float = 3.0, column: str = "log2", out: str = "smoothed") -> DataFrame:
    """WIN-17 over each sample's whole signal."""
    order = [c for c in ("chromosome", "start", "end", "row_id") if c in df.columns]
    return halo.decaying_mean(df, sample_keys(df), order, span, column, out)


def shorten_labels(df: DataFrame) -> DataFrame:
    """WIN-18: rows in a run that share a gene name get the shortest of the shared names."""
    fields = df.schema

    def shortest(names: set[str]) -> str:
        names = {n for n in names if not n.startswith("mRNA")} or names
        return min((n.rsplit("|", 1)[-1] for n in names), key=lambda n: (len(n), n))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["chromosome", "start", "end"], kind="stable").reset_index(drop=True)
        out, held, shared = [], 0, set()
        for gene in rows["gene"]:
            names = set(str(gene).rstrip().split(","))
            if held and shared & names:
                shared &= names
            else:
                out += [shortest(shared)] * held if held else []
                held, shared = 0, names
            held += 1
        out += [shortest(shared)] * held if held else []
        return rows.assign(gene=out)

    return df.groupBy(*sample_keys(df), "chromosome").applyInPandas(run, fields)
