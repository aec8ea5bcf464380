"""Robust statistics of groups of any size: no task holds a group.

Medians are found by counting: values are dealt to stretches between the least and the greatest,
and the stretch that holds the middle is dealt again, until its values are equal or the middle
lies between two stretches. The driver holds a few numbers for each group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.stats import MAD_SCALE
from ..sources.scratch import kept
from .halo import with_each

#: Stretches of a group's values that are counted in a pass.
STRETCHES = 4096


def _beside(rows: DataFrame, keys: list[str], state: dict[tuple, tuple], names: list[str]) -> DataFrame:
    """rows of the groups in state, with its numbers."""
    schema = StructType([rows.schema[k] for k in keys] + [StructField(n, DoubleType()) for n in names])
    table = rows.sparkSession.createDataFrame([(*k, *map(float, v)) for k, v in state.items()], schema)
    return with_each(rows, F.broadcast(table), keys).where(F.col(names[0]).isNotNull())


def medians(rows: DataFrame, keys: list[str], x: Column) -> dict[tuple, tuple[int, float]]:
    """The count and the exact median of x in each group; x has no nulls and no NaN."""
    rows = rows.select(*keys, x.alias("_x"))
    finite = F.when(F.abs("_x") < math.inf, F.col("_x"))
    key = lambda r: tuple(r[k] for k in keys)
    first = rows.groupBy(*keys).agg(F.count("_x").alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi")).collect()  # a row for each group
    size = {key(r): r["n"] for r in first}
    within = {key(r): (r["lo"] if r["lo"] is not None else 0.0, r["hi"] if r["hi"] is not None else 0.0) for r in first}
    below, found, whole = dict.fromkeys(size, 0), {}, True
    while within:
        near = _beside(rows, keys, within, ["_lo", "_hi"])
        if not whole:
            near = near.where(F.col("_x").between(F.col("_lo"), F.col("_hi")))
        place = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * STRETCHES)).otherwise(0)
        place = F.when(F.col("_x") == -math.inf, -1).when(F.col("_x") == math.inf, STRETCHES + 1).otherwise(place)
        counted: dict[tuple, list] = {}
        for r in near.groupBy(*keys, place.alias("_at")).agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi")).collect():  # STRETCHES rows at most for each group
            counted.setdefault(key(r), []).append((r["_at"], r["n"], r["lo"], r["hi"]))
        after = {}
        for k, stretches in counted.items():
            n, at, low = size[k], below[k], None
            for _, count, lo, hi in sorted(stretches):
                if at <= (n - 1) // 2 < at + count:
                    if n // 2 < at + count and lo < hi:  # both middle values are in it
                        after[k], below[k] = (lo, hi), at
                        break
                    low = hi
                if at <= n // 2 < at + count:
                    found[k] = n, lo if low == lo else (low + lo) / 2
                    break
                at += count
        within, whole = after, False
    return found


def biweight_midvariances(df: DataFrame, keys: list[str], column: str, out: str, epsilon: float = 1e-3, max_iter: int = 5) -> DataFrame:
    """STA-02 of each group as stats.biweight_midvariance has it: keys and out."""
    x = F.col(column)
    rows = kept(df.select(*keys, column).where(x.isNotNull() & ~F.isnan(x)), "values")
    size, center = {}, {}
    for k, (n, m) in medians(rows, keys, x).items():
        size[k], center[k] = n, (m,)
    gap = F.col(column) - F.col("_center")

    def spreads(of: dict, factor: float) -> DataFrame:
        """rows of some groups with _center and _mad, and _reach."""
        mads = medians(_beside(rows, keys, of, ["_center"]), keys, F.abs(gap))
        return _beside(rows, keys, {k: (*of[k], mads[k][1]) for k in of}, ["_center", "_mad"]).withColumn("_reach", F.greatest(factor * F.col("_mad"), F.lit(epsilon)))

    moving = {k: v for k, v in center.items() if size[k] > 1}
    for _ in range(max_iter):
        if not moving:
            break
        pull = F.pow(1 - F.pow(gap / F.col("_reach"), F.lit(2.0)), F.lit(2.0))
        sums = spreads(moving, 6.0).withColumns({"_gap": gap, "_pull": pull}).where("_pull < 1").groupBy(*keys).agg(F.sum("_pull").alias("mass"), F.sum(F.col("_gap") * F.col("_pull")).alias("sum")).collect()  # a row for each group
        before, moving = moving, {}
        for r in sums:
            k = tuple(r[c] for c in keys)
            if r["mass"]:
                shift = r["sum"] / r["mass"]
                center[k] = (before[k][0] + shift,)
                if abs(shift) > epsilon:
                    moving[k] = center[k]
    u = F.pow(gap / F.col("_reach"), F.lit(2.0))
    at = spreads(center, 9.0).withColumns({"_gap": gap, "_u": u})
    inside = lambda c: F.sum(F.when(F.col("_u") < 1, c))
    sums = at.groupBy(*keys).agg(
        F.count("*").alias("_all"), F.first("_mad").alias("_mad"), inside(F.lit(1)).alias("_n"), inside((1 - F.col("_u")) * (1 - 5 * F.col("_u"))).alias("_low"),
        inside(F.pow("_gap", F.lit(2.0)) * F.pow(1 - F.col("_u"), F.lit(4.0))).alias("_top"),
    )
    spread = F.when(F.col("_low") == 0, None).otherwise(F.sqrt(F.col("_n") * F.col("_top") / F.pow("_low", F.lit(2.0))))
    return sums.select(*keys, F.when(F.col("_all") < 2, 0.0).otherwise(F.coalesce(spread, F.col("_mad") * MAD_SCALE)).alias(out))
