"""Gaps and islands along a chromosome: arms, level runs, gene runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..functions.genome import IGNORED_GENES, OFF_TARGET, OFF_TARGET_ALIASES, require_columns, sample_keys
from .intervals import join_strings
from .ranges import range_join, with_row_id


def _order(df: DataFrame) -> list[str]:
    return ["start", "end", *[c for c in ("row_id",) if c in df.columns]]


def by_arm(df: DataFrame, min_gap: int = 100_000, min_bins: int = 50) -> DataFrame:
    """AGG-23: df with arm, p or q, parted at the largest gap away from the chromosome's ends."""
    keys = [*sample_keys(df), "chromosome"]
    w = Window.partitionBy(*keys).orderBy(*_order(df))
    whole = Window.partitionBy(*keys)
    margin = F.greatest(F.lit(min_bins).cast("double"), F.bround(0.1 * F.col("_n"), 0))
    rows = df.withColumns({"_rn": F.row_number().over(w) - 1, "_n": F.count("*").over(whole), "_gap": F.col("start") - F.lag("end").over(w)})
    inner = (F.col("_n") > 2 * margin + 1) & (F.col("_rn") >= margin + 1) & (F.col("_rn") <= F.col("_n") - margin - 1)
    rows = rows.withColumn("_best", F.max(F.when(inner, F.struct("_gap", (-F.col("_rn")).alias("r")))).over(whole))
    q = (F.col("_best._gap") >= min_gap) & (F.col("_rn") >= -F.col("_best.r"))
    return rows.withColumn("arm", F.when(F.coalesce(q, F.lit(False)), "q").otherwise("p")).drop("_rn", "_n", "_gap", "_best")


def run_ids(df: DataFrame, levels: list[Column | str], by_arm_too: bool = False, compat: bool = False) -> DataFrame:
    """AGG-15/16: df with run, a number that steps where a level, the chromosome or the arm changes.

    compat: numeric level differences add up and count when whole units are reached.
    """
    keys = [*sample_keys(df), "chromosome", *(["arm"] if by_arm_too else [])]
    rows = by_arm(df) if by_arm_too and "arm" not in df.columns else df
    w = Window.partitionBy(*keys).orderBy(*_order(df))
    cols = [F.col(x) if isinstance(x, str) else x for x in levels]
    rows = rows.withColumns({f"_l{i}": c for i, c in enumerate(cols)})
    names = [f"_l{i}" for i in range(len(cols))]
    steady = w.rowsBetween(Window.unboundedPreceding, 0)
    if compat:
        parts = [F.coalesce(F.abs(F.col(n) - F.lag(n).over(w)), F.lit(0.0)) for n in names]
        rows = rows.withColumns({f"_d{i}": p for i, p in enumerate(parts)})
        run = F.concat_ws("/", *[F.floor(F.sum(f"_d{i}").over(steady)).cast("string") for i in range(len(parts))])
        return rows.withColumn("run", run).drop(*names, *[f"_d{i}" for i in range(len(parts))])
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.lag(n).over(w))
    changed = F.when((F.row_number().over(w) > 1) & ~same, 1).otherwise(0)
    return rows.withColumn("_c", changed).withColumn("run", F.sum("_c").over(steady).cast("string")).drop("_c", *names)


def _weighted_median(rows: DataFrame, keys: list[str], c: str) -> tuple[DataFrame, Column]:
    """STA-04 built in: rows with running weights in order of c, and the aggregate by keys; the window spills, so a run may have any number of rows."""
    part = Window.partitionBy(*keys)
    w = part.orderBy(F.col(c).asc_nulls_last())
    weight = F.when(F.col(c).isNotNull(), F.coalesce(F.col("weight"), F.lit(0.0))).otherwise(0.0)
    names = (f"_{c}_sum", f"_{c}_half", f"_{c}_next")
    rows = rows.withColumns({names[0]: F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)), names[1]: 0.5 * F.sum(weight).over(part), names[2]: F.lead(c).over(w).cast("double")})
    reached = F.col(c).isNotNull() & (F.col(names[0]) >= F.col(names[1]))
    first = F.min(F.when(reached, F.struct(F.col(names[0]).alias("s"), F.col(c).cast("double").alias("v"), F.col(names[2]).alias("n"), F.col(names[1]).alias("h"))))
    return rows, F.when((F.abs(first["s"] - first["h"]) < 1e-12) & first["n"].isNotNull(), (first["v"] + first["n"]) / 2).otherwise(first["v"])


def squash(df: DataFrame, levels: list[Column | str], by_arm_too: bool = False, compat: bool = False) -> DataFrame:
    """AGG-15/17: one row for each run of equal levels."""
    rows = run_ids(df if "weight" in df.columns else df.withColumn("weight", F.lit(1.0)), levels, by_arm_too, compat)
    keys = [*sample_keys(df), "chromosome", *(["arm"] if by_arm_too else []), "run"]
    order = _order(df)
    mean = lambda c: stats.weighted_mean(c, "weight")
    copies = [c for c in ("cn", "cn1") if c in df.columns]
    native: dict[str, Column] = {}
    if not compat:
        for c in copies:
            rows, native[c] = _weighted_median(rows, keys, c)
    native |= {
        "start": F.min_by("start", F.struct(*order)),
        "end": F.max_by("end", F.struct(*order)),
        "gene": join_strings("gene", order),
        "log2": mean("log2"),
        "probes": F.sum("probes") if "probes" in df.columns else F.count("*"),
        "weight": F.sum("weight"),
    }
    native |= {c: mean(c) for c in ("depth", "baf") if c in df.columns}
    if "p_bintest" in df.columns:
        native["p_bintest"] = F.max("p_bintest")
    out = rows.groupBy(*keys).agg(*[e.alias(c) for c, e in native.items() if c in df.columns or c in ("weight", "probes")])
    if copies and compat:  # grouped Python aggregates do not mix with built-in ones
        median = stats.udaf(lambda a, w: stats.weighted_median(a, w, compat), weighted=True)
        calls = rows.groupBy(*keys).agg(*[median(F.col(c).cast("double"), F.col("weight")).alias(c) for c in copies])
        out = out.join(calls, keys)
    if "cn1" in copies:
        out = out.withColumn("cn2", F.col("cn") - F.col("cn1"))
    return out.drop("run", *(["arm"] if by_arm_too else []))


def filter_segments(df: DataFrame, name: str) -> DataFrame:
    """AGG-18: merge segments that the filter does not tell apart."""
    return SEGMENT_FILTERS[name](df)


def ampdel(df: DataFrame) -> DataFrame:
    """Only losses of all copies and gains to five or more."""
    require_columns(df, "cn")
    level = F.when(F.col("cn") == 0, -1).when(F.col("cn") >= 5, 1).otherwise(0)
    return squash(df, [level]).where((F.col("cn") == 0) | (F.col("cn") >= 5))


def ci(df: DataFrame) -> DataFrame:
    """By whether the confidence interval leaves out 0."""
    require_columns(df, "ci_lo", "ci_hi")
    return squash(df, [F.when(F.col("ci_hi") < 0, -1).when(F.col("ci_lo") > 0, 1).otherwise(0)])


def cn(df: DataFrame) -> DataFrame:
    """By copies, and by those of each allele where known."""
    require_columns(df, "cn")
    return squash(df, [c for c in ("cn", "cn1", "cn2") if c in df.columns])


def sem(df: DataFrame, z: float = 1.96) -> DataFrame:
    """By whether the standard error's interval leaves out 0."""
    require_columns(df, "sem")
    margin = z * F.col("sem")
    return squash(df, [F.when(F.col("log2") + margin < 0, -1).when(F.col("log2") - margin > 0, 1).otherwise(0)])


SEGMENT_FILTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"ampdel": ampdel, "ci": ci, "cn": cn, "sem": sem}


#: Bins in a stretch of a chromosome, in which bins and genes meet.
GENE_STRETCH = 256


def by_gene(df: DataFrame, ignore: tuple[str, ...] = IGNORED_GENES) -> DataFrame:
    """AGG-21: (bins with) gene_run and gene_name: spans from a gene's first to its last bin in each
    chromosome; bins outside all of them are off-target runs. A bin in two genes comes twice."""
    keys = [*sample_keys(df), "chromosome"]
    w = Window.partitionBy(*keys).orderBy(*_order(df))
    rows = df.withColumn("_rn", F.row_number().over(w))
    skip = [*ignore, *OFF_TARGET_ALIASES]
    spans = (
        rows.select(*keys, "_rn", F.explode(F.split("gene", ",")).alias("gene_name"))
        .where(~F.col("gene_name").isin(*skip))
        .groupBy(*keys, "gene_name")
        .agg(F.min("_rn").alias("_a"), F.max("_rn").alias("_b"))
    )
    # by stretches of ordinals, so that a chromosome's bins meet only the genes around them
    stretch = lambda c: F.floor(F.col(c) / GENE_STRETCH)
    dealt = spans.withColumn("_s", F.explode(F.sequence(stretch("_a"), stretch("_b"))))
    inside = rows.withColumn("_s", stretch("_rn")).join(dealt, [*keys, "_s"]).where(F.col("_rn").between(F.col("_a"), F.col("_b"))).drop("_s")
    covered = inside.select(*keys, "_rn").distinct()
    outside = rows.join(covered, [*keys, "_rn"], "left_anti")
    gaps = Window.partitionBy(*keys).orderBy("_rn")
    outside = outside.withColumn("_a", F.col("_rn") - F.row_number().over(gaps)).withColumn("gene_name", F.lit(OFF_TARGET))
    inside = inside.withColumn("gene_run", F.col("_a").cast("long")).drop("_a", "_b")
    outside = outside.withColumn("gene_run", -1 - F.col("_a").cast("long")).drop("_a")
    return inside.unionByName(outside).drop("_rn")


def squash_genes(df: DataFrame, summary: Callable = stats.biweight_location, squash_off_target: bool = False, ignore: tuple[str, ...] = IGNORED_GENES) -> DataFrame:
    """AGG-20: one row for each gene run; summary over log2 and the numeric extras."""
    rows = by_gene(df, ignore)
    keys = [*sample_keys(df), "chromosome", "gene_run", "gene_name"]
    numeric = [c for c, t in df.dtypes if t in ("double", "float") and c not in ("start", "end", "probes")]
    stats.bound_batches(df.sparkSession)
    kernel = stats.of_arrays(summary)
    off = rows.where((F.col("gene_name") == OFF_TARGET) & F.lit(not squash_off_target))
    on = rows.where((F.col("gene_name") != OFF_TARGET) | F.lit(squash_off_target))
    ends = on.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.sum("probes") if "probes" in df.columns else F.count("*")).alias("probes"))
    lists = on.groupBy(*keys).agg(*[stats.held(c).alias(c) for c in numeric])
    values = lists.select(*keys, *[kernel(F.col(c)).alias(c) for c in numeric])
    out = ends.join(values, keys).withColumn("gene", F.col("gene_name")).drop("gene_run", "gene_name")
    single = off.withColumn("probes", F.lit(1).cast("long") if "probes" not in df.columns else F.col("probes"))
    return out.unionByName(single.select(*out.columns))


def transfer_fields(segments: DataFrame, bins: DataFrame, ignore: tuple[str, ...] = IGNORED_GENES) -> DataFrame:
    """AGG-24: segments stretched to their chromosome's bins, with weight, depth, probes and genes of the bins in them."""
    keys = [*sample_keys(segments, bins), "chromosome"]
    extent = bins.groupBy(*keys).agg(F.min("start").alias("_lo"), F.max("end").alias("_hi"))
    w = Window.partitionBy(*keys)
    seg = segments.join(extent, keys, "left")
    seg = seg.withColumns({"_first": F.col("start") == F.min("start").over(w), "_last": F.col("end") == F.max("end").over(w)})
    seg = seg.withColumns(
        {"start": F.when(F.col("_first"), F.coalesce("_lo", "start")).otherwise(F.col("start")), "end": F.when(F.col("_last"), F.coalesce("_hi", "end")).otherwise(F.col("end"))}
    ).drop("_lo", "_hi", "_first", "_last")
    seg = with_row_id(seg)
    weighted = "weight" in bins.columns
    source = bins if weighted else bins.withColumn("weight", F.lit(1.0))
    skip = [*ignore, *OFF_TARGET_ALIASES]
    names = F.filter(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("s.start", "s.end", F.col("s.gene").alias("g")))), lambda x: F.split(x["g"], ","))),
        lambda g: ~g.isin(*skip),
    )
    flat = range_join(seg, source).select(F.col("q.row_id").alias("row_id"), "s", F.col("s.weight").alias("w"), (F.col("s.depth") if "depth" in bins.columns else F.lit(None).cast("double")).alias("d"))
    found = flat.groupBy("row_id").agg(
        F.sum("w").alias("weight"), stats.weighted_mean("d", "w").alias("depth"), F.array_join(F.array_distinct(names), ",").alias("gene"), F.count("*").alias("probes")
    )
    out = seg.drop("weight", "depth", "gene", "probes").join(found, "row_id", "left")
    return out.withColumn("gene", F.when(F.coalesce("gene", F.lit("")) == "", "-").otherwise(F.col("gene")))


def spike_into_segments(bins: DataFrame, segments: DataFrame, significant: str = "is_sig") -> DataFrame:
    """AGG-25: segments parted at significant bins."""
    rows = range_join(with_row_id(segments.select(*sample_keys(segments, bins), "chromosome", "start", "end"), "row_id"), bins)
    level = F.concat_ws(":", F.col("q.row_id").cast("string"), F.col(f"s.{significant}").cast("string"))
    return squash(rows.select("s.*", level.alias("_level")), ["_level"])
