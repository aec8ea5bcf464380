"""Copy-number operators: centring, sex, weights, correction, references, metrics, calls, genes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType
from pyspark.sql.window import Window

from ..functions import genome as g
from ..functions import stats
from ..sources.scratch import kept
from .ranges import baf_by_ranges, match_reference, range_join, with_row_id
from .robust import biweight_midvariances
from .runs import SEGMENT_FILTERS, by_gene
from .signal import adjust_bh, center_by_window, edge_bias, residuals

ESTIMATORS = {"mean": F.avg, "median": F.median, "mode": stats.modal_location, "biweight": stats.biweight_location}


def _one_row(df: DataFrame, single: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of a table of one row for each sample (or one row in all)."""
    return df.join(F.broadcast(single), keys, "left") if keys else df.join(F.broadcast(single), F.lit(True), "left")


def center_all(df: DataFrame, estimator: str = "mean", by_chrom: bool = True, skip_low: bool = False) -> DataFrame:
    """STA-17: log2 shifted so that the autosomes' estimate is 0."""
    keys = sample_keys = g.sample_keys(df)
    rows = g.autosomes(g.drop_low_coverage(df) if skip_low else df)
    rule = ESTIMATORS[estimator]
    agg = rule if estimator in ("mean", "median") else stats.udaf(rule)
    if by_chrom:
        rows = rows.groupBy(*keys, "chromosome").agg(agg("log2").alias("log2"))
    shift = rows.groupBy(*sample_keys).agg(agg("log2").alias("_shift"))
    return _one_row(df, shift, keys).withColumn("log2", F.col("log2") - F.coalesce("_shift", F.lit(0.0))).drop("_shift")


def _mood_g(x: Column, on: Column, auto: Column, keys: list[str], df: DataFrame, name: str) -> DataFrame:
    """R-8: the G statistic of Mood's median test between two sets of rows, and their medians' difference."""
    part = keys or ["_all"]
    rows = df.withColumn("_x", x).where(on | auto).withColumn("_on", on)
    rows = rows.withColumn("_m", F.percentile("_x", F.lit(0.5)).over(Window.partitionBy(*part)))
    count = lambda cond: F.count_if(cond).cast("double")
    above, below = F.col("_x") > F.col("_m"), F.col("_x") < F.col("_m")
    t = rows.groupBy(*part).agg(
        count(above & F.col("_on")).alias("a"), count(above & ~F.col("_on")).alias("b"), count(below & F.col("_on")).alias("c"), count(below & ~F.col("_on")).alias("d"),
        F.median(F.when(F.col("_on"), F.col("_x"))).alias("_mo"), F.median(F.when(~F.col("_on"), F.col("_x"))).alias("_ma"),
    )
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    cells = [("a", "a", "b", "a", "c"), ("b", "a", "b", "b", "d"), ("c", "c", "d", "a", "c"), ("d", "c", "d", "b", "d")]
    total = F.lit(0.0)
    for cell, r1, r2, c1, c2 in cells:
        expected = F.try_divide((F.col(r1) + F.col(r2)) * (F.col(c1) + F.col(c2)), n)
        gap = expected - F.col(cell)
        observed = F.col(cell) + F.signum(gap) * F.least(F.lit(0.5), F.abs(gap))
        total = total + F.when(observed > 0, observed * F.ln(F.try_divide(observed, expected))).otherwise(0.0)
    return t.select(*part, F.greatest(2 * total, F.lit(0.0)).alias(name), F.abs(F.col("_mo") - F.col("_ma")).alias(f"{name}_gap"))


def compare_sex_chromosomes(df: DataFrame, male_reference: bool = False, skip_low: bool = False) -> DataFrame:
    """STA-15: (sample_id,) is_xx, x_ratio, y_ratio: is X, and Y, more like a male's or a female's?"""
    keys = g.sample_keys(df)
    rows = (g.drop_low_coverage(df) if skip_low else df).withColumn("_all", F.lit(1))
    part = keys or ["_all"]
    auto = g.is_autosome()
    shifts = {"x": (g.is_x(), (-1.0, 0.0) if male_reference else (0.0, 1.0)), "y": (g.is_y(), (3.0, 0.0))}
    out = None
    for name, (on, (female, male)) in shifts.items():
        for sex, shift in (("female", female), ("male", male)):
            x = F.col("log2") + F.when(on, shift).otherwise(0.0)
            one = _mood_g(x, on, auto, keys, rows, f"{name}_{sex}")
            out = one if out is None else out.join(one, part)
    ratio = lambda n: F.when(
        F.col(f"{n}_male").isNotNull(), F.col(f"{n}_female") / F.greatest(F.col(f"{n}_male"), F.lit(0.01))
    ).otherwise(F.col(f"{n}_female_gap") / F.greatest(F.col(f"{n}_male_gap"), F.lit(0.01)))
    scored = out.withColumns({"x_ratio": ratio("x"), "y_ratio": ratio("y")})
    product = F.coalesce("x_ratio", F.lit(1.0)) * F.coalesce("y_ratio", F.lit(1.0))
    return scored.select(*keys, (product <= 1).alias("is_xx"), "x_ratio", "y_ratio")


def sex_table(df: DataFrame, male_reference: bool = False) -> DataFrame:
    """STA-16: one row for each sample: sex and the mean log-ratios of X and Y."""
    keys = g.sample_keys(df)
    means = df.groupBy(*keys).agg(F.avg(F.when(g.is_x(), F.col("log2"))).alias("x_log2"), F.avg(F.when(g.is_y(), F.col("log2"))).alias("y_log2"))
    sexes = compare_sex_chromosomes(df, male_reference)
    joined = sexes.join(means, keys) if keys else sexes.join(means, F.lit(True))
    return joined.withColumn("sex", F.when(F.col("is_xx"), "Female").otherwise("Male"))


def average_depth(counts: DataFrame, read_length: float) -> DataFrame:
    """STA-19: depth of a typical chromosome, by length-weighted median (one row)."""
    median = stats.udaf(stats.weighted_median, weighted=True)
    rows = counts.select((F.lit(float(read_length)) * F.col("mapped") / F.col("length")).alias("d"), F.col("length").cast("double").alias("w"))
    return rows.groupBy().agg(median("d", "w").alias("depth"))


def apply_weights(df: DataFrame, log2: str = "ref_log2", spread: str = "ref_spread", epsilon: float = 1e-4, skip_low: bool = True) -> DataFrame:
    """STA-20: weights by bin size and variance (of covered bins, or all), and by the reference's spread where it has one."""
    keys = g.sample_keys(df)
    off = F.col("gene").isin(*g.OFF_TARGET_ALIASES)
    rows = df.withColumns({"_off": off, "_root": F.sqrt((F.col("end") - F.col("start")).cast("double"))})
    both = [*keys, "_off"]
    var = (g.drop_low_coverage(rows) if skip_low else rows).select(*both, F.concat_ws("/", F.col("chromosome"), F.col("_off").cast("string")).alias("chromosome"), "log2")
    var = biweight_midvariances(residuals(var), both, "residual", "_sd")
    size = rows.groupBy(*both).agg(F.avg("_root").alias("_mean"))
    spreads = rows.groupBy(*keys).agg(
        (F.coalesce(F.max(F.col(spread) > epsilon), F.lit(False)) & F.coalesce(F.max(F.abs(F.col(log2) % 1) > epsilon), F.lit(False))).alias("_use")
    )
    rows = _one_row(rows.join(F.broadcast(size), both).join(F.broadcast(var), both, "left"), spreads, keys)
    simple = 1 - F.coalesce(F.pow("_sd", F.lit(2.0)), F.lit(0.0)) / (F.col("_root") / F.col("_mean"))
    weight = F.when(F.col("_use"), 0.9 * (1 - F.pow(F.col(spread), F.lit(2.0))) + 0.1 * simple).otherwise(simple)
    return rows.withColumn("weight", F.least(F.greatest(weight, F.lit(epsilon)), F.lit(1.0))).drop("_off", "_root", "_sd", "_mean", "_use")


def correct_bias(df: DataFrame, do_gc: bool = True, do_edge: bool = True, do_mask: bool = True, order: tuple[str, ...] = ("gc", "edge", "rmask")) -> DataFrame:
    """FIX-01/FUN-12: centre by windows along GC, edge effect and masked share; left alone where most bins are empty."""
    keys = g.sample_keys(df)
    df = kept(df, "biased")  # read again for each step, and for the samples that no step takes
    covered = df.groupBy(*keys).agg((F.avg((F.col("log2") > g.NULL_LOG2 - g.MIN_REF_COVERAGE).cast("double")) > 0.5).alias("_covered"))
    rows = _one_row(df, covered, keys)
    good, rest = rows.where("_covered").drop("_covered"), rows.where("NOT coalesce(_covered, false)").drop("_covered")
    for step in order:
        if step == "gc" and do_gc and "gc" in df.columns:
            good = center_by_window(good, 0.1, F.col("gc"))
        elif step == "edge" and do_edge:
            good = center_by_window(edge_bias(good, g.INSERT_SIZE), 0.1, F.col("edge_bias")).drop("edge_bias")
        elif step == "rmask" and do_mask and "rmask" in df.columns:
            good = center_by_window(good, 0.1, F.col("rmask"))
    return good.unionByName(rest)


def correct(target: DataFrame, reference: DataFrame, off_target: DataFrame | None = None, do_gc: bool = True, do_edge: bool = True, do_mask: bool = True) -> DataFrame:
    """FIX-01: a sample's bins against the reference: bias, log-ratio, weight, centre."""
    reference = kept(reference, "reference")
    extra = [c for c in ("log2", "spread", "depth", "gc", "rmask") if c in reference.columns]

    def one(bins, edge):
        rows = match_reference(bins, reference, extra)
        test = rows.select(*[c for c in rows.columns if not c.startswith("ref_")], *[F.col(f"ref_{c}") for c in extra])
        bad = g.bad_bin(reference.select(*extra))
        renamed = test.withColumnsRenamed({c: f"_own_{c}" for c in extra if c in test.columns and c in ("log2", "spread", "depth", "gc", "rmask")})
        flagged = renamed.withColumnsRenamed({f"ref_{c}": c for c in extra}).withColumn("_bad", bad).where(~F.col("_bad")).drop("_bad")
        back = flagged.withColumnsRenamed({c: f"ref_{c}" for c in ("log2", "spread", "depth")}).withColumnsRenamed({f"_own_{c}": c for c in ("log2", "spread", "depth")})
        back = back.drop(*[f"_own_{c}" for c in ("gc", "rmask")])
        return correct_bias(back, do_gc, do_edge and edge, do_mask)

    rows = one(target, True)
    if off_target is not None:
        rows = rows.unionByName(one(off_target, False), allowMissingColumns=True)
    rows = kept(rows.withColumn("log2", F.col("log2") - F.col("ref_log2")), "corrected")
    return center_all(kept(apply_weights(rows), "weighted"), "median", skip_low=True).drop("ref_log2", "ref_spread", "ref_depth", "gc", "rmask")


def flat_reference(regions: DataFrame, male_reference: bool = False) -> DataFrame:
    """REF-01: the reference of an even genome."""
    flat = g.expect_flat_log2(male_reference)
    return regions.withColumns({"log2": flat, "depth": F.pow(F.lit(2.0), flat), "spread": F.lit(0.0)})


def shift_sex_chroms(df: DataFrame, is_xx: str = "is_xx") -> DataFrame:
    """FUN-12/K-13: a female's Y is absent; others' X and Y are brought up to two copies."""
    xx = F.coalesce(F.col(is_xx), F.lit(False))
    shift = F.when(xx & g.is_y(), F.lit(None).cast("double")).when(~xx & (g.is_x() | g.is_y()), F.col("log2") + 1).otherwise(F.col("log2"))
    flat_y = F.when(xx & g.is_y(), F.lit(-1.0)).otherwise(shift)
    return df.withColumn("log2", flat_y)


def pooled_reference(samples: DataFrame, male_reference: bool = False, sexes: DataFrame | None = None, bias: bool = True) -> DataFrame:
    """REF-02/03: bins of many samples (sample_id) to one reference: robust centre and spread of each bin.

    Each bin must be in every sample, else the job fails. The even genome counts as a
    sample for the log-ratio, not for the depth.
    """
    at = ["chromosome", "start", "end", "gene"]
    total = samples.agg(F.count_distinct("sample_id").alias("_total"))
    rows = center_all(samples, "median", skip_low=True)
    known = sexes if sexes is not None else compare_sex_chromosomes(rows, male_reference).select("sample_id", "is_xx")
    rows = rows.join(F.broadcast(known), "sample_id", "left").withColumn("log2", F.col("log2") + g.expect_flat_log2(male_reference))
    rows = shift_sex_chroms(rows).drop("is_xx")
    if bias:
        rows = correct_bias(rows, order=("gc", "rmask", "edge"))
    flat = rows.groupBy(*at).agg(F.count("*").alias("_n")).join(F.broadcast(total), F.lit(True), "left")
    checked = flat.select(*at, F.when(F.col("_n") != F.col("_total"), F.raise_error(F.lit("samples do not have the same bins")).cast("double")).otherwise(g.expect_flat_log2(male_reference)).alias("log2"))
    stacked = rows.select(*at, "log2", "depth").unionByName(checked.withColumn("depth", F.lit(None).cast("double")))

    held = stacked.groupBy(*at).agg(F.collect_list("log2").alias("_log2"), F.collect_list("depth").alias("_depth"))  # a value for each sample
    sorted_ = held.withColumns({"_log2": F.array_sort("_log2"), "_depth": F.array_sort("_depth")})
    centred = sorted_.withColumns({"log2": stats.array_biweight_location(F.col("_log2")), "depth": stats.array_biweight_location(F.col("_depth"))})
    out = centred.select(*at, "log2", "depth", stats.array_biweight_midvariance(F.col("_log2"), F.col("log2")).alias("spread"))
    extras = [c for c in ("gc", "rmask") if c in samples.columns]
    if extras:
        out = out.join(samples.groupBy(*at).agg(*[F.first(c).alias(c) for c in extras]), at)
    return out


def bad_bin_report(reference: DataFrame) -> DataFrame:
    """REF-04: for targets and off-targets: bins, bad ones, and their share in percent."""
    rows = reference.select(F.col("gene").isin(*g.OFF_TARGET_ALIASES).alias("off_target"), g.bad_bin(reference).alias("_bad"))
    return rows.groupBy("off_target").agg(F.count("*").alias("bins"), F.count_if("_bad").alias("bad")).withColumn("percent", 100 * F.col("bad") / F.col("bins"))


def segment_mean(bins: DataFrame, segments: DataFrame) -> DataFrame:
    """STA-08: segments with the weighted mean of their bins."""
    seg = with_row_id(segments)
    w = "w" if "weight" in bins.columns else None
    pairs = range_join(seg, bins).select("q.row_id", F.col("s.log2").alias("x"), *([F.col("s.weight").alias("w")] if w else []))
    return seg.join(pairs.groupBy("row_id").agg(stats.weighted_mean("x", w).alias("mean")), "row_id", "left")


def segment_metrics(
    bins: DataFrame,
    segments: DataFrame,
    location: tuple[str, ...] = (),
    spread: tuple[str, ...] = (),
    interval: tuple[str, ...] = (),
    alpha: float = 0.05,
    bootstraps: int = 100,
    smoothed: bool = False,
) -> DataFrame:
    """STA-09: statistics of the bins in each segment; spreads are of deviations from the segment's log2."""
    seg = with_row_id(segments)
    source = bins if "weight" in bins.columns else bins.withColumn("weight", F.lit(1.0))
    pairs = range_join(seg, source).select(
        "q.row_id", F.col("s.log2").alias("x"), F.col("s.weight").alias("w"), (F.col("s.log2") - F.col("q.log2")).alias("d")
    )
    one = lambda c: F.when(F.count("d") == 1, 0.0).otherwise(c)  # noqa: E731  a single value has no spread, an infinite one neither
    native: dict[str, Column] = {
        "mean": stats.weighted_mean("x", "w"), "median": F.median("x"), "stdev": one(F.stddev_pop("d")), "mse": one(F.var_pop("d")), "iqr": stats.iqr("d"),
        "sem": F.stddev_samp("d") / F.sqrt(F.count("d")),
    }
    python = {"mode": (stats.modal_location, "x"), "p_ttest": (stats.t_test_p, "x"), "mad": (stats.median_absolute_deviation, "d"), "bivar": (stats.biweight_midvariance, "d")}
    asked = [*location, *spread]
    stats.bound_batches(bins.sparkSession)
    out = seg
    plain = [native[n].alias(n) for n in asked if n in native] + (stats.prediction_interval("x", alpha) if "pi" in interval else [])
    if plain:
        out = out.join(pairs.groupBy("row_id").agg(*plain), "row_id", "left")
    arrow = [stats.of_arrays(python[n][0])(F.col(f"_{python[n][1]}")).alias(n) for n in asked if n in python]
    if "ci" in interval:
        arrow.append(_bounds(alpha, bootstraps, smoothed)("_x", "_w").alias("_ci"))
    if arrow:
        used = {python[n][1] for n in asked if n in python} | ({"x", "w"} if "ci" in interval else set())
        lists = pairs.groupBy("row_id").agg(*[stats.held(c).alias(f"_{c}") for c in sorted(used)])
        found = lists.select("row_id", *arrow)
        # pandas gives NaN as missing: the spread of infinite values is not a number, as in SQL
        found = found.withColumns({n: F.coalesce(n, F.lit(math.nan)) for n in ("mad", "bivar") if n in asked})
        if "ci" in interval:
            found = found.select("*", F.col("_ci.ci_lo").alias("ci_lo"), F.col("_ci.ci_hi").alias("ci_hi")).drop("_ci")
        out = out.join(found, "row_id", "left")
    return out


def _bounds(alpha: float, bootstraps: int, smoothed: bool):
    def bounds(x: pd.Series, w: pd.Series) -> pd.DataFrame:
        ends = [stats.bootstrap_interval(a, b, alpha, bootstraps, smoothed) for a, b in zip(x, w)]
        return pd.DataFrame(ends, columns=["ci_lo", "ci_hi"], dtype=float)

    return F.pandas_udf(bounds, "ci_lo double, ci_hi double")


def sample_metrics(bins: DataFrame, segments: DataFrame | None = None, skip_low: bool = False) -> DataFrame:
    """STA-13: stdev, mad, iqr and bivar of residuals, one row for each sample."""
    rows = residuals(g.drop_low_coverage(bins) if skip_low else bins, segments)
    keys = g.sample_keys(rows)
    part = Window.partitionBy(*(keys or [F.lit(1)]))
    native = rows.withColumn("_g", F.abs(F.col("residual") - F.median("residual").over(part))).groupBy(*keys).agg(
        F.stddev_pop("residual").alias("stdev"), (F.median("_g") * stats.MAD_SCALE).alias("mad"), stats.iqr("residual").alias("iqr"), F.count("*").alias("bins")
    )
    bivar = rows.groupBy(*keys).agg(stats.udaf(stats.biweight_midvariance)("residual").alias("bivar"))
    return native.join(bivar, keys) if keys else native.join(bivar, F.lit(True))


def bin_test(bins: DataFrame, segments: DataFrame | None = None, alpha: float = 0.005, target_only: bool = False) -> DataFrame:
    """STA-14: bins that leave their segment: p_bintest (adjusted) below alpha, log2 the residual."""
    rows = residuals(bins, segments)
    if target_only:
        rows = rows.where(~F.col("gene").isin(*g.OFF_TARGET_ALIASES))
    w = Window.partitionBy(*g.sample_keys(rows), "chromosome", "start", "end").orderBy("residual")
    rows = rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    two_sided = F.pandas_udf(_two_sided, "double")
    z = F.try_divide(F.col("residual"), F.sqrt(F.greatest(1 - F.col("weight"), F.lit(0.0))))
    rows = rows.withColumn("_p", two_sided(F.abs(z))).where("_p IS NOT NULL")
    return adjust_bh(rows, "_p", "p_bintest").where(F.col("p_bintest") < alpha).withColumn("log2", F.col("residual")).drop("residual", "_p")


def _two_sided(z: pd.Series) -> pd.Series:
    return pd.Series([math.erfc(x / math.sqrt(2)) if x == x and x is not None else None for x in z], dtype=float)


def call(
    segments: DataFrame,
    variants: DataFrame | None = None,
    method: str = "threshold",
    ploidy: int = 2,
    purity: float | None = None,
    male_reference: bool = False,
    female_sample: bool = False,
    filters: tuple[str, ...] = (),
    thresholds: tuple[float, ...] = g.CALL_THRESHOLDS,
) -> DataFrame:
    """FUN-07: filters that need no copies, allele frequency, purity, copies, allele copies, other filters."""
    if method not in ("threshold", "clonal", "none"):
        raise ValueError("method must be threshold, clonal or none")
    out = segments
    for f in [f for f in filters if f in ("ci", "sem")]:
        out = SEGMENT_FILTERS[f](out)
    if variants is not None:
        out = baf_by_ranges(variants, out, tumor_boost="n_alt_freq" in variants.columns)
    if purity and purity < 1:
        out = out.withColumn("_abs", g.absolute_clonal(ploidy, purity, male_reference, female_sample))
        out = out.withColumn("log2", g.log2_ratios(F.col("_abs"), ploidy, male_reference))
        if "baf" in out.columns:
            out = out.withColumn("baf", g.rescale_baf(purity, F.col("baf")))
    elif method == "clonal":
        out = out.withColumn("_abs", g.absolute_pure(ploidy, male_reference))
    if method == "threshold":
        out = out.withColumn("_abs", g.absolute_threshold(ploidy, thresholds, male_reference).cast("double"))
    if method != "none":
        out = out.withColumn("cn", F.rint("_abs").cast("long"))
        if "baf" in out.columns:
            bright = F.rint(F.col("_abs") * (F.abs(F.coalesce("baf", F.lit(1.0)) - 0.5) + 0.5))
            one = F.least(F.greatest(bright, F.lit(0.0)), F.col("cn").cast("double")).cast("long")
            unknown = F.col("baf").isNull() & (F.col("cn") > 0)
            out = out.withColumn("cn1", F.when(unknown, F.lit(None).cast("long")).otherwise(one))
            out = out.withColumn("cn2", F.col("cn") - F.col("cn1"))
    out = out.drop("_abs")
    for f in [f for f in filters if f not in ("ci", "sem")]:
        out = SEGMENT_FILTERS[f](out)
    return out


# -- genes --------------------------------------------------------------------------------------


def gene_breaks(bins: DataFrame, segments: DataFrame, min_probes: int = 1) -> DataFrame:
    """GEN-01: genes that a segment boundary cuts: gene, place, change and probes on either side."""
    keys = [*g.sample_keys(bins, segments), "chromosome"]
    genes = (
        bins.withColumn("gene", F.explode(F.split("gene", ",")))
        .where(~F.col("gene").isin(*g.IGNORED_GENES, *g.OFF_TARGET_ALIASES))
        .groupBy(*keys, "gene")
        .agg(F.min("start").alias("gene_start"), F.max("end").alias("gene_end"), F.collect_list("start").alias("_starts"))
    )
    w = Window.partitionBy(*keys).orderBy("start", "end")
    edges = segments.select(*keys, F.lead("start").over(w).alias("location"), "start", "end", (F.lead("log2").over(w) - F.col("log2")).alias("change")).where("location IS NOT NULL")
    spans = genes.select(*keys, F.col("gene_start").alias("start"), F.col("gene_end").alias("end"), "gene", "_starts")
    points = edges.select(*keys, F.col("end").alias("start"), (F.col("end") + 1).alias("end"), F.col("end").alias("location"), "change")
    cut = range_join(spans, points).where((F.col("q.start") < F.col("s.location")) & (F.col("s.location") < F.col("q.end")))
    left = F.size(F.filter("q._starts", lambda x: x < F.col("s.location"))).cast("long")
    out = cut.select(*[F.col(f"q.{k}").alias(k) for k in keys], F.col("q.gene").alias("gene"), F.col("s.location").alias("location"), F.col("s.change").alias("change"), left.alias("probes_left"), (F.size("q._starts") - left).cast("long").alias("probes_right"))
    out = out.where((F.col("probes_left") >= min_probes) & (F.col("probes_right") >= min_probes))
    return out.orderBy(F.least("probes_left", "probes_right").desc(), F.abs("change").desc(), *keys, "gene", "location")


def gene_metrics(bins: DataFrame, segments: DataFrame | None = None, threshold: float = 0.2, min_probes: int = 3, skip_low: bool = False, ignore: tuple[str, ...] = g.IGNORED_GENES) -> DataFrame:
    """GEN-02/03: genes with a log-ratio beyond the threshold, over their bins or by segment."""
    rows = g.drop_low_coverage(bins) if skip_low else bins
    weight = "weight" if "weight" in rows.columns else None
    depth = stats.weighted_mean("depth", weight) if "depth" in rows.columns else F.lit(None).cast("double")
    total = F.sum("weight") if weight else F.lit(None).cast("double")
    keys = [*g.sample_keys(rows), "chromosome"]
    if segments is None:
        runs = by_gene(rows, ignore).where(F.col("gene_name") != g.OFF_TARGET)
        out = runs.groupBy(*keys, "gene_run", F.col("gene_name").alias("gene")).agg(
            F.min("start").alias("start"), F.max("end").alias("end"), stats.weighted_mean("log2", weight).alias("log2"), depth.alias("depth"), total.alias("weight"), F.count("*").alias("n_bins")
        ).drop("gene_run")
    else:
        seg = with_row_id(segments.where(F.abs("log2") >= threshold))
        pairs = range_join(seg, rows).select("s.*", F.col("q.row_id").alias("_seg"), F.col("q.log2").alias("_log2"), F.col("q.start").alias("segment_start"), F.col("q.end").alias("segment_end"))
        pairs = pairs.withColumn("gene", F.explode(F.split("gene", ","))).where(~F.col("gene").isin(*ignore, *g.OFF_TARGET_ALIASES))
        out = pairs.groupBy(*keys, "_seg", "gene").agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.first("_log2").alias("log2"), depth.alias("depth"), total.alias("weight"), F.count("*").alias("n_bins"),
            F.first("segment_start").alias("segment_start"), F.first("segment_end").alias("segment_end"),
        ).drop("_seg")
    return out.where((F.abs("log2") >= threshold) & (F.col("n_bins") >= min_probes))


# -- clusters -----------------------------------------------------------------------------------


def sample_components(samples: DataFrame, parts: int) -> tuple[list, np.ndarray]:
    """CLU-03: (sample ids, their places on the first principal components of the log-ratios).

    Bins are many and samples few, so the products of samples are summed over bins (the
    samples x samples matrix is all that reaches the driver) and its eigenvectors taken.
    """
    ids = sorted(r["sample_id"] for r in samples.select("sample_id").distinct().collect())  # as many as there are samples
    n = len(ids)
    by_bin = samples.groupBy("chromosome", "start", "end").agg(F.map_from_entries(F.collect_list(F.struct("sample_id", "log2"))).alias("m"))
    rows = by_bin.select(F.transform(F.array(*[F.lit(i) for i in ids]), lambda i: F.element_at("m", i)).alias("x"))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n))
        for batch in batches:
            x = np.array(batch["x"].tolist(), dtype=float).reshape(-1, n)
            x = x[np.isfinite(x).all(axis=1)]  # a bin tells nothing where a sample has no value
            x = x - x.mean(axis=1, keepdims=True)
            total += x.T @ x
        i, j = np.indices((n, n))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    gram = np.zeros((n, n))
    for r in rows.mapInPandas(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        gram[r["i"], r["j"]] = r["v"]
    value, vector = np.linalg.eigh(gram)
    first = np.argsort(-value, kind="stable")[:parts]
    real = value[first] > 1e-10 * value.max(initial=0)  # what is smaller is rounding
    places = vector[:, first] * np.sqrt(np.where(real, value[first], 0))
    lead = np.sign(places[np.abs(places).argmax(axis=0), np.arange(places.shape[1])]) if n else 1
    return ids, places * np.where(lead == 0, 1, lead)


def k_means(points: np.ndarray, k: int, seed: int = g.SEED, starts: int = 20, rounds: int = 100) -> np.ndarray:
    """Labels in order of first use: the best of several seeded starts by k-means++."""
    rng = np.random.default_rng(seed)
    best, labels = math.inf, np.zeros(len(points), dtype=int)
    for _ in range(starts):
        centers = points[rng.integers(len(points))][None]
        while len(centers) < k:
            gap = ((points[:, None] - centers[None]) ** 2).sum(axis=2).min(axis=1)
            share = gap / gap.sum() if gap.sum() > 0 else np.full(len(points), 1 / len(points))
            centers = np.vstack([centers, points[rng.choice(len(points), p=share)]])
        for _ in range(rounds):
            own = ((points[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
            moved = np.array([points[own == c].mean(axis=0) if (own == c).any() else centers[c] for c in range(k)])
            if np.allclose(moved, centers):
                break
            centers = moved
        cost = float(((points - centers[own]) ** 2).sum())
        if cost < best - 1e-12:
            best, labels = cost, own
    _, first, which = np.unique(labels, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[which]


def cluster_samples(samples: DataFrame, k: int | None = None, seed: int = g.SEED) -> DataFrame:
    """CLU-01: (sample_id, cluster): k-means on three principal components of the samples, each scaled to unit spread."""
    ids, places = sample_components(samples, 3)
    spread = places.std(axis=0)
    points = places / np.where(spread > 0, spread, 1)
    k = k or max(1, round(math.log(max(len(ids), 1), 3)))
    labels = k_means(points, k, seed) if len(ids) >= k > 1 else np.zeros(len(ids), dtype=int)
    schema = StructType([samples.schema["sample_id"]]).add("cluster", IntegerType())
    return samples.sparkSession.createDataFrame(list(zip(ids, labels.tolist())), schema)


def clustered_reference(samples: DataFrame, min_size: int = 4) -> DataFrame:
    """CLU-04: (chromosome, start, end, cluster, log2, spread) for each cluster of min_size samples or more."""
    labels = cluster_samples(samples)
    big = labels.groupBy("cluster").count().where(F.col("count") >= min_size).select("cluster")
    rows = samples.join(labels.join(F.broadcast(big), "cluster"), "sample_id")
    center, wide = stats.udaf(stats.biweight_location), stats.udaf(stats.biweight_midvariance)
    return rows.groupBy("chromosome", "start", "end", "cluster").agg(center("log2").alias("log2"), wide("log2").alias("spread"))


def markov_clusters(matrix: np.ndarray, inflation: float = 5.0, rounds: int = 100, least: float = 1e-3) -> list[tuple[int, ...]]:
    """CLU-02: Markov clustering of a similarity matrix of samples, on the driver."""
    if inflation <= 1:
        raise ValueError("inflation must be above 1")
    flow = np.asarray(matrix, dtype=float)
    flow = flow / flow.sum(axis=0)
    for _ in range(rounds):
        grown = (flow @ flow) ** inflation
        grown /= grown.sum(axis=0)
        if np.allclose(grown, flow):
            flow = grown
            break
        flow = np.where(grown < least, 0, grown)
    return [tuple(np.flatnonzero(flow[i]).tolist()) for i in np.flatnonzero(flow.diagonal())]


def markov_samples(samples: DataFrame, inflation: float = 5.0, by_components: bool = True) -> list[list]:
    """CLU-02: groups of samples: by nearness on two principal components, or by correlation."""
    ids, places = sample_components(samples, 2 if by_components else len(samples.select("sample_id").distinct().collect()))
    if by_components:
        gap = np.sqrt(((places[:, None] - places[None]) ** 2).sum(axis=2))
        near = 1 - gap / gap.max() if gap.max() > 0 else np.ones_like(gap)
    else:
        near = np.corrcoef(places)
    return [[ids[i] for i in group] for group in markov_clusters(near, inflation)]
