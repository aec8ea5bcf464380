"""Segmentation of log-ratios; every method works arm by arm (or sample by sample), in parallel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import kernels, stats
from ..functions.genome import drop_low_coverage, sample_keys
from ..sources.scratch import kept
from . import markov
from .ranges import range_join, with_row_id
from .runs import by_arm, run_ids, transfer_fields
from .signal import drop_outliers, smooth_log2

METHODS = ("cbs", "flasso", "haar", "none", "hmm", "hmm-tumor", "hmm-germline", "ewma_haar")
#: How far the two states' allele frequencies are from a half, their spread, and how likely each comes first.
ALLELE_SHIFTS, ALLELE_SD, ALLELE_START = (0.0, 0.17), 0.1, (0.95, 0.05)
DEFAULT_THRESHOLD = {"haar": 1e-4, "ewma_haar": 1e-4, "cbs": 1e-4, "flasso": 1e-4}


def _segments(rows: pd.DataFrame, breaks: np.ndarray) -> pd.DataFrame:
    x = rows["log2"].to_numpy(dtype=float)
    w = rows["weight"].to_numpy(dtype=float) if "weight" in rows else np.ones(len(x))
    cuts = [0, *[int(b) for b in breaks if 0 < b < len(x)], len(x)]
    spans = [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
    mean = [float(np.average(x[a:b], weights=w[a:b])) if w[a:b].sum() > 0 else float(x[a:b].mean()) for a, b in spans]
    return pd.DataFrame(
        {
            "start": [int(rows["start"].iloc[a]) for a, _ in spans],
            "end": [int(rows["end"].iloc[b - 1]) for _, b in spans],
            "log2": mean,
            "probes": [b - a for a, b in spans],
        }
    )


def _by_arm(bins: DataFrame, breaks) -> DataFrame:
    keys = [*sample_keys(bins), "chromosome", "arm"]
    schema = StructType([bins.schema[k] for k in keys[:-1]]).add("start", "long").add("end", "long").add("log2", "double").add("probes", "long")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start", "end"], kind="stable").reset_index(drop=True)
        out = _segments(rows, breaks(rows))
        for k, v in zip(keys[:-1], key):
            out[k] = v
        return out[[f.name for f in schema.fields]]

    return by_arm(bins).groupBy(*keys).applyInPandas(run, schema)


def _hmm(bins: DataFrame, method: str) -> DataFrame:
    """SEG-05: a model for each sample, fitted to the smoothed signal of its numbered chromosomes; runs of one state are segments."""
    keys = sample_keys(bins)
    weight = F.col("weight").cast("double") if "weight" in bins.columns else F.lit(1.0)
    rows = kept(by_arm(smooth_log2(bins)).select(*keys, "chromosome", "arm", "start", "end", F.col("log2").cast("double").alias("log2"), "smoothed", weight.alias("weight")), "smoothed")
    arms = markov.arms_of(rows, keys, "smoothed", ("log2", "weight"))
    sds = markov.spreads(rows, keys, "smoothed")
    models = markov.fit(markov.numbered_chromosomes(arms, keys), keys, markov.MEANS[method], markov.FROZEN[method], sds)
    runs = run_ids(markov.decode(arms.where(F.size("rows") > 0), keys, models), ["state"], by_arm_too=True)
    return runs.groupBy(*keys, "chromosome", "arm", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), stats.weighted_mean("log2", "weight").alias("log2"), F.count("*").alias("probes")
    ).drop("arm", "run")


def segment_none(bins: DataFrame) -> DataFrame:
    """SEG-09: one segment for each arm; built-in."""
    keys = [*sample_keys(bins), "chromosome", "arm"]
    weight = "weight" if "weight" in bins.columns else None
    return by_arm(bins).groupBy(*keys).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), stats.weighted_mean("log2", weight).alias("log2"), F.count("*").alias("probes")
    ).drop("arm")


def segment(
    bins: DataFrame,
    method: str = "cbs",
    threshold: float | None = None,
    variants: DataFrame | None = None,
    skip_low: bool = False,
    skip_outliers: float = 10,
    min_weight: float = 0,
) -> DataFrame:
    """SEG-01/02: segments with weight, depth, genes and probes of the bins in them."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    rows = drop_low_coverage(bins) if skip_low else bins
    rows = drop_outliers(rows, 50, skip_outliers) if skip_outliers else rows
    if "weight" in rows.columns:
        rows = rows.where((F.col("weight") > 0) & (F.col("weight") >= min_weight))
    q = DEFAULT_THRESHOLD.get(method, 1e-4) if threshold is None else threshold
    weights = lambda r: r["weight"].to_numpy(dtype=float) if "weight" in r else None
    signal = lambda r: r["log2"].to_numpy(dtype=float)

    def runs_of(level):
        return np.flatnonzero(np.abs(np.diff(level)) > 1e-9) + 1

    if method == "none":
        out = segment_none(rows)
    elif method.startswith("hmm"):
        out = _hmm(rows, method)
    elif method == "haar":
        out = _by_arm(rows, lambda r: kernels.haar_breaks(signal(r), q, weights(r)))
    elif method == "ewma_haar":
        out = _by_arm(rows, lambda r: kernels.ewma_haar_breaks(signal(r), q, weights(r)))
    elif method == "cbs":
        out = _by_arm(rows, lambda r: kernels.cbs_breaks(kernels.ewm(signal(r), 3), q, weights(r)))
    else:
        out = _by_arm(rows, lambda r: runs_of(kernels.fused_lasso(kernels.ewm(signal(r), 3))))
    if variants is not None:
        out = split_by_variants(out, variants)
    return transfer_fields(out, rows)


def split_by_variants(segments: DataFrame, variants: DataFrame, min_variants: int = 50) -> DataFrame:
    """SEG-06: segments parted where the allele frequency of their sites changes state."""
    seg = with_row_id(segments)
    columns = [c for c in segments.columns if c != "row_id"]
    pairs = range_join(seg, variants).select("q.row_id", F.col("s.start").alias("_p"), F.col("s.end").alias("_q"), F.abs(F.col("s.alt_freq") - 0.5).alias("_f")).where("_f IS NOT NULL")
    sites = pairs.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("_p", "_q", "_f"))).alias("_sites"))
    joined = seg.join(sites, "row_id", "left")

    def find(rows: pd.Series) -> pd.Series:
        out = []
        for site in rows:
            if site is None or len(site) <= min_variants:
                out.append([])
                continue
            start, end = (np.array([x[c] for x in site]) for c in ("_p", "_q"))
            f = np.array([x["_f"] for x in site], dtype=float)
            model = markov.fit_one(f, markov.initial(ALLELE_SHIFTS, ALLELE_SD, ALLELE_START), (0, 1))
            at = np.flatnonzero(np.diff(markov.posterior(f, model)[0].argmax(axis=1)))
            out.append(((end[at] + start[at + 1]) // 2).tolist())
        return pd.Series(out)

    found = joined.withColumn("_cuts", F.pandas_udf(find, "array<long>")(F.col("_sites").cast("array<struct<_p:bigint,_q:bigint,_f:double>>")))
    points = F.concat(F.array("start"), F.filter("_cuts", lambda c: (c > F.col("start")) & (c < F.col("end"))), F.array("end"))
    parts = found.withColumn("_pts", points).withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_pts") - 2)))
    return parts.withColumns({"start": F.get("_pts", F.col("_i")), "end": F.get("_pts", F.col("_i") + 1)}).select(*columns)
