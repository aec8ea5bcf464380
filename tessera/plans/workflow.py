"""Whole analyses over all samples, keyed by sample_id; each step's table is kept, as later steps read it more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.genome import split_reference
from ..operators.copynum import bin_test, call, center_all, correct, flat_reference, pooled_reference, segment_metrics
from ..operators.coverage import coverage
from ..operators.intervals import off_targets, targets
from ..operators.segment import segment
from ..sources.scratch import kept


def make_reference(
    baits: DataFrame,
    normals: dict[str, DataFrame],
    annotate: DataFrame | None = None,
    access: DataFrame | None = None,
    method: str = "hybrid",
    target_size: float = 200 / 0.75,
    off_target_size: int = 150000,
    male_reference: bool = False,
) -> DataFrame:
    """PIP-01: targets, off-targets, coverage of each normal sample, pooled reference (flat without normals)."""
    from pyspark.sql import functions as F

    regions = targets(baits, annotate, split=True, average=target_size)
    if "gene" not in regions.columns:
        regions = regions.withColumn("gene", F.lit("-"))
    at = ["chromosome", "start", "end", "gene"]
    regions = regions.select(*at)
    if method == "hybrid":
        regions = regions.unionByName(off_targets(regions, access, off_target_size).select(*at))
    regions = kept(regions, "regions")
    if not normals:
        return flat_reference(regions, male_reference)
    pool = None
    for name, reads in normals.items():
        one = coverage(reads, regions).withColumn("sample_id", F.lit(name))
        pool = one if pool is None else pool.unionByName(one)
    return kept(pooled_reference(kept(pool, "coverage"), male_reference), "reference")


def run_sample(reads: DataFrame, reference: DataFrame, sample_id: str, method: str = "cbs", wgs: bool = False, male_reference: bool = False) -> dict[str, DataFrame]:
    """PIP-02: coverage to calls of one sample."""
    from pyspark.sql import functions as F

    on, off = split_reference(reference)
    cover = lambda regions: kept(coverage(reads, regions.select("chromosome", "start", "end", "gene")).withColumn("sample_id", F.lit(sample_id)), "coverage")
    bins = kept(correct(cover(on), reference, None if wgs else cover(off)), "bins")
    segments = kept(segment(bins, method, threshold=1e-6 if wgs else None), "segments")
    rated = segment_metrics(bins, segments, interval=("ci",), alpha=0.5, smoothed=True)
    squashed = kept(call(rated, method="none", filters=("ci",)), "squashed")
    tested = segment_metrics(bins, squashed, location=("p_ttest",))
    calls = call(center_all(tested.drop("row_id"), "median"), method="threshold", male_reference=male_reference)
    return {"bins": bins, "segments": segments, "calls": calls, "bintest": bin_test(bins, squashed)}
