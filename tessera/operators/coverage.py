"""Coverage of regions from a table of aligned reads, and bin sizes from depth.

reads: chromosome, pos (0-based), aligned_len, query_len, mapq and the flags is_duplicate,
is_secondary, is_unmapped, is_qcfail; any store that Spark reads may hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.genome import NULL_LOG2, depth_to_bin, sample_keys
from .copynum import average_depth
from .intervals import region_size_by_chrom
from .ranges import range_join, subtract, update_chrom_length, with_row_id

FLAGS = ("is_duplicate", "is_secondary", "is_unmapped", "is_qcfail")


def good_reads(reads: DataFrame, min_mapq: int = 0) -> DataFrame:
    """COV-02: reads that count, as intervals."""
    out = reads
    for flag in FLAGS:
        if flag in reads.columns:
            out = out.where(~F.coalesce(F.col(flag), F.lit(False)))
    if min_mapq:
        out = out.where(F.col("mapq") >= min_mapq)
    return out.select(*sample_keys(reads), "chromosome", F.col("pos").alias("start"), (F.col("pos") + F.col("aligned_len")).alias("end"))


def region_bases(reads: DataFrame, regions: DataFrame, min_mapq: int = 0) -> DataFrame:
    """SRC-26: regions with basecount, the aligned bases of good reads inside each."""
    regions = with_row_id(regions)
    # bases are summed per region in the map side; the read side is never grouped whole
    pairs = range_join(regions, good_reads(reads, min_mapq).select("chromosome", "start", "end"), "trim")
    sums = pairs.groupBy("q.row_id").agg(F.sum(F.col("s.end") - F.col("s.start")).alias("basecount"), F.count("*").alias("readcount"))
    return regions.join(sums, "row_id", "left").withColumns({"basecount": F.coalesce("basecount", F.lit(0).cast("long")), "readcount": F.coalesce("readcount", F.lit(0).cast("long"))})


def coverage(reads: DataFrame, regions: DataFrame, min_mapq: int = 0) -> DataFrame:
    """COV-01/02/03: bins with depth and log2."""
    rows = region_bases(reads, regions, min_mapq)
    if "gene" not in rows.columns:
        rows = rows.withColumn("gene", F.lit("-"))
    depth = F.coalesce(F.try_divide(F.col("basecount").cast("double"), (F.col("end") - F.col("start"))), F.lit(0.0))
    out = rows.withColumn("depth", depth).withColumn("log2", F.when(F.col("depth") > 0, F.log2("depth")).otherwise(F.lit(NULL_LOG2)))
    return out.select(*sample_keys(out), "chromosome", "start", "end", F.coalesce("gene", F.lit("-")).alias("gene"), "depth", "log2")


def idxstats(reads: DataFrame, lengths: DataFrame, drop_unmapped: bool = True) -> DataFrame:
    """SRC-27: mapped and unmapped reads by chromosome."""
    unmapped = F.coalesce(F.col("is_unmapped"), F.lit(False)) if "is_unmapped" in reads.columns else F.lit(False)
    counts = reads.groupBy("chromosome").agg(F.count_if(~unmapped).alias("mapped"), F.count_if(unmapped).alias("unmapped"))
    out = lengths.join(counts, "chromosome", "left").fillna(0, ["mapped", "unmapped"])
    return out.where("mapped > 0") if drop_unmapped else out


def is_sorted(reads: DataFrame, span: int = 50) -> DataFrame:
    """SRC-28: one row: are the first span reads in order of place?"""
    from pyspark.sql.window import Window

    first = reads.limit(span).withColumn("_i", F.monotonically_increasing_id())
    w = Window.orderBy("_i")  # span rows
    return first.withColumn("_ok", F.coalesce((F.col("chromosome") != F.lag("chromosome").over(w)) | (F.col("pos") >= F.lag("pos").over(w)), F.lit(True))).agg(F.min("_ok").alias("is_sorted"))


def read_length(reads: DataFrame, span: int = 1000) -> DataFrame:
    """SRC-29/SRT-06: the median query length of the first span reads (one row)."""
    return reads.where("query_len > 0").orderBy("chromosome", "pos").limit(span).agg(F.median("query_len").alias("read_length"))


def midsize_regions(regions: DataFrame, most: int = 100, seed: int = 0xA5EED) -> DataFrame:
    """SRT-05: at most so many regions of middling size."""
    size = F.col("end") - F.col("start")
    bounds = regions.agg(F.percentile(size, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    mid = regions.join(F.broadcast(bounds), F.lit(True)).where((size >= F.get("_q", F.lit(0))) & (size <= F.get("_q", F.lit(1)))).drop("_q")
    return mid.orderBy(F.xxhash64("chromosome", "start", "end", F.lit(seed)), "chromosome", "start", "end").limit(most)


def sampled_depth(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """COV-04: depth over a sample of middling regions (one row)."""
    rows = coverage(reads, midsize_regions(regions))
    return rows.agg((F.sum(F.col("depth") * (F.col("end") - F.col("start"))) / F.sum(F.col("end") - F.col("start"))).alias("depth"))


def autobin(
    reads: DataFrame,
    lengths: DataFrame,
    method: str,
    targets: DataFrame | None = None,
    access: DataFrame | None = None,
    bases: float = 100000.0,
    target_sizes: tuple[int, int] = (20, 50000),
    off_target_sizes: tuple[int, int] = (500, 1000000),
) -> DataFrame:
    """COV-04: (kind, depth, bin_size) for targets and, in hybrid protocols, off-targets."""
    if method not in ("amplicon", "hybrid", "wgs"):
        raise ValueError("method must be amplicon, hybrid or wgs")
    if method != "wgs" and targets is None:
        raise ValueError(f"target regions are required for {method}")
    counts = idxstats(reads, lengths)
    length = read_length(reads)
    rows = []
    if method == "wgs":
        counts = update_chrom_length(counts, access) if access is not None else counts
        weighted = counts.join(F.broadcast(length), F.lit(True)).select((F.col("read_length") * F.col("mapped") / F.col("length")).alias("d"), F.col("length").cast("double").alias("w"))
        rows.append(("target", weighted.groupBy().agg(stats.udaf(stats.weighted_median, weighted=True)("d", "w").alias("depth")), target_sizes))
    else:
        rows.append(("target", sampled_depth(reads, targets), target_sizes))
    if method == "hybrid":
        space = access if access is not None else lengths.select("chromosome", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"))
        away = subtract(space.select("chromosome", "start", "end"), targets.select("chromosome", "start", "end"))
        size = region_size_by_chrom(away)
        on = coverage(reads, targets).groupBy("chromosome").agg(F.sum(F.col("depth") * (F.col("end") - F.col("start"))).alias("on_bases"))
        rest = counts.drop("length").join(size, "chromosome").join(on, "chromosome", "left").join(F.broadcast(length), F.lit(True))
        d = F.greatest(F.col("read_length") * F.col("mapped") - F.coalesce("on_bases", F.lit(0.0)), F.lit(0.0)) / F.col("length")
        away_depth = rest.select(d.alias("d"), F.col("length").cast("double").alias("w")).groupBy().agg(stats.udaf(stats.weighted_median, weighted=True)("d", "w").alias("depth"))
        rows.append(("off-target", away_depth, off_target_sizes))
    out = None
    for kind, depth, (least, most) in rows:
        one = depth.select(F.lit(kind).alias("kind"), "depth", depth_to_bin(F.col("depth"), bases, least, most).alias("bin_size"))
        out = one if out is None else out.unionByName(one)
    return out


__all__ = ["autobin", "average_depth", "coverage", "good_reads", "idxstats", "is_sorted", "midsize_regions", "read_length", "region_bases", "sampled_depth"]
