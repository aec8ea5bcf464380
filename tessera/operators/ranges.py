"""Range joins on half-open intervals, and what is built on them.

Both sides are dealt to fixed-width tiles of their chromosome, so a join is an equi-join on
(sample, chromosome, tile) with the range predicate as a residue; a pair is taken in the
tile where the later of the two starts lies, hence once. No side is collected; Spark may
broadcast a side by its own size check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.genome import sample_keys

TILE = 1 << 14


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A row id where there is none; readers and views give their own, which is the same in each run."""
    return df if name in df.columns else df.withColumn(name, F.monotonically_increasing_id())


def _tiled(df: DataFrame, side: str, keys: list[str], tile: int) -> DataFrame:
    last = F.greatest(F.col("end") - 1, F.col("start"))
    first_tile = F.call_function("div", F.col("start"), F.lit(tile).cast("long"))
    last_tile = F.call_function("div", last, F.lit(tile).cast("long"))
    return df.select(*keys, "chromosome", F.struct(*df.columns).alias(side), F.explode(F.sequence(first_tile, last_tile)).alias("_tile"))


def range_join(queries: DataFrame, sources: DataFrame, mode: str = "outer", tile: int = TILE) -> DataFrame:
    """RNG-01/03/04: struct columns q and s, one row for each pair in the mode outer, inner or trim.

    outer: they overlap; inner: s lies inside q; trim: outer, with s cut to q.
    """
    keys = sample_keys(queries, sources)
    q, s = _tiled(queries, "q", keys, tile), _tiled(sources, "s", keys, tile)
    once = F.col("_tile") == F.call_function("div", F.greatest("q.start", "s.start"), F.lit(tile).cast("long"))
    overlap = (F.col("s.end") > F.col("q.start")) & (F.col("s.start") < F.col("q.end"))
    within = (F.col("s.start") >= F.col("q.start")) & (F.col("s.end") <= F.col("q.end"))
    pairs = q.join(s, [*keys, "chromosome", "_tile"]).where(once & (within if mode == "inner" else overlap)).select("q", "s")
    if mode == "trim":
        pairs = pairs.withColumn(
            "s", F.col("s").withField("start", F.greatest("s.start", "q.start")).withField("end", F.least("s.end", "q.end"))
        )
    return pairs


def by_ranges(queries: DataFrame, sources: DataFrame, mode: str = "outer", keep_empty: bool = True) -> DataFrame:
    """RNG-01: each query row with rows, the array of sources in it, in order."""
    queries = with_row_id(queries)
    found = (
        range_join(queries, sources, mode)
        .groupBy("q.row_id")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("s.start").alias("_a"), F.col("s.end").alias("_b"), F.col("s").alias("s")))).alias("x"))
        .select("row_id", F.transform("x", lambda r: r["s"]).alias("rows"))
    )
    return queries.join(found, "row_id", "left" if keep_empty else "inner")


def in_range(df: DataFrame, chromosome: str | None = None, start: int | None = None, end: int | None = None, mode: str = "outer") -> DataFrame:
    """RNG-03: rows in one window; a bound left out is open."""
    out = df if chromosome is None else df.where(F.col("chromosome") == chromosome)
    if mode == "inner":
        out = out.where((F.col("start") >= start) if start is not None else F.lit(True)).where((F.col("end") <= end) if end is not None else F.lit(True))
    else:
        out = out.where((F.col("end") > start) if start is not None else F.lit(True)).where((F.col("start") < end) if end is not None else F.lit(True))
    if mode == "trim":
        if start is not None:
            out = out.withColumn("start", F.greatest("start", F.lit(start).cast("long")))
        if end is not None:
            out = out.withColumn("end", F.least("end", F.lit(end).cast("long")))
    return out


def intersection(df: DataFrame, other: DataFrame, mode: str = "outer") -> DataFrame:
    """RNG-05: rows of df in ranges of other; a row that meets several comes several times."""
    return range_join(other, df, mode).select("s.*")


def into_ranges(source: DataFrame, dest: DataFrame, column: str, default=None, summary: Callable[[Column], Column] | None = None, name: str | None = None) -> DataFrame:
    """RNG-06: dest with a summary of the source column in each range.

    No row: default; one row: its value as it is; more: summary, by default unique strings
    joined in order, the median of floats, else the first.
    """
    kind = dict(source.dtypes)[column]
    dest = with_row_id(dest)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("s.start", "s.end", F.col(f"s.{column}").alias("v")))), lambda x: x["v"])
    if summary is not None:
        many = summary(F.col(f"s.{column}"))
    elif kind == "string":
        many = F.array_join(F.array_distinct(ordered), ",")
    elif kind in ("double", "float"):
        many = F.median(f"s.{column}")
    else:
        many = F.get(ordered, 0)
    found = (
        range_join(dest, source)
        .groupBy("q.row_id")
        .agg(F.count("*").alias("_n"), F.min(f"s.{column}").alias("_one"), many.alias("_many"))
        .select("row_id", F.when(F.col("_n") == 1, F.col("_one")).otherwise(F.col("_many")).alias("_v"), "_n")
    )
    out = dest.join(found, "row_id", "left")
    return out.withColumn(name or column, F.when(F.col("_n").isNull(), F.lit(default)).otherwise(F.col("_v"))).drop("_v", "_n")


def values_in_ranges(source: DataFrame, dest: DataFrame, column: str, mode: str = "outer", keep_empty: bool = True) -> DataFrame:
    """RNG-07: dest with values, the column's values in each range, in order."""
    out = by_ranges(dest, source, mode, keep_empty)
    return out.withColumn("values", F.coalesce(F.transform("rows", lambda r: r[column]), F.array().cast(f"array<{dict(source.dtypes)[column]}>"))).drop("rows")


def subtract(df: DataFrame, other: DataFrame) -> DataFrame:
    """RNG-08: what of each row of df no row of other covers.

    Each cut gives the piece before it, and the last one also the piece after it; the cuts of
    a row are put in order by a window, which spills, so a row may hold any number of them.
    """
    from .intervals import merge

    keepers = with_row_id(df)
    cuts = range_join(keepers.select(*sample_keys(df, other), "chromosome", "start", "end", "row_id"), merge(other.select(*sample_keys(df, other), "chromosome", "start", "end")))
    cuts = cuts.select(F.col("q.row_id").alias("row_id"), F.col("s.start").alias("_a"), F.col("s.end").alias("_b"))
    w = Window.partitionBy("row_id").orderBy("_a")
    held = keepers.join(cuts.withColumns({"_before": F.lag("_b").over(w), "_last": F.lead("_a").over(w).isNull()}), "row_id", "left")
    piece = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    before = piece(F.coalesce("_before", "start"), F.coalesce("_a", "end"))
    after = piece(F.when(F.col("_last"), F.col("_b")), F.col("end"))
    names = [c for c in df.columns if c not in ("start", "end")]
    out = held.select(*names, F.explode(F.array(before, after)).alias("_p")).where("_p.b > _p.a")
    return out.select(*[F.col("_p.a").alias("start") if c == "start" else F.col("_p.b").alias("end") if c == "end" else F.col(c) for c in df.columns])


def match_reference(sample: DataFrame, reference: DataFrame, columns: list[str]) -> DataFrame:
    """RNG-09: reference columns (prefixed ref_) by exact coordinates; raises at run time on doubled or missing bins."""
    at = ["chromosome", "start", "end"]
    one = reference.groupBy(*at).agg(F.count("*").alias("_times"), *[F.first(c).alias(f"ref_{c}") for c in columns])
    out = sample.join(one, at, "left")
    wrong = F.when(F.col("_times").isNull(), F.lit("a bin is not in the reference")).when(F.col("_times") > 1, F.lit("the reference has a bin twice"))
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("long")).otherwise(F.col("start"))
    return out.withColumn("start", checked).drop("_times")


def update_chrom_length(counts: DataFrame, regions: DataFrame) -> DataFrame:
    """RNG-10: read counts with the lengths of the regions of their chromosomes."""
    size = regions.groupBy("chromosome").agg(F.sum(F.col("end") - F.col("start")).alias("length"))
    return counts.drop("length").join(size, "chromosome")


def shared_chroms(*frames: DataFrame) -> list[DataFrame]:
    """RNG-11: tables held to the chromosomes they have in common."""
    out = list(frames)
    for i in range(len(out)):
        for other in frames:
            if other is not frames[i]:
                out[i] = out[i].join(other.select("chromosome").distinct(), "chromosome", "left_semi")
    return out


def pair_samples(samples: DataFrame, segments: DataFrame) -> DataFrame:
    """RNG-12: segments for each sample: their own, or one set for all."""
    if "sample_id" in segments.columns:
        return segments
    return samples.select("sample_id").distinct().join(segments, F.lit(True))


def baf_by_ranges(variants: DataFrame, ranges: DataFrame, above_half: bool | None = None, tumor_boost: bool = False) -> DataFrame:
    """RNG-13: ranges with baf, the median mirrored frequency of the sites in each; one site alone as it is."""
    from ..functions.genome import heterozygous, mirrored_baf
    from ..functions.genome import tumor_boost as boost

    v = heterozygous(variants)
    if tumor_boost and "n_alt_freq" in v.columns:
        v = v.withColumn("alt_freq", boost(F.col("alt_freq"), F.col("n_alt_freq")))
    ranges = with_row_id(ranges)
    pairs = range_join(ranges, v).select(F.col("q.row_id").alias("row_id"), F.col("s.alt_freq").alias("f")).where("f IS NOT NULL")
    # frequencies are few, so they are counted first: a range of very many sites is no large group then
    counted = pairs.groupBy("row_id", "f").agg(F.count("*").alias("n"))
    median = lambda x: F.percentile(x, F.lit(0.5), F.col("n"))
    side = median(F.col("f")) > 0.5 if above_half is None else F.lit(above_half)
    mirrored = F.when(side, median(mirrored_baf(F.col("f"), F.lit(True)))).otherwise(median(mirrored_baf(F.col("f"), F.lit(False))))
    found = counted.groupBy("row_id").agg(F.when(F.sum("n") == 1, F.first("f")).otherwise(mirrored).alias("baf"))
    return ranges.drop("baf").join(found, "row_id", "left")


def het_fraction_by_ranges(variants: DataFrame, ranges: DataFrame) -> DataFrame:
    """RNG-13: ranges with the share of sites that are heterozygous."""
    return into_ranges(variants.withColumn("_het", (~F.col("zygosity").isin(0.0, 1.0)).cast("double")), ranges, "_het", None, F.avg, "het_fraction")


def gene_coords(df: DataFrame, genes: list[str] | None = None) -> DataFrame:
    """RNG-14: span of each gene on its chromosome."""
    out = df.withColumn("gene", F.explode(F.split("gene", ",")))
    out = out.where(F.col("gene").isin(*genes)) if genes else out
    return out.groupBy(*sample_keys(df), "chromosome", "gene").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def bin_positions(df: DataFrame) -> DataFrame:
    """RNG-15: each bin with its ordinal in its chromosome, from 0."""
    w = Window.partitionBy(*sample_keys(df), "chromosome").orderBy("start", "end")
    return df.withColumn("position", F.row_number().over(w) - 1)


def ranges_to_bins(ranges: DataFrame, bins: DataFrame) -> DataFrame:
    """RNG-15: ranges with the first and one past the last ordinal of the bins they hold."""
    ranges = with_row_id(ranges)
    found = range_join(ranges, bin_positions(bins)).groupBy("q.row_id").agg(F.min("s.position").alias("first_bin"), (F.max("s.position") + 1).alias("last_bin"))
    return ranges.join(found, "row_id", "left")
