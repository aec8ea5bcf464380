"""Interval algebra: merge, flatten, subdivide, resize, and region sets built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.genome import INSERT_SIZE, OFF_TARGET, drop_noncanonical, sample_keys
from .ranges import into_ranges, range_join, subtract, with_row_id


def join_strings(column: str, order: list[str]) -> Column:
    """Unique values in order, comma-joined."""
    values = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(column).alias("_v")))), lambda x: x["_v"])
    return F.array_join(F.array_distinct(values), ",")


def merge_strands(column: str) -> Column:
    return F.when(F.count_distinct(column) > 1, F.lit(".")).otherwise(F.first(column))


def combiners(df: DataFrame, custom: dict[str, Column] | None = None) -> dict[str, Column]:
    """AGG-03: how each column of grouped rows becomes one value; other columns keep the first row's."""
    order = ["start", "end"] + [c for c in ("row_id",) if c in df.columns]
    first = F.struct(*order)
    out: dict[str, Column] = {}
    for c in df.columns:
        if c == "start":
            out[c] = F.min("start")
        elif c == "end":
            out[c] = F.max("end")
        elif c in ("gene", "accession"):
            out[c] = join_strings(c, order)
        elif c in ("weight", "probes"):
            out[c] = F.sum(c)
        elif c == "strand":
            out[c] = merge_strands(c)
        else:
            out[c] = F.min_by(c, first)
    return out | (custom or {})


def islands(df: DataFrame, bp: int = 0, stranded: bool = False) -> DataFrame:
    """df with _island: rows joined as long as the next starts at or before the furthest end, less bp."""
    keys = [*sample_keys(df), "chromosome", *(["strand"] if stranded else [])]
    order = ["start", "end", *([c for c in ("row_id",) if c in df.columns])]
    w = Window.partitionBy(*keys).orderBy(*order)
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(reach.isNull() | (F.col("start") - reach > -bp), 1).otherwise(0)
    return df.withColumn("_open", opened).withColumn("_island", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_open")


def merge(df: DataFrame, bp: int = 0, stranded: bool = False, combine: dict[str, Column] | None = None) -> DataFrame:
    """AGG-01: one row for each run of rows that overlap by bp bases or more (0: or touch)."""
    keys = [*sample_keys(df), "chromosome", *(["strand"] if stranded else [])]
    rules = {c: e for c, e in combiners(df, combine).items() if c not in keys}
    return islands(df, bp, stranded).groupBy(*keys, "_island").agg(*[e.alias(c) for c, e in rules.items()]).select(*df.columns)


def flatten(df: DataFrame, combine: dict[str, Column] | None = None) -> DataFrame:
    """AGG-02: cut overlapping rows at each other's bounds; each piece combines the rows over it.

    Pieces meet the rows over them in tiles, so an island of many rows costs the pairs that
    it really has.
    """
    keys = [*sample_keys(df), "chromosome"]
    rows = islands(df)
    points = rows.select(*keys, "_island", F.explode(F.array("start", "end")).alias("start")).distinct()
    w = Window.partitionBy(*keys, "_island").orderBy("start")
    pieces = points.withColumn("end", F.lead("start").over(w)).where("end IS NOT NULL").drop("_island")
    over = range_join(pieces, df).select(F.col("q.start").alias("_a"), F.col("q.end").alias("_b"), "s.*")
    rules = {c: e for c, e in combiners(df, combine).items() if c not in (*keys, "start", "end")}
    out = over.groupBy(*keys, "_a", "_b").agg(F.count("*").alias("_n"), *[e.alias(c) for c, e in rules.items()])
    return out.withColumnsRenamed({"_a": "start", "_b": "end"}).select(*df.columns)


def subdivide(df: DataFrame, average: float, least: float = 0) -> DataFrame:
    """AGG-04: merged rows cut into equal parts of about the average size; shorter than least go."""
    size = F.col("end") - F.col("start")
    merged = merge(df).where(size >= least)
    parts = merged.withColumn("_n", F.greatest(F.bround(size / F.lit(float(average)), 0).cast("long"), F.lit(1).cast("long")))
    each = parts.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    edge = lambda i: F.col("start") + F.floor(i * (size.cast("double") / F.col("_n"))).cast("long")
    cut = each.withColumn("_e", F.when(F.col("_i") == F.col("_n") - 1, F.col("end")).otherwise(edge(F.col("_i") + 1))).withColumn("start", edge(F.col("_i")))
    return cut.withColumn("end", F.col("_e")).select(*df.columns)


def resize(df: DataFrame, bp: int, chrom_sizes: dict[str, int] | None = None) -> DataFrame:
    """AGG-05: widen (or shrink) each row on both sides, not past the chromosome's bounds."""
    end = F.col("end") + bp
    if chrom_sizes:
        sizes = F.create_map(*[x for c, n in chrom_sizes.items() for x in (F.lit(c), F.lit(n).cast("long"))])
        end = F.least(end, F.element_at(sizes, F.col("chromosome")))
    out = df.withColumns({"start": F.greatest(F.col("start") - bp, F.lit(0).cast("long")), "end": F.greatest(end, F.lit(0).cast("long"))})
    return out.where(F.col("end") > F.col("start")) if bp < 0 else out


def total_range_size(df: DataFrame) -> DataFrame:
    """AGG-06: bases under rows, each once (one row)."""
    merged = merge(df.select(*sample_keys(df), "chromosome", "start", "end"), bp=1)
    return merged.groupBy(*sample_keys(df)).agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0).cast("long")).alias("size"))


def region_size_by_chrom(df: DataFrame) -> DataFrame:
    """AGG-07: bases of rows by chromosome, overlaps counted again."""
    return df.groupBy("chromosome").agg(F.sum(F.col("end") - F.col("start")).alias("length"))


def chromosome_sizes(df: DataFrame, to_mb: bool = False) -> DataFrame:
    """AGG-08: the furthest end of each chromosome."""
    out = df.groupBy("chromosome").agg(F.max("end").alias("size"))
    return out.withColumn("size", F.col("size") / 1e6) if to_mb else out


def big_chromosomes(df: DataFrame) -> DataFrame:
    """AGG-09: chromosomes longer than the first that is less than half of the next longer one."""
    sizes = chromosome_sizes(df)
    w = Window.orderBy(F.col("size").desc(), "chromosome")  # one row for each chromosome
    drop = F.when(F.col("size") < 0.5 * F.lag("size").over(w), 1).otherwise(0)
    return sizes.withColumn("_d", drop).withColumn("_d", F.max("_d").over(w)).where("_d = 0").drop("_d")


def guess_chromosome_regions(targets: DataFrame, telomere: int = 150000) -> DataFrame:
    """AGG-10: what of each chromosome is accessible, judged by its targets."""
    return targets.groupBy("chromosome").agg(F.max("end").alias("end")).select("chromosome", F.lit(telomere).cast("long").alias("start"), "end")


def join_regions(df: DataFrame, min_gap: int) -> DataFrame:
    """AGG-11: fuse neighbours with less than min_gap between them."""
    w = Window.partitionBy("chromosome").orderBy("start", "end")
    gap = F.col("start") - F.lag("end").over(w)
    checked = F.when(gap <= 0, F.raise_error(F.lit("regions must not touch")).cast("int")).when(gap.isNull() | (gap >= min_gap), 1).otherwise(0)
    run = df.withColumn("_g", checked).withColumn("_g", F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("chromosome", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def accessible(regions: DataFrame, excludes: list[DataFrame] = (), min_gap: int = 5000, skip_noncanonical: bool = True) -> DataFrame:
    """AGG-12: sequenced regions less the excluded ones, small gaps closed."""
    out = drop_noncanonical(regions) if skip_noncanonical else regions
    for other in excludes:
        out = subtract(out, other)
    return join_regions(out.select("chromosome", "start", "end"), min_gap)


def targets(bait: DataFrame, annotate: DataFrame | None = None, short_names: bool = False, split: bool = False, average: float = 200 / 0.75) -> DataFrame:
    """AGG-13: bait regions made bins, with gene names."""
    from .signal import shorten_labels

    out = bait.where(F.col("start") != F.col("end"))
    if split:
        out = subdivide(out, average, 0)
    if annotate is not None:
        out = into_ranges(annotate, with_row_id(out.drop("gene")), "gene", "-").drop("row_id")
    return shorten_labels(out) if short_names else out


def off_targets(target: DataFrame, access: DataFrame | None = None, average: int = 150000, least: int | None = None) -> DataFrame:
    """AGG-14: bins of what is accessible and well away from targets."""
    pad = 2 * INSERT_SIZE
    least = 2 * int(average * 2**-5) if least is None else least
    space = drop_noncanonical(access, target) if access is not None else guess_chromosome_regions(target)
    at = ["chromosome", "start", "end"]
    left = subtract(resize(space.select(*at), -pad), resize(target.select(*at), pad))
    return subdivide(left, average, least).withColumn("gene", F.lit(OFF_TARGET))
