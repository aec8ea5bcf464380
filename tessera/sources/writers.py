"""Writers of text formats and exports for other tools: tables shaped in Spark, written by Spark."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import genome as g
from ..operators.order import numbered
from ..operators.ranges import range_join, with_row_id


def short_float(c: Column) -> Column:
    """%.6g as other tools print it: six significant digits, no trailing zeros; -0, inf and -inf."""
    e = F.floor(F.log10(F.abs(c)))
    plain = (e >= -5) & (e < 6)
    rounded = F.regexp_replace(F.format_string("%.6g", c), r"(\.\d*?)0+$", "$1")
    text = F.regexp_replace(rounded, r"\.$", "")
    science = F.regexp_replace(F.regexp_replace(F.format_string("%.5e", c), r"(\.\d*?)0+e", "$1e"), r"\.e", "e")
    endless = F.abs(c) == float("inf")
    return F.when(c.isNull(), None).when(c == 0, F.when(c.cast("string").startswith("-"), "-0").otherwise("0")).when(endless, F.when(c < 0, "-inf").otherwise("inf")).when(plain, text).otherwise(science)


def as_text(df: DataFrame) -> DataFrame:
    own = lambda c: F.col(f"`{c}`")
    return df.select(*[short_float(own(c).cast("double")).alias(c) if t in ("double", "float") else own(c).cast("string").alias(c) for c, t in df.dtypes])


def tab_table(df: DataFrame) -> DataFrame:
    """SNK-01/05: required columns first."""
    return g.canonical_order(df, tuple(c for c in ("chromosome", "start", "end", "gene", "log2") if c in df.columns))


def bed_table(df: DataFrame, columns: int = 4) -> DataFrame:
    """SNK-02."""
    gene = F.coalesce("gene", F.lit("-")) if "gene" in df.columns else F.lit("-")
    return df.select("chromosome", "start", "end", *([gene.alias("gene")] if columns == 4 else []))


def interval_table(df: DataFrame) -> DataFrame:
    """SNK-03: Picard intervals."""
    strand = F.coalesce("strand", F.lit("+")) if "strand" in df.columns else F.lit("+")
    gene = F.coalesce("gene", F.lit("-")) if "gene" in df.columns else F.lit("-")
    return df.select("chromosome", (F.col("start") + 1).alias("start"), "end", strand.alias("strand"), gene.alias("gene"))


def picard_table(df: DataFrame) -> DataFrame:
    """SNK-03: coverage of targets."""
    keys = g.sample_keys(df)
    if "depth" in df.columns:
        mean = df.groupBy(*keys).agg(F.avg("depth").alias("_mean"))
        rows = df.join(F.broadcast(mean), keys) if keys else df.join(F.broadcast(mean), F.lit(True))
        ratio, depth = F.col("depth") / F.col("_mean"), F.col("depth")
    else:
        rows, ratio, depth = df, F.pow(F.lit(2.0), F.col("log2")), F.pow(F.lit(2.0), F.col("log2"))
    gc = F.col("gc") if "gc" in df.columns else F.lit(0.0)
    return rows.select(
        F.col("chromosome").alias("chrom"), (F.col("start") + 1).alias("start"), "end", (F.col("end") - F.col("start")).alias("length"), F.col("gene").alias("name"),
        gc.alias("%gc"), depth.alias("mean_coverage"), ratio.alias("normalized_coverage"),
    )


def seg_table(df: DataFrame, chrom_ids: bool = False) -> DataFrame:
    """SNK-04/09: segments of any number of samples; chrom_ids: chromosomes as numbers in natural order."""
    sample = F.col("sample_id") if "sample_id" in df.columns else F.lit("sample")
    probes = [F.col("probes").alias("num.mark")] if "probes" in df.columns else []
    rows = df
    chrom = F.col("chromosome")
    if chrom_ids:
        names = df.select("chromosome").distinct()
        ids = names.withColumn("_id", F.dense_rank().over(Window.orderBy(g.chrom_key(), "chromosome")))  # one row for each chromosome
        rows, chrom = df.join(F.broadcast(ids), "chromosome"), F.col("_id").cast("string")
    return rows.select(sample.alias("ID"), chrom.alias("chrom"), (F.col("start") + 1).alias("loc.start"), F.col("end").alias("loc.end"), *probes, F.col("log2").alias("seg.mean"))


def text_table(df: DataFrame) -> DataFrame:
    """SNK-05: labels, moved to 1-based once."""
    return df.select(g.label().alias("label"), F.coalesce("gene", F.lit("-")).alias("gene") if "gene" in df.columns else F.lit("-").alias("gene"))


WRITERS: dict[str, tuple[Callable[[DataFrame], DataFrame], bool]] = {
    "tab": (tab_table, True), "bed": (lambda d: bed_table(d, 4), False), "bed3": (lambda d: bed_table(d, 3), False), "bed4": (lambda d: bed_table(d, 4), False),
    "interval": (interval_table, False), "picardhs": (picard_table, True), "seg": (seg_table, True), "text": (text_table, False),
}


def write_table(df: DataFrame, path: str, fmt: str = "tab", **options) -> None:
    """SNK-01/07: rows as tab-separated text, in files of a folder; an earlier one is replaced."""
    shape, header = WRITERS[fmt]
    as_text(g.sort_regions(shape(df, **options)) if fmt in ("tab", "bed", "bed3", "bed4", "interval") else shape(df, **options)).write.mode("overwrite").option("sep", "\t").option("header", header).csv(path)


# -- exports ------------------------------------------------------------------------------------


def copies(segments: DataFrame, ploidy: int, male_reference: bool, female_sample: bool) -> DataFrame:
    """ncopies and expect for each segment."""
    n = F.col("cn") if "cn" in segments.columns else F.rint(g.absolute_pure(ploidy, male_reference)).cast("long")
    return segments.withColumns({"ncopies": n, "expect": g.expected_copies(ploidy, female_sample)})


def export_bed(segments: DataFrame, ploidy: int = 2, male_reference: bool = False, female_sample: bool = True, label: str | None = None, show: str = "ploidy") -> DataFrame:
    """SNK-08: copies of segments; show: all, variant (not as expected) or ploidy (not the ploidy)."""
    rows = copies(segments, ploidy, male_reference, female_sample)
    if show == "ploidy":
        rows = rows.where(F.col("ncopies") != ploidy)
    elif show == "variant":
        rows = rows.where(F.col("ncopies") != F.col("expect"))
    name = F.lit(label) if label else (F.col("sample_id") if "sample_id" in rows.columns else F.col("gene"))
    return rows.select("chromosome", "start", "end", name.alias("label"), "ncopies")


def vcf_header(version: str = "4.2", sample: str = "sample") -> str:
    """SNK-10: the head of a file of structural variants."""
    # fixed values of the format
    info = [
        ("CIEND", 2, "Integer", "Confidence interval around END for imprecise variants"), ("CIPOS", 2, "Integer", "Confidence interval around POS for imprecise variants"),
        ("END", 1, "Integer", "End position of the variant described in this record"), ("IMPRECISE", 0, "Flag", "Imprecise structural variation"),
        ("SVLEN", 1, "Integer", "Difference in length between REF and ALT alleles"), ("SVTYPE", 1, "String", "Type of structural variant"),
        ("FOLD_CHANGE", 1, "Float", "Fold change"), ("FOLD_CHANGE_LOG", 1, "Float", "Log fold change"), ("PROBES", 1, "Integer", "Number of probes in CNV"),
    ]
    alt = [("DEL", "Deletion"), ("DUP", "Duplication"), ("CNV", "Copy number variable region")]
    form = [("GT", "String", "Genotype"), ("GQ", "Float", "Genotype quality"), ("CN", "Integer", "Copy number genotype for imprecise events"), ("CNQ", "Float", "Copy number genotype quality for imprecise events")]
    out = [f"##fileformat=VCFv{version}", f"##fileDate={datetime.date.today():%Y%m%d}", "##source=tessera"]
    out += [f'##INFO=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in info]
    out += [f'##ALT=<ID={i},Description="{d}">' for i, d in alt]
    out += [f'##FORMAT=<ID={i},Number=1,Type={t},Description="{d}">' for i, t, d in form]
    return "\n".join([*out, "\t".join(("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample))])


def assign_ci(segments: DataFrame, bins: DataFrame) -> DataFrame:
    """SNK-10: ends of the first bin and starts of the last in each segment."""
    seg = with_row_id(segments)
    found = range_join(seg, bins).groupBy("q.row_id").agg(F.min_by("s.end", F.struct("s.start", "s.end")).alias("ci_left"), F.max_by("s.start", F.struct("s.start", "s.end")).alias("ci_right"))
    return seg.join(found, "row_id", "left")


def export_vcf(segments: DataFrame, ploidy: int = 2, male_reference: bool = False, female_sample: bool = True, bins: DataFrame | None = None, sample: str = "sample") -> DataFrame:
    """SNK-10: records of segments with other than the expected copies."""
    rows = copies(assign_ci(segments, bins) if bins is not None else segments, ploidy, male_reference, female_sample)
    loss = F.col("ncopies") < F.col("expect")
    info = [F.lit("IMPRECISE"), F.concat(F.lit("SVTYPE="), F.when(loss, "DEL").otherwise("DUP")), F.concat(F.lit("END="), F.col("end")), F.concat(F.lit("SVLEN="), F.when(loss, F.col("start") - F.col("end")).otherwise(F.col("end") - F.col("start")))]
    info += [F.concat(F.lit("FOLD_CHANGE="), short_float(F.pow(F.lit(2.0), F.col("log2")))), F.concat(F.lit("FOLD_CHANGE_LOG="), short_float(F.col("log2"))), F.concat(F.lit("PROBES="), F.col("probes").cast("string"))]
    if bins is not None:
        w = Window.partitionBy(*g.sample_keys(segments), "chromosome").orderBy("start", "end")
        left, right = F.col("ci_left") - F.col("start"), F.col("end") - F.col("ci_right")
        pair = lambda a, b: F.concat(F.lit("("), a.cast("string"), F.lit(","), b.cast("string"), F.lit(")"))
        rows = rows.withColumns({"_pos": pair(F.coalesce(-F.lag(right).over(w), F.lit(0)), left), "_end": pair(right, F.coalesce(F.lead(left).over(w), F.lit(0)))})
        info += [F.concat(F.lit("CIPOS="), F.col("_pos")), F.concat(F.lit("CIEND="), F.col("_end"))]
    gt = F.when(loss, F.when(F.col("ncopies") == 0, "1/1").otherwise("0/1")).otherwise("0/1")
    values = F.when(loss, F.concat_ws(":", gt, F.col("probes").cast("string"))).otherwise(F.concat_ws(":", gt, F.lit("0"), F.col("ncopies").cast("string"), F.col("probes").cast("string")))
    kept = rows.where((F.col("ncopies") != F.col("expect")) & F.col("probes").isNotNull())
    return kept.select(
        F.col("chromosome").alias("#CHROM"), F.greatest(F.col("start"), F.lit(1).cast("long")).alias("POS"), F.lit(".").alias("ID"), F.lit("N").alias("REF"),
        F.when(loss, "<DEL>").otherwise("<DUP>").alias("ALT"), F.lit(".").alias("QUAL"), F.lit(".").alias("FILTER"), F.concat_ws(";", *info).alias("INFO"),
        F.when(loss, "GT:GQ").otherwise("GT:GQ:CN:CNQ").alias("FORMAT"), values.alias(sample),
    )


def export_gistic_markers(bins: DataFrame) -> DataFrame:
    """SNK-11: two markers for each autosomal bin."""
    rows = bins.where(g.is_autosome())
    mark = lambda c: rows.select(g.label().alias("ID"), F.col("chromosome").alias("CHROM"), c.alias("POS"))
    return mark(F.col("start") + 1).unionByName(mark(F.col("end"))).distinct()


def theta_counts(log2: Column, bins: Column) -> Column:
    """Reads of a segment, at a mean depth of 500 over bins of 200 bases and reads of 100."""
    return F.coalesce(F.bround(bins * 200 * (F.pow(F.lit(2.0), log2) * 500) / 100, 0).cast("long"), F.lit(0).cast("long"))


def export_theta(segments: DataFrame, normal: DataFrame | None = None) -> DataFrame:
    """SNK-12."""
    seg = with_row_id(segments.where(g.is_autosome()))
    ids = seg.select("chromosome").distinct().withColumn("chrm", F.dense_rank().over(Window.orderBy(g.chrom_key(), "chromosome")))  # one row for each chromosome
    seg = seg.join(F.broadcast(ids), "chromosome")
    if normal is not None:
        means = range_join(seg, normal).groupBy("q.row_id").agg(F.avg("s.log2").alias("_ref"), F.count("*").alias("_n"))
        seg = seg.join(means, "row_id", "left")
    else:
        seg = seg.withColumns({"_ref": F.lit(0.0), "_n": F.lit(None).cast("long")})
    n = F.col("probes") if "probes" in segments.columns else F.col("_n")
    return seg.select(
        F.format_string("start_%d_%d:end_%d_%d", "chrm", "start", "chrm", "end").alias("#ID"), F.col("chrm").cast("int").alias("chrm"), "start", "end",
        theta_counts(F.col("log2"), n).alias("tumorCount"), theta_counts(F.col("_ref"), n).alias("normalCount"),
    )


def export_theta_snps(variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-13: reference and mutant counts of tumour and normal sample."""
    rows = variants.where((g.is_autosome() | g.is_x() | g.is_y()) & (F.length("ref") == 1) & (F.length("alt") == 1)).dropna(subset=["depth", "alt_count"])
    if "n_depth" in variants.columns:
        rows = rows.dropna(subset=["n_depth", "n_alt_count"])
    rows = rows.where("depth >= alt_count")

    def one(p):
        d, a = F.col(f"{p}depth"), F.col(f"{p}alt_count")
        return rows.select(F.col("chromosome").alias("#Chrm"), F.col("start").alias("Pos"), (d - a).cast("long").alias("Ref_Allele"), a.cast("long").alias("Mut_Allele"))

    return one(""), one("n_" if "n_depth" in variants.columns else "")


def export_nexus_basic(bins: DataFrame) -> DataFrame:
    """SNK-14."""
    return bins.select("chromosome", "start", "end", "gene", "log2", g.label().alias("probe"))


def export_nexus_ogt(bins: DataFrame, variants: DataFrame, min_weight: float = 0.0) -> DataFrame:
    """SNK-14: bins with allele frequencies."""
    from ..operators.ranges import baf_by_ranges

    rows = bins.where(F.col("weight") >= min_weight) if min_weight and "weight" in bins.columns else bins
    out = baf_by_ranges(variants, rows)
    return out.select(F.col("chromosome").alias("Chromosome"), F.col("start").alias("Position"), F.col("end").alias("End"), F.col("log2").alias("Log R Ratio"), F.col("baf").alias("B-Allele Frequency"))


def merge_samples(bins: DataFrame, samples: list[str]) -> DataFrame:
    """SNK-15: one log2 column for each sample; samples must have the same bins. Repeats of a bin are rows of their own, in order of log2."""
    name = F.concat_ws(":", "chromosome", F.concat_ws("-", "start", "end"), "gene")
    again = Window.partitionBy("sample_id", "chromosome", "start", "end", "gene").orderBy("log2")
    rows = bins.withColumns({"label": name, "_again": F.row_number().over(again)})
    wide = rows.groupBy("chromosome", "start", "end", "gene", "label", "_again").pivot("sample_id", samples).agg(F.struct(F.first("log2").alias("v"), F.count(F.lit(1)).alias("n")))
    wrong = F.lit(False)
    for s in samples:
        wrong = wrong | F.col(f"`{s}`.n").isNull() | (F.col(f"`{s}`.n") != 1)
    value = lambda s: F.when(wrong, F.raise_error(F.lit("samples do not have the same bins")).cast("double")).otherwise(F.col(f"`{s}`.v")).alias(s)
    return wide.select("chromosome", "start", "end", "gene", "label", *[value(s) for s in samples])


def export_cdt(bins: DataFrame, samples: list[str]) -> DataFrame:
    """SNK-15: a clustering table: two rows of its own, then one for each bin, numbered in order."""
    wide = numbered(merge_samples(bins, samples).withColumn("_key", g.chrom_key()), ["_key", "start", "end", "gene"], "_i")
    text = lambda c: F.col(f"`{c}`").cast("string").alias(c)
    number = F.col("_i").cast("string")
    rows = wide.select(F.concat(F.lit("GENE"), number, F.lit("X")).alias("GID"), F.concat(F.lit("IMAGE:"), number).alias("CLID"), F.col("label").alias("NAME"), F.lit("1").alias("GWEIGHT"), *map(text, samples))
    head = [["AID", "", "", "", *(f"ARRY{i:03d}X" for i in range(len(samples)))], ["EWEIGHT", "", "", "", *["1"] * len(samples)]]
    return bins.sparkSession.createDataFrame(head, rows.schema).unionByName(rows)


def export_jtv(bins: DataFrame, samples: list[str]) -> DataFrame:
    """SNK-15."""
    wide = merge_samples(bins, samples)
    return wide.select(F.lit("IMAGE:").alias("CloneID"), F.col("label").alias("Name"), *samples)


EXPORTS: dict[str, Callable[..., DataFrame]] = {
    "bed": export_bed, "cdt": export_cdt, "gistic": export_gistic_markers, "jtv": export_jtv, "nexus-basic": export_nexus_basic, "nexus-ogt": export_nexus_ogt,
    "seg": seg_table, "theta": export_theta, "theta-snps": export_theta_snps, "vcf": export_vcf,
}
