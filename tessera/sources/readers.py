"""Readers of text formats: lines come from spark.read.text, so files may be many, large and remote.

Every reader gives 0-based half-open coordinates; sample_id comes from the file's name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.genome import NULL_LOG2, file_base, from_label, heterozygous, is_autosome, tumor_boost, unpipe_name, zygosity


#: Lines of a block at most, as a power of two: what is sorted at a time does not grow with a file or its splits.
BLOCK_BITS = 16


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, sample_id, _text, _block and line.

    _text is the file, or the folder of files part-*, which are one text in the order of their
    names; _block is a stretch of the split of it that a line was read from; in order of _block
    and line, lines stand as in the text.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("line"))
    rows = rows.withColumn("_block", F.struct(F.col("_path").alias("file"), F.col("_start").alias("start"), F.shiftright("line", BLOCK_BITS).alias("stretch"))).drop("_path", "_start")
    return rows.withColumns({"_text": F.regexp_replace("_block.file", "/part-[^/]*$", ""), "sample_id": file_base("_file")})


def carried(rows: DataFrame, mark: Column, name: Column) -> DataFrame:
    """rows of lines() with _name, that of the last marked line up to each in its text, and _no, how many there are.

    A task holds a block; from block to block goes one row with its last name and its count.
    """
    rows = rows.withColumns({"_mark": mark, "_own": F.when(mark, name)})
    blocks = rows.groupBy("_text", "_block").agg(F.max_by("_own", F.when(F.col("_mark"), F.col("line"))).alias("_last"), F.count_if("_mark").alias("_count"))
    before = Window.partitionBy("_text").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.last("_last", ignorenulls=True).over(before).alias("_last"), F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_count"))
    w = Window.partitionBy("_block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({"_name": F.last("_own", ignorenulls=True).over(w), "_no": F.count_if("_mark").over(w)})
    joined = inside.join(F.broadcast(blocks), "_block")  # one row for each block
    return joined.withColumns({"_name": F.coalesce("_name", "_last"), "_no": F.col("_no") + F.col("_count")}).drop("_mark", "_own", "_last", "_count")


def files(spark: SparkSession, path: str) -> list[str]:
    """The files of path in order of their names."""
    return sorted(unquote(f) for f in spark.read.text(path).inputFiles())


def fields(df: DataFrame, sep: str = "\t") -> DataFrame:
    return df.withColumn("f", F.split("value", sep))


def at(i: int) -> Column:
    """Field i from 1, NULL where the line is shorter."""
    return F.get("f", F.lit(i - 1))


def number(c: Column) -> Column:
    """A double; '.', empty and NaN are NULL."""
    x = c.try_cast("double")
    return F.when(F.isnan(x), None).otherwise(x)


def data_lines(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    return fields(lines(spark, path).where(~F.col("value").startswith(comment) & (F.trim("value") != "")))


TAB_TYPES = {"chromosome": "string", "gene": "string", "start": "bigint", "end": "bigint", "probes": "bigint", "cn": "bigint", "cn1": "bigint", "cn2": "bigint", "strand": "string", "accession": "string", "ref": "string", "alt": "string"}


def read_tab(spark: SparkSession, path: str) -> DataFrame:
    """SRC-04/35: tables with a header; rows without log2 go. Types by name, so nothing is inferred from data."""
    raw = spark.read.option("sep", "\t").option("header", True).option("mode", "FAILFAST").csv(path)
    typed = raw.select(*[number(F.col(c)).alias(c) if TAB_TYPES.get(c, "double") == "double" else F.col(c).try_cast(TAB_TYPES[c]).alias(c) for c in raw.columns], file_base(F.input_file_name()).alias("sample_id"))
    return typed.dropna(subset=["log2"]) if "log2" in typed.columns else typed


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05: the first track of each file."""
    rows = bed_tracks(spark, path).where("track_no <= 1")
    return rows.select("chromosome", "start", "end", "gene", "strand", "sample_id")


def bed_tracks(spark: SparkSession, path: str) -> DataFrame:
    """SRC-08: rows of all tracks, with track (DEFAULT before the first) and its number."""
    rows = lines(spark, path).where(~F.col("value").rlike("^(browser|#)") & (F.trim("value") != ""))
    name = F.coalesce(F.nullif(F.regexp_extract("value", 'name="([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract("value", r"name=(\S+)", 1), F.lit("")), F.lit("DEFAULT"))
    is_track = F.col("value").startswith("track")
    rows = carried(rows, is_track, name).withColumns({"track": F.coalesce("_name", F.lit("DEFAULT")), "track_no": F.col("_no")})
    f = fields(rows.where(~is_track))
    return f.select(at(1).alias("chromosome"), at(2).cast("long").alias("start"), at(3).cast("long").alias("end"), F.coalesce(at(4), F.lit("-")).alias("gene"), F.coalesce(at(6), F.lit(".")).alias("strand"), "track", "track_no", "sample_id")


def read_bed3(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06."""
    return read_bed(spark, path).select("chromosome", "start", "end", "sample_id")


def read_bed4(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06."""
    return read_bed(spark, path).select("chromosome", "start", "end", "gene", "sample_id")


def read_gff(spark: SparkSession, path: str, tag: str = r"(?:Name|gene_id|gene_name|gene)", keep_type: str | None = None) -> DataFrame:
    """SRC-09."""
    gene = F.coalesce(F.nullif(F.regexp_extract(at(9), rf'{tag}[= ]"?([^";]+)"?', 1), F.lit("")), F.lit("-"))
    out = data_lines(spark, path).select(
        at(1).alias("chromosome"), (at(4).cast("long") - 1).alias("start"), at(5).cast("long").alias("end"), gene.alias("gene"), at(7).alias("strand"),
        at(2).alias("source"), at(3).alias("type"), number(at(6)).alias("score"), at(8).alias("phase"), at(9).alias("attribute"), "sample_id",
    )
    return out.where(F.col("type") == keep_type) if keep_type else out


def read_interval(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10."""
    return data_lines(spark, path, "@").select(
        at(1).alias("chromosome"), (at(2).cast("long") - 1).alias("start"), at(3).cast("long").alias("end"), F.coalesce(F.nullif(at(5), F.lit("")), F.lit("-")).alias("gene"), at(4).alias("strand"), "sample_id"
    )


def read_picard_hs(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11."""
    rows = data_lines(spark, path).where(~F.col("value").startswith("chrom\t"))
    return rows.select(
        at(1).alias("chromosome"), (at(2).cast("long") - 1).alias("start"), at(3).cast("long").alias("end"), at(5).alias("gene"), number(at(6)).alias("gc"), number(at(7)).alias("depth"), number(at(8)).alias("ratio"), "sample_id"
    )


def import_picard(spark: SparkSession, path: str, empty: float = NULL_LOG2) -> DataFrame:
    """SRC-33: coverage of targets as log-ratios, names unpiped; empty: the log-ratio of a target without coverage."""
    rows = read_picard_hs(spark, path)
    log2 = F.when(F.col("ratio") > 0, F.log2("ratio")).otherwise(F.lit(empty))
    return rows.withColumns({"log2": log2, "gene": unpipe_name(F.col("gene"))})


def read_refflat(spark: SparkSession, path: str, cds: bool = False, exons: bool = False) -> DataFrame:
    """SRC-12/13: transcripts, coding spans or exons."""
    if cds and exons:
        raise ValueError("cds and exons exclude each other")
    rows = data_lines(spark, path)
    numbers = lambda c: F.transform(F.split(F.regexp_replace(c, ",$", ""), ","), lambda x: x.cast("long"))
    head = [at(3).alias("chromosome"), at(1).alias("gene"), at(2).alias("accession"), at(4).alias("strand"), "sample_id"]
    if exons:
        out = rows.select(*head, F.explode(F.zip_with(numbers(at(10)), numbers(at(11)), lambda a, b: F.struct(a.alias("start"), b.alias("end")))).alias("e"))
        out = out.select("*", "e.start", "e.end").drop("e")
    else:
        a, b = (7, 8) if cds else (5, 6)
        out = rows.select(*head, at(a).cast("long").alias("start"), at(b).cast("long").alias("end"))
    return out.withColumn("start", F.col("start") - 1)


def read_seg(spark: SparkSession, path: str, sample_id: str | int | None = None, chrom_names: dict[str, str] | None = None, chrom_prefix: str | None = None, from_log10: bool = False, every: bool = False) -> DataFrame:
    """SRC-15/16: segments; every: all samples, else the one named, numbered or first."""
    rows = fields(lines(spark, path).where(F.contains("value", F.lit("\t"))).withColumn("value", F.regexp_replace("value", '"', "")))
    header = F.lower(at(3)).rlike("start|loc")
    rows = rows.where(~F.coalesce(header, F.lit(False)))
    wide = F.size("f") >= 6
    name = at(2)
    if chrom_names:
        table = F.create_map(*[x for k, v in chrom_names.items() for x in (F.lit(str(k)), F.lit(v))])
        name = F.coalesce(F.try_element_at(table, at(2)), at(2))
    if chrom_prefix:
        name = F.concat(F.lit(chrom_prefix), name)
    value = number(F.when(wide, at(6)).otherwise(at(5))) * (math.log2(10) if from_log10 else 1.0)
    out = rows.select(
        at(1).alias("sample_id"), name.alias("chromosome"), (at(3).try_cast("double").cast("long") - 1).alias("start"), at(4).try_cast("double").cast("long").alias("end"),
        F.lit("-").alias("gene"), value.alias("log2"), F.when(wide, at(5).try_cast("double").cast("long")).alias("probes"), "line",
    )
    if every:
        return out.drop("line")
    order = out.groupBy("sample_id").agg(F.min("line").alias("_first"))
    if isinstance(sample_id, str):
        return out.where(F.col("sample_id") == sample_id).drop("line")
    w = Window.orderBy("_first")  # one row for each sample
    chosen = order.withColumn("_i", F.row_number().over(w) - 1).where(F.col("_i") == (sample_id or 0)).select("sample_id")
    return out.join(F.broadcast(chosen), "sample_id", "left_semi").drop("line")


def read_dict(spark: SparkSession, path: str) -> DataFrame:
    """SRC-17: contigs of a sequence dictionary."""
    rows = lines(spark, path).where(F.col("value").startswith("@SQ"))
    return rows.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("chromosome"), F.lit(0).cast("long").alias("start"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("end"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """SRC-18: chr:start-end gene; a line of another form fails the job."""
    rows = lines(spark, path).where(F.trim("value") != "")
    parsed = from_label(F.col("value"))
    good = F.when(F.col("value").rlike(r"^(\w[\w.]*)?:(\d+)?-(\d+)?"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a region: "), F.col("value"))).cast("string"))
    return rows.withColumn("value", good).select(parsed.alias("r"), "sample_id").select("r.*", "sample_id")


# -- VCF ----------------------------------------------------------------------------------------


def vcf_header(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(header lines, sample names): the head of a file, read on the driver."""
    head = []
    for file in files(spark, path):
        for r in spark.read.text(file).where(F.col("value").startswith("#")).toLocalIterator():  # a partition at a time
            head.append(r["value"])
            if r["value"].startswith("#CHROM"):
                break
        if head and head[-1].startswith("#CHROM"):
            break
    columns = next((h.rstrip("\n").split("\t") for h in head if h.startswith("#CHROM")), [])
    return head, columns[9:]


def choose_samples(head: list[str], samples: list[str], sample_id: str | int | None = None, normal_id: str | int | None = None) -> tuple[str | None, str | None]:
    """SRC-20: (sample, normal): as asked, else by PEDIGREE, else by the caller's header, else the first."""
    pick = lambda x: samples[x] if isinstance(x, int) else x
    sample_id, normal_id = pick(sample_id), pick(normal_id)
    for name in (sample_id, normal_id):
        if name is not None and samples.count(name) != 1:
            raise ValueError(f"sample {name!r} is not in the file once")
    pairs: list[tuple[str, str]] = []
    for h in head:
        if h.startswith("##PEDIGREE"):
            tag = dict(re.findall(r"(\w+)=([^,<>]+)", h.partition("=")[2]))
            if "Derived" in tag:
                pairs.append((tag["Derived"], tag.get("Original")))
        elif h.startswith(("##GATKCommandLine", "##MuTect")):
            tag = dict(re.findall(r"(tumor_sample_name|normal_sample_name)=([^\s\"]+)", h))
            if "tumor_sample_name" in tag:
                pairs.append((tag["tumor_sample_name"], tag.get("normal_sample_name")))
    for s, n in pairs:
        if s in samples and (sample_id in (None, s)) and (normal_id in (None, n)):
            return s, n if n in samples else None
    if sample_id is None and normal_id is not None:
        sample_id = next((s for s in samples if s != normal_id), None)
    return sample_id if sample_id is not None else (samples[0] if samples else None), normal_id


def _info(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.concat(F.lit(";"), at(8), F.lit(";")), f";{name}=([^;]*);", 1), F.lit(""))


def _genotype(index: int, prefix: str) -> dict[str, Column]:
    """SRC-22: zygosity, depth and alternative count of one sample's column."""
    tags = F.map_from_arrays(F.split(at(9), ":"), F.transform(F.sequence(F.lit(0), F.size(F.split(at(9), ":")) - 1), lambda i: F.get(F.split(at(10 + index), ":"), i)))
    tag = lambda n: F.nullif(F.try_element_at(tags, F.lit(n)), F.lit("."))
    total = lambda c: F.aggregate(F.transform(F.split(c, ","), lambda x: x.try_cast("double")), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    depth = F.coalesce(tag("DP").try_cast("double"), total(tag("AD")), _info("DP").try_cast("double"))
    alleles = F.array_distinct(F.filter(F.split(tag("GT"), "[/|]"), lambda x: x != "."))
    zyg = F.when(tag("GT").isNull() | (F.size(alleles) == 0), None).when(F.size(alleles) > 1, 0.5).when(F.get(alleles, F.lit(0)) == "0", 0.0).otherwise(1.0)
    second = lambda c: F.get(F.split(c, ","), F.lit(1)).try_cast("double")
    alt = F.coalesce(second(tag("AD")), second(tag("CLCAD2")), total(tag("AO")))
    return {f"{prefix}zygosity": zyg, f"{prefix}depth": depth, f"{prefix}alt_count": alt}


def read_vcf(spark: SparkSession, path: str, sample_id: str | int | None = None, normal_id: str | int | None = None, min_depth: int | None = None, skip_reject: bool = False, skip_somatic: bool = False) -> DataFrame:
    """SRC-19/21/22: a row for each alternative allele, with frequencies."""
    head, samples = vcf_header(spark, path)
    sample, normal = choose_samples(head, samples, sample_id, normal_id)
    rows = data_lines(spark, path)
    if skip_reject:
        flags = F.array_except(F.split(at(7), ";"), F.array(F.lit("."), F.lit("PASS"), F.lit("KEEP")))
        rows = rows.where(F.size(flags) == 0)
    somatic = (F.concat(F.lit(";"), at(8), F.lit(";"))).rlike(";SOMATIC[;=]")
    columns: dict[str, Column] = {}
    if sample is not None:
        columns |= _genotype(samples.index(sample), "")
        if normal is not None:
            columns |= _genotype(samples.index(normal), "n_")
    else:
        af = _info("AF").try_cast("double")
        depth = _info("DP").try_cast("double")
        columns = {"zygosity": F.when(af < 0.25, 0.0).when(af < 0.75, 0.5).otherwise(1.0), "depth": depth, "alt_count": F.rint(af * depth)}
    start = at(2).cast("long") - 1
    out = rows.select(at(1).alias("chromosome"), start.alias("start"), at(4).alias("ref"), F.explode(F.split(at(5), ",")).alias("alt"), somatic.alias("somatic"), _info("END").try_cast("bigint").alias("_end"), *[c.alias(n) for n, c in columns.items()])
    out = out.where(F.col("alt") != "<NON_REF>").withColumn("end", F.coalesce("_end", F.col("start") + F.length("alt"))).drop("_end")
    for p in ("", "n_"):
        if f"{p}depth" in columns:
            out = out.withColumn(f"{p}alt_freq", F.coalesce(F.try_divide(F.col(f"{p}alt_count"), F.col(f"{p}depth")), F.lit(0.0)))
    if min_depth:
        out = out.where(F.col("n_depth" if "n_depth" in out.columns else "depth") >= min_depth)
    if skip_somatic:
        out = out.where(~F.col("somatic"))
    return out.select("chromosome", "start", "end", "ref", "alt", *[c for c in out.columns if c not in ("chromosome", "start", "end", "ref", "alt")])


def read_vcf_sites(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """SRC-24/25: sites; compat gives a plain substitution no length."""
    ref, alt = F.length(at(4)), F.length(at(5))
    size = F.greatest(alt - ref, F.lit(0)) if compat else F.greatest(ref, alt - ref)
    start = at(2).cast("long") - 1
    return data_lines(spark, path).select(
        at(1).alias("chromosome"), start.alias("start"), F.coalesce(_info("END").try_cast("bigint"), start + size).alias("end"), at(4).alias("ref"), at(5).alias("alt"),
        at(3).alias("id"), number(at(6)).alias("qual"), at(7).alias("filter"), at(8).alias("info"),
    )


def read_vcf_simple(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """SRC-23: all columns as strings, a column for each sample."""
    _, samples = vcf_header(spark, path)
    ref, alt = F.length(at(4)), F.length(at(5))
    size = F.greatest(alt - ref, F.lit(0)) if compat else F.greatest(ref, alt - ref)
    start = at(2).cast("long") - 1
    names = ("id", "qual", "filter", "info", "format")
    return data_lines(spark, path).select(
        at(1).alias("chromosome"), start.alias("start"), F.coalesce(_info("END").try_cast("bigint"), start + size).alias("end"), at(4).alias("ref"), at(5).alias("alt"),
        *[at(i).alias(n) for i, n in zip((3, 6, 7, 8, 9), names)], *[at(10 + i).alias(s) for i, s in enumerate(samples)],
    )


def load_het_snps(spark: SparkSession, path: str, sample_id=None, normal_id=None, min_depth: int = 20, zygosity_freq: float | None = None, boost: bool = False) -> DataFrame:
    """SRC-36: heterozygous sites for allele frequencies."""
    rows = read_vcf(spark, path, sample_id, normal_id, min_depth, skip_somatic=True)
    freq = "n_alt_freq" if "n_alt_freq" in rows.columns else "alt_freq"
    z = "n_zygosity" if "n_zygosity" in rows.columns else "zygosity"
    if zygosity_freq is None and z == "n_zygosity" and rows.where(F.coalesce(F.col(z), F.lit(0.0)) != 0).isEmpty():
        zygosity_freq = 0.25
    if zygosity_freq is not None:
        rows = rows.withColumn(z, zygosity(F.col(freq), zygosity_freq, 1 - zygosity_freq))
    if "n_zygosity" in rows.columns:
        rows = rows.where(~((F.col("zygosity") != 0.0) & (F.col("n_zygosity") == 0.0)))
    rows = heterozygous(rows)
    if boost and "n_alt_freq" in rows.columns:
        rows = rows.withColumn("alt_freq", tumor_boost(F.col("alt_freq"), F.col("n_alt_freq")))
    return rows


# -- sequences, THetA ---------------------------------------------------------------------------


def read_fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """(chromosome, start, sequence): lines of sequence with their places in their contig."""
    rows = carried(lines(spark, path), F.col("value").startswith(">"), F.regexp_extract("value", r"^>(\S+)", 1)).withColumn("chromosome", F.col("_name"))
    rows = rows.where(~F.col("value").startswith(">")).withColumn("n", F.length("value"))
    own = Window.partitionBy("chromosome").orderBy("_block", "line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("start", (F.sum("n").over(own) - F.col("n")).cast("long")).select("chromosome", "start", F.col("value").alias("sequence"))


def fasta_regions(spark: SparkSession, path: str) -> DataFrame:
    """SRC-30: longest runs without N in each contig."""
    from ..operators.intervals import merge

    rows = read_fasta_lines(spark, path)
    gaps, runs = F.split("sequence", "[^N]+", -1), F.regexp_extract_all("sequence", F.lit("[^N]+"), F.lit(0))
    step = F.aggregate(
        F.sequence(F.lit(1), F.size(runs)),
        F.struct(F.lit(0).alias("p"), F.array().cast("array<struct<a:int,b:int>>").alias("o")),
        lambda acc, i: F.struct(
            (acc["p"] + F.length(F.get(F.col("_g"), i - 1)) + F.length(F.get(F.col("_r"), i - 1))).alias("p"),
            F.concat(acc["o"], F.array(F.struct((acc["p"] + F.length(F.get(F.col("_g"), i - 1))).alias("a"), (acc["p"] + F.length(F.get(F.col("_g"), i - 1)) + F.length(F.get(F.col("_r"), i - 1))).alias("b")))).alias("o"),
        ),
        lambda acc: acc["o"],
    )
    held = rows.withColumns({"_g": gaps, "_r": runs}).where(F.size("_r") > 0)
    spans = held.select("chromosome", "start", F.explode(step).alias("x"))
    return merge(spans.select("chromosome", (F.col("start") + F.col("x.a")).alias("start"), (F.col("start") + F.col("x.b")).alias("end")))


def sequence_stats(sequences: DataFrame, intervals: DataFrame) -> DataFrame:
    """SRC-31/FUN-01: intervals with gc and rmask, counted over the sequence lines that they meet."""
    from ..operators.ranges import range_join, with_row_id

    iv = with_row_id(intervals)
    spans = sequences.withColumn("end", F.col("start") + F.length("sequence"))
    cut = range_join(iv, spans).select("q.row_id", F.expr("substring(s.sequence, cast(greatest(q.start - s.start, 0) as int) + 1, cast(least(q.`end`, s.`end`) - greatest(q.start, s.start) as int))").alias("x"))
    n = lambda p: F.sum(F.regexp_count("x", F.lit(p)))
    sums = cut.groupBy("row_id").agg(n("[GCgc]").alias("_gc"), n("[acgt]").alias("_lo"), n("[ACGTacgt]").alias("_all"))
    return iv.join(sums, "row_id", "left").withColumns({"gc": F.coalesce(F.try_divide("_gc", "_all"), F.lit(0.0)), "rmask": F.coalesce(F.try_divide("_lo", "_all"), F.lit(0.0))}).drop("_gc", "_lo", "_all")


def parse_theta(spark: SparkSession, path: str) -> DataFrame:
    """SRC-32: (nll, mu_normal, mu_tumors, clone, i, copies): one row for each subclone and segment."""
    rows = data_lines(spark, path).where(~F.upper("value").startswith("NLL"))
    mu = F.transform(F.split(at(2), ","), lambda x: x.cast("double"))
    parts = F.transform(F.split(at(3), ":"), lambda s: F.transform(F.split(s, ","), lambda x: x.try_cast("int")))
    flat = rows.select(at(1).cast("double").alias("nll"), F.get(mu, F.lit(0)).alias("mu_normal"), F.slice(mu, 2, 100).alias("mu_tumors"), F.posexplode(parts).alias("i", "_c"))
    return flat.select("nll", "mu_normal", "mu_tumors", "i", F.posexplode("_c").alias("clone", "copies"))


def import_theta(segments: DataFrame, theta: DataFrame, ploidy: int = 2) -> DataFrame:
    """SRC-34: segments of each subclone with its copies and log-ratio; autosomes, by place."""
    from ..functions.genome import chrom_key

    w = Window.orderBy(chrom_key(), "start")  # segments of one sample
    seg = segments.where(is_autosome()).withColumn("i", F.row_number().over(w) - 1)
    joined = seg.join(theta.select("i", "clone", "copies"), "i").where("copies IS NOT NULL")
    copies = F.when(F.col("copies") == 0, 0.5).otherwise(F.col("copies").cast("double"))
    return joined.withColumn("log2", F.log2(copies / ploidy)).withColumnRenamed("copies", "cn").drop("i")


def bed_to_probes(regions: DataFrame) -> DataFrame:
    """SRC-37."""
    return regions.withColumns({"log2": F.lit(0.0), "spread": F.lit(0.0)})


#: The first line that says anything, by form, in this order.
SNIFF = {
    "text": r"^\w+:\d*-\d*.*",
    "tab": "^chromosome\tstart\tend",
    "interval": r"^\w+\t\d+\t\d+\t[.+-]\t\S+$",
    "refflat": r"^\S+\t\S+\t\w+\t[+-](\t\d+){5}\t(\d+,)+\t(\d+,)+$",
    "gff": r"^\w+\t\S+\t\w+\t\d+\t\d+\t\S+\t[.?+-]\t[012.]\t.*",
    "bed": r"^\S+\t\d+\t\d+",
}


def sniff(spark: SparkSession, path: str) -> str | None:
    """SRC-02: the format of a region file, None where it is blank."""
    # the first lines of the first file that has some: a limit over several tasks could give any task's lines first
    head = next((h for h in (spark.read.text(f).take(1000) for f in files(spark, path)) if h), [])
    for r in head:
        line = r["value"]
        if line.startswith("##gff-version"):
            return "gff"
        if line.startswith("##fileformat=VCF"):
            return "vcf"
        if line.startswith("@"):
            return "interval"
        if not line.strip() or line.startswith(("#", "track", "browser")):
            continue
        for name, pattern in SNIFF.items():
            if re.match(pattern, line):
                return name
        raise ValueError(f"format not known: {line[:80]!r}")
    return None


def read_auto(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02."""
    return READERS[sniff(spark, path) or "bed3"](spark, path)


READERS: dict[str, Callable[..., DataFrame]] = {
    "auto": read_auto, "bed": read_bed, "bed3": read_bed3, "bed4": read_bed4, "dict": read_dict, "gff": read_gff, "interval": read_interval, "picardhs": read_picard_hs,
    "refflat": read_refflat, "seg": read_seg, "tab": read_tab, "text": read_text, "vcf": read_vcf, "vcf-simple": read_vcf_simple, "vcf-sites": read_vcf_sites, "fasta": fasta_regions,
}


def read_table(spark: SparkSession, path: str, fmt: str = "tab", **options) -> DataFrame:
    """SRC-01/03: any registered format; a line that does not parse fails the job (SRC-38)."""
    if fmt not in READERS:
        raise ValueError(f"format must be one of {', '.join(sorted(READERS))}")
    return READERS[fmt](spark, path, **options)
