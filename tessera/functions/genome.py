"""Scalar expressions on genomic coordinates, names, ratios and copies."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values shared with the formats and methods that this package reads and repeats.
MIN_REF_COVERAGE = -5.0
MAX_REF_SPREAD = 1.0
NULL_LOG2 = -20.0
INSERT_SIZE = 250
IGNORED_GENES = ("-", ".", "CGH")
OFF_TARGET = "offTarget"
OFF_TARGET_ALIASES = ("offTarget", "Background")
SEED = 0xA5EED
CALL_THRESHOLDS = (-1.1, -0.25, 0.2, 0.7)


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Fail early where a required column is missing (PRJ-21)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN to NULL in all floating columns: the sources' boundary rule."""
    return df.withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def sample_keys(*frames: DataFrame) -> list[str]:
    """sample_id where every frame has it: operators then run sample by sample."""
    return ["sample_id"] if all("sample_id" in f.columns for f in frames) else []


def chrom_key(chromosome: Column | str = "chromosome") -> Column:
    """SRT-01: natural order as struct<n, rest>: numbers, X, Y, numbers with a letter, others."""
    name = F.regexp_replace(F.col(chromosome) if isinstance(chromosome, str) else chromosome, "^(?i:chr)", "")
    digits = F.regexp_extract(name, r"^(\d+)", 1)
    rest = F.regexp_replace(name, r"^\d+", "")
    n = F.when(digits == "", F.lit(0)).otherwise(F.expr("try_cast(null as bigint)"))
    n = F.coalesce(n, digits.try_cast("bigint"), F.lit(0).cast("long"))
    rank = (
        F.when(name.isin("X", "Y"), F.lit(1000).cast("long"))
        .when(rest == "", n)
        .when(F.length(rest) == 1, n + 2000)
        .otherwise(n + 3000)
    )
    return F.struct(rank.alias("n"), F.when(name.isin("X", "Y"), name).otherwise(rest).alias("rest"))


def sort_regions(df: DataFrame) -> DataFrame:
    """SRT-02: by natural chromosome order, start and end (and sample, row_id where present)."""
    tail = [c for c in ("row_id",) if c in df.columns]
    return df.orderBy(*sample_keys(df), chrom_key(), "start", "end", *tail)


def canonical_order(df: DataFrame, required: tuple[str, ...] = ("chromosome", "start", "end")) -> DataFrame:
    """Required columns first, then the others by name (PRJ-05)."""
    return df.select(*required, *sorted(c for c in df.columns if c not in required))


def label(chromosome: Column | str = "chromosome", start: Column | str = "start", end: Column | str = "end") -> Column:
    """PRJ-08: chr:start-end with a 1-based start; NULL where one of them is missing."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.concat(col(chromosome), F.lit(":"), (col(start) + 1).cast("string"), F.lit("-"), col(end).cast("string"))


LABEL = r"^(\w[\w.]*)?:(\d+)?-(\d+)?\s*(\S+)?"


def from_label(text: Column) -> Column:
    """PRJ-09: struct<chromosome,start,end,gene>; missing bounds are NULL."""
    part = lambda i: F.nullif(F.regexp_extract(text, LABEL, i), F.lit(""))
    return F.struct(
        part(1).alias("chromosome"), (part(2).cast("long") - 1).alias("start"), part(3).cast("long").alias("end"), F.coalesce(part(4), F.lit("-")).alias("gene")
    )


def unpack_range(value) -> tuple[str | None, int | None, int | None]:
    """A region given as label, name or tuple, on the driver."""
    if not value:
        return None, None, None
    if isinstance(value, str):
        m = re.match(LABEL, value)
        if not m:
            return value, None, None
        return m[1], int(m[2]) - 1 if m[2] else None, int(m[3]) if m[3] else None
    if len(value) >= 3:
        return tuple(value[:3])
    raise ValueError(f"not a region: {value!r}")


def is_autosome(chromosome: Column | str = "chromosome") -> Column:
    return (F.col(chromosome) if isinstance(chromosome, str) else chromosome).rlike(r"^(chr)?\d+$")


def autosomes(df: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """PRJ-10: numbered chromosomes (all, where there are none), and those in also."""
    w = Window.partitionBy(*(sample_keys(df) or [F.lit(1)]))
    if not sample_keys(df):
        some = df.where(is_autosome()).limit(1).select(F.lit(True).alias("_some"))
        flagged = df.join(F.broadcast(some), F.lit(True), "left")  # one row at most
        return flagged.where(F.col("_some").isNull() | is_autosome() | F.col("chromosome").isin(*also)).drop("_some")
    return (
        df.withColumn("_some", F.max(is_autosome()).over(w)).where(~F.col("_some") | is_autosome() | F.col("chromosome").isin(*also)).drop("_some")
    )


def is_x(chromosome: Column | str = "chromosome") -> Column:
    return (F.col(chromosome) if isinstance(chromosome, str) else chromosome).isin("chrX", "X")


def is_y(chromosome: Column | str = "chromosome") -> Column:
    return (F.col(chromosome) if isinstance(chromosome, str) else chromosome).isin("chrY", "Y")


def drop_low_coverage(df: DataFrame) -> DataFrame:
    """PRJ-11: rows with no signal."""
    low = F.col("log2") < NULL_LOG2 - MIN_REF_COVERAGE
    if "depth" in df.columns:
        low = low | F.coalesce(F.col("depth") == 0, F.lit(False))
    return df.where(~low)


def bad_bin(df: DataFrame) -> Column:
    """PRJ-12: bins of a reference not to be used."""
    bad = (F.col("log2") < MIN_REF_COVERAGE) | (F.col("log2") > -MIN_REF_COVERAGE) | (F.col("spread") > MAX_REF_SPREAD)
    if "depth" in df.columns:
        bad = bad | (F.col("depth") == 0)
    if "gc" in df.columns:
        bad = bad | ~F.col("gc").between(0.3, 0.7)
    return F.coalesce(bad, F.lit(False))


NONCANONICAL = r"(_random|_alt|_decoy|Un_|^Un|^GL\d|^KI\d|^NC_|^hs37d5|^hap|HLA|EBV|^(chr)?M$|^(chr)?MT$|phiX)"


def is_canonical(chromosome: Column | str = "chromosome") -> Column:
    """PRJ-13: names of assembled chromosomes."""
    return ~(F.col(chromosome) if isinstance(chromosome, str) else chromosome).rlike(NONCANONICAL)


def drop_noncanonical(df: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """PRJ-13: drop contigs without targets whose names are not canonical."""
    if targets is None:
        return df.where(is_canonical())
    on = targets.select("chromosome").distinct()
    return df.join(on, "chromosome", "left_semi").unionByName(df.join(on, "chromosome", "left_anti").where(is_canonical()))


def compare_chrom_names(a: DataFrame, b: DataFrame) -> None:
    """PRJ-14: two tables must share a chromosome name, or their naming differs."""
    names = lambda d: d.select("chromosome").distinct()
    if not names(a).isEmpty() and not names(b).isEmpty() and names(a).intersect(names(b)).isEmpty():
        raise ValueError("no chromosome name occurs in both tables")


def split_reference(reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PRJ-15: (targets, off-targets)."""
    off = F.col("gene").isin(*OFF_TARGET_ALIASES)
    return reference.where(~off), reference.where(off)


def shift_xx(df: DataFrame, male_reference: bool = False, is_xx: bool | None = None) -> DataFrame:
    """PRJ-16: X as if sample and reference were of one sex; is_xx may come as a column is_xx."""
    xx = F.col("is_xx") if is_xx is None else F.lit(is_xx)
    shift = F.when(xx & F.lit(male_reference), -1.0).when(~xx & F.lit(not male_reference), 1.0).otherwise(0.0)
    return df.withColumn("log2", F.col("log2") + F.when(is_x(), shift).otherwise(0.0))


def shuffle(df: DataFrame, seed: int = SEED) -> DataFrame:
    """PRJ-19: rows in an order that a seed fixes."""
    return df.orderBy(F.xxhash64(*df.columns, F.lit(seed)), *df.columns)


def expect_flat_log2(male_reference: bool = False) -> Column:
    """PRJ-17: the log-ratio of an even genome."""
    low = is_y() | is_x() if male_reference else is_y()
    return F.when(low, F.lit(-1.0)).otherwise(F.lit(0.0))


def reference_copies(ploidy: int, male_reference: bool) -> Column:
    """FUN-04: copies that the reference has."""
    half = ploidy // 2
    return F.when(is_y(), half).when(is_x(), half if male_reference else ploidy).otherwise(ploidy)


def expected_copies(ploidy: int, female_sample: bool) -> Column:
    """FUN-04: copies that a neutral sample has."""
    half = ploidy // 2
    return F.when(is_y(), 0 if female_sample else half).when(is_x(), ploidy if female_sample else half).otherwise(ploidy)


def absolute_pure(ploidy: int, male_reference: bool, log2: str = "log2") -> Column:
    """FUN-03 for pure samples."""
    return reference_copies(ploidy, male_reference) * F.pow(F.lit(2.0), F.col(log2))


def absolute_clonal(ploidy: int, purity: float, male_reference: bool, female_sample: bool, log2: str = "log2") -> Column:
    """FUN-03: copies in the tumour part of a mixed sample."""
    pure = absolute_pure(ploidy, male_reference, log2)
    if not purity or purity >= 1:
        return pure
    return F.greatest((pure - expected_copies(ploidy, female_sample) * (1 - purity)) / purity, F.lit(0.0))


def absolute_threshold(ploidy: int = 2, thresholds: tuple[float, ...] = CALL_THRESHOLDS, male_reference: bool = False, log2: str = "log2") -> Column:
    """FUN-02: the place of the first threshold at or above log2; beyond all, copies rounded up."""
    ref = reference_copies(ploidy, male_reference)
    x = F.col(log2)
    out = F.when(x.isNull() | F.isnan(x), ref.cast("long"))
    for c, threshold in enumerate(thresholds):
        scaled = F.when(ref != ploidy, F.floor(F.lit(c) * ref / ploidy)).otherwise(F.lit(c))
        out = out.when(x <= threshold, scaled.cast("long"))
    return out.otherwise(F.ceil(ref * F.pow(F.lit(2.0), x)).cast("long"))


def log2_ratios(absolute: Column, ploidy: int = 2, male_reference: bool = False, least: float = 1e-3, round_to_int: bool = False) -> Column:
    """FUN-05: copies back to log-ratios."""
    n = F.rint(absolute) if round_to_int else absolute
    flat = is_y() | is_x() if male_reference else is_y()
    return F.log2(F.greatest(n / ploidy, F.lit(least))) + F.when(flat, 1.0).otherwise(0.0)


def rescale_baf(purity: float, observed: Column, normal: float = 0.5) -> Column:
    """FUN-06: the tumour's allele frequency in a mixture."""
    return (observed - normal * (1 - purity)) / purity


def mirrored_baf(baf: Column, above: Column) -> Column:
    """FUN-08: frequency on one side of a half."""
    gap = F.abs(baf - 0.5)
    return F.when(above, 0.5 + gap).otherwise(0.5 - gap)


def tumor_boost(tumor: Column, normal: Column) -> Column:
    """FUN-09: tumour frequencies put right by the normal sample's."""
    return F.when(tumor < normal, F.try_divide(0.5 * tumor, normal)).otherwise(1 - F.try_divide(0.5 * (1 - tumor), 1 - normal))


def zygosity(frequency: Column, het: float = 0.0, hom: float = 0.0) -> Column:
    """FUN-10: 0, 0.5 or 1 by frequency."""
    return F.when(frequency >= hom, 1.0).when(frequency >= het, 0.5).otherwise(0.0)


def heterozygous(df: DataFrame) -> DataFrame:
    """FUN-10: heterozygous sites; all rows where there is none."""
    z = "n_zygosity" if "n_zygosity" in df.columns else "zygosity"
    if z not in df.columns:
        return df
    some = df.where(F.col(z).isNotNull() & ~F.col(z).isin(0.0, 1.0)).limit(1).select(F.lit(True).alias("_some"))
    return df.join(F.broadcast(some), F.lit(True), "left").where(F.col("_some").isNull() | ~F.col(z).isin(0.0, 1.0)).drop("_some")


def allele_copies(total: Column, baf: Column) -> tuple[Column, Column]:
    """FUN-11: (minor part, major part) of a depth."""
    minor = 0.5 * (1 - baf) * total
    return minor, total - minor


def gc_fraction(sequence: Column) -> Column:
    """FUN-01: G and C among A, C, G and T, 0 where there are none."""
    return F.coalesce(F.try_divide(F.regexp_count(sequence, F.lit("[GCgc]")), F.regexp_count(sequence, F.lit("[ACGTacgt]"))), F.lit(0.0))


def masked_fraction(sequence: Column) -> Column:
    """FUN-01: lower-case bases among all, 0 where there are none."""
    return F.coalesce(F.try_divide(F.regexp_count(sequence, F.lit("[acgt]")), F.regexp_count(sequence, F.lit("[ACGTacgt]"))), F.lit(0.0))


def unpipe_name(name: Column) -> Column:
    """FUN-13: the longest part of a piped name that is not to be ignored."""
    parts = F.array_distinct(F.split(name, r"\|"))
    real = F.array_except(parts, F.array(*[F.lit(x) for x in IGNORED_GENES]))
    pick = F.when(F.size(real) > 0, real).otherwise(parts)
    longest = F.sort_array(F.transform(pick, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))), asc=False)
    return F.when(F.contains(name, F.lit("|")), F.get(longest, 0)["x"]).otherwise(name)


def depth_to_bin(depth: Column, bases: float = 100000.0, least: int = 50, most: int = 50000) -> Column:
    """FUN-14: a bin size that gathers bases at this depth."""
    return F.least(F.greatest(F.bround(F.try_divide(F.lit(bases), depth), 0).cast("long"), F.lit(least).cast("long")), F.lit(most).cast("long"))


def file_base(path: Column | str, extensions: tuple[str, ...] = ("antitargetcoverage.cnn", "targetcoverage.cnn", "coverage.cnn", "recal.bam", "bam", "cnn", "cnr", "cns", "bed", "seg", "vcf.gz", "vcf")) -> Column:
    """PRJ-22: the file's name without folder and known extension."""
    name = F.regexp_extract(F.col(path) if isinstance(path, str) else path, "([^/]*)$", 1)
    known = reduce(lambda a, b: f"{a}|{b}", [re.escape(x) for x in extensions])
    return F.when(name.rlike(f"\\.(?:{known})$"), F.regexp_replace(name, f"\\.(?:{known})$", "")).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))
