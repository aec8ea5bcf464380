"""Registered queries of readers and writers: files are written from views of the driver tables and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import CALLS, calls, query, r6
from .functions import genome as g
from .sources import readers, writers
from .sources.scratch import scratch
from .sources.views import bins, regions, rounded


def text_file(spark: SparkSession, rows: DataFrame, *head: str) -> str:
    """One text of lines, in files part-* in order: head, then rows (i, value) in order of i. Its path."""
    path = scratch(spark, "lines")
    top = spark.createDataFrame([(k - len(head), h) for k, h in enumerate(head)], "i long, value string") if head else rows.limit(0).select(F.col("i").cast("long").alias("i"), "value")
    rows.select(F.col("i").cast("long").alias("i"), "value").unionByName(top).orderBy("i").select("value").write.text(path)
    return path


def table_file(df: DataFrame, fmt: str, **options) -> str:
    path = scratch(df.sparkSession, fmt)
    writers.write_table(df, path, fmt, **options)
    return path


def tabbed(*parts) -> Column:
    return F.concat_ws("\t", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])


def strand() -> Column:
    return F.when(F.col("row_id") % 2 == 0, "+").otherwise("-")


STRAND_SQL = "CASE WHEN row_id%2=0 THEN '+' ELSE '-' END"
SIX = "CAST(printf('%.6g', {}) AS DOUBLE)"


def six(x: str, name: str) -> str:
    return f"round({SIX.format(x)},6) AS {name}"


# -- tables and regions -------------------------------------------------------------------------


@query(f"SELECT chromosome, start, \"end\", gene, {six('log2', 'log2')}, {six('depth', 'depth')}, round({SIX.format('weight')},4) AS weight FROM iv_bins WHERE row_id%5<>0")
def src_tab(spark, sf):
    rows = bins(spark, sf).withColumn("log2", F.when(F.col("row_id") % 5 != 0, F.col("log2"))).drop("row_id")
    back = readers.read_table(spark, table_file(rows, "tab"), "tab")
    return back.select("chromosome", "start", "end", "gene", r6("log2", "log2"), r6("depth", "depth"), rounded("weight", 4).alias("weight"))


def _bed(spark, sf) -> str:
    rows = regions(spark, sf).select(F.col("row_id").alias("i"), tabbed("chromosome", "start", "end", "gene", F.lit("0"), strand()).alias("value"))
    return text_file(spark, rows, "browser position chr1:1-1000", "# a comment")


@query(f'SELECT chromosome, start, "end", gene, {STRAND_SQL} AS strand FROM iv_regions')
def src_bed(spark, sf):
    return readers.read_table(spark, _bed(spark, sf), "bed").select("chromosome", "start", "end", "gene", "strand")


@query('SELECT chromosome, start, "end" FROM iv_regions')
def src_bed3(spark, sf):
    return readers.read_table(spark, table_file(regions(spark, sf), "bed3"), "bed3").drop("sample_id")


@query('SELECT chromosome, start, "end", gene FROM iv_regions')
def src_bed4(spark, sf):
    return readers.read_table(spark, table_file(regions(spark, sf), "bed4"), "bed4").drop("sample_id")


def _tracks(spark, sf) -> str:
    one = F.col("row_id") % 3
    rows = regions(spark, sf).select((one * 1_000_000_000 + F.col("row_id") + 1).alias("i"), tabbed("chromosome", "start", "end", "gene").alias("value"))
    marks = spark.range(3).select((F.col("id") * 1_000_000_000).alias("i"), F.concat(F.lit('track name="T '), F.col("id").cast("string"), F.lit('" color=1')).alias("value"))
    return text_file(spark, rows.unionByName(marks))


@query("""SELECT chromosome, start, "end", gene, 'T ' || CAST(row_id%3 AS VARCHAR) AS track FROM iv_regions""")
def src_bed_tracks(spark, sf):
    return readers.bed_tracks(spark, _tracks(spark, sf)).select("chromosome", "start", "end", "gene", "track")


@query('SELECT chromosome, start, "end", gene FROM iv_regions WHERE row_id%3=0')
def src_bed_first_track(spark, sf):
    return readers.read_bed(spark, _tracks(spark, sf)).select("chromosome", "start", "end", "gene")


def _gff(spark, sf) -> str:
    kind = F.when(F.col("row_id") % 3 == 0, "exon").otherwise("gene")
    note = F.concat(F.lit("ID=x"), F.col("row_id").cast("string"), F.when(F.col("row_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(";Name="), F.col("gene"))), F.lit(";note=n"))
    score = F.when(F.col("row_id") % 2 == 0, ".").otherwise((F.col("row_id") % 100).cast("string"))
    line = tabbed("chromosome", F.lit("made"), kind, F.col("start") + 1, "end", score, strand(), F.lit("."), note)
    return text_file(spark, regions(spark, sf).select(F.col("row_id").alias("i"), line.alias("value")), "##gff-version 3")


@query(f"""SELECT chromosome, start, "end", CASE WHEN row_id%4=0 THEN '-' ELSE gene END AS gene, {STRAND_SQL} AS strand, 'gene' AS type,
 CASE WHEN row_id%2<>0 THEN CAST(row_id%100 AS DOUBLE) END AS score FROM iv_regions WHERE row_id%3<>0""")
def src_gff(spark, sf):
    return readers.read_gff(spark, _gff(spark, sf), keep_type="gene").select("chromosome", "start", "end", "gene", "strand", "type", "score")


@query("""SELECT chromosome, start, "end", gene, '+' AS strand FROM iv_regions""")
def src_interval(spark, sf):
    return readers.read_table(spark, table_file(regions(spark, sf), "interval"), "interval").drop("sample_id")


PICARD = f"{six('depth', 'depth')}, {SIX.format('depth/avg(depth) OVER ()')} AS r"


@query(f'SELECT chromosome, start, "end", gene, depth, round(r,6) AS ratio FROM (SELECT chromosome, start, "end", gene, {PICARD} FROM iv_bins)')
def src_picard_hs(spark, sf):
    back = readers.read_table(spark, table_file(bins(spark, sf), "picardhs"), "picardhs")
    return back.select("chromosome", "start", "end", "gene", r6("depth", "depth"), r6("ratio", "ratio"))


@query(f"""SELECT chromosome, start, gene, round(log2(r),4) AS log2 FROM (SELECT chromosome, start, CASE WHEN row_id%2=0 THEN 'long_' || gene ELSE gene END AS gene, {PICARD} FROM iv_bins)""")
def src_import_picard(spark, sf):
    piped = F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("-|"), F.lit("long_"), F.col("gene"), F.lit("|x"))).otherwise(F.col("gene"))
    back = readers.import_picard(spark, table_file(bins(spark, sf).withColumn("gene", piped), "picardhs"), empty=float("-inf"))
    return back.select("chromosome", "start", "gene", rounded("log2", 4).alias("log2"))


def _refflat(spark, sf) -> str:
    text = lambda *c: F.concat_ws(",", *[x.cast("string") for x in c], F.lit(""))
    s, e = F.col("start"), F.col("end")
    line = tabbed("gene", F.concat(F.lit("NM_"), F.col("row_id").cast("string")), "chromosome", strand(), s + 1, e, s + 11, e - 10, F.lit("2"), text(s + 1, s + 31), text(s + 20, e))
    return text_file(spark, regions(spark, sf).select(F.col("row_id").alias("i"), line.alias("value")))


@query(f"""SELECT chromosome, start, "end", gene, 'NM_' || CAST(row_id AS VARCHAR) AS accession, {STRAND_SQL} AS strand FROM iv_regions""")
def src_refflat(spark, sf):
    return readers.read_table(spark, _refflat(spark, sf), "refflat").drop("sample_id")


@query('SELECT chromosome, start+10 AS start, "end"-10 AS "end", gene FROM iv_regions')
def src_refflat_cds(spark, sf):
    return readers.read_refflat(spark, _refflat(spark, sf), cds=True).select("chromosome", "start", "end", "gene")


@query('SELECT chromosome, start, start+20 AS "end", gene FROM iv_regions UNION ALL SELECT chromosome, start+30 AS start, "end", gene FROM iv_regions')
def src_refflat_exons(spark, sf):
    return readers.read_refflat(spark, _refflat(spark, sf), exons=True).select("chromosome", "start", "end", "gene")


def _seg(spark, sf) -> str:
    return table_file(calls(spark, sf).withColumn("sample_id", F.concat(F.lit("s"), (F.col("row_id") % 3).cast("string"))), "seg", chrom_ids=False)


@query(CALLS + """ SELECT 's' || CAST(row_id%3 AS VARCHAR) AS sample_id, chromosome, start, "end", '-' AS gene, round(log2,6) AS log2, probes FROM seg""")
def src_seg(spark, sf):
    return readers.read_seg(spark, _seg(spark, sf), every=True).withColumn("log2", rounded("log2", 6))


@query(CALLS + """ SELECT 'X' || chromosome AS chromosome, start, "end", round(log2*log2(10),6) AS log2 FROM seg WHERE row_id%3=1""")
def src_seg_sample(spark, sf):
    back = readers.read_seg(spark, _seg(spark, sf), sample_id="s1", chrom_prefix="X", from_log10=True)
    return back.select("chromosome", "start", "end", r6("log2", "log2"))


def _sizes(spark, sf) -> DataFrame:
    return regions(spark, sf).groupBy("chromosome").agg(F.max("end").alias("length"))


@query('SELECT chromosome, CAST(0 AS BIGINT) AS start, max("end") AS "end" FROM iv_regions GROUP BY 1')
def src_dict(spark, sf):
    line = tabbed(F.lit("@SQ"), F.concat(F.lit("SN:"), F.col("chromosome")), F.concat(F.lit("LN:"), F.col("length").cast("string")), F.lit("M5:0"), F.lit("UR:made"))
    return readers.read_table(spark, text_file(spark, _sizes(spark, sf).select("length", line.alias("value")).withColumnRenamed("length", "i"), "@HD\tVN:1.5"), "dict")


@query("""SELECT chromosome, start, "end", split_part(gene, ' ', 1) AS gene FROM iv_regions""")
def src_text(spark, sf):
    return readers.read_table(spark, table_file(regions(spark, sf), "text"), "text").drop("sample_id")


@query("""SELECT unnest(['bed', 'gff', 'interval', 'refflat', 'tab', 'text', 'vcf']) AS format, unnest([n, n, n, n, b, n, n]) AS rows, unnest([s, s, s, s, bs, s, s]) AS starts
 FROM (SELECT count(*) AS n, CAST(sum(start) AS BIGINT) AS s FROM iv_regions), (SELECT count(*) AS b, CAST(sum(start) AS BIGINT) AS bs FROM iv_bins)""")
def src_auto(spark, sf):
    plain = regions(spark, sf).withColumn("gene", F.split("gene", " ")[0])
    files = {"bed": _bed(spark, sf), "gff": _gff(spark, sf), "interval": table_file(plain, "interval"), "refflat": _refflat(spark, sf), "tab": table_file(bins(spark, sf).drop("row_id"), "tab"), "text": table_file(plain, "text"), "vcf": _vcf(spark, sf)}
    out = None
    for path in files.values():
        kind = readers.sniff(spark, path)
        one = readers.read_auto(spark, path).groupBy().agg(F.lit(kind).alias("format"), F.count_distinct("start").alias("rows") if kind == "vcf" else F.count("*").alias("rows"), F.sum_distinct("start").alias("starts") if kind == "vcf" else F.sum("start").alias("starts"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT chromosome, start, "end", gene, CAST(0 AS DOUBLE) AS log2, CAST(0 AS DOUBLE) AS spread FROM iv_regions""")
def src_bed_probes(spark, sf):
    return readers.bed_to_probes(readers.read_bed(spark, _bed(spark, sf)).select("chromosome", "start", "end", "gene"))


# -- variants -----------------------------------------------------------------------------------

#: Per site: depth, alternative reads of tumour and normal, and what the line says of them.
SITES = """, sites AS (SELECT *, 10+k%60 AS d, (k*7)%(11+k%60) AS a, 10+k%45 AS nd, CASE WHEN k%3=0 THEN (10+k%45)//2 ELSE 0 END AS na,
 k%5=0 AS two, k%7=0 AS rejected, k%11=0 AS somatic FROM (SELECT chromosome, start, "end", row_id, row_id AS k FROM iv_regions))"""


def _sites(spark, sf) -> DataFrame:
    k = F.col("row_id")
    d, nd = 10 + k % 60, 10 + k % 45
    return regions(spark, sf).withColumns({"d": d, "a": (k * 7) % (d + 1), "nd": nd, "na": F.when(k % 3 == 0, F.floor(nd / 2)).otherwise(0), "two": k % 5 == 0, "rejected": k % 7 == 0, "somatic": k % 11 == 0})


def _vcf(spark, sf) -> str:
    s = _sites(spark, sf)
    word = lambda c: c.cast("string")
    sample = lambda gt, a, d: F.concat_ws(":", gt, F.concat_ws(",", word(d - a), word(a)), word(d))
    tumor = sample(F.when(F.col("a") == 0, "0/0").when(F.col("a") == F.col("d"), "1/1").otherwise("0/1"), F.col("a"), F.col("d"))
    normal = sample(F.when(F.col("na") == 0, "0|0").otherwise("0|1"), F.col("na"), F.col("nd"))
    info = F.concat(F.lit("DP="), word(F.col("d") + F.col("nd")), F.when(F.col("somatic"), F.lit(";SOMATIC")).otherwise(F.lit("")))
    line = tabbed("chromosome", F.col("start") + 1, F.lit("."), F.lit("A"), F.when(F.col("two"), "G,TT").otherwise("G"), F.lit("50.5"), F.when(F.col("rejected"), "q10;bad").otherwise("PASS"), info, F.lit("GT:AD:DP"), normal, tumor)
    head = ["##fileformat=VCFv4.2", "##PEDIGREE=<Derived=TUMOR,Original=NORMAL>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tNORMAL\tTUMOR"]
    return text_file(spark, s.select(F.col("row_id").alias("i"), line.alias("value")), *head)


GENOTYPES = """CAST(d AS DOUBLE) AS depth, CAST(a AS DOUBLE) AS alt_count, round(a/CAST(d AS DOUBLE),6) AS alt_freq, CASE WHEN a=0 THEN 0.0::DOUBLE WHEN a=d THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS zygosity,
 CAST(nd AS DOUBLE) AS n_depth, CAST(na AS DOUBLE) AS n_alt_count, round(na/CAST(nd AS DOUBLE),6) AS n_alt_freq, CASE WHEN na=0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS n_zygosity"""
ALLELES = """(SELECT *, 'G' AS alt, 1 AS n FROM sites UNION ALL SELECT *, 'TT' AS alt, 2 AS n FROM sites WHERE two)"""
VCF_COLUMNS = ("depth", "alt_count", "alt_freq", "zygosity", "n_depth", "n_alt_count", "n_alt_freq", "n_zygosity")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("chromosome", "start", "end", "ref", "alt", "somatic", *[r6(c, c) for c in VCF_COLUMNS])


@query(SITES + f"""SELECT chromosome, start, start+n AS "end", 'A' AS ref, alt, somatic, {GENOTYPES} FROM {ALLELES}""")
def src_vcf(spark, sf):
    return _rounded(readers.read_table(spark, _vcf(spark, sf), "vcf"))


@query(SITES + f"""SELECT chromosome, start, start+n AS "end", 'A' AS ref, alt, somatic, {GENOTYPES} FROM {ALLELES} WHERE NOT rejected AND NOT somatic AND nd>=30""")
def src_vcf_filtered(spark, sf):
    return _rounded(readers.read_vcf(spark, _vcf(spark, sf), "TUMOR", "NORMAL", min_depth=30, skip_reject=True, skip_somatic=True))


SITE_END = "start+CASE WHEN two THEN 3 ELSE 1 END"


@query(SITES + f"""SELECT chromosome, start, {SITE_END} AS "end", 'A' AS ref, CASE WHEN two THEN 'G,TT' ELSE 'G' END AS alt, '50.5' AS qual, CASE WHEN rejected THEN 'q10;bad' ELSE 'PASS' END AS filter,
 CASE WHEN na=0 THEN '0|0' ELSE '0|1' END || ':' || (nd-na) || ',' || na || ':' || nd AS "NORMAL" FROM sites""")
def src_vcf_simple(spark, sf):
    back = readers.read_table(spark, _vcf(spark, sf), "vcf-simple")
    return back.select("chromosome", "start", "end", "ref", "alt", "qual", "filter", "NORMAL")


@query(SITES + f"""SELECT chromosome, start, {SITE_END} AS "end", 'A' AS ref, CASE WHEN two THEN 'G,TT' ELSE 'G' END AS alt, 50.5::DOUBLE AS qual FROM sites""")
def src_vcf_sites(spark, sf):
    return readers.read_table(spark, _vcf(spark, sf), "vcf-sites").select("chromosome", "start", "end", "ref", "alt", "qual")


@query(SITES + f""", x AS (SELECT chromosome, start, alt, a/CAST(d AS DOUBLE) AS t, na/CAST(nd AS DOUBLE) AS n FROM {ALLELES} WHERE NOT somatic AND nd>=20 AND na>0)
 SELECT chromosome, start, alt, round(CASE WHEN t<n THEN 0.5::DOUBLE*t/n ELSE 1-0.5::DOUBLE*(1-t)/(1-n) END,6) AS alt_freq FROM x""")
def src_het_snps(spark, sf):
    back = readers.load_het_snps(spark, _vcf(spark, sf), "TUMOR", "NORMAL", boost=True)
    return back.select("chromosome", "start", "alt", r6("alt_freq", "alt_freq"))


@query(SITES + """SELECT chromosome AS "#Chrm", start AS "Pos", CAST(d-a AS BIGINT) AS "Ref_Allele", CAST(a AS BIGINT) AS "Mut_Allele", 'tumor' AS kind FROM sites WHERE a<=d
 UNION ALL SELECT chromosome, start, CAST(nd-na AS BIGINT), CAST(na AS BIGINT), 'normal' FROM sites WHERE a<=d""")
def snk_theta_snps(spark, sf):
    tumor, normal = writers.export_theta_snps(readers.read_vcf(spark, _vcf(spark, sf)))
    return tumor.withColumn("kind", F.lit("tumor")).unionByName(normal.withColumn("kind", F.lit("normal")))


# -- sequences, THetA ---------------------------------------------------------------------------

#: 40 lines of 50 bases for each contig; some are unknown, some end in unknown bases.
LINES = """, fa AS (SELECT 'chr' || CAST(n_nationkey+1 AS VARCHAR) AS chromosome, n_nationkey AS c, unnest(range(0,40)) AS k FROM nation),
 ln AS (SELECT chromosome, CAST(k*50 AS BIGINT) AS start, CASE WHEN (c+k)%4=0 THEN repeat('N',50) WHEN (c+k)%4=1 THEN repeat('ACGTacgtGG',4) || repeat('N',10) ELSE repeat('ACGTTacgCA',5) END AS s FROM fa)"""


def _fasta(spark, sf) -> str:
    n = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", F.explode(F.sequence(F.lit(-1), F.lit(39))).alias("k"))
    kind = (F.col("n_nationkey") + F.col("k")) % 4
    repeat = lambda x, times: F.repeat(F.lit(x), times)
    line = F.when(F.col("k") < 0, F.concat(F.lit(">chr"), (F.col("n_nationkey") + 1).cast("string"), F.lit(" made"))).when(kind == 0, repeat("N", 50)).when(kind == 1, F.concat(repeat("ACGTacgtGG", 4), repeat("N", 10))).otherwise(repeat("ACGTTacgCA", 5))
    return text_file(spark, n.select((F.col("n_nationkey") * 100 + F.col("k")).alias("i"), line.alias("value")))


KNOWN = """, kn AS (SELECT chromosome, start, start+CASE WHEN s LIKE '%N' THEN 40 ELSE 50 END AS e FROM ln WHERE s NOT LIKE 'N%'),
 op AS (SELECT *, CASE WHEN start=lag(e) OVER w THEN 0 ELSE 1 END AS o FROM kn WINDOW w AS (PARTITION BY chromosome ORDER BY start)),
 gr AS (SELECT *, sum(o) OVER (PARTITION BY chromosome ORDER BY start) AS g FROM op)"""


@query(LINES + KNOWN + ' SELECT chromosome, min(start) AS start, max(e) AS "end" FROM gr GROUP BY chromosome, g')
def src_fasta_regions(spark, sf):
    return readers.read_table(spark, _fasta(spark, sf), "fasta")


@query(LINES + KNOWN + """, rg AS (SELECT chromosome, min(start) AS a, max(e) AS b FROM gr GROUP BY chromosome, g),
 jn AS (SELECT *, CASE WHEN a-lag(b) OVER w < 20 THEN 0 ELSE 1 END AS o FROM rg WINDOW w AS (PARTITION BY chromosome ORDER BY a)),
 jg AS (SELECT *, sum(o) OVER (PARTITION BY chromosome ORDER BY a) AS g2 FROM jn) SELECT chromosome, min(a) AS start, max(b) AS "end" FROM jg GROUP BY chromosome, g2""")
def agg_accessible(spark, sf):
    from .operators.intervals import accessible

    return accessible(readers.fasta_regions(spark, _fasta(spark, sf)), min_gap=20)


@query(LINES + """, sq AS (SELECT chromosome, string_agg(s, '' ORDER BY start) AS s FROM ln GROUP BY 1), iv AS (SELECT chromosome, start%1700 AS a, start%1700+("end"-start)%290+5 AS b, row_id FROM iv_regions),
 ct AS (SELECT row_id, iv.chromosome, a, b, substr(s, CAST(a+1 AS BIGINT), CAST(b-a AS BIGINT)) AS x FROM iv JOIN sq USING (chromosome)),
 cn AS (SELECT *, length(regexp_replace(x,'[^GCgc]','','g')) AS gc, length(regexp_replace(x,'[^acgt]','','g')) AS lo, length(regexp_replace(x,'[^ACGTacgt]','','g')) AS n FROM ct)
 SELECT row_id, round(CASE WHEN n>0 THEN gc/CAST(n AS DOUBLE) ELSE 0 END,6) AS gc, round(CASE WHEN n>0 THEN lo/CAST(n AS DOUBLE) ELSE 0 END,6) AS rmask FROM cn""")
def src_sequence_stats(spark, sf):
    r = regions(spark, sf)
    size = (F.col("end") - F.col("start")) % 290 + 5
    iv = r.select("chromosome", (F.col("start") % 1700).alias("start"), (F.col("start") % 1700 + size).alias("end"), "row_id").where(~F.col("chromosome").isin("chrX", "chrY"))
    out = readers.sequence_stats(readers.read_fasta_lines(spark, _fasta(spark, sf)), iv)
    return out.select("row_id", r6("gc", "gc"), r6("rmask", "rmask"))


THETA = "12.5\t0.3,0.4,0.3\t2,2:1,X:3,0:2,4\t0.1,0.2"


def _theta(spark) -> str:
    return text_file(spark, spark.createDataFrame([(1, THETA)], "i long, value string"), "#NLL\tmu\tC\tp*")


@query("""SELECT 12.5::DOUBLE AS nll, 0.3::DOUBLE AS mu_normal, i, clone, copies FROM (VALUES (0,0,2),(0,1,2),(1,0,1),(1,1,NULL),(2,0,3),(2,1,0),(3,0,2),(3,1,4)) AS t(i, clone, copies)""")
def src_theta(spark, sf):
    return readers.parse_theta(spark, _theta(spark)).select("nll", "mu_normal", "i", "clone", "copies")


@query(CALLS + """, o AS (SELECT *, row_number() OVER (ORDER BY CAST(substr(chromosome,4) AS INT), start)-1 AS i FROM seg WHERE chromosome NOT IN ('chrX','chrY'))
 SELECT chromosome, start, clone, copies AS cn, round(log2(CASE WHEN copies=0 THEN 0.5::DOUBLE ELSE copies END/2),6) AS log2
 FROM o JOIN (VALUES (0,0,2),(0,1,2),(1,0,1),(2,0,3),(2,1,0),(3,0,2),(3,1,4)) AS t(i, clone, copies) USING (i)""")
def src_import_theta(spark, sf):
    out = readers.import_theta(calls(spark, sf).drop("log2", "row_id"), readers.parse_theta(spark, _theta(spark)))
    return out.select("chromosome", "start", "clone", "cn", r6("log2", "log2"))


# -- names --------------------------------------------------------------------------------------


@query("""SELECT DISTINCT chromosome FROM (SELECT CASE WHEN row_id%3=0 THEN chromosome || '_random' ELSE chromosome END AS chromosome FROM iv_regions) WHERE chromosome NOT LIKE '%random'""")
def prj_noncanonical(spark, sf):
    name = F.when(F.col("row_id") % 3 == 0, F.concat(F.col("chromosome"), F.lit("_random"))).otherwise(F.col("chromosome"))
    return g.drop_noncanonical(regions(spark, sf).withColumn("chromosome", name)).select("chromosome").distinct()


@query("SELECT row_id, CASE WHEN row_id%2=0 THEN 'long_' || gene ELSE gene END AS gene FROM iv_regions")
def fun_unpipe_name(spark, sf):
    piped = F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("-|"), F.lit("long_"), F.col("gene"), F.lit("|x"))).otherwise(F.col("gene"))
    return regions(spark, sf).select("row_id", g.unpipe_name(piped).alias("gene"))
