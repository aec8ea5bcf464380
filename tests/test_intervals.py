import random

import pytest

from tessera.functions import genome as g
from tessera.operators import copynum, coverage, intervals, ranges, runs
from tessera.sources import readers, writers

RNG = random.Random(3)


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, "chromosome string, start long, end long" + extra)


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns or ("chromosome", "start", "end")) for r in df.collect())


@pytest.fixture(scope="module")
def some():
    out = []
    for _ in range(60):
        a = RNG.randrange(40000)
        out.append((RNG.choice(["chr1", "chr2"]), a, a + RNG.randrange(1, 3000)))
    return out


def covered(rows):
    out = set()
    for c, a, b in rows:
        out |= {(c, x) for x in range(a, b)}
    return out


def test_range_join_finds_every_pair_once(spark, some):
    q, s = some[:30], some[30:]
    pairs = ranges.range_join(table(spark, q), table(spark, s), tile=1000).select("q.start", "q.end", "s.start", "s.end").collect()
    brute = [(a[1], a[2], b[1], b[2]) for a in q for b in s if a[0] == b[0] and b[2] > a[1] and b[1] < a[2]]
    assert sorted(map(tuple, pairs)) == sorted(brute)


def test_merge_subtract_flatten_cover_what_they_should(spark, some):
    a, b = table(spark, some[:30]), table(spark, some[30:])
    merged = got(intervals.merge(a))
    assert covered(merged) == covered(some[:30])
    assert got(intervals.merge(table(spark, merged))) == merged
    assert covered(got(ranges.subtract(a, b))) == covered(some[:30]) - covered(some[30:])
    assert covered(got(intervals.flatten(a))) == covered(some[:30])
    assert sum(e - s for _, s, e in got(intervals.subdivide(a, 700))) == sum(e - s for _, s, e in merged)


def test_book_ended_rows(spark):
    rows = table(spark, [("chr1", 0, 10), ("chr1", 10, 20), ("chr1", 19, 30)])
    assert got(intervals.merge(rows)) == [("chr1", 0, 30)]
    assert got(intervals.merge(rows, bp=1)) == [("chr1", 0, 10), ("chr1", 10, 30)]


def test_natural_order(spark):
    names = ["chrX", "chr10", "chr2", "chrY", "chr1", "chrM", "chr1_random"]
    out = g.sort_regions(table(spark, [(n, 0, 1) for n in names])).collect()
    assert [r["chromosome"] for r in out] == ["chr1", "chr2", "chr10", "chrX", "chrY", "chrM", "chr1_random"]


def test_squash_and_genes(spark):
    rows = [("chr1", i * 10, i * 10 + 10, name, x, 1.0) for i, (name, x) in enumerate([("A", 0.0), ("A", 0.0), ("B", 1.0), ("-", 1.0), ("B", 1.0), ("-", 0.0)])]
    df = table(spark, rows, ", gene string, log2 double, weight double")
    assert got(runs.squash(df, ["log2"]), "start", "end", "gene", "probes") == [(0, 20, "A", 2), (20, 50, "B,-", 3), (50, 60, "-", 1)]
    genes = runs.by_gene(df).groupBy("gene_name", "gene_run").count()
    assert got(genes, "gene_name", "count") == [("A", 2), ("B", 3), ("offTarget", 1)]


def test_coverage_counts_clipped_bases(spark):
    reads = spark.createDataFrame([("chr1", 5, 10, 60, False), ("chr1", 18, 10, 60, False), ("chr1", 5, 10, 60, True)], "chromosome string, pos long, aligned_len int, mapq int, is_duplicate boolean")
    out = coverage.coverage(reads, table(spark, [("chr1", 10, 20), ("chr1", 100, 110)])).collect()
    assert sorted((r["start"], r["depth"], r["log2"]) for r in out) == [(10, 0.7, pytest.approx(-0.514573, abs=1e-5)), (100, 0.0, -20.0)]


def test_calls(spark):
    df = table(spark, [("chr1", 0, 9, -1.5), ("chr1", 10, 19, 0.0), ("chr2", 0, 9, 1.0), ("chrY", 0, 9, 0.0)], ", log2 double").withColumn("gene", g.F.lit("-"))
    assert got(copynum.call(df), "chromosome", "start", "cn") == [("chr1", 0, 0), ("chr1", 10, 2), ("chr2", 0, 4), ("chrY", 0, 1)]


def test_text_formats(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    bed = file("a.bed", "track name=x\nchr1\t0\t10\tG\t0\t+\nchr2\t5\t9\ntrack name=y\nchr3\t1\t2\n")
    assert got(readers.read_table(spark, bed, "bed"), "chromosome", "start", "end", "gene") == [("chr1", 0, 10, "G"), ("chr2", 5, 9, "-")]
    interval = file("b.interval_list", "@HD\tVN:1\nchr1\t1\t10\t+\tG\n")
    assert got(readers.read_auto(spark, interval), "chromosome", "start", "end", "gene") == [("chr1", 0, 10, "G")]
    text = file("c.txt", "chr1:11-20 G\n")
    assert got(readers.read_auto(spark, text), "chromosome", "start", "end", "gene") == [("chr1", 10, 20, "G")]
    gff = file("d.gff", "##gff-version 3\nchr1\tsrc\texon\t5\t9\t.\t+\t.\tName=abc;x=1\n")
    assert got(readers.read_auto(spark, gff), "chromosome", "start", "end", "gene") == [("chr1", 4, 9, "abc")]
    flat = file("e.txt", "G\tNM_1\tchr1\t+\t1\t100\t10\t90\t2\t1,50,\t20,100,\n")
    assert got(readers.read_refflat(spark, flat, exons=True), "start", "end", "gene") == [(0, 20, "G"), (49, 100, "G")]
    seg = file("f.seg", "ID\tchrom\tloc.start\tloc.end\tnum.mark\tseg.mean\ns1\t1\t1\t10\t3\t0.5\ns2\t1\t1\t10\t3\t-0.5\n")
    assert got(readers.read_seg(spark, seg, chrom_prefix="chr"), "sample_id", "chromosome", "start", "log2") == [("s1", "chr1", 0, 0.5)]
    vcf = file("g.vcf", "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tT\tN\nchr1\t10\t.\tA\tC,<NON_REF>\t.\tPASS\t.\tGT:AD:DP\t0/1:6,4:10\t0/0:9,0:9\n")
    row = readers.read_vcf(spark, vcf, "T", "N").first()
    assert (row["start"], row["end"], row["alt"], row["alt_freq"], row["zygosity"], row["n_zygosity"]) == (9, 10, "C", 0.4, 0.5, 0.0)
    fasta = file("h.fa", ">chr1 x\nNNACG\nTNNAc\n>chr2\nAC\n")
    assert got(readers.fasta_regions(spark, fasta)) == [("chr1", 2, 6), ("chr1", 8, 10), ("chr2", 0, 2)]
    writers.write_table(table(spark, [("chr2", 1, 2), ("chr1", 3, 4)]), f"{tmp_path}/out", "bed3")
    assert got(readers.read_bed3(spark, f"{tmp_path}/out")) == [("chr1", 3, 4), ("chr2", 1, 2)]
