"""BAM files: splits anywhere, regions by index, damaged files."""

import random

import numpy as np
import pandas as pd
import pytest
from pyarrow import fs

from tessera.sources import bam

REFERENCES = [("chr1", 1 << 28), ("chr2", 1 << 20), ("chrM", 16_000)]


@pytest.fixture(scope="module")
def reads(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        chromosome = rng.choice(["chr1", "chr1", "chr2", None])
        cigar = "*" if chromosome is None else f"{rng.randint(1, 90)}M{rng.randint(1, 9)}I{rng.randint(1, 5000)}N{rng.randint(1, 60)}M"
        rows.append((f"read{i}", 4 if chromosome is None else rng.choice([0, 16, 256, 1024]), chromosome, -1 if chromosome is None else rng.randrange(900_000), rng.randrange(60), cigar))
    rows.append(("long", 0, "chr1", 77, 9, "1M1D" * 30_000))  # more than a block
    folder = str(tmp_path_factory.mktemp("bam"))
    written = bam.write_bam(spark.createDataFrame(rows, "name string, flag int, chromosome string, pos long, mapq int, cigar string"), folder, REFERENCES, 3000).collect()
    assert sum(r["reads"] for r in written) == len(rows)
    return folder, rows


def facts(rows):
    return sorted((str(r["name"]), r["flag"], str(r["chromosome"]), r["pos"], r["mapq"], r["cigar"]) for r in rows)


def wanted(rows):
    return sorted((n, f, str(c), p, m, g) for n, f, c, p, m, g in rows)


@pytest.mark.parametrize("split", [700, 5000, 1 << 25])
def test_each_read_is_in_one_split(spark, reads, split):
    folder, rows = reads
    out = bam.read_bam(spark, folder, split_bytes=split)
    assert facts(out.collect()) == wanted(rows) and (split > 5000 or out.rdd.getNumPartitions() > 10)
    one = next(r for r in out.where("name = 'long'").collect())
    assert one["aligned_len"] == 60_000 and one["query_len"] == 30_000


def test_a_region_reads_its_blocks(spark, reads, monkeypatch):
    folder, rows = reads
    out = bam.read_bam(spark, folder, "chr2:300,001-301,000").collect()

    def length(cigar):
        import re

        return sum(int(n) for n, s in re.findall(r"(\d+)([MIDN])", cigar) if s != "I")

    want = [r for r in rows if r[2] == "chr2" and r[3] < 301_000 and r[3] + length(r[5]) > 300_000]
    assert facts(out) == wanted(want) and want
    reader = bam.BamReader({"path": folder, "region": "chr2:300,001-301,000"})
    touched = sum(max(s.end - s.begin, 0) + 3000 for s in reader.partitions())
    whole = sum(f.size for f in fs.LocalFileSystem().get_file_info(fs.FileSelector(folder)) if f.path.endswith(".bam"))
    assert 0 < touched < whole / 4
    assert bam.read_bam(spark, folder, "chrM").collect() == [] and bam.read_bam(spark, folder, "chr9").collect() == []


def test_bins_hold_their_reads():
    rng = random.Random(1)
    for _ in range(500):
        start = rng.randrange(1 << 29)
        end = min(start + rng.choice([1, 100, 20_000, 5_000_000]), 1 << 29)
        at = rng.randrange(start, end)
        assert bam.bin_of(start, end) in bam.bins_of(at, at + 1)
    assert bam.bin_of(0, 1 << 14) == 4681 and bam.bin_of(0, 1 << 29) == 0 and len(bam.bins_of(0, 1)) == 6


def test_regions_as_text():
    assert bam.parse_region("chr1") == ("chr1", 0, 1 << 29) and bam.parse_region("HLA:A:1,001-2,000") == ("HLA:A", 1000, 2000)


def test_a_file_cut_short_fails(reads, tmp_path):
    folder, _ = reads
    path = sorted(f.path for f in fs.LocalFileSystem().get_file_info(fs.FileSelector(folder)) if f.path.endswith(".bam"))[0]
    with open(path, "rb") as f:
        data = f.read()
    cut = tmp_path / "cut.bam"
    cut.write_bytes(data[: len(data) * 2 // 3])
    reader = bam.BamReader({"path": str(cut)})
    with pytest.raises(ValueError):
        for split in reader.partitions():
            list(reader.read(split))
    damaged = bytearray(data)
    damaged[len(data) // 2] ^= 0xFF
    cut.write_bytes(bytes(damaged))
    with pytest.raises((ValueError, Exception)):
        for split in bam.BamReader({"path": str(cut)}).partitions():
            list(bam.BamReader({"path": str(cut)}).read(split))


def test_no_reads(spark, tmp_path):
    none = spark.createDataFrame([], "name string, flag int, chromosome string, pos long, mapq int, cigar string")
    assert bam.write_bam(none, str(tmp_path / "none"), REFERENCES).collect() == []
    assert bam.read_bam(spark, str(tmp_path / "none")).collect() == []


def test_the_index_does_not_grow_with_the_reads():
    """A task kept a list of five numbers for each read of its file."""
    index, n = bam.Index(2), 1000
    for k in range(300):  # blocks of a thousand reads in one bin, each third one across its end
        start = np.arange(n) // 3 + 16_000 + np.arange(n) % 3 // 2 * 380
        begin = k << 16 | np.arange(n) * 50
        index.add(np.full(n, 1), start, start + 10, begin, np.append(begin[1:], (k + 1) << 16))
    bins, windows = index.of[1]
    assert index.of[0] == ({}, {}) and sum(len(c) for c in bins.values()) < 700 and len(windows) <= 2
    assert min(c[0][0] for c in bins.values()) == 0 and max(c[-1][1] for c in bins.values()) == 300 << 16


def test_places_far_out(spark, tmp_path):
    """A read over the border of the largest bins is in the first one, and a place that the format cannot hold fails."""
    rows = [("a", 0, "chr1", (1 << 29) - 5, 9, "10M"), ("b", 0, "chr1", (1 << 29) + (1 << 26) - 5, 9, "10M"), ("c", 0, "chr1", 1_500_000_000, 9, "10M")]
    schema = "name string, flag int, chromosome string, pos long, mapq int, cigar string"
    bam.write_bam(spark.createDataFrame(rows, schema), str(tmp_path / "far"), [("chr1", 2_000_000_000)]).collect()
    for name, _, _, pos, _, _ in rows:
        assert [r["name"] for r in bam.read_bam(spark, str(tmp_path / "far"), f"chr1:{pos + 8}-{pos + 9}").collect()] == [name]
    with pytest.raises(ValueError, match="pos"):
        bam.encode(pd.DataFrame([("d", 0, 0, 1 << 31, 9, "10M")], columns=["name", "flag", "_ref", "pos", "mapq", "cigar"]))


def test_references_beyond_the_format(spark, tmp_path):
    """Reads at places that no record can hold ended the job; they go into pieces of their reference and come back."""
    places = [0, (1 << 29) - 5, 1 << 29, (1 << 31) - 3, 1 << 31, 3_780_000_000, 4_999_999_990]
    rows = [(f"{chr(97 + i)}{c}", 0, c, p, 9, "10M") for i, p in enumerate(places) for c in ("chr1", "chr3")] + [("x", 0, "chr2", 7, 9, "10M"), ("u", 4, None, -1, 0, "*")]
    schema = "name string, flag int, chromosome string, pos long, mapq int, cigar string"
    folder = str(tmp_path / "beyond")
    bam.write_bam(spark.createDataFrame(rows, schema), folder, [("chr1", 5_000_000_000), ("chr2", 100), ("chr3", 5_000_000_000)]).collect()
    got = bam.read_bam(spark, folder).select("name", "chromosome", "pos").collect()
    assert sorted(map(tuple, got)) == sorted((r[0], r[2], r[3]) for r in rows)
    for _, _, chromosome, pos, _, _ in rows[:-2]:  # some end in the next piece, where another begins
        met = sorted(r[0] for r in rows if r[2] == chromosome and pos - 3 < r[3] < pos + 9)
        assert sorted(r["name"] for r in bam.read_bam(spark, folder, f"{chromosome}:{pos + 8}-{pos + 9}").collect()) == met
    assert bam.read_bam(spark, folder, "chr1").count() == len(places) and bam.read_bam(spark, folder, "chr3:2,000,000,000").count() == 4


@pytest.mark.parametrize("name", ["src_bam", "src_bam_region", "src_bam_region_bases"])
def test_queries_beyond_the_format(spark, tmp_path, name):
    import duckdb

    from tessera import catalog, catalog_order  # noqa: F401

    db = duckdb.connect()
    for t, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        db.execute(f"COPY (SELECT * REPLACE ({key}+{key}%2*54000000 AS {key}) FROM '/root/testdata/sf0.001/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    db.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    catalog.QUERIES[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    columns = ",".join(f'"{r[0]}"' for r in db.execute(f"DESCRIBE {catalog.ORACLE_SQL[name]}").fetchall())
    got, want = f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'", f"SELECT {columns} FROM ({catalog.ORACLE_SQL[name]})"
    for a, b in ((got, want), (want, got)):
        assert db.execute(f"{a} EXCEPT ALL {b}").fetchall() == []
