"""Bins without signal (value 0, log-ratio minus infinity) and groups of many sizes: whole queries against their SQL, kernels against plain ones."""

import os
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera import catalog, catalog_more, catalog_order, catalog_sources  # noqa: E402, F401
from tessera.functions import kernels, stats  # noqa: E402
from tessera.operators import copynum, runs  # noqa: E402
from tessera.sources import readers, writers  # noqa: E402
from tessera.sources.views import log2  # noqa: E402

NAMES = (
    "agg_squash_genes", "agg_squash_runs", "fun_shift_sex_chroms", "gen_breaks", "gen_metrics", "gen_metrics_by_segment", "prj_shift_xx", "snk_jtv", "snk_nexus_basic", "src_import_picard",
    "src_auto", "sta_sex", "sta_weighted_median", "sta_segment_spreads", "win_drop_outliers", "win_flag_outliers", "win_residuals", "clu_samples", "agg_by_gene", "agg_filter_ampdel",
)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The tables of sf0.01 with a value of 0 in 5 of 10,000 bins, none near another of its chromosome."""
    out = str(tmp_path_factory.mktemp("empty"))
    db = duckdb.connect()
    for t in ("events", "orders", "lineitem", "nation", "part", "customer", "supplier"):
        what = "* REPLACE (CASE WHEN event_id%2000=777 THEN 0 ELSE value END AS value)" if t == "events" else "*"
        db.execute(f"COPY (SELECT {what} FROM '/root/testdata/sf0.01/{t}.parquet') TO '{out}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, folder, name, tmp_path):
    catalog.QUERIES[name](spark, folder).write.parquet(f"{tmp_path}/out")
    db = duckdb.connect()
    for t in ("events", "orders", "lineitem", "nation", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    db.execute(f"CREATE TABLE want AS {catalog.ORACLE_SQL[name]}")
    db.execute(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    columns = ",".join(f'"{r[0]}"' for r in db.execute("DESCRIBE want").fetchall())
    for a, b in (("want", "got"), ("got", "want")):
        assert db.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b} LIMIT 3").fetchall() == []


def test_logarithm_is_exact(spark):
    rows = spark.range(1, 2000).select(log2(F.lit(2.0) ** (F.col("id") % 40 - 20)).alias("x"), (F.col("id") % 40 - 20).cast("double").alias("y")).where("x <> y")
    assert rows.isEmpty()


def test_missing_values_of_samples(spark):
    """One bin without a value in each task took all of that task's sums away."""
    rows = spark.range(400).select(F.lit("chr1").alias("chromosome"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("s"))
    value = F.when(F.col("start") % 10 == 0, F.when(F.col("s") > 0, F.col("s") / 1)).otherwise(F.sin("start") + F.when(F.col("s") < 3, 0.0).otherwise(F.cos("start")) + 0.01 * F.sin(F.col("s") * 7 + F.col("start")))
    out = copynum.cluster_samples(rows.select("chromosome", "start", "end", F.concat(F.lit("s"), "s").alias("sample_id"), value.alias("log2")))
    assert [r["cluster"] for r in out.orderBy("sample_id").collect()] == [0, 0, 0, 1, 1, 1]


def test_densities_and_modes():
    rng = np.random.default_rng(3)
    for n in (2, 5, 300, 3000):
        a = np.sort(np.concatenate([rng.normal(size=n), rng.normal(40, 2, n // 5)]))
        width = a.std(ddof=1) * len(a) ** -0.2
        plain = np.array([np.exp(-0.5 * ((x - a) / width) ** 2).sum() for x in a])
        assert np.abs(stats.kernel_densities(a, width) / plain - 1).max() < 1e-12
        assert stats.modal_location(a) == a[plain.argmax()]
    big = rng.normal(size=400_000)  # the square of this took minutes
    assert abs(stats.modal_location(np.append(big, -np.inf))) < 0.3


def test_many_groups_at_once():
    rng = np.random.default_rng(4)
    arrays = [rng.normal(size=k) for k in rng.integers(1, 40, 300)] + [np.array([]), np.array([np.nan]), np.array([1.0, 1, 1, 9]), np.array([-np.inf, 1, 2, 3, 5])]
    for one, many in stats.MANY.items():
        np.testing.assert_allclose(many(arrays), [one(a) for a in arrays], rtol=1e-12)


def test_weighted_medians_of_runs(spark):
    rng = np.random.default_rng(5)
    n = 3000
    data = pd.DataFrame({"chromosome": "chr1", "start": np.arange(n) * 10, "end": np.arange(n) * 10 + 5, "level": np.arange(n) // rng.integers(1, 9), "cn": rng.integers(0, 6, n), "log2": 1.0, "weight": rng.integers(0, 4, n) / 2})
    got = {r["start"]: r["cn"] for r in runs.squash(spark.createDataFrame(data), ["level"]).collect()}
    want = {g["start"].min(): stats.weighted_median(g["cn"], g["weight"]) for _, g in data.groupby("level")}
    assert got == want


def test_outliers_beside_an_empty_bin():
    x = np.sin(np.arange(400.0))
    x[200] = -np.inf
    assert np.flatnonzero(kernels.rolling_outliers(x)).tolist() == [200]


def test_one_text_in_many_files(spark, tmp_path):
    """Tracks go on from file to file of a folder, whatever the sizes of the files; its first line tells its format."""
    parts = [["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS"], [f"chr1\t{i}\t.\tA\tG\t1\tPASS\tDP=9\tGT:AD:DP\t0/1:4,5:9" for i in range(1, 3000)]]
    bed = [["chr1\t1\t2\ta"], ['track name="one"', "chr1\t2\t3\tb"], ["chr1\t3\t4\tc"] * 500, ['track name="two"', "chr1\t4\t5\td"]]
    for name, texts in (("vcf", parts), ("bed", bed)):
        (tmp_path / name).mkdir()
        for i, lines in enumerate(texts):
            (tmp_path / name / f"part-{i:05d}.txt").write_text("\n".join(lines) + "\n")
    assert readers.sniff(spark, f"{tmp_path}/vcf") == "vcf"
    assert readers.read_auto(spark, f"{tmp_path}/vcf").count() == 2999
    tracks = readers.bed_tracks(spark, f"{tmp_path}/bed").groupBy("track", "track_no", "gene").count().collect()
    assert {tuple(r) for r in tracks} == {("DEFAULT", 0, "a", 1), ("one", 1, "b", 1), ("one", 1, "c", 500), ("two", 2, "d", 1)}


def test_blocks_of_a_long_file(spark, tmp_path):
    """A block does not grow with its split; tracks go on from block to block of one."""
    n, per = 300_000, 40_000
    text = "".join((f'track name="t{i // per}"\n' if i % per == 0 else "") + f"chr1\t{i}\t{i + 1}\n" for i in range(n))
    (tmp_path / "long.bed").write_text(text)
    rows = readers.lines(spark, f"{tmp_path}/long.bed").groupBy("_block").count().collect()
    assert sum(r["count"] for r in rows) == n + 8 and max(r["count"] for r in rows) <= 65_536
    tracks = readers.bed_tracks(spark, f"{tmp_path}/long.bed").groupBy("track", "track_no").agg(F.min("start").alias("a"), F.max("start").alias("z"), F.count("*").alias("n")).collect()
    assert {tuple(r) for r in tracks} == {(f"t{k}", k + 1, k * per, min(n, k * per + per) - 1, min(n, k * per + per) - k * per) for k in range(8)}


def test_median_of_a_chromosome_without_values(spark, tmp_path):
    """As in SQL, it has no row."""
    db = duckdb.connect()
    db.execute(f"COPY (SELECT * REPLACE (CASE WHEN user_id%24<>5 AND event_id%53<>7 THEN value END AS value) FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet'")
    for t in ("events", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path if t == 'events' else '/root/testdata/sf0.001'}/{t}.parquet'")
    want = db.execute(catalog.ORACLE_SQL["sta_weighted_median"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["sta_weighted_median"](spark, str(tmp_path)).collect())) == sorted(want) and len(want) > 5


def test_repeated_bins_of_samples(spark):
    """Repeats are rows of their own if all samples have them; else the samples do not have the same bins."""
    rows = [(s, "chr1", at, at + 5, "g", float(v + k)) for k, s in enumerate(("a", "b")) for at, v in ((0, 1), (0, 3), (9, 2))]
    frame = spark.createDataFrame(rows, "sample_id string, chromosome string, start long, end long, gene string, log2 double")
    assert sorted((r["Name"], r["a"], r["b"]) for r in writers.export_jtv(frame, ["a", "b"]).collect()) == [("chr1:0-5:g", 1.0, 2.0), ("chr1:0-5:g", 3.0, 4.0), ("chr1:9-14:g", 2.0, 3.0)]
    with pytest.raises(Exception, match="same bins"):
        writers.export_jtv(frame.where("NOT (sample_id = 'b' AND log2 = 4)"), ["a", "b"]).collect()


BINS = ("agg_squash_runs", "fun_shift_sex_chroms", "gen_breaks", "gen_metrics", "gen_metrics_by_segment", "prj_shift_xx", "snk_nexus_basic")


@pytest.fixture(scope="module")
def extremes(tmp_path_factory):
    """The tables of sf0.01 with values below 0 and near the largest and the smallest."""
    out = str(tmp_path_factory.mktemp("extremes"))
    odd = "CASE event_id%1000 WHEN 7 THEN 1.79e308 WHEN 207 THEN 5e-324 WHEN 407 THEN -0.5 WHEN 607 THEN -3 WHEN 807 THEN -0.0 ELSE value END"
    duckdb.execute(f"COPY (SELECT * REPLACE ({odd} AS value) FROM '/root/testdata/sf0.01/events.parquet') TO '{out}/events.parquet'")
    return out


@pytest.mark.parametrize("name", BINS)
def test_extreme_values_against_sql(spark, extremes, name, tmp_path):
    catalog.QUERIES[name](spark, extremes).write.parquet(f"{tmp_path}/out")
    db = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{extremes if t == 'events' else '/root/testdata/sf0.01'}/{t}.parquet'")
    db.execute(f"CREATE TABLE want AS {catalog.ORACLE_SQL[name]}")
    db.execute(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    text = ",".join(f"""replace(CAST("{r[0]}" AS VARCHAR), '-nan', 'nan')""" for r in db.execute("DESCRIBE want").fetchall())  # tells -0 from 0
    for a, b in (("want", "got"), ("got", "want")):
        assert db.execute(f"SELECT {text} FROM {a} EXCEPT ALL SELECT {text} FROM {b} LIMIT 3").fetchall() == []


def test_logarithm_of_extremes(spark):
    values = [0.0, -0.0, -1.0, 5e-324, 1.0, 2.0**1023, 1.79e308, float("inf"), float("nan"), None]
    got = [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", log2(F.col("v")).alias("x")).orderBy("i").collect()]
    want = [None if v is None else duckdb.execute("SELECT log2(?::DOUBLE)", [v]).fetchone()[0] for v in values]
    assert got[-1] is None and want[-1] is None
    np.testing.assert_allclose(got[:-1], want[:-1], rtol=1e-15)


@pytest.mark.parametrize("name", ("snk_nexus_basic", "prj_labels", "fun_shift_sex_chroms", "prj_shift_xx"))
def test_missing_chromosome_against_sql(spark, tmp_path, name):
    """A label has no place without a chromosome; it read null:1-null."""
    db = duckdb.connect()
    db.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id%10<>3 THEN user_id END AS user_id) FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet'")
    for t in ("events", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path if t == 'events' else '/root/testdata/sf0.001'}/{t}.parquet'")
    want = db.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in catalog.QUERIES[name](spark, str(tmp_path)).select(*columns).collect())


@pytest.fixture(scope="module")
def many_empty(spark, tmp_path_factory):
    """The tables of sf0.01 with a value of 0 in every eleventh bin: medians move."""
    out = str(tmp_path_factory.mktemp("many_empty"))
    db = duckdb.connect()
    db.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id%11=7 THEN 0 ELSE value END AS value) FROM '/root/testdata/sf0.01/events.parquet') TO '{out}/events.parquet'")
    for t in ("orders", "lineitem", "nation", "part"):
        db.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.01/{t}.parquet') TO '{out}/{t}.parquet'")
    return out


def test_weights_with_many_empty_bins(spark, many_empty, tmp_path):
    """The query's SQL takes empty bins into its medians; the reference leaves them out."""
    test_query_against_sql(spark, many_empty, "sta_apply_weights", tmp_path)


@pytest.mark.parametrize("name", ["win_drop_outliers", "win_flag_outliers"])
def test_outliers_where_empty_bins_are_near(spark, many_empty, tmp_path, name):
    """With several in a window the SQL's limit is no number, and it drops none."""
    test_query_against_sql(spark, many_empty, name, tmp_path)
