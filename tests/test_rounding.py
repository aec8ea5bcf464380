"""Numbers rounded as in SQL, down to the sign of 0: whole queries against their SQL, compared as text."""

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera import catalog, catalog_more, catalog_order, catalog_sources  # noqa: E402, F401
from tessera.sources.views import rounded  # noqa: E402

TABLES = ("events", "orders", "lineitem", "nation", "part")
#: The bin's or order's value in tables made of sf0.01.
MADE = {
    "halves": ("events", "value", "CASE WHEN event_id%7=0 THEN 40.58 WHEN event_id%7=1 THEN 11.07 ELSE value END"),
    "near_mean": ("events", "value", "10+(event_id%2)*0.0002::DOUBLE"),
    "near_one": ("orders", "o_totalprice", "CASE WHEN o_custkey%24=23 THEN 99999 ELSE o_totalprice END"),
    "near_center": ("events", "value", "10+CAST(event_id%3>0 AS INTEGER)*0.000001::DOUBLE"),
    "near_64": ("events", "value", "CASE WHEN event_id%7=0 THEN 63.99999 WHEN event_id%7=1 THEN 0.9999999 WHEN event_id%7=2 THEN 0.4999999 ELSE value END"),
}


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    out = {}
    for name, (table, column, value) in MADE.items():
        out[name] = str(tmp_path_factory.mktemp(name))
        for t in TABLES:
            what = f"* REPLACE ({value} AS {column})" if t == table else "*"
            duckdb.execute(f"COPY (SELECT {what} FROM '/root/testdata/sf0.01/{t}.parquet') TO '{out[name]}/{t}.parquet'")
    return out


def same_text(spark, folder, name, tmp_path):
    catalog.QUERIES[name](spark, folder).write.parquet(f"{tmp_path}/out")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    db.execute(f"CREATE TABLE want AS {catalog.ORACLE_SQL[name]}")
    db.execute(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    columns = ",".join(f'CAST("{r[0]}" AS VARCHAR)' for r in db.execute("DESCRIBE want").fetchall())
    for a, b in (("want", "got"), ("got", "want")):
        assert db.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b} LIMIT 3").fetchall() == []


def test_rounded_as_in_sql(spark):
    numbers = [0.02405, 0.08285, -0.02405, 2.5e-6, -2.4e-5, 1e-9, -1e-9, -0.0, 0.0, 5.1234565, 1e20, -1.79e308, float("inf"), float("-inf"), float("nan"), None]
    for digits in (3, 4, 6):
        got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").orderBy("i").select(rounded(F.col("x"), digits)).collect()]
        want = [duckdb.execute(f"SELECT round(CAST(? AS DOUBLE),{digits})", [x]).fetchone()[0] for x in numbers]
        assert list(map(repr, got)) == list(map(repr, want))


def test_table_with_halves(spark, made, tmp_path):
    same_text(spark, made["halves"], "src_tab", tmp_path)


def test_ratios_near_the_mean(spark, made, tmp_path):
    """Log-ratios that round to a negative 0."""
    same_text(spark, made["near_mean"], "src_import_picard", tmp_path)


def test_calls_near_one(spark, made, tmp_path):
    same_text(spark, made["near_one"], "snk_vcf", tmp_path)


@pytest.mark.parametrize("name", ["agg_squash_runs", "fun_shift_sex_chroms", "prj_shift_xx", "rng_match_reference", "snk_jtv", "snk_nexus_basic"])
def test_values_near_powers_of_two(spark, made, tmp_path, name):
    same_text(spark, made["near_64"], name, tmp_path)


@pytest.mark.parametrize("name", ["sta_center_all", "sta_center_median"])
def test_values_near_the_center(spark, made, tmp_path, name):
    same_text(spark, made["near_center"], name, tmp_path)
