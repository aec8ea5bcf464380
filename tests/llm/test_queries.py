"""Whole queries on the smallest tables, against plain Python and SQL."""

import zlib

import brute
import duckdb
import pandas as pd
import pytest

from tessera.llm import decontaminate, queries, sharding
from tessera.llm.common import documents

SF = "/root/testdata/sf0.001"
NASTY = [
    None, "", "\n\n", "a b", "one two three one two three one two three", "Über Straße, nach Hause!\r\nKlick hier | weiter | zurück | Ende\n",
    "A real sentence stands here, quietly.\n" * 3 + "Home\n Home .\nread more\n", "copyright 2020 by nobody\nThis line ends well.", "x y. \nword\x0b \x0c and more…\n\t\n",
    "### title ###\nplain words without an end\n" + "Sentence with ﬁ ligature and 𝒳 sign.\n" * 12, "w " * 49 + "w.", "w1 w2 w3. " * 30,
]


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in documents(spark, SF).select("doc_id", "text").collect()}


def test_base_finds_of_secrets_and_personal_data(spark, texts):
    for name, find in (("op1_secret_scan", brute.secrets), ("op9_pii_scan", brute.pii)):
        rows = queries.QUERIES[name](spark, SF).collect()
        assert len(rows) == len(texts)
        for r in rows:
            want = find(texts[r["doc_id"]])
            assert tuple(r)[1 : 1 + len(want)] == want
            assert r["n_spans"] == (len(r["spans"].split(",")) if r["spans"] else 0)


def test_leaks_of_the_benchmark(spark, texts):
    items = [(r["item_id"], decontaminate.plain(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in queries.op2_decontaminate(spark, SF).collect()}
    for d, text in texts.items():
        plain = decontaminate.plain(text)
        for i, item in items:
            if item in plain:
                assert got[d, i] == 0
            elif (d, i) in got:
                assert decontaminate.myers(item, plain, decontaminate.budget(item))[0] == got[d, i] > 0


def test_shards(spark, texts):
    rows = sorted(queries.op7_histogram_shards(spark, SF).collect(), key=lambda r: (r["shard"], r["slot"]))
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    sizes = [0] * 8
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sizes[r["shard"]] += r["size"]
    assert [r["doc_id"] for r in rows] == sorted(texts)
    at = dict.fromkeys(range(8), 0)
    for r in rows:
        assert r["slot"] == at[r["shard"]]
        at[r["shard"]] += 1
    # each boundary is at the document nearest to its place
    ends, total = [0], sum(sizes)
    for r in rows:
        ends.append(ends[-1] + r["size"])
    cut = 0
    for s in range(1, 8):
        cut += sizes[s - 1]
        assert abs(cut - total * s / 8) <= min(abs(e - total * s / 8) for e in ends) + total / 64000 + 1


def test_shards_of_many_ranges_and_clashing_names(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(sharding, "RANGE_ROWS", 3)
    rows = [(None if i % 97 == 0 else 7 if i % 3 == 0 else i * 1_000_003, 1 + i % 50, i, "clash") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, n long, slot int, shard string").repartition(3)
    out = sharding.histogram_shard(df, "doc_id", F.col("n"), F.xxhash64("n")).collect()
    sizes, keys, slots = [0] * 8, [[] for _ in range(8)], [[] for _ in range(8)]
    for r in sorted(out, key=lambda r: (r["shard"], r["slot"])):
        sizes[r["shard"]] += r["size"]
        keys[r["shard"]].append(-(1 << 63) if r["doc_id"] is None else r["doc_id"])
        slots[r["shard"]].append(r["slot"])
    assert max(sizes) - min(sizes) <= 102 and len(out) == 1500
    assert sum(keys, []) == sorted(sum(keys, [])) and all(s == list(range(len(s))) for s in slots)


@pytest.mark.parametrize(("giants", "want"), [
    ([], [100] * 8), ([(300, 200)], None), ([(0, 800)], None), ([(10, 400), (410, 300)], None),
])
def test_aims_of_shards(giants, want):
    places = sharding.aims(800, 8, giants)
    assert len(places) == 9 and places[0] == 0 and places[-1] == 800 and places == sorted(places)
    if not giants:
        assert [b - a for a, b in zip(places, places[1:])] == want
    for before, size in giants:  # a shard of its own, but for a stretch too small for one
        assert any(abs(a - before) <= 10 and b - a >= size for a, b in zip(places, places[1:]))


def test_a_row_larger_than_a_shard(spark):
    from pyspark.sql import functions as F

    rows = [(i, 5_000_000 if i == 700 else 4500) for i in range(2000)]
    out = sharding.histogram_shard(spark.createDataFrame(rows, "doc_id long, n long").repartition(3), "doc_id", F.col("n"), F.xxhash64("n")).collect()
    sizes = [sum(r["size"] for r in out if r["shard"] == s) for s in range(8)]
    others = sorted(sizes)[:-1]
    assert sum(sizes) == 5_000_000 + 1999 * 4500 and max(sizes) < 5_050_000 and max(others) < 1.4 * min(others)  # shards are stretches of keys, so 3 and 4 of them share what is before and after


@pytest.mark.parametrize("bounds", [1, 64, 1023])
def test_bounds_are_found_in_compiled_code(spark, bounds):
    import bisect

    from pyspark.sql import functions as F

    rng = __import__("random").Random(bounds)
    edges = sorted((rng.randrange(50), rng.choice([-(1 << 63), 0, rng.randrange(9)]), rng.randrange(-3, 3)) for _ in range(bounds))
    rows = [(rng.randrange(-1, 51), rng.randrange(-1, 9), rng.randrange(-4, 4)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(2)
    out = df.withColumn("n", sharding.at_or_below(edges, [F.col(c) for c in "abc"]))
    assert all(r["n"] == bisect.bisect_right(edges, (r["a"], r["b"], r["c"])) for r in out.collect())
    code = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "codegen")
    assert "Generated code" in code and max(map(len, code.split("/* 001 */"))) < 65536


@pytest.mark.parametrize("rows", ["table", "nasty"])
def test_quality_rules_against_sql(spark, rows, tmp_path):
    folder = SF
    if rows == "nasty":
        folder = str(tmp_path)
        frame = pd.DataFrame({"doc_id": pd.array([*range(len(NASTY)), 4, None], dtype="Int64"), "text": [*NASTY, NASTY[4], NASTY[6]]})
        frame.to_parquet(f"{folder}/documents.parquet")
    got = queries.op10_quality_rules(spark, folder).toPandas()
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    want = base.execute(queries.ORACLE_SQL["op10_quality_rules"]).df()
    plain = lambda df: sorted(tuple(str(v) for v in r) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns)
    assert [[x.removesuffix(".0") for x in r] for r in plain(got)] == [[x.removesuffix(".0") for x in r] for r in plain(want)]
