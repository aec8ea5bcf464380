"""Lines of many documents: the operator and its query against plain Python, and SQL."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup, queries

SPACE = " \t\n\x0b\f\r"


def plain(texts, least=10):
    """(lines before, lines dropped, kept text) of each text."""
    keys = [[k.strip(SPACE).translate({c: c + 32 for c in range(65, 91)}) for k in (t or "").split("\n")] for t in texts]
    held = Counter(k for own in keys for k in set(own))
    out = []
    for t, own in zip(texts, keys):
        stays = [line for line, k in zip((t or "").split("\n"), own) if not k or held[k] < least]
        out.append((len(own), len(own) - len(stays), "\n".join(stays)))
    return out


def corpus():
    rng = random.Random(5)
    lines = ["Read More", " read more\t", "READ MORE\x0b", "", "  ", "Über uns", "über uns", "ÜBER UNS", "a ", "x" * 300, "x" * 299 + "y", "\r", "ŐŰ", "KK"]
    lines += [f"line {i}" for i in range(60)]
    texts = ["\n".join(rng.choice(lines[: rng.choice([9, 14, 74])]) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    # a key at nine documents, one at ten, one often in a single document
    texts = [t + "\nnine" if i < 9 else t + "\nTen " if i < 19 else t for i, t in enumerate(texts)]
    texts += [None, "", "\n", "own line\n" * 5000 + "read more\n" * 200 + "end", "\n".join(f"only {i}" for i in range(700))]
    return [(None if i % 50 == 3 else i // 2 if i % 7 == 0 else i, t, "given", i, 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("sample", [1_000_000, 600, 20])
def test_common_lines_against_plain_python(spark, monkeypatch, sample):
    monkeypatch.setattr(line_dedup, "SAMPLE", sample)
    rows = corpus()
    rows += [rows[5]] * 12  # repeated rows are documents of their own
    df = spark.createDataFrame(rows, "doc_id long, text string, h1 string, row int, n_dropped int").repartition(5)
    out = line_dedup.drop_common_lines(df)
    assert out.columns == ["doc_id", "text", "h1", "row", "n_dropped", "n_lines"]
    got = sorted((str(r["doc_id"]), r["row"], r["h1"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in out.collect())
    want = sorted((str(r[0]), r[3], r[2], *w) for r, w in zip(rows, plain([r[1] for r in rows])))
    assert got == want and any(g[4] for g in got) and any(g[3] > g[4] > 100 for g in got)


def test_bitmaps_hold_only_words_that_lose_lines(spark):
    texts = ["\n".join(f"own {i} {k}" for k in range(500)) + "\nshared\n" + f"tail {i}" for i in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = line_dedup.keep_bitmaps(df).collect()
    assert sorted(r["doc"] for r in rows) == list(range(10))
    assert all([(w["word"], w["kept"]) for w in r["words"]] == [(500 // 64, ~(1 << 500 % 64))] for r in rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.drop_common_lines(df).collect() == []


def test_lower_case_of_every_character(spark):
    df = spark.range(0x110000).where("id < 55296 or id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    key = line_dedup.line_key(F.concat(F.lit("x"), "c", F.lit("x")))
    wrong = df.where(key != F.concat(F.lit("x"), F.when(F.col("id").between(65, 90), F.lower("c")).otherwise(F.col("c")), F.lit("x")))
    assert [r["id"] for r in wrong.collect()] == []


@pytest.mark.parametrize("rows", ["table", "made"])
def test_query_against_sql(spark, tmp_path, rows):
    folder = "/root/testdata/sf0.001"
    if rows == "made":
        folder = str(tmp_path)
        made = corpus()
        pd.DataFrame({"doc_id": pd.array([r[0] for r in made], dtype="Int64"), "text": [r[1] for r in made]}).to_parquet(f"{folder}/documents.parquet")
    got = sorted(map(str, map(tuple, queries.op13_line_dedup(spark, folder).collect())))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    assert got == sorted(map(str, base.execute(queries.ORACLE_SQL["op13_line_dedup"]).fetchall()))
    if rows == "made":
        want = plain([r[1] for r in made])
        assert got == sorted(str((r[0], n, gone, hashlib.sha256(t.encode()).hexdigest())) for r, (n, gone, t) in zip(made, want))
