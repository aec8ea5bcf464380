"""Importance resampling and the audit of sources, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tessera.llm import automaton, importance, queries, source_audit

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeABé9ß") for _ in range(rng.randint(1, 8))) for _ in range(120)]
    out = [rng.choice([" ", ", ", "\n"]).join(rng.choice(words[: rng.choice([10, 120])]) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return out + [None, "", "--", "x" * 5000 + " y", "y" * 70, "ab " * 3000, "日本語の文 Ünï ÜNÏ", "a\x00b\x7fc\x80d"]


def features(text):
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    return w, [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


@pytest.mark.parametrize("stretch", [5, 64, 1 << 20])
def test_features_of_buffers(monkeypatch, stretch):
    monkeypatch.setattr(automaton, "STRETCH", stretch)
    rows = texts(1, 60)
    rows = ["joined"] + rows + ["tail", "tail"]
    got, singles = [], 0
    array = pa.concat_arrays([pa.array(["cut", "off"]), pa.array(rows)])[2:]
    for row, bucket, single in importance.feature_buckets(array):
        got += zip(row.tolist(), bucket.tolist())
        singles += single
    assert sorted(got) == sorted((i, b) for i, t in enumerate(rows) for b in features(t)[1])
    assert singles == sum(len(features(t)[0]) for t in rows)


def drawn(rows, target):
    """doc_id, n_features, weight, score, rank, by plain Python."""
    count = lambda texts: Counter(b for t in texts for b in features(t)[1])
    s, t = count([r[1] for r in rows]), count(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for d, text, *_ in rows:
        w, own = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in own]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    order = sorted((i for i, r in enumerate(out) if r[4] >= 20), key=lambda i: (-out[i][3], out[i][0] is not None, out[i][0] or 0, out[i][2], out[i][1]))
    rank = {i: k + 1 for k, i in enumerate(order[: 25 * len(order) // 100])}
    return [(*r[:4], rank.get(i)) for i, r in enumerate(out)]


def test_resampling_against_plain_python(spark):
    rows = [(None if i % 40 == 7 else i, t, "given", i) for i, t in enumerate(texts(2, 200))]
    rows += [rows[11]] * 5
    target = texts(3, 20)
    df = spark.createDataFrame(rows, "doc_id long, text string, _part string, place int").repartition(3)
    out = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert out.columns == ["doc_id", "_part", "place", *importance.RESULTS]
    got = sorted(str((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"])) for r in out.collect())
    assert got == sorted(map(str, drawn(rows, target))) and {r["_part"] for r in out.collect()} == {"given"}


def test_resampling_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert importance.resample(none, some).collect() == []
    assert sorted((r["doc_id"], r["n_features"], r["rank"]) for r in importance.resample(some, none).collect()) == [(1, 3, None), (2, 0, None)]


@pytest.mark.parametrize("deep", [2, 32])
def test_trie_walks_in_byte_order(monkeypatch, deep):
    monkeypatch.setattr(source_audit, "DEEP", deep)
    rng = random.Random(4)
    trie, known = source_audit.Trie(), {}
    for _ in range(6):
        terms = sorted({bytes(rng.choice(b"ab\xc3\xff") for _ in range(rng.randint(1, 7))) for _ in range(300)}, key=lambda _: rng.random()) + [b"a" * 40]
        for term, leaf in zip(terms, trie.add(pa.array([b"cut", *terms], pa.large_binary())[1:]).tolist()):
            assert known.setdefault(term, leaf) == leaf
    walked, leaves = trie.walk()
    assert walked.to_pylist() == sorted(known) and dict(zip(walked.to_pylist(), leaves.tolist())) == known
    assert sorted(known.values()) == list(range(len(known)))


def audited(rows):
    """lang, source, part, item, value, rank, by plain Python."""
    n, documents, groups = Counter(), Counter(), defaultdict(set)
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", TERM.findall((text or "").translate(ASCII_LOWER))
        groups[lang].add(source)
        n.update((lang, source, t) for t in found)
        documents.update((lang, t) for t in set(found))
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for (g, t), k in documents.items() if g == lang and k >= 10), key=str.encode)
        total = {s: sum(n[lang, s, t] for t in kept) for s in sources}
        whole = sum(total.values())
        share = lambda count, of: 1 + 10**9 * (count + 2) // (of + 2 * len(kept))
        far = lambda p, q: (p - q) ** 2 // (p + q)
        for a in sources:
            p = {t: share(n[lang, a, t], total[a]) for t in kept}
            pairs = [(-sum(far(p[t], share(n[lang, b, t], total[b])) for t in kept), b) for b in sources if b != a]
            q = {t: share(sum(n[lang, s, t] for s in sources), whole) for t in kept}
            own = [(-far(p[t], q[t]), t) for t in kept if n[lang, a, t] and p[t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", own, 10)):
                ordered = sorted(items, key=lambda x: (x[0], x[1].encode()))[:most]
                out += [(lang, a, part, item, -value, k + 1) for k, (value, item) in enumerate(ordered)]
    return out


def labelled(seed, n):
    rng = random.Random(seed)
    rows = []
    for t in texts(seed, n):
        source = rng.choice(["s1", "s1", "s1", "s2", "s3", "", None, "ß"])
        rows.append((rng.choice(["en", "en", "de", None]), source, f"{t or ''} only{ord((source or 'x')[0])}" if t and rng.random() < 0.6 else t))
    return rows + [("xx", "s1", "rare words"), ("xx", "s2", None), ("yy", "alone", "one source"), ("en", "empty", "")] + [rows[3]] * 12


@pytest.mark.parametrize("most", [3, 200_000])
def test_audit_against_plain_python(spark, monkeypatch, most):
    monkeypatch.setattr(source_audit, "MOST_LEAVES", most)
    monkeypatch.setattr(source_audit, "BLOCK", 50 if most == 3 else 1 << 21)
    monkeypatch.setattr(automaton, "STRETCH", 200 if most == 3 else 1 << 20)
    rows = labelled(6, 400)
    df = spark.createDataFrame([(*r, 1, "given") for r in rows], "lang string, source string, text string, term int, documents string").repartition(4)
    got = [tuple(r) for r in source_audit.audit(df).select("lang", "source", "part", "item", "value", "rank").collect()]
    want = audited(rows)
    assert sorted(got) == sorted(want) and sum(r[2] == "term" for r in want) > 30
    assert source_audit.audit(df.limit(0)).collect() == []


def test_shares_beyond_a_long():
    counts = np.array([0, 10**10, 3 * 10**12], dtype=np.int64)
    assert source_audit.shares(counts, 7 * 10**12).tolist() == [1 + 10**9 * (int(c) + 2) // (7 * 10**12) for c in counts]


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_source_divergence"])
def test_queries_against_sql(spark, tmp_path, name):
    rows = labelled(8, 300)
    frame = pd.DataFrame({"doc_id": pd.array([None if i == 9 else i for i in range(len(rows))], dtype="Int64"), **dict(zip(("lang", "source", "text"), zip(*rows)))})
    frame.to_parquet(f"{tmp_path}/documents.parquet")
    pd.DataFrame({"item_id": range(10), "text": texts(9, 2)}).to_parquet(f"{tmp_path}/benchmark.parquet")
    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        out = queries.QUERIES[name](spark, folder)
        base = duckdb.connect()
        for t in ("documents", "benchmark"):
            base.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
        want = base.execute(queries.ORACLE_SQL[name])
        assert [c[0] for c in want.description] == out.columns
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want.fetchall()))
