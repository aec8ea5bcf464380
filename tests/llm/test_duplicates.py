import hashlib
import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontaminate, near_dedup, quality_model, repeats

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def edited(text, share):
    return " ".join(RNG.choice(WORDS) if RNG.random() < share else w for w in text.split(" "))


def test_signatures_estimate_weighted_similarity():
    a, b = np.arange(400), np.arange(100, 500)
    wa, wb = 1 + a % 5, 1 + b % 3
    both = sum(min(1 + x % 5, 1 + x % 3) for x in range(100, 400))
    true = both / (wa.sum() + wb.sum() - both)
    element = np.concatenate([near_dedup.mix(a.astype(np.uint64)), near_dedup.mix(b.astype(np.uint64))])
    sig = near_dedup.signatures(np.repeat([0, 1], 400), element, np.concatenate([wa, wb]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.035


def test_shingles_of_short_texts():
    h, before = near_dedup.shingles(pa.array(["a b c d e f", "a b", None, "", "a b", " a  b\n"]))
    assert np.diff(before).tolist() == [2, 1, 0, 0, 1, 1]
    assert h[before[1]] == h[before[4]] == h[before[5]]


def corpus():
    base = [prose(RNG.randint(30, 120)) for _ in range(40)]
    texts = base + [edited(t, 0.01) for t in base[:15]] + base[:10] + [edited(base[0], 0.012) for _ in range(25)] + [None, "", "one two", "one two"]
    return list(enumerate(texts))


def expected_classes(rows):
    bags = {i: near_dedup.multiset(*near_dedup.shingles(pa.array([t], pa.string())))[1:] for i, t in rows}
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, _ in rows:
        for j in range(i):
            if len(bags[i][0]) and brute.similarity(bags[i], bags[j]) >= 0.8:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in rows}


def test_near_duplicate_classes(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, class_id int").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(df).collect()}
    assert got == expected_classes(rows)
    kept = {r["doc_id"] for r in near_dedup.deduplicate(df).collect()}
    assert kept == set(got.values())
    assert near_dedup.classes(df.limit(0)).count() == 0


def test_signatures_do_not_depend_on_the_stretch(monkeypatch):
    doc, element = np.repeat([0, 1, 2], [300, 5, 700]), near_dedup.mix(np.arange(1005, dtype=np.uint64))
    weight = 1 + np.arange(1005) % 9
    whole = near_dedup.signatures(doc, element, weight, 4)
    monkeypatch.setattr(near_dedup, "STRETCH", 64)
    assert np.array_equal(whole, near_dedup.signatures(doc, element, weight, 4)) and np.isinf(whole[3]).all()


def test_a_family_of_near_copies(spark, monkeypatch):
    rng = random.Random(8)
    base = [rng.choice(WORDS) for _ in range(90)]
    rows = []
    for i in range(700):  # similar to some of the family only: many classes meet in its buckets
        words = list(base)
        for k in rng.sample(range(90), rng.choice([1, 2, 3, 4])):
            words[k] = rng.choice(WORDS)
        rows.append((i, " ".join(words)))
    rows += [(i, rows[i % 700][1]) for i in range(700, 900)]
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    monkeypatch.setattr(near_dedup, "UNIT", 64)
    seen = []
    real = near_dedup.linked

    def counted(units, least):
        out = real(units, least)
        seen.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "linked", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(df).collect()}
    assert got == expected_classes(rows)
    assert len(seen) == 2 and max(seen) <= 4 * 900  # a forest from each task


def test_a_very_long_text_and_hot_words(spark):
    long = " ".join(RNG.choice(WORDS) for _ in range(150_000))
    rows = [(1, long), (2, long + " more"), (3, "the " * 60_000), (4, "the " * 60_000 + "end"), (5, prose(40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_null_ids_take_no_links(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice(WORDS) for _ in range(60))
    near = [" ".join([*text.split(" ")[:-1], w]) for w in ("one", "two")]
    rows = [(None, text), (4, text), (6, text), (None, text), (8, near[0]), (9, near[1]), (None, "only here, without an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"] or -1, r["class_id"] or -1) for r in near_dedup.classes(df).collect())
    assert got == [(-1, -1)] * 3 + [(4, 4), (6, 4), (8, 4), (9, 4)]
    assert sorted(r["doc_id"] or -1 for r in near_dedup.deduplicate(df).collect()) == [-1, -1, -1, 4]


def test_repeated_ids_with_different_texts(spark):
    rng = random.Random(4)
    a, b = (" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(2))
    rows = [(5, a), (5, b), (5, b), (7, a + " more"), (9, b + " more"), (3, b + " less")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["class_id"]) for r in near_dedup.classes(df).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (5, 5), (7, 5), (9, 3)]
    assert sorted((r["doc_id"], r["text"]) for r in near_dedup.deduplicate(df).collect()) == [(3, b + " less"), (5, a)]


def test_repeats_match_brute_force(spark):
    shared = [prose(12), "é" * 60, "\x00" * 70, "ab" * 40]
    texts = [prose(25) for _ in range(6)]
    texts += [prose(5) + " " + RNG.choice(shared) + " " + prose(6) for _ in range(14)] + [texts[0], texts[1][10:90], None, "", "x" * 49, "x" * 49, "x" * 50, "x" * 120, "y" + "x" * 51]
    docs = [(i, (t or "").encode()) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, b"z") for i, t in enumerate(texts)], "doc_id long, text string, kept binary").repartition(4)
    got = {r["doc_id"]: r for r in repeats.removed_runs(df).collect()}
    for (i, raw), (_, cover) in zip(docs, brute.substring_cover(docs, 50)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"]) == (len(raw), sum(cover))
        assert r["n_spans"] == sum(1 for k, c in enumerate(cover) if c and (k == 0 or not cover[k - 1]))
        assert hashlib.sha256(bytes(r["kept"])).digest() == hashlib.sha256(bytes(b for b, c in zip(raw, cover) if not c)).digest()
    assert repeats.removed_runs(df.limit(0)).count() == 0


def test_repeats_with_doubled_ids(spark):
    text = prose(30)
    df = spark.createDataFrame([(5, text), (5, text), (7, text), (None, "other " + text)], "doc_id long, text string")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_removed"]) for r in repeats.removed_runs(df).collect())
    n = len(text)
    assert got == [(-1, 0), (5, n), (5, n), (7, n)]


def test_myers_against_the_table():
    def table(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    for _ in range(200):
        p = "".join(RNG.choice("abc") for _ in range(RNG.randint(1, 14)))
        t = "".join(RNG.choice("abc") for _ in range(RNG.randint(1, 30)))
        assert decontaminate.myers(p, t, 99)[0] == table(p, t)


def test_leaks(spark):
    items = [(1, prose(30)), (2, prose(40)), (3, None), (4, "")]
    near = items[1][1][:50] + "Q" + items[1][1][51:120] + items[1][1][122:]
    rows = [(1, f"start {items[0][1].upper()} end"), (2, f"{prose(20)}\n{near}"), (3, prose(60)), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 1): 0, (2, 2): 3}
    assert {r["doc_id"] for r in decontaminate.remove_leaks(docs, bench).collect()} == {3, 4, 5}
    assert decontaminate.leaks(docs.limit(0), bench).count() == decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_leaks_match_brute_force(spark):
    def table(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(rng.randint(1, 14))) for i in range(12)] + [(None, "an item without an id, and some words"), (5, "second item of one id, long enough")]
    rows = []
    for i in range(120):
        part = list(rng.choice(items)[1])
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            k = rng.randrange(len(part))
            part[k : k + rng.choice([0, 1])] = rng.choice(["", "z", "é"])
        rows.append((rng.choice([i, i, None, 9007199254740993 + 2 * i]), prose(3) + rng.choice(["\n", " "]) + "".join(part).title() + " " + prose(4)))
    rows += [rows[0], rows[0], (70, "x" * 200_000 + items[3][1])]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, item_id string").repartition(3)
    got = sorted((str(r["doc_id"]), str(r["item_id"]), r["item_length"], r["distance"]) for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    want = []
    for d, t in rows:
        for i, item in items:
            a, b = decontaminate.plain(item), decontaminate.plain(t[-400:])
            if (n := table(a, b)) <= decontaminate.budget(a):
                want.append((str(d), str(i), len(a), n))
    assert got == sorted(want) and len(want) > 40


def test_labels_with_nulls_and_repeats(spark):
    rows = [(i, f"good prose number {i} about rivers and mills") if i % 2 else (i, f"%%% buy {i} now %%% buy") for i in range(60)] + [(7, "another text of one id")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, i % 2, 0) for i in range(40)] + [(41, None, None), (43, None, 0), (None, 1, 0), (999, 0, 0), (7, 1, 0)]
    model = quality_model.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = quality_model.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), model=model)
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert all(kept[i] == (i % 2 == 1) for i in range(40, 60)) and out.count() == 63
    assert quality_model.classify(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_classifier_on_held_out_rows(spark):
    bad = ["vile", "rotten"]
    rows, labels = [], []
    for i in range(600):
        kind = i % 3
        text = prose(RNG.randint(20, 150))
        if kind == 0:
            words = text.split(" ")
            for _ in range(2):
                words.insert(RNG.randrange(len(words)), RNG.choice(bad))
            text = " ".join(words)
        elif kind == 1:
            text = " ".join(w + "%%%" for w in text.split(" "))
        rows.append((i, text, 1))
        if i < 400:
            labels.append((i, int(kind != 1), int(kind == 0)))
    docs = spark.createDataFrame([*rows, (1000, None, 1), (1001, "", 1)], "doc_id long, text string, kept int")
    out = {r["doc_id"]: r["kept"] for r in quality_model.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = range(400, 600)
    assert sum(out[i] == (i % 3 == 2) for i in held) >= 195
    none = quality_model.classify(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(r["kept"] for r in none.collect())


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    good = [prose(80) for _ in range(12)]
    item = prose(30)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*good, edited(good[0], 0.005), good[1] + " " + item, good[2] + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + prose(40)])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 12 not in left and 13 not in left and set(range(12)) - {0} <= set(left)
    assert "[SECRET]" in left[14] and "04dbeb" not in left[14]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(left)
