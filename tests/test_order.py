"""Windows, scans and models over ordered signals, against plain loops over whole signals."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels, stats
from tessera.operators import halo, markov, segment


@pytest.fixture(scope="module")
def signals(spark):
    rng = np.random.RandomState(3)
    rows = []
    for s, n in (("a", 1), ("b", 3), ("c", 50), ("d", 700), ("e", 200), (None, 120)):
        x = rng.randn(n)
        x[n // 3 : n // 3 + n // 20] += 6
        if s == "d":  # runs outside that meet, and one at the end
            x[-4:] -= 9
            x[[100, 102]] += 9
        if s == "e":
            x[:] = 0
        rows += [(s, i, float(v), "given") for i, v in enumerate(x)]
    frame = pd.DataFrame(rows, columns=["s", "i", "log2", "_chunk"])
    return spark.createDataFrame(rows, "s string, i long, log2 double, _other string").repartition(3), frame


def by_block(got, frame):
    for s, g in got.groupby("s", dropna=False):
        own = frame[frame.s == s] if isinstance(s, str) else frame[frame.s.isna()]
        assert len(own) == len(g)
        yield g.sort_values("i"), own.log2.to_numpy()


@pytest.mark.parametrize(("width", "gated"), [(0.1, True), (7, True), (0.5, False)])
def test_rolling_median_in_chunks(signals, monkeypatch, width, gated):
    monkeypatch.setattr(halo, "CHUNK", 16)
    df, frame = signals
    for got, x in by_block(halo.rolling_median(df, ["s"], ["i"], width, gated=gated).toPandas(), frame):
        assert got.smoothed.to_numpy() == pytest.approx(kernels.rolling_median(x, width, gated))
        assert set(got._other) == {"given"}


def test_decaying_mean_in_chunks(signals, monkeypatch):
    monkeypatch.setattr(halo, "CHUNK", 16)
    df, frame = signals
    holes = df.withColumn("log2", F.when(F.col("i") % 9 != 4, F.col("log2")))
    for got, x in by_block(halo.decaying_mean(holes, ["s"], ["i"], 7).toPandas(), frame):
        want = pd.Series(np.where(np.arange(len(x)) % 9 != 4, x, np.nan)).ewm(span=7).mean()
        assert got.smoothed.to_numpy() == pytest.approx(want.to_numpy())
    whole = halo.decaying_mean(df.where("s IS NOT NULL"), [], ["s", "i"], 3).toPandas().sort_values(["s", "i"])
    assert whole.smoothed.to_numpy() == pytest.approx(kernels.ewm(frame[frame.s.notna()].log2.to_numpy(), 3))


def test_no_rows(spark):
    none = spark.createDataFrame([], "s string, i long, log2 double")
    assert halo.rolling_median(none, ["s"], ["i"], 0.1).collect() == []
    assert halo.decaying_mean(none, [], ["i"], 3).collect() == []


def test_biweights_of_arrays(spark):
    rng = np.random.RandomState(2)
    values = [[], [3.5], [1.0, 2.0], [1.0, 1.0, 1.0], *[list(map(float, rng.randn(n) * s)) for n in (3, 4, 9, 40) for s in (1, 1e-4, 50)], [0.0, 0.0, 0.0, 9.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<double>")
    center = stats.array_biweight_location(F.col("v"))
    rows = df.select("i", center.alias("c"), stats.array_biweight_midvariance(F.col("v"), center).alias("m")).orderBy("i").collect()
    for r, v in zip(rows, values):
        if not v:
            assert r["c"] is None and r["m"] is None
            continue
        assert r["c"] == pytest.approx(stats.biweight_location(v))
        assert r["m"] == pytest.approx(stats.biweight_midvariance(v, stats.biweight_location(v)))


def loops(x, model):
    """Posterior, moves and log-likelihood, a place at a time."""
    k, n = len(model.means), len(x)
    like = np.array([[1.0 if np.isnan(v) else stats_density(v, m, s) for m, s in zip(model.means, model.variances)] for v in x])
    a, b, c = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    for t in range(n):
        a[t] = (model.start if t == 0 else a[t - 1] @ model.moves) * like[t]
        c[t] = a[t].sum()
        a[t] /= c[t]
    for t in range(n - 2, -1, -1):
        b[t] = model.moves @ (like[t + 1] * b[t + 1]) / c[t + 1]
    moves = sum((np.outer(a[t], like[t + 1] * b[t + 1] / c[t + 1]) * model.moves for t in range(n - 1)), np.zeros((k, k)))
    return a * b, moves, np.log(c).sum()


def stats_density(x, mean, variance):
    return np.exp(-0.5 * (x - mean) ** 2 / variance) / np.sqrt(2 * np.pi * variance)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 50])
def test_forward_and_backward_scans(n):
    rng = np.random.RandomState(n)
    model = markov.Model(np.array([0.2, 0.5, 0.3]), rng.dirichlet([5, 2, 1], 3), np.array([-1.0, 0.0, 0.6]), np.array([0.1, 0.2, 0.3]))
    x = rng.randn(n)
    if n > 3:
        x[2] = np.nan
    got, want = markov.posterior(x, model), loops(x, model)
    for g, w in zip(got, want):
        assert g == pytest.approx(w)


@pytest.mark.parametrize("n", [1, 4, 5, 6, 17, 50])
def test_scans_in_stretches(n, monkeypatch):
    rng = np.random.RandomState(n)
    model = markov.Model(np.array([0.2, 0.5, 0.3]), rng.dirichlet([5, 2, 1], 3), np.array([-1.0, 0.0, 0.6]), np.array([0.1, 0.2, 0.3]))
    x = rng.randn(n)
    if n > 6:
        x[[2, 5]] = np.nan
    want, sums = markov.posterior(x, model), markov.statistics(x, model)
    monkeypatch.setattr(markov, "STRETCH", 5)
    for g, w in zip(markov.posterior(x, model), want):
        assert g == pytest.approx(w, rel=1e-12)
    assert markov.statistics(x, model) == pytest.approx(sums, rel=1e-12)
    state, certainty = markov.likeliest(x, model)
    assert (state == want[0].argmax(axis=1)).all() and certainty == pytest.approx(want[0].max(axis=1))


def test_states_of_a_long_arm_are_not_held_at_once():
    """An arm of a million places took 168 MB beside its values."""
    import tracemalloc

    x = np.random.RandomState(1).randn(1_000_000)
    tracemalloc.start()
    markov.statistics(x, markov.initial((-1.0, 0.0, 0.585), 0.5))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6


def test_far_values_do_not_underflow():
    both, _, fit = markov.posterior(np.array([0.0, 1e6, -1e6, 0.0]), markov.initial((-1.0, 0.0, 0.585), 0.1))
    assert np.isfinite(both).all() and np.isfinite(fit)


def test_likelihood_rises_and_steps_are_found(spark):
    rng = np.random.RandomState(5)
    rows = []
    for s, level in (("s1", 0.9), ("s2", -1.2)):
        for c in ("chr1", "chr2", "chrX"):
            x = rng.randn(300) * 0.15
            x[120:200] += level
            rows += [(s, c, "p", i * 100, i * 100 + 90, float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "sample_id string, chromosome string, arm string, start long, end long, log2 double")
    keys, trace = ["sample_id"], []
    sds = markov.spreads(df, keys)
    for s in ("s1", "s2"):
        own = [r[5] for r in rows if r[0] == s and r[1] != "chrX"]
        assert sds[s,] == pytest.approx(stats.biweight_midvariance(own, 0.0))
    arms = markov.arms_of(df, keys)
    models = markov.fit(markov.numbered_chromosomes(arms, keys), keys, markov.MEANS["hmm"], (), sds, trace=trace)
    for s, level, state in (("s1", 0.9, 2), ("s2", -1.2, 0)):
        fits = [t[s,] for t in trace]
        assert all(b >= a - 1e-6 * abs(a) for a, b in zip(fits, fits[1:])) and fits[-1] > fits[0]
        assert models[s,].means[state] == pytest.approx(level, abs=0.1)
    found = markov.decode(arms, keys, models).toPandas()
    for (s, _), g in found.groupby(["sample_id", "chromosome"]):
        state = g.sort_values("start").state.to_numpy()
        # two states may share the level of the rest, so a change there is no fault
        assert set(state[121:199]) == {2 if s == "s1" else 0} and not set(state[121:199]) & set(state[[*range(10, 119), *range(201, 300)]])


@pytest.mark.parametrize("method", ["hmm-germline", "hmm-tumor"])
def test_segments_of_models(spark, method):
    rng = np.random.RandomState(8)
    x = rng.randn(600) * 0.1
    x[250:400] -= 1.0
    rows = [("chr1", i * 1000, i * 1000 + 900, "g", float(v), 1.0, 5.0) for i, v in enumerate(x)]
    out = segment.segment(spark.createDataFrame(rows, "chromosome string, start long, end long, gene string, log2 double, weight double, depth double"), method)
    seg = out.toPandas().sort_values("start")
    low = seg[seg.log2 < -0.5]
    assert low.probes.sum() == pytest.approx(150, abs=12) and seg.probes.sum() == 600


def test_bootstrap_intervals(spark):
    from tessera.operators import bootstrap

    rng = np.random.RandomState(4)
    rows, segs = [], []
    for s, n in enumerate((1, 2, 400, 900)):
        segs.append((f"chr{s}", 0, n * 100))
        rows += [(f"chr{s}", i * 100, i * 100 + 50, float(v), float(w)) for i, (v, w) in enumerate(zip(rng.randn(n) + s, rng.rand(n) + 0.5))]
    rows += [("chr2", 50, 60, None, 1.0), ("chr2", 60, 70, 99.0, 0.0)]
    bins_ = spark.createDataFrame(rows, "chromosome string, start long, end long, log2 double, weight double").repartition(4)
    segments = spark.createDataFrame(segs, "chromosome string, start long, end long").coalesce(1)
    out = [bootstrap.bootstrap_intervals(bins_, segments, 400, 0.05).toPandas().sort_values("n") for _ in range(2)]
    pd.testing.assert_frame_equal(out[0].reset_index(drop=True), out[1].reset_index(drop=True), check_exact=False, rtol=1e-9)
    one, two, *more = out[0].itertuples()
    assert one.ci_lo == one.mean == one.bca_hi and two.ci_lo <= two.mean <= two.ci_hi
    for r in more:
        x, w = (np.array([row[k] for row in rows if row[0] == f"chr{2 if r.n == 400 else 3}" and row[3] is not None and row[4] > 0]) for k in (3, 4))
        mean = np.average(x, weights=w)
        error = np.sqrt((w**2 * (x - mean) ** 2).sum()) / w.sum()
        assert r.mean == pytest.approx(mean) and r.ci_hi - r.ci_lo == pytest.approx(3.92 * error, rel=0.2)
        assert abs(r.bca_lo - r.ci_lo) < error and abs(r.bca_hi - r.ci_hi) < error


def test_normal_approximations(spark):
    import math

    from tessera.operators import bootstrap

    z = [-3.0, -1.0, -0.1, 0.0, 0.5, 2.5]
    df = spark.createDataFrame([(v, 0.5 * (1 + math.erf(v / math.sqrt(2)))) for v in z], "z double, p double")
    for r in df.select("z", "p", bootstrap.normal_share(F.col("z")).alias("share"), bootstrap.normal_quantile(F.col("p")).alias("back")).collect():
        assert r["share"] == pytest.approx(r["p"], abs=1e-7) and r["back"] == pytest.approx(r["z"], abs=5e-4)


def test_models_get_only_the_values_of_an_arm(spark):
    """Whole rows of an arm as Python dicts took hundreds of bytes a bin."""
    rng = np.random.default_rng(8)
    data = [("s", "chr1", "p", 10 * i, 10 * i + 5, None if i == 7 else float(v)) for i, v in enumerate(rng.normal(size=50))]
    arms = markov.arms_of(spark.createDataFrame(data, "sample_id string, chromosome string, arm string, start long, end long, log2 double"), ["sample_id"])
    values = arms.select(markov._signals(arms).alias("x"))
    assert values.dtypes == [("x", "array<double>")]
    model = markov.initial(markov.MEANS["hmm"], 0.5)
    out = markov.decode(arms, ["sample_id"], {("s",): model}).orderBy("start").collect()
    both, _, _ = markov.posterior(np.array([np.nan if r[5] is None else r[5] for r in data]), model)
    assert [r["state"] for r in out] == both.argmax(axis=1).tolist() and [r["start"] for r in out] == [r[3] for r in data]
    assert np.allclose([r["certainty"] for r in out], both.max(axis=1))
