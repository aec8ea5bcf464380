import numpy as np
import pytest

from tessera.functions import kernels, stats
from tessera.operators import markov


@pytest.fixture(scope="module")
def steps():
    rng = np.random.RandomState(7)
    x = np.concatenate([np.zeros(800), np.ones(200), np.zeros(800), np.full(200, 0.8), np.zeros(800)])
    return x + rng.randn(len(x)) * 0.2


def near(found, places=(800, 1000, 1800, 2000), reach=12):
    return all(np.abs(np.asarray(found) - p).min() <= reach for p in places) and len(found) <= 8


def test_haar_finds_the_steps(steps):
    assert near(kernels.haar_breaks(steps, 1e-4, compat=False))


def test_other_segmenters_find_the_steps(steps):
    assert near(kernels.cbs_breaks(steps, 1e-3))
    level = kernels.fused_lasso(steps)
    cuts = np.flatnonzero(np.abs(np.diff(level)) > 0.2) + 1
    assert all(np.abs(cuts - p).min() <= 12 for p in (800, 1000, 1800, 2000))
    model = markov.fit_one(steps, markov.initial((-0.6, 0.0, 0.5), 0.3), ())
    assert near(np.flatnonzero(np.diff(markov.posterior(steps, model)[0].argmax(axis=1))) + 1)


def test_haar_convolution_is_the_difference_of_means():
    x = np.random.RandomState(1).randn(60)
    y = kernels.haar_convolution(x, 4)
    assert y[20] == pytest.approx((x[20:24].sum() - x[16:20].sum()) / np.sqrt(8))


def test_fused_lasso_is_optimal_on_a_small_case():
    x = np.array([0.0, 0.0, 3.0, 3.0])
    assert kernels.fused_lasso(x, 1.0) == pytest.approx([0.5, 0.5, 2.5, 2.5])
    assert kernels.fused_lasso(x, 100.0) == pytest.approx([1.5] * 4)


def test_savgol_keeps_cubics():
    x = np.arange(40.0) ** 3 / 1000
    assert kernels.savgol(x, 7)[8:-8] == pytest.approx(x[8:-8])
    assert kernels.savgol(np.array([1.0, 2.0]), 7).tolist() == [1.0, 2.0]


def test_rolling_median_of_pieces():
    x = np.zeros(50)
    x[20] = 50.0
    assert len(kernels.rolling_median(x, 7)) == 50
    assert kernels.plain_rolling_median(x, 7)[20] == 0
    assert kernels.plain_rolling_median(np.array([1.0, 9.0, 1.0]), 5).tolist() == [1.0, 9.0, 1.0]


def test_robust_statistics():
    a = np.array([1.0, 2.0, 3.0, 4.0, 100.0])
    assert 2 < stats.biweight_location(a) < 3.2
    assert stats.biweight_location([np.nan, 5.0]) == 5.0
    assert stats.biweight_midvariance(np.random.RandomState(0).randn(4000)) == pytest.approx(1, abs=0.06)
    assert stats.weighted_median([1, 2, 3], [1, 1, 1]) == 2
    assert stats.weighted_median([1, 2, 3], [1, 1, 1], compat=True) == 1.5
    assert stats.weighted_median([1, 2, 3], [1, 1, 5]) == 3
    assert stats.modal_location([0, 1, 1.1, 0.9, 5]) == pytest.approx(1, abs=0.11)
    assert stats.median_absolute_deviation([1, 1, 1]) == 0
    assert stats.interquartile_range([1, 2, 4, 8]) == pytest.approx(3.25)


def test_t_test_against_tables():
    assert stats.student_two_sided(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert stats.student_two_sided(0.0, 5) == pytest.approx(1)
    assert stats.normal_cdf(np.array([1.959964]))[0] == pytest.approx(0.975, abs=1e-6)


def test_bootstrap_is_the_same_every_time():
    v, w = np.arange(20.0), np.ones(20)
    assert stats.bootstrap_interval(v, w) == stats.bootstrap_interval(v, w)
    assert stats.bootstrap_interval([3.0], [1.0]) == (3.0, 3.0)


def test_best_arc_over_all_arcs():
    rng = np.random.default_rng(2)
    for n in (5, 40, 200):
        x, w = rng.normal(size=n), rng.uniform(0.2, 2, n)
        found = kernels.best_arc(x, w, 2, block=8)
        mean = np.average(x, weights=w)
        brute = 0.0
        for a in range(n):
            for b in range(a + 2, n + 1):
                if n - (b - a) >= 2:
                    m, total = w[a:b].sum(), w.sum()
                    brute = max(brute, (w[a:b] * (x[a:b] - mean)).sum() ** 2 * total / (m * (total - m)))
        assert abs(found[0] - brute) < 1e-9 * max(1, brute)


def test_binary_segmentation_keeps_its_level():
    rng = np.random.default_rng(4)
    false = sum(len(kernels.cbs_breaks(rng.normal(size=150), alpha=0.05)) > 0 for _ in range(200))
    assert false <= 22  # 0.05 and sampling error
    x = rng.normal(0, 0.2, 600)
    x[200:260] += 0.6
    breaks = kernels.cbs_breaks(x, 1e-4)
    assert any(abs(b - 200) <= 3 for b in breaks) and any(abs(b - 260) <= 3 for b in breaks) and len(breaks) <= 4


def test_pairwise_quartile_by_counting():
    rng = np.random.default_rng(5)
    for n in (2, 3, 11, 400, 501):
        a = np.round(rng.normal(size=n), 1)
        gaps = np.abs(a[:, None] - a[None, :])[np.triu_indices(n, 1)]
        factor = 1.392 if n <= 10 else 1 + 4 / n if n < 400 else 1.0
        assert abs(stats.q_n(a) - np.percentile(gaps, 25) / factor) < 1e-12


@pytest.mark.parametrize(("n", "block", "fan"), [(5, 64, 8), (40, 4, 2), (200, 8, 3), (333, 64, 8)])
def test_best_arc_is_the_best_of_all(n, block, fan):
    rng = np.random.RandomState(n)
    for shape in ("noise", "step", "ties"):
        x, w = rng.randn(n), rng.rand(n) + 0.2
        if shape == "step":
            x[n // 3 : n // 2] += 3
        if shape == "ties":
            x, w = np.round(x), np.ones(n)
        s, m = np.concatenate([[0], np.cumsum(w * (x - np.average(x, weights=w)))]), np.concatenate([[0], np.cumsum(w)])
        want = max((s[b] - s[a]) ** 2 * m[-1] / ((m[b] - m[a]) * (m[-1] - m[b] + m[a])) for a in range(n + 1) for b in range(a + 2, n + 1) if n - (b - a) >= 2)
        z, a, b = kernels.best_arc(x, w, 2, block, fan)
        assert z == pytest.approx(want) and z == pytest.approx((s[b] - s[a]) ** 2 * m[-1] / ((m[b] - m[a]) * (m[-1] - m[b] + m[a])))


def test_best_arc_of_a_long_signal_takes_little_memory():
    import tracemalloc

    rng = np.random.RandomState(1)
    x = rng.randn(300_000)
    x[100_000:100_400] += 1.5
    tracemalloc.start()
    _, a, b = kernels.best_arc(x, np.ones(len(x)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(a - 100_000) < 30 and abs(b - 100_400) < 30 and peak < 100e6
