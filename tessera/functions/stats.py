"""Robust statistics: native aggregates where SQL has them, numpy kernels where it has not.

The kernels take plain arrays and drop missing values; udaf() makes one a grouped aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def _clean(a) -> np.ndarray:
    a = np.asarray(a, dtype=float)
    return a[~np.isnan(a)]


def _pairs(a, w) -> tuple[np.ndarray, np.ndarray]:
    a, w = np.asarray(a, dtype=float), np.asarray(w, dtype=float)
    real = ~np.isnan(a)
    return a[real], np.nan_to_num(w[real])


def biweight_location(a, initial: float | None = None, c: float = 6.0, epsilon: float = 1e-3, max_iter: int = 5) -> float:
    """STA-01: Tukey's biweight mean."""
    a = _clean(a)
    if len(a) < 2:
        return float(a[0]) if len(a) else math.nan
    center = float(np.median(a)) if initial is None else initial
    for _ in range(max_iter):
        gap = a - center
        reach = max(c * float(np.median(np.abs(gap))), epsilon)
        pull = np.square(1 - np.square(gap / reach))
        near = pull < 1  # the transformed weight decides: the centre itself and far values (infinite ones too) take no part
        if not pull[near].any():
            break
        shift = float(np.dot(gap[near], pull[near]) / pull[near].sum())
        center += shift
        if abs(shift) <= epsilon:
            break
    return center


def biweight_midvariance(a, initial: float | None = None, c: float = 9.0, epsilon: float = 1e-3) -> float:
    """STA-02: a standard deviation (the root of the biweight midvariance)."""
    a = _clean(a)
    if len(a) < 2:
        return 0.0 if len(a) else math.nan
    center = biweight_location(a) if initial is None else initial
    d = a - center
    mad = float(np.median(np.abs(d)))
    u = d / max(c * mad, epsilon)
    inside = np.abs(u) < 1
    d, u2 = d[inside], u[inside] ** 2
    n = int(inside.sum())
    low = float(((1 - u2) * (1 - 5 * u2)).sum())
    if n == 0 or low == 0:
        return mad * MAD_SCALE
    return math.sqrt(n * float((d**2 * (1 - u2) ** 4).sum()) / low**2)


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def array_median(values: Column) -> Column:
    """The median of an array without nulls; null of an empty one."""
    middle = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    return F.when(F.size(values) > 0, _let(F.array_sort(values), middle))


def array_biweight_location(values: Column, c: float = 6.0, epsilon: float = 1e-3, max_iter: int = 5) -> Column:
    """STA-01 of an array without nulls, in built-in expressions: for the few values of a group."""

    def moved(center):
        gaps = F.transform(values, lambda x: x - center)

        def shifted(gaps):
            def weighed(reach):
                pull = lambda g: F.pow(1 - F.pow(g / reach, F.lit(2.0)), F.lit(2.0))
                start = F.struct(F.lit(0.0).alias("mass"), F.lit(0.0).alias("sum"))
                add = lambda s, g: _let(pull(g), lambda p: F.when(p < 1, F.struct((s["mass"] + p).alias("mass"), (s["sum"] + g * p).alias("sum"))).otherwise(s))
                return F.aggregate(gaps, start, add)

            return _let(F.greatest(c * array_median(F.transform(gaps, F.abs)), F.lit(epsilon)), weighed)

        return _let(gaps, shifted)

    state = lambda center, done: F.struct(center.alias("center"), done.alias("done"))

    def step(held, _):
        def next_state(sums):
            move = sums["sum"] / sums["mass"]
            return F.when(sums["mass"] == 0, state(held["center"], F.lit(True))).otherwise(state(held["center"] + move, F.abs(move) <= epsilon))

        return F.when(held["done"], held).otherwise(_let(moved(held["center"]), next_state))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max_iter)), state(array_median(values), F.size(values) < 2), step, lambda s: s["center"])


def array_biweight_midvariance(values: Column, center: Column, c: float = 9.0, epsilon: float = 1e-3) -> Column:
    """STA-02 of an array without nulls around center, in built-in expressions."""

    def spread(f):
        d = lambda x: x - f["center"]
        share = lambda x: F.pow(d(x) / F.greatest(c * f["mad"], F.lit(epsilon)), F.lit(2.0))
        start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("low"), F.lit(0.0).alias("top"))

        def add(s, x):
            more = lambda u: F.struct((s["n"] + 1).alias("n"), (s["low"] + (1 - u) * (1 - 5 * u)).alias("low"), (s["top"] + d(x) * d(x) * F.pow(1 - u, F.lit(4.0))).alias("top"))
            return _let(share(x), lambda u: F.when(u < 1, more(u)).otherwise(s))

        rooted = lambda s: F.when((s["n"] == 0) | (s["low"] == 0), f["mad"] * MAD_SCALE).otherwise(F.sqrt(s["n"] * s["top"] / (s["low"] * s["low"])))
        return F.aggregate(values, start, add, rooted)

    facts = F.struct(center.alias("center"), array_median(F.transform(values, lambda x: F.abs(x - center))).alias("mad"))
    return F.when(F.size(values) == 1, F.lit(0.0)).when(F.size(values) > 1, _let(facts, spread))


#: Chebyshev places in a stretch of one bandwidth: a Gaussian is followed to 1e-13 with these.
PLACES = 16


def _to_places(t: np.ndarray) -> np.ndarray:
    """Row by row, the weights by which the values at the Chebyshev places of [-1, 1] give the value at t."""
    k = np.arange(PLACES)
    nodes = np.cos((k + 0.5) * np.pi / PLACES)
    scale = np.where(k == 0, 1.0, 2.0) / PLACES
    return np.polynomial.chebyshev.chebvander(t, PLACES - 1) @ (np.polynomial.chebyshev.chebvander(nodes, PLACES - 1) * scale).T


def kernel_densities(a: np.ndarray, width: float) -> np.ndarray:
    """The sums of exp(-0.5 ((x - y) / width)^2) over all y at each x of sorted values, in time in proportion to their number.

    Values in a stretch of one width act through weights at its Chebyshev places, and densities
    are read from those at the places of their own stretch; stretches beyond 9 widths count for nothing.
    """
    stretch = np.floor((a - a[0]) / width).astype(np.int64)
    own, first = np.unique(stretch, return_index=True)
    bounds = np.append(first, len(a))
    nodes = np.cos((np.arange(PLACES) + 0.5) * np.pi / PLACES) / 2 + 0.5
    inside = lambda i, lo, hi: _to_places(2 * ((a[lo:hi] - a[0]) / width - own[i]) - 1)
    blocks = lambda i: range(bounds[i], bounds[i + 1], 4096)
    mass = np.array([sum(inside(i, k, min(k + 4096, bounds[i + 1])).sum(axis=0) for k in blocks(i)) for i in range(len(own))])
    out = np.empty(len(a))
    for i in range(len(own)):
        near = slice(np.searchsorted(own, own[i] - 9), np.searchsorted(own, own[i] + 9, side="right"))
        at, to = own[i] + nodes, (own[near, None] + nodes[None, :]).ravel()
        values = np.exp(-0.5 * (at[:, None] - to[None, :]) ** 2) @ mass[near].ravel()
        for k in blocks(i):
            hi = min(k + 4096, bounds[i + 1])
            out[k:hi] = inside(i, k, hi) @ values
    return out


def modal_location(a) -> float:
    """STA-03: the (finite) value where a Gaussian kernel density (Scott's bandwidth) is highest."""
    a = _clean(a)
    a = np.sort(a[np.isfinite(a)])
    if len(a) < 2 or a[0] == a[-1]:
        return float(a[0]) if len(a) else math.nan
    width = a.std(ddof=1) * len(a) ** -0.2
    rough = kernel_densities(a, width)
    top = a[rough >= rough.max() * (1 - 1e-11)]  # what rounding may put first is summed in full
    best, at = -1.0, top[0]
    for x in np.unique(top):
        density = float(np.exp(-0.5 * ((x - a) / width) ** 2).sum())
        if density > best:
            best, at = density, x
    return float(at)


def weighted_median(a, w, compat: bool = False) -> float:
    """STA-04: compat repeats the rule that averages with the value before whenever there is one."""
    a, w = _pairs(a, w)
    if not len(a):
        return math.nan
    if len(a) == 1:
        return float(a[0])
    half = 0.5 * w.sum()
    if (w > half).any():
        return float(a[w.argmax()])
    order = np.argsort(a, kind="stable")
    a, sums = a[order], np.cumsum(w[order])
    i = int(np.flatnonzero(sums >= half)[0])
    if compat:
        return float(a[i - 1 : i + 1].mean()) if i > 0 else float(a[0])
    if abs(sums[i] - half) < 1e-12 and i + 1 < len(a):
        return float((a[i] + a[i + 1]) / 2)
    return float(a[i])


def median_absolute_deviation(a, scale: bool = True) -> float:
    a = _clean(a)
    if len(a) < 2:
        return 0.0 if len(a) else math.nan
    return float(np.median(np.abs(a - np.median(a)))) * (MAD_SCALE if scale else 1.0)


def interquartile_range(a) -> float:
    a = _clean(a)
    return float(np.subtract(*np.percentile(a, [75, 25]))) if len(a) else math.nan


def mean_squared_error(a) -> float:
    a = _clean(a)
    return float(((a - a.mean()) ** 2).mean()) if len(a) else math.nan


def weighted_mad(a, w) -> float:
    """STA-06."""
    a, w = _pairs(a, w)
    return weighted_median(np.abs(a - weighted_median(a, w)), w) * MAD_SCALE if len(a) else math.nan


def weighted_std(a, w) -> float:
    a, w = _pairs(a, w)
    if not len(a):
        return math.nan
    mean = np.average(a, weights=w)
    return math.sqrt(float(np.average((a - mean) ** 2, weights=w)))


def gapper_scale(a) -> float:
    """STA-07: the scale from weighted gaps between sorted values."""
    a = np.sort(_clean(a))
    n = len(a)
    if n < 2:
        return 0.0 if n else math.nan
    i = np.arange(1, n)
    return float((np.diff(a) * i * (n - i)).sum()) * math.sqrt(math.pi) / (n * (n - 1))


def _gaps_upto(a: np.ndarray, x: float) -> int:
    """How many pairs of sorted values differ by x or less."""
    return int((np.searchsorted(a, a + x, side="right") - np.arange(1, len(a) + 1)).sum())


def _nth_gap(a: np.ndarray, nth: int) -> float:
    """The nth smallest (from 0) difference of two sorted values, by bisection over the bits of a double."""
    low, high = 0, int(np.float64(a[-1] - a[0]).view(np.int64))
    while low < high:
        mid = (low + high) // 2
        if _gaps_upto(a, float(np.int64(mid).view(np.float64))) > nth:
            high = mid
        else:
            low = mid + 1
    return float(np.int64(low).view(np.float64))


def q_n(a) -> float:
    """STA-07: the first quartile of pairwise differences over a factor for the sample's size.

    The quartile is searched for by counting, so memory stays in proportion to the values.
    """
    a = np.sort(_clean(a))
    n = len(a)
    if n < 2:
        return 0.0 if n else math.nan
    place = 0.25 * (n * (n - 1) // 2 - 1)
    below = _nth_gap(a, math.floor(place))
    gap = below + (place - math.floor(place)) * (_nth_gap(a, math.ceil(place)) - below)
    factor = 1.392 if n <= 10 else 1 + 4 / n if n < 400 else 1.0
    return gap / factor


def bootstrap_interval(values, weights, alpha: float = 0.05, bootstraps: int = 100, smoothed: bool = False, seed: int = 0xA5EED) -> tuple[float, float]:
    """STA-10: percentile interval of the weighted mean over resamples; the seed starts anew for each group."""
    values, weights = _pairs(values, weights)
    k = len(values)
    if k < 2:
        return (float(values[0]),) * 2 if k else (math.nan, math.nan)
    bootstraps = max(bootstraps, int(math.ceil(2 / alpha)))
    rng, noise = np.random.RandomState(seed), np.random.RandomState(seed)
    if smoothed:  # the noise is drawn after all choices, which are made again below, one resample at a time
        for _ in range(bootstraps):
            noise.randint(0, k, size=k)
    means = np.empty(bootstraps)
    for b in range(bootstraps):
        chosen = rng.randint(0, k, size=k)
        v, w = values[chosen], weights[chosen]
        if smoothed:
            v = v + k**-0.25 * np.sqrt(np.maximum(1 - w, 0)) * noise.randn(k)
        means[b] = np.average(v, weights=w) if w.sum() else v.mean()
    low, high = np.percentile(means, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(low), float(high)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """R-9."""
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(np.asarray(z, dtype=float) / math.sqrt(2)))


def student_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|), by the incomplete beta function's continued fraction."""
    if math.isnan(t) or df <= 0:
        return math.nan
    x = df / (df + t * t)
    return _incomplete_beta(df / 2, 0.5, x)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Lentz's method
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def t_test_p(values) -> float:
    """p_ttest of STA-09: is the mean other than 0?"""
    a = _clean(values)
    if len(a) < 2:
        return math.nan
    spread = a.std(ddof=1)
    if spread == 0:
        return 0.0 if a.mean() else math.nan
    return student_two_sided(float(a.mean() / (spread / math.sqrt(len(a)))), len(a) - 1)


def udaf(kernel: Callable, *, weighted: bool = False):
    """A kernel as a grouped aggregate on one column, or on values and weights."""
    if weighted:

        def two(a: pd.Series, w: pd.Series) -> float:
            return float(kernel(a.to_numpy(), w.to_numpy()))

        return F.pandas_udf(two, "double")

    def one(a: pd.Series) -> float:
        return float(kernel(a.to_numpy()))

    return F.pandas_udf(one, "double")


# -- many groups at once ------------------------------------------------------------------------


def bound_batches(spark) -> None:
    """Arrays of groups go to Python 4 MB at a time, where the session has no value of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf.get(name, None):
        spark.conf.set(name, "4m")


def held(column: str) -> Column:
    """A group's values as an array, missing ones as NaN, so that several arrays stay in step."""
    return F.collect_list(F.coalesce(F.col(column).cast("double"), F.lit(math.nan)))


def _ragged_median(v: np.ndarray, group: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Medians of groups that lie one after the other, none of them empty."""
    v = v[np.lexsort((v, group))]
    return (v[first + (n - 1) // 2] + v[first + n // 2]) / 2


def _ragged(arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values, group, first, count, which): the groups with a value, flat, NaN left out."""
    arrays = [np.asarray(a, dtype=float) for a in arrays]
    n = np.array([len(a) for a in arrays], dtype=np.int64)
    v, group = np.concatenate([*arrays, np.empty(0)]), np.repeat(np.arange(len(arrays)), n)
    real = ~np.isnan(v)
    v, group = v[real], group[real]
    which, group, n = np.unique(group, return_inverse=True, return_counts=True)
    return v, group, np.cumsum(n) - n, n, which


def _ragged_location(v, group, first, n, c: float = 6.0, epsilon: float = 1e-3, max_iter: int = 5) -> np.ndarray:
    center = _ragged_median(v, group, first, n)
    open_ = n > 1
    for _ in range(max_iter):
        gap = v - center[group]
        reach = np.maximum(c * _ragged_median(np.abs(gap), group, first, n), epsilon)
        pull = np.square(1 - np.square(gap / reach[group]))
        near = pull < 1
        mass = np.bincount(group[near], pull[near], len(n))
        shift = np.divide(np.bincount(group[near], gap[near] * pull[near], len(n)), mass, out=np.zeros(len(n)), where=mass > 0)
        center = np.where(open_ & (mass > 0), center + shift, center)
        open_ &= (mass > 0) & (np.abs(shift) > epsilon)
        if not open_.any():
            break
    return center


def many_biweight_locations(arrays) -> np.ndarray:
    """STA-01 of many groups."""
    out = np.full(len(arrays), math.nan)
    v, group, first, n, which = _ragged(arrays)
    with np.errstate(invalid="ignore"):
        out[which] = _ragged_location(v, group, first, n)
    return out


def many_biweight_midvariances(arrays, c: float = 9.0, epsilon: float = 1e-3) -> np.ndarray:
    """STA-02 of many groups."""
    out = np.full(len(arrays), math.nan)
    v, group, first, n, which = _ragged(arrays)
    with np.errstate(invalid="ignore"):
        d = v - _ragged_location(v, group, first, n)[group]
        mad = _ragged_median(np.abs(d), group, first, n)
        u = d / np.maximum(c * mad, epsilon)[group]
    inside = np.abs(u) < 1
    d, u2, at = d[inside], u[inside] ** 2, group[inside]
    k = np.bincount(at, minlength=len(n))
    low, top = np.bincount(at, (1 - u2) * (1 - 5 * u2), len(n)), np.bincount(at, d**2 * (1 - u2) ** 4, len(n))
    plain = (k == 0) | (low == 0)
    root = np.sqrt(np.divide(k * top, low**2, out=np.zeros(len(n)), where=~plain))
    out[which] = np.where(n < 2, 0.0, np.where(plain, mad * MAD_SCALE, root))
    return out


def many_median_deviations(arrays) -> np.ndarray:
    """The scaled median absolute deviations of many groups."""
    out = np.full(len(arrays), math.nan)
    v, group, first, n, which = _ragged(arrays)
    with np.errstate(invalid="ignore"):
        gap = np.abs(v - _ragged_median(v, group, first, n)[group])
    out[which] = np.where(n < 2, 0.0, _ragged_median(gap, group, first, n) * MAD_SCALE)
    return out


MANY = {biweight_location: many_biweight_locations, biweight_midvariance: many_biweight_midvariances, median_absolute_deviation: many_median_deviations}


def of_arrays(kernel: Callable):
    """A kernel as a function of an array column: a batch of groups at a time, which costs far less than a call for each group."""
    many = MANY.get(kernel)

    def run(arrays: pd.Series) -> pd.Series:
        return pd.Series(many(list(arrays)) if many else [float(kernel(a)) for a in arrays], dtype=float)

    return F.pandas_udf(run, "double")


# -- native forms -------------------------------------------------------------------------------


def weighted_mean(value: str, weight: str | None) -> Column:
    """STA-08: the weighted mean, the plain one where all weights are 0."""
    if weight is None:
        return F.avg(value)
    total = F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    return F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(weight)), total), F.avg(value))


def iqr(value: str) -> Column:
    """STA-05."""
    q = F.percentile(F.col(value), F.array(F.lit(0.25), F.lit(0.75)))
    return F.get(q, 1) - F.get(q, 0)


def prediction_interval(value: str, alpha: float) -> list[Column]:
    """STA-11: pi_lo and pi_hi."""
    q = F.percentile(F.col(value), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return [F.get(q, 0).alias("pi_lo"), F.get(q, 1).alias("pi_hi")]
