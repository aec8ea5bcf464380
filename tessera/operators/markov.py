"""Hidden Markov models over arms, fitted by Spark: Baum-Welch with the expectation step arm by arm.

An arm is a row with its signal as an array, stored once. A round maps each arm to its
sufficient statistics (weights, first and second moments and moves of the states: a few dozen
numbers), Spark sums them by sample, and the driver turns the sums of each sample into the next
parameters. So no task holds more than an arm, and what moves in a round does not depend on
the length of the signal.

Within an arm the forward and backward passes are scans: the signal is folded into columns,
the k x k matrices of all columns are multiplied side by side, the few columns are chained,
and the states within them follow side by side. Long arms go a stretch of places at a time,
so a task holds an arm's values, and the states of a stretch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.genome import is_autosome
from ..functions.stats import MAD_SCALE, bound_batches
from ..sources.scratch import kept
from .halo import with_each

# Fixed values of the models: means of the states, states whose distribution stays as it is (None: all).
MEANS = {"hmm": (-1.0, 0.0, 0.585), "hmm-germline": (-1.0, 0.0, 0.585), "hmm-tumor": (-2.0, -0.5, 0.0, 0.3, 1.0)}
FROZEN = {"hmm": (), "hmm-germline": (0, 1, 2), "hmm-tumor": (2,)}
#: What a parameter keeps of its last value in a round; counts added to each move; weight of staying before any data.
KEEP_DISTRIBUTION, KEEP_MOVES, PSEUDOCOUNT, STAY = 0.8, 0.1, 5.0, 100.0
#: Rounds at most, and the relative gain in likelihood that ends them.
ROUNDS, LEAST_GAIN = 40, 1e-5
LEAST_VARIANCE = 1e-4
#: Places that are held at once with their states.
STRETCH = 1 << 16


class Model(NamedTuple):
    start: np.ndarray
    moves: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def numbers(self) -> list[float]:
        return [float(x) for a in self for x in a.ravel()]


def model_of(numbers, k: int) -> Model:
    x = np.asarray(numbers, dtype=float)
    return Model(x[:k], x[k : k + k * k].reshape(k, k), x[k + k * k : 2 * k + k * k], x[2 * k + k * k :])


def first_moves(k: int) -> np.ndarray:
    return np.eye(k) * STAY + 1.0 / k


def initial(means, sd: float, start=None) -> Model:
    """Binomial start, states that mostly stay, one spread for all."""
    k = len(means)
    start = np.array([math.comb(k - 1, i) for i in range(k)], dtype=float) if start is None else np.asarray(start, dtype=float)
    moves = first_moves(k)
    return Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), np.array(means, dtype=float), np.full(k, max(sd**2, LEAST_VARIANCE)))


def _folded(like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """like as (steps, columns, states), and which of its places are real: consecutive places run down a column."""
    n, k = like.shape
    depth = max(1, math.isqrt(n))
    columns = -(-n // depth)
    full = np.ones((columns * depth, k))
    full[:n] = like
    real = np.arange(columns * depth) < n
    return full.reshape(columns, depth, k).transpose(1, 0, 2), real.reshape(columns, depth).T


def _chain(like: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised states s[t] ~ (s[t-1] moves) * like[t] with s[0] ~ first * like[0], and the factors taken out."""
    n, k = like.shape
    by_step, real = _folded(like)
    depth, columns, _ = by_step.shape
    fold = np.tile(np.eye(k), (columns, 1, 1))
    for t in range(depth):  # all columns at once
        on = real[t].copy()
        on[0] &= t > 0  # the first place has no move before it
        after = (fold @ moves) * by_step[t][:, None, :]
        after /= after.sum(axis=(1, 2), keepdims=True)
        fold = np.where(on[:, None, None], after, fold)
    state = first * like[0]
    entry = np.empty((columns, k))
    entry[0] = state / state.sum()
    for c in range(1, columns):
        state = entry[c - 1] @ fold[c - 1]
        entry[c] = state / state.sum()
    out, scale = np.empty((depth, columns, k)), np.ones((depth, columns))
    now = entry
    for t in range(depth):
        raw = (now @ moves) * by_step[t]
        if t == 0:
            raw[0] = first * like[0]
        total = raw.sum(axis=1)
        now = np.where(real[t][:, None], raw / total[:, None], now)
        out[t], scale[t] = now, np.where(real[t], total, 1.0)
    return out.transpose(1, 0, 2).reshape(-1, k)[:n], scale.T.ravel()[:n]


def likelihoods(x: np.ndarray, model: Model) -> tuple[np.ndarray, float]:
    """The density of each value in each state, over its greatest, and the log of what was taken out; a missing value says nothing."""
    with np.errstate(invalid="ignore"):
        log = -0.5 * (x[:, None] - model.means) ** 2 / model.variances - 0.5 * np.log(2 * math.pi * model.variances)
    log = np.where(np.isnan(log), 0.0, log)
    top = log.max(axis=1, keepdims=True)
    return np.exp(log - top) + 1e-300, float(top.sum())


def _stretches(x: np.ndarray, model: Model) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """From the last stretch of places to the first: where it begins, the probability of each state at its places, its expected moves with the one into the next stretch, and its log-likelihood.

    A first pass keeps the state in which each stretch is entered; the second finds a
    stretch's states anew, so no more than STRETCH places are held with their states.
    """
    begins = range(0, max(len(x), 1), STRETCH)
    entries = [model.start]
    for at in begins[:-1]:
        entries.append(_chain(likelihoods(x[at : at + STRETCH], model)[0], model.moves, entries[-1])[0][-1] @ model.moves)
    k, after = len(model.means), None
    for at, first in zip(reversed(begins), reversed(entries)):
        like, taken = likelihoods(x[at : at + STRETCH], model)
        ahead, scale = _chain(like, model.moves, first)
        # backwards: u[t] = like[t] * b[t] follows the same recursion with the moves turned round
        back, _ = _chain(like[::-1], model.moves.T, np.ones(k) if after is None else after @ model.moves.T)
        back = back[::-1]
        follows = back[1:] if after is None else np.concatenate([back[1:], after[None]])
        behind = np.ones_like(back)
        behind[: len(follows)] = follows @ model.moves.T
        both = ahead * behind
        both /= both.sum(axis=1, keepdims=True)
        moves = np.zeros((k, k))
        if len(follows):
            before = ahead[: len(follows)]
            weight = np.einsum("ti,ij,tj->t", before, model.moves, follows)
            moves = (before.T @ (follows / weight[:, None])) * model.moves
        after = back[0].copy()
        yield at, both, moves, float(np.log(scale).sum()) + taken


def posterior(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """(probability of each state at each place, expected moves, log-likelihood)."""
    parts = list(_stretches(x, model))
    return np.concatenate([p[1] for p in reversed(parts)]), sum(p[2] for p in parts), sum(p[3] for p in parts)


def likeliest(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest state of each place, and its probability."""
    state, certainty = np.empty(len(x), dtype=np.int32), np.empty(len(x))
    for at, both, _, _ in _stretches(x, model):
        state[at : at + len(both)], certainty[at : at + len(both)] = both.argmax(axis=1), both.max(axis=1)
    return state, certainty


def statistics(x: np.ndarray, model: Model) -> list[float]:
    """Weight, first and second moment of each state, moves, weighted log-likelihood: an arm counts by its length."""
    sums = 0.0
    for at, both, moves, fit in _stretches(x, model):
        own = x[at : at + len(both)]
        held, value = both * ~np.isnan(own)[:, None], np.nan_to_num(own)
        sums = sums + np.concatenate([held.sum(axis=0), held.T @ value, held.T @ value**2, moves.ravel(), [fit]])
    return [float(v) * len(x) for v in sums]


def stepped(model: Model, sums: np.ndarray, frozen: tuple[int, ...]) -> Model:
    """The parameters after a round with these sums."""
    k = len(model.means)
    mass, one, two, moves = sums[:k], sums[k : 2 * k], sums[2 * k : 3 * k], sums[3 * k : 3 * k + k * k].reshape(k, k)
    free = np.array([s not in frozen for s in range(k)]) & (mass > 1e-6)
    safe = np.maximum(mass, 1e-12)
    mean = np.where(free, one / safe, model.means)
    variance = np.where(free, np.maximum(two / safe - mean**2, LEAST_VARIANCE), model.variances)
    keep = np.where(free, KEEP_DISTRIBUTION, 1.0)
    counted = moves + PSEUDOCOUNT + first_moves(k)
    counted /= counted.sum(axis=1, keepdims=True)
    new = KEEP_MOVES * model.moves + (1 - KEEP_MOVES) * counted
    return Model(model.start, new, keep * model.means + (1 - keep) * mean, keep * model.variances + (1 - keep) * variance)


def numbered_chromosomes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the numbered chromosomes; all rows of a sample that has none."""
    some = df.groupBy(*keys).agg(F.max(is_autosome()).alias("_some"))
    return with_each(df, F.broadcast(some), keys).where(is_autosome() | ~F.col("_some")).drop("_some")


def arms_of(bins: DataFrame, keys: list[str], column: str = "log2", also: tuple[str, ...] = ()) -> DataFrame:
    """A row for each arm, stored: keys, chromosome, arm and its rows in order (start, end, x and the columns also)."""
    order = F.array_sort(F.collect_list(F.struct("start", "end", F.col(column).cast("double").alias("x"), *also)))
    return kept(bins.groupBy(*keys, "chromosome", "arm").agg(order.alias("rows")), "arms")


def _signals(arms: DataFrame) -> Column:
    """The arm's values alone, missing ones as NaN: 8 bytes a bin in Python, where a bin's whole row takes hundreds; batches go an arm or a few at a time."""
    bound_batches(arms.sparkSession)
    return F.transform("rows", lambda r: F.coalesce(r["x"], F.lit(math.nan)))


def fit(arms: DataFrame, keys: list[str], means: tuple[float, ...], frozen: tuple[int, ...], sds: dict[tuple, float], rounds: int = ROUNDS, trace: list | None = None) -> dict[tuple, Model]:
    """A model for each sample (key values); trace gets a {sample: log-likelihood} for each round."""
    k = len(means)
    models = {sample: initial(means, sd) for sample, sd in sds.items()}
    fits: dict[tuple, float] = {}
    open_ = set(models)
    sizes = 3 * k + k * k + 1
    for _ in range(rounds):
        if not open_:
            break
        now = {s: models[s].numbers() for s in open_}

        def expect(frames, now=now):
            for frame in frames:
                frame = frame[[tuple(s) in now for s in frame[keys].itertuples(index=False)]] if keys else frame
                made = [statistics(np.asarray(x, dtype=float), model_of(now[tuple(s)], k)) for s, x in zip(frame[keys].itertuples(index=False) if keys else [()] * len(frame), frame["x"])]
                yield pd.DataFrame({**{c: frame[c] for c in keys}, "sums": pd.Series(made, index=frame.index, dtype=object)})

        schema = StructType([arms.schema[c] for c in keys] + [StructField("sums", ArrayType(DoubleType()))])
        summed = arms.select(*keys, _signals(arms).alias("x")).mapInPandas(expect, schema).groupBy(*keys).agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(sizes)]).alias("sums"))
        for r in summed.collect():  # a row for each sample
            sample = tuple(r[c] for c in keys)
            sums = np.array(r["sums"], dtype=float)
            models[sample] = stepped(models[sample], sums, frozen)
            gain = sums[-1] - fits.get(sample, -math.inf)
            fits[sample] = float(sums[-1])
            if gain < LEAST_GAIN * abs(sums[-1]):
                open_.discard(sample)
        if trace is not None:
            trace.append(dict(fits))
    return models


def decode(arms: DataFrame, keys: list[str], models: dict[tuple, Model]) -> DataFrame:
    """keys, chromosome, arm, start, end, state, certainty: the likeliest state of each place, and its probability."""
    plain = {s: m.numbers() for s, m in models.items()}
    k = len(next(iter(models.values())).means) if models else 1

    def states(signals: pd.Series, *samples: pd.Series) -> pd.DataFrame:
        out = []
        for i, x in enumerate(signals):
            out.append(likeliest(np.asarray(x, dtype=float), model_of(plain[tuple(s.iloc[i] for s in samples)], k)))
        return pd.DataFrame({"state": pd.Series([s for s, _ in out], dtype=object), "certainty": pd.Series([c for _, c in out], dtype=object)})

    found = F.pandas_udf(states, StructType([StructField("state", ArrayType(IntegerType())), StructField("certainty", ArrayType(DoubleType()))]))
    held = arms.select(*keys, "chromosome", "arm", "rows", found(_signals(arms), *keys).alias("_f"))
    zipped = F.arrays_zip("rows", F.col("_f.state").alias("state"), F.col("_f.certainty").alias("certainty"))
    flat = held.select(*keys, "chromosome", "arm", F.explode(zipped).alias("_z"))
    return flat.select(*keys, "chromosome", "arm", "_z.rows.*", "_z.state", "_z.certainty")


def fit_one(x: np.ndarray, model: Model, frozen: tuple[int, ...], rounds: int = ROUNDS) -> Model:
    """The same rounds for one short signal."""
    last = -math.inf
    for _ in range(rounds):
        sums = np.array(statistics(x, model), dtype=float)
        model = stepped(model, sums, frozen)
        if sums[-1] - last < LEAST_GAIN * abs(sums[-1]):
            break
        last = sums[-1]
    return model


def spreads(bins: DataFrame, keys: list[str], column: str = "log2") -> dict[tuple, float]:
    """The root of the biweight midvariance of each sample's autosomes (all, where there are none) around 0."""
    rows = numbered_chromosomes(bins, keys).select(*keys, F.col(column).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    mads = rows.groupBy(*keys).agg(F.median(F.abs("x")).alias("mad"))
    u = F.pow(F.col("x") / F.greatest(9 * F.col("mad"), F.lit(1e-3)), F.lit(2.0))
    near = with_each(rows, F.broadcast(mads), keys).withColumn("u", u)  # a row for each sample
    inside = lambda c: F.sum(F.when(F.col("u") < 1, c))
    sums = near.groupBy(*keys).agg(
        F.first("mad").alias("mad"), inside(F.lit(1)).alias("n"), inside((1 - F.col("u")) * (1 - 5 * F.col("u"))).alias("low"), inside(F.col("x") * F.col("x") * F.pow(1 - F.col("u"), F.lit(4.0))).alias("top"),
    )
    out = {}
    for r in sums.collect():  # a row for each sample
        out[tuple(r[c] for c in keys)] = math.sqrt(r["n"] * r["top"]) / abs(r["low"]) if r["n"] and r["low"] else MAD_SCALE * r["mad"]
    return out
