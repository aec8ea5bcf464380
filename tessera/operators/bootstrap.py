"""Bootstrap intervals of segment means as plain aggregates.

A resample draws each bin a Poisson number of times, and the number comes from a digest of the
bin and the resample, so no group is drawn in one task: counts, sums and resamples add up in
any order, before the shuffle as after it. What is collected for a segment is its resampled
means, as many as there are resamples.

The corrected interval (BCa) shifts the percentiles by the resamples' bias and by the skewness
of the means that leave one bin out, which come from sums of powers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genome import SEED
from .ranges import range_join, with_row_id

#: Where a Poisson number of mean 1 steps up, in parts of 2^16.
STEPS = [int(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8)]
# Fixed values of the rational approximations to the normal distribution and its inverse.
TAIL_TOP, TAIL_BELOW = (2.515517, 0.802853, 0.010328), (1.0, 1.432788, 0.189269, 0.001308)
CDF_SCALE, CDF_TERMS = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
#: Resamples whose numbers come from one digest.
PER_DIGEST = 8


def _polynomial(x: Column, terms) -> Column:
    out = F.lit(float(terms[-1]))
    for t in reversed(terms[:-1]):
        out = out * x + F.lit(float(t))
    return out


def normal_quantile(p: Column) -> Column:
    """The value below which a normal one lies with probability p (within 0.0005)."""
    t = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    far = t - _polynomial(t, TAIL_TOP) / _polynomial(t, TAIL_BELOW)
    return F.when(p < 0.5, -far).otherwise(far)


def normal_share(z: Column) -> Column:
    """The probability of a normal value below z."""
    t = 1 / (1 + CDF_SCALE * F.abs(z))
    above = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * _polynomial(t, CDF_TERMS)
    return F.when(z < 0, above).otherwise(1 - above)


def _at(values: Column, share: Column) -> Column:
    """The value at a share of the way through a sorted array, between neighbours in proportion."""
    place = share * (F.size(values) - 1)
    low = F.floor(place).cast("int")
    return F.get(values, low) + (place - low) * (F.get(values, F.least(low + 1, F.size(values) - 1)) - F.get(values, low))


def bootstrap_intervals(bins: DataFrame, segments: DataFrame, resamples: int = 100, alpha: float = 0.05) -> DataFrame:
    """STA-10/12: row_id of each segment with bins, n, mean, ci_lo, ci_hi and the corrected bca_lo, bca_hi.

    A segment of one bin has that bin's value throughout; bins without a weight or a value take no part.
    """
    resamples = max(resamples, math.ceil(2 / alpha))
    source = bins if "weight" in bins.columns else bins.withColumn("weight", F.lit(1.0))
    value, weight = F.col("s.log2").cast("double"), F.col("s.weight").cast("double")
    pairs = range_join(with_row_id(segments), source).select("q.row_id", F.concat_ws(":", "s.chromosome", "s.start", "s.end").alias("_bin"), value.alias("_x"), weight.alias("_w"))
    pairs = pairs.where("_x IS NOT NULL AND _w > 0")
    whole = pairs.groupBy("row_id").agg(F.count("*").alias("n"), (F.sum(F.col("_w") * F.col("_x"))).alias("_sum"), F.sum("_w").alias("_mass"))
    # one bin left out: how far the mean moves
    moved = (F.col("_sum") - F.col("_w") * F.col("_x")) / (F.col("_mass") - F.col("_w")) - F.col("_sum") / F.col("_mass")
    moves = pairs.join(whole.where("n > 1"), "row_id").withColumn("_d", moved)
    moments = moves.groupBy("row_id").agg(*[F.sum(F.pow("_d", F.lit(float(k)))).alias(f"_d{k}") for k in (1, 2, 3)])
    dealt = pairs.withColumn("_digest", F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // PER_DIGEST)))).withColumn("_md5", F.md5(F.concat_ws(":", "_bin", "_digest", F.lit(str(SEED)))))
    each = dealt.select("row_id", "_x", "_w", "_md5", "_digest", F.explode(F.sequence(F.lit(0), F.lit(PER_DIGEST - 1))).alias("_k")).withColumn("_r", F.col("_digest") * PER_DIGEST + F.col("_k")).where(F.col("_r") < resamples)
    u = F.conv(F.substring(F.col("_md5"), F.col("_k") * 4 + 1, F.lit(4)), 16, 10).cast("int")
    times = sum(((u >= s).cast("int") for s in STEPS[1:]), (u >= STEPS[0]).cast("int"))
    drawn = each.withColumn("_n", times).where("_n > 0").groupBy("row_id", "_r").agg((F.sum(F.col("_n") * F.col("_w") * F.col("_x")) / F.sum(F.col("_n") * F.col("_w"))).alias("_mean"))
    held = drawn.groupBy("row_id").agg(F.array_sort(F.collect_list("_mean")).alias("_means"))
    joined = whole.join(held, "row_id", "left").join(moments, "row_id", "left").withColumn("mean", F.col("_sum") / F.col("_mass"))
    size = F.size("_means")
    below = F.size(F.filter("_means", lambda m: m < F.col("mean"))) / size
    shift = normal_quantile(F.least(F.greatest(below, 0.5 / size), 1 - 0.5 / size))
    n, center = F.col("n"), F.col("_d1") / F.col("n")
    two = F.col("_d2") - n * center * center
    three = -(F.col("_d3") - 3 * center * F.col("_d2") + 3 * center * center * F.col("_d1") - n * center * center * center)
    skew = F.when(two > 0, three / (6 * F.pow(two, F.lit(1.5)))).otherwise(0.0)
    facts = joined.withColumns({"_shift": shift, "_skew": skew})

    def corrected(share: float) -> Column:
        z = F.col("_shift") + normal_quantile(F.lit(share))
        return _at(F.col("_means"), normal_share(F.col("_shift") + z / (1 - F.col("_skew") * z)))

    ends = {"ci_lo": _at(F.col("_means"), F.lit(alpha / 2)), "ci_hi": _at(F.col("_means"), F.lit(1 - alpha / 2)), "bca_lo": corrected(alpha / 2), "bca_hi": corrected(1 - alpha / 2)}
    return facts.select("row_id", "n", "mean", *[F.when((n > 1) & F.col("_means").isNotNull(), e).otherwise(F.col("mean")).alias(c) for c, e in ends.items()])
