"""Robust statistics of whole groups by counting, against the kernels; no task reads a group."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.operators import copynum, robust


def groups():
    rng = np.random.default_rng(8)
    return {
        "normal": rng.normal(size=20_000), "even": np.array([1.0, 2, 3, 9]), "odd": np.array([4.0, 1, 2]), "one": np.array([3.0]), "ties": np.repeat([1.0, 2, 7], [50, 50, 3]), "far": np.append(rng.normal(size=999), 1e12),
        "empty bins": np.append(rng.normal(size=500), [-np.inf] * 3), "equal": np.full(30, 0.1), "rounded": np.round(rng.normal(size=5001), 1), None: rng.normal(3, 0.001, 200), "near": 1 + np.arange(9) * 2.0**-52,
    }


def test_spreads_of_groups(spark):
    held = groups()
    rows = spark.createDataFrame(pd.DataFrame([(k, v) for k, values in held.items() for v in values], columns=["k", "x"]), "k string, x double").repartition(7)
    rows = rows.unionByName(spark.createDataFrame([("even", None), ("even", float("nan"))], rows.schema))
    known = robust.medians(rows.where("x IS NOT NULL AND NOT isnan(x)"), ["k"], F.col("x"))
    assert known == {(k,): (len(v), float(np.median(v))) for k, v in held.items()}
    got = {r["k"]: r["sd"] for r in robust.biweight_midvariances(rows, ["k"], "x", "sd").collect()}
    assert got.keys() == held.keys()
    for k, v in held.items():
        np.testing.assert_allclose(got[k], stats.biweight_midvariance(v), rtol=1e-9, atol=1e-15, err_msg=str(k))


def test_weights_hold_no_sample_in_a_task(spark):
    """The spread of a whole sample's residuals went through one Python group."""
    n = F.col("id")
    rows = spark.range(4000).select(
        F.concat(F.lit("chr"), (n % 5 + 1).cast("string")).alias("chromosome"), (n * 100).alias("start"), (n * 100 + 50 + n % 7).alias("end"), F.when(n % 3 == 0, "Background").otherwise("a").alias("gene"),
        F.sin(n * n).alias("log2"), F.lit(1.0).alias("depth"), F.lit(0.0).alias("ref_log2"), F.lit(0.0).alias("ref_spread"),
    )
    out = copynum.apply_weights(rows)
    assert "Python" not in out._jdf.queryExecution().toString()
    got = out.toPandas()
    off = got["gene"] == "Background"
    want = pd.Series(0.0, index=got.index)
    for kind in (off, ~off):
        part = got[kind]
        gaps = part["log2"] - part.groupby("chromosome")["log2"].transform("median")
        root = np.sqrt(part["end"] - part["start"])
        want[kind] = (1 - stats.biweight_midvariance(gaps) ** 2 / (root / root.mean())).clip(1e-4, 1)
    np.testing.assert_allclose(got["weight"], want, rtol=1e-9)
