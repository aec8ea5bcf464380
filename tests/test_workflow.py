import random

from tessera.plans.workflow import make_reference, run_sample


def reads(spark, seed, gain=None):
    rng = random.Random(seed)
    rows = []
    for chrom, n in (("chr1", 6000), ("chr2", 6000), ("chrX", 3000)):
        for _ in range(n):
            pos = rng.randrange(0, 400_000)
            rows.append((chrom, pos, 100, 100, 60))
            if gain == chrom and 100_000 <= pos < 250_000:
                rows += [(chrom, pos + 7, 100, 100, 60)] * 2
    return spark.createDataFrame(rows, "chromosome string, pos long, aligned_len int, query_len int, mapq int")


def test_from_reads_to_calls(spark):
    baits = spark.createDataFrame([(c, 0, 400_000) for c in ("chr1", "chr2", "chrX")], "chromosome string, start long, end long")
    reference = make_reference(baits, {"a": reads(spark, 1), "b": reads(spark, 2), "c": reads(spark, 3)}, target_size=2000, method="wgs")
    assert reference.count() == 600
    out = run_sample(reads(spark, 4, gain="chr1"), reference, "tumor", "haar", wgs=True)
    assert out["bins"].count() == 600
    segments = out["segments"].collect()
    best = max(segments, key=lambda r: r["log2"])
    assert best["chromosome"] == "chr1" and best["start"] < 250_000 and best["end"] > 150_000 and best["log2"] > 0.3
    calls = out["calls"].collect()
    assert sum(r["probes"] for r in calls) == 600 and {r["cn"] for r in calls if r["chromosome"] == "chr2"} == {2}
    assert make_reference(baits, {}, target_size=2000, method="wgs").count() == 600


def test_counts_of_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.streaming import coverage

    rows = reads(spark, 9).select("chromosome", F.col("pos").alias("start"), (F.col("pos") + 100).alias("end"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    regions = spark.createDataFrame([(i, c, i * 50_000, i * 50_000 + 20_000) for i in range(8) for c in ("chr1", "chr2")], "row_id long, chromosome string, start long, end long")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = coverage.start(stream, regions, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    want = {r["row_id"]: (r["n"], r["bases"]) for r in coverage.region_counts(rows, regions).collect()}
    out = spark.read.parquet(str(tmp_path / "out")).groupBy("row_id").agg(F.sum("n").alias("n"), F.sum("bases").alias("bases"), F.count_distinct("batch").alias("batches")).collect()
    assert {r["row_id"]: (r["n"], r["bases"]) for r in out} == want and max(r["batches"] for r in out) == 2
