"""Running region counts over a stream of intervals: an addition, as the batch operators have no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import range_join


def region_counts(batch: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows and bases of one micro-batch in each region."""
    return range_join(regions, batch, "trim").groupBy("q.row_id").agg(F.count("*").alias("n"), F.sum(F.col("s.end") - F.col("s.start")).alias("bases"))


def start(stream: DataFrame, regions: DataFrame, sink: str, checkpoint: str):
    """Append each micro-batch's counts with its number; a batch done again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        region_counts(batch, regions).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
