"""Places of rows in one order over a whole table, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch


def ordered_parts(df: DataFrame, order: list) -> DataFrame:
    """df in ranges by order, each sorted and stored: with _part, the number of the range, and _at, the row's place in it."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    path = scratch(spark, "ordered")
    ranged.select("*", F.spark_partition_id().alias("_part"), place.bitwiseAND((1 << 33) - 1).alias("_at")).write.parquet(path)
    return spark.read.parquet(path)


def lookup(values: dict[int, object], kind: str):
    """The value of the row's range, from a map with an entry for each range."""
    if not values:
        return F.lit(None).cast(kind)
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast(kind))]), F.col("_part"))


def numbered(df: DataFrame, order: list, name: str = "row_number") -> DataFrame:
    """df with the place of each row in order, from 0."""
    held = ordered_parts(df, order)
    before, starts = 0, {}
    for r in sorted(held.groupBy("_part").count().collect()):  # a row for each range
        starts[r["_part"]] = before
        before += r["count"]
    return held.withColumn(name, lookup(starts, "long") + F.col("_at")).drop("_part", "_at")
