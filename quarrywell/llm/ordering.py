"""Global positions in id order by two passes: totals of range partitions, then their prefix sums.

Only one total per partition leaves the executors; no row is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def in_id_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """Range-partitioned and sorted by ``keys`` and, among equal keys, by the order of reading, so that rows of one
    hot id spread over partitions too."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = df.withColumn("read_order", F.monotonically_increasing_id())
    order = [F.col(k).asc_nulls_first() for k in [*keys, "read_order"]]
    return read.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("read_order")


def partition_offsets(df: DataFrame, part: str, size: str) -> DataFrame:
    """part, base: the sum of ``size`` over all partitions before.  One row for each partition."""
    totals = df.groupBy(part).agg(F.sum(size).alias("total"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("base"))
