"""Global ranks and running sums that no single task computes.

A window without a partition sorts everything in one task, and one partitioned by
a key does so for a hot key.  Here rows are range-partitioned by the order,
numbered within their partition, and shifted by the sizes of the partitions
before; the shift table has one row a partition and is sent to all executors, so
that the rows stay where they are. Rows go through the exchange and the shared folder
whole: large values are left out and joined to the result by their key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import cut

_LOW = (1 << 33) - 1


def with_index(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """Adds ``name``: the rank of each row (from 0) by ``order``, which must be a total order."""
    ordered = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit(_LOW))
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    shift = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_shift"))
    return ordered.withColumn("_part", part).join(F.broadcast(shift), "_part").withColumn(name, F.col("_shift") + within).drop("_at", "_part", "_shift")


def with_running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before this one in a total order."""
    ordered = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sums = ordered.groupBy("_part").agg(F.sum(value).alias("_n"))
    shift = sums.select("_part", (F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_shift"))
    own = F.sum(value).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col(value)
    return ordered.join(F.broadcast(shift), "_part").withColumn(name, F.col("_shift") + own).drop("_part", "_shift")
