"""Dense numbers for distinct values, without a global window in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkloom.session import cut


def dense_ids(values: DataFrame, cols: list[str], name: str, start: int = 0) -> DataFrame:
    """Distinct ``cols`` with numbers from ``start`` on, in their order.

    Values are range-partitioned and numbered within each partition; the partitions'
    counts, one row each, give the offsets.  Nulls come first.
    """
    parted = values.select(*cols).distinct().repartitionByRange(*cols).withColumn("_p", F.spark_partition_id())
    parted = cut(parted, "ranked")  # fixes which partition each value is in
    counts = parted.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_p", before.alias("_o"))  # as many rows as partitions
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*cols)) - 1
    return parted.withColumn("_r", rank).join(F.broadcast(offsets), "_p").select(*cols, (F.col("_r") + F.col("_o") + start).cast("bigint").alias(name))


def dense_within(values: DataFrame, group: str, cols: list[str], name: str, start: int = 0) -> DataFrame:
    """Distinct ``group, cols`` with numbers from ``start`` on within each group, in the order
    of ``cols``; a group that holds most rows is still numbered by many tasks."""
    ids = dense_ids(values, [group, *cols], "_g")
    first = ids.groupBy(group).agg(F.min("_g").alias("_f"))  # merges on the map side
    return ids.join(first, group).select(group, *cols, (F.col("_g") - F.col("_f") + start).alias(name))
