"""Running totals over a whole table in a given order, without one task for it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlake.session import pin


def with_running_total(rows: DataFrame, order: list[Column], value: str, total: str) -> DataFrame:
    """Adds ``total``: the sum of ``value`` up to and with each row in the given order.

    The rows are range-partitioned by the order and written once, each with the number
    of its range. Only one sum per range is carried from range to range; inside a range
    a window adds up. Rows that the order leaves equal may stand in any order.
    """
    ranged = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = pin(ranged, "ranges")
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.withColumn(total, F.sum(value).over(upto))
        .join(starts, "_range")
        .withColumn(total, F.col(total) + F.col("_start"))
        .drop("_range", "_start")
    )
