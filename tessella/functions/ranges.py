"""Running sums along an order, over ranges of rows instead of one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.shared import written


def running(table: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``table`` with the sums, over all rows that come before in ``order``, of whole numbers: no task holds more than a range of rows."""
    ranged = written(table.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy("_range").agg(*(F.sum(v).alias(f"_{k}") for k, v in sums.items()))  # one row for each range
    offsets = whole.select("_range", *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(offsets), "_range")
    return out.withColumns({k: F.col(f"_{k}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in sums.items()}).drop("_range", *(f"_{k}" for k in sums))
