"""Positions in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cerulea.sinks.shared import stored


def numbered(rows: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """``rows`` with their position from ``start``: range partitions, sorted and numbered inside; the number of rows before a partition comes from a count for each.

    Rows are stored first, as the ranges are drawn from a sample of them, which would compute them twice.
    """
    sorted_rows = stored(rows, "unordered").repartitionByRange(*order).sortWithinPartitions(*order)
    held = stored(sorted_rows.withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}), "ordered")
    parts = held.groupBy("_part").agg(F.count("*").alias("n"), F.min("_seq").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    shifts = parts.select("_part", (before - F.col("first") + start).alias("_shift"))
    return held.join(F.broadcast(shifts), "_part").withColumn(name, F.col("_seq") + F.col("_shift")).drop("_part", "_seq", "_shift")
