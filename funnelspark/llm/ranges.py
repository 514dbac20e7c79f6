"""Rows dealt out in ascending order of an id, and running totals over the parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(df: DataFrame, order: list[str], parts: int, out: str = "part") -> DataFrame:
    """Rows with the number of their part; a part is one sorted task, and parts ascend.

    All columns of ``order`` cut the parts, so rows with equal ids spread as well. The number
    holds inside the job that reads it: write it down with what is made from the part.
    """
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return placed.withColumn(out, F.spark_partition_id())


def totals_before(df: DataFrame, part: str, amount: Column, out: str) -> DataFrame:
    """One row per part with the sum of ``amount`` over all earlier parts."""
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    per = df.groupBy(part).agg(F.sum(amount).alias("_amount"))
    return per.select(part, F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).alias(out))
