"""Ids of logged changes, and links from rollback rows to the changes that they take back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalake.operators.skew import salted_join
from catalake.sources.recorded import recorded

#: Rows that a range partition should have; a partition is numbered by one task.
ROWS_PER_PART = 1_000_000


def dense_ids(
    rows: DataFrame, order: list[str | Column], name: str, start: int = 1, rows_per_part: int = ROWS_PER_PART, part: str | None = None
) -> DataFrame:
    """``rows`` with numbers ``start``, ``start`` + 1, ... in the order of the columns, which together are unique.

    Rows are dealt over ranges of the order and recorded with their range, as the ranges come from a sample and would not be
    the same again. Numbers within a range are counted there; the counts of the ranges, one row each, give its first number.
    ``part``: a column for the number of the range, where the caller wants it.
    """
    rows = recorded(rows, "unnumbered")
    parts = max(1, -(-rows.count() // rows_per_part))
    dealt = recorded(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = dealt.withColumn("_place", within).join(F.broadcast(offsets), "_part")
    numbered = numbered.withColumn(name, (F.col("_offset") + F.col("_place") + (start - 1)).cast("long")).drop("_offset", "_place")
    return numbered.withColumnRenamed("_part", part) if part else numbered.drop("_part")


def linked(items: DataFrame, log: DataFrame, key: list[str]) -> DataFrame:
    """Rollback rows with ``original_change_id``: the logged change of the same run and product."""
    ids = log.select(*key, F.col("change_id").alias("original_change_id"))
    return salted_join(items, ids, key, row_id=key[-1], how="left")
