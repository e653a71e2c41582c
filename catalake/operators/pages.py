"""Pages of long lists: the list is put in order once, in ranges; a page reads only the ranges that hold its ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalake.operators.change_ids import ROWS_PER_PART, dense_ids


def write_pages(rows: DataFrame, order: list[str | Column], path: str, rows_per_part: int = ROWS_PER_PART) -> None:
    """Write the rows below ``path`` with their ``rank`` (from 0) in this order, which has to be total, and an index of the ranges."""
    ranked = dense_ids(rows, order, "rank", 0, rows_per_part, "part")
    ranked.write.partitionBy("part").parquet(f"{path}/rows")
    written = rows.sparkSession.read.schema(ranked.schema).parquet(f"{path}/rows")
    index = written.groupBy("part").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    index.coalesce(1).write.parquet(f"{path}/index")


def read_page(spark: SparkSession, path: str, offset: int, limit: int) -> DataFrame:
    """``limit`` rows from rank ``offset`` on, in order."""
    if offset < 0 or limit < 1:
        raise ValueError("an offset is 0 or more, a limit 1 or more")
    index = spark.read.parquet(f"{path}/index").where((F.col("last") >= offset) & (F.col("first") < offset + limit))
    # the ranges of one page
    parts = [row["part"] for row in index.select("part").collect()]
    rows = spark.read.parquet(f"{path}/rows").where(F.col("part").isin(parts)) if parts else spark.read.parquet(f"{path}/rows").limit(0)
    return rows.where((F.col("rank") >= offset) & (F.col("rank") < offset + limit)).drop("part").orderBy("rank")


def total(spark: SparkSession, path: str) -> int:
    """The length of the list, from its index."""
    return spark.read.parquet(f"{path}/index").agg(F.coalesce(F.max("last") + 1, F.lit(0))).first()[0]
