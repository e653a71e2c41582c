"""Bringing per-key results back to rows when one key may hold a large share of all rows.

Aggregates are safe by themselves (partial aggregation runs before the shuffle). The dangerous step is the join of
the aggregate with the rows. Here the aggregate is copied to a few salts and the rows are spread over them; as both
sides of the join are then plain shuffles, adaptive execution can also split a partition that is still too large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 4


def salted_join(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    row_id: str | list[str] = "row_index",
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join one-row-per-key results to rows. ``per_key`` should hold only the keys that matter.

    ``row_id``: columns that tell the rows of one key apart; their hash picks the salt. Always a merge join: tables made
    from few bytes are estimated as few bytes, so the planner would broadcast results that grow with the rows.
    """
    ids = [row_id] if isinstance(row_id, str) else row_id
    spread = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # never NULL, and known to be: a test for NULL would move below shuffles that other steps share, and set them apart
    salted = rows.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*ids), F.lit(salts)).cast("int"), F.lit(0)))
    return salted.join(spread.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def spread(rows: DataFrame, *by: str | Column) -> DataFrame:
    """``rows`` dealt by hash over as many tasks as shuffles have (``spark.sql.shuffle.partitions``), however few bytes they are.

    For steps that make many rows, or much work, of one: a small file is read by one task, and adaptive execution sizes
    partitions by what they read. A number that is asked for is left alone by it.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
