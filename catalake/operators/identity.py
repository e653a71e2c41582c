"""Work is done once per identity: the first arrival creates, later ones get its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalake.operators.skew import salted_join


def first_arrivals(arrivals: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """(identity, first): the earliest arrival of each identity. A plain aggregate, so hot identities are harmless."""
    return arrivals.groupBy(*identity).agg(F.min(F.struct(*order)).alias("first"))


def new_arrivals(arrivals: DataFrame, known: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """Arrivals that create work: first of their identity and not known yet. NULL identities never match."""
    first = arrivals.groupBy(*identity).agg(F.min_by(F.struct(*arrivals.columns), F.struct(*order)).alias("row"))
    return first.select("row.*").join(known.select(*identity), identity, "left_anti")


def resolve_attempts(attempts: DataFrame, identity: list[str], order: list[str], failed: Column, row_id: str) -> DataFrame:
    """Adds ``outcome`` (created, duplicate, failed) and the creating attempt's columns as ``first``."""
    usable = attempts.where(~failed)
    first = usable.groupBy(*identity).agg(
        F.min_by(F.struct(*attempts.columns), F.struct(*order)).alias("first")
    )
    joined = salted_join(attempts, first, identity, row_id=row_id, how="left")
    outcome = (
        F.when(failed, F.lit("failed"))
        .when(F.col(row_id) == F.col(f"first.{row_id}"), F.lit("created"))
        .otherwise(F.lit("duplicate"))
    )
    return joined.withColumn("outcome", outcome)
