"""Connected components of links between ids, as a table of ids and their smallest reachable id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalake.llm.shared import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def _starred(edges: DataFrame, larger: bool) -> DataFrame:
    """Every node's neighbours are tied to the smallest id around it.

    ``larger``: neighbours above the node; otherwise the node and those below it. Minima are partial aggregates and come
    back by a shuffled join, whose hot partitions adaptive execution can split.
    """
    seen = edges.union(edges.select("v", "u")) if larger else edges
    low = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = seen.join(low, "u")
    if larger:
        tied = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return tied.filter("u > v") if larger else tied.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every id of ``links`` (a, b) that is not the smallest of its component.

    Alternating large-star and small-star steps until the edges no longer change: then every edge leads from an id to
    the smallest id of its component. Needs a number of rounds logarithmic in the length of chains. Null ids and links
    of an id to itself are left out; no links give no rows.
    """
    edges = written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = _state(edges)
    while before[0]:
        edges = written(_starred(_starred(edges, larger=True), larger=False), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
