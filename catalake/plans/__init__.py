"""Registered queries over the given tables."""

from catalake.plans import batch_queries, catalog_queries, constraint_queries, order_queries, report_queries, state_queries  # noqa: F401
from catalake.plans.registry import ORACLES, QUERIES, with_views


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return {name: with_views(sql) for name, sql in ORACLES.items()}
