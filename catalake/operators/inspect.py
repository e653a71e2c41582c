"""Run inspection rules over a catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalake.functions.vocabulary import DEFAULT, OPTIONAL_COLUMNS, REQUIRED_COLUMNS, Vocabulary
from catalake.operators.group_rules import COMPARED, GROUP_RULES, PRICE, SCOPE, GroupRule, group_issues, price_outliers
from catalake.operators.row_rules import ROW_RULES, RowRule, run_row_rules
from catalake.operators.skew import spread

RULES: tuple[RowRule | GroupRule, ...] = tuple(sorted((*ROW_RULES, *GROUP_RULES), key=lambda rule: rule.position))
# Columns that put issues in discovery order: rule, group of the rule, row, place within the row.
DISCOVERY_ORDER = ("rule_ord", "lead_row", "row_index", "sub_ord")
# What rules read of a product.
READ = (SCOPE, "row_index", *REQUIRED_COLUMNS, *OPTIONAL_COLUMNS, "sale_price_provided")


def inspect(
    products: DataFrame,
    vocab: Vocabulary = DEFAULT,
    rules: tuple[RowRule | GroupRule, ...] = RULES,
) -> DataFrame:
    """All issues of a typed catalog (see ``load_catalog``), unordered; sort by ``DISCOVERY_ORDER`` to list them.

    Row rules share one scan, and so do all rules that compare products, whatever the size of a group. Products are spread
    over all tasks first: their patterns and cells are many times the work of reading them. They are dealt by all that rules
    read, so that the shuffles of all steps hold the same columns and are one: products are read and typed only once.
    """
    by = READ if len(rules) > 1 else (SCOPE, "row_index", "product_id")
    products = spread(products, *[c for c in by if c in products.columns])
    names = {rule.name for rule in rules if isinstance(rule, GroupRule)}
    parts = [group_issues(products, vocab, names)] if names & set(COMPARED) else []
    if PRICE in names:
        parts.append(price_outliers(products, vocab))
    row_rules = tuple(rule for rule in rules if isinstance(rule, RowRule))
    if row_rules:
        parts.append(run_row_rules(products, row_rules, vocab))
    return reduce(DataFrame.unionByName, parts)


def rule_issues(products: DataFrame, name: str, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Issues of one rule group."""
    return inspect(products, vocab, tuple(rule for rule in RULES if rule.name == name))


def in_discovery_order(issues: DataFrame) -> DataFrame:
    return issues.orderBy(*DISCOVERY_ORDER)


def summarise(products: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: products, issues, errors, warnings."""
    none = F.lit(0).cast("bigint")
    counted = issues.agg(
        none.alias("total_products"),
        F.count(F.lit(1)).alias("total_issues"),
        F.count_if(F.col("severity") == "error").alias("error_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
    )
    total = products.agg(
        F.count(F.lit(1)).alias("total_products"),
        none.alias("total_issues"), none.alias("error_count"), none.alias("warning_count"),
    )
    return counted.unionByName(total).agg(*[F.sum(name).alias(name) for name in counted.columns])
