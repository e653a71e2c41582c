"""Unique keys and references of many tables, audited together.

Every table is read once: a row gives an entry for each key and reference that it takes part in, named by the constraint
and the value. One aggregate over all entries judges all constraints: a key value may occur once, and a referenced value
needs a row of the parent table. Values that half of all rows share are counted before they are shuffled; nothing is joined.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Key:
    """Columns whose values together occur once; rows with a NULL among them, or outside ``only`` (SQL), don't count."""

    table: str
    columns: tuple[str, ...]
    only: str | None = None

    @property
    def rule(self) -> str:
        return "repeated_" + "_".join(self.columns)


@dataclass(frozen=True)
class Reference:
    """A column whose values, where there are any, are values of the parent's column."""

    table: str
    column: str
    parent: str
    parent_column: str = "id"

    @property
    def rule(self) -> str:
        return f"orphan_{self.column}"


_PARENT, _ROW = 0, 1


def _entry(number: int, side: int, values: list[Column], row: Column, when: Column) -> Column:
    # each part with its length: ('a|b', 'c') and ('a', 'b|c') are different values
    parts = [F.concat(F.length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")) for v in values]
    shown = F.concat_ws("|", *[v.cast("string") for v in values])
    made = F.struct(F.lit(number).alias("number"), F.lit(side).alias("side"), F.concat_ws("|", *parts).alias("value"),
                    shown.alias("shown"), row.cast("string").alias("row"))
    present = reduce(lambda a, b: a & b, [v.isNotNull() for v in values])
    return F.when(present & F.coalesce(when, F.lit(False)), made)


def _entries(name: str, frame: DataFrame, row: str, constraints: list[Key | Reference]) -> DataFrame | None:
    made = []
    for number, rule in enumerate(constraints):
        if isinstance(rule, Key) and rule.table == name:
            made.append(_entry(number, _ROW, [F.col(c) for c in rule.columns], F.col(row), F.expr(rule.only or "true")))
        if isinstance(rule, Reference) and rule.table == name:
            made.append(_entry(number, _ROW, [F.col(rule.column)], F.col(row), F.lit(True)))
        if isinstance(rule, Reference) and rule.parent == name:
            made.append(_entry(number, _PARENT, [F.col(rule.parent_column)], F.lit(None), F.lit(True)))
    if not made:
        return None
    return frame.select(F.explode(F.array_compact(F.array(*made))).alias("e")).select("e.*")


def broken_constraints(tables: dict[str, tuple[DataFrame, str]], constraints: list[Key | Reference]) -> DataFrame:
    """(table_name, rule, value, rows, first_row) of every value that breaks a constraint.

    ``tables``: name to rows and the column that names a row. ``rows`` counts the rows that share the key, or refer to a
    missing parent; ``first_row`` is the smallest of their names as text. Tables without constraints are not read.
    """
    parts = [_entries(name, frame, row, constraints) for name, (frame, row) in tables.items()]
    entries = reduce(DataFrame.unionByName, [p for p in parts if p is not None])
    of_row = F.col("side") == _ROW
    judged = entries.groupBy("number", "value").agg(
        F.min("shown").alias("shown"), F.count_if(of_row).alias("rows"), F.count_if(~of_row).alias("parents"),
        F.min(F.when(of_row, F.col("row"))).alias("first_row"),
    )
    is_key = F.col("number").isin([i for i, rule in enumerate(constraints) if isinstance(rule, Key)])
    broken = judged.where(F.when(is_key, F.col("rows") > 1).otherwise((F.col("rows") > 0) & (F.col("parents") == 0)))
    pick = lambda what: F.element_at(F.array(*[F.lit(getattr(rule, what)) for rule in constraints]), F.col("number") + 1)
    return broken.select(pick("table").alias("table_name"), pick("rule").alias("rule"), F.col("shown").alias("value"), "rows", "first_row")
