"""Constraint audits on small tables, and that one shuffle serves all of them."""

from catalake.operators.constraints import Key, Reference, broken_constraints
from catalake.plans.constraint_queries import KEYS, REFERENCES
from catalake.plans.registry import QUERIES
from catalake.plans.state_queries import _SQL

FOLDER = "/root/testdata/sf0.001"


def test_keys_and_references(spark):
    parents = spark.createDataFrame([(1, "a|b", "c"), (2, "a", "b|c"), (3, None, "c"), (4, None, "c"), (5, "x", "y"), (6, "x", "y")], "id long, p string, q string")
    children = spark.createDataFrame([(10, 1, True), (11, 9, True), (12, 9, False), (13, None, True), (14, 1, None), (15, 1, True)], "name long, parent long, live boolean")
    rules = [Key("parents", ("p", "q")), Key("parents", ("id",)), Reference("children", "parent", "parents"), Key("children", ("parent",), "live")]
    found = broken_constraints({"parents": (parents, "id"), "children": (children, "name"), "other": (None, "")}, rules)
    assert sorted(tuple(r) for r in found.collect()) == [
        ("children", "orphan_parent", "9", 2, "11"), ("children", "repeated_parent", "1", 2, "10"), ("parents", "repeated_p_q", "x|y", 2, "5"),
    ]
    empty = {"parents": (parents.limit(0), "id"), "children": (children.limit(0), "name")}
    assert broken_constraints(empty, rules).count() == 0


def test_one_exchange_for_all_constraints(spark):
    frame = QUERIES["inv_constraints"](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    broken = {(r["table_name"], r["rule"]) for r in QUERIES["inv_constraints"](spark, "/root/testdata/sf0.01").collect()}
    assert broken == {(rule.table, rule.rule) for rule in (*KEYS, *REFERENCES)}


def test_every_state_rule_is_broken_somewhere(spark):
    found = {(r["table_name"], r["rule"]) for r in QUERIES["inv_all_states"](spark, "/root/testdata/sf0.01").select("table_name", "rule").distinct().collect()}
    assert found == {(table, rule) for table, rules in _SQL.items() for rule in rules}
