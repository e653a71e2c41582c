"""Audits of the states of runs, logs and refused rows, on tables with damages put in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from catalake.operators import invariants
from catalake.plans.registry import VIEWS, query

_STATUS = "CASE k % 6 WHEN 0 THEN 'applying' WHEN 1 THEN 'failed' WHEN 2 THEN 'blocked' ELSE CASE WHEN k % 91 = 5 THEN 'waiting' ELSE 'succeeded' END END"
_ENDED = "CASE WHEN (k % 6 = 0) = (k % 53 = 0) THEN k END"  # wrong for every 53rd
_HASH = "CASE WHEN k % 4 > 0 THEN repeat('f', CASE WHEN k % 77 = 3 THEN 63 ELSE 64 END) END"
_COUNT = "CASE WHEN k % {0} = 1 THEN -1 ELSE k % 9 END AS {1}"
_LOG = "CASE WHEN k % 61 = 2 THEN 'other' WHEN k % 3 = 0 THEN '{0}' ELSE '{1}' END AS action, {2}, CASE WHEN k % 67 = 4 THEN array() ELSE array('price') END AS changed_fields"

# (name, Spark text, DuckDB text where it differs): every table is a projection of a whole given table with the key k.
_TABLES = {
    "s_load_runs": f"""SELECT k AS id, {_COUNT.format(41, 'loaded_rows')}, CASE WHEN k % 5 > 0 THEN CASE WHEN k % 43 = 1 THEN -3 ELSE 7 END END AS total_rows,
        {_COUNT.format(47, 'rejected_rows')}, k % 2 = 0 AS reject_details_stored,
        CASE WHEN (k % 2 = 0) <> (k % 37 = 1) THEN repeat('a', CASE WHEN k % 59 = 0 THEN 60 ELSE 64 END) END AS rejects_file_sha256 FROM s_customer""",
    "s_promotions": f"""SELECT k AS id, {_STATUS} AS status, {_ENDED} AS completed_at, {_HASH} AS preview_hash,
        {', '.join(_COUNT.format(n, c) for n, c in ((31, 'inserted_count'), (37, 'updated_count'), (41, 'unchanged_count'), (43, 'blocked_count'), (47, 'error_count'), (53, 'warning_count')))} FROM s_customer""",
    "s_rollbacks": f"""SELECT k AS id, {_STATUS} AS status, {_ENDED} AS completed_at, {_HASH} AS preview_hash,
        {', '.join(_COUNT.format(n, c) for n, c in ((31, 'restored_count'), (37, 'deleted_count'), (41, 'conflict_count')))} FROM s_customer""",
    "s_changes": f"SELECT k AS id, {_LOG.format('insert', 'update', 'CASE WHEN (k % 3 = 0) = (k % 71 = 0) THEN 1 END AS before_data, CASE WHEN k % 73 <> 0 THEN 1 END AS after_data')} FROM s_orders",
    "s_rollback_changes": f"SELECT k AS id, {_LOG.format('delete', 'restore', 'CASE WHEN k % 73 <> 0 THEN 1 END AS before_data, CASE WHEN (k % 3 = 0) = (k % 71 = 0) THEN 1 END AS after_data')} FROM s_orders",
    "s_rejects": "SELECT k AS id, CASE WHEN k % 83 = 0 THEN 1 ELSE 2 + k END AS source_row_number, CASE WHEN k % 89 = 0 THEN array() ELSE array('x') END AS errors FROM s_orders",
}
VIEWS["s_customer"] = "SELECT c_custkey AS k FROM customer"
VIEWS["s_orders"] = "SELECT o_orderkey AS k FROM orders"
VIEWS.update({name: text.replace("array()", "CAST([] AS VARCHAR[])").replace("array('price')", "['price']").replace("array('x')", "['x']") for name, text in _TABLES.items()})


def _negative(*names: str) -> dict[str, str]:
    return {f"negative_{name}": f"{name} < 0" for name in names}


_RUN = {
    "unknown_status": "status NOT IN ('applying', 'succeeded', 'failed', 'blocked')",
    "end_and_status": "status = 'applying' AND completed_at IS NOT NULL OR status IN ('succeeded', 'failed', 'blocked') AND completed_at IS NULL",
    "preview_hash_form": "length(preview_hash) <> 64",
}
_SQL = {
    "s_load_runs": _negative("loaded_rows", "total_rows", "rejected_rows") | {
        "reject_state": "reject_details_stored AND rejects_file_sha256 IS NULL OR NOT reject_details_stored AND rejects_file_sha256 IS NOT NULL",
        "reject_hash_form": "length(rejects_file_sha256) <> 64",
    },
    "s_promotions": _negative("inserted_count", "updated_count", "unchanged_count", "blocked_count", "error_count", "warning_count") | _RUN,
    "s_rollbacks": _negative("restored_count", "deleted_count", "conflict_count") | _RUN,
    "s_changes": {
        "unknown_action": "action NOT IN ('insert', 'update')", "after_presence": "after_data IS NULL", "no_changed_fields": "len(changed_fields) = 0",
        "before_presence": "action = 'insert' AND before_data IS NOT NULL OR action <> 'insert' AND before_data IS NULL",
    },
    "s_rollback_changes": {
        "unknown_action": "action NOT IN ('delete', 'restore')", "before_presence": "before_data IS NULL", "no_changed_fields": "len(changed_fields) = 0",
        "after_presence": "action = 'delete' AND after_data IS NOT NULL OR action <> 'delete' AND after_data IS NULL",
    },
    "s_rejects": {"row_number_too_small": "source_row_number < 2", "no_errors": "len(errors) = 0"},
}


@query("inv_all_states", " UNION ALL ".join(
    f"SELECT '{table}' AS table_name, '{rule}' AS rule, CAST(id AS VARCHAR) AS key FROM {table} WHERE {test}" for table, rules in _SQL.items() for rule, test in rules.items()
))
def _inv_all_states(spark, sf_dir):
    """States of load, promotion and rollback runs, both change logs and refused rows; each rule is broken somewhere."""
    given = {"s_customer": spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS k"),
             "s_orders": spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS k")}
    rules = {
        "s_load_runs": invariants.load_run_rules(), "s_promotions": invariants.promotion_run_rules(),
        "s_rollbacks": invariants.rollback_run_rules(), "s_changes": invariants.logged_change_rules("insert", None, ("update",)),
        "s_rollback_changes": invariants.logged_change_rules(None, "delete", ("restore",)), "s_rejects": invariants.rejected_row_rules(),
    }
    parts = []
    for name, text in _TABLES.items():
        source = next(s for s in given if text.endswith(f"FROM {s}"))
        frame = spark.sql(text.replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: given[source]})
        parts.append(invariants.rows_that_break(frame, name, "id", rules[name]))
    return reduce(DataFrame.unionByName, parts)
