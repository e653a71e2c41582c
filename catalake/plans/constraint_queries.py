"""Audits of all unique keys and references at once, on tables with damages put in."""

from __future__ import annotations

from catalake.operators.constraints import Key, Reference, broken_constraints
from catalake.plans.registry import VIEWS, query

# One text for both engines; every table is a projection of a whole given table.
_TABLES = {
    "c_users": "SELECT s_suppkey AS id, concat('user', CAST(s_suppkey - CASE WHEN s_suppkey % 25 = 0 THEN 1 ELSE 0 END AS STRING)) AS username FROM supplier",
    "c_inspection_runs": """SELECT c_custkey AS id, CASE WHEN c_custkey % 11 <> 0 THEN concat('f', CAST(c_custkey - CASE WHEN c_custkey % 40 = 0 THEN 1 ELSE 0 END AS STRING)) END AS file_sha256,
        '13' AS inspection_version, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 90 = 1 THEN -c_custkey ELSE 1 + c_custkey % 5 END AS actor_user_id FROM customer WHERE c_custkey % 60 <> 7""",
    "c_results": "SELECT o_orderkey AS id, o_custkey AS inspection_run_id FROM orders",
    "c_load_runs": """SELECT c_custkey AS id, concat('in', CAST(c_custkey - CASE WHEN c_custkey % 40 = 0 THEN 1 ELSE 0 END AS STRING)) AS input_file_sha256,
        'shop|x' AS profile_name, CASE WHEN c_custkey % 3 = 0 THEN '1' ELSE '2' END AS profile_version FROM customer WHERE c_custkey % 70 <> 3""",
    "c_rejects": "SELECT o_orderkey AS id, o_custkey AS load_run_id, 2 + o_orderkey % 50 AS source_row_number FROM orders",
    "c_catalog": """SELECT p_partkey AS id, concat('S', CAST(p_partkey % 7 AS STRING)) AS supplier_key, concat('P', CAST(p_partkey - CASE WHEN p_partkey % 50 = 0 THEN 7 ELSE 0 END AS STRING)) AS external_product_id,
        CASE WHEN p_partkey % 20 = 0 THEN NULL WHEN p_partkey % 33 = 0 THEN -p_partkey ELSE 1 + p_partkey % 100 END AS source_load_run_id FROM part""",
    "c_promotions": "SELECT c_custkey AS id, 1 + c_custkey % 130 AS load_run_id, CASE WHEN c_custkey % 4 = 0 THEN 'succeeded' ELSE 'blocked' END AS status FROM customer WHERE c_custkey % 80 <> 9",
    "c_changes": "SELECT l_orderkey * 10 + l_linenumber AS id, 1 + l_suppkey % 90 AS promotion_run_id FROM lineitem",
    "c_rollbacks": "SELECT s_suppkey AS id, s_suppkey AS target_promotion_run_id FROM supplier",
}
KEYS = [
    Key("c_users", ("username",)),
    Key("c_inspection_runs", ("file_sha256", "inspection_version")),
    Key("c_load_runs", ("input_file_sha256", "profile_name", "profile_version")),
    Key("c_rejects", ("load_run_id", "source_row_number")),
    Key("c_catalog", ("supplier_key", "external_product_id")),
    Key("c_promotions", ("load_run_id",), "status = 'succeeded'"),
]
REFERENCES = [
    Reference("c_inspection_runs", "actor_user_id", "c_users"),
    Reference("c_results", "inspection_run_id", "c_inspection_runs"),
    Reference("c_rejects", "load_run_id", "c_load_runs"),
    Reference("c_catalog", "source_load_run_id", "c_load_runs"),
    Reference("c_promotions", "load_run_id", "c_load_runs"),
    Reference("c_changes", "promotion_run_id", "c_promotions"),
    Reference("c_rollbacks", "target_promotion_run_id", "c_promotions"),
]
VIEWS.update(_TABLES)

_SQL = [
    f"SELECT '{k.table}' AS table_name, '{k.rule}' AS rule, concat_ws('|', {', '.join(k.columns)}) AS value, count(*) AS rows, min(CAST(id AS VARCHAR)) AS first_row "
    f"FROM {k.table} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in k.columns)} AND ({k.only or 'true'}) GROUP BY {', '.join(k.columns)} HAVING count(*) > 1"
    for k in KEYS
] + [
    f"SELECT '{r.table}', '{r.rule}', CAST({r.column} AS VARCHAR), count(*), min(CAST(id AS VARCHAR)) FROM {r.table} "
    f"WHERE {r.column} IS NOT NULL AND {r.column} NOT IN (SELECT {r.parent_column} FROM {r.parent}) GROUP BY {r.column}"
    for r in REFERENCES
]


@query("inv_constraints", " UNION ALL ".join(_SQL))
def _inv_constraints(spark, sf_dir):
    """Six unique keys and seven references in one shuffle; every one of them is broken somewhere."""
    given = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("customer", "supplier", "part", "orders", "lineitem")}
    tables = {}
    for name, text in _TABLES.items():
        source = next(t for t in given if f"FROM {t}" in text)
        tables[name] = (spark.sql(text.replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: given[source]}), "id")
    return broken_constraints(tables, [*KEYS, *REFERENCES])
