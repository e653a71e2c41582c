"""Queries on issues and on the history of runs and batches."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalake.functions import vocabulary as v
from catalake.operators import history, pages, report
from catalake.operators.identity import new_arrivals, resolve_attempts
from catalake.operators.inspect import inspect, summarise
from catalake.plans import ducksql as d
from catalake.plans.catalog_queries import products
from catalake.plans.fixtures import ATTEMPTS, CATALOG, FIXTURES, INSPECTION_RESULTS, INSPECTION_RUNS, LOAD_RUNS
from catalake.plans.registry import VIEWS, query
from catalake.sources.recorded import shared_folder

VIEWS["v_cards"] = d.rows_of([(rule, *card) for rule, card in v.RULE_CARDS.items()], "rule, label, advice, risk")
VIEWS["v_report"] = """
SELECT CASE severity WHEN 'error' THEN '오류' WHEN 'warning' THEN '주의' ELSE severity END AS status, coalesce(c.label, i.rule) AS error_field,
  product_group_id, product_id, coalesce(c.advice, 'CSV 내용을 확인하세요.') AS recommendation, coalesce(c.risk, '') AS risk_level, row_index, i.rule, message
FROM v_issues i LEFT JOIN v_cards c ON c.rule = i.rule
"""


def _reported(spark, sf_dir) -> DataFrame:
    return report.report(inspect(products(spark, sf_dir)))


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def duck_stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {column}"


_SHOWN = ("status", "error_field", "product_group_id", "product_id", "recommendation", "risk_level", "row_index")


@query("issue_report", f"SELECT {', '.join(_SHOWN)} FROM v_report")
def _issue_report(spark, sf_dir):
    return report.in_report_order(_reported(spark, sf_dir)).select(*_SHOWN)


def _captures(pattern: str, *groups: int) -> list[str]:
    return [f"regexp_extract(message, '{pattern}', {g})" for g in groups]


def _comma(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


_NAMES = "CASE {f} WHEN 'product_name' THEN '상품명' WHEN 'description' THEN '상품 설명' WHEN 'seller' THEN '판매자 정보' END"
_FIELD_PATTERN = "^field ''(.*)'' contains [a-z ]+ ''(.*)''$"
_F, _V = _captures(_FIELD_PATTERN, 1, 2)
_FIELD = _NAMES.replace("{f}", _F)
_PRICE = "^price ([0-9]+) in category ''(.*)'' has median ([0-9.]+) and ratio ([0-9.]+)$"
_P, _C, _M, _R = _captures(_PRICE, 1, 2, 3, 4)
_KW, _IMP, _CUR = _captures("^product_name keyword ''(.*)'' implies category ''(.*)'' but current category is ''(.*)''$", 1, 2, 3)
_DC = _captures("^product_id ''(.*)'' in group ''(.*)'' duplicates product_id ''(.*)'' in group ''(.*)'' with same", 1, 2, 3, 4)
# Sentences written from the message text for the rules whose message can be read back plainly.
_REASONS = f"""
SELECT rule, product_id, row_index, CASE rule
  WHEN 'prohibited_term' THEN {_FIELD} || '에 금지어 ''' || {_V} || '''이 포함되어 있습니다.'
  WHEN 'email_address' THEN {_FIELD} || '에 이메일 주소 ''' || {_V} || '''이 포함되어 있습니다.'
  WHEN 'phone_number' THEN {_FIELD} || '에 전화번호 ''' || {_V} || '''이 포함되어 있습니다.'
  WHEN 'resident_registration_number' THEN {_FIELD} || '에 주민등록번호 형식 ''' || {_V} || '''이 포함되어 있습니다.'
  WHEN 'suspected_bank_account' THEN {_FIELD} || '에 계좌번호로 의심되는 값 ''' || {_V} || '''이 포함되어 있습니다.'
  WHEN 'duplicate_product_id' THEN '동일한 상품 ID ''' || product_id || '''가 여러 상품에 사용되었습니다. 중복 행: ' || regexp_extract(message, ' is used in ([0-9]+) rows, first in row ([0-9]+)$', 1)
    || '개, 첫 행: ' || regexp_extract(message, ' is used in ([0-9]+) rows, first in row ([0-9]+)$', 2) || '.'
  WHEN 'inconsistent_group_size_system' THEN '상품 그룹 ''' || product_group_id || '''에서 문자형 사이즈와 숫자형 사이즈가 함께 사용되고 있습니다.'
  WHEN 'missing_required_field' THEN '필수 항목 ' || regexp_extract(message, '^(''.*'') is missing$', 1) || ' 값이 누락되었습니다.'
  WHEN 'non_standard_color' THEN '색상 ''' || {_captures("^color ''(.*)'' should be standardized to ''(.*)''$", 1)[0]} || '''은 표준값 ''' || {_captures("^color ''(.*)'' should be standardized to ''(.*)''$", 2)[0]} || '''으로 통일하는 것이 좋습니다.'
  WHEN 'non_standard_size' THEN '사이즈 ''' || {_captures("^size ''(.*)'' should be standardized to ''(.*)''$", 1)[0]} || '''은 표준값 ''' || {_captures("^size ''(.*)'' should be standardized to ''(.*)''$", 2)[0]} || '''으로 통일하는 것이 좋습니다.'
  WHEN 'duplicate_product_content' THEN '상품 ID ''' || {_DC[0]} || '''(그룹 ''' || {_DC[1]} || ''')는 상품 ID ''' || {_DC[2]} || '''(그룹 ''' || {_DC[3]} || ''')와 상품명, 카테고리, 색상, 사이즈, 가격이 모두 같습니다.'
  WHEN 'invalid_category' THEN '카테고리 ''' || {_captures("^category ''(.*)'' is not one of", 1)[0]} || '''는 허용된 카테고리가 아닙니다.'
  WHEN 'invalid_stock' THEN CASE WHEN message LIKE '%negative' THEN '재고 ' || regexp_extract(message, '-?[0-9]+') || '개는 음수이므로 사용할 수 없습니다.' ELSE '재고가 누락되었거나 숫자 형식이 아닙니다.' END
  WHEN 'out_of_stock' THEN '재고가 0개인 품절 상품입니다.'
  WHEN 'invalid_price' THEN '가격이 누락되었거나 숫자 형식이 아닙니다.'
  WHEN 'invalid_non_positive_price' THEN '상품 가격이 0 이하입니다. 현재 가격: ' || {_comma("regexp_extract(message, '-?[0-9]+')")} || '원.'
  WHEN 'invalid_sale_price' THEN '할인가가 누락되었거나 숫자 형식이 아닙니다.'
  WHEN 'invalid_non_positive_sale_price' THEN '할인가가 0 이하입니다. 현재 할인가: ' || {_comma("regexp_extract(message, '-?[0-9]+')")} || '원.'
  WHEN 'sale_price_greater_than_price' THEN '할인가 ' || {_comma("regexp_extract(message, '[0-9]+')")} || '원이 정상가 ' || {_comma("regexp_extract(message, 'price ([0-9]+)$', 1)")} || '원보다 큽니다.'
  WHEN 'category_price_anomaly' THEN '같은 카테고리의 일반적인 가격 범위와 큰 차이가 있습니다. 현재 가격 ' || {_comma(_P)} || '원은 ' || {_C} || ' 카테고리 중앙값 '
    || format('{{:,.0f}}', CAST({_M} AS DOUBLE)) || '원의 ' || format('{{:g}}', CAST({_R} AS DOUBLE)) || '배입니다.'
  WHEN 'product_category_mismatch' THEN '상품명에서 ''' || {_KW} || '''가 확인되어 ' || {_IMP} || ' 상품으로 추정되지만 현재 카테고리는 ''' || {_CUR} || '''입니다.'
  END AS reason
FROM v_issues WHERE rule NOT IN ('duplicate_product_name', 'duplicate_variant_combination', 'inconsistent_group_category')
UNION ALL SELECT 'duplicate_product_name', product_id, row_index, '상품명 ''' || product_name || '''이 다른 상품과 동일하거나 정리 후 같은 값으로 확인되었습니다. 같은 이름의 행: '
  || n || '개, 첫 행: ' || first_row || '.'
FROM v_name_rows JOIN (SELECT name_key, count(*) AS n, min(row_index) + 2 AS first_row FROM v_keyed GROUP BY name_key) USING (name_key)
UNION ALL SELECT 'duplicate_variant_combination', product_id, row_index, '상품 그룹 ''' || product_group_id || '''에서 색상 ''' || color_key || ''', 사이즈 '
  || CASE WHEN size_key = '' THEN '없음' ELSE '''' || size_key || '''' END || ' 조합이 여러 상품 ID에 중복되어 있습니다. 조합의 행: ' || n || '개, 첫 행: ' || first_row || '.'
FROM v_variant_rows JOIN v_variant_sizes USING (product_group_id, color_key, size_key)
UNION ALL SELECT 'inconsistent_group_category', product_id, row_index, '상품 그룹 ''' || product_group_id || '''에 서로 다른 카테고리 ''' || low || ''', ''' || high || '''가 함께 등록되어 있습니다.'
FROM v_keyed JOIN v_mixed_groups USING (product_group_id) WHERE cat_key <> ''
"""


@query("issue_reason", _REASONS)
def _issue_reason(spark, sf_dir):
    return inspect(products(spark, sf_dir)).select("rule", "product_id", "row_index", report.reason_text().alias("reason"))


@query("inspect_summary", """
SELECT (SELECT count(*) FROM v_products) AS total_products, count(*) AS total_issues,
  count_if(severity = 'error')::BIGINT AS error_count, count_if(severity = 'warning')::BIGINT AS warning_count FROM v_issues
""")
def _inspect_summary(spark, sf_dir):
    catalog = products(spark, sf_dir)
    return summarise(catalog, inspect(catalog))


@query("stats_by_rule", "SELECT error_field, count(*) AS issue_count FROM v_report GROUP BY 1")
def _stats_by_rule(spark, sf_dir):
    return report.count_by_rule(_reported(spark, sf_dir))


@query("stats_by_risk", "SELECT risk_level, count(*) AS issue_count FROM v_report GROUP BY 1")
def _stats_by_risk(spark, sf_dir):
    return report.count_by_risk(_reported(spark, sf_dir))


@query("stats_by_product", "SELECT CASE WHEN product_id = '' THEN '상품 ID 없음' ELSE product_id END AS product_id, count(*) AS issue_count FROM v_report GROUP BY 1")
def _stats_by_product(spark, sf_dir):
    return report.count_by_product(_reported(spark, sf_dir))


@query("stats_top_products", """
SELECT CASE WHEN product_id = '' THEN '상품 ID 없음' ELSE product_id END AS product_id, issue_count
FROM (SELECT product_id, count(*) AS issue_count FROM v_report GROUP BY 1) ORDER BY issue_count DESC, product_id = '', product_id LIMIT 5
""")
def _stats_top_products(spark, sf_dir):
    return report.count_by_product(_reported(spark, sf_dir)).limit(5)


@query("issue_filter", f"SELECT {', '.join(_SHOWN)} FROM v_report WHERE status = '오류' AND error_field = '필수 값 누락' AND contains(lower(product_id), lower('p1'))")
def _issue_filter(spark, sf_dir):
    kept = report.filter_issues(_reported(spark, sf_dir), "오류", "필수 값 누락", " p1 ")
    return kept.select(*_SHOWN)


@query("export_safe_cells", """
SELECT row_index, CASE WHEN left(seller, 1) IN ('=', '+', '-', '@') THEN '''' || seller ELSE seller END AS seller,
  CASE WHEN left(description, 1) IN ('=', '+', '-', '@') THEN '''' || description ELSE description END AS description FROM v_products
""")
def _export_safe_cells(spark, sf_dir):
    return report.export_safe(products(spark, sf_dir).select("row_index", "seller", "description"))


# --- inspection history ---


def _runs(spark, sf_dir) -> DataFrame:
    return INSPECTION_RUNS.frame(spark, sf_dir)


@query("history_deep_page", f"""
SELECT id, source_filename, {duck_stamp('created_at')}, rank FROM (
  SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) - 1 AS rank FROM fx_inspection_runs) WHERE rank >= 700 AND rank < 725
""")
def _history_deep_page(spark, sf_dir):
    """A page far down the list of runs, newest first, from pages that were written once."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/pages-{uuid.uuid4().hex[:12]}"
    runs = _runs(spark, sf_dir).select("id", "source_filename", "created_at")
    pages.write_pages(runs, [F.desc("created_at"), F.desc("id")], path, rows_per_part=200)
    page = pages.read_page(spark, path, 700, 25)
    return page.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("history_export_repeated", "SELECT id, CAST(2 AS BIGINT) AS n FROM fx_inspection_runs WHERE id % 37 = 1")
def _history_export_repeated(spark, sf_dir):
    """Pages that overlap bring some runs twice: such an export must not be published."""
    runs = _runs(spark, sf_dir)
    return history.repeated_ids(history.history_export(runs.unionByName(runs.where("id % 37 = 1"))))


@query("history_export", f"""
SELECT id, CASE WHEN left(source_filename, 1) IN ('=', '+', '-', '@') THEN '''' || source_filename ELSE source_filename END AS source_filename,
  coalesce(actor_username, '알 수 없음') AS actor, {duck_stamp('created_at')}, total_products, total_issues, error_count, warning_count,
  CASE WHEN error_count > 0 THEN '오류' WHEN warning_count > 0 THEN '주의' ELSE '정상' END AS status
FROM fx_inspection_runs
""")
def _history_export(spark, sf_dir):
    exported = history.history_export(_runs(spark, sf_dir))
    return exported.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("run_status", "SELECT id, CASE WHEN error_count > 0 THEN '오류' WHEN warning_count > 0 THEN '주의' ELSE '정상' END AS status FROM fx_inspection_runs")
def _run_status(spark, sf_dir):
    status = report.overall_status(F.col("error_count"), F.col("warning_count"))
    return _runs(spark, sf_dir).select("id", status.alias("status"))


@query("audit_issue_totals", """
SELECT r.id, r.total_issues, coalesce(s.n, 0) AS stored, coalesce(s.blank, 0)::BIGINT AS blank_fields FROM fx_inspection_runs r
LEFT JOIN (SELECT inspection_run_id, count(*) AS n, count_if(trim(error_field) = '') AS blank FROM fx_inspection_results GROUP BY 1) s ON s.inspection_run_id = r.id
WHERE r.total_issues <> coalesce(s.n, 0) OR coalesce(s.blank, 0) > 0
""")
def _audit_issue_totals(spark, sf_dir):
    return history.issue_total_violations(_runs(spark, sf_dir), INSPECTION_RESULTS.frame(spark, sf_dir))


_PAGE_FILTER = """FROM fx_inspection_runs WHERE contains(lower(source_filename), 'spring_') AND error_count = 0 AND warning_count > 0
  AND created_at >= TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 9 HOUR AND created_at < TIMESTAMP '2024-01-07 00:00:00' - INTERVAL 9 HOUR"""


def _filtered_runs(spark, sf_dir) -> DataFrame:
    return history.filter_inspections(
        _runs(spark, sf_dir), " Spring_ ", dt.date(2024, 1, 2), dt.date(2024, 1, 6), "warning"
    )


@query("history_page", f"SELECT id, source_filename, {duck_stamp('created_at')}, total_issues {_PAGE_FILTER} ORDER BY fx_inspection_runs.created_at DESC, id DESC LIMIT 20 OFFSET 5")
def _history_page(spark, sf_dir):
    paged = history.page(_filtered_runs(spark, sf_dir), 20, 5)
    return paged.select("id", "source_filename", stamp("created_at"), "total_issues")


@query("history_total", f"SELECT count(*) AS total {_PAGE_FILTER}")
def _history_total(spark, sf_dir):
    return _filtered_runs(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"))


@query("history_detail", """
SELECT s.id, s.product_id, s.status, s.error_field, s.reason, r.source_filename, r.total_issues
FROM fx_inspection_results s JOIN fx_inspection_runs r ON r.id = s.inspection_run_id WHERE r.id = 77
""")
def _history_detail(spark, sf_dir):
    detail = history.inspection_detail(_runs(spark, sf_dir), INSPECTION_RESULTS.frame(spark, sf_dir), 77)
    return detail.select("id", "product_id", "status", "error_field", "reason", "source_filename", "total_issues")


@query("dedupe_inspections", """
SELECT id, file_sha256, inspection_version FROM fx_inspection_runs r WHERE id % 10 <> 0 AND file_sha256 IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM fx_inspection_runs k WHERE k.id % 10 = 0 AND k.file_sha256 = r.file_sha256 AND k.inspection_version = r.inspection_version)
  AND NOT EXISTS (SELECT 1 FROM fx_inspection_runs e WHERE e.id % 10 <> 0 AND e.id < r.id AND e.file_sha256 = r.file_sha256 AND e.inspection_version = r.inspection_version)
UNION ALL SELECT id, file_sha256, inspection_version FROM fx_inspection_runs WHERE id % 10 <> 0 AND file_sha256 IS NULL
""")
def _dedupe_inspections(spark, sf_dir):
    """Every tenth run is known, all others arrive: what has to be inspected (a file without a hash always is)."""
    runs = _runs(spark, sf_dir)
    arrivals = runs.where("id % 10 <> 0").select("id", "file_sha256", "inspection_version")
    known = runs.where("id % 10 = 0")
    hashed = new_arrivals(arrivals.where("file_sha256 IS NOT NULL"), known, ["file_sha256", "inspection_version"], ["id"])
    return hashed.select(*arrivals.columns).unionByName(arrivals.where("file_sha256 IS NULL"))


# --- batches ---


def _batches(spark, sf_dir) -> DataFrame:
    return LOAD_RUNS.frame(spark, sf_dir)


@query("batch_page", f"""
SELECT id, source_filename, profile_name, {duck_stamp('created_at')} FROM fx_load_runs
WHERE contains(lower(source_filename), 'feed%') AND contains(lower(profile_name), 'mac') ORDER BY fx_load_runs.created_at DESC, id DESC LIMIT 20 OFFSET 10
""")
def _batch_page(spark, sf_dir):
    kept = history.filter_batches(_batches(spark, sf_dir), "FEED%", "mac")
    return history.page(kept, 20, 10).select("id", "source_filename", "profile_name", stamp("created_at"))


VIEWS["v_file_rows"] = "SELECT o_orderkey AS id, o_custkey AS load_run_id, 'P' || CAST(o_orderkey AS VARCHAR) AS product_id FROM orders"


def _file_rows(spark, sf_dir) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("load_run_id"),
        F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("product_id"),
    )


@query("batch_detail", """
SELECT s.id, s.product_id, r.source_filename, r.profile_name FROM v_file_rows s JOIN fx_load_runs r ON r.id = s.load_run_id
WHERE r.id = 42 ORDER BY s.id LIMIT 50 OFFSET 2
""")
def _batch_detail(spark, sf_dir):
    rows = history.batch_products(_batches(spark, sf_dir), _file_rows(spark, sf_dir), 42)
    return history.page(rows, 50, 2, [F.col("id")]).select("id", "product_id", "source_filename", "profile_name")


_QUALITY = "FROM fx_load_runs WHERE total_rows IS NOT NULL"


@query("quality_summary", f"""
SELECT *, batch_count - quality_batch_count AS no_quality_batch_count, CASE WHEN total_rows = 0 THEN 0.0 ELSE round_even(rejected_rows / total_rows * 100, 2) END::DOUBLE AS rejection_rate
FROM (SELECT count(*) AS batch_count, count(total_rows) AS quality_batch_count,
  coalesce(sum(total_rows), 0)::BIGINT AS total_rows, coalesce(sum(loaded_rows) FILTER (WHERE total_rows IS NOT NULL), 0)::BIGINT AS loaded_rows,
  coalesce(sum(rejected_rows), 0)::BIGINT AS rejected_rows FROM fx_load_runs WHERE contains(lower(profile_name), 'u'))
""")
def _quality_summary(spark, sf_dir):
    return history.quality_summary(_batches(spark, sf_dir), "U")


def _rate(prefix: str = "") -> str:
    return f"CAST(round_even({prefix}rejected_rows / {prefix}total_rows * 100, 2) AS DOUBLE)"


@query("quality_trend", f"""
SELECT id, {duck_stamp('created_at')}, total_rows, loaded_rows, rejected_rows, {_rate()} AS rejection_rate {_QUALITY}
ORDER BY fx_load_runs.created_at DESC, id DESC LIMIT 10
""")
def _quality_trend(spark, sf_dir):
    trend = history.quality_trend(_batches(spark, sf_dir), 10)
    return trend.select("id", stamp("created_at"), "total_rows", "loaded_rows", "rejected_rows", "rejection_rate")


VIEWS["v_ranked"] = f"""
SELECT *, {_rate()} AS rate, row_number() OVER (PARTITION BY profile_name ORDER BY created_at DESC, id DESC) AS place {_QUALITY}
"""


@query("quality_delta", """
SELECT l.profile_name, l.id AS latest_id, p.id AS previous_id, l.rate AS latest_rate, p.rate AS previous_rate,
  CAST(round_even(l.rate - p.rate, 2) AS DOUBLE) AS rate_delta,
  CASE WHEN p.id IS NULL THEN 'no_baseline' WHEN l.rate < p.rate THEN 'improved' WHEN l.rate > p.rate THEN 'worsened' ELSE 'unchanged' END AS direction
FROM v_ranked l LEFT JOIN v_ranked p ON p.profile_name = l.profile_name AND p.place = 2 WHERE l.place = 1
""")
def _quality_delta(spark, sf_dir):
    return history.quality_delta(_batches(spark, sf_dir))


@query("quality_error_codes", """
SELECT r.profile_name, e.code, sum(e.n)::BIGINT AS total_count, count(*) AS batch_count FROM v_ranked r JOIN fx_run_errors e USING (id)
WHERE r.place <= 10 AND trim(e.code) <> '' AND e.n >= 1 GROUP BY 1, 2
""")
def _quality_error_codes(spark, sf_dir):
    return history.error_code_totals(_batches(spark, sf_dir), 10)


@query("quality_profiles", f"SELECT DISTINCT profile_name {_QUALITY}")
def _quality_profiles(spark, sf_dir):
    return history.quality_profiles(_batches(spark, sf_dir))


@query("batch_load_rate", """
SELECT id, total_rows, loaded_rows, CASE WHEN total_rows > 0 THEN CAST(round_even(loaded_rows / total_rows * 100, 1) AS DOUBLE) END AS load_rate FROM fx_load_runs
""")
def _batch_load_rate(spark, sf_dir):
    return history.load_rates(_batches(spark, sf_dir))


@query("batch_error_table", "SELECT id, code, n FROM fx_run_errors")
def _batch_error_table(spark, sf_dir):
    return history.error_table(_batches(spark, sf_dir))


_TOKEN = d.collapse("size")


@query("unknown_sizes", f"""
SELECT arg_min(token, lower(token) || chr(1) || token) AS token, sum(n)::BIGINT AS count FROM (
  SELECT {_TOKEN} AS token, count(*) AS n FROM fx_catalog GROUP BY size)
WHERE token <> '' AND NOT EXISTS (SELECT 1 FROM v_sizes z WHERE z.alias = {d.alias_key('token')}) AND NOT regexp_full_match(replace(token, ' ', ''), '[0-9]+')
GROUP BY lower(token) ORDER BY count DESC, lower(token) LIMIT 2
""")
def _unknown_sizes(spark, sf_dir):
    return history.unknown_sizes(CATALOG.frame(spark, sf_dir), 2)


# --- promotions, rollbacks, attempts ---


@query("promotion_page", f"""
SELECT p.id, p.load_run_id, r.source_filename, p.status, p.inserted_count, strftime(p.created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM fx_promotion_runs p JOIN fx_load_runs r ON r.id = p.load_run_id WHERE p.status = 'succeeded' AND contains(lower(r.profile_name), 'building')
ORDER BY p.created_at DESC, p.id DESC LIMIT 20
""")
def _promotion_page(spark, sf_dir):
    runs = FIXTURES["fx_promotion_runs"].frame(spark, sf_dir)
    kept = history.promotion_history(runs, _batches(spark, sf_dir), status="succeeded", profile_name="building")
    return history.page(kept, 20).select(
        "id", "load_run_id", "source_filename", "status", "inserted_count", stamp("created_at")
    )


@query("rollback_page", f"""
SELECT id, target_promotion_run_id, status, restored_count, deleted_count, conflict_count, {duck_stamp('created_at')} FROM fx_rollback_runs
WHERE status = 'blocked' ORDER BY fx_rollback_runs.created_at DESC, id DESC LIMIT 20
""")
def _rollback_page(spark, sf_dir):
    kept = history.rollback_history(FIXTURES["fx_rollback_runs"].frame(spark, sf_dir), status="blocked")
    return history.page(kept, 20).select(
        "id", "target_promotion_run_id", "status", "restored_count", "deleted_count", "conflict_count", stamp("created_at")
    )


_ROLLBACK_CHANGES = """SELECT l_orderkey * 10 + l_linenumber AS id, 2 * l_suppkey AS rollback_run_id, l_partkey AS original_change_id,
  CASE WHEN l_linenumber % 3 = 0 THEN 'delete' ELSE 'restore' END AS action, l_orderkey % 1000 AS minute FROM {0}"""
VIEWS["v_rollback_log"] = _ROLLBACK_CHANGES.format("lineitem")


def _rollback_changes(spark, sf_dir) -> DataFrame:
    return spark.sql(_ROLLBACK_CHANGES.format("{lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


@query("rollback_detail", """
SELECT r.id, r.target_promotion_run_id, r.status, r.conflict_count, p.status AS promotion_status, p.load_run_id AS promoted_load_run_id,
  count(c.id) AS changes, count(CASE WHEN c.action = 'restore' THEN 1 END) AS logged_restores, count(CASE WHEN c.action = 'delete' THEN 1 END) AS logged_deletes
FROM fx_rollback_runs r LEFT JOIN fx_promotion_runs p ON p.id = r.target_promotion_run_id LEFT JOIN v_rollback_log c ON c.rollback_run_id = r.id GROUP BY ALL
""")
def _rollback_detail(spark, sf_dir):
    detail = history.rollback_detail(
        FIXTURES["fx_rollback_runs"].frame(spark, sf_dir), FIXTURES["fx_promotion_runs"].frame(spark, sf_dir), _rollback_changes(spark, sf_dir)
    )
    return detail.select("id", "target_promotion_run_id", "status", "conflict_count", "promotion_status", "promoted_load_run_id", "changes",
                         "logged_restores", "logged_deletes")


@query("rollback_change_pages", """
SELECT rollback_run_id, id, original_change_id, action, position, total FROM (
  SELECT *, row_number() OVER (PARTITION BY rollback_run_id ORDER BY minute DESC, id DESC, original_change_id DESC) AS position, count(*) OVER (PARTITION BY rollback_run_id) AS total FROM v_rollback_log)
WHERE position BETWEEN 11 AND 30
""")
def _rollback_change_pages(spark, sf_dir):
    """The second page of every run's changes, newest first."""
    pages_of = history.change_pages(_rollback_changes(spark, sf_dir), "rollback_run_id", [F.desc("minute"), F.desc("id"), F.desc("original_change_id")], 20, 10)
    return pages_of.select("rollback_run_id", "id", "original_change_id", "action", "position", "total")


VIEWS["v_attempts"] = """
SELECT a.*, f.attempt_id AS first_id, f.source_type AS first_type, f.source_ref AS first_ref,
  CASE WHEN a.failed THEN 'failed' WHEN a.attempt_id = f.attempt_id THEN 'created' ELSE 'duplicate' END AS outcome
FROM fx_attempts a LEFT JOIN (SELECT * FROM fx_attempts WHERE NOT failed
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY "at", attempt_id) = 1) f USING (user_id, event_type)
"""


def _resolved(spark, sf_dir) -> DataFrame:
    return resolve_attempts(
        ATTEMPTS.frame(spark, sf_dir), ["user_id", "event_type"], ["at", "attempt_id"], F.col("failed"), "attempt_id"
    )


@query("dedupe_loads", "SELECT attempt_id, user_id, event_type, outcome, first_id FROM v_attempts")
def _dedupe_loads(spark, sf_dir):
    return _resolved(spark, sf_dir).select(
        "attempt_id", "user_id", "event_type", "outcome", F.col("first.attempt_id").alias("first_id")
    )


@query("load_outcomes", """
SELECT outcome, count(*) AS attempts, coalesce(sum(total_rows - rejected_rows) FILTER (WHERE outcome = 'created'), 0)::BIGINT AS rows_loaded,
  coalesce(sum(rejected_rows) FILTER (WHERE outcome = 'created'), 0)::BIGINT AS rows_rejected FROM v_attempts GROUP BY 1
""")
def _load_outcomes(spark, sf_dir):
    return history.load_outcomes(_resolved(spark, sf_dir))


@query("duplicate_arrivals", """
SELECT attempt_id, first_id, first_type AS initial_source_type, source_type AS request_source_type, first_type = source_type AS same_source FROM v_attempts WHERE outcome = 'duplicate'
""")
def _duplicate_arrivals(spark, sf_dir):
    first = F.col("first.source_type")
    return _resolved(spark, sf_dir).where("outcome = 'duplicate'").select(
        "attempt_id", F.col("first.attempt_id").alias("first_id"), first.alias("initial_source_type"),
        F.col("source_type").alias("request_source_type"), (first == F.col("source_type")).alias("same_source"),
    )
