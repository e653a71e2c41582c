"""Queries on supplier feeds, batches, promotions and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalake.functions import vocabulary as v
from catalake.functions.profiles import FASHION, MARKETPLACE, changed_profiles, profile_rows
from catalake.operators import conform as cf
from catalake.operators import history, invariants, promote, scan
from catalake.operators.inspect import inspect
from catalake.plans import ducksql as d
from catalake.plans.fixtures import BATCHES, CATALOG, FEED_A, FEED_B, FIXTURES, LOAD_RUNS, STAGING
from catalake.plans.registry import VIEWS, query
from catalake.sources import feeds, lineage
from catalake.sources.recorded import recorded
from catalake.streaming import landing

PLACE = ["file_id", "source_row_number"]


def _conformed(spark, sf_dir, which: str = "a") -> DataFrame:
    fixture, profile = (FEED_A, FASHION) if which == "a" else (FEED_B, MARKETPLACE)
    return cf.conform(fixture.frame(spark, sf_dir), profile, PLACE)


def _duck_conform(fixture: str, profile) -> str:
    """Mapping, parsing and errors written out for one profile."""
    target_of = {t: s for s, ts in profile.targets.items() for t in ts}
    value = {}
    for name in v.STANDARD_COLUMNS:
        source = d.strip(target_of[name])
        value[name] = f"CASE WHEN {source} <> '' THEN {source} ELSE '{profile.defaults[name]}' END" if name in profile.defaults else source
    inner = ", ".join(f"{expr} AS {name}" for name, expr in value.items())
    sources = ", ".join(f"{d.strip(s)} AS src_{s}" for s in profile.sources)
    number = lambda x: d.number(d.strip("replace(replace(" + x + ", '₩', ''), ',', '')"))
    missing = []
    for s in profile.required:
        test = f"src_{s} = ''" + (" AND category <> 'BAG'" if profile.targets[s] == ("size",) else "")
        missing.append(f"CASE WHEN {test} THEN 'MISSING_SOURCE_VALUE/{s}/필수 공급사 값이 비어 있습니다: {s}' END")

    def bad(n: str, field: str, kind: str, label: str, unit: str) -> str:
        return (f"CASE WHEN {n} IS NULL THEN 'INVALID_{kind}/{field}/{label} 값을 {unit}로 변환할 수 없습니다.' "
                f"WHEN {n} < 0 THEN 'NEGATIVE_{kind}/{field}/{label}은 음수일 수 없습니다.' END")

    price = bad("price_n", "price", "PRICE", "가격", "숫자")
    sale = f"CASE WHEN sale_price <> '' THEN {bad('sale_n', 'sale_price', 'PRICE', '가격', '숫자')} END"
    stock = bad("stock_n", "stock", "STOCK", "재고", "정수").replace("재고은", "재고는")
    stock = stock.replace("가격 값", "가격 값")
    errors = ", ".join([*missing, "CASE WHEN product_id = '' THEN 'MISSING_PRODUCT_ID/product_id/상품 ID가 비어 있습니다.' END", price, sale, stock])
    return f"""
SELECT *, array_to_string(list_filter([{errors}], lambda e: e IS NOT NULL), ';') AS errors FROM (
  SELECT *, {number('price')} AS price_n, {number('sale_price')} AS sale_n, {d.number('stock')} AS stock_n FROM (
    SELECT file_id, source_row_number, {inner}, {sources} FROM {fixture}))
"""


VIEWS["v_conform_a"] = _duck_conform("fx_feed_a", FASHION)
VIEWS["v_conform_b"] = _duck_conform("fx_feed_b", MARKETPLACE)
_TEXT_COLUMNS = [c for c in v.STANDARD_COLUMNS if c not in ("price", "sale_price", "stock")]
_NORMAL = ", ".join(_TEXT_COLUMNS) + ", CAST(price_n AS VARCHAR) AS price, coalesce(CAST(sale_n AS VARCHAR), '') AS sale_price, CAST(stock_n AS VARCHAR) AS stock"


@query("conform_map", f"SELECT file_id, source_row_number, {', '.join(_TEXT_COLUMNS)}, price, stock FROM v_conform_b")
def _conform_map(spark, sf_dir):
    rows = FEED_B.frame(spark, sf_dir)
    mapped = cf.map_columns(rows, MARKETPLACE, PLACE)
    return mapped.select(*PLACE, *_TEXT_COLUMNS, "price", "stock")


@query("conform_price", "SELECT file_id, source_row_number, price, price_n, sale_n FROM v_conform_a")
def _conform_price(spark, sf_dir):
    mapped = cf.map_columns(FEED_A.frame(spark, sf_dir), FASHION, PLACE)
    return mapped.select(
        *PLACE, "price", cf.price_number(F.col("price")).alias("price_n"),
        cf.price_number(F.col("sale_price")).alias("sale_n"),
    )


@query("conform_accepted", f"SELECT file_id, source_row_number, {_NORMAL} FROM v_conform_a WHERE errors = ''")
def _conform_accepted(spark, sf_dir):
    return cf.accepted(_conformed(spark, sf_dir))


def _joined_errors(rows: DataFrame) -> DataFrame:
    text = F.transform("errors", lambda e: F.concat_ws("/", e["code"], e["field"], e["message"]))
    return rows.select(*PLACE, F.array_join(text, ";").alias("errors"))


@query("conform_rejected", "SELECT file_id, source_row_number, errors FROM v_conform_a WHERE errors <> ''")
def _conform_rejected(spark, sf_dir):
    return _joined_errors(cf.rejected(_conformed(spark, sf_dir), PLACE))


@query("conform_rejected_marketplace", "SELECT file_id, source_row_number, errors FROM v_conform_b WHERE errors <> ''")
def _conform_rejected_b(spark, sf_dir):
    return _joined_errors(cf.rejected(_conformed(spark, sf_dir, "b"), PLACE))


VIEWS["v_codes"] = "SELECT file_id, split_part(e, '/', 1) AS code FROM (SELECT file_id, unnest(string_split(errors, ';')) AS e FROM v_conform_a WHERE errors <> '')"


@query("batch_error_counts", "SELECT file_id, code, count(*) AS n FROM v_codes GROUP BY 1, 2")
def _batch_error_counts(spark, sf_dir):
    summary = cf.batch_summary(_conformed(spark, sf_dir), ["file_id"])
    return summary.select("file_id", F.explode("error_counts").alias("code", "n"))


@query("batch_summary", "SELECT file_id, count(*) AS total_rows, count_if(errors = '')::BIGINT AS loaded_rows, count_if(errors <> '')::BIGINT AS rejected_rows FROM v_conform_a GROUP BY 1")
def _batch_summary(spark, sf_dir):
    return cf.batch_summary(_conformed(spark, sf_dir), ["file_id"]).drop("error_counts")


@query("audit_summary", """
SELECT r.id, violation FROM (SELECT r.id, unnest([
  CASE WHEN rejected_rows = 0 AND e.n > 0 THEN 'errors_without_rejects' END,
  CASE WHEN rejected_rows > 0 AND coalesce(e.total, 0) < rejected_rows THEN 'too_few_errors' END,
  CASE WHEN e.blank > 0 THEN 'blank_error_code' END, CASE WHEN e.low < 1 THEN 'non_positive_error_count' END]) AS violation
  FROM fx_load_runs r LEFT JOIN (SELECT id, count(*) AS n, sum(n) AS total, count_if(trim(code) = '') AS blank, min(n) AS low FROM fx_run_errors GROUP BY id) e ON e.id = r.id) r
WHERE violation IS NOT NULL
""")
def _audit_summary(spark, sf_dir):
    return cf.summary_violations(LOAD_RUNS.frame(spark, sf_dir))


# Rows for the staging check: the raw feed, mapped but not split, so bad rows are still there.
@query("staging_admission", f"""
SELECT file_id, count(*) AS row_count, count_if(bad)::BIGINT AS bad_rows, count_if(bad) = 0 AS admitted FROM (
  SELECT file_id, coalesce(product_group_id = '' OR product_id = '' OR product_name = '' OR category = '' OR color = '' OR image_path = '' OR (size = '' AND category <> 'BAG')
    OR s IS NULL OR s < 0 OR p IS NULL OR p < 0 OR (sale_price <> '' AND (q IS NULL OR q < 0)), TRUE) AS bad
  FROM (SELECT *, {d.number("replace(stock, ',', '')")} AS s, {d.number("replace(price, ',', '')")} AS p, {d.number("replace(sale_price, ',', '')")} AS q FROM v_conform_a)) GROUP BY 1
""")
def _staging_admission(spark, sf_dir):
    mapped = cf.map_columns(FEED_A.frame(spark, sf_dir), FASHION, PLACE)
    return cf.staging_admission(mapped.select(*PLACE, *v.STANDARD_COLUMNS), ["file_id"])


def _damaged_rejects(spark, sf_dir) -> DataFrame:
    """Refused rows with defects put in by row number: code case, a lost message, a repeated and a low row number."""
    rows = cf.rejected(_conformed(spark, sf_dir), PLACE)
    n = F.col("source_row_number")
    return rows.select(
        "file_id",
        F.when(n % 97 == 0, F.lit(1)).when(n % 89 == 0, n - n % 2).otherwise(n).cast("bigint").alias("source_row_number"),
        F.when(n % 31 == 0, F.transform("error_code", lambda c: F.lower(c))).otherwise(F.col("error_code")).alias("error_code"),
        "error_field",
        F.when(n % 37 == 0, F.slice("error_message", 2, 100)).otherwise(F.col("error_message")).alias("error_message"),
    )


VIEWS["v_damaged"] = """
SELECT file_id, CASE WHEN n % 97 = 0 THEN 1 WHEN n % 89 = 0 THEN n - n % 2 ELSE n END AS row_number, n % 31 = 0 AS lower_code, n % 37 = 0 AS lost, len(string_split(errors, ';')) AS k
FROM (SELECT file_id, source_row_number AS n, errors FROM v_conform_a WHERE errors <> '')
"""


@query("audit_rejects", """
SELECT file_id, row_number AS source_row_number, 'row_number_too_small' AS violation FROM v_damaged WHERE row_number < 2
UNION ALL SELECT file_id, row_number, 'bad_code' FROM v_damaged WHERE lower_code
UNION ALL SELECT file_id, row_number, 'length_mismatch' FROM v_damaged WHERE lost
UNION ALL SELECT file_id, row_number, 'no_errors' FROM v_damaged WHERE lost AND k = 1
UNION ALL SELECT file_id, row_number, 'repeated_row_number' FROM v_damaged GROUP BY 1, 2 HAVING count(*) > 1
""")
def _audit_rejects(spark, sf_dir):
    return cf.reject_violations(_damaged_rejects(spark, sf_dir), ["file_id"])


@query("audit_reject_counts", """
SELECT file_id, rejected_rows, stored FROM (SELECT file_id, count_if(errors <> '')::BIGINT AS rejected_rows, count_if(errors <> '' AND source_row_number % 50 <> 0)::BIGINT AS stored FROM v_conform_a GROUP BY 1)
WHERE rejected_rows <> stored
""")
def _audit_reject_counts(spark, sf_dir):
    conformed = _conformed(spark, sf_dir)
    kept = cf.rejected(conformed, PLACE).where(F.col("source_row_number") % 50 != 0)
    return cf.reject_count_violations(kept, cf.batch_summary(conformed, ["file_id"]), ["file_id"])


@query("mask_reject_map", r"""
SELECT file_id, source_row_number, regexp_replace(regexp_replace(src_description_text, '(010)-[0-9]{4}-([0-9]{4})', '\1-****-\2'), '계좌 (1234-56)-[0-9]{3}([0-9]{3})', '계좌 123-***-***\2') AS description_text
FROM v_conform_a WHERE errors <> ''
""")
def _mask_reject_map(spark, sf_dir):
    rows = cf.rejected(_conformed(spark, sf_dir), PLACE)
    masked = rows.select(*PLACE, scan.mask_source_map(F.col("source")).alias("source"))
    return masked.select(*PLACE, F.try_element_at("source", F.lit("description_text")).alias("description_text"))


@query("batch_rejects", """
SELECT r.id AS load_run_id, r.reject_details_stored AS available, c.source_row_number FROM fx_load_runs r
LEFT JOIN (SELECT * FROM v_conform_a WHERE errors <> '') c ON c.file_id = r.id AND r.reject_details_stored
WHERE NOT r.reject_details_stored OR c.file_id IS NOT NULL
""")
def _batch_rejects(spark, sf_dir):
    rows = cf.rejected(_conformed(spark, sf_dir), PLACE).withColumnRenamed("file_id", "load_run_id")
    found = history.batch_rejections(LOAD_RUNS.frame(spark, sf_dir), rows)
    return found.select("load_run_id", "available", "source_row_number")


@query("reject_flat", """
SELECT file_id AS load_run_id, source_row_number, array_to_string(list_transform(string_split(errors, ';'), lambda e: split_part(e, '/', 1)), ', ') AS codes,
  array_to_string(list_transform(string_split(errors, ';'), lambda e: split_part(e, '/', 2)), ', ') AS fields,
  array_to_string(list_transform(string_split(errors, ';'), lambda e: split_part(e, '/', 3)), ', ') AS messages FROM v_conform_a WHERE errors <> ''
""")
def _reject_flat(spark, sf_dir):
    rows = cf.rejected(_conformed(spark, sf_dir), PLACE).withColumnRenamed("file_id", "load_run_id")
    return history.flat_rejections(rows)


# --- feed files ---

_HEADER = [c for c in FASHION.sources]


_LIMITS = feeds.Limits(max_bytes=400_000, max_rows=500)


def _files(spark, sf_dir) -> DataFrame:
    """Feed files put together from the feed rows (at most 500 rows a file); twelve of forty are damaged in some way."""
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    line = F.concat_ws(",", *[quote(F.col(name)) for name in _HEADER])
    body = FEED_A.frame(spark, sf_dir).groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct("source_row_number", line.alias("line")))).alias("lines")
    )
    k, names = F.col("file_id") % 40, ",".join(_HEADER)
    header = (
        F.when(k == 3, F.lit(names.replace("colour", " ")))
        .when(k == 4, F.lit(names.replace("colour", "Item_Name")))
        .when(k == 5, F.lit(names.replace("colour", "tint")))
        .otherwise(F.lit(names))
    )
    text = F.concat(header, F.lit("\n"), F.array_join("lines.line", "\n"), F.when(k == 6, F.lit("\n1,2")).otherwise(F.lit("\n,,\n")))
    text = F.when(k == 7, header).when(k == 8, F.lit(" \n")).when(k == 9, F.concat(text, F.lit("\x00"))).otherwise(text)
    many = F.concat(header, F.lit("\n"), F.array_join(F.array_repeat(F.lit(",".join(["1"] * len(_HEADER))), 501), "\n"))
    content = (
        F.when(k == 1, F.lit("").cast("binary")).when(k == 10, F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit("FFFEFF80"))))
        .when(k == 11, F.encode(many, "UTF-8"))
        .when(k == 12, F.encode(F.concat(text, F.repeat(F.lit(" "), 400_000)), "UTF-8")).otherwise(F.encode(text, "UTF-8"))
    )
    path = F.concat(F.lit("/landing/feed-"), F.col("file_id").cast("string"), F.when(k == 2, F.lit(".txt")).otherwise(F.lit(".CSV")))
    return body.select(path.alias("path"), F.length(content).cast("bigint").alias("length"), content.alias("content"))


_VERDICT = "CASE file_id % 40 " + " ".join(
    f"WHEN {i} THEN '{s}'" for i, s in enumerate(
        ("empty_file", "bad_extension", "blank_header", "duplicate_header", "missing_columns", "ragged_row", "no_rows",
         "blank_text", "nul_byte", "undecodable", "too_many_rows", "too_large"), start=1)
) + " ELSE 'ok' END"
_DETAIL = """CASE file_id % 40 WHEN 4 THEN 'item_name' WHEN 5 THEN 'colour' WHEN 6 THEN CAST(n + 2 AS VARCHAR) WHEN 11 THEN '501' ELSE '' END"""


@query("admit_feeds", f"""
SELECT '/landing/feed-' || file_id || CASE WHEN file_id % 40 = 2 THEN '.txt' ELSE '.CSV' END AS path, {_VERDICT} AS status, {_DETAIL} AS detail
FROM (SELECT file_id, count(*) AS n FROM fx_feed_a GROUP BY 1)
""")
def _admit_feeds(spark, sf_dir):
    return feeds.admit_feeds(_files(spark, sf_dir), FASHION.required, _LIMITS)


@query("feed_rows", "SELECT '/landing/feed-' || file_id || '.CSV' AS path, source_row_number, vendor_sku, item_name, list_price FROM fx_feed_a WHERE file_id % 40 NOT BETWEEN 1 AND 12")
def _feed_rows(spark, sf_dir):
    rows = feeds.feed_rows(_files(spark, sf_dir), FASHION.required, _LIMITS)
    return feeds.widened(rows, ("vendor_sku", "item_name", "list_price"), ["path", "source_row_number"])


@query("content_sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _content_sha256(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents.select("doc_id", lineage.content_sha256(F.col("text").cast("binary")).alias("sha256"))


_LEAF = r"trim(regexp_extract(rtrim(replace(trim(path), chr(92), '/'), '/'), '([^/]*)$', 1))"


@query("leaf_filename", rf"""
SELECT page_id, CASE WHEN n = '' THEN 'uploaded.csv' WHEN length(n) <= 255 THEN n WHEN sfx <> '' THEN left(n, 255 - length(sfx)) || sfx ELSE left(n, 255) END AS name
FROM (SELECT page_id, n, regexp_extract(n, '^.+(\.[^.]+)$', 1) AS sfx FROM (SELECT page_id, {_LEAF} AS n FROM fx_paths))
""")
def _leaf_filename(spark, sf_dir):
    return FIXTURES["fx_paths"].frame(spark, sf_dir).select(
        "page_id", lineage.stored_file_name(F.col("path")).alias("name")
    )


@query("source_lineage", f"""
SELECT page_id, source_type, source_type IN ('unknown', 'upload', 's3', 'http_feed', 'cli') AS source_type_ok,
  left(nullif(CASE source_type WHEN 's3' THEN ltrim(CASE WHEN starts_with(k, 'feeds/in/') THEN substr(k, 10) ELSE k END, '/') WHEN 'http_feed' THEN 'configured_http_feed' ELSE {_LEAF} END, ''), 255) AS source_ref
FROM (SELECT *, trim(replace(path, chr(92), '/')) AS k FROM fx_paths)
""")
def _source_lineage(spark, sf_dir):
    arrivals = FIXTURES["fx_paths"].frame(spark, sf_dir)
    return lineage.with_lineage(arrivals, "feeds/in/").drop("path")


# --- reconcile and promote ---


def _staging(spark, sf_dir) -> DataFrame:
    return STAGING.frame(spark, sf_dir)


def _catalog(spark, sf_dir) -> DataFrame:
    return CATALOG.frame(spark, sf_dir)


VIEWS["v_dup_identity"] = "SELECT load_run_id, product_id AS external_product_id, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM fx_staging GROUP BY 1, 2 HAVING count(*) > 1"


@query("batch_dup_identity", "SELECT * FROM v_dup_identity")
def _batch_dup_identity(spark, sf_dir):
    return promote.repeated_identities(_staging(spark, sf_dir))


@query("batch_dup_identity_rows", "SELECT s.load_run_id, s.product_id AS external_product_id, s.id, x.n FROM fx_staging s JOIN v_dup_identity x ON x.load_run_id = s.load_run_id AND x.external_product_id = s.product_id")
def _batch_dup_identity_rows(spark, sf_dir):
    return promote.repeated_identity_rows(_staging(spark, sf_dir))


_DIFFS = ", ".join(
    f"CASE WHEN s.{name} IS DISTINCT FROM c.{name} THEN {{'field': '{name}', 'before': CAST(c.{name} AS VARCHAR), 'after': CAST(s.{name} AS VARCHAR)}} END"
    for name in v.COMPARED_FIELDS
)
VIEWS["v_staged"] = "SELECT *, product_id AS external_product_id FROM fx_staging WHERE load_run_id NOT IN (SELECT load_run_id FROM v_dup_identity)"
VIEWS["v_items"] = f"""
SELECT s.supplier_key, s.external_product_id, s.load_run_id, c.external_product_id IS NOT NULL AS known,
  CASE WHEN c.external_product_id IS NULL THEN [] ELSE list_filter([{_DIFFS}], lambda x: x IS NOT NULL) END AS diffs
FROM v_staged s LEFT JOIN fx_catalog c USING (supplier_key, external_product_id)
"""
VIEWS["v_reconcile"] = """
SELECT load_run_id, supplier_key, external_product_id, CASE WHEN NOT known THEN 'new' WHEN len(diffs) > 0 THEN 'changed' ELSE 'unchanged' END AS status, diffs FROM v_items
UNION ALL SELECT b.load_run_id, c.supplier_key, c.external_product_id, 'not_observed_in_batch', []
FROM fx_catalog c JOIN (SELECT DISTINCT supplier_key, load_run_id FROM v_staged) b ON b.supplier_key = c.supplier_key
WHERE NOT EXISTS (SELECT 1 FROM v_staged s WHERE s.load_run_id = b.load_run_id AND s.supplier_key = c.supplier_key AND s.external_product_id = c.external_product_id)
"""


def _items(spark, sf_dir) -> DataFrame:
    return promote.reconcile(_staging(spark, sf_dir), _catalog(spark, sf_dir))


@query("reconcile_items", "SELECT load_run_id, supplier_key, external_product_id, status, array_to_string(list_sort(list_transform(diffs, lambda x: x.field)), ',') AS fields FROM v_reconcile")
def _reconcile_items(spark, sf_dir):
    fields = F.array_join(F.array_sort(F.map_keys("changed_fields")), ",")
    return _items(spark, sf_dir).select("load_run_id", *promote.IDENTITY, "status", fields.alias("fields"))


@query("reconcile_counts", "SELECT load_run_id, supplier_key, status, count(*) AS n FROM v_reconcile GROUP BY ALL")
def _reconcile_counts(spark, sf_dir):
    return promote.reconcile_counts(_items(spark, sf_dir))


@query("reconcile_fields", "SELECT load_run_id, supplier_key, x.field AS field, count(*) AS n FROM (SELECT load_run_id, supplier_key, unnest(diffs) AS x FROM v_reconcile) GROUP BY ALL")
def _reconcile_fields(spark, sf_dir):
    return promote.field_changes(_items(spark, sf_dir))


@query("reconcile_page", """
SELECT external_product_id, status FROM v_reconcile WHERE load_run_id = 12
ORDER BY CASE status WHEN 'new' THEN 0 WHEN 'changed' THEN 1 WHEN 'unchanged' THEN 2 ELSE 3 END, external_product_id LIMIT 50 OFFSET 10
""")
def _reconcile_page(spark, sf_dir):
    own = _items(spark, sf_dir).where("load_run_id = 12")
    order = [promote.status_order(F.col("status")), F.col("external_product_id")]
    return history.page(own, 50, 10, order).select("external_product_id", "status")


def _preview(spark, sf_dir) -> DataFrame:
    return promote.preview(_staging(spark, sf_dir), _catalog(spark, sf_dir))


_ACTION = "CASE WHEN NOT known THEN 'insert' WHEN len(diffs) > 0 THEN 'update' ELSE 'unchanged' END"


@query("promotion_preview", f"SELECT supplier_key, external_product_id, load_run_id, {_ACTION} AS action FROM v_items")
def _promotion_preview(spark, sf_dir):
    return _preview(spark, sf_dir).select(*promote.IDENTITY, "load_run_id", "action")


VIEWS["v_flat_preview"] = f"""
SELECT supplier_key, external_product_id, 'update' AS action, x.field AS field, coalesce(x.before, '-') AS before, coalesce(x.after, '-') AS after
FROM (SELECT *, unnest(diffs) AS x FROM v_items WHERE known)
UNION ALL SELECT supplier_key, external_product_id, {_ACTION}, CASE WHEN known THEN '-' ELSE '상품 전체' END, CASE WHEN known THEN '변경 없음' ELSE '-' END, CASE WHEN known THEN '변경 없음' ELSE '신규 등록' END
FROM v_items WHERE len(diffs) = 0
"""


@query("promotion_preview_flat", "SELECT * FROM v_flat_preview")
def _promotion_preview_flat(spark, sf_dir):
    return promote.flat_preview(_preview(spark, sf_dir))


def _length_text(alias: str) -> str:
    fields = ["external_product_id", *v.COMPARED_FIELDS]
    return " || '|' || ".join(
        f"coalesce(CAST(length(CAST({alias}.{f} AS VARCHAR)) AS VARCHAR) || ':' || CAST({alias}.{f} AS VARCHAR), '-')" for f in fields
    )


VIEWS["v_digests"] = f"""
SELECT s.load_run_id, s.supplier_key, sha256(({_length_text('s')}) || chr(10) || CASE WHEN c.external_product_id IS NULL THEN 'none' ELSE {_length_text('c')} END) AS h
FROM v_staged s LEFT JOIN fx_catalog c USING (supplier_key, external_product_id)
"""
_LANES = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))
VIEWS["v_hashes"] = f"""
SELECT load_run_id, supplier_key, sha256(concat_ws('|', '1', '13', CAST(load_run_id AS VARCHAR), supplier_key, CAST(count(*) AS VARCHAR), {_LANES})) AS preview_hash FROM v_digests GROUP BY 1, 2
"""


@query("preview_hash", "SELECT * FROM v_hashes")
def _preview_hash(spark, sf_dir):
    return promote.preview_hash(_preview(spark, sf_dir))


def staged_products(staging: DataFrame) -> DataFrame:
    """Staging rows as a typed catalog per batch, ready to inspect."""
    return staging.select(
        F.col("load_run_id").alias("catalog_id"), F.col("id").alias("row_index"), *v.REQUIRED_COLUMNS, "sale_price",
        F.col("sale_price").isNotNull().alias("sale_price_provided"),
        F.coalesce("description", F.lit("")).alias("description"), F.coalesce("seller", F.lit("")).alias("seller"),
    )


def _error_counts(spark, sf_dir) -> DataFrame:
    issues = inspect(staged_products(_staging(spark, sf_dir)))
    return issues.groupBy(F.col("catalog_id").alias("load_run_id")).agg(
        F.count_if(F.col("severity") == "error").alias("error_count")
    )


# Staged rows are clean but for errors that a plain query can find: blank size, duplicate id and equal options.
VIEWS["v_staged_errors"] = f"""
SELECT load_run_id, sum(n) AS error_count FROM (
  SELECT load_run_id, count(*) AS n FROM fx_staging WHERE size = '' AND category <> 'BAG' GROUP BY 1
  UNION ALL SELECT load_run_id, count(*) FROM fx_staging s WHERE EXISTS (SELECT 1 FROM fx_staging t WHERE t.load_run_id = s.load_run_id AND t.product_id = s.product_id AND t.id <> s.id) GROUP BY 1
  UNION ALL SELECT load_run_id, count(*) FROM fx_staging s WHERE (SELECT count(DISTINCT category) FROM fx_staging t WHERE t.load_run_id = s.load_run_id AND t.product_group_id = s.product_group_id) > 1 GROUP BY 1)
GROUP BY 1
"""
VIEWS["v_eligible"] = """
SELECT b.id, coalesce(s.n, 0) AS staged_rows, list_filter([
  CASE WHEN b.total_rows IS NULL OR b.rejected_rows IS NULL OR NOT b.has_error_counts THEN 'quality_summary_missing' END,
  CASE WHEN coalesce(b.rejected_rows, 0) > 0 OR b.has_reject_rows THEN 'etl_rejections_present' END,
  CASE WHEN s.n IS NULL THEN 'empty_staging_batch' END,
  CASE WHEN b.id IN (SELECT load_run_id FROM v_dup_identity) THEN 'duplicate_product_identity'
       WHEN e.error_count > 0 THEN 'inspection_errors_present' END], lambda x: x IS NOT NULL) AS reasons
FROM fx_batches b LEFT JOIN (SELECT load_run_id, count(*) AS n FROM fx_staging GROUP BY 1) s ON s.load_run_id = b.id
LEFT JOIN v_staged_errors e ON e.load_run_id = b.id
"""


def _eligible(spark, sf_dir) -> DataFrame:
    return promote.eligibility(BATCHES.frame(spark, sf_dir), _staging(spark, sf_dir), _error_counts(spark, sf_dir))


@query("promotion_eligibility", "SELECT id, staged_rows, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS eligible FROM v_eligible")
def _promotion_eligibility(spark, sf_dir):
    return _eligible(spark, sf_dir).withColumn("reasons", F.array_join("reasons", ","))


VIEWS["v_outcome"] = """
SELECT b.id, CASE WHEN b.id % 9 = 0 THEN 'succeeded' WHEN len(e.reasons) > 0 OR h.preview_hash IS NULL OR b.id % 5 = 0 THEN 'blocked' ELSE 'succeeded' END AS status,
  b.id % 9 <> 0 AS created, CASE WHEN b.id % 9 = 0 THEN NULL WHEN len(e.reasons) > 0 OR h.preview_hash IS NULL THEN 'promotion_blocked' WHEN b.id % 5 = 0 THEN 'preview_stale' END AS failure_code,
  CASE WHEN b.id % 9 <> 0 AND (len(e.reasons) > 0 OR h.preview_hash IS NULL OR b.id % 5 = 0) THEN e.staged_rows ELSE 0 END AS blocked_count
FROM fx_batches b JOIN v_eligible e ON e.id = b.id LEFT JOIN v_hashes h ON h.load_run_id = b.id
"""
VIEWS["v_chosen"] = """
SELECT * FROM (SELECT * FROM v_items WHERE load_run_id IN (SELECT id FROM v_outcome WHERE created AND status = 'succeeded')
  QUALIFY row_number() OVER (PARTITION BY supplier_key, external_product_id ORDER BY load_run_id DESC) = 1)
WHERE NOT known OR len(diffs) > 0
"""
_KEPT = ", ".join(f"CASE WHEN a.supplier_key IS NOT NULL THEN s.{n} ELSE c.{n} END AS {n}" for n in v.COMPARED_FIELDS)
VIEWS["v_applied"] = f"""
SELECT coalesce(c.supplier_key, a.supplier_key) AS supplier_key, coalesce(c.external_product_id, a.external_product_id) AS external_product_id, {_KEPT},
  CASE WHEN a.supplier_key IS NOT NULL THEN a.load_run_id ELSE c.source_load_run_id END AS source_load_run_id
FROM fx_catalog c FULL JOIN v_chosen a ON a.supplier_key = c.supplier_key AND a.external_product_id = c.external_product_id
LEFT JOIN v_staged s ON s.supplier_key = a.supplier_key AND s.external_product_id = a.external_product_id AND s.load_run_id = a.load_run_id
"""


def _outcome(spark, sf_dir) -> DataFrame:
    """Every batch is requested with its current hash, every fifth with an old one or none; every ninth succeeded before."""
    batches, hashes = BATCHES.frame(spark, sf_dir), promote.preview_hash(_preview(spark, sf_dir))
    requests = batches.select("id").join(hashes.select(F.col("load_run_id").alias("id"), "preview_hash"), "id", "left").select(
        "id", F.when(F.col("id") % 10 == 0, F.lit("old")).when(F.col("id") % 5 != 0, F.col("preview_hash")).alias("expected_hash")
    )
    return promote.outcomes(_eligible(spark, sf_dir), hashes, requests, batches.where("id % 9 = 0"))


@query("promotion_outcome", "SELECT * FROM v_outcome")
def _promotion_outcome(spark, sf_dir):
    return _outcome(spark, sf_dir)


_resolved: dict[tuple[str, str], DataFrame] = {}


def _promotion(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The outcome rows are recorded before anything is applied, as a promotion service does; they hold one row a batch."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _resolved:
        _resolved[key] = recorded(_outcome(spark, sf_dir), "outcomes")
    return promote.run_promotions(_preview(spark, sf_dir), _resolved[key])


@query("promotion_run", """
SELECT o.*, coalesce(c.inserted, 0)::BIGINT AS inserted_count, coalesce(c.updated, 0)::BIGINT AS updated_count FROM v_outcome o
LEFT JOIN (SELECT load_run_id AS id, count_if(NOT known) AS inserted, count_if(known) AS updated FROM v_chosen GROUP BY 1) c USING (id)
""")
def _promotion_run(spark, sf_dir):
    """Requests resolved and carried out: only what passes changes the catalog."""
    return _promotion(spark, sf_dir)[0]


@query("promotion_apply", "SELECT * FROM v_applied")
def _promotion_apply(spark, sf_dir):
    return promote.apply_promotion(_catalog(spark, sf_dir), _promotion(spark, sf_dir)[1])


_INSERTED = " UNION ALL ".join(
    f"SELECT s.load_run_id, s.supplier_key, s.external_product_id, 'insert' AS action, '{n}' AS field, NULL AS before, CAST(s.{n} AS VARCHAR) AS after FROM v_staged s JOIN v_chosen i USING (load_run_id, supplier_key, external_product_id) WHERE NOT i.known"
    for n in v.COMPARED_FIELDS
)
VIEWS["v_log"] = f"""
SELECT load_run_id, supplier_key, external_product_id, 'update' AS action, x.field AS field, x.before AS before, x.after AS after FROM (SELECT *, unnest(diffs) AS x FROM v_chosen WHERE known)
UNION ALL {_INSERTED}
"""


def _log(spark, sf_dir) -> DataFrame:
    return promote.change_log(_promotion(spark, sf_dir)[1])


@query("promotion_changelog", "SELECT * FROM v_log")
def _promotion_changelog(spark, sf_dir):
    return promote.flat_changes(_log(spark, sf_dir), ["load_run_id", *promote.IDENTITY])


@query("promotion_changes", "SELECT DISTINCT supplier_key, external_product_id, action FROM v_log WHERE load_run_id IN (2, 22) ORDER BY external_product_id DESC, supplier_key LIMIT 20")
def _promotion_changes(spark, sf_dir):
    log = _log(spark, sf_dir).where("load_run_id in (2, 22)")
    return history.page(log, 20, 0, [F.desc("external_product_id"), F.col("supplier_key")]).select(*promote.IDENTITY, "action")


@query("promotion_changes_flat", "SELECT load_run_id, external_product_id, action, field, coalesce(before, '-') AS before, coalesce(after, '-') AS after FROM v_log")
def _promotion_changes_flat(spark, sf_dir):
    flat = promote.flat_changes(_log(spark, sf_dir), ["load_run_id", "external_product_id"])
    return flat.withColumns({side: F.coalesce(side, F.lit("-")) for side in ("before", "after")})


# --- rollback: the promoted catalog, in some batches edited later on (k % 11) and partly deleted (k % 17) ---

_MOVED = "source_load_run_id % 17 = 0 AND source_load_run_id > 0"


def _later_catalog(spark, sf_dir) -> DataFrame:
    applied = promote.apply_promotion(_catalog(spark, sf_dir), _promotion(spark, sf_dir)[1])
    k, moved = F.substr("external_product_id", F.lit(2)).cast("bigint"), F.expr(_MOVED)
    return applied.where(~(moved & (k % 17 == 0))).withColumn("price", F.col("price") + F.when(moved & (k % 11 == 0), 1).otherwise(0))


VIEWS["v_later"] = f"SELECT * REPLACE (price + CASE WHEN {_MOVED} AND CAST(substr(external_product_id, 2) AS BIGINT) % 11 = 0 THEN 1 ELSE 0 END AS price) FROM v_applied WHERE NOT ({_MOVED} AND CAST(substr(external_product_id, 2) AS BIGINT) % 17 = 0)"
VIEWS["v_rollback"] = """
SELECT i.load_run_id, i.supplier_key, i.external_product_id, CASE WHEN i.known THEN 'restore' ELSE 'delete' END AS rollback_action, l.external_product_id IS NOT NULL AS present,
  i.load_run_id % 17 = 0 AND (CAST(substr(i.external_product_id, 2) AS BIGINT) % 11 = 0 OR CAST(substr(i.external_product_id, 2) AS BIGINT) % 17 = 0) AS conflict
FROM v_chosen i LEFT JOIN v_later l USING (supplier_key, external_product_id)
"""


def _rollback_items(spark, sf_dir) -> DataFrame:
    return promote.rollback_preview(_log(spark, sf_dir), _later_catalog(spark, sf_dir))


@query("rollback_preview", "SELECT load_run_id, supplier_key, external_product_id, rollback_action, conflict FROM v_rollback")
def _rollback_preview(spark, sf_dir):
    return _rollback_items(spark, sf_dir).drop("current", "restore")


VIEWS["v_rollback_eligible"] = """
SELECT b.id AS load_run_id, array_to_string(list_filter([CASE WHEN b.id % 7 = 0 THEN 'promotion_not_succeeded' END, CASE WHEN b.id % 10 = 1 THEN 'already_rolled_back' END,
  CASE WHEN r.n IS NULL THEN 'audit_missing' END, CASE WHEN r.c > 0 THEN 'rollback_conflict' END], lambda x: x IS NOT NULL), ',') AS reasons, coalesce(r.c, 0)::BIGINT AS conflicts,
  b.id % 7 <> 0 AND b.id % 10 <> 1 AND r.n IS NOT NULL AND r.c = 0 AS eligible
FROM fx_batches b LEFT JOIN (SELECT load_run_id, count(*) AS n, count_if(conflict) AS c FROM v_rollback GROUP BY 1) r ON r.load_run_id = b.id
"""


def _rollback_eligible(spark, sf_dir) -> DataFrame:
    ids = BATCHES.frame(spark, sf_dir).select(F.col("id").alias("load_run_id"))
    promotions = ids.withColumn("status", F.when(F.col("load_run_id") % 7 == 0, F.lit("blocked")).otherwise(F.lit("succeeded")))
    return promote.rollback_eligibility(
        promotions, _log(spark, sf_dir), _rollback_items(spark, sf_dir), ids.where("load_run_id % 10 = 1")
    )


@query("rollback_eligibility", "SELECT * FROM v_rollback_eligible")
def _rollback_eligibility(spark, sf_dir):
    return _rollback_eligible(spark, sf_dir).withColumn("reasons", F.array_join("reasons", ","))


def _rollback(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every promotion is asked to be rolled back, every fifth with an old hash."""
    items = _rollback_items(spark, sf_dir)
    hashes = promote.preview_hash(items, "restore", "current").select("load_run_id", "preview_hash")
    ids = BATCHES.frame(spark, sf_dir).select(F.col("id").alias("load_run_id"))
    requests = ids.join(hashes, "load_run_id", "left").select(
        "load_run_id", F.when(F.col("load_run_id") % 5 == 0, F.lit("old")).otherwise(F.col("preview_hash")).alias("expected_hash")
    )
    return promote.run_rollbacks(items, _rollback_eligible(spark, sf_dir), requests)


VIEWS["v_rollback_runs"] = """
SELECT load_run_id, CASE WHEN eligible AND load_run_id % 5 <> 0 THEN 'succeeded' ELSE 'blocked' END AS status,
  CASE WHEN NOT eligible THEN 'rollback_blocked' WHEN load_run_id % 5 = 0 THEN 'preview_stale' END AS failure_code
FROM v_rollback_eligible
"""
VIEWS["v_rolled"] = "SELECT r.* FROM v_rollback r JOIN v_rollback_runs g ON g.load_run_id = r.load_run_id AND g.status = 'succeeded'"


@query("rollback_run", """
SELECT g.*, coalesce(r.restored, 0)::BIGINT AS restored_count, coalesce(r.deleted, 0)::BIGINT AS deleted_count FROM v_rollback_runs g
LEFT JOIN (SELECT load_run_id, count_if(rollback_action = 'restore') AS restored, count_if(rollback_action = 'delete') AS deleted FROM v_rolled GROUP BY 1) r
ON r.load_run_id = g.load_run_id
""")
def _rollback_run(spark, sf_dir):
    return _rollback(spark, sf_dir)[0]


VIEWS["v_back"] = f"""
SELECT l.supplier_key, l.external_product_id, {", ".join(f"CASE WHEN r.rollback_action = 'restore' THEN c.{n} ELSE l.{n} END AS {n}" for n in v.COMPARED_FIELDS)}, l.source_load_run_id
FROM v_later l LEFT JOIN v_rolled r USING (supplier_key, external_product_id) LEFT JOIN fx_catalog c USING (supplier_key, external_product_id)
WHERE coalesce(r.rollback_action, '') <> 'delete'
"""


@query("rollback_apply", "SELECT * FROM v_back")
def _rollback_apply(spark, sf_dir):
    """Whole promotions go back; one conflict keeps a promotion as it is."""
    return promote.apply_rollback(_later_catalog(spark, sf_dir), _rollback(spark, sf_dir)[1])


_ROLLBACK_LOG = """
SELECT r.load_run_id, r.external_product_id, r.rollback_action AS action, g.field, g.after AS before, CASE WHEN r.rollback_action = 'restore' THEN g.before END AS after
FROM v_rolled r JOIN v_log g ON g.load_run_id = r.load_run_id AND g.supplier_key = r.supplier_key AND g.external_product_id = r.external_product_id
"""


@query("rollback_changelog", _ROLLBACK_LOG)
def _rollback_changelog(spark, sf_dir):
    log = promote.rollback_log(_rollback(spark, sf_dir)[1])
    return promote.flat_changes(log, ["load_run_id", "external_product_id"])


@query("rollback_changes_flat", f"SELECT load_run_id, external_product_id, action, field, coalesce(before, '-') AS before, CASE WHEN action = 'delete' THEN '삭제됨' ELSE coalesce(after, '-') END AS after FROM ({_ROLLBACK_LOG})")
def _rollback_changes_flat(spark, sf_dir):
    log = promote.rollback_log(_rollback(spark, sf_dir)[1])
    flat = promote.flat_changes(log, ["load_run_id", "external_product_id"])
    gone = (F.col("action") == "delete") & F.col("after").isNull()
    return flat.withColumns({
        "before": F.coalesce("before", F.lit("-")),
        "after": F.when(gone, F.lit("삭제됨")).otherwise(F.coalesce("after", F.lit("-"))),
    })


# --- streaming counterparts and invariants ---


@query("effective_profile", """
SELECT c_custkey AS file_id, profile_id, CASE WHEN has THEN ov ELSE av END AS effective_version,
  CASE WHEN av IS NULL THEN 'unsupported' WHEN has AND ov IS NULL THEN 'inactive' ELSE 'run' END AS route
FROM (SELECT c_custkey, c_mktsegment AS profile_id, CASE WHEN c_mktsegment <> 'MACHINERY' THEN '1' END AS av,
  c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AS has, CASE WHEN c_mktsegment = 'BUILDING' THEN '2' END AS ov FROM customer)
""")
def _effective_profile(spark, sf_dir):
    """Files routed by market segment: one segment is not registered, one is switched off, one runs version 2."""
    files = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("file_id"), F.col("c_mktsegment").alias("profile_id")
    )
    names = files.select("profile_id").distinct()
    registry = names.where("profile_id <> 'MACHINERY'").withColumn("active_version", F.lit("1"))
    overrides = names.where("profile_id IN ('BUILDING', 'HOUSEHOLD')").withColumn(
        "active_version", F.when(F.col("profile_id") == "BUILDING", F.lit("2"))
    )
    return landing.route(files, landing.effective_profiles(registry, overrides))


@query("job_status_latest", """
SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS steps FROM events GROUP BY 1
""")
def _job_status_latest(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
    )
    return landing.latest_status(events).drop("at")


@query("inv_non_negative", """
SELECT 'orders' AS table_name, 'negative_margin' AS rule, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_totalprice - 100000 < 0
UNION ALL SELECT 'customer', 'negative_c_acctbal', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'products', 'negative_stock', CAST(row_index AS VARCHAR) FROM v_products WHERE stock < 0
UNION ALL SELECT 'products', 'negative_price', CAST(row_index AS VARCHAR) FROM v_products WHERE price < 0
""")
def _inv_non_negative(spark, sf_dir):
    from catalake.plans.catalog_queries import products

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("margin", F.col("o_totalprice") - 100000)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    check = invariants.rows_that_break
    return (
        check(orders, "orders", "o_orderkey", invariants.non_negative(["margin"]))
        .unionByName(check(customers, "customer", "c_custkey", invariants.non_negative(["c_acctbal"])))
        .unionByName(check(products(spark, sf_dir), "products", "row_index", invariants.non_negative(["stock", "price"])))
    )


@query("inv_quality", """
SELECT 'load_runs' AS table_name, unnest(CASE WHEN id % 13 <> 0 AND id % 71 = 0 THEN ['quality_partly_set'] ELSE [] END || CASE WHEN id % 13 <> 0 AND id % 83 = 0 THEN ['total_mismatch'] ELSE [] END) AS rule, CAST(id AS VARCHAR) AS key FROM fx_load_runs
""")
def _inv_quality(spark, sf_dir):
    """Batch runs with defects put in: lost error counts (k % 71) and a wrong row count (k % 83)."""
    runs = LOAD_RUNS.frame(spark, sf_dir)
    damaged = runs.withColumns({
        "error_counts": F.when(F.col("id") % 71 != 0, F.col("error_counts")),
        "loaded_rows": F.col("loaded_rows") + F.when(F.col("id") % 83 == 0, 1).otherwise(0),
    })
    return invariants.rows_that_break(damaged, "load_runs", "id", invariants.quality_rules())


@query("inv_unique", """
SELECT 'inspection_runs' AS table_name, 'repeated_file_sha256_inspection_version' AS rule, file_sha256 || '|' || inspection_version AS key FROM fx_inspection_runs WHERE file_sha256 IS NOT NULL GROUP BY file_sha256, inspection_version HAVING count(*) > 1
UNION ALL SELECT 'staging', 'repeated_load_run_id_product_id', load_run_id || '|' || product_id FROM fx_staging GROUP BY load_run_id, product_id HAVING count(*) > 1
UNION ALL SELECT 'promotion_runs', 'repeated_load_run_id', CAST(load_run_id AS VARCHAR) FROM fx_promotion_runs WHERE status = 'succeeded' GROUP BY load_run_id HAVING count(*) > 1
UNION ALL SELECT 'lineitem', 'repeated_l_orderkey_l_linenumber', l_orderkey || '|' || l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
""")
def _inv_unique(spark, sf_dir):
    repeated = invariants.repeated_keys
    return (
        repeated(FIXTURES["fx_inspection_runs"].frame(spark, sf_dir), "inspection_runs", ["file_sha256", "inspection_version"])
        .unionByName(repeated(_staging(spark, sf_dir), "staging", ["load_run_id", "product_id"]))
        .unionByName(repeated(FIXTURES["fx_promotion_runs"].frame(spark, sf_dir), "promotion_runs", ["load_run_id"], F.col("status") == "succeeded"))
        .unionByName(repeated(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "lineitem", ["l_orderkey", "l_linenumber"]))
    )


@query("inv_state", """
SELECT 'promotion_runs' AS table_name, CASE WHEN status IN ('succeeded', 'blocked', 'failed') THEN 'final_not_completed' ELSE 'open_but_completed' END AS rule, CAST(id AS VARCHAR) AS key
FROM fx_promotion_runs WHERE (status IN ('succeeded', 'blocked', 'failed')) <> completed
UNION ALL SELECT 'changes', 'before_presence', external_product_id FROM v_items WHERE known AND len(diffs) > 0 AND CAST(substr(external_product_id, 2) AS BIGINT) % 23 = 0
""")
def _inv_state(spark, sf_dir):
    runs = FIXTURES["fx_promotion_runs"].frame(spark, sf_dir)
    log = promote.change_log(_preview(spark, sf_dir))
    lost = F.substr("external_product_id", F.lit(2)).cast("bigint") % 23 == 0
    damaged = log.withColumn("before", F.when(~lost, F.col("before")))
    return invariants.rows_that_break(
        runs, "promotion_runs", "id", invariants.run_state_rules(("succeeded", "blocked", "failed"))
    ).unionByName(
        invariants.rows_that_break(damaged, "changes", "external_product_id", invariants.change_rules(("insert",), ()))
    )


@query("inv_orphans", """
SELECT 'inspection_results' AS table_name, 'orphan_inspection_run_id' AS rule, CAST(id AS VARCHAR) AS key FROM fx_inspection_results WHERE inspection_run_id NOT IN (SELECT id FROM fx_inspection_runs WHERE id % 5 <> 0)
UNION ALL SELECT 'staging', 'orphan_load_run_id', CAST(id AS VARCHAR) FROM fx_staging WHERE load_run_id NOT IN (SELECT id FROM fx_batches)
""")
def _inv_orphans(spark, sf_dir):
    """Every fifth inspection run is taken away."""
    runs = FIXTURES["fx_inspection_runs"].frame(spark, sf_dir).where("id % 5 <> 0")
    results = FIXTURES["fx_inspection_results"].frame(spark, sf_dir)
    return invariants.orphans(results, "inspection_results", "inspection_run_id", "id", runs, "id").unionByName(
        invariants.orphans(_staging(spark, sf_dir), "staging", "load_run_id", "id", BATCHES.frame(spark, sf_dir), "id")
    )


@query("inv_fingerprint", """
SELECT c_mktsegment AS profile_name, CAST(c_nationkey AS VARCHAR) AS profile_version, CASE WHEN c_nationkey % 4 = 0 THEN 'unpublished' ELSE 'changed' END AS problem
FROM customer GROUP BY c_mktsegment, c_nationkey HAVING c_nationkey % 4 = 0 OR count_if(c_custkey % 29 = 5) > 0
""")
def _inv_fingerprint(spark, sf_dir):
    """Published mappings against the present ones: a line each, some edited since (k % 29); every fourth version is unpublished."""
    lines = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_mktsegment").alias("profile_name"), F.col("c_nationkey").cast("string").alias("profile_version"),
        F.col("c_custkey").alias("place"), F.col("c_name").alias("line"),
    )
    edited = lines.withColumn("line", F.when(F.col("place") % 29 == 5, F.concat("line", F.lit("!"))).otherwise(F.col("line")))
    published = invariants.fingerprints(lines.where("cast(profile_version as int) % 4 <> 0"), ["profile_name", "profile_version"])
    return invariants.changed_versions(invariants.fingerprints(edited, ["profile_name", "profile_version"]), published, ["profile_name", "profile_version"])


__all__ = ["profile_rows", "staged_products"]
