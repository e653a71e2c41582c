"""Test tables derived from the given tables.

One text per column serves both engines: only operators that Spark SQL and DuckDB share are used (``%``, ``floor``,
``CASE``, ``||``, ``lpad``, casts). The few that differ are given twice. Every fixture is a projection of a whole table,
so it grows with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalake.operators.skew import spread


@dataclass(frozen=True)
class Fixture:
    table: str
    columns: tuple[tuple[str, ...], ...]  # (name, text) or (name, Spark text, DuckDB text)
    keep: str = "TRUE"

    def frame(self, spark: SparkSession, sf_dir: str, spread_by: str | None = None) -> DataFrame:
        """``spread_by``: deal the rows of the table over all tasks first, for tables whose few bytes mean much work."""
        base = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        base = spread(base, spread_by) if spread_by else base
        return base.where(self.keep).select(*[F.expr(col[1]).alias(col[0]) for col in self.columns])

    def sql(self) -> str:
        body = ", ".join(f"{col[-1]} AS {col[0]}" for col in self.columns)
        return f"SELECT {body} FROM {self.table} WHERE {self.keep}"


def div(value: str, by: int) -> str:
    return f"CAST(floor(({value}) / {by}) AS BIGINT)"


def text(value: str) -> str:
    return f"CAST({value} AS STRING)"


def pick(index: str, *choices: str) -> str:
    """One of the texts (SQL expressions) by index."""
    arms = " ".join(f"WHEN {i} THEN {choice}" for i, choice in enumerate(choices[:-1]))
    return f"(CASE {index} {arms} ELSE {choices[-1]} END)"


def quoted(*values: str) -> list[str]:
    return [f"'{value}'" for value in values]


_COLORS = quoted("BLACK", "black", "블랙", "Navy", "na-vy", "red ", "", "MELANGE  GRAY", "melange gray", "WHITE", "off_white")
_SIZES = quoted("M", "medium", "XL", "x-large", "95", "270", "", "FREE", "free  size", "S-M", "L", "1 0 0", "XXXL")
_CATEGORIES = quoted("TOP", "BOTTOM", "OUTER", "SHOES", "BAG", "tops", "bag", "상의", "가방", "HAT", "", "TOP", "BOTTOM", "OUTER", "SHOES", "BAG", "TOP")
_KEYWORDS = quoted("", " 티셔츠", " 청 바지", " 후드집업", " RUN-러닝화", " 백팩", " 셔츠 바지", "", "")


def product_columns(k: str, name: str, price: str) -> tuple[tuple[str, ...], ...]:
    """A supplier's catalog as text, with every kind of defect at a fixed rate."""
    base = f"CAST(floor({price}) AS BIGINT)"
    triple = div(k, 3)
    pair = f"{k} % 40 IN (12, 13, 14)"
    named = (
        f"CASE WHEN {pair} THEN 'Twin  ' || {text(div(k, 40))} "
        f"WHEN {k} % 40 = 0 THEN 'Common Item ' || {text(f'{k} % 7')} "
        f"WHEN {k} % 59 = 0 THEN '' "
        f"WHEN {k} % 12 = 11 THEN {name} || ' ' || {text(k)} "
        f"WHEN {k} % 6 = 1 THEN upper('Item ' || {text(triple)}) || {pick(f'{triple} % 9', *_KEYWORDS)} "
        f"WHEN {k} % 6 = 2 THEN 'Item-' || {text(triple)} || {pick(f'{triple} % 9', *_KEYWORDS)} "
        f"ELSE 'Item ' || {text(triple)} || {pick(f'{triple} % 9', *_KEYWORDS)} END"
    )
    mail = f"'seller' || {text(k)} || '@example.com'"
    description = pick(
        f"{k} % 19",
        "'카톡 문의 바랍니다'",
        f"'문의 ' || {mail}",
        f"'연락처 010-1234-' || lpad({text(f'{k} % 10000')}, 4, '0')",
        f"'전화 02 123 ' || lpad({text(f'{k} % 10000')}, 4, '0')",
        f"'주민 900101-1' || lpad({text(f'{k} % 1000000')}, 6, '0')",
        f"'계좌 입금 123-456-' || lpad({text(f'{k} % 1000000')}, 6, '0')",
        "'숫자 123-456-789012'",
        "'외부  결제 및 직거래'",
        "'A.b@x.co, a.B@X.CO c@d.org'",
        f"'은행 01012345678 입금 1102' || lpad({text(f'{k} % 100000000')}, 8, '0')",
        "''",
        "'plain text'",
        "'No phone 010-1234-56789 here'",
        "'tel 0311234567, 031-123-4567'",
        "'  '",
        "'=SUM(A1)'",
        "'-discount-'",
        "'soft cotton'",
        "'made for daily use'",
    )
    return (
        ("row_index", k),
        (
            "product_group_id",
            f"CASE WHEN {k} % 97 = 0 THEN '' WHEN {k} % 61 = 2 THEN ' G' || {text(div(k, 4))} || ' ' ELSE 'G' || {text(div(k, 4))} END",
        ),
        (
            "product_id",
            f"CASE WHEN {k} % 101 = 0 THEN '' WHEN {k} % 50 = 7 THEN 'P' || {text(f'{k} - 1')} "
            f"WHEN {k} % 60 = 1 THEN '　P' || {text(k)} || ' ' ELSE 'P' || {text(k)} END",
        ),
        ("product_name", named),
        ("category", f"CASE WHEN {pair} THEN 'TOP' WHEN {k} % 9 = 0 THEN {pick(f'{k} % 17', *_CATEGORIES)} ELSE {pick(f'{div(k, 4)} % 11', *_CATEGORIES)} END"),
        (
            "color",
            f"CASE WHEN {pair} THEN 'RED' WHEN {k} % 20 = 1 THEN 'BLACK' WHEN {k} % 20 = 2 THEN '블랙' ELSE {pick(f'{k} % 11', *_COLORS)} END",
        ),
        (
            "size",
            f"CASE WHEN {pair} THEN 'L' WHEN {k} % 20 = 1 THEN 'M' WHEN {k} % 20 = 2 THEN 'medium' ELSE {pick(f'{k} % 13', *_SIZES)} END",
        ),
        ("stock", pick(f"{k} % 15", "'-1'", "'0'", "'abc'", "''", "'1_000'", "' 7 '", "'1.5'", "'+5'", text(k))),
        (
            "price",
            f"CASE WHEN {k} % 40 IN (12, 13) THEN '19900' WHEN {k} % 200 = 3 THEN {text(f'{base} * 5000')} WHEN {k} % 31 = 0 THEN '0' "
            f"WHEN {k} % 37 = 0 THEN '-100' WHEN {k} % 41 = 0 THEN 'free' WHEN {k} % 43 = 0 THEN '' "
            f"WHEN {k} % 47 = 0 THEN {text(f'{base} * 10')} ELSE {text(f'{base} * 100')} END",
        ),
        ("image_path", f"CASE WHEN {k} % 53 = 0 THEN '' ELSE 'img/' || {text(k)} || '.jpg' END"),
        (
            "sale_price",
            pick(f"{k} % 8", "''", "''", text(f"{base} * 50"), text(f"{base} * 200"), "'0'", "'n/a'", "'-5'", "''"),
        ),
        ("description", description),
        ("seller", pick(f"{k} % 10", "''", "'=cmd'", "'+82 shop'", "chr(39) || '=x'", "'@home'", f"'Seller ' || {text(f'{k} % 10')}")),
    )


PRODUCTS = Fixture("part", product_columns("p_partkey", "p_name", "p_retailprice"))
# The same catalog on a larger table, for timing.
ORDER_PRODUCTS = Fixture("orders", product_columns("o_orderkey", "o_orderpriority", "(900 + o_totalprice / 1000)"))


def tidy_product_columns(k: str) -> tuple[tuple[str, ...], ...]:
    """A mostly clean catalog: each kind of defect comes with a period of its own, of about a hundred rows."""
    def every(period: int, place: int) -> str:
        return f"{k} % {period} = {place}"

    before = f"({k} - 1)"
    model = f"CASE WHEN {every(89, 3)} THEN {before} ELSE {k} END"  # the row whose content this row has
    option = f"CASE WHEN {every(103, 29)} THEN {before} ELSE {model} END"  # the row whose kind, color and size it has
    names = quoted("가을 니트", "데님팬츠 일자", "롱 패딩", "가죽 로퍼", "여행 토트백")
    note = f"CASE WHEN {every(91, 43)} THEN '직거래 환영' WHEN {every(93, 47)} THEN 'ask' || {text(k)} || '@store.example' ELSE '계절 신상품' END"
    return (
        ("row_index", k),
        ("product_group_id", f"'style ' || {text(f'CASE WHEN {every(101, 13)} OR {every(103, 29)} THEN {before} ELSE {k} END')}"),
        ("product_id", f"'item-' || {text(f'CASE WHEN {every(97, 11)} THEN {before} ELSE {k} END')}"),
        ("product_name", f"{pick(f'({option}) % 5', *names)} || ' no. ' || {text(model)}"),
        ("category", pick(f"({option}) % 5", *quoted("TOP", "BOTTOM", "OUTER", "SHOES", "BAG"))),
        ("color", f"CASE WHEN {every(107, 31)} THEN '네이비' ELSE {pick(f'({option}) % 6', *quoted('GREEN', 'BROWN', 'NAVY', 'PINK', 'YELLOW', 'WHITE'))} END"),
        ("size", f"CASE WHEN {every(109, 37)} THEN 'x-large' ELSE {pick(f'({option}) % 5', *quoted('XS', 'S', 'M', 'L', 'XL'))} END"),
        ("stock", text(f"3 + {k} % 40")),
        ("price", f"CASE WHEN {every(113, 41)} THEN {text(f'500000 + {k} % 1000')} ELSE {text(f'8900 + ({model}) % 57 * 150')} END"),
        ("image_path", f"'photo/' || {text(k)} || '.png'"),
        ("sale_price", "''"),
        ("description", note),
        ("seller", f"'store ' || {text(f'{k} % 12')}"),
    )


TIDY_PRODUCTS = Fixture("orders", tidy_product_columns("o_orderkey"))

# --- supplier feeds ---

_PRICE_TEXTS = ("'₩1,200'", "'12,000'", "' 990 '", "'abc'", "'-5'", "''", "'1.5'", "'₩'")


def _feed_values(k: str) -> dict[str, str]:
    price = f"CASE WHEN {k} % 11 < 8 THEN {text(f'1000 + {k} % 5000')} ELSE {pick(f'{k} % 8', *_PRICE_TEXTS)} END"
    return {
        "sku": f"CASE WHEN {k} % 71 = 0 THEN ' ' ELSE '00' || {text(k)} END",
        "name": f"CASE WHEN {k} % 83 = 0 THEN '' ELSE ' Item ' || {text(k)} END",
        "category": pick(f"{k} % 7", *quoted("TOP", "BOTTOM", "OUTER", "SHOES", "BAG", "BAG", "")),
        "brand": f"CASE WHEN {k} % 29 = 0 THEN '' ELSE 'Brand ' || {text(f'{k} % 20')} END",
        "price": price,
        "sale": pick(f"{k} % 6", "''", "''", f"{text(f'500 + {k} % 900')}", "'₩800'", "'-1'", "'sale'"),
        "color": pick(f"{k} % 9", *quoted("black", "RED", "네이비", "", "white", "Ivory", "khaki", "RED", "blue")),
        "size": pick(f"{k} % 5", *quoted("M", "L", "", "95", "FREE")),
        "quantity": pick(f"{k} % 13", *quoted("5", "0", "", "-2", "1.5", "1,000", " 12 ", "x", "7", "8", "9", "10", "11")),
        "details": f"CASE WHEN {k} % 17 = 0 THEN '문의 010-9876-' || lpad({text(f'{k} % 10000')}, 4, '0') "
                   f"WHEN {k} % 17 = 1 THEN '입금 계좌 1234-56-' || lpad({text(f'{k} % 1000000')}, 6, '0') ELSE 'desc ' || {text(k)} END",
        "image": f"CASE WHEN {k} % 91 = 0 THEN '' ELSE 'i/' || {text(k)} || '.png' END",
    }


def _feed(k: str, names: dict[str, str]) -> tuple[tuple[str, ...], ...]:
    values = _feed_values(k)
    values["style"] = f"'S' || {text(div(k, 4))}"
    place = (("file_id", div(k, 500)), ("source_row_number", f"CAST(2 + {k} % 500 AS BIGINT)"))
    return place + tuple((column, values[meaning]) for column, meaning in names.items())


FEED_A = Fixture("orders", _feed("o_orderkey", {
    "vendor_sku": "sku", "item_name": "name", "main_category": "category", "brand_name": "brand",
    "list_price": "price", "discount_price": "sale", "colour": "color", "size_name": "size",
    "quantity": "quantity", "description_text": "details", "image_link": "image",
}))
FEED_B = Fixture("orders", _feed("o_orderkey", {
    "style_id": "style", "sku_code": "sku", "title": "name", "category_code": "category", "label": "brand",
    "regular_price": "price", "promo_price": "sale", "tone": "color", "fit_size": "size",
    "available_qty": "quantity", "details": "details", "photo": "image",
}))

# --- batch and inspection history ---


def minutes_after_start(count: str) -> tuple[str, str]:
    return (
        f"timestampadd(MINUTE, CAST({count} AS INT), TIMESTAMP '2024-01-01 00:00:00')",
        f"TIMESTAMP '2024-01-01 00:00:00' + CAST({count} AS INTEGER) * INTERVAL 1 MINUTE",
    )


def sha_of(value: str) -> tuple[str, str]:
    return f"sha2({value}, 256)", f"sha256({value})"


_RUN_TOTAL, _RUN_BAD = "CAST(10 + c_custkey % 91 AS BIGINT)", "CAST(c_custkey % 7 AS BIGINT)"


def _if_known(value: str) -> str:
    return f"CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE {value} END"


LOAD_RUNS = Fixture("customer", (
    ("id", "c_custkey"),
    ("source_filename", f"'dir/feed' || {pick('c_custkey % 4', *quoted('_', '%', '-', 'A'))} || {text('c_custkey')} || '.csv'"),
    ("profile_name", "c_mktsegment"),
    ("profile_version", "CASE WHEN c_custkey % 3 = 0 THEN '1' ELSE '2' END"),
    ("input_file_sha256", *sha_of(text("c_custkey"))),
    ("output_file_sha256", *sha_of(f"'out' || {text('c_custkey')}")),
    ("loaded_rows", f"{_RUN_TOTAL} - {_RUN_BAD}"),
    ("total_rows", _if_known(_RUN_TOTAL)),
    ("rejected_rows", _if_known(_RUN_BAD)),
    (
        "error_counts",
        "CASE WHEN c_custkey % 13 <> 0 THEN map_filter(map("
        f"'INVALID_PRICE', {_RUN_BAD}, "
        "'MISSING_SOURCE_VALUE', CASE WHEN c_custkey % 7 > 0 AND c_custkey % 3 > 0 THEN c_custkey % 3 END, "
        "' ', CASE WHEN c_custkey % 17 = 0 THEN CAST(5 AS BIGINT) END, "
        "'ZERO', CASE WHEN c_custkey % 19 = 0 THEN CAST(0 AS BIGINT) END), "
        "(code, n) -> n IS NOT NULL AND (code <> 'INVALID_PRICE' OR n > 0)) END",
        "NULL",
    ),
    ("reject_details_stored", "(c_custkey % 5 <> 0 AND c_custkey % 13 <> 0)"),
    ("initial_source_type", pick("c_custkey % 5", *quoted("unknown", "upload", "s3", "http_feed", "cli"))),
    ("actor_username", f"CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'user' || {text('c_custkey % 5')} END"),
    ("created_at", *minutes_after_start(div("c_custkey", 2))),
))

# error_counts in long form for DuckDB.
RUN_ERRORS_SQL = f"""
SELECT id, code, n FROM (
  SELECT c_custkey AS id, 'INVALID_PRICE' AS code, {_RUN_BAD} AS n FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 7 > 0
  UNION ALL SELECT c_custkey, 'MISSING_SOURCE_VALUE', c_custkey % 3 FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 7 > 0 AND c_custkey % 3 > 0
  UNION ALL SELECT c_custkey, ' ', 5 FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 17 = 0
  UNION ALL SELECT c_custkey, 'ZERO', 0 FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 19 = 0)
"""

INSPECTION_RUNS = Fixture("customer", (
    ("id", "c_custkey"),
    ("source_filename", f"{pick('c_custkey % 4', *quoted('=cmd_', 'Spring%', 'sale-', 'SPRING_'))} || {text('c_custkey')} || '.csv'"),
    ("file_sha256", f"CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE {sha_of(text(div('c_custkey', 2)))[0]} END",
     f"CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE {sha_of(text(div('c_custkey', 2)))[1]} END"),
    ("inspection_version", "CASE WHEN c_custkey % 5 = 0 THEN '12' ELSE '13' END"),
    ("total_products", "CAST(100 + c_custkey % 50 AS BIGINT)"),
    ("error_count", "CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 5 END AS BIGINT)"),
    ("warning_count", "CAST(c_custkey % 4 AS BIGINT)"),
    ("total_issues", "CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 5 END + c_custkey % 4 + CASE WHEN c_custkey % 137 = 0 THEN 1 ELSE 0 END AS BIGINT)"),
    ("actor_username", f"CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'user' || {text('c_custkey % 5')} END"),
    ("created_at", *minutes_after_start("c_custkey * 7")),
))

# One stored issue per line item, spread over the inspection runs.
INSPECTION_RESULTS = Fixture("orders", (
    ("id", "o_orderkey"),
    ("inspection_run_id", "o_custkey"),
    ("product_id", f"'P' || {text('o_orderkey')}"),
    ("status", pick("o_orderkey % 3", *quoted("오류", "주의", "주의"))),
    ("error_field", "CASE WHEN o_orderkey % 503 = 0 THEN '' ELSE '가격 오류' END"),
    ("reason", f"'reason ' || {text('o_orderkey % 10')}"),
    ("recommendation", "'fix it'"),
    ("risk_level", "'높음'"),
))

# --- staging, catalog ---

_BATCH = "CAST(substr(p_brand, 7) AS BIGINT)"
# A supplier has several batches; odd batches hold rows with errors.
_SUPPLIER = f"'S' || {text(_BATCH + ' % 3')}"
_ODD = f"{_BATCH} % 2 = 1"


def _item(kind: str) -> tuple[tuple[str, ...], ...]:
    k, staged = "p_partkey", kind == "staging"
    price = f"CAST(floor(p_retailprice) AS BIGINT) * 100"
    newer = f"CASE WHEN {k} % 4 = 0 THEN 500 ELSE 0 END" if staged else "0"
    return (
        ("product_group_id", f"CASE WHEN {_ODD} THEN 'G' || {text(div(k, 4))} ELSE 'G' || {text(k)} END"),
        ("product_name", f"p_name || CASE WHEN {k} % 6 = 1 AND {'TRUE' if staged else 'FALSE'} THEN ' II' ELSE '' END"),
        ("category", pick(f"{k} % 5", *quoted("TOP", "BOTTOM", "OUTER", "SHOES", "BAG"))),
        ("color", "'BLACK'"),
        ("size", f"CASE WHEN NOT ({_ODD}) AND {k} % 9 = 8 THEN 'XL' ELSE " + pick(f"{k} % 9", *quoted("M", "95", "S-M", "s-m", " S-M ", "free size", "One/Two", "L", "")) + " END"),
        ("stock", f"CAST({k} % 50 AS BIGINT)"),
        ("price", f"{price} + {newer}"),
        ("sale_price", f"CASE WHEN {k} % 3 = 0 THEN NULL ELSE {price} - 100 END"),
        ("image_path", f"'img/' || {text(k)} || '.jpg'"),
        ("description", f"CASE WHEN {k} % 5 = 1 THEN NULL ELSE 'text ' || {text(f'{k} % 9')} END"),
        ("seller", f"CASE WHEN {k} % 9 = 0 THEN {'NULL' if staged else chr(39) + 'Old' + chr(39)} ELSE 'Shop' END"),
    )


STAGING = Fixture("part", (
    ("id", "p_partkey"),
    ("load_run_id", _BATCH),
    ("supplier_key", _SUPPLIER),
    ("product_id", f"CASE WHEN (p_partkey % 17 = 1 AND {_ODD} OR p_partkey % 13 = 2) AND p_partkey > 1 THEN 'P' || {text('p_partkey - 1')} ELSE 'P' || {text('p_partkey')} END"),
    *_item("staging"),
), "p_partkey % 7 <> 0")

CATALOG = Fixture("part", (
    ("id", "p_partkey + 1000000"),
    ("supplier_key", _SUPPLIER),
    ("external_product_id", f"'P' || {text('p_partkey')}"),
    *_item("catalog"),
    ("source_load_run_id", "CAST(0 AS BIGINT)"),
), "p_partkey % 5 <> 0")

# Products in lots of a supplier, for batches that share products (see order_queries).
LOTS = Fixture("part", (
    ("k", "p_partkey"),
    ("s", "p_partkey % 3"),
    ("lot", f"{div('p_partkey', 3)} % 6"),
    ("supplier_key", f"'S' || {text('p_partkey % 3')}"),
    ("external_product_id", f"'P' || {text('p_partkey')}"),
    *_item("catalog"),
))

BATCHES = Fixture("supplier", (
    ("id", "s_suppkey"),
    ("profile_name", f"'Brand#' || {text('s_suppkey')}"),
    ("total_rows", "CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST(100 AS BIGINT) END"),
    ("rejected_rows", "CASE WHEN s_suppkey % 6 = 0 THEN NULL WHEN s_suppkey % 4 = 0 THEN CAST(3 AS BIGINT) ELSE CAST(0 AS BIGINT) END"),
    ("has_error_counts", "(s_suppkey % 6 <> 0)"),
    ("has_reject_rows", "(s_suppkey % 10 = 3)"),
))

PROMOTION_RUNS = Fixture("customer", (
    ("id", "c_custkey"),
    ("load_run_id", div("c_custkey", 2)),
    ("status", pick("c_custkey % 4", *quoted("succeeded", "blocked", "failed", "applying"))),
    ("inserted_count", "CAST(c_custkey % 9 AS BIGINT)"),
    ("updated_count", "CAST(c_custkey % 8 AS BIGINT)"),
    ("blocked_count", "CAST(c_custkey % 3 AS BIGINT)"),
    ("failure_code", "CASE WHEN c_custkey % 4 = 1 THEN 'promotion_blocked' WHEN c_custkey % 4 = 2 THEN 'promotion_apply_failed' END"),
    ("actor_username", f"'user' || {text('c_custkey % 5')}"),
    ("created_at", *minutes_after_start(div("c_custkey", 3))),
    ("completed", "(c_custkey % 4 < 3 AND c_custkey % 101 <> 0)"),
))

ROLLBACK_RUNS = Fixture("customer", (
    ("id", "c_custkey"),
    ("target_promotion_run_id", div("c_custkey", 2)),
    ("status", pick("c_custkey % 3", *quoted("succeeded", "blocked", "failed"))),
    ("restored_count", "CAST(c_custkey % 9 AS BIGINT)"),
    ("deleted_count", "CAST(c_custkey % 8 AS BIGINT)"),
    ("conflict_count", "CAST(c_custkey % 3 AS BIGINT)"),
    ("actor_username", f"'user' || {text('c_custkey % 5')}"),
    ("created_at", *minutes_after_start(div("c_custkey", 3))),
))

# --- load attempts ---

ATTEMPTS = Fixture("events", (
    ("attempt_id", "event_id"),
    ("user_id", "user_id"),
    ("event_type", "event_type"),
    ("at", "ts"),
    ("source_type", pick("event_id % 4", *quoted("upload", "s3", "http_feed", "cli"))),
    ("source_ref", f"'ref' || {text('event_id')}"),
    ("failed", "(event_id % 29 = 0)"),
    ("total_rows", "CAST(20 + event_id % 30 AS BIGINT)"),
    ("rejected_rows", "CAST(event_id % 6 AS BIGINT)"),
))

# File names and object keys.
PATHS = Fixture("pages", (
    ("page_id", "page_id"),
    (
        "path",
        pick(
            "page_id % 6",
            "url",
            f"'C:' || chr(92) || 'in' || chr(92) || 'file ' || {text('page_id')} || '.csv'",
            f"'feeds/in/' || repeat('x', 300) || '.csv'",
            f"repeat('y', 300)",
            f"' feeds/in/sub/part-' || {text('page_id')} || '.csv '",
            "''",
        ),
    ),
    ("source_type", pick("page_id % 6", *quoted("unknown", "upload", "s3", "http_feed", "cli", "ftp"))),
))

FIXTURES = {
    "fx_products": PRODUCTS, "fx_order_products": ORDER_PRODUCTS, "fx_tidy_products": TIDY_PRODUCTS,
    "fx_feed_a": FEED_A, "fx_feed_b": FEED_B,
    "fx_load_runs": LOAD_RUNS, "fx_inspection_runs": INSPECTION_RUNS, "fx_inspection_results": INSPECTION_RESULTS,
    "fx_staging": STAGING, "fx_catalog": CATALOG, "fx_batches": BATCHES, "fx_lots": LOTS,
    "fx_promotion_runs": PROMOTION_RUNS, "fx_rollback_runs": ROLLBACK_RUNS,
    "fx_attempts": ATTEMPTS, "fx_paths": PATHS,
}
