"""Queries on the text catalog: typing, keys, every rule, text search and masking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalake.functions import keys
from catalake.functions import vocabulary as v
from catalake.operators import group_rules, scan
from catalake.operators.inspect import inspect, rule_issues
from catalake.plans import ducksql as d
from catalake.plans.fixtures import PRODUCTS
from catalake.plans.registry import VIEWS, query
from catalake.sources.catalog import load_catalog

ISSUE_COLUMNS = ("rule", "severity", "product_id", "product_group_id", "message", "row_index")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed catalog; its table is a small file, and typing is many times the work of reading it."""
    return load_catalog(PRODUCTS.frame(spark, sf_dir, spread_by="p_partkey"))


def supplier_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PRODUCTS.frame(spark, sf_dir)


_TEXTS = ("product_group_id", "product_id", "product_name", "category", "color", "size", "image_path", "description", "seller")
VIEWS["v_trimmed"] = "SELECT row_index, " + ", ".join(
    f"{d.strip(name)} AS {name}" for name in v.STANDARD_COLUMNS
) + " FROM fx_products"
VIEWS["v_products"] = (
    "SELECT row_index, " + ", ".join(_TEXTS)
    + f", {d.number('stock')} AS stock, {d.number('price')} AS price, {d.number('sale_price')} AS sale_price"
    + ", sale_price <> '' AS sale_price_provided FROM v_trimmed"
)
VIEWS["v_colors"] = d.alias_rows(v.COLOR_ALIASES)
VIEWS["v_sizes"] = d.alias_rows(v.SIZE_ALIASES)
VIEWS["v_cats"] = d.category_rows()
VIEWS["v_std"] = f"""
SELECT p.*, c.standard AS color_std, s.standard AS size_std, coalesce(k.category, lower(p.category)) AS cat_key
FROM v_products p
LEFT JOIN v_colors c ON c.alias = {d.alias_key('p.color')}
LEFT JOIN v_sizes s ON s.alias = {d.alias_key('p.size')}
LEFT JOIN v_cats k ON k.alias = lower(p.category)
"""
VIEWS["v_keyed"] = f"""
SELECT *,
  CASE WHEN color <> '' THEN coalesce(color_std, {d.squash('color')}) END AS color_key,
  CASE WHEN size <> '' THEN coalesce(size_std, {d.squash('size')}) WHEN category = 'BAG' THEN '' END AS size_key,
  CASE WHEN size_std IS NOT NULL AND size_std <> 'FREE' THEN 'ALPHA'
       WHEN regexp_full_match(regexp_replace(size, '{d.WS}', '', 'g'), '[0-9]+') THEN 'NUMERIC' END AS size_system,
  regexp_replace(lower(product_name), '[^0-9a-z가-힣ㄱ-ㅎㅏ-ㅣ]', '', 'g') AS name_key,
  CASE WHEN product_group_id <> '' AND product_id <> '' AND product_name <> ''
            AND category IN {d.text_list(v.CANONICAL_CATEGORIES)} AND color <> '' AND (size <> '' OR category = 'BAG') AND price > 0
       THEN concat_ws(chr(31), {d.squash('product_name')}, {d.squash('category')}, {d.squash('color')}, {d.squash('size')}, CAST(price AS VARCHAR)) END AS content
FROM v_std
"""


@query("catalog_load", "SELECT * FROM v_products")
def _catalog_load(spark, sf_dir):
    return load_catalog(supplier_table(spark, sf_dir))


# --- keys ---


@query("norm_content", f"SELECT row_index, {d.squash('description')} AS content FROM fx_products")
def _norm_content(spark, sf_dir):
    from catalake.functions.text import squash

    return supplier_table(spark, sf_dir).select("row_index", squash(F.col("description")).alias("content"))


@query("norm_name", f"""
SELECT row_index, name_key, {d.collapse("regexp_replace(lower(product_name), '[-_/]+', ' ', 'g')")} AS keyword_text FROM v_keyed
""")
def _norm_name(spark, sf_dir):
    name = F.col("product_name")
    return products(spark, sf_dir).select(
        "row_index", keys.name_key(name).alias("name_key"), keys.keyword_text(name).alias("keyword_text")
    )


@query("norm_category", "SELECT row_index, category, cat_key AS category_key FROM v_std")
def _norm_category(spark, sf_dir):
    return products(spark, sf_dir).select(
        "row_index", "category", keys.category_key(F.col("category")).alias("category_key")
    )


@query("standard_color", "SELECT row_index, color, color_std AS standard FROM v_std")
def _standard_color(spark, sf_dir):
    return products(spark, sf_dir).select("row_index", "color", keys.standard_color(F.col("color")).alias("standard"))


@query("standard_size", "SELECT row_index, size, size_std AS standard FROM v_std")
def _standard_size(spark, sf_dir):
    return products(spark, sf_dir).select("row_index", "size", keys.standard_size(F.col("size")).alias("standard"))


@query("alias_conflicts", f"""
SELECT {d.alias_key('spelling')} AS alias, count(DISTINCT standard) AS standards, string_agg(DISTINCT standard, ',' ORDER BY standard) AS claimed
FROM (SELECT color AS spelling, category AS standard FROM v_products WHERE color <> '' AND category <> '')
GROUP BY 1 HAVING count(DISTINCT standard) > 1
""")
def _alias_conflicts(spark, sf_dir):
    """Conflict check of an alias table of any size: here the spellings and values found in a catalog."""
    from catalake.functions.text import alias_form

    claims = (
        products(spark, sf_dir)
        .where((F.col("color") != "") & (F.col("category") != ""))
        .select(alias_form(F.col("color")).alias("alias"), F.col("category").alias("standard"))
        .distinct()
    )
    return claims.groupBy("alias").agg(
        F.count(F.lit(1)).alias("standards"), F.array_join(F.array_sort(F.collect_list("standard")), ",").alias("claimed")
    ).where(F.col("standards") > 1)


@query("size_system", "SELECT row_index, size, size_system FROM v_keyed")
def _size_system(spark, sf_dir):
    return products(spark, sf_dir).select("row_index", "size", keys.size_system(F.col("size")).alias("size_system"))


@query("option_keys", "SELECT row_index, color_key, size_key, content FROM v_keyed")
def _option_keys(spark, sf_dir):
    c = F.col
    return products(spark, sf_dir).select(
        "row_index", keys.color_key(c("color")).alias("color_key"),
        keys.variant_size_key(c("category"), c("size")).alias("size_key"), keys.content_key().alias("content"),
    )


# --- rules: every oracle states the pairwise or plain definition ---


def _say(rule: str, severity: str, message: str, tail: str, product_id: str = "product_id") -> str:
    return (
        f"SELECT '{rule}' AS rule, '{severity}' AS severity, {product_id} AS product_id, product_group_id, "
        f"{message} AS message, row_index {tail}"
    )


VIEWS["v_dup_id"] = _say(
    "duplicate_product_id", "error",
    "'product_id ''' || product_id || ''' is used in ' || n || ' rows, first in row ' || first_row",
    """FROM v_products JOIN (
      SELECT product_id, count(*) AS n, min(row_index) + 2 AS first_row
      FROM v_products WHERE product_id <> '' GROUP BY product_id HAVING count(*) > 1) USING (product_id)""",
)
VIEWS["v_mixed_groups"] = """
SELECT product_group_id, min(cat_key) AS low, max(cat_key) AS high, count(*) AS n, min(row_index) + 2 AS first_row
FROM v_keyed WHERE product_group_id <> '' AND cat_key <> '' GROUP BY product_group_id HAVING count(DISTINCT cat_key) > 1
"""
VIEWS["v_group_cat"] = _say(
    "inconsistent_group_category", "error",
    """'inconsistent_group_category:{"product_group_id":' || CAST(to_json(product_group_id) AS VARCHAR) || ',"categories":['
      || CAST(to_json(low) AS VARCHAR) || ',' || CAST(to_json(high) AS VARCHAR) || '],"count":' || n || ',"first_row":' || first_row || '}'""",
    "FROM v_keyed JOIN v_mixed_groups USING (product_group_id) WHERE cat_key <> ''",
)
VIEWS["v_group_size"] = _say(
    "inconsistent_group_size_system", "warning", "'product group mixes alpha and numeric size systems'",
    """FROM v_keyed WHERE size_system IS NOT NULL AND product_group_id IN (
      SELECT product_group_id FROM v_keyed WHERE product_group_id <> '' AND size_system IS NOT NULL
      GROUP BY product_group_id HAVING count(DISTINCT size_system) > 1)""",
)
VIEWS["v_variant_rows"] = """
SELECT a.row_index, a.product_id, a.product_group_id, a.color_key, a.size_key FROM v_keyed a
WHERE a.product_group_id <> '' AND a.product_id <> '' AND a.color_key IS NOT NULL AND a.size_key IS NOT NULL AND EXISTS (
  SELECT 1 FROM v_keyed b WHERE b.product_group_id = a.product_group_id AND b.color_key = a.color_key AND b.size_key = a.size_key
    AND b.product_id <> '' AND b.product_id <> a.product_id AND NOT coalesce(b.content = a.content, FALSE))
"""
VIEWS["v_variant_sizes"] = """
SELECT product_group_id, color_key, size_key, count(*) AS n, min(row_index) + 2 AS first_row FROM v_keyed
WHERE product_group_id <> '' AND product_id <> '' AND color_key IS NOT NULL AND size_key IS NOT NULL GROUP BY ALL
"""
VIEWS["v_dup_variant"] = _say(
    "duplicate_variant_combination", "error",
    """'duplicate_variant_combination:{"product_group_id":' || CAST(to_json(product_group_id) AS VARCHAR) || ',"color":' || CAST(to_json(color_key) AS VARCHAR)
      || ',"size":' || CAST(to_json(size_key) AS VARCHAR) || ',"count":' || n || ',"first_row":' || first_row || '}'""",
    "FROM v_variant_rows JOIN v_variant_sizes USING (product_group_id, color_key, size_key)",
)
VIEWS["v_name_rows"] = """
SELECT a.* FROM v_keyed a WHERE a.name_key <> '' AND EXISTS (
  SELECT 1 FROM v_keyed b WHERE b.name_key = a.name_key AND b.row_index <> a.row_index AND NOT (
    a.product_group_id <> '' AND lower(a.product_group_id) = lower(b.product_group_id)
    AND a.product_id <> '' AND b.product_id <> '' AND lower(a.product_id) <> lower(b.product_id)
    AND ((a.color <> '' AND b.color <> '' AND lower(a.color) <> lower(b.color))
      OR (a.size <> '' AND b.size <> '' AND lower(a.size) <> lower(b.size)))))
"""
VIEWS["v_dup_name"] = _say(
    "duplicate_product_name", "warning",
    "'product_name ''' || product_name || ''' normalized to ''' || name_key || ''' is used in ' || n || ' rows, first in row ' || first_row",
    """FROM v_name_rows JOIN (SELECT name_key, count(*) AS n, min(row_index) + 2 AS first_row FROM v_keyed GROUP BY name_key)
      USING (name_key)""",
)
VIEWS["v_dup_content"] = _say(
    "duplicate_product_content", "error",
    "'product_id ''' || product_id || ''' in group ''' || product_group_id || ''' duplicates product_id ''' || first_id || ''' in group ''' || first_group || ''' with same product_name, category, color, size, and price'",
    """FROM v_keyed JOIN (
      SELECT content, min(row_index) AS lead, arg_min(product_id, row_index) AS first_id, arg_min(product_group_id, row_index) AS first_group
      FROM v_keyed WHERE content IS NOT NULL GROUP BY content) USING (content) WHERE row_index > lead""",
)
VIEWS["v_missing"] = " UNION ALL ".join(
    _say(
        "missing_required_field", "error", f"'''{name}'' is missing'",
        f"FROM v_products WHERE {name} = ''" + (" AND category <> 'BAG'" if name == "size" else ""),
    )
    for name in v.REQUIRED_TEXT_FIELDS
)
VIEWS["v_bad_color"] = _say(
    "non_standard_color", "warning", "'color ''' || color || ''' should be standardized to ''' || color_std || ''''",
    "FROM v_std WHERE color <> '' AND color <> color_std",
)
VIEWS["v_bad_size"] = _say(
    "non_standard_size", "warning", "'size ''' || size || ''' should be standardized to ''' || size_std || ''''",
    "FROM v_std WHERE size <> '' AND size <> size_std",
)
VIEWS["v_bad_category"] = _say(
    "invalid_category", "error",
    "'category ''' || category || ''' is not one of [''BAG'', ''BOTTOM'', ''OUTER'', ''SHOES'', ''TOP'']'",
    f"FROM v_products WHERE category <> '' AND category NOT IN {d.text_list(v.CANONICAL_CATEGORIES)}",
)
VIEWS["v_stock"] = """
SELECT CASE WHEN stock = 0 THEN 'out_of_stock' ELSE 'invalid_stock' END AS rule, CASE WHEN stock = 0 THEN 'warning' ELSE 'error' END AS severity,
  product_id, product_group_id,
  CASE WHEN stock IS NULL THEN 'stock is missing or not a number' WHEN stock = 0 THEN 'stock is 0' ELSE 'stock ' || CAST(stock AS VARCHAR) || ' is negative' END AS message, row_index
FROM v_products WHERE stock IS NULL OR stock <= 0
"""
VIEWS["v_price"] = """
SELECT CASE WHEN price IS NULL THEN 'invalid_price' ELSE 'invalid_non_positive_price' END AS rule, 'error' AS severity, product_id, product_group_id,
  CASE WHEN price IS NULL THEN 'price is missing or not a number' ELSE 'price ' || CAST(price AS VARCHAR) || ' is not positive' END AS message, row_index
FROM v_products WHERE price IS NULL OR price <= 0
"""
VIEWS["v_sale_price"] = """
SELECT CASE WHEN sale_price IS NULL THEN 'invalid_sale_price' WHEN sale_price <= 0 THEN 'invalid_non_positive_sale_price' ELSE 'sale_price_greater_than_price' END AS rule,
  'error' AS severity, product_id, product_group_id,
  CASE WHEN sale_price IS NULL THEN 'sale_price is missing or not a number' WHEN sale_price <= 0 THEN 'sale_price ' || CAST(sale_price AS VARCHAR) || ' is not positive'
       ELSE 'sale_price ' || CAST(sale_price AS VARCHAR) || ' is greater than price ' || CAST(price AS VARCHAR) END AS message, row_index
FROM v_products WHERE sale_price_provided AND (sale_price IS NULL OR sale_price <= 0 OR (price > 0 AND sale_price > price))
"""
VIEWS["v_medians"] = """
SELECT cat_key AS category_key, count(*) AS n, CAST(median(price) AS DOUBLE) AS median FROM v_std WHERE cat_key <> '' AND price > 0 GROUP BY 1 HAVING count(*) >= 5
"""


def _plain(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE printf('%.2f', {x}) END"


VIEWS["v_outliers"] = _say(
    "category_price_anomaly", "warning",
    f"'price ' || CAST(price AS VARCHAR) || ' in category ''' || category || ''' has median ' || {_plain('median')} || ' and ratio ' || {_plain('(price / median)')}",
    "FROM v_std JOIN v_medians ON category_key = cat_key WHERE price > 0 AND (price < median * 0.25 OR price > median * 4)",
)
VIEWS["v_keywords"] = d.keyword_rows()
VIEWS["v_name_hits"] = """
SELECT p.row_index, k.category, arg_min(k.keyword, k.place) AS keyword
FROM v_products p JOIN v_keywords k ON contains(regexp_replace(lower(p.product_name), '[-_/ ]+', '', 'g'), k.keyword) GROUP BY ALL
"""
VIEWS["v_mismatch"] = _say(
    "product_category_mismatch", "warning",
    "'product_name keyword ''' || keyword || ''' implies category ''' || implied || ''' but current category is ''' || cat_key || ''''",
    """FROM v_std JOIN (SELECT row_index, min(category) AS implied, min(keyword) AS keyword FROM v_name_hits GROUP BY row_index HAVING count(*) = 1)
       USING (row_index) WHERE cat_key <> '' AND implied <> cat_key""",
)

# Text search. RE2 has no look-around: every non-digit is doubled first, so that a boundary character can be
# consumed on both sides of it.


def _doubled(x: str) -> str:
    return rf"regexp_replace({x}, '([^0-9])', '\1\1', 'g')"


def _hits(x: str, core: str, left: str = "[^0-9]", right: str = "[^0-9]") -> str:
    found = f"regexp_extract_all({_doubled(x)}, '(?:^|{left})({core})(?:$|{right})', 1)"
    return rf"list_transform({found}, lambda h: regexp_replace(h, '([^0-9])[^0-9]', '\1', 'g'))"


_SEP = f"(?:[-{d.WS[1:-1]}][-{d.WS[1:-1]}])"
_DIGITS = r"regexp_replace(value, '[^0-9]', '', 'g')"
VIEWS["v_texts"] = " UNION ALL ".join(
    f"SELECT row_index, '{name}' AS field, {i} AS place, {name} AS body FROM v_products WHERE {name} <> ''"
    for i, name in enumerate(v.SCANNED_FIELDS)
)
VIEWS["v_terms"] = d.term_rows(v.PROHIBITED_TERMS)
VIEWS["v_term_hits"] = f"""
SELECT row_index, field, t.term AS value, t.term AS masked FROM v_texts JOIN v_terms t ON contains({d.squash('body')}, {d.squash('t.term')})
"""
_MASKED_MAIL = (
    "CASE WHEN length(split_part(value, '@', 1)) <= 2 THEN left(value, 1) || repeat('*', greatest(1, length(split_part(value, '@', 1)) - 1)) "
    "ELSE left(value, 2) || repeat('*', length(split_part(value, '@', 1)) - 2) END || substr(value, strpos(value, '@'))"
)
_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def _first_per(hits: str, key: str) -> str:
    """Unnested hits of v_texts, first per key and field."""
    return f"""SELECT row_index, field, value FROM (SELECT row_index, field, body, unnest({hits}) AS value FROM v_texts)
      QUALIFY row_number() OVER (PARTITION BY row_index, field, {key} ORDER BY strpos(body, value)) = 1"""


VIEWS["v_email_hits"] = f"SELECT *, {_MASKED_MAIL} AS masked FROM (" + _first_per(f"regexp_extract_all(body, '{_MAIL}')", "lower(value)") + ")"
_MOBILE = _hits("body", "01[016789]" + _SEP + "?[0-9]{3,4}" + _SEP + "?[0-9]{4}")
_LANDLINE = _hits("body", "0(?:2|[3-6][0-9])" + _SEP + "?[0-9]{3,4}" + _SEP + "?[0-9]{4}")
_PHONE_PARTS = f"regexp_split_to_array(value, '[-{d.WS[1:-1]}]+')"
VIEWS["v_phone_hits"] = f"""
SELECT *, CASE WHEN len({_PHONE_PARTS}) >= 3 THEN {_PHONE_PARTS}[1] || '-****-' || {_PHONE_PARTS}[-1]
  ELSE left({_DIGITS}, CASE WHEN {_DIGITS} LIKE '02%' THEN 2 ELSE 3 END) || '****' || right({_DIGITS}, 4) END AS masked
FROM ({_first_per(f"list_concat({_MOBILE}, {_LANDLINE})", _DIGITS)})
"""
_RESIDENT = _hits("body", "[0-9]{6}--[1-4][0-9]{6}")
VIEWS["v_resident_hits"] = f"SELECT *, left(value, 7) || '*******' AS masked FROM ({_first_per(_RESIDENT, 'value')})"
_ACCOUNT = _hits(
    "body", "(?:[0-9]" + _SEP + "?){9,13}[0-9]", "[^0-9-]", f"[^0-9{d.WS[1:-1]}-]|{_SEP}(?:$|[^0-9])"
)
_CONTEXT = " OR ".join(f"contains({d.squash('body')}, '{term}')" for term in v.ACCOUNT_CONTEXT_TERMS)
VIEWS["v_account_hits"] = f"""
SELECT *, left({_DIGITS}, 3) || '-***-***' || right({_DIGITS}, 3) AS masked FROM ({_first_per(_ACCOUNT, _DIGITS)}) h
WHERE NOT EXISTS (SELECT 1 FROM v_phone_hits p WHERE p.row_index = h.row_index AND p.field = h.field AND contains(h.value, p.value))
  AND EXISTS (SELECT 1 FROM v_texts t WHERE t.row_index = h.row_index AND t.field = h.field AND ({_CONTEXT}))
"""
_SCANS = (
    ("prohibited_term", "error", "prohibited term", "v_term_hits"),
    ("email_address", "error", "email address", "v_email_hits"),
    ("phone_number", "error", "phone number", "v_phone_hits"),
    ("resident_registration_number", "error", "resident registration number", "v_resident_hits"),
    ("suspected_bank_account", "warning", "suspected bank account", "v_account_hits"),
)
VIEWS["v_text_scan"] = " UNION ALL ".join(
    _say(rule, severity, f"'field ''' || field || ''' contains {what} ''' || masked || ''''",
         f"FROM {view} JOIN v_products USING (row_index)")
    for rule, severity, what, view in _SCANS
)

RULE_VIEWS = {
    "rule_dup_id": ("duplicate_product_id", "v_dup_id"),
    "rule_group_category": ("inconsistent_group_category", "v_group_cat"),
    "rule_group_size": ("inconsistent_group_size_system", "v_group_size"),
    "rule_dup_variant": ("duplicate_variant_combination", "v_dup_variant"),
    "rule_dup_name": ("duplicate_product_name", "v_dup_name"),
    "rule_dup_content": ("duplicate_product_content", "v_dup_content"),
    "rule_missing": ("missing_required_field", "v_missing"),
    "rule_color": ("non_standard_color", "v_bad_color"),
    "rule_size": ("non_standard_size", "v_bad_size"),
    "rule_category": ("invalid_category", "v_bad_category"),
    "rule_stock": ("stock", "v_stock"),
    "rule_price": ("price", "v_price"),
    "rule_sale_price": ("sale_price", "v_sale_price"),
    "rule_price_outlier": ("category_price_anomaly", "v_outliers"),
    "rule_category_mismatch": ("product_category_mismatch", "v_mismatch"),
    "rule_text_scan": ("text_scan", "v_text_scan"),
}


def _register_rules() -> None:
    def builder(rule: str):
        return lambda spark, sf_dir: rule_issues(products(spark, sf_dir), rule).select(*ISSUE_COLUMNS)

    for name, (rule, view) in RULE_VIEWS.items():
        query(name, f"SELECT * FROM {view}")(builder(rule))


_register_rules()
VIEWS["v_issues"] = " UNION ALL ".join(f"SELECT * FROM {view}" for _, view in RULE_VIEWS.values())


@query("inspect_issues", "SELECT * FROM v_issues")
def _inspect_issues(spark, sf_dir):
    return inspect(products(spark, sf_dir)).select(*ISSUE_COLUMNS)


@query("category_medians", "SELECT * FROM v_medians")
def _category_medians(spark, sf_dir):
    return group_rules.category_medians(products(spark, sf_dir), v.DEFAULT)


@query("group_members", """
SELECT 'duplicate_product_id' AS rule, product_id AS "group", row_index + 2 AS row_number, product_id FROM v_dup_id
UNION ALL SELECT 'inconsistent_group_category', product_group_id, row_index + 2, product_id FROM v_group_cat
UNION ALL SELECT 'duplicate_variant_combination', concat_ws(chr(31), product_group_id, color_key, size_key), row_index + 2, product_id FROM v_variant_rows
UNION ALL SELECT 'duplicate_product_name', name_key, row_index + 2, product_id FROM v_name_rows
""")
def _group_members(spark, sf_dir):
    return group_rules.group_members(products(spark, sf_dir), v.DEFAULT)


@query("group_categories", """
SELECT product_group_id, cat_key AS category_key, arg_min(category, row_index) AS shown, count(*) AS n,
  min(row_index) + 2 AS first_row
FROM v_keyed JOIN v_mixed_groups USING (product_group_id) WHERE cat_key <> '' GROUP BY product_group_id, cat_key
""")
def _group_categories(spark, sf_dir):
    return group_rules.group_categories(products(spark, sf_dir), v.DEFAULT)


@query("group_category_members", """
SELECT product_group_id, cat_key AS category_key, row_index + 2 AS row_number, product_id
FROM v_keyed JOIN v_mixed_groups USING (product_group_id) WHERE cat_key <> ''
""")
def _group_category_members(spark, sf_dir):
    return group_rules.group_category_members(products(spark, sf_dir), v.DEFAULT)


# --- text search and masking ---


def _texts(spark, sf_dir) -> DataFrame:
    return scan.fields_long(products(spark, sf_dir), ["row_index"], list(v.SCANNED_FIELDS))


def _corpus(spark, sf_dir) -> DataFrame:
    """Every text of the three text tables, whole."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("part"), "text"
    )
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.lit(0).cast("bigint").alias("part"),
        F.col("html").alias("text"),
    )
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.lit("conversations").alias("source"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text"
    )
    return documents.unionByName(pages).unionByName(talks)


VIEWS["v_corpus"] = """
SELECT 'documents' AS source, doc_id AS id, 0::BIGINT AS part, text AS body FROM documents
UNION ALL SELECT 'pages', page_id, 0, html FROM pages UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations
"""


@query("scan_terms", "SELECT row_index, field, value FROM v_term_hits")
def _scan_terms(spark, sf_dir):
    return scan.scan_terms(_texts(spark, sf_dir)).select("row_index", "field", "value")


@query("scan_email", f"""
SELECT source, id, part, value, {_MASKED_MAIL} AS masked FROM (
  SELECT source, id, part, unnest(h) AS value, generate_subscripts(h, 1) AS place0 FROM (SELECT source, id, part, regexp_extract_all(body, '{_MAIL}') AS h FROM v_corpus))
QUALIFY row_number() OVER (PARTITION BY source, id, part, lower(value) ORDER BY place0) = 1
""")
def _scan_email(spark, sf_dir):
    return scan.scan_emails(_corpus(spark, sf_dir)).drop("pos")


@query("scan_phone", "SELECT row_index, field, value, masked FROM v_phone_hits")
def _scan_phone(spark, sf_dir):
    return scan.scan_phones(_texts(spark, sf_dir)).select("row_index", "field", "value", "masked")


@query("scan_rrn", "SELECT row_index, field, value, masked FROM v_resident_hits")
def _scan_rrn(spark, sf_dir):
    return scan.scan_residents(_texts(spark, sf_dir)).select("row_index", "field", "value", "masked")


@query("scan_account", "SELECT row_index, field, value, masked FROM v_account_hits")
def _scan_account(spark, sf_dir):
    return scan.scan_accounts(_texts(spark, sf_dir)).select("row_index", "field", "value", "masked")


@query("scan_corpus_counts", f"""
SELECT source, CAST(sum(len(regexp_extract_all(body, '{_MAIL}'))) AS BIGINT) AS emails,
  CAST(sum(len({_MOBILE}) + len({_LANDLINE})) AS BIGINT) AS phones, CAST(sum(len({_RESIDENT})) AS BIGINT) AS residents
FROM v_corpus GROUP BY source
""")
def _scan_corpus_counts(spark, sf_dir):
    from catalake.functions import privacy

    def total(*patterns: str):
        return F.sum(sum((F.size(privacy.hits(F.col("text"), p)) for p in patterns), F.lit(0))).cast("bigint")

    return _corpus(spark, sf_dir).groupBy("source").agg(
        total(privacy.EMAIL).alias("emails"), total(privacy.MOBILE, privacy.LANDLINE).alias("phones"),
        total(privacy.RESIDENT).alias("residents"),
    )


_MASK_ALL_MAIL = f"""array_to_string(list_transform(list_zip(string_split_regex(body, '{_MAIL}'), regexp_extract_all(body, '{_MAIL}')),
  lambda z: z[1] || CASE WHEN z[2] IS NULL THEN '' ELSE {_MASKED_MAIL.replace('value', 'z[2]')} END), '')"""


@query("mask_text", f"SELECT source, id, part, {_MASK_ALL_MAIL} AS masked FROM v_corpus")
def _mask_text(spark, sf_dir):
    """The corpus holds e-mail addresses but no Korean numbers; those are covered by ``mask_table``."""
    return scan.mask_columns(_corpus(spark, sf_dir), ["text"]).withColumnRenamed("text", "masked")


def _replace_hits(body: str, *views: str) -> str:
    """Masked text built from the hits of each kind, for texts that hold each value once."""
    joined = " UNION ALL ".join(f"SELECT row_index, field, value, masked FROM {view}" for view in views)
    return f"coalesce((SELECT list_reduce(list_prepend({{'value': '', 'masked': t.body}}, list({{'value': h.value, 'masked': h.masked}} ORDER BY length(h.value) DESC)), lambda a, b: {{'value': '', 'masked': replace(a.masked, b.value, b.masked)}}).masked FROM ({joined}) h WHERE h.row_index = t.row_index AND h.field = t.field), t.body)"


VIEWS["v_all_emails"] = f"SELECT row_index, field, unnest(regexp_extract_all(body, '{_MAIL}')) AS value FROM v_texts"
VIEWS["v_all_mails"] = f"SELECT DISTINCT row_index, field, value, {_MASKED_MAIL} AS masked FROM v_all_emails"
VIEWS["v_all_phones"] = f"""
SELECT DISTINCT row_index, field, value, CASE WHEN len({_PHONE_PARTS}) >= 3 THEN {_PHONE_PARTS}[1] || '-****-' || {_PHONE_PARTS}[-1]
  ELSE left({_DIGITS}, CASE WHEN {_DIGITS} LIKE '02%' THEN 2 ELSE 3 END) || '****' || right({_DIGITS}, 4) END AS masked
FROM (SELECT row_index, field, unnest(list_concat({_MOBILE}, {_LANDLINE})) AS value FROM v_texts)
"""


@query("mask_table", f"""
SELECT t.row_index, t.field, {_replace_hits('body', 'v_all_mails', 'v_all_phones', 'v_resident_hits')} AS masked FROM v_texts t
""")
def _mask_table(spark, sf_dir):
    masked = scan.mask_table(products(spark, sf_dir))
    return scan.fields_long(masked, ["row_index"], list(v.SCANNED_FIELDS)).select(
        "row_index", "field", F.col("text").alias("masked")
    )
