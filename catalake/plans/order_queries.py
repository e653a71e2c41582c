"""Queries on promotions carried out in the order of their requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalake.functions import vocabulary as v
from catalake.operators import history, promote
from catalake.operators.change_ids import dense_ids, linked
from catalake.operators.promotion_order import last_changes, run_in_order
from catalake.plans.batch_queries import _length_text
from catalake.plans.fixtures import LOTS
from catalake.plans.registry import VIEWS, query

# Every part belongs to a lot of its supplier and is staged by up to three batches (waves) of the lot. By lot, the waves:
# 0 leave prices alone, so that only new products make later previews stale; 1 change some prices, agree with the catalog
# again, and change them on top of a preview made after the first wave; 2 lack eligibility at first; 3 come with a wrong
# hash at first; 4 are requested in reverse order; 5 come without a hash, twice, and after an earlier success.
_MORE = (
    "CASE WHEN lot = 1 AND wave = 0 AND k % 4 = 1 THEN 500 WHEN lot = 1 AND wave = 2 THEN 700 "
    "WHEN lot = 2 THEN 100 * wave WHEN lot = 3 AND wave > 0 THEN 100 WHEN lot = 4 THEN 100 + wave WHEN lot = 5 THEN 900 ELSE 0 END"
)
_BATCH = "s * 1000 + lot * 10 + wave"
_PLACE = "lot * 100 + CASE WHEN lot = 4 THEN 2 - wave ELSE wave END * 10 + s"
_FIELDS = ", ".join(f"price + {_MORE} AS price" if n == "price" else n for n in v.COMPARED_FIELDS)

VIEWS["v_lot_catalog"] = f"SELECT supplier_key, external_product_id, {', '.join(v.COMPARED_FIELDS)}, CAST(0 AS BIGINT) AS source_load_run_id FROM fx_lots WHERE k % 5 <> 0"
VIEWS["v_lot_staged"] = f"""
SELECT supplier_key, external_product_id, s, lot, wave, {_BATCH} AS load_run_id, {_FIELDS}
FROM (SELECT *, unnest([0, 1, 2]) AS wave FROM fx_lots) WHERE (k + wave) % 7 <> 0
"""
VIEWS["v_lot_requests"] = f"""
SELECT request_no, load_run_id AS id, staged_rows, lot = 5 AND wave = 0 AS refused, lot = 5 AND wave = 2 AS done,
  NOT (lot = 2 AND wave = 0) AS eligible, lot = 3 AND wave = 0 AS wrong,
  CASE WHEN lot = 1 AND wave = 2 THEN [lot * 100 + s] ELSE CAST([] AS BIGINT[]) END AS assumes, row_number() OVER (ORDER BY request_no) AS n
FROM (SELECT DISTINCT s, lot, wave, load_run_id, {_PLACE} + extra AS request_no, count(*) OVER (PARTITION BY load_run_id, extra) AS staged_rows
  FROM (SELECT *, unnest(CASE WHEN lot = 5 AND wave = 1 THEN [0, 5] ELSE [0] END) AS extra FROM v_lot_staged))
"""
VIEWS["v_lot_items"] = f"""
SELECT r.request_no, r.id, s.supplier_key, s.external_product_id, {_length_text('s')} AS after_text,
  CASE WHEN c.supplier_key IS NULL THEN 'none' ELSE {_length_text('c')} END AS before_text
FROM v_lot_requests r JOIN v_lot_staged s ON s.load_run_id = r.id
LEFT JOIN v_lot_catalog c ON c.supplier_key = s.supplier_key AND c.external_product_id = s.external_product_id
"""
VIEWS["v_lot_pairs"] = """
SELECT a.request_no, a.supplier_key, a.external_product_id, a.before_text, b.request_no AS earlier, b.after_text
FROM v_lot_items a JOIN v_lot_items b ON a.supplier_key = b.supplier_key AND a.external_product_id = b.external_product_id AND b.request_no < a.request_no
"""
# The requests one after the other: which of them go ahead, by number.
VIEWS["v_lot_fold"] = """
SELECT unnest(going) AS request_no FROM (
  WITH RECURSIVE fold(n, going, batches) AS (
    SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[])
    UNION ALL
    SELECT n, CASE WHEN ok THEN list_append(going, request_no) ELSE going END, CASE WHEN ok THEN list_append(batches, id) ELSE batches END
    FROM (
      SELECT r.n, r.request_no, r.id, f.going, f.batches,
        r.eligible AND NOT r.refused AND NOT r.done AND NOT r.wrong AND NOT list_contains(f.batches, r.id) AND NOT coalesce((
          SELECT bool_or(coalesce(actual, before_text) <> coalesce(assumed, before_text)) FROM (
            SELECT any_value(p.before_text) AS before_text, max_by(p.after_text, p.earlier) FILTER (WHERE list_contains(f.going, p.earlier)) AS actual,
              max_by(p.after_text, p.earlier) FILTER (WHERE list_contains(r.assumes, p.earlier)) AS assumed
            FROM v_lot_pairs p WHERE p.request_no = r.request_no GROUP BY p.supplier_key, p.external_product_id)), false) AS ok
      FROM fold f JOIN v_lot_requests r ON r.n = f.n + 1))
  SELECT going FROM fold ORDER BY n DESC LIMIT 1)
"""
VIEWS["v_lot_changes"] = """
SELECT request_no, id, supplier_key, external_product_id, CASE WHEN before_text = 'none' THEN 'insert' WHEN before_text <> after_text THEN 'update' ELSE 'unchanged' END AS action
FROM (SELECT i.request_no, i.id, i.supplier_key, i.external_product_id, i.after_text,
    coalesce(max_by(p.after_text, p.earlier) FILTER (WHERE p.earlier IN (SELECT request_no FROM v_lot_fold)), any_value(i.before_text)) AS before_text
  FROM v_lot_items i LEFT JOIN v_lot_pairs p ON p.request_no = i.request_no AND p.supplier_key = i.supplier_key AND p.external_product_id = i.external_product_id
  WHERE i.request_no IN (SELECT request_no FROM v_lot_fold) GROUP BY ALL)
"""


def _tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lots = LOTS.frame(spark, sf_dir)
    catalog = lots.where("k % 5 <> 0").select(*promote.IDENTITY, *v.COMPARED_FIELDS, F.lit(0).cast("long").alias("source_load_run_id"))
    waves = lots.withColumn("wave", F.explode(F.array(*[F.lit(i) for i in range(3)]))).where("(k + wave) % 7 <> 0")
    staged = waves.withColumns({"price": F.expr(f"price + {_MORE}"), "load_run_id": F.expr(_BATCH), "id": F.expr("k * 3 + wave")})
    return staged.withColumnRenamed("external_product_id", "product_id"), catalog


def _requests(staged: DataFrame, catalog: DataFrame) -> DataFrame:
    """The requests with the hashes of the previews that their senders saw."""
    at_first = promote.preview_hash(promote.preview(staged, catalog))
    first_wave = promote.preview(staged.where("lot = 1 and wave = 0"), catalog)
    moved = promote.apply_promotion(catalog, first_wave.where("action <> 'unchanged'"))
    after_first = promote.preview_hash(promote.preview(staged.where("lot = 1 and wave = 2"), moved))
    seen = at_first.join(after_first.withColumnRenamed("preview_hash", "later"), ["load_run_id", "supplier_key"], "left")
    batches = staged.groupBy("s", "lot", "wave", "load_run_id").agg(F.count(F.lit(1)).alias("staged_rows"))
    sent = (
        F.when(F.expr("lot = 3 and wave = 0"), F.repeat(F.lit("0"), 64)).when(F.expr("not (lot = 5 and wave = 0)"), F.coalesce("later", "preview_hash"))
    )
    times = F.when(F.expr("lot = 5 and wave = 1"), F.array(F.lit(0), F.lit(5))).otherwise(F.array(F.lit(0)))
    return batches.join(seen, "load_run_id").select(
        "lot", "wave", "staged_rows", F.col("load_run_id").alias("id"), sent.alias("expected_hash"), F.explode(times).alias("extra"),
        F.expr(_PLACE).alias("place"),
    ).withColumn("request_no", (F.col("place") + F.col("extra")).cast("long"))


def _ordered(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    staged, catalog = _tables(spark, sf_dir)
    requests = _requests(staged, catalog)
    eligible = requests.select("id", "staged_rows", F.expr("not (lot = 2 and wave = 0)").alias("eligible")).distinct()
    runs, changes = run_in_order(
        staged, catalog, eligible, requests.select("request_no", "id", "expected_hash"), requests.where("lot = 5 and wave = 2").select("id")
    )
    return catalog, runs, changes


@query("promotion_ordered_runs", """
SELECT r.request_no, r.id, CASE WHEN refused THEN 'refused' WHEN goes OR early THEN 'succeeded' ELSE 'blocked' END AS status, NOT (refused OR early) AS created,
  CASE WHEN refused THEN 'invalid_preview_hash' WHEN goes OR early THEN NULL WHEN eligible THEN 'preview_stale' ELSE 'promotion_blocked' END AS failure_code,
  CASE WHEN refused OR goes OR early THEN 0 ELSE staged_rows END AS blocked_count,
  coalesce(inserted, 0)::BIGINT AS inserted_count, coalesce(updated, 0)::BIGINT AS updated_count, coalesce(same, 0)::BIGINT AS unchanged_count
FROM (SELECT *, request_no IN (SELECT request_no FROM v_lot_fold) AS goes,
    NOT refused AND (done OR EXISTS (SELECT 1 FROM v_lot_requests e JOIN v_lot_fold g ON g.request_no = e.request_no WHERE e.id = q.id AND e.request_no < q.request_no)) AS early
  FROM v_lot_requests q) r
LEFT JOIN (SELECT request_no, count_if(action = 'insert') AS inserted, count_if(action = 'update') AS updated, count_if(action = 'unchanged') AS same FROM v_lot_changes GROUP BY 1) c
ON c.request_no = r.request_no
""")
def _ordered_runs(spark, sf_dir):
    """Requests on batches that share products: a later one is stale once an earlier one changed one of its products."""
    return _ordered(spark, sf_dir)[1]


@query("promotion_ordered_changes", "SELECT request_no, id AS load_run_id, supplier_key, external_product_id, action FROM v_lot_changes WHERE action <> 'unchanged'")
def _ordered_changes(spark, sf_dir):
    changes = promote.change_log(_ordered(spark, sf_dir)[2].withColumn("load_run_id", F.struct("request_no", "load_run_id")))
    return changes.select("load_run_id.request_no", "load_run_id.load_run_id", *promote.IDENTITY, "action")


@query("promotion_ordered_apply", """
SELECT supplier_key, external_product_id, coalesce(s.product_name, c.product_name) AS product_name, coalesce(s.price, c.price) AS price, coalesce(s.load_run_id, c.source_load_run_id) AS source_load_run_id
FROM v_lot_catalog c FULL JOIN (
  SELECT x.* FROM v_lot_staged x JOIN (SELECT supplier_key, external_product_id, max_by(id, request_no) AS load_run_id FROM v_lot_changes WHERE action <> 'unchanged' GROUP BY ALL)
  USING (supplier_key, external_product_id, load_run_id)) s USING (supplier_key, external_product_id)
""")
def _ordered_apply(spark, sf_dir):
    catalog, _, changes = _ordered(spark, sf_dir)
    new = promote.apply_promotion(catalog, last_changes(changes))
    return new.select(*promote.IDENTITY, "product_name", "price", "source_load_run_id")


# Changes with numbers of their own: in the order of requests, then products.
VIEWS["v_lot_log"] = """
SELECT row_number() OVER (ORDER BY request_no, supplier_key, external_product_id) AS change_id, c.*, i.after_text,
  TIMESTAMP '2024-03-01 00:00:00' + CAST(request_no AS INTEGER) * INTERVAL 1 MINUTE AS changed_at
FROM v_lot_changes c JOIN v_lot_items i USING (request_no, id, supplier_key, external_product_id) WHERE action <> 'unchanged'
"""


def _numbered(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(catalog after all requests, change log with ids, run ids and times)."""
    catalog, _, changes = _ordered(spark, sf_dir)
    real = changes.where("action <> 'unchanged'").withColumn("changed_at", F.expr("timestampadd(MINUTE, CAST(request_no AS INT), TIMESTAMP '2024-03-01 00:00:00')"))
    return promote.apply_promotion(catalog, last_changes(changes)), dense_ids(real, ["request_no", *promote.IDENTITY], "change_id")


@query("promotion_change_page", """
SELECT change_id, request_no, supplier_key, external_product_id, action, strftime(changed_at, '%Y-%m-%d %H:%M:%S') AS changed_at
FROM v_lot_log ORDER BY change_id DESC LIMIT 20 OFFSET 40
""")
def _promotion_change_page(spark, sf_dir):
    """The third page of changes, newest first."""
    rows = history.page(_numbered(spark, sf_dir)[1], 20, 40, [F.desc("change_id")])
    shown = F.date_format("changed_at", "yyyy-MM-dd HH:mm:ss").alias("changed_at")
    return rows.select("change_id", "request_no", *promote.IDENTITY, "action", shown)


@query("rollback_links", """
SELECT l.change_id AS original_change_id, l.request_no, l.supplier_key, l.external_product_id,
  CASE WHEN l.action = 'insert' THEN 'delete' ELSE 'restore' END AS rollback_action, f.after_text <> l.after_text AS conflict
FROM v_lot_log l JOIN (SELECT supplier_key, external_product_id, max_by(after_text, request_no) AS after_text FROM v_lot_log GROUP BY ALL) f
USING (supplier_key, external_product_id)
""")
def _rollback_links(spark, sf_dir):
    """What rolling back every change would do, each linked to the change that it takes back."""
    catalog, log = _numbered(spark, sf_dir)
    items = promote.rollback_preview(log.drop("load_run_id").withColumnRenamed("request_no", "load_run_id"), catalog)
    return linked(items.withColumnRenamed("load_run_id", "request_no"), log, ["request_no", *promote.IDENTITY]).select(
        "original_change_id", "request_no", *promote.IDENTITY, "rollback_action", "conflict"
    )
