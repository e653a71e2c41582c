"""Group rules against their pairwise definitions, and on large groups."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from catalake.functions.vocabulary import DEFAULT
from catalake.operators import group_rules, report
from catalake.operators.inspect import RULES, in_discovery_order, inspect, rule_issues
from catalake.operators.row_rules import RowRule, finding
from catalake.sources.catalog import MissingColumns, load_catalog

FIELDS = "row_index bigint, product_group_id string, product_id string, product_name string, category string, color string, size string, stock string, price string, image_path string, sale_price string, description string, seller string"


def catalog(spark, rows):
    full = []
    for i, row in enumerate(rows):
        base = dict(
            product_group_id="G1", product_id=f"P{i}", product_name=f"name {i}", category="TOP", color="BLACK", size="M",
            stock="5", price="100", image_path="x.jpg", sale_price="", description="", seller="",
        )
        base.update(row)
        full.append((i, *[base[f.split()[0]] for f in FIELDS.split(", ")[1:]]))
    return load_catalog(spark.createDataFrame(full, FIELDS))


def random_rows(n, seed):
    rng = random.Random(seed)
    return [
        dict(
            product_group_id=rng.choice(["G1", "g1", "G2", ""]) if rng.random() < 0.3 else f"G{rng.randint(3, 12)}",
            product_id=rng.choice(["A", "a", "B", "C", "", f"P{rng.randint(0, 30)}"]),
            product_name=rng.choice(["Shirt", "shirt!", "Pants", "", "모자"]) + (f" {rng.randint(0, 6)}" if rng.random() < 0.7 else ""),
            category=rng.choice(["TOP", "BAG", "tops", "HAT", ""]),
            color=rng.choice(["BLACK", "black", "Red", "", "x  y", "X y"]),
            size=rng.choice(["M", "medium", "", "95", "XL"]),
            price=rng.choice(["100", "200", "0", "abc", ""]),
        )
        for _ in range(n)
    ]


def content(p):
    ok = all([p.product_group_id, p.product_id, p.product_name, p.color]) and p.category in ("TOP", "BOTTOM", "OUTER", "SHOES", "BAG")
    if not ok or not (p.size or p.category == "BAG") or p.price is None or p.price <= 0:
        return None
    flat = lambda s: " ".join(s.split()).casefold()
    return (flat(p.product_name), flat(p.category), flat(p.color), flat(p.size), p.price)


COLORS = {"BLACK": "BLACK", "black": "BLACK", "Red": "RED", "x  y": "x y", "X y": "x y"}
SIZES = {"M": "M", "medium": "M", "95": "95", "XL": "XL"}


def flagged_variants(products):
    out = set()
    for a, b in itertools.permutations(products, 2):
        def key(p):
            size = SIZES.get(p.size, "" if p.category == "BAG" else None)
            return (p.product_group_id, COLORS.get(p.color), size)

        if not a.product_group_id or not a.product_id or not b.product_id or None in key(a) or key(a) != key(b):
            continue
        if a.product_id != b.product_id and not (content(a) is not None and content(a) == content(b)):
            out.add(a.row_index)
    return out


def flagged_names(products):
    norm = lambda s: "".join(c for c in s.casefold() if c.isascii() and c.isalnum() or "가" <= c <= "힣")
    low = lambda s: s.strip().casefold()
    out = set()
    for a, b in itertools.permutations(products, 2):
        if not norm(a.product_name) or norm(a.product_name) != norm(b.product_name):
            continue
        differ = lambda x, y: x and y and x != y
        option = (
            low(a.product_group_id) and low(a.product_group_id) == low(b.product_group_id)
            and low(a.product_id) and low(b.product_id) and low(a.product_id) != low(b.product_id)
            and (differ(low(a.color), low(b.color)) or differ(low(a.size), low(b.size)))
        )
        if not option:
            out.add(a.row_index)
    return out


def flagged_rows(products, rule):
    return sorted(r.row_index for r in rule_issues(products, rule).select("row_index").collect())


def test_pair_rules_equal_the_pairwise_definition(spark):
    products = catalog(spark, random_rows(400, 3)).cache()
    local = products.collect()
    assert flagged_rows(products, "duplicate_variant_combination") == sorted(flagged_variants(local))
    assert flagged_rows(products, "duplicate_product_name") == sorted(flagged_names(local))


def test_option_pairs_in_one_product(spark):
    """Only options of one product: the counts per color and size decide."""
    rng = random.Random(5)
    rows = [
        dict(product_name=f"Item {rng.randint(0, 25)}", product_id=f"P{i}", color=rng.choice(["", "BLACK", "Red", "x  y"]),
             size=rng.choice(["", "M", "XL", "95"]))
        for i in range(150)
    ]
    products = catalog(spark, rows).cache()
    assert flagged_rows(products, "duplicate_product_name") == sorted(flagged_names(products.collect()))


def test_messages(spark):
    rows = [
        dict(product_id="A", product_name="Red Shirt"), dict(product_id="A", product_name="red-shirt", color="RED", category="tops"),
        dict(product_id="B", color="블랙", size="medium", price="200"), dict(product_id="C", size="95", category="BAG"),
    ]
    found = {(r.rule, r.row_index): r.message for r in inspect(catalog(spark, rows)).collect()}
    assert found["duplicate_product_id", 0] == "product_id 'A' is used in 2 rows, first in row 2"
    assert found["duplicate_product_name", 1] == "product_name 'red-shirt' normalized to 'redshirt' is used in 2 rows, first in row 2"
    variant = found["duplicate_variant_combination", 2].removeprefix("duplicate_variant_combination:")
    assert json.loads(variant) == {"product_group_id": "G1", "color": "BLACK", "size": "M", "count": 2, "first_row": 2}
    mixed = found["inconsistent_group_category", 3].removeprefix("inconsistent_group_category:")
    assert json.loads(mixed) == {"product_group_id": "G1", "categories": ["가방", "상의"], "count": 4, "first_row": 2}
    assert found["inconsistent_group_size_system", 3] == "product group mixes alpha and numeric size systems"
    assert found["non_standard_color", 2] == "color '블랙' should be standardized to 'BLACK'"
    assert found["invalid_category", 1] == "category 'tops' is not one of ['BAG', 'BOTTOM', 'OUTER', 'SHOES', 'TOP']"


def test_no_category_of_a_mixed_group_is_lost(spark):
    shown = ["TOP", "bag", "Odd ", "BAG", "tops", "zebra"]
    rows = [dict(product_id=f"P{i}", category=c) for i, c in enumerate(shown)]
    rows += [dict(product_id="Q", product_group_id="G2", category="TOP")]
    products = catalog(spark, rows)
    found = group_rules.group_categories(products, DEFAULT).collect()
    assert {r["product_group_id"] for r in found} == {"G1"}
    assert sorted((r["shown"].strip(), r["n"], r["first_row"]) for r in found) == [
        ("Odd", 1, 4), ("TOP", 2, 2), ("bag", 2, 3), ("zebra", 1, 7)]
    members = group_rules.group_category_members(products, DEFAULT).collect()
    keys_of = {r["first_row"]: r["category_key"] for r in found}
    assert sorted((r["row_number"], r["category_key"]) for r in members) == sorted(
        (row, keys_of[first]) for row, first in [(2, 2), (3, 3), (4, 4), (5, 3), (6, 2), (7, 7)])


def test_output_is_linear_in_the_size_of_a_group(spark):
    """One key of 50,000 rows: an issue per row, all of one short length, and the members once in the long table."""
    rows = spark.range(50_000).select(
        F.col("id").alias("row_index"), *[F.lit(x).alias(name) for name, x in (
            ("product_group_id", "G"), ("product_id", "A"), ("product_name", "Shirt"), ("category", "TOP"), ("color", "BLACK"),
            ("size", "M"), ("stock", "5"), ("price", "100"), ("image_path", "x.jpg"), ("sale_price", ""), ("description", ""),
            ("seller", ""))],
    )
    products = load_catalog(rows)
    found = rule_issues(products, "duplicate_product_id").agg(
        F.count("*").alias("n"), F.max(F.length("message")).alias("longest"), F.count_distinct("message").alias("messages")
    ).first()
    assert (found["n"], found["messages"]) == (50_000, 1) and found["longest"] < 80
    members = group_rules.group_members(products, DEFAULT).where("rule = 'duplicate_product_id'")
    assert members.count() == 50_000


def test_plan_of_all_rules_needs_no_job(spark):
    products = catalog(spark, random_rows(20, 1))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    plan = inspect(products)._jdf.queryExecution().executedPlan().toString()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) == before
    assert plan.count("Exchange hashpartitioning") <= 28


def test_many_catalogs_at_once_equal_one_at_a_time(spark):
    products = catalog(spark, random_rows(300, 9)).withColumn("catalog_id", F.col("row_index") % 3).cache()
    together = inspect(products).select("catalog_id", "rule", "row_index", "message").collect()
    apart = []
    for k in range(3):
        one = products.where(F.col("catalog_id") == k).drop("catalog_id")
        apart += [(k, *r) for r in inspect(one).select("rule", "row_index", "message").collect()]
    assert sorted(tuple(r) for r in together) == sorted(apart)


def test_result_does_not_depend_on_partitions(spark):
    products = catalog(spark, random_rows(200, 4)).cache()
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = in_discovery_order(inspect(products.repartition(int(n) % 7 + 1))).select("rule", "row_index", "message").collect()
            seen.add(tuple(tuple(r) for r in rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_skewed_key_is_split(spark):
    """A key with most rows ends in several tasks: salts spread it and adaptive execution may split it further."""
    hot = spark.range(0, 60_000).select(
        F.col("id").alias("row_index"), F.when(F.col("id") % 3 < 2, F.lit("HOT")).otherwise(F.concat(F.lit("P"), F.col("id"))).alias("product_id"),
        F.lit("G").alias("product_group_id"),
    )
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        from catalake.operators.skew import salted_join

        counts = hot.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        joined = salted_join(hot, counts, ["product_id"])
        per_task = joined.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert sum(r["count"] for r in per_task) == 40_000
        plain = salted_join(hot, counts, ["product_id"])
        rows = plain.select("row_index")
        assert rows.count() == 40_000
        assert len(per_task) >= 3 and max(r["count"] for r in per_task) < 30_000
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_rule_plans_hold_no_python_and_no_product_join(spark):
    products = catalog(spark, random_rows(20, 1))
    for rule in RULES:
        plan = rule_issues(products, rule.name)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_own_rule_can_be_added(spark):
    no_seller = RowRule("no_seller", 99, lambda vocab: F.array_compact(F.array(F.when(F.col("seller") == "", finding("no_seller", "warning", "no seller")))))
    issues = inspect(catalog(spark, [dict(), dict(seller="x")]), rules=(no_seller,))
    assert [(i.rule, i.row_index) for i in issues.collect()] == [("no_seller", 0)]
    assert report.report(issues).first()["error_field"] == "no_seller"


def test_missing_columns_are_refused(spark):
    with pytest.raises(MissingColumns):
        load_catalog(spark.createDataFrame([(0, "x")], "row_index bigint, product_id string"))


def test_work_is_spread_however_small_the_file(spark):
    rows = [dict(product_name="same", description=f"tel 010-1234-{i:04}") for i in range(400)]
    products = catalog(spark, rows).coalesce(1)
    tasks = lambda frame: frame.select(F.spark_partition_id()).distinct().count()
    assert tasks(rule_issues(products, "text_scan")) > 1
    assert tasks(group_rules.flagged(products, names=(group_rules.SAME_NAME,))) > 1
    again = catalog(spark, [*rows, *rows]).coalesce(1).withColumn("row_index", F.lit(None).cast("bigint"))
    assert rule_issues(again, "text_scan").count() == 800


def test_results_that_grow_with_the_rows_are_not_broadcast(spark):
    issues = inspect(catalog(spark, random_rows(20, 1)))
    plan = report.in_report_order(report.report(issues))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_issues_are_found_once_for_a_sort(spark):
    issues = inspect(catalog(spark, [dict(product_name="same", stock="x")] * 3))
    ordered = report.in_report_order(report.report(issues))
    plan = ordered._jdf.queryExecution().executedPlan().toString()
    between = plan[plan.index("rangepartitioning"):plan.index("Union")]
    assert "REPARTITION_BY_NUM" in between
    order = [(r.severity_rank, r.rule_ord, r.lead_row, r.row_index, r.sub_ord) for r in ordered.collect()]
    assert order == sorted(order) and len(order) == issues.count()


def test_products_are_read_once_for_all_rules(spark, tmp_path):
    """All steps of an inspection share one shuffle of the products, so their table is read and typed once."""
    catalog(spark, random_rows(30, 2)).write.parquet(f"{tmp_path}/catalog")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan then shows the shuffles that are used again
    try:
        reported = report.report(inspect(spark.read.parquet(f"{tmp_path}/catalog")))
        plan = report.count_by_risk(reported)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert plan.count("FileScan parquet") == 1
