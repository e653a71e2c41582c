import pytest
from pyspark.sql import functions as F

from catalake.functions.profiles import FASHION, MARKETPLACE, PROFILES, PUBLISHED, changed_profiles, profile_rows
from catalake.functions.vocabulary import COMPARED_FIELDS
from catalake.operators import conform as cf
from catalake.operators import promote
from catalake.sources.feeds import Limits, admit_feeds, feed_rows, scan_feeds
from catalake.sources.store import StaleVersion, Store
from catalake.streaming.landing import stream_load

HEADER = list(FASHION.sources)


def feed(spark, rows, profile=FASHION):
    columns = list(profile.sources)
    data = [(i + 2, *[row.get(c, "") for c in columns]) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, "source_row_number bigint, " + ", ".join(f"{c} string" for c in columns))


GOOD = dict(
    vendor_sku="0007", item_name="Shirt", main_category="TOP", brand_name="B", list_price="1,000", discount_price="",
    colour="black", size_name="M", quantity="", description_text="", image_link="a.jpg",
)


def test_conform_keeps_zeros_defaults_and_order_of_errors(spark):
    rows = [
        GOOD,
        {**GOOD, "vendor_sku": " ", "list_price": "abc", "discount_price": "-1", "quantity": "1.5", "size_name": ""},
        {**GOOD, "main_category": "BAG", "size_name": ""},
        {**GOOD, "list_price": "₩", "quantity": "-2"},
    ]
    out = cf.conform(feed(spark, rows), FASHION, ["source_row_number"])
    good = cf.accepted(out).orderBy("source_row_number").collect()
    assert [(r.product_id, r.product_group_id, r.price, r.stock, r.size) for r in good] == [
        ("0007", "0007", "1000", "0", "M"), ("0007", "0007", "1000", "0", ""),
    ]
    bad = cf.rejected(out, ["source_row_number"]).orderBy("source_row_number").collect()
    assert [(r.error_code, r.error_field) for r in bad] == [
        (
            ["MISSING_SOURCE_VALUE", "MISSING_SOURCE_VALUE", "MISSING_PRODUCT_ID", "INVALID_PRICE", "NEGATIVE_PRICE", "INVALID_STOCK"],
            ["vendor_sku", "size_name", "product_id", "price", "sale_price", "stock"],
        ),
        (["INVALID_PRICE", "NEGATIVE_STOCK"], ["price", "stock"]),
    ]
    assert bad[0].source["list_price"] == "abc"
    summary = cf.batch_summary(out.withColumn("b", F.lit(1)), ["b"]).first()
    assert (summary.total_rows, summary.loaded_rows, summary.rejected_rows) == (4, 2, 2)
    assert sorted(summary.error_counts.items()) == [
        ("INVALID_PRICE", 2), ("INVALID_STOCK", 1), ("MISSING_PRODUCT_ID", 1), ("MISSING_SOURCE_VALUE", 2),
        ("NEGATIVE_PRICE", 1), ("NEGATIVE_STOCK", 1),
    ]


def test_marketplace_profile_reports_negative_stock(spark):
    row = dict(style_id="S", sku_code="1", title="t", category_code="BAG", label="L", regular_price="10", promo_price="",
               tone="red", fit_size="", available_qty="-1", details="", photo="p")
    out = cf.conform(feed(spark, [row], MARKETPLACE), MARKETPLACE, ["source_row_number"]).first()
    assert [e.code for e in out.errors] == ["NEGATIVE_STOCK"]


def test_published_profiles_have_not_changed(spark):
    baseline = spark.createDataFrame([(n, x, h) for (n, x), h in PUBLISHED.items()], "profile_name string, profile_version string, fingerprint string")
    assert changed_profiles(profile_rows(spark), baseline).isEmpty()
    edited = dict(PROFILES)
    edited["sample_fashion_vendor", "1"] = type(FASHION)("sample_fashion_vendor", "1", FASHION.targets, FASHION.required[1:], FASHION.defaults)
    assert [r.profile_version for r in changed_profiles(profile_rows(spark, edited), baseline).collect()] == ["1"]


def files(spark, items):
    rows = [(path, len(data), bytearray(data)) for path, data in items.items()]
    return spark.createDataFrame(rows, "path string, length bigint, content binary")


def line(*values):
    return ",".join(values)


def test_admission_first_failing_check_wins(spark):
    head, row = line(*HEADER), line(*[GOOD[c].replace(",", "") for c in HEADER])
    body = f"{head}\n{row}\n"
    items = {
        "/in/ok.csv": body.encode(), "/in/bom.CSV": b"\xef\xbb\xbf" + body.encode(),
        "/in/korean.csv": body.replace("Shirt", "셔츠").encode("cp949"), "/in/a.txt": body.encode(), "/in/empty.csv": b"",
        "/in/big.csv": body.encode() + b"x" * 3000, "/in/nul.csv": body.encode() + b"\x00", "/in/bad.csv": b"\xff\xff\xfe\x80",
        "/in/blank.csv": b"\xef\xbb\xbf \n", "/in/blankhead.csv": body.replace("colour", " ").encode(),
        "/in/dup.csv": body.replace("colour", "Item_Name").encode(), "/in/missing.csv": body.replace("colour", "tint").encode(),
        "/in/ragged.csv": (body + "1,2\n").encode(), "/in/norows.csv": (head + "\n,,\n").encode(),
        "/in/many.csv": (head + "\n" + (row + "\n") * 4).encode(), "/in/quote.csv": (head + '\n"a"b,' + row + "\n").encode(),
    }
    out = {r.path[4:]: (r.status, r.detail) for r in admit_feeds(files(spark, items), FASHION.required, Limits(3000, 3)).collect()}
    assert {k: s for k, (s, _) in out.items()} == {
        "ok.csv": "ok", "bom.CSV": "ok", "korean.csv": "ok", "a.txt": "bad_extension", "empty.csv": "empty_file",
        "big.csv": "too_large", "nul.csv": "nul_byte", "bad.csv": "undecodable", "blank.csv": "blank_text",
        "blankhead.csv": "blank_header", "dup.csv": "duplicate_header", "missing.csv": "missing_columns",
        "ragged.csv": "ragged_row", "norows.csv": "no_rows", "many.csv": "too_many_rows", "quote.csv": "malformed_csv",
    }
    assert out["missing.csv"][1] == "colour" and out["dup.csv"][1] == "item_name"


def test_row_numbers_count_blank_records(spark):
    head, row = line(*HEADER), line(*[GOOD[c].replace(",", "") for c in HEADER])
    data = {"/in/x.csv": f"{head}\n{row}\n,,\n\n{row}\n".encode()}
    rows = feed_rows(files(spark, data), FASHION.required).collect()
    assert [r.source_row_number for r in rows] == [2, 5]
    assert rows[0]["values"]["vendor_sku"] == "0007"


def test_stream_loads_each_content_once(spark, tmp_path):
    landing, store, checkpoint = tmp_path / "in", tmp_path / "store", tmp_path / "cp"
    landing.mkdir()
    head, row = line(*HEADER), line(*[GOOD[c].replace(",", "") for c in HEADER])
    secret = row.replace("Shirt", "").replace("a.jpg", "010-1234-5678")
    (landing / "a.csv").write_text(f"{head}\n{row}\n{secret}\n")
    (landing / "copy.csv").write_text(f"{head}\n{row}\n{secret}\n")

    def run():
        stream_load(spark, str(landing), FASHION, str(store), str(checkpoint)).awaitTermination()
        kept = Store(spark, str(store))
        return kept.batches("runs").count(), kept.batches("staging").count(), kept.batches("rejects").count()

    assert run() == (1, 1, 1)
    assert run() == (1, 1, 1)
    (landing / "again.csv").write_text(f"{head}\n{row}\n{secret}\n")
    (landing / "new.csv").write_text(f"{head}\n{row.replace('0007', '0008')}\n")
    assert run() == (2, 2, 1)
    rejected = Store(spark, str(store)).batches("rejects").first()
    assert rejected.source["image_link"] == "010-****-5678"


def test_two_profiles_in_one_store_and_a_fresh_checkpoint(spark, tmp_path):
    head, row = line(*HEADER), line(*[GOOD[c].replace(",", "") for c in HEADER])
    market = dict(zip(MARKETPLACE.sources, ["x"] * len(MARKETPLACE.sources))) | {
        "sku_code": "9", "category_code": "BAG", "regular_price": "10", "promo_price": "", "available_qty": "1"}
    for name, text in (("a", f"{head}\n{row}\n"), ("b", f"{line(*market)}\n{line(*market.values())}\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "one.csv").write_text(text)
    (tmp_path / "a" / "broken.csv").write_text("nothing,known\n1,2\n")

    def run(folder, profile, checkpoint):
        stream_load(spark, str(tmp_path / folder), profile, str(tmp_path / "store"), str(tmp_path / checkpoint)).awaitTermination()
        kept = Store(spark, str(tmp_path / "store"))
        return kept.batches("runs").count(), kept.batches("staging").count()

    assert run("a", FASHION, "cp1") == (2, 1)
    assert run("b", MARKETPLACE, "cp2") == (3, 2)
    assert run("a", FASHION, "cp3") == (3, 2)  # an old target with a fresh checkpoint: all contents are known
    (tmp_path / "a" / "two.csv").write_text(f"{head}\n{row.replace('0007', '0009')}\n")
    assert run("a", FASHION, "cp4") == (4, 3)
    status = {r["path"].rsplit("/", 1)[1]: r["status"] for r in Store(spark, str(tmp_path / "store")).batches("runs").collect()
              if "/a/" in r["path"]}
    assert status == {"one.csv": "ok", "two.csv": "ok", "broken.csv": "missing_columns"}


def test_files_of_a_folder_are_admitted_without_limits(spark, tmp_path):
    head, row = line(*HEADER), line(*[GOOD[c].replace(",", "") for c in HEADER])
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "large.csv").write_text(head + "\n" + (row + "\n") * 12_000)
    files_found = scan_feeds(spark, str(tmp_path), "*.csv")
    assert [r["status"] for r in admit_feeds(files_found, FASHION.required).collect()] == ["ok"]
    assert feed_rows(files_found, FASHION.required).count() == 12_000


def test_store_refuses_stale_writers_and_ignores_uncommitted(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = spark.range(3)
    assert store.commit("catalog", first, expected=0) == 1
    spark.range(9).write.parquet(f"{tmp_path}/data/catalog/v=2")
    assert store.latest("catalog") == 1 and store.read("catalog").count() == 3
    assert store.commit("catalog", spark.range(5), expected=1) == 2
    assert store.read("catalog").count() == 5
    with pytest.raises(StaleVersion):
        store.commit("catalog", first, expected=1)
    assert store.append_batch("b1", {"rows": first}) and not store.append_batch("b1", {"rows": first})
    spark.range(4).write.parquet(f"{tmp_path}/batches/rows/batch=half")
    assert store.batches("rows").count() == 3


SHAPE = "supplier_key string, {id} string, {run} bigint, product_group_id string, product_name string, category string, color string, size string, stock bigint, price bigint, sale_price bigint, image_path string, description string, seller string"


def product(supplier, key, run, price=100, seller=None):
    return (supplier, key, run, "G", f"n{key}", "TOP", "BLACK", "M", 1, price, None, "i", None, seller)


def test_promote_then_roll_back_gives_the_old_catalog_but_for_the_batch(spark):
    catalog = spark.createDataFrame(
        [product("S", "a", 1), product("S", "b", 1, seller="x"), product("S", "gone", 1), product("T", "a", 9)],
        SHAPE.format(id="external_product_id", run="source_load_run_id"),
    )
    staging = spark.createDataFrame(
        [product("S", "a", 2), product("S", "b", 2), product("S", "c", 2)], SHAPE.format(id="product_id", run="load_run_id")
    ).withColumn("id", F.monotonically_increasing_id())
    items = promote.preview(staging, catalog)
    assert {r.external_product_id: r.action for r in items.collect()} == {"a": "unchanged", "b": "update", "c": "insert"}
    changes = promote.applicable(items, staging)
    new = promote.apply_promotion(catalog, changes)
    state = {(r.supplier_key, r.external_product_id): (r.seller, r.source_load_run_id) for r in new.collect()}
    assert state == {("S", "a"): (None, 1), ("S", "b"): (None, 2), ("S", "c"): (None, 2), ("S", "gone"): (None, 1), ("T", "a"): (None, 9)}
    log = promote.change_log(changes)
    entries = {r.external_product_id: r.changed_fields for r in log.collect()}
    assert set(entries) == {"b", "c"} and set(entries["c"]) == set(COMPARED_FIELDS)
    assert entries["b"] == {"seller": ("x", None)}
    back = promote.rollback_preview(log, new)
    assert not any(r.conflict for r in back.collect())
    old = promote.apply_rollback(new, back)
    drop = lambda frame: sorted(map(str, frame.drop("source_load_run_id").select("supplier_key", "external_product_id", *COMPARED_FIELDS).collect()))
    assert drop(old) == drop(catalog)
    moved = new.withColumn("price", F.col("price") + F.when(F.col("external_product_id") == "c", 1).otherwise(0)).where("external_product_id <> 'b'")
    assert all(r.conflict for r in promote.rollback_preview(log, moved).collect())


def test_two_batches_of_a_supplier_change_a_product_once(spark):
    catalog = spark.createDataFrame(
        [product("S", "a", 1), product("S", "b", 1)], SHAPE.format(id="external_product_id", run="source_load_run_id")
    )
    rows = [product("S", "a", 2, price=200), product("S", "a", 3, price=300), product("S", "c", 2), product("S", "c", 3, price=5),
            product("S", "b", 4, price=9)]
    staging = spark.createDataFrame(rows, SHAPE.format(id="product_id", run="load_run_id")).withColumn("id", F.monotonically_increasing_id())
    items = promote.preview(staging, catalog)
    ready = spark.createDataFrame([(2,), (3,)], "load_run_id bigint")
    new = {r.external_product_id: (r.price, r.source_load_run_id) for r in promote.apply_promotion(catalog, promote.applicable(items, ready)).collect()}
    assert new == {"a": (300, 3), "b": (100, 1), "c": (5, 3)}
    seen = sorted((r.load_run_id, r.external_product_id, r.status) for r in promote.reconcile(staging, catalog).collect())
    assert seen == [(2, "a", "changed"), (2, "b", "not_observed_in_batch"), (2, "c", "new"), (3, "a", "changed"),
                    (3, "b", "not_observed_in_batch"), (3, "c", "new"), (4, "a", "not_observed_in_batch"), (4, "b", "changed")]


def test_preview_hash_sees_every_change_and_ignores_order(spark):
    catalog = spark.createDataFrame([product("S", "a", 1)], SHAPE.format(id="external_product_id", run="source_load_run_id"))

    def mark(rows):
        staging = spark.createDataFrame(rows, SHAPE.format(id="product_id", run="load_run_id")).withColumn("id", F.monotonically_increasing_id())
        return promote.preview_hash(promote.preview(staging, catalog)).first().preview_hash

    base = [product("S", "a", 2), product("S", "b", 2)]
    assert mark(base) == mark(base[::-1])
    others = [[product("S", "a", 2, price=101), base[1]], [base[0], product("S", "b", 2, seller="")], base[:1], [product("S", "a", 3), product("S", "b", 3)]]
    assert len({mark(base), *map(mark, others)}) == 5


def test_products_are_never_sent_to_all_tasks(spark):
    item = "external_product_id string, " + ", ".join(f"{c} string" for c in COMPARED_FIELDS)
    values = ["x"] * len(COMPARED_FIELDS)
    staging = spark.createDataFrame(
        [(1, 1, "S", "a", *values), (2, 1, "S", "b", *values)],
        f"id long, load_run_id long, supplier_key string, {item.replace('external_product_id', 'product_id')}",
    )
    catalog = spark.createDataFrame([("S", "a", *values, 0)], f"supplier_key string, {item}, source_load_run_id long")
    items = promote.preview(staging, catalog)
    assert {r.external_product_id: r.action for r in items.collect()} == {"a": "unchanged", "b": "insert"}
    changes = promote.applicable(items, staging.select("load_run_id"))
    back = promote.rollback_preview(promote.change_log(changes), catalog)
    for frame in (items, changes, back, promote.apply_rollback(catalog, back)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.split("\n") if "BroadcastHashJoin" in x and "external_product_id" in x]
    assert [tuple(r)[:2] for r in promote.apply_rollback(catalog, back).collect()] == [("S", "a")]
