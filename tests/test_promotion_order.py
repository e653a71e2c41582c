"""Ordered promotion against a plain loop over the requests."""

import random

from pyspark.sql import functions as F

from catalake.functions.vocabulary import COMPARED_FIELDS
from catalake.operators import promote
from catalake.operators.promotion_order import last_changes, run_in_order

_TYPES = {"stock": "int", "price": "bigint", "sale_price": "bigint"}
_SCHEMA = ", ".join(f"{n} {_TYPES.get(n, 'string')}" for n in COMPARED_FIELDS)


def _product(price, stock=1):
    return tuple({"price": price, "stock": stock}.get(n) for n in COMPARED_FIELDS)


def _staging(spark, batches):
    rows = [(10 * b + i, b, supplier, pid, *_product(price)) for b, (supplier, items) in batches.items() for i, (pid, price) in enumerate(items.items())]
    return spark.createDataFrame(rows, f"id long, load_run_id long, supplier_key string, product_id string, {_SCHEMA}")


def _catalog(spark, products):
    rows = [(s, pid, *_product(price), 0) for (s, pid), price in products.items()]
    return spark.createDataFrame(rows, f"supplier_key string, external_product_id string, {_SCHEMA}, source_load_run_id long")


def _loop(products, batches, requests, eligible, done):
    """(request_no: (status, created, code)), and the final products. ``requests``: (number, batch, assumed prices or None)."""
    now, promoted, out = dict(products), set(done), {}
    for number, batch, assumed in sorted(requests):
        supplier, items = batches[batch]
        if assumed is None:
            out[number] = ("refused", False, "invalid_preview_hash")
        elif batch in promoted:
            out[number] = ("succeeded", False, None)
        elif batch not in eligible:
            out[number] = ("blocked", True, "promotion_blocked")
        elif any(now.get((supplier, pid)) != assumed.get((supplier, pid)) for pid in items):
            out[number] = ("blocked", True, "preview_stale")
        else:
            out[number] = ("succeeded", True, None)
            promoted.add(batch)
            now |= {(supplier, pid): price for pid, price in items.items()}
    return out, now


def test_equals_a_loop(spark):
    draw = random.Random(4)
    products = {(s, f"p{i}"): draw.randrange(3) for s in "ab" for i in range(12) if i % 5}
    batches = {b: (draw.choice("ab"), {f"p{i}": draw.randrange(3) for i in draw.sample(range(12), 3)}) for b in range(1, 13)}
    eligible = {b for b in batches if b % 6}
    number, sent = 0, []
    at_first = dict(products)
    for b in [*batches, 3, 5, 8]:
        number += 1
        # some senders saw the catalog after one other batch, one has no preview
        other = draw.choice(list(batches))
        seen = at_first if draw.random() < 0.6 else at_first | {(batches[other][0], pid): p for pid, p in batches[other][1].items()}
        sent.append((number, b, None if number == 7 else seen))
    staging, catalog = _staging(spark, batches), _catalog(spark, products)
    hashes = {}
    for number, b, seen in sent:
        if seen is not None:
            found = promote.preview_hash(promote.preview(_staging(spark, {b: batches[b]}), _catalog(spark, seen))).first()
            hashes[number] = found["preview_hash"]
    requests = spark.createDataFrame([(n, b, hashes.get(n)) for n, b, _ in sent], "request_no long, id long, expected_hash string")
    ready = spark.createDataFrame([(b, len(batches[b][1]), b in eligible) for b in batches], "id long, staged_rows long, eligible boolean")
    done = spark.createDataFrame([(11,)], "id long")
    runs, changes = run_in_order(staging, catalog, ready, requests, done)
    want, now = _loop(products, batches, sent, eligible, {11})
    assert {r["request_no"]: (r["status"], r["created"], r["failure_code"]) for r in runs.collect()} == want
    assert {code for _, _, code in want.values()} >= {"preview_stale", "promotion_blocked", "invalid_preview_hash", None}
    new = promote.apply_promotion(catalog, last_changes(changes))
    assert {(r["supplier_key"], r["external_product_id"]): r["price"] for r in new.collect()} == now


def test_a_chain_of_previews(spark):
    """Each request was sent on top of the one before; the first is stale, so the second goes ahead alone."""
    products = {("a", "x"): 100}
    batches = {b: ("a", {"x": 100 + b}) for b in range(1, 5)}
    seen = [{("a", "x"): 99}, {("a", "x"): 100}, {("a", "x"): 102}, {("a", "x"): 102}]
    hashes = [promote.preview_hash(promote.preview(_staging(spark, {b: batches[b]}), _catalog(spark, s))).first()["preview_hash"] for b, s in zip(batches, seen, strict=True)]
    requests = spark.createDataFrame([(b, b, h) for b, h in zip(batches, hashes, strict=True)], "request_no long, id long, expected_hash string")
    ready = spark.createDataFrame([(b, 1, True) for b in batches], "id long, staged_rows long, eligible boolean")
    runs, changes = run_in_order(_staging(spark, batches), _catalog(spark, products), ready, requests, ready.where("false").select("id"))
    assert [r["failure_code"] for r in runs.orderBy("request_no").collect()] == ["preview_stale", None, None, "preview_stale"]
    log = promote.change_log(changes)
    assert [(r["before"]["price"], r["after"]["price"]) for r in changes.orderBy("request_no").collect()] == [(100, 102), (102, 103)]
    assert log.count() == 2
    assert last_changes(changes).first()["after"]["price"] == 103


def test_no_requests(spark):
    products, batches = {("a", "x"): 1}, {1: ("a", {"x": 2})}
    ready = spark.createDataFrame([(1, 1, True)], "id long, staged_rows long, eligible boolean")
    none = spark.createDataFrame([], "request_no long, id long, expected_hash string")
    runs, changes = run_in_order(_staging(spark, batches), _catalog(spark, products), ready, none, none.select("id"))
    assert runs.count() == 0 and changes.count() == 0


def test_newest_batch_counts_and_requests_need_a_hash(spark):
    """Batch 1 says 200, the newer batch 2 agrees with the catalog: the product stays as it is."""
    catalog, batches = _catalog(spark, {("a", "x"): 100}), {1: ("a", {"x": 200}), 2: ("a", {"x": 100})}
    staging = _staging(spark, batches)
    items = promote.preview(staging, catalog)
    ready = staging.select("load_run_id").distinct()
    assert promote.applicable(items, ready).count() == 0
    eligible = spark.createDataFrame([(1, 1, True), (2, 1, True)], "id long, staged_rows long, eligible boolean")
    asked = spark.createDataFrame([(1, None), (2, "old")], "id long, expected_hash string")
    outcome = promote.outcomes(eligible, promote.preview_hash(items), asked, eligible.where("false"))
    assert {r["failure_code"] for r in outcome.collect()} == {"preview_stale"}
    assert items.where(F.col("action") == "update").count() == 1
