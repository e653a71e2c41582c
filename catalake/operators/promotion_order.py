"""Promotion requests carried out in their order, many suppliers and batches at once.

Every request is judged against the catalog that the requests before it leave: a preview that was right when it was made is
stale once an earlier request of the run has changed one of its products. Nothing runs request by request. Whether a request
goes ahead depends only on earlier ones, so the statuses are a fixed point: all are judged at once against the versions that
the requests going ahead so far leave behind, and again with the result, until none changes. The number of rounds is that
of the longest chain of requests whose outcomes hang on each other, plus one.

A product that only one request holds can't change between rounds; its part of the preview hash is added up once. Only
products of several requests are looked at again, by a window over the requests of one product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalake.operators.promote import IDENTITY, changed_fields, hash_of_lanes, lane_sums, merged, preview
from catalake.sources.recorded import recorded

_REQUEST = ["request_no", "load_run_id", "supplier_key"]
_HASH = "^[0-9a-f]{64}$"


def _asked(eligible: DataFrame, requests: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Requests with what is known of their batch before any of them is carried out."""
    joined = requests.join(eligible.select("id", "staged_rows", "eligible"), "id", "left").join(
        succeeded.select("id", F.lit(True).alias("done")).distinct(), "id", "left"
    )
    return joined.select(
        "request_no", F.col("id").alias("load_run_id"), "expected_hash", F.coalesce("staged_rows", F.lit(0)).alias("staged_rows"),
        (~F.coalesce(F.col("expected_hash").rlike(_HASH), F.lit(False))).alias("refused"),
        F.coalesce("done", F.lit(False)).alias("done"), F.coalesce("eligible", F.lit(False)).alias("eligible"),
    )


def _current() -> Column:
    """The product as the last earlier request that goes ahead left it, or as the catalog has it."""
    earlier = Window.partitionBy(*IDENTITY).orderBy("request_no").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.last(F.when(F.col("goes"), F.col("after")), ignorenulls=True).over(earlier), F.col("before"))


def _judged(asked: DataFrame, shared: DataFrame, fixed: DataFrame, going: DataFrame) -> DataFrame:
    """(request_no, load_run_id, goes, repeated) with the requests of ``going`` carried out."""
    now = shared.join(going.select("request_no", "goes"), "request_no").withColumn("current", _current())
    lanes = fixed.unionByName(lane_sums(now, "after", "current", _REQUEST))
    sums = lanes.groupBy(*_REQUEST).agg(*[F.sum(c).alias(c) for c in lanes.columns if c not in _REQUEST])
    hashes = hash_of_lanes(sums, _REQUEST).select("request_no", "preview_hash")
    before = Window.partitionBy("load_run_id").orderBy("request_no").rowsBetween(Window.unboundedPreceding, -1)
    # a batch that an earlier request of this run promoted is not promoted again
    known = asked.join(going.select("request_no", "goes"), "request_no", "left").withColumn(
        "repeated", F.coalesce(F.max(F.coalesce("goes", F.lit(False))).over(before), F.lit(False))
    ).drop("goes")
    joined = known.join(hashes, "request_no", "left")
    matches = F.col("expected_hash").eqNullSafe(F.col("preview_hash"))
    goes = F.col("eligible") & ~F.col("done") & ~F.col("refused") & ~F.col("repeated") & matches
    return joined.withColumn("goes", goes)


def run_in_order(
    staging: DataFrame, catalog: DataFrame, eligible: DataFrame, requests: DataFrame, succeeded: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(runs, changes) of ``requests`` (request_no, id, expected_hash), carried out by rising request_no.

    ``runs`` has a row for each request: status, created, failure_code and counts. A request without a well-formed hash is
    refused and leaves no run; a batch that succeeded before, or by an earlier request, is returned as succeeded and not
    created; otherwise a batch with reasons against it is blocked, and one whose preview is no longer that of the request is
    stale. ``changes`` has every product of the requests that go ahead with the action, and before and after as they
    were at that point. Request numbers are unique; no requests give no rows.
    """
    asked = recorded(_asked(eligible, requests, succeeded), "asked")
    open_requests = asked.where("eligible and not done and not refused").select("request_no", "load_run_id")
    items = preview(staging, catalog).select(*IDENTITY, "load_run_id", "before", "after").join(open_requests, "load_run_id")
    held = items.groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("holders"))
    items = recorded(items.join(merged(held), IDENTITY), "requested")
    fixed = recorded(lane_sums(items.where("holders = 1"), "after", "before", _REQUEST), "lanes")
    shared = items.where("holders > 1")

    going = asked.select("request_no", F.lit(False).alias("goes"))
    while True:
        judged = recorded(_judged(asked, shared, fixed, going), "judged")
        changed = judged.join(going.withColumnRenamed("goes", "was"), "request_no").where("goes <> was").limit(1).count()
        going = judged.select("request_no", "goes")
        if not changed:
            break

    now = items.join(going, "request_no").withColumn("before", _current()).where("goes")
    fields = F.when(F.col("before").isNotNull(), changed_fields("before", "after"))
    action = F.when(F.col("before").isNull(), "insert").when(F.size("changed_fields") > 0, "update").otherwise("unchanged")
    changes = now.withColumn("changed_fields", fields).withColumn("action", action).drop("goes", "holders")
    return _runs(judged, changes), changes


def _runs(judged: DataFrame, changes: DataFrame) -> DataFrame:
    counts = changes.groupBy("request_no").agg(
        *[F.count_if(F.col("action") == a).alias(f"{n}_count") for a, n in (("insert", "inserted"), ("update", "updated"), ("unchanged", "unchanged"))]
    )
    early = F.col("done") | F.col("repeated")
    status = F.when(F.col("refused"), "refused").when(early | F.col("goes"), "succeeded").otherwise("blocked")
    code = (
        F.when(F.col("refused"), "invalid_preview_hash").when(early | F.col("goes"), F.lit(None))
        .when(F.col("eligible") & F.col("preview_hash").isNotNull(), "preview_stale").otherwise("promotion_blocked")
    )
    joined = judged.withColumns({"status": status, "failure_code": code}).join(counts, "request_no", "left")
    return joined.select(
        "request_no", F.col("load_run_id").alias("id"), "status", (~(F.col("refused") | early)).alias("created"), "failure_code",
        F.when(F.col("status") == "blocked", F.col("staged_rows")).otherwise(0).cast("long").alias("blocked_count"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("inserted_count", "updated_count", "unchanged_count")],
    )


def last_changes(changes: DataFrame) -> DataFrame:
    """Of every product the last version that a request gave it, for ``promote.apply_promotion``."""
    real = changes.where("action <> 'unchanged'")
    last = real.groupBy(*IDENTITY).agg(F.max("request_no").alias("request_no"))
    return real.join(merged(last), [*IDENTITY, "request_no"], "left_semi")
