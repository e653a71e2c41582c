"""Compare a batch with the catalog, promote it into a new snapshot, roll a promotion back.

A product is identified by (supplier_key, external_product_id); the catalog is never updated in place: every change
yields a new snapshot and appends to a change log. All functions work on any number of batches at once, also several of
one supplier; where approved batches change the same product, the newest batch counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalake.functions.vocabulary import COMPARED_FIELDS, INSPECTION_VERSION
from catalake.operators.skew import salted_join

IDENTITY = ["supplier_key", "external_product_id"]
STATUSES = ("new", "changed", "unchanged", "not_observed_in_batch")
PREVIEW_VERSION = "1"
PRODUCT_FIELDS = ("external_product_id", *COMPARED_FIELDS)


def merged(frame: DataFrame) -> DataFrame:
    """``frame``, which has about as many rows as there are products, marked to be joined by merging.

    Tables made from a small file are estimated as small; the planner would send every product to all tasks.
    """
    return frame.hint("merge")


def repeated_identities(staging: DataFrame) -> DataFrame:
    """(load_run_id, external_product_id, staging_ids): identities a batch holds more than once.

    A batch with any is refused, so the listed ids matter only up to the point of proving it; ``n`` counts them all
    and ``staging_ids`` names the lowest and highest.
    """
    return (
        staging.groupBy("load_run_id", F.col("product_id").alias("external_product_id"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
        .where(F.col("n") > 1)
    )


def repeated_identity_rows(staging: DataFrame) -> DataFrame:
    """Every staging row of a repeated identity (long form of the refusal list)."""
    keyed = staging.withColumnRenamed("product_id", "external_product_id")
    repeated = repeated_identities(staging).select("load_run_id", "external_product_id", "n")
    return salted_join(keyed, repeated, ["load_run_id", "external_product_id"], row_id="id").select(
        "load_run_id", "external_product_id", "id", "n"
    )


def comparable_staging(staging: DataFrame) -> DataFrame:
    """Staging rows of batches without repeated identities."""
    refused = repeated_identities(staging).select("load_run_id").distinct()
    kept = salted_join(staging, refused, ["load_run_id"], row_id="id", how="left_anti")
    return kept.withColumnRenamed("product_id", "external_product_id")


def _product(prefix: str) -> Column:
    return F.struct(*[F.col(f"{prefix}{name}").alias(name) for name in PRODUCT_FIELDS])


def changed_fields(before: str, after: str) -> Column:
    """map<field, struct<before, after>> of the fields that differ (NULL equals NULL), values as text."""
    entries = [
        F.when(
            ~F.col(f"{before}.{name}").eqNullSafe(F.col(f"{after}.{name}")),
            F.struct(
                F.lit(name).alias("key"),
                F.struct(
                    F.col(f"{before}.{name}").cast("string").alias("before"),
                    F.col(f"{after}.{name}").cast("string").alias("after"),
                ).alias("value"),
            ),
        )
        for name in COMPARED_FIELDS
    ]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def reconcile(staging: DataFrame, catalog: DataFrame) -> DataFrame:
    """(load_run_id, supplier_key, external_product_id, status, changed_fields) for every comparable batch."""
    batches = comparable_staging(staging).select("supplier_key", "load_run_id").distinct()
    own = salted_join(catalog, batches, ["supplier_key"], row_id="external_product_id")
    after = comparable_staging(staging).select(*IDENTITY, "load_run_id", _product("").alias("after"))
    before = own.select(*IDENTITY, "load_run_id", _product("").alias("before"))
    joined = after.join(before, [*IDENTITY, "load_run_id"], "full_outer")
    status = (
        F.when(F.col("before").isNull(), F.lit("new"))
        .when(F.col("after").isNull(), F.lit("not_observed_in_batch"))
        .when(F.size("fields") > 0, F.lit("changed"))
        .otherwise(F.lit("unchanged"))
    )
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    fields = F.when(both, changed_fields("before", "after")).otherwise(F.map_from_entries(F.array().cast(
        "array<struct<key:string,value:struct<before:string,after:string>>>"
    )))
    return joined.withColumn("fields", fields).select("load_run_id", *IDENTITY, status.alias("status"), F.col("fields").alias("changed_fields"))


def status_order(status: Column) -> Column:
    return F.array_position(F.lit(list(STATUSES)), status)


def reconcile_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("load_run_id", "supplier_key", "status").agg(F.count(F.lit(1)).alias("n"))


def field_changes(items: DataFrame) -> DataFrame:
    """Changed products per batch and field, in field order."""
    names = items.select("load_run_id", "supplier_key", F.explode(F.map_keys("changed_fields")).alias("field"))
    counts = names.groupBy("load_run_id", "supplier_key", "field").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy("load_run_id", "supplier_key", F.array_position(F.lit(list(COMPARED_FIELDS)), F.col("field")))


# --- promotion ---


def preview(staging: DataFrame, catalog: DataFrame) -> DataFrame:
    """What promoting each batch would do: action, changed_fields, before, after."""
    after = comparable_staging(staging).select(*IDENTITY, "load_run_id", _product("").alias("after"))
    joined = after.join(merged(catalog.select(*IDENTITY, _product("").alias("before"))), IDENTITY, "left")
    with_fields = joined.withColumn(
        "changed_fields", F.when(F.col("before").isNotNull(), changed_fields("before", "after"))
    )
    action = (
        F.when(F.col("before").isNull(), F.lit("insert"))
        .when(F.size("changed_fields") > 0, F.lit("update"))
        .otherwise(F.lit("unchanged"))
    )
    return with_fields.withColumn("action", action)


def _canonical(item: str) -> Column:
    """Unambiguous text of a product: every field with its length, NULL and absent told apart."""
    fields = [
        F.coalesce(
            F.concat(F.length(F.col(f"{item}.{name}").cast("string")).cast("string"), F.lit(":"), F.col(f"{item}.{name}").cast("string")),
            F.lit("-"),
        )
        for name in PRODUCT_FIELDS
    ]
    return F.when(F.col(item).isNull(), F.lit("none")).otherwise(F.concat_ws("|", *fields))


def lane_sums(items: DataFrame, target: str, current: str, keys: list[str]) -> DataFrame:
    """Per batch, the number of products and the sums of eight lanes of 32 bits of their digests.

    Sums don't depend on order and add up over parts of a batch.
    """
    digest = F.sha2(F.concat_ws("\n", _canonical(target), _canonical(current)), 256)
    lane = lambda i: F.conv(F.substr(F.col("_digest"), F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("decimal(20,0)")
    return items.withColumn("_digest", digest).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(lane(i)).alias(f"_lane{i}") for i in range(8)]
    )


def hash_of_lanes(sums: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` (with load_run_id and supplier_key) and the preview hash of each."""
    text = [F.col(c).cast("string") for c in ("load_run_id", "supplier_key", "_n", *[f"_lane{i}" for i in range(8)])]
    return sums.select(
        *keys, F.sha2(F.concat_ws("|", F.lit(PREVIEW_VERSION), F.lit(INSPECTION_VERSION), *text), 256).alias("preview_hash")
    )


def preview_hash(items: DataFrame, target: str = "after", current: str = "before") -> DataFrame:
    """(load_run_id, supplier_key, preview_hash): changes when any target or current product of the batch does.

    The digest of the lane sums is the hash: it combines in partial aggregates and no list of products is built.
    """
    keys = ["load_run_id", "supplier_key"]
    return hash_of_lanes(lane_sums(items, target, current, keys), keys)


def eligibility(batches: DataFrame, staging: DataFrame, error_counts: DataFrame) -> DataFrame:
    """(id, staged_rows, reasons, eligible) per batch.

    ``batches`` has id, total_rows, rejected_rows, has_error_counts, has_reject_rows; ``error_counts`` has load_run_id
    and error_count from inspecting the staged rows. A repeated identity ends the check before inspection.
    """
    staged = staging.groupBy(F.col("load_run_id").alias("id")).agg(F.count(F.lit(1)).alias("staged_rows"))
    repeated = repeated_identities(staging).groupBy(F.col("load_run_id").alias("id")).agg(F.count(F.lit(1)).alias("repeated"))
    errors = error_counts.select(F.col("load_run_id").alias("id"), "error_count")
    joined = batches.join(staged, "id", "left").join(repeated, "id", "left").join(errors, "id", "left")
    unknown = F.col("total_rows").isNull() | F.col("rejected_rows").isNull() | ~F.col("has_error_counts")
    reasons = F.array_compact(
        F.array(
            F.when(unknown, F.lit("quality_summary_missing")),
            F.when((F.coalesce("rejected_rows", F.lit(0)) > 0) | F.col("has_reject_rows"), F.lit("etl_rejections_present")),
            F.when(F.col("staged_rows").isNull(), F.lit("empty_staging_batch")),
            F.when(F.col("repeated") > 0, F.lit("duplicate_product_identity")),
            F.when(F.col("repeated").isNull() & (F.col("error_count") > 0), F.lit("inspection_errors_present")),
        )
    )
    return joined.select("id", F.coalesce("staged_rows", F.lit(0)).alias("staged_rows"), reasons.alias("reasons")).withColumn(
        "eligible", F.size("reasons") == 0
    )


def outcomes(eligible: DataFrame, hashes: DataFrame, requests: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Resolve promotion requests (id, expected_hash).

    An earlier success is returned as it is; else a batch with reasons is blocked; else a hash that no longer matches
    blocks as stale, as does a request without a hash; else the request goes ahead. All are judged against one catalog;
    ``promotion_order.run_in_order`` carries out requests one after the other.
    """
    joined = (
        requests.join(succeeded.select("id", F.lit(True).alias("done")).distinct(), "id", "left")
        .join(eligible, "id", "left")
        .join(hashes.select(F.col("load_run_id").alias("id"), "preview_hash"), "id", "left")
    )
    done = F.coalesce("done", F.lit(False))
    blocked = ~F.coalesce("eligible", F.lit(False)) | F.col("preview_hash").isNull()
    stale = ~F.col("expected_hash").eqNullSafe(F.col("preview_hash"))
    return joined.select(
        "id",
        F.when(done, F.lit("succeeded")).when(blocked | stale, F.lit("blocked")).otherwise(F.lit("succeeded")).alias("status"),
        (~done).alias("created"),
        F.when(~done & blocked, F.lit("promotion_blocked")).when(~done & stale, F.lit("preview_stale")).alias("failure_code"),
        F.when(~done & (blocked | stale), F.coalesce("staged_rows", F.lit(0))).otherwise(F.lit(0)).alias("blocked_count"),
    )


def applicable(items: DataFrame, ready: DataFrame) -> DataFrame:
    """What the batches of ``ready`` (load_run_id) change, once per product: as the newest of them has it.

    A newest batch that agrees with the catalog keeps the product as it is, whatever older batches say.
    """
    chosen = items.join(ready.select("load_run_id").distinct(), "load_run_id", "left_semi")
    newest = chosen.groupBy(*IDENTITY).agg(F.max("load_run_id").alias("load_run_id"))
    return chosen.join(merged(newest), [*IDENTITY, "load_run_id"], "left_semi").where(F.col("action") != "unchanged")


def run_promotions(items: DataFrame, outcome: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, changes) of resolved requests (see ``outcomes``).

    Only requests that go ahead now change the catalog; ``runs`` has every request with the number of products its
    batch inserted and updated, none where it was blocked or had succeeded before.
    """
    ahead = outcome.where("created and status = 'succeeded'").select(F.col("id").alias("load_run_id"))
    changes = applicable(items, ahead)
    done = changes.groupBy(F.col("load_run_id").alias("id")).agg(
        F.count_if(F.col("action") == "insert").alias("inserted_count"), F.count_if(F.col("action") == "update").alias("updated_count")
    )
    zero = {"inserted_count": 0, "updated_count": 0}
    return outcome.join(done, "id", "left").fillna(zero, list(zero)), changes


def apply_promotion(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """The next catalog snapshot: ``changes`` (see ``applicable``) overlaid, everything else as it was.

    The batch is noted only on rows it changed. Other suppliers' rows pass through. Changes hold a product once, so the
    snapshot does if the catalog did.
    """
    changes = changes.select(*IDENTITY, "load_run_id", "after")
    joined = catalog.join(changes, IDENTITY, "full_outer")
    touched = F.col("after").isNotNull()
    return joined.select(
        *IDENTITY,
        *[F.when(touched, F.col(f"after.{name}")).otherwise(F.col(name)).alias(name) for name in COMPARED_FIELDS],
        F.when(touched, F.col("load_run_id")).otherwise(F.col("source_load_run_id")).alias("source_load_run_id"),
    )


def _all_fields(item: str, before: bool) -> Column:
    """Change map of a whole product that appears (before NULL) or disappears (after NULL)."""
    pairs: list[Column] = []
    for name in COMPARED_FIELDS:
        value, none = F.col(f"{item}.{name}").cast("string"), F.lit(None).cast("string")
        pairs += [F.lit(name), F.struct((value if before else none).alias("before"), (none if before else value).alias("after"))]
    return F.create_map(*pairs)


def change_log(items: DataFrame) -> DataFrame:
    """Log of applied changes: one entry per insert (all fields, before NULL) and update (changed fields only)."""
    logged = items.where(F.col("action") != "unchanged")
    return logged.select(
        "load_run_id", *IDENTITY, "action",
        F.when(F.col("action") == "insert", _all_fields("after", before=False)).otherwise(F.col("changed_fields")).alias("changed_fields"),
        "before", "after",
    )


def flat_changes(changes: DataFrame, keys: list[str]) -> DataFrame:
    """One row per changed field: keys, action, field, before, after."""
    entry = F.explode(F.map_entries("changed_fields")).alias("entry")
    return changes.select(*keys, "action", entry).select(
        *keys, "action", F.col("entry.key").alias("field"),
        F.col("entry.value.before").alias("before"), F.col("entry.value.after").alias("after"),
    )


def flat_preview(items: DataFrame) -> DataFrame:
    """Preview as rows: one per changed field of an update, one per inserted or unchanged product."""
    entries = F.when(F.col("action") == "update", F.map_entries("changed_fields"))
    flat = items.select(*IDENTITY, "action", F.explode_outer(entries).alias("entry"))
    insert = F.col("action") == "insert"
    other = lambda when_insert, when_same: F.when(insert, F.lit(when_insert)).otherwise(F.lit(when_same))
    update = F.col("action") == "update"
    return flat.select(
        *IDENTITY, "action",
        F.when(update, F.col("entry.key")).otherwise(other("상품 전체", "-")).alias("field"),
        F.when(update, F.coalesce("entry.value.before", F.lit("-"))).otherwise(other("-", "변경 없음")).alias("before"),
        F.when(update, F.coalesce("entry.value.after", F.lit("-"))).otherwise(other("신규 등록", "변경 없음")).alias("after"),
    )


# --- rollback ---


def rollback_preview(changes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per logged change: delete (was an insert) or restore (was an update), and whether the product has moved on."""
    current = catalog.select(*IDENTITY, _product("").alias("current"))
    joined = changes.join(merged(current), IDENTITY, "left")
    conflict = ~F.col("current").eqNullSafe(F.col("after"))
    return joined.select(
        "load_run_id", *IDENTITY,
        F.when(F.col("action") == "insert", F.lit("delete")).otherwise(F.lit("restore")).alias("rollback_action"),
        "current", F.when(F.col("action") != "insert", F.col("before")).alias("restore"), conflict.alias("conflict"),
    )


def rollback_eligibility(promotions: DataFrame, changes: DataFrame, items: DataFrame, rolled_back: DataFrame) -> DataFrame:
    """(load_run_id, reasons, conflicts, eligible). ``promotions`` has load_run_id and status."""
    logged = changes.groupBy("load_run_id").agg(F.count(F.lit(1)).alias("logged"))
    conflicts = items.groupBy("load_run_id").agg(F.count_if("conflict").alias("conflicts"))
    joined = (
        promotions.join(logged, "load_run_id", "left").join(conflicts, "load_run_id", "left")
        .join(rolled_back.select("load_run_id", F.lit(True).alias("done")).distinct(), "load_run_id", "left")
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("status") != "succeeded", F.lit("promotion_not_succeeded")),
            F.when(F.col("done"), F.lit("already_rolled_back")),
            F.when(F.col("logged").isNull(), F.lit("audit_missing")),
            F.when(F.col("conflicts") > 0, F.lit("rollback_conflict")),
        )
    )
    return joined.select(
        "load_run_id", reasons.alias("reasons"), F.coalesce("conflicts", F.lit(0)).alias("conflicts")
    ).withColumn("eligible", F.size("reasons") == 0)


def run_rollbacks(items: DataFrame, eligible: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, items) of rollback requests (load_run_id, expected_hash).

    A promotion is rolled back whole or not at all: with any reason against it, one conflict included, it is blocked;
    with a hash that no longer is that of the preview it is stale. ``items`` keeps what may be applied.
    """
    hashes = preview_hash(items, "restore", "current")
    joined = requests.join(eligible, "load_run_id", "left").join(
        hashes.groupBy("load_run_id").agg(F.max("preview_hash").alias("preview_hash")), "load_run_id", "left"
    )
    blocked = ~F.coalesce("eligible", F.lit(False)) | F.col("preview_hash").isNull()
    stale = ~F.col("expected_hash").eqNullSafe(F.col("preview_hash"))
    counts = items.groupBy("load_run_id").agg(
        F.count_if(F.col("rollback_action") == "restore").alias("restored"), F.count_if(F.col("rollback_action") == "delete").alias("deleted")
    )
    goes = ~(blocked | stale)
    runs = joined.join(counts, "load_run_id", "left").select(
        "load_run_id", F.when(goes, F.lit("succeeded")).otherwise(F.lit("blocked")).alias("status"),
        F.when(blocked, F.lit("rollback_blocked")).when(stale, F.lit("preview_stale")).alias("failure_code"),
        F.when(goes, F.col("restored")).otherwise(0).alias("restored_count"),
        F.when(goes, F.col("deleted")).otherwise(0).alias("deleted_count"),
    )
    return runs, items.join(runs.where("status = 'succeeded'").select("load_run_id"), "load_run_id", "left_semi")


def apply_rollback(catalog: DataFrame, items: DataFrame) -> DataFrame:
    """The next snapshot: inserted products gone, updated ones as before. The noted batch stays as it is.

    ``items`` are those of promotions that may be rolled back (see ``run_rollbacks``).
    """
    restored = items.select(*IDENTITY, "rollback_action", "restore")
    joined = catalog.join(merged(restored), IDENTITY, "left")
    back = F.col("restore").isNotNull()
    return joined.where(~F.col("rollback_action").eqNullSafe(F.lit("delete"))).select(
        *IDENTITY,
        *[F.when(back, F.col(f"restore.{name}")).otherwise(F.col(name)).alias(name) for name in COMPARED_FIELDS],
        "source_load_run_id",
    )


def rollback_log(items: DataFrame) -> DataFrame:
    """One entry per product: delete logs all fields with after NULL, restore only what changes."""
    deleted = F.col("rollback_action") == "delete"
    fields = F.when(deleted, _all_fields("current", before=True)).otherwise(changed_fields("current", "restore"))
    return items.select(
        "load_run_id", *IDENTITY, F.col("rollback_action").alias("action"), fields.alias("changed_fields"),
        F.col("current").alias("before"), F.col("restore").alias("after"),
    )
