"""History of inspection runs and load batches: filters, pages, details, quality."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalake.functions.text import contains_ignoring_case, strip
from catalake.functions import keys
from catalake.functions.vocabulary import DEFAULT, Vocabulary
from catalake.operators.report import overall_status, safe_cell

LOCAL_ZONE = "Asia/Seoul"
UNKNOWN_ACTOR = "알 수 없음"
PAGE_SIZES = range(1, 101)
TREND_SIZES = range(1, 51)


def _part(text: str | None) -> str:
    return "" if text is None else text.strip()


def newest_first() -> list[Column]:
    return [F.desc("created_at"), F.desc("id")]


def page(rows: DataFrame, limit: int, offset: int = 0, order: list[Column] | None = None) -> DataFrame:
    """One page in the given order. Deep pages: prefer ``after`` (keyset), whose cost does not grow."""
    if limit not in PAGE_SIZES or offset < 0:
        raise ValueError("limit must be 1 to 100, offset must not be negative")
    return rows.orderBy(*(order or newest_first())).offset(offset).limit(limit)


def after(rows: DataFrame, created_at: dt.datetime, last_id: int) -> DataFrame:
    """Rows that follow the given one in newest-first order."""
    at = F.lit(created_at)
    return rows.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < last_id)))


def local_days(column: str, start: dt.date | None, end: dt.date | None, zone: str = LOCAL_ZONE) -> Column:
    """Timestamps (UTC) that fall on the local days from ``start`` to ``end``, both included."""
    if start is not None and end is not None and start > end:
        raise ValueError("start date is after end date")
    kept = F.lit(True)
    if start is not None:
        kept &= F.col(column) >= F.to_utc_timestamp(F.lit(start.isoformat()), zone)
    if end is not None:
        kept &= F.col(column) < F.to_utc_timestamp(F.lit((end + dt.timedelta(days=1)).isoformat()), zone)
    return kept


def run_state(state: str) -> Column:
    errors, warnings = F.col("error_count"), F.col("warning_count")
    states = {
        "error": errors > 0,
        "warning": (errors == 0) & (warnings > 0),
        "normal": (errors == 0) & (warnings == 0),
    }
    if state not in states:
        raise ValueError(f"state must be one of {sorted(states)}")
    return states[state]


def filter_inspections(runs: DataFrame, filename: str | None = None, start: dt.date | None = None,
                       end: dt.date | None = None, state: str | None = None) -> DataFrame:
    kept = runs.where(local_days("created_at", start, end))
    if _part(filename):
        kept = kept.where(contains_ignoring_case(F.col("source_filename"), _part(filename)))
    return kept if state is None else kept.where(run_state(state))


def filter_batches(runs: DataFrame, filename: str | None = None, profile_name: str | None = None) -> DataFrame:
    kept = runs
    for column, text in (("source_filename", filename), ("profile_name", profile_name)):
        if _part(text):
            kept = kept.where(contains_ignoring_case(F.col(column), _part(text)))
    return kept


def inspection_detail(runs: DataFrame, results: DataFrame, run_id: int) -> DataFrame:
    """Issues of one run with the run's columns, by issue id."""
    run = runs.where(F.col("id") == run_id).select(F.col("id").alias("inspection_run_id"), "source_filename", "total_issues")
    own = results.where(F.col("inspection_run_id") == run_id)
    return own.join(run, "inspection_run_id").orderBy("id")


def shown_actor(actor: Column) -> Column:
    return F.when(strip(actor) == "", F.lit(UNKNOWN_ACTOR)).otherwise(actor)


def history_export(runs: DataFrame) -> DataFrame:
    """Every run as a spreadsheet row; pages are not needed when the export is one job."""
    errors, warnings = F.coalesce("error_count", F.lit(0)), F.coalesce("warning_count", F.lit(0))
    return runs.select(
        "id", safe_cell(F.col("source_filename")).alias("source_filename"), shown_actor(F.col("actor_username")).alias("actor"),
        "created_at", "total_products", "total_issues", errors.alias("error_count"), warnings.alias("warning_count"),
        overall_status(errors, warnings).alias("status"),
    )


def repeated_ids(runs: DataFrame) -> DataFrame:
    """Run ids that occur more than once; an export is valid only when there are none."""
    return runs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def issue_total_violations(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs whose stored totals disagree with their issues or have issues with blank required fields."""
    blank = F.lit(False)
    for name in ("status", "error_field", "reason", "recommendation", "risk_level"):
        blank |= strip(F.col(name)) == ""
    found = results.groupBy(F.col("inspection_run_id").alias("id")).agg(
        F.count(F.lit(1)).alias("stored"), F.count_if(blank).alias("blank_fields")
    )
    joined = runs.select("id", "total_issues").join(found, "id", "left").select(
        "id", "total_issues", F.coalesce("stored", F.lit(0)).alias("stored"),
        F.coalesce("blank_fields", F.lit(0)).alias("blank_fields"),
    )
    return joined.where((F.col("total_issues") != F.col("stored")) | (F.col("blank_fields") > 0))


# --- batches ---


def batch_products(runs: DataFrame, staging: DataFrame, batch_id: int) -> DataFrame:
    """Staged products of one batch with its columns (page with ``page(..., order=[F.col("id")])``)."""
    run = runs.where(F.col("id") == batch_id).select(F.col("id").alias("load_run_id"), "source_filename", "profile_name")
    return staging.where(F.col("load_run_id") == batch_id).join(run, "load_run_id")


def batch_rejections(runs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rejected rows with an availability flag: batches stored without details give one row with NULLs."""
    kept = runs.select(F.col("id").alias("load_run_id"), F.col("reject_details_stored").alias("available"))
    stored = kept.where("available").join(rejected, "load_run_id")
    return stored.unionByName(kept.where(~F.col("available")), allowMissingColumns=True)


def flat_rejections(rejected: DataFrame) -> DataFrame:
    def joined(part: str) -> Column:
        return F.array_join(F.transform(F.col("errors"), lambda e: F.coalesce(e[part], F.lit(""))), ", ")

    return rejected.select(
        "load_run_id", "source_row_number",
        joined("code").alias("codes"), joined("field").alias("fields"), joined("message").alias("messages"),
    )


def has_quality() -> Column:
    """Batches stored before quality was recorded hold NULLs; they are left out, never read as zero."""
    return F.col("total_rows").isNotNull() & F.col("rejected_rows").isNotNull() & F.col("error_counts").isNotNull()


def rejection_rate(rejected: Column, total: Column) -> Column:
    """Percent with two decimals (half to even); 0 without rows."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.bround(rejected / total * 100, 2))


def quality_summary(runs: DataFrame, profile_part: str | None = None) -> DataFrame:
    def over_known(name: str) -> Column:
        return F.coalesce(F.sum(F.when(has_quality(), F.col(name))), F.lit(0)).alias(name)

    totals = filter_batches(runs, profile_name=profile_part).agg(
        F.count(F.lit(1)).alias("batch_count"), F.count_if(has_quality()).alias("quality_batch_count"),
        over_known("total_rows"), over_known("loaded_rows"), over_known("rejected_rows"),
    )
    return totals.select(
        "*", (F.col("batch_count") - F.col("quality_batch_count")).alias("no_quality_batch_count"),
        rejection_rate(F.col("rejected_rows"), F.col("total_rows")).alias("rejection_rate"),
    )


def trend_items(runs: DataFrame) -> DataFrame:
    return runs.where(has_quality()).withColumn(
        "rejection_rate", rejection_rate(F.col("rejected_rows"), F.col("total_rows"))
    )


def quality_trend(runs: DataFrame, limit: int = 10, profile_part: str | None = None) -> DataFrame:
    """The last batches with quality data, oldest first."""
    if limit not in TREND_SIZES:
        raise ValueError("limit must be 1 to 50")
    last = trend_items(filter_batches(runs, profile_name=profile_part)).orderBy(*newest_first()).limit(limit)
    return last.orderBy("created_at", "id")


def _last_per_profile(runs: DataFrame, limit: int) -> DataFrame:
    """The newest batches of every profile, ranked 1 to ``limit``.

    A rank filter makes Spark keep only the best rows of each profile before the shuffle (window group limit), so a
    profile with most of the batches does not gather in one task.
    """
    newest = Window.partitionBy("profile_name").orderBy(*newest_first())
    return runs.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= limit)


def quality_delta(runs: DataFrame) -> DataFrame:
    """Latest against previous batch of every profile, on the rounded rates the reader sees."""
    last = _last_per_profile(trend_items(runs), 2)
    per_profile = last.groupBy("profile_name").agg(
        F.max(F.when(F.col("place") == 1, F.col("id"))).alias("latest_id"),
        F.max(F.when(F.col("place") == 2, F.col("id"))).alias("previous_id"),
        F.max(F.when(F.col("place") == 1, F.col("rejection_rate"))).alias("latest_rate"),
        F.max(F.when(F.col("place") == 2, F.col("rejection_rate"))).alias("previous_rate"),
    )
    latest, previous = F.col("latest_rate"), F.col("previous_rate")
    direction = (
        F.when(previous.isNull(), F.lit("no_baseline")).when(latest < previous, F.lit("improved"))
        .when(latest > previous, F.lit("worsened")).otherwise(F.lit("unchanged"))
    )
    return per_profile.select("*", F.bround(latest - previous, 2).alias("rate_delta"), direction.alias("direction"))


def error_code_totals(runs: DataFrame, limit: int = 10) -> DataFrame:
    """Error codes over the last batches of every profile: total and batches affected."""
    last = _last_per_profile(runs.where(has_quality()), limit)
    codes = last.select("profile_name", F.explode("error_counts").alias("code", "n"))
    usable = codes.where((strip(F.col("code")) != "") & (F.col("n") >= 1))
    return usable.groupBy("profile_name", "code").agg(
        F.sum("n").alias("total_count"), F.count(F.lit(1)).alias("batch_count")
    ).orderBy("profile_name", F.desc("total_count"), "code")


def quality_profiles(runs: DataFrame) -> DataFrame:
    return runs.where(has_quality()).select("profile_name").distinct().orderBy("profile_name")


def load_rates(runs: DataFrame) -> DataFrame:
    rate = F.when(F.col("total_rows") > 0, F.bround(F.col("loaded_rows") / F.col("total_rows") * 100, 1))
    return runs.select("id", "total_rows", "loaded_rows", rate.alias("load_rate"))


def error_table(runs: DataFrame) -> DataFrame:
    """Error counts of every batch as rows (sort by count descending, then code, within a batch)."""
    return runs.select("id", F.explode("error_counts").alias("code", "n"))


def unknown_sizes(catalog: DataFrame, limit: int, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Most frequent sizes that are neither standard nor numeric, spellings of one key counted together."""
    from catalake.functions.text import collapse

    # Spellings are few compared with rows: count them first, then build keys once per spelling.
    spellings = catalog.groupBy("size").agg(F.count(F.lit(1)).alias("n")).select(collapse(F.col("size")).alias("token"), "n")
    unknown = spellings.where(
        (F.col("token") != "")
        & keys.standard_size(F.col("token"), vocab).isNull() & keys.size_system(F.col("token"), vocab).isNull()
    )
    grouped = unknown.groupBy(keys.size_key(F.col("token"), vocab).alias("key")).agg(
        F.sum("n").alias("count"), F.min(F.struct(F.lower("token").alias("folded"), "token")).alias("best")
    )
    return (
        grouped.orderBy(F.desc("count"), "best.folded", "best.token").limit(limit)
        .select(F.col("best.token").alias("token"), "count")
    )


# --- promotions and rollbacks ---


def promotion_history(promotions: DataFrame, runs: DataFrame, status: str | None = None, batch_id: int | None = None,
                      filename: str | None = None, profile_name: str | None = None) -> DataFrame:
    kept = promotions
    if status is not None:
        kept = kept.where(F.col("status") == status)
    if batch_id is not None:
        kept = kept.where(F.col("load_run_id") == batch_id)
    files = filter_batches(runs, filename, profile_name).select(F.col("id").alias("load_run_id"), "source_filename", "profile_name")
    return kept.join(files, "load_run_id")


def rollback_history(rollbacks: DataFrame, status: str | None = None, promotion_id: int | None = None) -> DataFrame:
    kept = rollbacks
    if status is not None:
        kept = kept.where(F.col("status") == status)
    return kept if promotion_id is None else kept.where(F.col("target_promotion_run_id") == promotion_id)


def rollback_detail(rollbacks: DataFrame, promotions: DataFrame, changes: DataFrame) -> DataFrame:
    """Every rollback run with the state of the promotion that it took back and the number of its logged changes.

    ``changes`` has rollback_run_id and action. A run without logged changes has zeros; one whose promotion is gone has NULLs.
    """
    logged = changes.groupBy(F.col("rollback_run_id").alias("id")).agg(
        F.count(F.lit(1)).alias("changes"), F.count_if(F.col("action") == "restore").alias("logged_restores"),
        F.count_if(F.col("action") == "delete").alias("logged_deletes"),
    )
    target = promotions.select(
        F.col("id").alias("target_promotion_run_id"), F.col("status").alias("promotion_status"), F.col("load_run_id").alias("promoted_load_run_id")
    )
    counts = {name: 0 for name in ("changes", "logged_restores", "logged_deletes")}
    return rollbacks.join(target, "target_promotion_run_id", "left").join(logged, "id", "left").fillna(counts, list(counts))


def change_pages(changes: DataFrame, run: str, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Of every run's logged changes one page in this order, with ``position`` (from 1) and the run's ``total``.

    Only the rows up to the end of the page are kept while runs are put in order; totals are a partial aggregate.
    """
    place = F.row_number().over(Window.partitionBy(run).orderBy(*order))
    page = changes.withColumn("position", place).where(F.col("position") <= offset + limit).where(F.col("position") > offset)
    return page.join(changes.groupBy(run).agg(F.count(F.lit(1)).alias("total")), run)


# --- load attempts ---


def load_outcomes(attempts: DataFrame) -> DataFrame:
    """Attempts per outcome; rows count only for attempts that created a batch."""
    created = F.col("outcome") == "created"
    return attempts.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.coalesce(F.sum(F.when(created, F.col("total_rows") - F.col("rejected_rows"))), F.lit(0)).alias("rows_loaded"),
        F.coalesce(F.sum(F.when(created, F.col("rejected_rows"))), F.lit(0)).alias("rows_rejected"),
    )
