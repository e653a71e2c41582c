"""Table invariants as audits: each returns the rows that break a rule (table, rule, key)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _broken(frame: DataFrame, table: str, rule: str, key: Column, test: Column) -> DataFrame:
    return frame.where(test).select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), key.cast("string").alias("key")
    )


def rows_that_break(frame: DataFrame, table: str, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule, in one scan. A NULL test does not count as broken."""
    hits = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]))
    return frame.select(
        F.lit(table).alias("table_name"), F.explode(hits).alias("rule"), F.col(key).cast("string").alias("key")
    )


def non_negative(columns: list[str]) -> dict[str, Column]:
    return {f"negative_{name}": F.col(name) < 0 for name in columns}


def quality_rules() -> dict[str, Column]:
    """Quality columns all NULL or all set; total = loaded + rejected."""
    parts = [F.col(name).isNull() for name in ("total_rows", "rejected_rows", "error_counts")]
    some, every = reduce(lambda a, b: a | b, parts), reduce(lambda a, b: a & b, parts)
    return {
        "quality_partly_set": some & ~every,
        "total_mismatch": F.col("total_rows") != F.col("loaded_rows") + F.col("rejected_rows"),
    }


def repeated_keys(frame: DataFrame, table: str, columns: list[str], only: Column | None = None) -> DataFrame:
    """Keys that occur more than once (NULL parts never collide)."""
    kept = frame if only is None else frame.where(only)
    for name in columns:
        kept = kept.where(F.col(name).isNotNull())
    counts = kept.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    shown = F.concat_ws("|", *[F.col(name).cast("string") for name in columns])
    return _broken(counts, table, "repeated_" + "_".join(columns), shown, F.col("n") > 1)


def orphans(child: DataFrame, table: str, reference: str, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose reference does not exist."""
    known = parents.select(F.col(parent_key).alias(reference))
    lost = child.where(F.col(reference).isNotNull()).join(known, reference, "left_anti")
    return _broken(lost, table, f"orphan_{reference}", F.col(key), F.lit(True))


def run_state_rules(final: tuple[str, ...]) -> dict[str, Column]:
    """A run in a final state is completed, any other is not."""
    done = F.col("status").isin(*final)
    return {
        "final_not_completed": done & ~F.col("completed"),
        "open_but_completed": ~done & F.col("completed"),
    }


def change_rules(actions_without_before: tuple[str, ...], actions_without_after: tuple[str, ...]) -> dict[str, Column]:
    """Which side of a change must be present, and that something changed."""
    no_before, no_after = F.col("action").isin(*actions_without_before), F.col("action").isin(*actions_without_after)
    if not actions_without_before:
        no_before = F.lit(False)
    if not actions_without_after:
        no_after = F.lit(False)
    return {
        "before_presence": F.col("before").isNull() != no_before,
        "after_presence": F.col("after").isNull() != no_after,
        "empty_changes": F.size("changed_fields") <= 0,
    }


def fingerprints(lines: DataFrame, version: list[str]) -> DataFrame:
    """(version, n, mark) of long texts given as lines (place, line).

    The hashes of numbered lines are added up in four lanes, which needs no order and no list of lines in one place.
    """
    digest = F.sha2(F.concat_ws(":", F.col("place").cast("string"), F.coalesce(F.concat(F.lit("="), "line"), F.lit(""))), 256)
    lane = lambda i: F.sum(F.conv(F.substr(F.col("_digest"), F.lit(16 * i + 1), F.lit(16)), 16, 10).cast("decimal(20,0)"))
    return lines.withColumn("_digest", digest).groupBy(*version).agg(
        F.count(F.lit(1)).alias("n"), F.concat_ws("-", *[lane(i).cast("string") for i in range(4)]).alias("mark")
    )


def changed_versions(current: DataFrame, published: DataFrame, version: list[str]) -> DataFrame:
    """(version, problem): versions whose text is not the published one, or which were never published."""
    joined = current.join(published.select(*version, F.col("n").alias("_n"), F.col("mark").alias("_mark")), version, "left")
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("mark").eqNullSafe(F.col("_mark"))
    return joined.where(~same).select(*version, F.when(F.col("_mark").isNull(), "unpublished").otherwise("changed").alias("problem"))


def _hash_form(name: str) -> Column:
    """A hash that is there but not 64 characters long."""
    return F.length(name) != 64


def load_run_rules() -> dict[str, Column]:
    """Counts of a load run, and that a file of refused rows is named if and only if their details are kept."""
    stored, named = F.col("reject_details_stored"), F.col("rejects_file_sha256").isNotNull()
    return non_negative(["loaded_rows", "total_rows", "rejected_rows"]) | {
        "reject_state": stored != named, "reject_hash_form": _hash_form("rejects_file_sha256"),
    }


_RUN_STATES = ("applying", "succeeded", "failed", "blocked")


def _run_rules(counts: list[str]) -> dict[str, Column]:
    """A run is in a known state, has an end exactly when it ended, a well-formed hash and no negative count."""
    ended, open_run = F.col("completed_at").isNotNull(), F.col("status") == "applying"
    return non_negative(counts) | {
        "unknown_status": ~F.col("status").isin(*_RUN_STATES),
        "end_and_status": F.col("status").isin(*_RUN_STATES) & (open_run == ended),
        "preview_hash_form": _hash_form("preview_hash"),
    }


def promotion_run_rules() -> dict[str, Column]:
    return _run_rules(["inserted_count", "updated_count", "unchanged_count", "blocked_count", "error_count", "warning_count"])


def rollback_run_rules() -> dict[str, Column]:
    return _run_rules(["restored_count", "deleted_count", "conflict_count"])


def logged_change_rules(without_before: str | None, without_after: str | None, others: tuple[str, ...]) -> dict[str, Column]:
    """A logged change has one of the log's actions, the sides that its action asks for, and changed fields."""
    def side(name: str, action: str | None) -> Column:
        lacks = F.col("action") == action if action else F.lit(False)
        return F.col(name).isNull() != lacks

    known = [a for a in (without_before, without_after, *others) if a]
    return {
        "unknown_action": ~F.col("action").isin(*known), "before_presence": side("before_data", without_before),
        "after_presence": side("after_data", without_after), "no_changed_fields": F.size("changed_fields") <= 0,
    }


def rejected_row_rules() -> dict[str, Column]:
    """The header is row 1; a refused row says why."""
    return {"row_number_too_small": F.col("source_row_number") < 2, "no_errors": F.size("errors") <= 0}
