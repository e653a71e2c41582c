"""Feeds of many suppliers in one stream: each file goes to the profile version that is in effect when it arrives.

Files are routed by joining a micro-batch with the registry as it is at that moment. Unknown and switched-off profiles are
refused as rows, and so is a file whose accepted rows don't pass staging admission; nothing else of the micro-batch suffers.
Tables are plain Parquet below the target, one folder for each micro-batch of a profile version, named by the contents in it,
so that a repeated attempt overwrites its own folder. The runs table is written last: rows of other tables count only where
their batch has runs (see ``loaded``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from catalake.functions.profiles import Profile
from catalake.operators.conform import accepted, batch_summary, conform, rejected, staging_admission
from catalake.operators.identity import new_arrivals
from catalake.operators.scan import mask_source_map
from catalake.sources.feeds import LIMIT_VERDICTS, Limits, parse_feeds, records_of, verdicts_of, widened
from catalake.sources.lineage import content_sha256
from catalake.streaming.landing import effective_profiles, feed_stream, route

RUNS = "input_sha256 string, profile_name string, profile_version string, path string, status string, detail string, loaded_rows bigint, rejected_rows bigint, batch string"
EVENTS = "path string, input_sha256 string, profile_id string, seq int, status string, code string, batch string"
_IDENTITY = ["input_sha256", "profile_name", "profile_version"]


def folder_of(path: Column) -> Column:
    """The name of the folder that a file lies in: by default its profile."""
    return F.regexp_extract(path, "/([^/]+)/[^/]+$", 1)


def table(spark: SparkSession, target: str, name: str, schema: str) -> DataFrame:
    """A table below the target; empty before its first batch."""
    try:
        return spark.read.schema(schema).parquet(f"{target}/{name}")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def loaded(spark: SparkSession, target: str, name: str) -> DataFrame:
    """Rows of ``staging`` or ``rejects`` of batches whose runs were written."""
    done = table(spark, target, "runs", RUNS).select("batch").distinct()
    return spark.read.parquet(f"{target}/{name}").join(done, "batch", "left_semi")


def _events(files: DataFrame, seq: int, status: str, code: Column, batch: str) -> DataFrame:
    return files.select(
        "path", "input_sha256", "profile_id", F.lit(seq).alias("seq"), F.lit(status).alias("status"), code.cast("string").alias("code"),
        F.lit(batch).alias("batch"),
    )


def _write(frame: DataFrame, target: str, name: str, batch: str) -> None:
    """The rows of one batch, in place of what an earlier attempt left."""
    frame.drop("batch").write.mode("overwrite").parquet(f"{target}/{name}/batch={batch}")


def _load(files: DataFrame, profile: Profile, target: str, batch: str, limits: Limits) -> None:
    """One micro-batch of one profile version; ``files``: path, length, content, input_sha256, profile_id."""
    # parsed once for all tables of the batch
    parsed = parse_feeds(files.select("path", "length", "content"), profile.required, limits).persist()
    rows = widened(records_of(parsed), profile.sources, ["path", "source_row_number"])
    conformed = conform(rows, profile, ["path", "source_row_number"])
    good = accepted(conformed)
    admitted = staging_admission(good, ["path"]).select("path", "admitted")
    refused = F.col("admitted").eqNullSafe(F.lit(False))
    verdicts = verdicts_of(parsed).join(batch_summary(conformed, ["path"]), "path", "left").join(admitted, "path", "left")
    runs = files.select("path", "input_sha256").join(verdicts, "path").select(
        "input_sha256", F.lit(profile.name).alias("profile_name"), F.lit(profile.version).alias("profile_version"), "path",
        F.when(refused, "staging_refused").otherwise(F.col("status")).alias("status"), "detail",
        F.when(refused, 0).otherwise(F.coalesce("loaded_rows", F.lit(0))).cast("bigint").alias("loaded_rows"),
        F.coalesce("rejected_rows", F.lit(0)).cast("bigint").alias("rejected_rows"), F.lit(batch).alias("batch"),
    )

    try:
        staged = good.join(admitted.where("admitted"), "path", "left_semi")
        _write(staged, target, "staging", batch)
        masked = rejected(conformed, ["path", "source_row_number"]).withColumn("source", mask_source_map(F.col("source")))
        _write(masked.drop("errors"), target, "rejects", batch)
        _write(runs, target, "runs", batch)
        done = files.select("path", "input_sha256", "profile_id").join(runs.select("path", F.col("status").alias("verdict")), "path")
        ok = F.col("verdict") == "ok"
        events = _events(files, 1, "running", F.lit(None), batch).unionByName(
            _events(done.where(ok), 2, "succeeded", F.lit(None), batch)
        ).unionByName(_events(done.where(~ok), 2, "failed", F.col("verdict"), batch))
        _write(events, target, "events", batch)
    finally:
        parsed.unpersist()


def load_routed(files: DataFrame, registry: DataFrame, overrides: DataFrame, profiles: dict[tuple[str, str], Profile], target: str,
                limits: Limits = Limits(), profile_of=folder_of) -> None:
    """Load the files of a micro-batch (path, length, content) that have not been loaded yet.

    ``registry`` and ``overrides`` say which version of a profile is in effect (see ``effective_profiles``); ``profiles`` has the
    mappings by name and version. A version without a mapping counts as unsupported. Content counts as loaded once its
    verdict can't change: files refused for a limit, an inactive or an unknown profile are judged again when they come again.
    """
    spark = files.sparkSession
    arrived = files.withColumns({"input_sha256": content_sha256(F.col("content")), "profile_id": profile_of(F.col("path"))})
    mapped = spark.createDataFrame(list(profiles), "profile_id string, effective_version string").withColumn("mapped", F.lit(True))
    routed = route(arrived, effective_profiles(registry, overrides)).join(mapped, ["profile_id", "effective_version"], "left")
    routed = routed.withColumn("route", F.when((F.col("route") == "run") & F.col("mapped").isNull(), "unsupported").otherwise(F.col("route")))
    known = table(spark, target, "runs", RUNS).where(~F.col("status").isin(*LIMIT_VERDICTS)).select(*_IDENTITY)
    named = routed.where("route = 'run'").withColumnsRenamed({"profile_id": "profile_name", "effective_version": "profile_version"})
    fresh = new_arrivals(named.select("path", *_IDENTITY), known, _IDENTITY, ["path"])
    marks = fresh.groupBy("profile_name", "profile_version").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("input_sha256")).alias("mark")
    )
    # one row for each mapping at most
    for row in marks.collect():
        mine = fresh.where((F.col("profile_name") == row["profile_name"]) & (F.col("profile_version") == row["profile_version"]))
        work = arrived.join(mine.select("path"), "path", "left_semi")
        batch = f"{row['profile_name']}-{row['profile_version']}-{row['n']}-{row['mark'] & (2**64 - 1):016x}-{limits.max_bytes}-{limits.max_rows}"
        _load(work, profiles[row["profile_name"], row["profile_version"]], target, batch, limits)
    refused = routed.where("route <> 'run'")
    n, mark = refused.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("path", "input_sha256", "route"))).first()
    if n:
        batch = f"refused-{n}-{mark & (2**64 - 1):016x}"
        _write(_events(refused, 1, "refused", F.col("route"), batch), target, "events", batch)


def file_states(spark: SparkSession, target: str) -> DataFrame:
    """(path, input_sha256, status, code): where every file has come to; a load counts more than an earlier refusal."""
    events = table(spark, target, "events", EVENTS)
    return events.groupBy("path", "input_sha256").agg(F.max_by(F.struct("status", "code"), F.struct(F.col("status") != "refused", "seq", F.col("status") == "succeeded")).alias("last")).select(
        "path", "input_sha256", "last.*"
    )


def routed_stream(spark: SparkSession, landing: str, registry, profiles: dict[tuple[str, str], Profile], target: str, checkpoint: str,
                  limits: Limits = Limits(), glob: str = "*.csv", profile_of=folder_of) -> StreamingQuery:
    """Load everything that has arrived, then stop. ``registry()`` gives (registry, overrides) as they are for each micro-batch."""
    def write(batch: DataFrame, number: int) -> None:
        load_routed(batch, *registry(), profiles, target, limits, profile_of)

    return (
        feed_stream(spark, landing, glob).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
