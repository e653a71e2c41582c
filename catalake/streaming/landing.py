"""Feed files that keep arriving: routed to a profile, conformed and loaded once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from catalake.functions.profiles import Profile
from catalake.operators.conform import accepted, batch_summary, conform, rejected
from catalake.operators.identity import new_arrivals
from catalake.operators.scan import mask_source_map
from catalake.sources.feeds import FEED_SCHEMA, LIMIT_VERDICTS, Limits, parse_feeds, records_of, verdicts_of, widened
from catalake.sources.lineage import content_sha256
from catalake.sources.store import Store


def feed_stream(spark: SparkSession, landing: str, glob: str = "*.csv", files_per_trigger: int = 1000) -> DataFrame:
    """New files below the landing directory as a stream."""
    return (
        spark.readStream.format("binaryFile").schema(FEED_SCHEMA)
        .option("pathGlobFilter", glob).option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_trigger).load(landing)
    )


def effective_profiles(registry: DataFrame, overrides: DataFrame) -> DataFrame:
    """(profile_id, effective_version, inactive): the override when there is one, even if it is NULL (switched off).

    ``registry`` has profile_id and active_version, ``overrides`` profile_id and active_version.
    """
    chosen = overrides.select("profile_id", F.col("active_version").alias("override"), F.lit(True).alias("has_override"))
    joined = registry.join(chosen, "profile_id", "left")
    version = F.when(F.col("has_override"), F.col("override")).otherwise(F.col("active_version"))
    return joined.select("profile_id", version.alias("effective_version"), version.isNull().alias("inactive"))


def route(arrivals: DataFrame, effective: DataFrame) -> DataFrame:
    """Adds effective_version and route: run, inactive (known but off) or unsupported (not in the registry)."""
    joined = arrivals.join(effective, "profile_id", "left")
    verdict = (
        F.when(F.col("inactive").isNull(), F.lit("unsupported"))
        .when(F.col("inactive"), F.lit("inactive")).otherwise(F.lit("run"))
    )
    return joined.withColumn("route", verdict).drop("inactive")


def latest_status(events: DataFrame) -> DataFrame:
    """Current status of every job from its appended status rows (job_id, status, at, seq)."""
    return events.groupBy("job_id").agg(
        F.max_by("status", F.struct("at", "seq")).alias("status"), F.max("at").alias("at"),
        F.count(F.lit(1)).alias("steps"),
    )


def load_wave(files: DataFrame, profile: Profile, store: Store, limits: Limits = Limits()) -> bool:
    """Load the files whose content this profile version has not loaded yet; False when there are none.

    A wave is named by profile, version and the contents it holds, so files of another profile or a fresh checkpoint on
    an old target never meet a name that is taken. Content that was loaded earlier, or repeats within the wave, is left
    out by its hash, unless it was refused for a limit; work that was begun but not committed has the same name and is
    written again. ``routed.load_routed`` loads files of several profiles.
    """
    hashed = files.select("path", content_sha256(F.col("content")).alias("input_sha256"))
    known = store.spark.createDataFrame([], "input_sha256 string")
    if not store.manifest().where(F.startswith("entry", F.lit("batch:"))).isEmpty():
        known = store.batches("runs").where(
            (F.col("profile_name") == profile.name) & (F.col("profile_version") == profile.version)
            & ~F.col("status").isin(*LIMIT_VERDICTS)
        ).select("input_sha256")
    fresh = new_arrivals(hashed, known, ["input_sha256"], ["path"]).select("path", "input_sha256")
    content = F.xxhash64("input_sha256")
    n, mark = fresh.agg(F.count(F.lit(1)), F.bit_xor(content)).first()
    if not n:
        return False
    work = files.select("path", "length", "content").join(fresh.select("path"), "path", "left_semi")
    parsed = parse_feeds(work, profile.required, limits).persist()  # parsed once for all tables of the wave
    verdicts = verdicts_of(parsed).join(fresh, "path")
    rows = widened(records_of(parsed), profile.sources, ["path", "source_row_number"])
    conformed = conform(rows, profile, ["path", "source_row_number"])
    named = {"profile_name": F.lit(profile.name), "profile_version": F.lit(profile.version)}
    # a refused file is a run too: its content is known, and its status says why nothing was loaded
    runs = verdicts.join(batch_summary(conformed, ["path"]), "path", "left").withColumns(named)
    refused = rejected(conformed, ["path", "source_row_number"]).withColumn("source", mask_source_map(F.col("source")))
    try:
        return store.append_batch(
            f"{profile.name}-{profile.version}-{n}-{mark & (2**64 - 1):016x}-{limits.max_bytes}-{limits.max_rows}",
            {"staging": accepted(conformed), "rejects": refused.drop("errors"), "verdicts": verdicts, "runs": runs},
            note=profile.name,
        )
    finally:
        parsed.unpersist()


def stream_load(spark: SparkSession, landing: str, profile: Profile, store_path: str, checkpoint: str,
                limits: Limits = Limits(), glob: str = "*.csv") -> StreamingQuery:
    """Load everything that has arrived, then stop. Restarts and repeated files add nothing."""
    stream = feed_stream(spark, landing, glob)

    def write(batch: DataFrame, number: int) -> None:
        load_wave(batch, profile, Store(batch.sparkSession, store_path), limits)

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
