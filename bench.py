"""Times the headline jobs and prints one JSON line.

Inputs are written as Parquet once before timing (a user's catalog is a table, not a generator). Catalogs are text rows,
as a supplier file holds them; inspection jobs type them, run the rules, write the labelled report and, for the headline,
count the summary as well. Every timed job reads whole tables and writes its whole result to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalake.functions.profiles import FASHION
from catalake.operators import conform as cf
from catalake.operators import history, promote, report, scan
from catalake.operators.inspect import inspect
from catalake.operators.row_rules import ROW_RULES
from catalake.plans.fixtures import CATALOG, FEED_A, LOAD_RUNS, ORDER_PRODUCTS, STAGING, TIDY_PRODUCTS
from catalake.sources.catalog import load_catalog

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
INPUTS = tempfile.mkdtemp(prefix="bench-")
WARM_DIR = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("catalake-bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    def kept(name: str, build) -> DataFrame:
        path = f"{INPUTS}/{os.path.basename(folder.rstrip('/'))}/{name}"
        build().repartition(int(CPUS)).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return {
        "raw": kept("order_products", lambda: ORDER_PRODUCTS.frame(spark, folder)),
        "tidy": kept("tidy_products", lambda: TIDY_PRODUCTS.frame(spark, folder)),
        "feed": kept("feed_a", lambda: FEED_A.frame(spark, folder)),
        "runs": kept("load_runs", lambda: LOAD_RUNS.frame(spark, folder)),
        "staging": kept("staging", lambda: STAGING.frame(spark, folder)),
        "live": kept("catalog", lambda: CATALOG.frame(spark, folder)),
        "documents": spark.read.parquet(f"{folder}/documents.parquet"),
    }


def inspected(raw: DataFrame) -> DataFrame:
    """The report of a catalog of text rows; the summary is observed on the same pass."""
    reported = report.report(inspect(load_catalog(raw)))
    counts = [F.count(F.lit(1)).alias("issues"), F.count_if(F.col("severity_rank") == 0).alias("errors"),
              F.count_if(F.col("severity_rank") == 1).alias("warnings")]
    return reported.observe("summary", *counts)


def jobs(t: dict[str, DataFrame]) -> dict[str, Callable[[], DataFrame]]:
    place = ["file_id", "source_row_number"]
    preview = lambda: promote.preview(t["staging"], t["live"])
    return {
        "inspect_published_mix": lambda: inspected(t["tidy"]),
        "inspect_defect_heavy": lambda: inspected(t["raw"]),
        "inspect_row_rules": lambda: report.report(inspect(load_catalog(t["raw"]), rules=ROW_RULES)),
        "stats_by_rule": lambda: report.count_by_rule(report.report(inspect(load_catalog(t["raw"])))),
        "conform_feed": lambda: cf.batch_summary(cf.conform(t["feed"], FASHION, place), ["file_id"]),
        "mask_documents": lambda: scan.mask_columns(t["documents"], ["text"]),
        "quality_delta": lambda: history.quality_delta(t["runs"]),
        "reconcile": lambda: promote.reconcile_counts(promote.reconcile(t["staging"], t["live"])),
        "promote": lambda: promote.apply_promotion(t["live"], promote.applicable(preview(), t["staging"])),
        "preview_hash": lambda: promote.preview_hash(preview()),
    }


def run(build: Callable[[], DataFrame]) -> float:
    """Seconds to build the plan (with the size checks it makes) and write the whole result."""
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = session()
    if os.path.isdir(WARM_DIR):
        for build in jobs(tables(spark, WARM_DIR)).values():
            run(build)
    loaded = tables(spark, SF_DIR)
    rows = loaded["tidy"].agg(F.count(F.lit(1)).alias("n")).first()["n"]
    seconds = {name: round(run(build), 4) for name, build in jobs(loaded).items()}
    print(
        json.dumps(
            {
                "metric": "inspect_published_mix_seconds", "value": seconds["inspect_published_mix"], "unit": "sec",
                "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "catalog_rows": rows, "rows_per_second": round(rows / seconds["inspect_published_mix"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
