"""Batches and catalog snapshots on a shared file system.

Data files are written first into a directory of their own; one manifest row written last makes them visible. Readers
look only at what the manifest names, so a half-written directory is never read and nothing is updated in place.
There is a single writer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "entry string, version bigint, note string"


class StaleVersion(RuntimeError):
    """Somebody committed a version in between."""


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def _path(self, entry: str, version: int) -> str:
        return f"{self.root}/data/{entry}/v={version}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def manifest(self) -> DataFrame:
        path = f"{self.root}/manifest"
        if not self._exists(path):
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(path)

    def latest(self, entry: str) -> int:
        """Newest committed version, 0 when there is none."""
        row = self.manifest().where(F.col("entry") == entry).agg(F.max("version").alias("v")).first()
        return row["v"] or 0

    def commit(self, entry: str, frame: DataFrame, expected: int | None = None, note: str = "",
               partition_by: tuple[str, ...] = ()) -> int:
        """Write a snapshot and make it the latest. ``expected``: the version the caller worked from."""
        current = self.latest(entry)
        if expected is not None and expected != current:
            raise StaleVersion(f"{entry}: expected version {expected}, found {current}")
        version = current + 1
        frame.write.mode("overwrite").partitionBy(*partition_by).parquet(self._path(entry, version))
        row = self.spark.createDataFrame([(entry, version, note)], _MANIFEST)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return version

    def read(self, entry: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self._path(entry, version or self.latest(entry)))

    def append_batch(self, batch: str, tables: dict[str, DataFrame], note: str = "") -> bool:
        """Append the tables of one batch as a unit; False when the batch is already there.

        A batch that was started but not committed is written again over its own directories.
        """
        if not self.manifest().where((F.col("entry") == f"batch:{batch}")).isEmpty():
            return False
        for name, frame in tables.items():
            frame.write.mode("overwrite").parquet(f"{self.root}/batches/{name}/batch={batch}")
        row = self.spark.createDataFrame([(f"batch:{batch}", 1, note)], _MANIFEST)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return True

    def batches(self, table: str) -> DataFrame:
        """Rows of one table over all committed batches, with the column ``batch``."""
        committed = self.manifest().where(F.startswith("entry", F.lit("batch:"))).select(
            F.substring_index("entry", ":", -1).alias("batch")
        )
        rows = self.spark.read.parquet(f"{self.root}/batches/{table}")
        return rows.withColumn("batch", F.col("batch").cast("string")).join(committed, "batch", "left_semi")
