"""Tables in the cluster's shared folder: they cut lineage and survive the loss of executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; the warehouse, which is shared too, only where that is unset."""
    setting = "spark.checkpoint.dir"
    named = spark.conf.get(setting, None) or spark.sparkContext.getConf().get(setting)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


#: Whether Spark removes a statement's shuffle files at its end, not when the driver happens to collect its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(frame: DataFrame, name: str, free: bool = False) -> DataFrame:
    """The rows of ``frame`` written once as Parquet under a path of their own, and read back.

    With ``free`` the shuffles of this statement go from the executors' disks as soon as the rows are written.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_FREE)
    if free:
        spark.conf.set(_FREE, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(_FREE, before)
    return spark.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
