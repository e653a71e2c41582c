"""Tables recorded in the cluster's shared folder, so that later steps read a decision instead of making it again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; the warehouse, which is shared too, only where that is unset."""
    setting = "spark.checkpoint.dir"
    named = spark.conf.get(setting, None) or spark.sparkContext.getConf().get(setting)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/recorded"


def recorded(frame: DataFrame, name: str) -> DataFrame:
    """The rows of ``frame`` written once as Parquet under a path of their own, and read back."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
