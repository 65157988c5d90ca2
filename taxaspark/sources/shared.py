"""Files that a query writes and reads back, in the folder that driver and executors share; they go when the process ends."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return f"{path}/{name}"


def kept(df: DataFrame) -> DataFrame:
    """The rows, written once: later plans read them in place of making them again, and a lost executor costs no more."""
    path = new_folder(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
