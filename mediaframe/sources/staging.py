"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master, as in tests, gets a folder of its own."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, written and counted, as the side of a join to broadcast if it has so few rows; else by a merge join."""
    table = staged(df)
    return F.broadcast(table) if table.count() <= rows else table.hint("merge")
