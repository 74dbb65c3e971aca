"""Streams over the event log, run until all given rows are read: I1, I3, I4."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources import bindings as b
from ..sources.staging import shared_dir
from ..streaming import watch


def table_stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table as a stream, whether it is one file or a folder of files. The path is a pattern,
    because Spark takes a plain path of a stream for a folder."""
    return spark.readStream.schema(b.read(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    return table_stream(spark, d, "events")


def drained(stream: DataFrame, label: str) -> DataFrame:
    """Runs a stream over what is there and reads its sink."""
    spark, root = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/{label}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("i1_watch_stream", """SELECT library_id, poll, signature FROM (SELECT user_id % 50 AS library_id, event_id AS poll, CAST(event_id // 200 AS VARCHAR) AS signature, row_number() OVER (PARTITION BY user_id % 50, event_id // 200 ORDER BY event_id) AS rn,
    event_id // 200 <> min(event_id // 200) OVER (PARTITION BY user_id % 50) AS changed FROM events) WHERE rn = 2 AND changed""")
def i1(spark, d):
    """A library's folder signature at each day of the log; a change counts when it is seen twice."""
    polls = event_stream(spark, d).selectExpr("user_id % 50 as library_id", "event_id as poll", "cast((event_id div 200) as string) as signature")
    with watch.configured(spark, watch.DRAINED):
        return drained(watch.watch_folders(polls), "watch").select("library_id", "poll", "signature")


@query("i3_first_per_hash_stream", "SELECT count(DISTINCT event_id % 997) AS hashes FROM events")
def i3(spark, d):
    hashes = event_stream(spark, d).selectExpr("event_id % 997 as content_hash")
    return drained(watch.first_per_hash(hashes), "hashes").agg(F.count(F.lit(1)).alias("hashes"))


@query("i4_two_phase", f"WITH {b.ASSETS} SELECT vec_id IS NOT NULL AS searchable, count(*) AS n FROM assets LEFT JOIN embeddings ON vec_id = asset_id GROUP BY 1")
def i4(spark, d):
    return watch.two_phase(b.assets(spark, d), b.vectors(spark, d)).groupBy("searchable").agg(F.count(F.lit(1)).alias("n"))


@query("i4_two_sinks", "SELECT count(*) AS assets, count(vec_id) AS searchable FROM events LEFT JOIN embeddings ON vec_id = event_id")
def i4b(spark, d):
    """Catalog rows and vectors as two streams with a sink each."""
    catalog = event_stream(spark, d).selectExpr("event_id as asset_id", "event_type", "user_id")
    v = table_stream(spark, d, "embeddings").selectExpr("vec_id as asset_id", "embedding as vector")
    assets, vectors = watch.two_sinks(spark, catalog, v, f"{shared_dir(spark)}/phases-{uuid.uuid4().hex}")
    return watch.two_phase(assets, vectors).agg(F.count(F.lit(1)).alias("assets"), F.count_if("searchable").alias("searchable"))
