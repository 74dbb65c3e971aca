"""The logical tables of a media catalog, bound to the driver's tables; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as catalog rows: library, path, media type, status, capture time, place, hash."""
    return read(spark, sf_dir, "events").selectExpr(
        "event_id as asset_id", "user_id % 5 as library_id", "concat(event_type, '/IMG_', event_id, '.jpg') as rel_path",
        "case event_type when 'purchase' then 'video' when 'signup' then 'audio' else 'image' end as media_type",
        "case when event_type = 'error' then 'failed' when event_id % 23 = 0 then 'missing' when event_id % 17 = 0 then 'pending' else 'indexed' end as status",
        "if(event_id % 10 = 0, null, ts) as taken_at", "value as duration", "cast(get_json_object(props, '$.k') as bigint) as size",
        "concat('h', event_id % 997) as content_hash", "if(event_id % 31 = 0, event_id - 1, null) as live_photo",
        "if(user_id % 7 = 0, null, concat('Town', user_id % 20, ', Region', user_id % 4, ', Country', user_id % 2)) as place",
        "if(user_id % 7 = 0, null, cast(user_id % 160 - 80 as double)) as gps_lat", "if(user_id % 7 = 0, null, cast(user_id * 7 % 340 - 170 as double)) as gps_lon")


ASSETS = """assets AS (SELECT event_id AS asset_id, user_id % 5 AS library_id, concat(event_type, '/IMG_', event_id, '.jpg') AS rel_path,
    CASE event_type WHEN 'purchase' THEN 'video' WHEN 'signup' THEN 'audio' ELSE 'image' END AS media_type,
    CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 23 = 0 THEN 'missing' WHEN event_id % 17 = 0 THEN 'pending' ELSE 'indexed' END AS status,
    CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts END AS taken_at, value AS duration, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size,
    concat('h', event_id % 997) AS content_hash, CASE WHEN event_id % 31 = 0 THEN event_id - 1 END AS live_photo,
    CASE WHEN user_id % 7 = 0 THEN NULL ELSE concat('Town', user_id % 20, ', Region', user_id % 4, ', Country', user_id % 2) END AS place,
    CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(user_id % 160 - 80 AS DOUBLE) END AS gps_lat,
    CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(user_id * 7 % 340 - 170 AS DOUBLE) END AS gps_lon FROM events)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("asset_id"), F.col("label").alias("library_id"), F.col("embedding").alias("vector"))


VECTORS = "vectors AS (SELECT vec_id AS asset_id, label AS library_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five windows of 8 s with half overlap for each asset."""
    return read(spark, sf_dir, "embeddings").selectExpr("vec_id as embedding_id", "vec_id div 5 as asset_id", "cast(vec_id % 5 as int) as segment_index",
                                                        "cast(4 * (vec_id % 5) as double) as start_s", "cast(4 * (vec_id % 5) + 8 as double) as end_s", "embedding as vector")


SEGMENTS = """segments AS (SELECT vec_id AS embedding_id, vec_id // 5 AS asset_id, CAST(vec_id % 5 AS INTEGER) AS segment_index, CAST(4 * (vec_id % 5) AS DOUBLE) AS start_s,
    CAST(4 * (vec_id % 5) + 8 AS DOUBLE) AS end_s, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as detected boxes: one row for each box, coordinates in fractions of the photo."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as content_hash", "l_linenumber as box_no", "l_returnflag as label", "round(10 * l_discount, 2) as score", "round(l_tax * 5, 4) as x0", "round((l_quantity - 1) / 100, 4) as y0",
        "round(least(1.0D, l_tax * 5 + l_quantity / 100), 4) as x1", "round(least(1.0D, (l_quantity - 1) / 100 + l_discount * 4 + 0.05D), 4) as y1")


BOXES = """boxes AS (SELECT l_orderkey AS content_hash, l_linenumber AS box_no, l_returnflag AS label, round(10 * l_discount, 2) AS score, round(l_tax * 5, 4) AS x0,
    round((l_quantity - 1) / 100, 4) AS y0, round(least(1.0, l_tax * 5 + l_quantity / 100), 4) AS x1, round(least(1.0, (l_quantity - 1) / 100 + l_discount * 4 + 0.05), 4) AS y1 FROM lineitem)"""


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as photos of the detector: the content hash is the order."""
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey as asset_id", "o_custkey % 5 as library_id", "concat('p/', o_orderkey, '.jpg') as rel_path", "o_orderkey as content_hash", "o_orderdate as taken_at")


PHOTOS = "photos AS (SELECT o_orderkey AS asset_id, o_custkey % 5 AS library_id, concat('p/', o_orderkey, '.jpg') AS rel_path, o_orderkey AS content_hash, o_orderdate AS taken_at FROM orders)"


def detection_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").filter("o_orderkey % 4 <> 0").selectExpr("o_orderkey as content_hash", "'detector-1' as detector")


RUNS = "runs AS (SELECT o_orderkey AS content_hash, 'detector-1' AS detector FROM orders WHERE o_orderkey % 4 <> 0)"


def hashed_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr("doc_id as asset_id", "source as library_id", "concat(source, '/', doc_id) as rel_path", "sha2(text, 256) as content_hash",
                                                       "n_chars as size", "if(doc_id % 11 = 0, 'missing', if(doc_id % 5 = 0, 'pending', 'indexed')) as status")


HASHED = """hashed AS (SELECT doc_id AS asset_id, source AS library_id, concat(source, '/', doc_id) AS rel_path, sha256(text) AS content_hash, n_chars AS size,
    CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'pending' ELSE 'indexed' END AS status FROM documents)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings of each source by length, to 10 places, with grades 0 to 2; null: not judged."""
    d, l = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    from ..operators.blocks import numbered

    ranked = numbered(d.selectExpr("source as query", "doc_id as candidate", "-n_chars as shorter"), ["query"], ["shorter", "candidate"], "rank")
    return ranked.join(l, ranked.candidate == l.doc_id, "left").selectExpr("query", "candidate", "rank", "quality + toxic as grade")


JUDGED = """judged AS (SELECT source AS query, d.doc_id AS candidate, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, d.doc_id) AS rank, quality + toxic AS grade
    FROM documents d LEFT JOIN labels l USING (doc_id))"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .selectExpr("c_custkey as asset_id", "concat(c_mktsegment, ', ', n_name, ', ', r_name) as place"))


PLACES = """places AS (SELECT c_custkey AS asset_id, concat(c_mktsegment, ', ', n_name, ', ', r_name) AS place FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr("c_custkey as point_id", "cast(pmod(c_custkey * 37, 170) - 85 as double) as lat", "cast(pmod(c_custkey * 91, 360) - 180 as double) as lon")


def towns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as town_id", "concat('T', s_suppkey) as name", "concat('R', s_suppkey % 9) as region", "if(s_suppkey % 3 = 0, concat('R', s_suppkey % 9), concat('C', s_suppkey % 4)) as country",
        "cast(pmod(s_suppkey * 37, 170) - 85 as double) + (s_suppkey % 5) * 0.2D as lat", "cast(pmod(s_suppkey * 91, 360) - 180 as double) as lon", "1000 * (1 + s_suppkey) as population")


POINTS = """points AS (SELECT c_custkey AS point_id, CAST(c_custkey * 37 % 170 - 85 AS DOUBLE) AS lat, CAST(c_custkey * 91 % 360 - 180 AS DOUBLE) AS lon FROM customer)"""
TOWNS = """towns AS (SELECT s_suppkey AS town_id, concat('T', s_suppkey) AS name, concat('R', s_suppkey % 9) AS region, CASE WHEN s_suppkey % 3 = 0 THEN concat('R', s_suppkey % 9) ELSE concat('C', s_suppkey % 4) END AS country,
    CAST(s_suppkey * 37 % 170 - 85 AS DOUBLE) + (s_suppkey % 5) * CAST(0.2 AS DOUBLE) AS lat, CAST(s_suppkey * 91 % 360 - 180 AS DOUBLE) AS lon, 1000 * (1 + s_suppkey) AS population FROM supplier)"""


def selection_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as items of one selection for each customer, in order of date."""
    return read(spark, sf_dir, "orders").selectExpr("o_custkey as selection_id", "o_orderkey as asset_id", "row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as position",
                                                    "o_totalprice as bytes", "o_orderstatus as state")


ITEMS = """items AS (SELECT o_custkey AS selection_id, o_orderkey AS asset_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position,
    o_totalprice AS bytes, o_orderstatus AS state FROM orders)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations")
