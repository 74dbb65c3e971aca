"""Whole queries of the engine and operators over several tables: A1, A4, A6, A11-A15, B3, B8, B14, C10, C11, D9, D11, D17, D21, D23, D24, E17, E18, F6, H31, H32, I2, J2, J3, K1, K2, K8, L1, L2, L5, L6, L10."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pixels
from ..functions.vectors import l2_norm, truncate_dim
from ..operators import catalog as c
from ..operators import detections as det
from ..operators import evaluation as ev
from ..operators import lookalikes
from ..operators import places as pl
from ..operators import search as s
from ..operators import selections as sel
from ..registry import query
from ..sources import bindings as b
from ..sources import media
from ..sources.rawfiles import write_files
from ..sources.staging import shared_path, staged
from ..streaming import watch
from .catalog import SCAN, VISIBLE, scan
from .retrieval import PAIRS, Q0, STARS, query_vector

A, H, V, S, B, P, R, I = b.ASSETS, b.HASHED, b.VECTORS, b.SEGMENTS, b.BOXES, b.PHOTOS, b.RUNS, b.ITEMS
PROFILED = "profiled AS (SELECT vec_id // 2 AS asset_id, CASE WHEN vec_id % 3 = 0 THEN 'old' ELSE 'current' END AS profile_key, 'image' AS modality, CAST(vec_id % 2 AS INTEGER) AS segment_index, vec_id FROM embeddings)"


def profiled(spark, d):
    return b.read(spark, d, "embeddings").selectExpr("vec_id div 2 as asset_id", "if(vec_id % 3 = 0, 'old', 'current') as profile_key", "'image' as modality", "cast(vec_id % 2 as int) as segment_index", "vec_id", "embedding as vector")


# Catalog.


@query("b3_filter_gaps", f"WITH {A} SELECT count(*) - count(taken_at) AS undated, CAST(NULL AS BIGINT) AS unplaced FROM assets WHERE {VISIBLE}")
def b3(spark, d):
    return c.filter_gaps(c.scope(b.assets(spark, d)), dated=True, placed=False)


@query("b8_public_columns", f"""WITH {A}, v AS (SELECT live_photo AS photo, min(asset_id) AS video FROM assets WHERE live_photo IS NOT NULL AND status <> 'missing' GROUP BY 1)
    SELECT asset_id, library_id, rel_path, media_type, status, size, duration, taken_at, gps_lat, gps_lon, place, video AS live_video, json_extract_string(props, '$.k') AS source FROM assets LEFT JOIN v ON photo = asset_id JOIN events ON event_id = asset_id""")
def b8(spark, d):
    a = b.assets(spark, d).join(b.read(spark, d, "events").select(F.col("event_id").alias("asset_id"), "props"), "asset_id")
    v = a.filter("live_photo is not null and status <> 'missing'").groupBy(F.col("live_photo").alias("photo")).agg(F.min("asset_id").alias("live_video"))
    return a.join(v, a.asset_id == v.photo, "left").select("asset_id", "library_id", "rel_path", "media_type", "status", "size", "duration", "taken_at", "gps_lat", "gps_lon", "place", "live_video", F.get_json_object("props", "$.k").alias("source"))


@query("c10_live_status", f"""WITH {A}, p AS (SELECT asset_id AS video, max(image) AS image FROM (SELECT v.asset_id, i.asset_id AS image FROM assets v JOIN assets i ON v.library_id = i.library_id AND v.asset_id // 10 = i.asset_id // 10 WHERE v.media_type = 'video' AND v.duration <= 5 AND i.media_type = 'image') GROUP BY 1)
    SELECT asset_id, image AS live_photo, image IS DISTINCT FROM live_photo AS changed FROM assets LEFT JOIN p ON video = asset_id WHERE media_type = 'video'""")
def c10(spark, d):
    a = b.assets(spark, d).withColumn("rel_path", F.expr("concat('d/', asset_id div 10, '.x')"))
    pairs = c.pair_live(a.filter("media_type = 'video'"), a.filter("media_type = 'image'"), order="asset_id")
    return c.live_status(a.filter("media_type = 'video'"), pairs)


@query("c11_reuse_segments", f"""WITH {H}, {PROFILED}, h AS (SELECT * FROM hashed WHERE asset_id IN (SELECT asset_id FROM profiled)), p AS (SELECT p.asset_id, min(q.asset_id) AS donor FROM hashed p JOIN h q USING (content_hash) WHERE p.status = 'pending' AND q.status = 'indexed' GROUP BY 1)
    SELECT p.asset_id, donor, profile_key, modality, segment_index, vec_id FROM p JOIN profiled v ON v.asset_id = donor""")
def c11(spark, d):
    h = b.hashed_assets(spark, d)
    return c.reuse_segments(h.filter("status = 'pending'"), profiled(spark, d).drop("vector"), h.filter("status = 'indexed'"))


STATE = f"""v AS (SELECT asset_id, bool_or(profile_key = 'current') AS own, bool_or(profile_key <> 'current') AS other FROM profiled GROUP BY 1), s AS (SELECT library_id, count(*) AS total, count(*) FILTER (own AND status = 'indexed') AS searchable,
    count(*) FILTER (other) AS other_profile_vectors, count(*) FILTER (status NOT IN ('failed', 'missing')) AS wanted FROM assets LEFT JOIN v USING (asset_id) GROUP BY library_id),
    state AS (SELECT library_id, total, searchable, other_profile_vectors, CASE WHEN searchable = 0 AND other_profile_vectors > 0 THEN 'incompatible' WHEN searchable = 0 THEN 'not_indexed' WHEN searchable < wanted THEN 'partial' ELSE 'ready' END AS state FROM s)"""


@query("d9_index_states", f"WITH {A}, {PROFILED}, {STATE} SELECT * FROM state")
def d9(spark, d):
    return c.index_state(b.assets(spark, d), profiled(spark, d), "current")


@query("d11_import_lists", f"""WITH {H}, {SCAN}, o AS (SELECT rel_path, CASE WHEN asset_id IS NULL THEN 'new' WHEN now IS NULL THEN 'missing' WHEN content_hash <> now THEN 'changed' WHEN status = 'missing' THEN 'returned' ELSE 'unchanged' END AS outcome FROM e FULL JOIN s USING (rel_path))
    SELECT outcome, split_part(rel_path, '/', 1) AS folder, list_sort(list(rel_path)) AS files FROM o WHERE outcome IN ('missing', 'changed') GROUP BY 1, 2""")
def d11(spark, d):
    """The files of what needs a look, by folder."""
    o = c.import_diff(*scan(spark, d)).filter("outcome in ('missing', 'changed')")
    return o.groupBy("outcome", F.split_part("rel_path", F.lit("/"), F.lit(1)).alias("folder")).agg(F.array_sort(F.collect_list("rel_path")).alias("files"))


@query("k1_vectors_after_import", f"WITH {H}, {SCAN}, {PROFILED} SELECT asset_id, vec_id FROM profiled WHERE asset_id NOT IN (SELECT asset_id FROM e JOIN s USING (rel_path) WHERE content_hash <> now)")
def k1(spark, d):
    return c.drop_changed_vectors(profiled(spark, d).select("asset_id", "vec_id"), *scan(spark, d))


@query("k2_detection_runs", f"WITH {B}, {R} SELECT content_hash, 'detector-1' AS detector, 0 AS boxes FROM runs WHERE content_hash NOT IN (SELECT content_hash FROM boxes) UNION ALL SELECT content_hash, 'detector-1', count(*) FROM boxes WHERE content_hash IN (SELECT content_hash FROM runs) GROUP BY 1")
def k2(spark, d):
    """A run is recorded also where it found nothing."""
    n = b.boxes(spark, d).groupBy("content_hash").agg(F.count(F.lit(1)).alias("boxes"))
    return b.detection_runs(spark, d).join(n, "content_hash", "left").select("content_hash", "detector", F.coalesce("boxes", F.lit(0)).cast("long").alias("boxes"))


@query("k8_marks_with_reason", f"WITH {A} SELECT asset_id, CASE WHEN asset_id % 41 = 0 THEN 'missing' WHEN asset_id % 43 = 0 THEN 'indexed' ELSE status END AS status, CASE WHEN asset_id % 41 = 0 THEN 'file not found' END AS reason FROM assets")
def k8(spark, d):
    a = b.assets(spark, d).select("asset_id", "status")
    marks = a.filter("asset_id % 41 = 0 or asset_id % 43 = 0").selectExpr("asset_id", "if(asset_id % 41 = 0, 'missing', 'indexed') as new_status", "if(asset_id % 41 = 0, 'file not found', 'read again') as reason")
    return c.mark_status(a, marks)


@query("a12_manifest_pairs", f"""WITH {I} SELECT selection_id, asset_id, position, [CAST(floor(bytes % 4000) AS BIGINT), 1080] AS dims, CASE WHEN position % 2 = 0 THEN [position * 1.0, position + 2.5] END AS segment FROM items""")
def a12(spark, d):
    items = b.selection_items(spark, d).selectExpr("*", "cast(floor(bytes % 4000) as bigint) as width", "cast(1080 as bigint) as height", "if(position % 2 = 0, cast(position as double), null) as start_s", "if(position % 2 = 0, position + 2.5D, null) as end_s")
    return sel.manifest(items).select("selection_id", F.explode("items").alias("i")).select("selection_id", "i.asset_id", "i.position", "i.dims", "i.segment")


@query("b14_export_rows", f"""WITH {I} SELECT selection_id, asset_id, CASE WHEN state <> 'F' THEN 'skipped: not there' WHEN position % 2 = 0 AND asset_id % 3 = 0 THEN 'skipped: part of a sound' WHEN position % 2 = 0 AND asset_id % 3 = 1 THEN 'clip' WHEN position % 2 = 0 THEN 'skipped: part of a picture' ELSE 'file' END AS row FROM items""")
def b14(spark, d):
    items = b.selection_items(spark, d).selectExpr("*", "case asset_id % 3 when 0 then 'audio' when 1 then 'video' else 'image' end as media_type", "if(position % 2 = 0, cast(position as double), null) as start_s", "if(state = 'F', 'ok', 'missing') as status")
    return sel.export_rows(items).select("selection_id", "asset_id", "row")


@query("f6_listing_page", f"WITH {A} SELECT asset_id FROM assets WHERE {VISIBLE} AND place = 'Town3, Region3, Country1' ORDER BY taken_at NULLS LAST, rel_path LIMIT 2000")
def f6(spark, d):
    return c.scope(b.assets(spark, d), when=c.MediaFilter(places=["Town3, Region3, Country1"])).orderBy(F.asc_nulls_last("taken_at"), "rel_path").limit(max(1, min(5000, 2000))).select("asset_id")


@query("k5_cascade_rows", f"WITH {A} SELECT library_id, count(*) AS assets, count(vec_id) AS vectors FROM assets LEFT JOIN embeddings ON vec_id = asset_id WHERE library_id <> 2 GROUP BY 1")
def k5(spark, d):
    left, v = c.cascade_delete(2, b.assets(spark, d), b.vectors(spark, d).select("asset_id"))
    return left.join(v.withColumn("v", F.lit(1)), "asset_id", "left").groupBy("library_id").agg(F.count(F.lit(1)).alias("assets"), F.count("v").alias("vectors"))


@query("k6_rekey_by_space", """WITH v AS (SELECT vec_id // 4 AS asset_id, vec_id % 4 AS k, vec_id % 3 AS segment_index, vec_id FROM embeddings), t AS (SELECT *, concat('p', k % 2) AS target, concat('p', k) AS profile_key FROM v),
    r AS (SELECT *, row_number() OVER (PARTITION BY asset_id, segment_index, target ORDER BY profile_key <> target, vec_id) AS rn FROM t) SELECT asset_id, target AS profile_key, segment_index, vec_id FROM r WHERE rn = 1""")
def k6(spark, d):
    """Four profiles, of which two and two name the same space."""
    v = b.read(spark, d, "embeddings").selectExpr("vec_id div 4 as asset_id", "'image' as modality", "vec_id % 3 as segment_index", "concat('p', vec_id % 4) as profile_key", "vec_id")
    profiles = v.select("profile_key").distinct().withColumn("space", F.expr("cast(substring(profile_key, 2) as int) % 2"))
    return c.rekey(v, profiles).select("asset_id", "profile_key", "segment_index", "vec_id")


POLLS = "polls AS (SELECT library_id, 2 * day + k AS poll, signature FROM (SELECT library_id, dayofmonth(taken_at) AS day, concat(count(*), ':', sum(size), ':', CAST(round(epoch(max(taken_at))) AS BIGINT)) AS signature FROM assets WHERE taken_at IS NOT NULL GROUP BY 1, 2), (SELECT unnest([0, 1]) AS k))"


@query("e15_settled_signatures", f"WITH {A}, {POLLS}, r AS (SELECT *, lag(signature) OVER w AS before, first_value(signature) OVER w AS base FROM polls WINDOW w AS (PARTITION BY library_id ORDER BY poll)) SELECT library_id, poll FROM r WHERE signature <> base AND signature = before")
def e15(spark, d):
    """Each day's files are polled twice; a signature has their number, bytes and last change."""
    last = F.floor(F.unix_micros(F.max("taken_at").cast("timestamp")) / 1e6 + 0.5).cast("long")
    day = b.assets(spark, d).filter("taken_at is not null").groupBy("library_id", F.dayofmonth("taken_at").cast("long").alias("day")).agg(F.concat_ws(":", F.count(F.lit(1)), F.sum("size"), last).alias("signature"))
    return c.settled_changes(day.select("library_id", F.explode(F.array(F.col("day") * 2, F.col("day") * 2 + 1)).alias("poll"), "signature"))


@query("l9_place_tree", f"WITH {A}, l AS (SELECT unnest([place, regexp_replace(place, '^[^,]*, ', ''), regexp_replace(place, '^[^,]*, [^,]*, ', '')]) AS level, gps_lat, gps_lon FROM assets WHERE place IS NOT NULL) SELECT level, count(*) AS n, round(avg(gps_lat), 4) AS lat, round(avg(gps_lon), 4) AS lon FROM l GROUP BY 1")
def l9(spark, d):
    """Every level of every place, with its number of files and its middle."""
    each = b.assets(spark, d).filter("place is not null").select(F.explode(pl.suffixes(F.col("place"))).alias("level"), "gps_lat", "gps_lon")
    return each.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gps_lat"), 4).alias("lat"), F.round(F.avg("gps_lon"), 4).alias("lon"))


# Sources and sinks, over files that are written from the tables.


@query("a1_scan_media_files", "SELECT DISTINCT event_type AS folder, 'image' AS media_type, 'jpg' AS ext FROM events")
def a1(spark, d):
    root = shared_path(spark, "files")
    b.read(spark, d, "events").select("event_type", F.col("event_id").cast("string")).write.option("extension", "jpg").partitionBy("event_type").csv(root)
    files = media.scan_media_files(spark, root)
    return files.select(F.regexp_extract("rel_path", "event_type=([^/]+)/", 1).alias("folder"), "media_type", "ext").distinct()


#: One file a supplier: names in either case, hidden ones, files in a hidden folder, files of no media type.
MIXED = """concat('n', s_nationkey, '/', CASE s_suppkey % 7 WHEN 0 THEN concat('.s', s_suppkey, '.jpg') WHEN 1 THEN concat('s', s_suppkey, '.JPG')
 WHEN 2 THEN concat('.trash/s', s_suppkey, '.png') WHEN 3 THEN concat('s', s_suppkey, '.txt') WHEN 4 THEN concat('s.', s_suppkey, '.Mp4')
 WHEN 5 THEN concat('deep/er/s', s_suppkey, '.flac') ELSE concat('s', s_suppkey) END)"""
FILLED = "concat(s_name, repeat('x', CAST(s_suppkey % 50 AS INT)))"


@query("a1_scan_mixed_files", f"""WITH listed AS (SELECT {MIXED} AS rel_path, CAST(strlen({FILLED}) AS BIGINT) AS size FROM supplier),
kinds AS (SELECT *, lower(regexp_extract(rel_path, '\\.([^./]+)$', 1)) AS ext FROM listed WHERE NOT regexp_matches(rel_path, '(^|/)\\.'))
SELECT rel_path, ext, CASE ext WHEN 'jpg' THEN 'image' WHEN 'mp4' THEN 'video' ELSE 'audio' END AS media_type, size FROM kinds WHERE ext IN ('jpg', 'mp4', 'flac')""")
def a1_mixed(spark, d):
    """A listing of files of many kinds, with their sizes."""
    root = write_files(b.read(spark, d, "supplier"), shared_path(spark, "mixed"), F.expr(MIXED), F.expr(FILLED))
    return media.scan_media_files(spark, root).select("rel_path", "ext", "media_type", "size")


@query("a4_read_gazetteer", f"WITH {b.TOWNS} SELECT name, region, country, round(lat, 6) AS lat, lon, CAST(population AS DOUBLE) AS population FROM towns")
def a4(spark, d):
    path = shared_path(spark, "gazetteer")
    media.write_gazetteer(b.towns(spark, d), path)
    return media.read_gazetteer(spark, path).withColumn("lat", F.round("lat", 6))


@query("a6_read_provenance", "SELECT concat('s', s_suppkey, '.jpg') AS rel_path, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'CC0' ELSE concat('L', s_nationkey) END AS licence FROM supplier")
def a6(spark, d):
    """One sidecar a nation."""
    path = shared_path(spark, "provenance")
    record = F.struct(F.col("s_name").alias("title"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("url"), F.expr("if(s_suppkey % 2 = 0, 'CC0', null)").alias("licence"))
    side = b.read(spark, d, "supplier").groupBy("s_nationkey").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("s"), "s_suppkey", F.lit(".jpg")).alias("k"), record.alias("v")))).alias("items"))
    rows = side.select("s_nationkey", F.to_json(F.struct(F.concat(F.lit("L"), "s_nationkey").alias("licence"), "items")).alias("value"))
    rows.repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    return media.read_provenance(spark, path).select("rel_path", "title", "licence")


@query("a11_write_embeddings", f"WITH {PROFILED} SELECT asset_id, profile_key, count(*) AS n, max(segment_index) AS last FROM (SELECT asset_id, profile_key, row_number() OVER (PARTITION BY asset_id, profile_key ORDER BY segment_index) - 1 AS segment_index FROM profiled WHERE asset_id % 5 <> 0) GROUP BY 1, 2")
def a11(spark, d):
    """A first snapshot, then one that replaces some keys; of every fifth asset a vector is broken, so that it is left out."""
    rows = profiled(spark, d).drop("vec_id").withColumn("vector", F.expr("if(asset_id % 5 = 0 and segment_index = 0, transform(vector, x -> cast('NaN' as float)), vector)"))
    columns = [F.col("asset_id"), F.col("profile_key"), F.col("modality"), F.col("segment_index"), F.col("vector").cast("array<double>").alias("vector")]
    store = media.embedding_store(spark, shared_path(spark, "embeddings"), 16)
    media.merge_embeddings(store, rows.filter("asset_id % 2 = 0").select(*columns), 64)
    media.merge_embeddings(store, rows.filter("asset_id % 4 <> 1 or asset_id % 2 = 1").select(*columns), 64)
    bad = rows.filter("asset_id % 5 = 0").select("asset_id").distinct()  # assets without a second segment have no broken one
    return store.read().join(bad, "asset_id", "left_anti").groupBy("asset_id", "profile_key").agg(F.count(F.lit(1)).alias("n"), F.max("segment_index").cast("long").alias("last"))


@query("a13_append_run", f"WITH {b.JUDGED} SELECT query, CASE WHEN rank <= 5 THEN 'first' ELSE 'second' END AS run, list(candidate ORDER BY rank) AS ranked FROM judged WHERE rank <= 9 GROUP BY 1, 2")
def a13(spark, d):
    j = b.judged(spark, d)
    runs = [(name, j.filter(which).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate"))).alias("r"))) for name, which in (("first", "rank <= 5"), ("second", "rank between 6 and 9"))]
    parts = [rows.select("query", F.lit(name).alias("run"), F.transform("r", lambda x: x["candidate"]).alias("ranked")) for name, rows in runs]
    return parts[0].unionByName(parts[1])


#: 63 numbers of a vector as 3 rows of 7 pixels of blue, green and red.
PIXELS = "pixels AS (SELECT vec_id AS photo, list_transform(embedding[1:63], lambda x: greatest(0, least(255, CAST(floor((CAST(x AS DOUBLE) * 3 + 0.5) * 255) AS INTEGER)))) AS px FROM embeddings)"


def pictures(spark, d):
    byte = lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") * 3 + 0.5) * 255).cast("int")))), 2, "0")
    data = F.unhex(F.array_join(F.transform(F.slice("embedding", 1, 63), byte), ""))
    return b.read(spark, d, "embeddings").select(F.col("vec_id").alias("photo"), data.alias("data"), F.lit(7).alias("width"), F.lit(3).alias("height"), F.lit(3).alias("channels"))


GREY = "list_transform(range(0, 21), lambda i: 0.114 * px[3 * i + 1] + 0.587 * px[3 * i + 2] + 0.299 * px[3 * i + 3])"


@query("h31_sharpness", f"WITH {PIXELS}, g AS (SELECT photo, {GREY} AS g FROM pixels) SELECT photo, round(list_aggregate(list_transform(range(9, 14), lambda i: g[i - 7] + g[i + 7] + g[i - 1] + g[i + 1] - 4 * g[i]), 'var_pop'), 2) AS sharpness FROM g")
def h31(spark, d):
    return pictures(spark, d).select("photo", F.round(pixels.sharpness("data", "width", "height", "channels"), 2).alias("sharpness"))


def decoded(spark, d):
    """The pictures as bitmap files, read back by Spark's image source."""
    files = pictures(spark, d).select("photo", pixels.bmp("data", "width", "height").alias("content"))
    root = write_files(files, shared_path(spark, "bitmaps"), F.concat(F.col("photo") % 256, F.lit("/"), "photo", F.lit(".bmp")), F.col("content"))
    return media.read_decoded_images(spark, root).withColumn("photo", F.regexp_extract("origin", r"(\d+)\.bmp$", 1).cast("long"))


@query("a14_decoded_images", f"WITH {PIXELS} SELECT photo, 7 AS width, 3 AS height, 3 AS channels, list_sum(px) AS total, list_sum(list_transform(range(1, 64), lambda i: i * px[i])) AS placed FROM pixels")
def a14(spark, d):
    """Sizes and pixels of decoded files: the sum of all bytes, and that of bytes times places."""
    byte = lambda i: F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("long")
    values = decoded(spark, d).withColumn("px", F.transform(F.sequence(F.lit(1), F.length("data")), byte))
    total = F.aggregate("px", F.lit(0).cast("long"), lambda n, x: n + x)
    placed = F.aggregate(F.transform("px", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda n, x: n + x)
    return values.select("photo", "width", "height", F.col("nChannels").alias("channels"), total.alias("total"), placed.alias("placed"))


@query("a15_synthetic_vectors", "SELECT row_number() OVER () - 1 AS asset_id, 64 AS dim, CAST(1 AS DOUBLE) AS norm FROM embeddings")
def a15(spark, d):
    """As many made vectors as there are given ones."""
    made = media.synthetic_vectors(spark, b.read(spark, d, "embeddings").count(), 64, 7)
    return made.select("asset_id", F.size("vector").alias("dim"), F.round(l2_norm("vector"), 4).alias("norm"))


@query("h31_sharpness_of_files", f"WITH {PIXELS}, g AS (SELECT photo, {GREY} AS g FROM pixels) SELECT photo, round(list_aggregate(list_transform(range(9, 14), lambda i: g[i - 7] + g[i + 7] + g[i - 1] + g[i + 1] - 4 * g[i]), 'var_pop'), 2) AS sharpness FROM g")
def h31_files(spark, d):
    return decoded(spark, d).select("photo", F.round(pixels.sharpness("data", "width", "height", "nChannels"), 2).alias("sharpness"))


def pale_sql(a: int, z: int) -> str:
    hit = "list_max([px[3 * i + 1], px[3 * i + 2], px[3 * i + 3]])"
    low = "list_min([px[3 * i + 1], px[3 * i + 2], px[3 * i + 3]])"
    return f"len(list_filter([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20], lambda i: i % 7 >= {a} AND i % 7 < {z} AND {hit} BETWEEN 70 AND 190 AND ({hit} - {low}) / {hit} * 255 < 40)) / {3 * (z - a)}.0"


@query("h32_colour_share", f"WITH {PIXELS}, w AS (SELECT photo, greatest({pale_sql(0, 7)}, {pale_sql(0, 3)}) AS share FROM pixels) SELECT photo, round(share, 6) AS share, CASE WHEN share >= 0.1 THEN 'sure' WHEN share >= 0.04 THEN 'maybe' END AS band FROM w")
def h32(spark, d):
    """The greyer of two boxes of a picture: all of it, or its left columns."""
    boxes = F.array(*[F.array(*map(F.lit, box)) for box in ((0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 3 / 7, 1.0))])
    share = pixels.best_box_share("gray")("data", "width", "height", "channels", boxes)
    return pictures(spark, d).select("photo", share.alias("x")).select("photo", F.round("x", 6).alias("share"), pixels.band(F.col("x")).alias("band"))


@query("i2_incremental_import", f"WITH {H}, {SCAN} SELECT rel_path, coalesce(asset_id, new_id) AS asset_id, coalesce(now, content_hash) AS content_hash, 'pending' AS status FROM e FULL JOIN s USING (rel_path)")
def i2(spark, d):
    """Two listings as a stream of files, merged one after the other."""
    old, new = scan(spark, d)
    root, catalog, mark = (shared_path(spark, n) for n in ("listing", "catalog", "marks"))
    for k, rows in enumerate((old.withColumn("new_id", F.col("asset_id")), new)):
        rows.select("rel_path", "content_hash", F.col("size").cast("long"), F.col("new_id").cast("long"), F.lit(k).cast("long").alias("seq")).write.mode("append").json(root)
        watch.incremental_import(spark, root, catalog, mark, "rel_path string, content_hash string, size long, new_id long, seq long").awaitTermination()
    return watch.latest_snapshot(spark, catalog).select("rel_path", "asset_id", "content_hash", "status")


@query("j2_hash_embedder", "SELECT count(*) AS texts, count(DISTINCT text) AS vectors FROM documents WHERE text IS NOT NULL")
def j2(spark, d):
    """Equal texts have equal vectors, others do not."""
    docs = b.read(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    return s.encode(docs, s.hash_encoder, "text", "doc_id").agg(F.count(F.lit(1)).alias("texts"), F.count_distinct(F.xxhash64("vector")).alias("vectors"))


def length_detector():
    """A stand-in detector: a box whose score and width come from the number of bytes."""
    def fn(data):
        n = len(data)
        if n % 50 == 0:
            raise ValueError("broken")
        return [("long" if n > 1000 else "short", (n % 100) / 100, (0.0, 0.0, 0.5, 0.5))]

    return fn


@query("j3_detect", "SELECT content_hash, CASE WHEN n % 50 <> 0 THEN CASE WHEN n > 1000 THEN 'long' ELSE 'short' END END AS label, CASE WHEN n % 50 <> 0 THEN n % 100 / 100 END AS score, CASE WHEN n % 50 = 0 THEN 'ValueError: broken' END AS error FROM (SELECT DISTINCT sha256(text) AS content_hash, strlen(text) AS n FROM documents)")
def j3(spark, d):
    photos = b.read(spark, d, "documents").select(F.sha2("text", 256).alias("content_hash"), F.col("text").cast("binary").alias("content"))
    return media.detect(photos, length_detector).select("content_hash", "label", "score", "error")


# Evaluation.


@query("d17_variant", f"""WITH {b.JUDGED}, v AS (SELECT query, candidate, grade, row_number() OVER (PARTITION BY query ORDER BY rank DESC) AS rank FROM judged), t AS (SELECT query, bool_and(grade IS NOT NULL) AS whole, count(*) FILTER (grade IS NULL) AS unlabelled, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM v WHERE rank <= 10 GROUP BY query),
    i AS (SELECT query, sum((pow(2, grade) - 1) / log2(n + 1)) AS idcg FROM (SELECT query, grade, row_number() OVER (PARTITION BY query ORDER BY grade DESC, candidate) AS n FROM judged WHERE grade IS NOT NULL) WHERE n <= 10 GROUP BY query)
    SELECT query, unlabelled, CASE WHEN whole AND idcg > 0 THEN round(dcg / idcg, 6) END AS ndcg FROM t LEFT JOIN i USING (query)""")
def d17(spark, d):
    """Another order of the same candidates: nDCG only where its own first ten are all judged, against the best of what is judged."""
    j = b.judged(spark, d)
    v = j.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rank")))).filter("rank <= 10")
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    t = v.groupBy("query").agg(F.bool_and(F.col("grade").isNotNull()).alias("whole"), F.count_if(F.col("grade").isNull()).alias("unlabelled"), F.sum(gain).alias("dcg"))
    best = j.filter("grade is not null").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "candidate"))).filter("rank <= 10").groupBy("query").agg(F.sum(gain).alias("idcg"))
    return t.join(best, "query", "left").select("query", "unlabelled", F.when(F.col("whole") & (F.col("idcg") > 0), F.round(F.col("dcg") / F.col("idcg"), 6)).alias("ndcg"))


TOP = """sized AS (SELECT *, greatest(0, CAST(round(x1 * 10000) AS BIGINT) - CAST(round(x0 * 10000) AS BIGINT)) * greatest(0, CAST(round(y1 * 10000) AS BIGINT) - CAST(round(y0 * 10000) AS BIGINT)) / 1e8 AS area FROM boxes),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY content_hash, label ORDER BY score DESC, box_no, area DESC) AS rn FROM sized), top AS (SELECT content_hash, label, score, area FROM ordered WHERE rn = 1), opinion AS (SELECT *, CASE WHEN content_hash % 5 < 3 THEN content_hash % 5 < 2 END AS second, content_hash % 3 <> 0 AS truth FROM top)"""
RULES = [("score >= 0.5", "score >= 0.5"), ("score >= 0.75", "score >= 0.75"), ("second opinion says yes", "score >= 0.5 AND second IS TRUE"), ("sure, or second opinion says yes", "score >= 0.75 OR (score >= 0.5 AND second IS TRUE)"),
         ("second opinion removes boxes of 2 %", "score >= 0.5 AND NOT (second IS FALSE AND area >= 0.02)"), ("second opinion removes boxes of 5 %", "score >= 0.5 AND NOT (second IS FALSE AND area >= 0.05)")]


def opinions(spark, d):
    """The best box of each photo and label, what a second look says (null: not asked), and the truth."""
    box = F.struct("score", (-F.col("box_no")).alias("b"), (det.exact_area() / 1e8).alias("area"))
    top = b.boxes(spark, d).groupBy("content_hash", "label").agg(F.max(box).alias("m")).select("content_hash", "label", "m.score", "m.area")
    return top.selectExpr("*", "if(content_hash % 5 < 3, content_hash % 5 < 2, null) as second", "content_hash % 3 <> 0 as truth")


@query("d21_rules", f"WITH {B}, {TOP} " + " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) FILTER (truth AND ({rule})) AS tp, count(*) FILTER (NOT truth AND ({rule})) AS fp, count(*) FILTER (truth AND NOT ({rule})) AS fn FROM opinion" for name, rule in RULES))
def d21(spark, d):
    o = opinions(spark, d)
    each = o.select("truth", F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.expr(rule).alias("said")) for name, rule in RULES])).alias("r")).select("truth", "r.*")
    return each.groupBy("rule").agg(F.count_if(F.col("truth") & F.col("said")).alias("tp"), F.count_if(~F.col("truth") & F.col("said")).alias("fp"), F.count_if(F.col("truth") & ~F.col("said")).alias("fn"))


BUCKETS = "CASE WHEN area < 0.005 THEN 0.0 WHEN area < 0.02 THEN 0.005 WHEN area < 0.05 THEN 0.02 ELSE 0.05 END"


@query("d21_by_size", f"WITH {B}, {TOP} SELECT CAST({BUCKETS} AS DOUBLE) AS least_area, count(*) AS noes, avg(CAST(NOT truth AS INTEGER)) AS correct FROM opinion WHERE score >= 0.5 AND second IS FALSE GROUP BY 1")
def d21b(spark, d):
    return opinions(spark, d).filter("score >= 0.5 and second is false").groupBy(F.expr(BUCKETS).cast("double").alias("least_area")).agg(F.count(F.lit(1)).alias("noes"), F.avg((~F.col("truth")).cast("int")).alias("correct"))


@query("d25_edit_rates", f"""WITH {B}, g AS (SELECT *, box_no % 3 <> 0 AS edited, score >= 0.5 AS good, greatest(0, CAST(round(x1 * 10000) AS BIGINT) - CAST(round(x0 * 10000) AS BIGINT)) AS width FROM boxes)
    SELECT label, round(avg(CAST(edited AS INTEGER)), 6) AS rate, round(sum(width) FILTER (edited) / sum(width), 6) AS share, round(avg(CAST(good AS INTEGER)) FILTER (edited), 6) AS good_if_edited FROM g GROUP BY label""")
def d25(spark, d):
    """The share of edits that were made, their share of all that was to be edited (a ratio of sums), and how many of those made are good."""
    width = F.greatest(F.lit(0), F.round(F.col("x1") * 10000).cast("long") - F.round(F.col("x0") * 10000).cast("long"))
    g = b.boxes(spark, d).withColumn("edited", F.expr("box_no % 3 <> 0")).withColumn("width", width)
    made = F.col("edited")
    return g.groupBy("label").agg(F.round(F.avg(made.cast("int")), 6).alias("rate"), F.round(F.sum(F.when(made, F.col("width"))) / F.sum("width"), 6).alias("share"), F.round(F.avg(F.when(made, (F.col("score") >= det.KEEP).cast("int"))), 6).alias("good_if_edited"))


@query("d23_topk_overlap", f"""WITH {V}, p AS (SELECT a.asset_id AS q, v.asset_id, list_dot_product(a.vector, v.vector) AS x, list_dot_product(a.vector[1:32], v.vector[1:32]) / sqrt(list_dot_product(v.vector[1:32], v.vector[1:32])) AS y FROM vectors a, vectors v WHERE a.asset_id % 100 = 0),
    r AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY x DESC, asset_id) AS rx, row_number() OVER (PARTITION BY q ORDER BY y DESC, asset_id) AS ry FROM p) SELECT round(avg(n) / 10, 6) AS mean_overlap FROM (SELECT q, count(*) FILTER (rx <= 10 AND ry <= 10) AS n FROM r GROUP BY q)""")
def d23(spark, d):
    v = b.vectors(spark, d)
    small = v.withColumn("vector", truncate_dim("vector", 32))
    tops = [s.batch_topk(x.filter("asset_id % 100 = 0").withColumnRenamed("asset_id", "query_id"), x, 10).select("query_id", "asset_id") for x in (v, small)]
    both = tops[0].join(tops[1].hint("merge"), ["query_id", "asset_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    asked = v.filter("asset_id % 100 = 0").select(F.col("asset_id").alias("query_id"))
    return asked.join(both.hint("merge"), "query_id", "left").agg(F.round(F.avg(F.coalesce("n", F.lit(0))) / 10, 6).alias("mean_overlap"))


@query("d24_expected_cases", f"WITH {b.JUDGED}, x AS (SELECT query, list(candidate) AS wanted FROM judged WHERE grade > 0 GROUP BY query), e AS (SELECT query, unnest(wanted) AS candidate FROM x), r AS (SELECT query, min(rank) AS best FROM e JOIN judged USING (query, candidate) WHERE rank <= 50 GROUP BY query) SELECT count(*) AS cases, count(*) FILTER (best = 1) AS hit1, count(*) FILTER (best <= 10) AS hit10 FROM x LEFT JOIN r USING (query)")
def d24(spark, d):
    """Cases list what they expect; the best place of any of it counts."""
    j = b.judged(spark, d)
    cases = staged(j.filter("grade > 0").groupBy("query").agg(F.collect_list("candidate").alias("wanted")))
    places = j.filter("rank <= 50").join(cases.select("query", F.explode("wanted").alias("candidate")).hint("merge"), ["query", "candidate"], "left_semi")
    best = cases.join(places.groupBy("query").agg(F.min("rank").alias("best")), "query", "left")
    return best.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("best") == 1).alias("hit1"), F.count_if(F.col("best") <= 10).alias("hit10"))


# Conversations about photos: orders as turns of their customers.

TALK = """talk AS (SELECT o_custkey AS conv_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS turn, CASE WHEN o_orderkey % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey % 4 END AS shown,
    CASE WHEN o_orderkey % 2 = 0 THEN CASE o_orderkey % 5 WHEN 0 THEN 'remove the car from photo 2' WHEN 1 THEN 'try again, there is a gap' WHEN 2 THEN 'yes, go ahead' WHEN 3 THEN 'put a bus instead' ELSE 'show me dogs' END ELSE 'here you are' END AS text FROM orders)"""


def talk(spark, d):
    return b.read(spark, d, "orders").selectExpr("o_custkey as conv_id", "row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as turn", "if(o_orderkey % 2 = 0, 'user', 'assistant') as role", "if(o_orderkey % 2 = 1, o_orderkey % 4, null) as shown",
                                                 "if(o_orderkey % 2 = 0, case o_orderkey % 5 when 0 then 'remove the car from photo 2' when 1 then 'try again, there is a gap' when 2 then 'yes, go ahead' when 3 then 'put a bus instead' else 'show me dogs' end, 'here you are') as text")


@query("e17_photos_shown", f"WITH {TALK} SELECT conv_id, turn, last_value(CASE WHEN shown > 0 THEN turn END IGNORE NULLS) OVER w AS photos, last_value(CASE WHEN shown > 1 THEN turn END IGNORE NULLS) OVER w AS lists, last_value(CASE WHEN text LIKE 'remove%' THEN turn END IGNORE NULLS) OVER w AS edit FROM talk WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def e17(spark, d):
    """The last earlier answer with photos, with several, and the last earlier request for an edit."""
    from ..functions.textmine import classify_intent

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    edit = (F.col("role") == "user") & (classify_intent(F.col("text"), F.lit(True)) == "edit")
    last = lambda when, name: F.last(F.when(when, F.col("turn")), ignorenulls=True).over(w).alias(name)
    return talk(spark, d).select("conv_id", "turn", last(F.col("shown") > 0, "photos"), last(F.col("shown") > 1, "lists"), last(edit, "edit"))


FOLLOW = "CASE WHEN text LIKE 'yes%' THEN 'confirm' WHEN text LIKE 'put a%' THEN 'redo' WHEN text LIKE 'try again%' THEN 'retry' END"


@query("e18_follow_ups", f"""WITH {TALK}, g AS (SELECT *, sum(CAST(text LIKE 'remove%' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM talk), u AS (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id, grp ORDER BY turn) AS users FROM g WHERE grp > 0)
    SELECT conv_id, turn, {FOLLOW} AS kind, users - 1 AS number FROM u WHERE role = 'user' AND {FOLLOW} IS NOT NULL""")
def e18(spark, d):
    """What a message after an edit asks for, and how many messages of the user came since."""
    from ..functions.textmine import classify_intent, follow_up

    w = Window.partitionBy("conv_id").orderBy("turn")
    edit = (F.col("role") == "user") & (classify_intent(F.col("text"), F.lit(True)) == "edit")
    g = talk(spark, d).withColumn("grp", F.sum(edit.cast("int")).over(w)).filter("grp > 0")
    users = F.count_if(F.col("role") == "user").over(Window.partitionBy("conv_id", "grp").orderBy("turn"))
    return g.withColumn("number", users - 1).filter("role = 'user'").select("conv_id", "turn", follow_up(F.col("text")).alias("kind"), "number").filter("kind is not null")


# Whole searches.

WHEN = "taken_at >= TIMESTAMP '2024-01-01' AND taken_at < TIMESTAMP '2024-01-20'"


@query("l1_search_grouped", f"""WITH {V}, {S}, {A}, {Q0}, {B}, {R}, ok AS (SELECT asset_id FROM assets WHERE {VISIBLE} AND {WHEN}), h AS (SELECT asset_id, max(list_dot_product(vector, qv)) AS x FROM segments JOIN ok USING (asset_id), q GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY x DESC, asset_id) AS rank FROM h ORDER BY x DESC, asset_id LIMIT 200),
    f AS (SELECT DISTINCT content_hash AS asset_id FROM boxes WHERE label = 'A' AND score >= 0.75), m AS (SELECT t.*, CASE WHEN f.asset_id IS NOT NULL THEN 'found' WHEN r.content_hash IS NOT NULL THEN 'not found' ELSE 'not checked' END AS object_check FROM t LEFT JOIN f USING (asset_id) LEFT JOIN runs r ON r.content_hash = t.asset_id),
    g AS (SELECT count(*) - count(taken_at) AS undated FROM assets WHERE {VISIBLE}) SELECT asset_id, round(x, 5) AS similarity, object_check, undated, row_number() OVER (ORDER BY object_check <> 'found', rank) AS rank FROM m, g ORDER BY object_check <> 'found', rank LIMIT 20""")
def l1(spark, d):
    """Date filter, its gaps, windows grouped by photo, ranks, photos of the object first."""
    a, v = b.assets(spark, d), b.vectors(spark, d)
    found = b.boxes(spark, d).filter(f"label = 'A' and score >= {det.SURE}").select(F.col("content_hash").alias("asset_id"))
    checked = b.detection_runs(spark, d).select(F.col("content_hash").alias("asset_id"))
    results = s.search_grouped(a, b.segments(spark, d), query_vector(v), c.MediaFilter(ranges=[("2024-01-01", "2024-01-20")]), 20, found, checked)
    return results.crossJoin(F.broadcast(c.filter_gaps(c.scope(a), True, False).select("undated"))).select("asset_id", F.round("similarity", 5).alias("similarity"), "object_check", "undated", "rank")  # one row


#: Windows of files under two profiles; those of videos have one of three signals.
SIGNALS = f"{S}, signals AS (SELECT s.embedding_id, s.asset_id, start_s, end_s, vector, CASE WHEN embedding_id % 11 = 0 THEN 'old' ELSE 'current' END AS profile_key, CASE media_type WHEN 'video' THEN CASE segment_index % 3 WHEN 0 THEN 'video-visual' WHEN 1 THEN 'video-audio' ELSE 'video-joint' END ELSE media_type END AS modality FROM segments s JOIN assets USING (asset_id))"


def signals(spark, d):
    rows = b.segments(spark, d).join(b.assets(spark, d).select("asset_id", "media_type"), "asset_id")
    return rows.selectExpr("embedding_id", "asset_id", "start_s", "end_s", "vector", "if(embedding_id % 11 = 0, 'old', 'current') as profile_key",
                           "case when media_type <> 'video' then media_type when segment_index % 3 = 0 then 'video-visual' when segment_index % 3 = 1 then 'video-audio' else 'video-joint' end as modality")


def searched_by_signal(signal):
    """The twin of a search of images and videos by one signal of these, files grouped; windows overlap by half, so only every other one of a file is told beside the best."""
    return f"""WITH {V}, {A}, {Q0}, {SIGNALS}, ok AS (SELECT asset_id, rel_path, taken_at FROM assets WHERE status = 'indexed' AND live_photo IS NULL AND media_type IN ('image', 'video') AND library_id IN (0, 1, 2)),
    h AS (SELECT *, list_dot_product(vector, qv) AS x FROM signals JOIN ok USING (asset_id), q WHERE profile_key = 'current' AND modality IN ('image', 'video-{signal}') ORDER BY x DESC, embedding_id LIMIT 200),
    o AS (SELECT asset_id, list([CAST(embedding_id AS BIGINT)] ORDER BY x DESC, embedding_id) AS l FROM h GROUP BY 1),
    k AS (SELECT asset_id, len(l) AS n, list_reduce(l, lambda a, e: CASE WHEN len(list_filter(a, lambda z: abs(z - e[1]) < 2)) = 0 THEN list_concat(a, e) ELSE a END) AS kept FROM o),
    state AS (SELECT CASE WHEN count(*) FILTER (own AND status = 'indexed') = 0 AND count(*) FILTER (other) > 0 THEN 'incompatible' WHEN count(*) FILTER (own AND status = 'indexed') = 0 THEN 'not_indexed' WHEN count(*) FILTER (own AND status = 'indexed') < count(*) FILTER (status NOT IN ('failed', 'missing')) THEN 'partial' ELSE 'ready' END AS index_state
        FROM assets LEFT JOIN (SELECT asset_id, bool_or(profile_key = 'current') AS own, bool_or(profile_key <> 'current') AS other FROM signals GROUP BY 1) USING (asset_id) WHERE media_type IN ('image', 'video') AND library_id IN (0, 1, 2))
    SELECT k.asset_id, round(x, 5) AS similarity, modality, start_s, end_s, list_transform(kept[2:], lambda z: z) AS others, CAST(n - len(kept) AS INTEGER) AS suppressed, rel_path, taken_at, index_state, row_number() OVER (ORDER BY x DESC, embedding_id) AS rank
    FROM k JOIN h ON embedding_id = kept[1], state ORDER BY x DESC, embedding_id LIMIT 12"""


def search_signal(spark, d, signal):
    found = s.search(b.assets(spark, d), signals(spark, d), query_vector(b.vectors(spark, d)), "current", 12, ["image", "video"], signal, libraries=[0, 1, 2], hydrate=["rel_path", "taken_at"])
    return found.select("asset_id", F.round("similarity", 5).alias("similarity"), "modality", "start_s", "end_s", F.transform("others", lambda o: o["embedding_id"]).alias("others"), "suppressed", "rel_path", "taken_at", "index_state", "rank")


@query("l1_search_visual", searched_by_signal("visual"))
def l1_visual(spark, d):
    """Images and what is seen in videos, with the state of the index and the files' columns."""
    return search_signal(spark, d, "visual")


@query("l1_search_joint", searched_by_signal("joint"))
def l1_joint(spark, d):
    """Images and videos by the vectors of picture and sound together."""
    return search_signal(spark, d, "joint")


#: What a mode of search needs, and whether it is an experiment.
MODES = [("image", "image", False), ("video", "video", True), ("audio", "audio", True)]


@query("l2_mode_support", f"WITH {V}, {Q0}, {A}, m AS (SELECT * FROM (VALUES ('image', 'image', false), ('video', 'video', true)) t(media_type, encoder, experimental)), t AS (SELECT asset_id, media_type, experimental, list_dot_product(vector, qv) AS x FROM vectors JOIN assets USING (asset_id) JOIN m USING (media_type), q WHERE status = 'indexed' AND asset_id <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY media_type ORDER BY x DESC, asset_id) AS rank FROM t) SELECT media_type, asset_id, rank, experimental FROM r WHERE rank <= 5")
def l2(spark, d):
    """Only modes whose encoder is there are searched; here that of sound is not."""
    loaded = {"image", "video"}
    v, a = b.vectors(spark, d), b.assets(spark, d)
    parts = [s.rank_results(s.cosine_topk(s.searchable(v.filter("asset_id <> 0"), a.filter(F.col("media_type") == m)), query_vector(v), 5)).select(F.lit(m).alias("media_type"), "asset_id", "rank", F.lit(x).alias("experimental")) for m, needs, x in MODES if needs in loaded]
    return parts[0].unionByName(parts[1])


@query("j4_search_by_type", f"WITH {V}, {Q0}, {A}, t AS (SELECT asset_id, media_type, list_dot_product(vector, qv) AS x FROM vectors JOIN assets USING (asset_id), q WHERE status = 'indexed'), r AS (SELECT *, row_number() OVER (PARTITION BY media_type ORDER BY x DESC, asset_id) AS k FROM t) SELECT asset_id, media_type, row_number() OVER (ORDER BY x DESC, asset_id) AS rank FROM r WHERE (media_type = 'image' AND k <= 6) OR (media_type = 'video' AND k <= 3)")
def j4(spark, d):
    """Each type by its own function, then one ranking."""
    v = b.vectors(spark, d)
    q = query_vector(v)
    top = lambda k: lambda assets: s.cosine_topk(s.searchable(v, assets), q, k)
    return s.by_media_type(b.assets(spark, d), {"image": top(6), "video": top(3)}, s.rank_results).select("asset_id", "media_type", "rank")


@query("j5_trimmed_mean", "WITH n AS (SELECT l_suppkey AS supplier, l_extendedprice AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT supplier, round(avg(x) FILTER (i >= n // 10 AND i < n - n // 10), 2) AS mean FROM n GROUP BY 1")
def j5(spark, d):
    """A grouped aggregate in Arrow batches; a supplier has some 600 lines."""
    return b.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.round(ev.trimmed_mean("l_extendedprice"), 2).alias("mean"))


@query("l5_refine_colour_text", f"""WITH {V}, {Q0}, {PIXELS}, prev AS (SELECT asset_id, row_number() OVER (ORDER BY list_dot_product(vector, qv) DESC, asset_id) AS rank FROM vectors, q ORDER BY rank LIMIT 200), w AS (SELECT photo AS asset_id, {pale_sql(0, 7)} AS share FROM pixels), k AS (SELECT asset_id, share FROM prev JOIN w USING (asset_id) WHERE share >= 0.04),
    r AS (SELECT asset_id, row_number() OVER (ORDER BY share < 0.1, share DESC, asset_id) AS place, list_dot_product(vector, (SELECT vector FROM vectors WHERE asset_id = 1)) AS x FROM k JOIN vectors USING (asset_id)) SELECT asset_id, place, row_number() OVER (ORDER BY x DESC, asset_id) <= 3 AS close FROM r""")
def l5(spark, d):
    """What was shown, by the share of a colour; then the three closest to another text are sure."""
    v = b.vectors(spark, d)
    shown = s.cosine_topk(v, query_vector(v), 200).select("asset_id")
    boxes = F.array(F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))))
    shares = pictures(spark, d).withColumnRenamed("photo", "asset_id").join(shown, "asset_id", "left_semi").select("asset_id", pixels.best_box_share("grey")("data", "width", "height", "channels", boxes).alias("share"))
    kept = staged(shares).filter(F.col("share") >= pixels.MAYBE)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("share") < pixels.SURE, F.desc("share"), "asset_id"))  # of 200 rows at most
    again = s.rank_results(s.rank_within(kept, v, query_vector(v, 1)))
    return again.withColumn("place", place).select("asset_id", "place", (F.col("rank") <= 3).alias("close"))


@query("l6_summary", f"""WITH {P}, {B}, {R}, n AS (SELECT label, content_hash, count(*) AS n FROM boxes WHERE score >= 0.75 GROUP BY 1, 2), t AS (SELECT label, count(*) AS photos, sum(n) AS objects FROM n GROUP BY 1 ORDER BY photos DESC, label LIMIT 8), c AS (SELECT count(*) AS files, count(r.content_hash) AS checked FROM photos LEFT JOIN runs r USING (content_hash))
    SELECT label, photos, CAST(objects AS BIGINT) AS objects, files, checked FROM t, c""")
def l6(spark, d):
    """Coverage and the eight most frequent things."""
    top = det.object_summary(b.boxes(spark, d)).limit(8)
    return top.crossJoin(F.broadcast(det.coverage(b.photos(spark, d), b.detection_runs(spark, d))))  # one row


@query("l8_corrected_answers", f"""WITH {V}, {Q0}, {H}, shown AS (SELECT content_hash, row_number() OVER (ORDER BY list_dot_product(vector, qv) DESC, asset_id) AS rank FROM vectors JOIN hashed USING (asset_id), q ORDER BY rank LIMIT 40),
    wrong AS (SELECT content_hash FROM shown WHERE rank IN (2, 5, 7, 40)), before AS (SELECT content_hash, min(toxic) AS present FROM labels JOIN hashed ON doc_id = asset_id WHERE quality = 0 GROUP BY content_hash),
    verdicts AS (SELECT content_hash, 0 AS present FROM wrong UNION SELECT content_hash, present FROM before WHERE content_hash NOT IN (SELECT content_hash FROM wrong))
    SELECT asset_id FROM hashed WHERE content_hash NOT IN (SELECT content_hash FROM verdicts WHERE present = 0)""")
def l8(spark, d):
    """The user takes four photos out of an answer; the verdicts are stored by content, beside older ones, and every
    later answer about that label leaves out all copies."""
    h, v = b.hashed_assets(spark, d), b.vectors(spark, d)
    top = s.cosine_topk(v.join(h.select("asset_id"), "asset_id", "left_semi"), query_vector(v), 40)
    shown = s.rank_results(top).select("asset_id", "rank").join(h.select("asset_id", "content_hash"), "asset_id")
    before = (b.read(spark, d, "labels").filter("quality = 0").join(h, F.col("doc_id") == F.col("asset_id")).groupBy("content_hash").agg(F.min("toxic").alias("present"))
              .select("content_hash", F.lit("dog").alias("label"), F.lit("user").alias("verifier"), "present"))
    verdicts, _ = det.apply_corrections(shown, [2, 5, 7, -1], "dog", before)
    return det.without_corrections(h, verdicts.filter("label = 'dog'")).select("asset_id")


GROUPS = STARS.format(least=0.3) + f""", {H}, every AS (SELECT leader, member FROM stars UNION ALL SELECT DISTINCT leader, leader FROM stars), sizes AS (SELECT leader, count(*) AS size FROM every GROUP BY leader),
    fit AS (SELECT leader, size FROM (SELECT *, sum(size) OVER (ORDER BY size DESC, leader ROWS UNBOUNDED PRECEDING) AS total FROM sizes) WHERE total <= 60),
    shots AS (SELECT leader, member, size, content_hash, CAST(hashed.size_ % 997 AS DOUBLE) AS sharpness, hashed.size_ AS pixels FROM every JOIN fit USING (leader) LEFT JOIN (SELECT asset_id, content_hash, size AS size_ FROM hashed) hashed ON asset_id = member),
    tops AS (SELECT *, max(sharpness) OVER (PARTITION BY leader) AS top FROM shots), keep AS (SELECT leader, member FROM (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY pixels DESC, sharpness DESC, member) AS rn FROM tops WHERE sharpness >= 0.9 * top) WHERE rn = 1),
    same AS (SELECT leader, count(DISTINCT content_hash) = 1 AND count(content_hash) = count(*) AS identical FROM shots GROUP BY leader),
    told AS (SELECT shots.leader, shots.member, keep.member IS NOT NULL AS best, identical, size FROM shots JOIN same USING (leader) LEFT JOIN keep ON keep.leader = shots.leader AND keep.member = shots.member)"""


@query("l10_groups", GROUPS + " SELECT * FROM told")
def l10(spark, d):
    """Groups of look-alikes up to a number of photos: the best shot, and whether all have one hash."""
    return lookalikes.groups(alike(spark, d), shots(spark, d), 60)


def alike(spark, d):
    return staged(lookalikes.stars_of(b.vectors(spark, d), 0.3, spark))


def shots(spark, d):
    return b.hashed_assets(spark, d).select("asset_id", "content_hash", F.expr("size % 997").cast("double").alias("sharpness"), F.col("size").alias("pixels"))


@query("l10_review", GROUPS + """, seen AS (SELECT told.*, round(s, 5) AS similarity FROM told LEFT JOIN edges ON u = leader AND v = member)
    SELECT row_number() OVER (ORDER BY size DESC, leader, best DESC, similarity DESC NULLS FIRST, member) AS rank, dense_rank() OVER (ORDER BY size DESC, leader) AS grp, size, identical, member, best, similarity FROM seen""")
def l10_review(spark, d):
    """The same groups in the order in which they are looked through, the shot to keep first."""
    return lookalikes.review(alike(spark, d), shots(spark, d), 60)


@query("l10_levels", f"""WITH RECURSIVE {V}, {PAIRS}, near AS (SELECT a, b, s FROM pairs WHERE s >= 0.9), edges AS (SELECT a AS u, b AS v, s FROM near UNION ALL SELECT b, a, s FROM near), levels AS (SELECT * FROM (VALUES ('strict', 0.95), ('normal', 0.92), ('loose', 0.90)) t(level, threshold)),
    visits AS (SELECT level, u, list(v ORDER BY v) AS vs, row_number() OVER (PARTITION BY level ORDER BY count(*) DESC, u) AS k FROM edges, levels WHERE s >= threshold GROUP BY level, u),
    steps AS (SELECT level, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS leader, CAST([] AS BIGINT[]) AS members, CAST([] AS BIGINT[]) AS taken FROM levels UNION ALL
        SELECT level, k, CASE WHEN len(members) > 0 THEN u END AS leader, members, CASE WHEN len(members) > 0 THEN list_concat(taken, members, [u]) ELSE taken END AS taken
        FROM (SELECT v.level, v.k, u, taken, CASE WHEN list_contains(taken, u) THEN CAST([] AS BIGINT[]) ELSE list_filter(vs, lambda x: NOT list_contains(taken, x)) END AS members FROM steps s JOIN visits v ON v.k = s.k + 1 AND v.level = s.level))
    SELECT level, CAST(any_value(threshold) AS DOUBLE) AS threshold, count(leader) AS groups, CAST(coalesce(sum(CASE WHEN leader IS NOT NULL THEN 1 + len(members) END), 0) AS BIGINT) AS photos FROM levels LEFT JOIN steps USING (level) GROUP BY level""")
def l10_levels(spark, d):
    """How many groups and photos each level finds."""
    return lookalikes.level_summary(b.vectors(spark, d), spark)
