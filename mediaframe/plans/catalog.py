"""Catalog, places and selections: A2, A3, A5, A12, A13, B1-B4, B6, B8, B13, B14, B16, C4-C6, C8-C11, C16, C18, C19, C22, D4-D12, E8, E12-E16, F4, F6, G2, G4-G6, H2-H4, H13, H22, H23, H28, H33, I3, I5, K1-K8, L9."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, media
from ..operators import catalog as c
from ..operators import places as pl
from ..operators import selections as sel
from ..operators.blocks import numbered
from ..operators.search import VIDEO_SIGNALS, modalities_for
from ..registry import query
from ..sources import bindings as b

A, H, P, I = b.ASSETS, b.HASHED, b.PLACES, b.ITEMS
VISIBLE = "media_type = 'image' AND status = 'indexed' AND live_photo IS NULL"


@query("a2_hash_content", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def a2(spark, d):
    return b.read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("a3_folder_signature", f"WITH {A} SELECT library_id, count(*) AS n, sum(size) AS bytes, CAST(sum(CAST(round(epoch(taken_at)) AS BIGINT)) AS BIGINT) AS mtimes FROM assets GROUP BY library_id")
def a3(spark, d):
    t = F.floor(F.unix_micros(F.col("taken_at").cast("timestamp")) / 1e6 + 0.5)
    return b.assets(spark, d).groupBy("library_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.sum(t.cast("long")).alias("mtimes"))


@query("a5_build_gazetteer", "SELECT c_custkey AS town_id, c_name AS name, coalesce(n_name, '') AS region, coalesce(r_name, CAST(c_nationkey AS VARCHAR)) AS country FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment NOT IN ('BUILDING')")
def a5(spark, d):
    cities = b.read(spark, d, "customer").filter(~F.col("c_mktsegment").isin("BUILDING"))
    n, r = b.read(spark, d, "nation"), b.read(spark, d, "region")
    j = cities.join(n, cities.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return j.selectExpr("c_custkey as town_id", "c_name as name", "coalesce(n_name, '') as region", "coalesce(r_name, cast(c_nationkey as string)) as country").orderBy("country", "region", "name")


@query("a12_selection_manifest", f"""WITH {I} SELECT selection_id, asset_id, position, CASE WHEN state = 'F' THEN 'ok' WHEN state = 'O' THEN 'changed' ELSE 'missing' END AS status, concat('p/', asset_id, '.jpg') AS source FROM items""")
def a12(spark, d):
    m = sel.manifest(b.selection_items(spark, d))
    return m.select("selection_id", F.explode("items").alias("i")).select("selection_id", "i.asset_id", "i.position", "i.status", "i.source")


@query("a13_merge_pool", f"WITH {b.JUDGED}, u AS (SELECT query, candidate, rank AS seq FROM judged WHERE rank <= 5 UNION ALL SELECT query, candidate, 100 + rank FROM judged WHERE rank BETWEEN 3 AND 9) SELECT query, candidate, min(seq) AS seq FROM u GROUP BY query, candidate")
def a13(spark, d):
    j = b.judged(spark, d)
    runs = j.filter("rank <= 5").selectExpr("query", "candidate", "rank as seq").unionByName(j.filter("rank between 3 and 9").selectExpr("query", "candidate", "100 + rank as seq"))
    return runs.groupBy("query", "candidate").agg(F.min("seq").alias("seq"))


@query("b1_scope", f"WITH {A} SELECT asset_id FROM assets WHERE {VISIBLE} AND library_id IN (0, 2)")
def b1(spark, d):
    return c.scope(b.assets(spark, d), [0, 2]).select("asset_id")


@query("b2_media_filter", f"""WITH {A} SELECT asset_id FROM assets WHERE {VISIBLE} AND ((taken_at >= TIMESTAMP '2024-01-03' AND taken_at < TIMESTAMP '2024-01-06') OR (taken_at >= TIMESTAMP '2024-01-20' AND taken_at < TIMESTAMP '2024-01-22'))
    AND month(taken_at) IN (1, 7) AND place IN ('Town1, Region1, Country1', 'Town2, Region2, Country0', 'Town3, Region3, Country1')""")
def b2(spark, d):
    when = c.MediaFilter([("2024-01-03", "2024-01-06"), ("2024-01-20", "2024-01-22")], [1, 7], ["Town1, Region1, Country1", "Town2, Region2, Country0", "Town3, Region3, Country1"])
    return c.scope(b.assets(spark, d), when=when).select("asset_id")


@query("b3_date_place_filter", f"WITH {A} SELECT asset_id FROM assets WHERE taken_at >= TIMESTAMP '2024-01-10' AND taken_at < TIMESTAMP '2024-01-13' AND (place = 'Region1, Country1' OR place LIKE '%, Region1, Country1')")
def b3(spark, d):
    found = pl.within(b.assets(spark, d), "Region1, Country1")
    return c.date_place_filter(found, "2024-01-10", "2024-01-12").select("asset_id")


@query("b4_modalities_for", f"WITH {A} SELECT media_type, CASE media_type WHEN 'image' THEN 'image' WHEN 'audio' THEN 'audio' ELSE 'video-visual' END AS modality, count(*) AS n FROM assets GROUP BY 1, 2")
def b4(spark, d):
    m = F.when(F.col("media_type").isin("image", "audio"), F.col("media_type")).otherwise("video-visual")
    return b.assets(spark, d).groupBy("media_type", m.alias("modality")).agg(F.count(F.lit(1)).alias("n"))


@query("b4_video_signals", f"""WITH {A}, t AS (SELECT * FROM (VALUES ('visual', 'video-visual'), ('audio', 'video-audio'), ('joint', 'video-joint')) v(signal, modality))
    SELECT asset_id, signal, CASE media_type WHEN 'video' THEN modality ELSE media_type END AS modality FROM assets, t""")
def b4_signals(spark, d):
    """The modality in which each asset is searched, for each signal of videos."""
    a = b.assets(spark, d).select("asset_id", "media_type")
    out = None
    for signal in VIDEO_SIGNALS:
        names = F.create_map(*[F.lit(x) for t in ("image", "audio", "video") for x in (t, *modalities_for([t], signal))])
        one = a.select("asset_id", F.lit(signal).alias("signal"), names[F.col("media_type")].alias("modality"))
        out = one if out is None else out.unionByName(one)
    return out


@query("b6_list_assets", f"WITH {A} SELECT asset_id, rel_path FROM assets WHERE library_id = 1 AND status = 'pending' AND media_type = 'image'")
def b6(spark, d):
    return b.assets(spark, d).filter("library_id = 1 and status = 'pending' and media_type = 'image'").orderBy("rel_path").select("asset_id", "rel_path")


@query("b8_public_assets", f"WITH {A}, v AS (SELECT live_photo AS photo, min(asset_id) AS video FROM assets WHERE live_photo IS NOT NULL AND status <> 'missing' GROUP BY 1) SELECT asset_id, library_id, rel_path, media_type, status, size, place, video AS live_video FROM assets LEFT JOIN v ON photo = asset_id")
def b8(spark, d):
    a = b.assets(spark, d)
    v = a.filter("live_photo is not null and status <> 'missing'").groupBy(F.col("live_photo").alias("photo")).agg(F.min("asset_id").alias("live_video"))
    return a.join(v, a.asset_id == v.photo, "left").select("asset_id", "library_id", "rel_path", "media_type", "status", "size", "place", "live_video")


@query("b13_validate_ranges", """WITH r AS (SELECT l_orderkey AS asset_id, l_linenumber AS n, l_quantity - 3 AS start_s, l_quantity - 3 + l_discount * 100 AS end_s, 40.0 AS duration FROM lineitem)
    SELECT asset_id, n, start_s, least(end_s, duration) AS end_s, CASE WHEN start_s < 0 THEN 'starts before 0' WHEN start_s >= least(end_s, duration) THEN 'empty' WHEN least(end_s, duration) - start_s < 0.5 THEN 'too short' WHEN least(end_s, duration) - start_s > 600 THEN 'too long' END AS reason FROM r""")
def b13(spark, d):
    r = b.read(spark, d, "lineitem").selectExpr("l_orderkey as asset_id", "l_linenumber as n", "l_quantity - 3 as start_s", "l_quantity - 3 + l_discount * 100 as end_s", "40.0D as duration")
    return sel.validate_ranges(r).drop("duration")


@query("b14_exportable", f"WITH {I} SELECT CASE WHEN state <> 'F' THEN 'skipped' WHEN position % 3 = 0 THEN 'clip' WHEN position % 3 = 1 THEN 'file' ELSE 'audio segment skipped' END AS branch, count(*) AS n FROM items GROUP BY 1")
def b14(spark, d):
    kind = F.when(F.col("state") != "F", "skipped").when(F.expr("position % 3 = 0"), "clip").when(F.expr("position % 3 = 1"), "file").otherwise("audio segment skipped")
    return b.selection_items(spark, d).groupBy(kind.alias("branch")).agg(F.count(F.lit(1)).alias("n"))


@query("b16_available_modes", "SELECT p_partkey AS mode, p_size % 2 = 0 AND p_size % 3 = 0 AS usable FROM part")
def b16(spark, d):
    needs = F.array(F.concat(F.lit("two"), (F.col("p_size") % 2)), F.concat(F.lit("three"), (F.col("p_size") % 3)))
    loaded = F.array(F.lit("two0"), F.lit("three0"))
    return b.read(spark, d, "part").select(F.col("p_partkey").alias("mode"), F.forall(needs, lambda x: F.array_contains(loaded, x)).alias("usable"))


@query("c5_stale_libraries", "SELECT DISTINCT source AS library_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 50 = 0)")
def c5(spark, d):
    e = b.read(spark, d, "documents").selectExpr("source as library_id", "if(doc_id % 50 = 0, 'new', 'old') as profile")
    return e.filter("profile = 'old'").join(e.filter("profile = 'new'"), "library_id", "left_anti").select("library_id").distinct()


@query("c6_exclude_identical", f"WITH {H} SELECT asset_id FROM hashed WHERE content_hash NOT IN (SELECT content_hash FROM hashed WHERE asset_id < 20)")
def c6(spark, d):
    h = b.hashed_assets(spark, d)
    return h.join(h.filter("asset_id < 20").select("content_hash"), "content_hash", "left_anti").select("asset_id")


KM = "2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(t.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - p.lon) / 2), 2))))"


@query("c8_nearest_place", f"""WITH {b.POINTS}, {b.TOWNS}, k AS (SELECT point_id, town_id, name, region, country, population, {KM} AS km FROM points p, towns t), f AS (SELECT * FROM k WHERE km <= 150),
    r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY km > 30, CASE WHEN km <= 30 THEN -population / pow(km + 1, 2) ELSE km END, town_id) AS rn FROM f),
    n AS (SELECT point_id, CASE WHEN km <= 30 THEN list_filter([name, region, country], lambda x, i: x <> '' AND list_position([name, region, country], x) = i) ELSE list_filter([region, country], lambda x, i: x <> '' AND list_position([region, country], x) = i) END AS parts FROM r WHERE rn = 1)
    SELECT p.point_id, array_to_string(parts, ', ') AS place FROM points p LEFT JOIN n USING (point_id)""")
def c8(spark, d):
    return geo.nearest_place(b.points(spark, d), b.towns(spark, d))


@query("c9_places_within", f"WITH {P} SELECT asset_id FROM places WHERE place = 'CHINA, ASIA' OR place LIKE '%, CHINA, ASIA'")
def c9(spark, d):
    return pl.within(b.places(spark, d), "CHINA, ASIA").select("asset_id")


@query("c10_pair_live", f"""WITH {A}, v AS (SELECT library_id, regexp_replace(lower(split_part(rel_path, '/', 2)), '.$', '') AS stem, asset_id AS video FROM assets WHERE media_type = 'video' AND duration <= 5), i AS (SELECT library_id, regexp_replace(lower(split_part(rel_path, '/', 2)), '.$', '') AS stem, asset_id AS image, rel_path FROM assets WHERE media_type = 'image')
    SELECT video, arg_max(image, rel_path) AS image FROM v JOIN i ON v.library_id = i.library_id AND regexp_extract(v.stem, '_(\\d+)', 1)::BIGINT // 10 = regexp_extract(i.stem, '_(\\d+)', 1)::BIGINT // 10 GROUP BY video""")
def c10(spark, d):
    a = b.assets(spark, d).withColumn("rel_path", F.expr("concat(asset_id div 10, '.', rel_path)"))
    stem = F.regexp_extract("rel_path", r"^(\d+)\.", 1)
    shaped = a.withColumn("path", F.expr("substring(rel_path, instr(rel_path, '.') + 1)")).withColumn("stem", stem)
    v = shaped.filter("media_type = 'video'").select("library_id", "asset_id", "duration", F.concat("stem", F.lit(".mov")).alias("rel_path"))
    i = shaped.filter("media_type = 'image'").select("library_id", "asset_id", "path", F.concat("stem", F.lit(".jpg")).alias("rel_path"))
    return c.pair_live(v, i, order="path")


@query("c11_reuse_vectors", f"WITH {H} SELECT p.asset_id, min(q.asset_id) AS donor FROM hashed p JOIN hashed q USING (content_hash) WHERE p.status = 'pending' AND q.status = 'indexed' GROUP BY p.asset_id")
def c11(spark, d):
    h = b.hashed_assets(spark, d)
    return c.reuse_vectors(h.filter("status = 'pending'"), h.filter("status = 'indexed'"))


@query("c16_item_status", f"WITH {I} SELECT i.selection_id, i.asset_id, CASE WHEN o_orderkey IS NULL THEN 'removed' WHEN state = 'P' THEN 'missing' WHEN round(bytes) % 7 = 0 THEN 'changed' ELSE 'ok' END AS status FROM items i LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 9 <> 0) ON o_orderkey = i.asset_id")
def c16(spark, d):
    items = b.selection_items(spark, d).withColumn("snapshot", F.expr("if(round(bytes) % 7 = 0, 'old', 'h')"))
    there = b.read(spark, d, "orders").filter("o_orderkey % 9 <> 0").selectExpr("o_orderkey as asset_id", "if(o_orderstatus = 'P', null, 'h') as content_hash")
    return sel.item_status(items, there).select("selection_id", "asset_id", "status")


SCAN = "e AS (SELECT * FROM hashed WHERE asset_id % 7 <> 0), s AS (SELECT rel_path, CASE WHEN asset_id % 13 = 0 THEN concat(content_hash, 'x') ELSE content_hash END AS now, size + 1 AS size1, asset_id + 1000000 AS new_id FROM hashed WHERE asset_id % 6 <> 0)"


def scan(spark, d):
    h = b.hashed_assets(spark, d)
    return h.filter("asset_id % 7 <> 0"), h.filter("asset_id % 6 <> 0").selectExpr("rel_path", "if(asset_id % 13 = 0, concat(content_hash, 'x'), content_hash) as content_hash", "size + 1 as size", "asset_id + 1000000 as new_id")


@query("c18_import_diff", f"""WITH {H}, {SCAN} SELECT rel_path, CASE WHEN asset_id IS NULL THEN 'new' WHEN now IS NULL THEN 'missing' WHEN content_hash <> now THEN 'changed' WHEN status = 'missing' THEN 'returned' ELSE 'unchanged' END AS outcome FROM e FULL JOIN s USING (rel_path)""")
def c18(spark, d):
    return c.import_diff(*scan(spark, d))


@query("k1_upsert_assets", f"""WITH {H}, {SCAN} SELECT rel_path, coalesce(asset_id, new_id) AS asset_id, coalesce(now, content_hash) AS content_hash, coalesce(size1, size) AS size,
    CASE WHEN now IS NULL THEN status WHEN asset_id IS NULL OR content_hash <> now OR status = 'missing' THEN 'pending' ELSE status END AS status FROM e FULL JOIN s USING (rel_path)""")
def k1(spark, d):
    return c.upsert_assets(*scan(spark, d))


@query("d11_import_summary", f"""WITH {H}, {SCAN} SELECT CASE WHEN asset_id IS NULL THEN 'new' WHEN now IS NULL THEN 'missing' WHEN content_hash <> now THEN 'changed' WHEN status = 'missing' THEN 'returned' ELSE 'unchanged' END AS outcome, count(*) AS n FROM e FULL JOIN s USING (rel_path) GROUP BY 1""")
def d11(spark, d):
    return c.import_diff(*scan(spark, d)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("c19_needs_metadata", f"WITH {A} SELECT asset_id FROM assets WHERE media_type IN ('image', 'video') AND taken_at IS NULL AND status NOT IN ('missing', 'failed')")
def c19(spark, d):
    return b.assets(spark, d).filter("media_type in ('image', 'video') and taken_at is null and status not in ('missing', 'failed')").select("asset_id")


@query("c22_needs_embedding", f"WITH {A} SELECT asset_id FROM assets WHERE media_type = 'image' AND asset_id NOT IN (SELECT vec_id FROM embeddings)")
def c22(spark, d):
    return b.assets(spark, d).filter("media_type = 'image'").join(b.vectors(spark, d).select("asset_id"), "asset_id", "left_anti").select("asset_id")


@query("c4_undetected", f"WITH {b.PHOTOS} SELECT min(asset_id) AS asset_id FROM photos WHERE content_hash % 4 = 0 GROUP BY content_hash")
def c4(spark, d):
    runs = b.detection_runs(spark, d)
    return b.photos(spark, d).join(runs, "content_hash", "left_anti").groupBy("content_hash").agg(F.min("asset_id").alias("asset_id")).select("asset_id")


@query("d4_taken_months", f"WITH {A} SELECT strftime(taken_at, '%Y-%m') AS month, count(*) AS n FROM assets WHERE {VISIBLE} GROUP BY 1")
def d4(spark, d):
    return c.scope(b.assets(spark, d)).groupBy(F.date_format("taken_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("d5_place_counts", f"WITH {P} SELECT place, count(*) AS n FROM places GROUP BY place")
def d5(spark, d):
    return b.places(spark, d).groupBy("place").agg(F.count(F.lit(1)).alias("n"))


@query("d6_place_points", f"WITH {A} SELECT place, round(avg(gps_lat), 4) AS lat, round(avg(gps_lon), 4) AS lon, count(*) AS n FROM assets WHERE place IS NOT NULL AND gps_lat IS NOT NULL GROUP BY place")
def d6(spark, d):
    return pl.points(b.assets(spark, d))


@query("d7_place_levels", f"WITH {P}, l AS (SELECT unnest([place, regexp_replace(place, '^[^,]*, ', ''), regexp_replace(place, '^[^,]*, [^,]*, ', '')]) AS level, unnest([3, 2, 1]) AS depth FROM places) SELECT level, CAST(depth AS BIGINT) AS depth, count(*) AS n FROM l GROUP BY 1, 2")
def d7(spark, d):
    return pl.levels(b.places(spark, d)).withColumn("depth", F.col("depth").cast("long"))


@query("d8_metadata_gaps", f"WITH {A} SELECT count(*) AS total, count(*) - count(taken_at) AS undated, count(*) - count(place) AS unplaced FROM assets WHERE {VISIBLE}")
def d8(spark, d):
    return c.scope(b.assets(spark, d)).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("taken_at").isNull()).alias("undated"), F.count_if(F.col("place").isNull()).alias("unplaced"))


@query("d9_index_state", f"""WITH {A}, s AS (SELECT library_id, count(*) AS n, count(*) FILTER (status = 'indexed') AS indexed, count(DISTINCT vec_id) AS current FROM assets LEFT JOIN embeddings ON vec_id = asset_id GROUP BY library_id)
    SELECT library_id, n, indexed, current, CASE WHEN n = 0 THEN 'empty' WHEN current = 0 THEN 'not_indexed' WHEN current < n THEN 'partial' ELSE 'ready' END AS state FROM s""")
def d9(spark, d):
    a, v = b.assets(spark, d), b.vectors(spark, d).select(F.col("asset_id").alias("v"))
    s = a.join(v, a.asset_id == v.v, "left").groupBy("library_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_distinct("v").alias("current"))
    return s.withColumn("state", F.when(F.col("n") == 0, "empty").when(F.col("current") == 0, "not_indexed").when(F.col("current") < F.col("n"), "partial").otherwise("ready"))


@query("d10_selection_counts", "SELECT c_custkey AS selection_id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def d10(spark, d):
    n = b.selection_items(spark, d).groupBy("selection_id").agg(F.count(F.lit(1)).alias("n"))
    return b.read(spark, d, "customer").select(F.col("c_custkey").alias("selection_id")).join(n, "selection_id", "left").select("selection_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("d12_export_totals", f"WITH {I} SELECT selection_id, count(*) FILTER (state = 'F') AS files, round(coalesce(sum(bytes) FILTER (state = 'F'), 0), 2) AS bytes, count(*) FILTER (state <> 'F') AS skipped FROM items GROUP BY selection_id")
def d12(spark, d):
    ok = F.col("state") == "F"
    return b.selection_items(spark, d).groupBy("selection_id").agg(F.count_if(ok).alias("files"), F.round(F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0.0)), 2).alias("bytes"), F.count_if(~ok).alias("skipped"))


@query("e8_positions", f"WITH {I} SELECT selection_id, asset_id, row_number() OVER (PARTITION BY selection_id ORDER BY bytes, asset_id) AS position FROM items")
def e8(spark, d):
    return sel.reorder(b.selection_items(spark, d), ["bytes", "asset_id"]).select("selection_id", "asset_id", "position")


@query("e12_free_names", "SELECT o_orderkey AS id, CASE WHEN row_number() OVER w = 1 THEN concat('Photo', o_custkey % 50, '.jpg') ELSE concat('Photo', o_custkey % 50, ' (', row_number() OVER w, ').jpg') END AS name FROM orders WINDOW w AS (PARTITION BY o_custkey % 50 ORDER BY o_orderkey)")
def e12(spark, d):
    return sel.free_names(b.read(spark, d, "orders").selectExpr("o_orderkey as id", "concat('Photo', o_custkey % 50) as stem", "'.jpg' as ext"))


@query("e12_taken_names", """WITH f AS (SELECT s_suppkey AS id, s_suppkey // 6 AS g, s_suppkey % 6 AS k FROM supplier) SELECT id, concat('p', g, CASE k WHEN 0 THEN '.jpg' WHEN 1 THEN ' (2).jpg' WHEN 2 THEN ' (3).JPG' WHEN 3 THEN ' (2) (2).jpg' WHEN 4 THEN ' (4).jpg' ELSE '_.jpg' END) AS name FROM f""")
def e12b(spark, d):
    """Of each root: a.jpg, "a (2).jpg", A.JPG, "a (2).jpg", a.jpg and another name; two of them ask for names that are taken."""
    stem = "case s_suppkey % 6 when 0 then '' when 1 then ' (2)' when 2 then '' when 3 then ' (2)' when 4 then '' else '_' end"
    return sel.free_names(b.read(spark, d, "supplier").selectExpr("s_suppkey as id", f"concat('p', s_suppkey div 6, {stem}) as stem", "if(s_suppkey % 6 = 2, '.JPG', '.jpg') as ext"))


@query("e13_systematic_sample", f"WITH {A}, r AS (SELECT asset_id, row_number() OVER (PARTITION BY library_id ORDER BY asset_id) AS rn FROM assets) SELECT asset_id FROM r WHERE rn % 10 = 1")
def e13(spark, d):
    return numbered(b.assets(spark, d).select("library_id", "asset_id"), ["library_id"], ["asset_id"]).filter("rn % 10 = 1").select("asset_id")


@query("e14_blind_order", f"WITH {b.JUDGED} SELECT query, candidate, row_number() OVER (PARTITION BY query ORDER BY sha256(concat(query, candidate))) AS place FROM judged WHERE rank <= 10")
def e14(spark, d):
    w = Window.partitionBy("query").orderBy(F.sha2(F.concat("query", F.col("candidate").cast("string")), 256))
    return b.judged(spark, d).filter("rank <= 10").select("query", "candidate", F.row_number().over(w).alias("place"))


@query("e15_settled_change", f"""WITH {A}, p AS (SELECT library_id, dayofmonth(taken_at) AS poll, count(*) // 60 AS sig FROM assets WHERE taken_at IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, lag(sig) OVER w AS before, first_value(sig) OVER w AS base FROM p WINDOW w AS (PARTITION BY library_id ORDER BY poll)) SELECT library_id, poll FROM r WHERE sig <> base AND sig = before""")
def e15(spark, d):
    polls = b.assets(spark, d).filter("taken_at is not null").groupBy("library_id", F.dayofmonth("taken_at").cast("long").alias("poll")).agg(F.expr("count(1) div 60").alias("sig"))
    w = Window.partitionBy("library_id").orderBy("poll")
    return polls.withColumn("before", F.lag("sig").over(w)).withColumn("base", F.first("sig").over(w)).filter("sig <> base and sig = before").select("library_id", "poll")


@query("f4_oldest_first", f"WITH {A} SELECT asset_id, row_number() OVER (ORDER BY taken_at NULLS LAST, rel_path) AS place FROM assets WHERE {VISIBLE} ORDER BY taken_at NULLS LAST, rel_path LIMIT 100")
def f4(spark, d):
    top = c.scope(b.assets(spark, d)).orderBy(F.asc_nulls_last("taken_at"), "rel_path").limit(100)
    return top.select("asset_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_last("taken_at"), "rel_path")).alias("place"))


@query("f6_month_listing", f"WITH {A} SELECT asset_id, count(*) OVER () AS total FROM assets WHERE {VISIBLE} AND taken_at >= TIMESTAMP '2024-01-01' AND taken_at < TIMESTAMP '2024-02-01' ORDER BY taken_at, rel_path LIMIT 60")
def f6(spark, d):
    month = c.scope(b.assets(spark, d), when=c.MediaFilter([("2024-01-01", "2024-02-01")]))
    return month.orderBy("taken_at", "rel_path").limit(60).select("asset_id").crossJoin(F.broadcast(month.agg(F.count(F.lit(1)).alias("total"))))


@query("f6_place_listing", f"WITH {P} SELECT asset_id FROM places WHERE place LIKE '%, ASIA' ORDER BY asset_id LIMIT 200")
def f6b(spark, d):
    return pl.within(b.places(spark, d), "ASIA").select("asset_id").orderBy("asset_id").limit(200)


@query("f6_places_by_time", f"""WITH {A}, kept AS (SELECT * FROM assets WHERE media_type IN ('image', 'video') AND status = 'indexed' AND live_photo IS NULL AND (place = 'Country1' OR place LIKE '%, Country1'))
    SELECT asset_id, row_number() OVER (ORDER BY taken_at NULLS LAST, rel_path) AS rank, count(*) OVER () AS total FROM kept ORDER BY rank LIMIT 2000""")
def f6_place(spark, d):
    """Photos and videos of a country, oldest first: at most 2,000 however many are asked for, and their number."""
    kept = pl.within(c.scope(b.assets(spark, d), media=("image", "video")), "Country1")
    return c.listing(kept, 9999).select("asset_id", "rank", "total")


@query("f6_months", f"""WITH {A}, kept AS (SELECT *, strftime(taken_at, '%Y-%m') AS m FROM assets WHERE media_type IN ('image', 'video') AND status = 'indexed' AND live_photo IS NULL AND taken_at >= TIMESTAMP '2024-01-01' AND taken_at < TIMESTAMP '2024-03-01')
    SELECT m AS month, asset_id, rank, total FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY taken_at, rel_path) AS rank, count(*) OVER (PARTITION BY m) AS total FROM kept) WHERE rank <= 500""")
def f6_months(spark, d):
    """The first page of two months."""
    out = None
    for month, after in (("2024-01", "2024-02"), ("2024-02", "2024-03")):
        kept = c.scope(b.assets(spark, d), when=c.MediaFilter([(f"{month}-01", f"{after}-01")]), media=("image", "video"))
        one = c.listing(kept).select(F.lit(month).alias("month"), "asset_id", "rank", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query("h13_thumb_and_clip", f"""WITH {b.ASSETS}, {b.SEGMENTS}, t AS (SELECT embedding_id, content_hash, rel_path, start_s, end_s, CAST(round(start_s * 10) AS BIGINT) AS x, CAST(round(end_s * 10) AS BIGINT) AS y FROM segments JOIN assets USING (asset_id))
    SELECT embedding_id, concat(substr(content_hash, 1, 2), '/', content_hash, '-w', printf('%.3f', start_s), '.jpg') AS thumb,
        concat(regexp_extract(rel_path, '([^/]*)\\.[^.]*$', 1), '_', printf('%02dm%02d_%ds', x // 600, (x // 10) % 60, x % 10), '-', printf('%02dm%02d_%ds', y // 600, (y // 10) % 60, y % 10), '.mp4') AS clip FROM t""")
def h13_names(spark, d):
    """Where a window's picture is kept, and what its clip is called."""
    rows = b.segments(spark, d).join(b.assets(spark, d).select("asset_id", "content_hash", "rel_path"), "asset_id")
    return rows.select("embedding_id", media.thumb_path(F.col("content_hash"), F.col("start_s")).alias("thumb"), media.clip_name(F.col("rel_path"), F.col("start_s"), F.col("end_s")).alias("clip"))


@query("g2_pool_union", f"WITH {b.JUDGED} SELECT DISTINCT query, candidate FROM judged WHERE rank <= 5 OR grade > 0")
def g2(spark, d):
    j = b.judged(spark, d)
    return j.filter("rank <= 5").select("query", "candidate").union(j.filter("grade > 0").select("query", "candidate")).dropDuplicates()


@query("g4_intersect_order", f"WITH {I} SELECT selection_id, asset_id, position FROM items WHERE asset_id IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.08)")
def g4(spark, d):
    allowed = b.read(spark, d, "lineitem").filter("l_discount > 0.08").select(F.col("l_orderkey").alias("asset_id"))
    return b.selection_items(spark, d).join(allowed, "asset_id", "left_semi").select("selection_id", "asset_id", "position")


@query("g5_except", f"WITH {H}, {SCAN} SELECT rel_path FROM e EXCEPT SELECT rel_path FROM s")
def g5(spark, d):
    e, s = scan(spark, d)
    return e.join(s, "rel_path", "left_anti").select("rel_path")


@query("g6_exclusion_union", f"WITH {H} SELECT asset_id FROM hashed WHERE content_hash IN (SELECT content_hash FROM hashed WHERE asset_id = 5) UNION SELECT 5")
def g6(spark, d):
    h = b.hashed_assets(spark, d)
    ref = h.filter("asset_id = 5")
    return h.join(ref.select("content_hash"), "content_hash", "left_semi").select("asset_id").union(ref.select("asset_id")).distinct()


@query("h2_fold", "SELECT DISTINCT strip_accents(lower(trim(lang))) AS folded FROM documents UNION SELECT DISTINCT strip_accents(lower('São ' || source)) FROM documents")
def h2(spark, d):
    docs = b.read(spark, d, "documents")
    return docs.select(pl.fold(F.col("lang")).alias("folded")).union(docs.select(pl.fold(F.concat(F.lit("São "), "source")))).distinct()


@query("h4_place_suffixes", f"WITH {P} SELECT asset_id, list_transform(range(1, len(string_split(place, ', ')) + 1), lambda i: array_to_string(string_split(place, ', ')[i:], ', ')) AS suffixes FROM places")
def h4(spark, d):
    return b.places(spark, d).select("asset_id", pl.suffixes(F.col("place")).alias("suffixes"))


@query("h13_path_parts", f"WITH {A} SELECT asset_id, split_part(rel_path, '/', 1) AS dir, regexp_extract(rel_path, '([^/]*)\\.[^.]*$', 1) AS stem, regexp_extract(rel_path, '\\.([^.]*)$', 1) AS ext FROM assets")
def h13(spark, d):
    p = F.col("rel_path")
    return b.assets(spark, d).select("asset_id", F.regexp_extract(p, r"^(.*)/", 1).alias("dir"), F.regexp_extract(p, r"([^/]*)\.[^.]*$", 1).alias("stem"), F.regexp_extract(p, r"\.([^.]*)$", 1).alias("ext"))


@query("h22_haversine_gravity", f"WITH {b.POINTS}, {b.TOWNS} SELECT point_id, town_id, round({KM}, 3) AS km, round(population / pow({KM} + 1, 2), 3) AS gravity FROM points p JOIN towns t ON point_id % 100 = town_id % 100")
def h22(spark, d):
    """Every point with each town of its key. Distances and pulls are told once for all points of one place; a
    key's places are dealt over 16 parts, each of which meets all of the key's towns. The rows of the
    result grow with points times towns."""
    key, tasks = F.col("point_id") % 100, 384
    places = b.points(spark, d).groupBy("lat", "lon", key.alias("key"), F.floor(F.col("point_id") / 1_000_000).alias("piece")).agg(F.collect_list("point_id").alias("ids"))  # 10,000 at most
    p = places.withColumn("part", F.pmod(F.xxhash64("lat", "lon", "piece"), F.lit(16))).repartition(tasks, "key", "part")
    t = b.towns(spark, d).select("town_id", "population", F.col("lat").alias("tlat"), F.col("lon").alias("tlon"), (F.col("town_id") % 100).alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("part")).repartition(tasks, "key", "part")
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("tlat"), F.col("tlon"))
    told = p.join(t.hint("merge"), ["key", "part"]).select("ids", "town_id", F.round(km, 3).alias("km"), F.round(geo.gravity(F.col("population"), km), 3).alias("gravity"))
    return told.select(F.explode("ids").alias("point_id"), "town_id", "km", "gravity")


@query("h28_calendar", "SELECT o_orderkey AS id, date_trunc('month', o_orderdate)::TIMESTAMP AS month_start, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::TIMESTAMP AS month_end, (date_trunc('month', o_orderdate) - to_months(CAST(month(o_orderdate) % 3 AS INTEGER)))::TIMESTAMP AS season_start FROM orders")
def h28(spark, d):
    m = F.trunc("o_orderdate", "month")
    return b.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), m.cast("timestamp_ntz").alias("month_start"), F.add_months(m, 1).cast("timestamp_ntz").alias("month_end"), F.add_months(m, -(F.month("o_orderdate") % 3)).cast("timestamp_ntz").alias("season_start"))


@query("h33_json_helpers", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 2 = 0 THEN concat('[', event_id, ',', event_id + 5, ']') END AS segment FROM events")
def h33(spark, d):
    seg = F.when(F.expr("event_id % 2 = 0"), F.to_json(F.array(F.col("event_id"), F.col("event_id") + 5)))
    return b.read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), seg.alias("segment"))


@query("i3_first_per_hash", f"WITH {H} SELECT content_hash, min(asset_id) AS asset_id FROM hashed GROUP BY content_hash")
def i3(spark, d):
    return b.hashed_assets(spark, d).groupBy("content_hash").agg(F.min("asset_id").alias("asset_id"))


@query("i5_late_backfill", f"WITH {A} SELECT library_id, count(*) AS n FROM assets WHERE taken_at IS NULL AND media_type <> 'audio' AND status NOT IN ('missing', 'failed') GROUP BY library_id")
def i5(spark, d):
    return c19(spark, d).join(b.assets(spark, d).select("asset_id", "library_id"), "asset_id").groupBy("library_id").agg(F.count(F.lit(1)).alias("n"))


@query("k3_upsert_verification", "WITH u AS (SELECT doc_id AS hash, toxic AS present, 0 AS turn FROM labels UNION ALL SELECT doc_id, 1 - toxic, 1 FROM labels WHERE doc_id % 3 = 0) SELECT hash, arg_max(present, turn) AS present FROM u GROUP BY hash")
def k3(spark, d):
    l = b.read(spark, d, "labels")
    rows = l.selectExpr("doc_id as hash", "toxic as present", "0 as at").unionByName(l.filter("doc_id % 3 = 0").selectExpr("doc_id as hash", "1 - toxic as present", "1 as at"))
    return c.latest(rows, ["hash"], "at").select("hash", "present")


@query("k4_set_photo_meta", f"WITH {A} SELECT asset_id, CASE WHEN asset_id % 10 = 0 THEN TIMESTAMP '2020-01-01' ELSE taken_at END AS taken_at, asset_id % 10 = 0 AS meta_read FROM assets")
def k4(spark, d):
    a = b.assets(spark, d)
    meta = a.filter("asset_id % 10 = 0").selectExpr("asset_id", "to_timestamp_ntz('2020-01-01') as new_at", "true as read")
    return a.join(meta, "asset_id", "left").select("asset_id", F.coalesce("new_at", "taken_at").alias("taken_at"), F.coalesce("read", F.lit(False)).alias("meta_read"))


@query("k5_cascade_delete", f"WITH {A} SELECT count(*) AS assets, count(vec_id) AS embeddings FROM assets LEFT JOIN embeddings ON vec_id = asset_id WHERE library_id <> 2")
def k5(spark, d):
    a = b.assets(spark, d)
    left = a.join(a.filter("library_id = 2").select("library_id").distinct(), "library_id", "left_anti")
    v = b.vectors(spark, d).select("asset_id").join(left, "asset_id", "left_semi")
    return left.agg(F.count(F.lit(1)).alias("assets")).crossJoin(F.broadcast(v.agg(F.count(F.lit(1)).alias("embeddings"))))


@query("k6_rekey_profiles", "WITH u AS (SELECT vec_id // 2 AS asset_id, CASE WHEN vec_id % 2 = 0 THEN 0 ELSE 1 END AS pref, vec_id FROM embeddings) SELECT asset_id, arg_min(vec_id, pref) AS vec_id FROM u GROUP BY asset_id")
def k6(spark, d):
    e = b.read(spark, d, "embeddings").selectExpr("vec_id div 2 as asset_id", "vec_id", "if(vec_id % 2 = 0, 'current', 'old-key') as profile")
    keys = e.filter("profile = 'old-key'").select("profile").distinct().withColumn("to", F.lit("current"))
    moved = e.join(keys, "profile", "left").withColumn("moved", F.col("to").isNotNull()).withColumn("profile", F.coalesce("to", "profile"))
    return moved.groupBy("asset_id", "profile").agg(F.min_by("vec_id", "moved").alias("vec_id")).select("asset_id", "vec_id")


@query("k7_add_selection_items", f"""WITH {I}, old AS (SELECT * FROM items WHERE position <= 3), new AS (SELECT * FROM items WHERE position IN (2, 5, 6)), m AS (SELECT selection_id, max(position) AS top FROM old GROUP BY 1),
    add AS (SELECT n.selection_id, n.asset_id, top + row_number() OVER (PARTITION BY n.selection_id ORDER BY n.position) AS position FROM new n JOIN m USING (selection_id) WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.selection_id = n.selection_id AND o.asset_id = n.asset_id))
    SELECT selection_id, asset_id, position FROM old UNION ALL SELECT * FROM add""")
def k7(spark, d):
    items = b.selection_items(spark, d).select("selection_id", "asset_id", "position", F.lit(None).cast("double").alias("start_s"), F.lit(None).cast("double").alias("end_s"))
    new = items.filter("position in (2, 5, 6)")
    return sel.add_items(items.filter("position <= 3"), new).select("selection_id", "asset_id", "position")


@query("k8_mark_status", f"WITH {A} SELECT status, count(*) AS n FROM (SELECT CASE WHEN asset_id % 41 = 0 THEN 'missing' ELSE status END AS status FROM assets) GROUP BY status")
def k8(spark, d):
    a = b.assets(spark, d)
    gone = a.filter("asset_id % 41 = 0").select("asset_id").withColumn("gone", F.lit(True))
    return a.join(gone, "asset_id", "left").groupBy(F.when(F.col("gone"), "missing").otherwise(F.col("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("l9_timeline_map", f"WITH {A} SELECT strftime(taken_at, '%Y-%m') AS month, split_part(place, ', ', 3) AS country, count(*) AS n FROM assets WHERE {VISIBLE} AND taken_at IS NOT NULL AND place IS NOT NULL GROUP BY 1, 2")
def l9(spark, d):
    seen = c.scope(b.assets(spark, d)).filter("taken_at is not null and place is not null")
    return seen.groupBy(F.date_format("taken_at", "yyyy-MM").alias("month"), F.element_at(pl.parts(F.col("place")), 3).alias("country")).agg(F.count(F.lit(1)).alias("n"))
