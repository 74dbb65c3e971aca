"""Detections: A9, A10, B9, B10, C2, C3, C7, C15, C17, C21, D1-D3, D21, D25, E5, E11, E16, F5, F7, G3, H24, K2, L3-L8."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import detections as det
from ..operators import search as s
from ..registry import query
from ..sources import bindings as b
from ..sources.staging import small

B, R, P = b.BOXES, b.RUNS, b.PHOTOS
AREA = "greatest(0, x1 - x0) * greatest(0, y1 - y0)"


def iou_sql(a: str, c: str) -> str:
    inter = f"greatest(0, least({a}.x1, {c}.x1) - greatest({a}.x0, {c}.x0)) * greatest(0, least({a}.y1, {c}.y1) - greatest({a}.y0, {c}.y0))"
    size = " + ".join(f"greatest(0, {x}.x1 - {x}.x0) * greatest(0, {x}.y1 - {x}.y0)" for x in (a, c))
    return f"(CASE WHEN {size} - {inter} > 0 THEN {inter} / ({size} - {inter}) ELSE 0 END)"


@query("a9_read_boxes", f"WITH {B} SELECT content_hash, label, score, x0, y0, x1, y1 FROM boxes")
def a9(spark, d):
    j = b.boxes(spark, d).groupBy("content_hash", "label").agg(F.to_json(F.collect_list(F.array(F.col("score").cast("string"), F.to_json(F.array("x0", "y0", "x1", "y1"))))).alias("boxes_json"))
    return det.read_boxes(j)


@query("a10_ground_truth_counts", f"WITH {B}, c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS category FROM (SELECT DISTINCT label FROM boxes)) SELECT content_hash, category, count(*) AS n FROM boxes JOIN c USING (label) GROUP BY 1, 2")
def a10(spark, d):
    boxes = b.boxes(spark, d)
    kinds = boxes.select("label").distinct().withColumn("category", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("label")) - 1)  # a row for each label
    return boxes.join(small(kinds), "label").groupBy("content_hash", F.col("category").cast("long").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("b9_confidence_band", f"WITH {B} SELECT CASE WHEN score >= 0.75 THEN 'sure' WHEN score >= 0.5 THEN 'maybe' ELSE 'dropped' END AS band, count(*) AS n FROM boxes GROUP BY 1")
def b9(spark, d):
    return b.boxes(spark, d).groupBy(det.band(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("b10_boxes_for", f"WITH {B} SELECT box_no, label, score FROM boxes WHERE content_hash IN (1, 2, 3, 4, 5, 6, 7) AND label IN ('A', 'R')")
def b10(spark, d):
    return b.boxes(spark, d).filter(F.col("content_hash").isin(1, 2, 3, 4, 5, 6, 7) & F.col("label").isin("A", "R")).select("box_no", "label", "score")


@query("c2_detection_coverage", f"WITH {P}, {R} SELECT count(*) AS files, count(r.content_hash) AS checked FROM photos LEFT JOIN runs r USING (content_hash)")
def c2(spark, d):
    return det.coverage(b.photos(spark, d), b.detection_runs(spark, d))


@query("c3_assets_join_detections", f"WITH {P}, {B} SELECT library_id, label, count(*) AS n FROM photos JOIN boxes USING (content_hash) GROUP BY 1, 2")
def c3(spark, d):
    return b.photos(spark, d).join(b.boxes(spark, d), "content_hash").groupBy("library_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query("c7_without_corrections", f"WITH {P} SELECT asset_id FROM photos WHERE content_hash NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def c7(spark, d):
    v = b.read(spark, d, "labels").selectExpr("doc_id as content_hash", "1 - toxic as present")
    return det.without_corrections(b.photos(spark, d), v).select("asset_id")


TRUTH = f"{B}, pred AS (SELECT content_hash, box_no, label, score, round(least(1, x0 + 0.02), 4) AS x0, y0, round(least(1, x1 + 0.02), 4) AS x1, y1 FROM boxes WHERE box_no % 3 <> 0)"


def truth(spark, d):
    boxes = b.boxes(spark, d)
    moved = [F.round(F.least(F.lit(1.0), F.col(c) + 0.02), 4).alias(c) for c in ("x0", "x1")]
    return boxes, boxes.filter("box_no % 3 <> 0").select("content_hash", "box_no", "label", "score", moved[0], "y0", moved[1], "y1")


@query("c15_match_boxes", f"""WITH {TRUTH}, m AS (SELECT t.content_hash, t.label, t.box_no, greatest(0, CAST(round(t.x1 * 10000) AS BIGINT) - CAST(round(t.x0 * 10000) AS BIGINT)) * greatest(0, CAST(round(t.y1 * 10000) AS BIGINT) - CAST(round(t.y0 * 10000) AS BIGINT)) AS area FROM boxes t JOIN pred p ON p.content_hash = t.content_hash AND p.label = t.label AND p.score >= 0.75 AND {iou_sql('t', 'p')} >= 0.5),
    r AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY area DESC, box_no, label DESC) AS rn FROM m) SELECT content_hash, label, box_no FROM r WHERE rn = 1""")
def c15(spark, d):
    return det.match_boxes(*truth(spark, d))


@query("c21_boxes_survive", f"""WITH {TRUTH} SELECT t.content_hash, t.label, t.box_no, coalesce(max({iou_sql('t', 'p')}), 0) >= 0.5 AS kept, coalesce(max({iou_sql('t', 'p')}), 0) < 0.3 AS removed
    FROM boxes t LEFT JOIN pred p ON p.content_hash = t.content_hash AND p.label = t.label GROUP BY 1, 2, 3""")
def c21(spark, d):
    return det.survive(*truth(spark, d))


@query("d1_count_objects", f"WITH {B} SELECT content_hash, count(*) FILTER (score >= 0.75) AS n, max(score) AS best FROM boxes WHERE label = 'R' AND score >= 0.5 GROUP BY content_hash")
def d1(spark, d):
    return det.count_objects(b.boxes(spark, d), "R")


@query("d2_object_summary", f"WITH {B} SELECT label, count(DISTINCT content_hash) AS photos, count(*) AS objects FROM boxes WHERE score >= 0.75 GROUP BY label")
def d2(spark, d):
    return det.object_summary(b.boxes(spark, d))


@query("d3_detections_for", f"WITH {B}, {R}, n AS (SELECT content_hash, label, count(*) AS n FROM boxes WHERE score >= 0.75 GROUP BY 1, 2) SELECT r.content_hash, count(label) AS labels, CAST(coalesce(sum(n), 0) AS BIGINT) AS objects FROM runs r LEFT JOIN n USING (content_hash) GROUP BY 1")
def d3(spark, d):
    m = det.detections_for(b.detection_runs(spark, d), b.boxes(spark, d))
    return m.select("content_hash", F.size("counts").cast("long").alias("labels"), F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x).alias("objects"))


PAIR = f"{B}, t AS (SELECT DISTINCT content_hash, label FROM boxes WHERE x0 >= 0.1), p AS (SELECT content_hash, label, max(score) AS top FROM boxes GROUP BY 1, 2)"


def pair(spark, d):
    boxes = b.boxes(spark, d)
    return boxes.filter("x0 >= 0.1").select("content_hash", "label").distinct().withColumn("truth", F.lit(True)), boxes.groupBy("content_hash", "label").agg(F.max("score").alias("top"))


@query("c17_truth_vs_prediction", f"WITH {PAIR}, q AS (SELECT * FROM p WHERE top >= 0.75) SELECT label, count(*) FILTER (t.label IS NOT NULL AND q.label IS NOT NULL) AS tp, count(*) FILTER (t.label IS NULL) AS fp, count(*) FILTER (q.label IS NULL) AS fn FROM t FULL JOIN q USING (content_hash, label) GROUP BY label")
def c17(spark, d):
    t, p = pair(spark, d)
    j = t.join(p.filter("top >= 0.75"), ["content_hash", "label"], "full")
    return j.groupBy("label").agg(F.count_if(F.col("truth") & F.col("top").isNotNull()).alias("tp"), F.count_if(F.col("truth").isNull()).alias("fp"), F.count_if(F.col("top").isNull()).alias("fn"))


@query("d21_detection_pr", f"""WITH {PAIR}, r AS (SELECT unnest([0.5, 0.75, 0.9]) AS rule), j AS (SELECT rule, t.label IS NOT NULL AS truth, coalesce(top, 0) >= rule AS pred FROM t FULL JOIN p USING (content_hash, label), r)
    SELECT CAST(rule AS DOUBLE) AS rule, count(*) FILTER (truth AND pred) / nullif(count(*) FILTER (pred), 0) AS precision, count(*) FILTER (truth AND pred) / nullif(count(*) FILTER (truth), 0) AS recall FROM j GROUP BY rule""")
def d21(spark, d):
    t, p = pair(spark, d)
    j = t.join(p, ["content_hash", "label"], "full").withColumn("rule", F.explode(F.array(*[F.lit(x) for x in (0.5, 0.75, 0.9)])))
    pred, true = F.coalesce("top", F.lit(0.0)) >= F.col("rule"), F.coalesce("truth", F.lit(False))
    return j.groupBy("rule").agg(F.try_divide(F.count_if(true & pred), F.count_if(pred)).alias("precision"), F.try_divide(F.count_if(true & pred), F.count_if(true)).alias("recall"))


@query("d25_edit_quality_rollup", f"""WITH {TRUTH}, g AS (SELECT t.label, coalesce(max({iou_sql('t', 'p')}), 0) AS iou FROM boxes t LEFT JOIN pred p ON p.content_hash = t.content_hash AND p.label = t.label GROUP BY t.content_hash, t.label, t.box_no)
    SELECT label, count(*) FILTER (iou = 0) AS refused, count(*) FILTER (iou > 0) AS edited, round(avg(iou) FILTER (iou > 0), 5) AS mean_iou, round(quantile_cont(iou, 0.5) FILTER (iou > 0), 5) AS median_iou, round(avg(CAST(iou >= 0.5 AS INTEGER)) FILTER (iou > 0), 5) AS good FROM g GROUP BY label""")
def d25(spark, d):
    before, after = truth(spark, d)
    a = det.prefixed(after, "a_", ("content_hash", "label"))
    g = before.join(a, ["content_hash", "label"], "left").groupBy("content_hash", "label", "box_no").agg(F.max(F.when(F.col("a_box_no").isNotNull(), det.iou("", "a_")).otherwise(0.0)).alias("iou"))
    e = F.when(F.col("iou") > 0, F.col("iou"))
    return g.groupBy("label").agg(F.count_if(F.col("iou") == 0).alias("refused"), F.count_if(F.col("iou") > 0).alias("edited"), F.round(F.avg(e), 5).alias("mean_iou"), F.round(F.percentile(e, F.lit(0.5)), 5).alias("median_iou"), F.round(F.avg((e >= 0.5).cast("int")), 5).alias("good"))


RANKED = "ranked AS (SELECT o_orderkey AS asset_id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200)"


def ranked(spark, d):
    top = b.read(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200)
    return s.rank_results(top.select(F.col("o_orderkey").alias("asset_id"), F.col("o_totalprice").alias("similarity")))


@query("e5_object_first", f"""WITH {RANKED}, {B}, f AS (SELECT DISTINCT content_hash AS asset_id FROM boxes WHERE label = 'A' AND score >= 0.75), {R}, m AS (SELECT r.asset_id, rank, CASE WHEN f.asset_id IS NOT NULL THEN 'found' WHEN c.content_hash IS NOT NULL THEN 'not found' ELSE 'not checked' END AS object_check FROM ranked r LEFT JOIN f USING (asset_id) LEFT JOIN runs c ON c.content_hash = r.asset_id)
    SELECT asset_id, object_check, row_number() OVER (ORDER BY object_check <> 'found', rank) AS rank FROM m ORDER BY object_check <> 'found', rank LIMIT 50""")
def e5(spark, d):
    found = b.boxes(spark, d).filter("label = 'A' and score >= 0.75").select(F.col("content_hash").alias("asset_id"))
    checked = b.detection_runs(spark, d).select(F.col("content_hash").alias("asset_id"))
    return s.object_first(ranked(spark, d), found, checked, 50).select("asset_id", "object_check", "rank")


@query("e11_main_object", f"WITH {B}, r AS (SELECT content_hash, label, row_number() OVER (PARTITION BY content_hash ORDER BY greatest(0, CAST(round(x1 * 10000) AS BIGINT) - CAST(round(x0 * 10000) AS BIGINT)) * greatest(0, CAST(round(y1 * 10000) AS BIGINT) - CAST(round(y0 * 10000) AS BIGINT)) DESC, box_no, label DESC) AS rn FROM boxes WHERE score >= 0.75) SELECT content_hash, label FROM r WHERE rn = 1")
def e11(spark, d):
    return det.main_object(b.boxes(spark, d))


@query("e16_example_per_label", f"""WITH {B}, n AS (SELECT label, content_hash, count(*) AS n FROM boxes WHERE score >= 0.75 GROUP BY 1, 2), t AS (SELECT label, count(*) AS photos FROM n GROUP BY 1 ORDER BY photos DESC, label LIMIT 6),
    r AS (SELECT label, photos, content_hash, row_number() OVER (PARTITION BY label ORDER BY n DESC, content_hash) AS rn FROM n JOIN t USING (label)), c AS (SELECT label, photos, list(content_hash ORDER BY rn) AS c FROM r WHERE rn <= 6 GROUP BY 1, 2),
    l AS (SELECT list(c ORDER BY photos DESC, label) AS l, list(label ORDER BY photos DESC, label) AS labels FROM c)
    SELECT unnest(labels) AS label, unnest(list_reduce(list_concat([[l[1][1]]], l[2:]), lambda a, h: list_append(a, list_filter(h, lambda x: NOT list_contains(a, x))[1]))) AS content_hash FROM l""")
def e16(spark, d):
    return det.example_per_label(b.boxes(spark, d))


@query("f7_top_refine", f"WITH {RANKED} SELECT asset_id, rank, rank > 3 AS maybe FROM ranked WHERE rank <= 24")
def f7(spark, d):
    return det.top_refine(ranked(spark, d).filter("rank <= 24")).select("asset_id", "rank", "maybe")


@query("f5_overfetch", f"WITH {RANKED} SELECT count(*) AS n FROM ranked WHERE rank <= greatest(12 * 10, 200)")
def f5(spark, d):
    return ranked(spark, d).filter(F.col("rank") <= max(12 * 10, 200)).agg(F.count(F.lit(1)).alias("n"))


@query("g3_multi_label_union", f"""WITH {B}, n AS (SELECT content_hash, label, max(score) AS best, count(*) FILTER (score >= 0.75) AS n FROM boxes WHERE label IN ('R', 'A') AND score >= 0.5 GROUP BY 1, 2),
    k AS (SELECT content_hash, n = 0 AS maybe, CASE label WHEN 'R' THEN 0 ELSE 1 END AS o, -n AS neg, -best AS negb, row_number() OVER (PARTITION BY content_hash ORDER BY n = 0, CASE label WHEN 'R' THEN 0 ELSE 1 END, -n, -best) AS rn FROM n),
    r AS (SELECT content_hash, maybe, row_number() OVER (PARTITION BY maybe ORDER BY o, neg, negb, content_hash) AS place FROM k WHERE rn = 1) SELECT * FROM r WHERE place <= CASE WHEN maybe THEN 24 ELSE 48 END""")
def g3(spark, d):
    return det.multi_label(b.boxes(spark, d), ["R", "A"])


@query("h24_box_geometry", f"WITH {B} SELECT content_hash, box_no, round({AREA}, 6) AS area, round(greatest(0, least(1, x1 + 0.3)), 4) AS clamped, (x0 + x1) / 2 BETWEEN 0.25 AND 0.75 AND (y0 + y1) / 2 BETWEEN 0.25 AND 0.75 AS centred FROM boxes")
def h24(spark, d):
    mid = [(F.col(f"{c}0") + F.col(f"{c}1")) / 2 for c in "xy"]
    return b.boxes(spark, d).select("content_hash", "box_no", F.round(det.area(), 6).alias("area"), det.clamp(F.col("x1") + 0.3).alias("clamped"), (mid[0].between(0.25, 0.75) & mid[1].between(0.25, 0.75)).alias("centred"))


@query("k2_replace_detections", f"WITH {B} SELECT content_hash, label, count(*) AS n FROM boxes WHERE content_hash % 10 <> 0 OR label = 'N' GROUP BY 1, 2")
def k2(spark, d):
    from ..operators.catalog import replace_keys

    boxes = b.boxes(spark, d)
    new = boxes.filter("content_hash % 10 = 0 and label = 'N'")
    looked = boxes.filter("content_hash % 10 = 0").select("content_hash").distinct()
    old = boxes.join(looked, "content_hash", "left_anti").select(*boxes.columns)
    return replace_keys(old, new, ["content_hash"]).groupBy("content_hash", "label").agg(F.count(F.lit(1)).alias("n"))


@query("l3_count_query", f"""WITH {P}, {R}, {B}, ok AS (SELECT * FROM photos WHERE taken_at >= TIMESTAMP '1996-01-01' AND taken_at < TIMESTAMP '1998-01-01' AND content_hash NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
    n AS (SELECT content_hash, count(*) FILTER (score >= 0.75) AS n FROM boxes WHERE label = 'R' AND score >= 0.5 GROUP BY 1)
    SELECT count(*) AS files, count(r.content_hash) AS checked, count(*) FILTER (n > 0) AS photos, CAST(coalesce(sum(n), 0) AS BIGINT) AS objects, count(*) FILTER (n = 0) AS maybe FROM ok LEFT JOIN runs r USING (content_hash) LEFT JOIN n USING (content_hash)""")
def l3(spark, d):
    v = b.read(spark, d, "labels").selectExpr("doc_id as content_hash", "1 - toxic as present")
    ok = det.without_corrections(b.photos(spark, d).filter("taken_at >= timestamp_ntz'1996-01-01' and taken_at < timestamp_ntz'1998-01-01'"), v)
    runs = b.detection_runs(spark, d).select("content_hash", F.lit(True).alias("seen"))
    n = det.count_objects(b.boxes(spark, d), "R").select("content_hash", "n")
    return ok.join(runs, "content_hash", "left").join(n, "content_hash", "left").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("seen")).alias("checked"), F.count_if(F.col("n") > 0).alias("photos"), F.coalesce(F.sum("n"), F.lit(0)).alias("objects"), F.count_if(F.col("n") == 0).alias("maybe"))


@query("l4_boosted_search", f"""WITH {RANKED}, {B}, n AS (SELECT content_hash AS asset_id, count(*) FILTER (score >= 0.75) AS n FROM boxes WHERE label = 'N' AND score >= 0.5 GROUP BY 1)
    SELECT asset_id, row_number() OVER (ORDER BY CASE WHEN n > 0 THEN 0 WHEN n = 0 THEN 1 ELSE 2 END, rank) AS place FROM ranked LEFT JOIN n USING (asset_id) WHERE rank <= 120""")
def l4(spark, d):
    n = det.count_objects(b.boxes(spark, d), "N").select(F.col("content_hash").alias("asset_id"), "n")
    return boosted(ranked(spark, d).filter("rank <= 120"), n)


def boosted(hits, n):
    from pyspark.sql import Window

    order = F.when(F.col("n") > 0, 0).when(F.col("n") == 0, 1).otherwise(2)
    return hits.join(n, "asset_id", "left").select("asset_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order, "rank")).alias("place"))


@query("l5_refine", f"WITH {RANKED}, {B} SELECT asset_id, rank FROM ranked WHERE asset_id IN (SELECT content_hash FROM boxes WHERE label = 'A' AND score >= 0.75) AND asset_id IN (SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1997)")
def l5(spark, d):
    label = b.boxes(spark, d).filter("label = 'A' and score >= 0.75").select(F.col("content_hash").alias("asset_id"))
    when = b.read(spark, d, "orders").filter("year(o_orderdate) = 1997").select(F.col("o_orderkey").alias("asset_id"))
    return ranked(spark, d).join(label, "asset_id", "left_semi").join(when, "asset_id", "left_semi").select("asset_id", "rank")


@query("l6_library_summary", f"WITH {P}, {B} SELECT library_id, label, count(DISTINCT content_hash) AS photos, count(*) AS objects FROM photos JOIN boxes USING (content_hash) WHERE score >= 0.75 GROUP BY 1, 2")
def l6(spark, d):
    per = b.photos(spark, d).join(b.boxes(spark, d).filter(F.col("score") >= det.SURE), "content_hash").groupBy("library_id", "label", "content_hash").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("library_id", "label").agg(F.count(F.lit(1)).alias("photos"), F.sum("n").alias("objects"))


@query("l7_evidence", f"WITH {B} SELECT content_hash, count(*) AS boxes, max(score) AS best, round(max({AREA}), 6) AS largest, max({AREA}) < 0.02 AS small FROM boxes WHERE label = 'A' AND score >= 0.5 GROUP BY 1")
def l7(spark, d):
    e = b.boxes(spark, d).filter("label = 'A' and score >= 0.5").groupBy("content_hash")
    return e.agg(F.count(F.lit(1)).alias("boxes"), F.max("score").alias("best"), F.round(F.max(det.area()), 6).alias("largest"), (F.max(det.area()) < 0.02).alias("small"))


@query("l8_apply_corrections", f"WITH {RANKED} SELECT asset_id, rank FROM ranked WHERE rank NOT IN (2, 5, 7)")
def l8(spark, d):
    shown = ranked(spark, d)
    wrong = shown.filter(F.col("rank").isin(2, 5, 7)).select(F.col("asset_id").alias("content_hash"), F.lit(0).alias("present"))
    return det.without_corrections(shown.withColumn("content_hash", F.col("asset_id")), wrong).select("asset_id", "rank")
