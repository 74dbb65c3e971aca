"""Vector search: B5, B7, B12, B15, C1, C12-C14, C20, D22, D23, D29, E1-E4, E6, E7, F1-F3, F8, H20, H21, L1, L2."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2_norm, l2_normalize, truncate_dim
from ..operators import evaluation as ev
from ..operators import lookalikes
from ..operators import search as s
from ..operators.blocks import quantiles
from ..registry import query
from ..sources import bindings as b
from ..sources.staging import staged


def query_vector(vectors, asset_id: int = 0):
    """The vector of one asset as a table of one row, or of none."""
    return vectors.filter(F.col("asset_id") == asset_id).select("vector")


Q0 = "q AS (SELECT vector AS qv FROM vectors WHERE asset_id = 0)"
V, S = b.VECTORS, b.SEGMENTS


@query("f1_cosine_topk", f"""WITH {V}, {Q0}, s AS (SELECT asset_id, library_id, list_dot_product(vector, qv) AS x FROM vectors, q WHERE asset_id <> 0 AND library_id IN (1, 2, 3, 4))
    SELECT asset_id, round(x, 5) AS similarity, row_number() OVER (ORDER BY x DESC, asset_id) AS rank FROM s ORDER BY x DESC, asset_id LIMIT 10""")
def f1(spark, d):
    v = b.vectors(spark, d)
    hits = s.cosine_topk(v.filter(F.col("library_id").isin(1, 2, 3, 4) & (F.col("asset_id") != 0)), query_vector(v), 10)
    return s.rank_results(hits).select("asset_id", F.round("similarity", 5).alias("similarity"), "rank")


@query("f2_batch_topk", f"""WITH {V}, p AS (SELECT a.asset_id AS query_id, v.asset_id, list_dot_product(a.vector, v.vector) AS x FROM vectors a, vectors v WHERE a.asset_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, asset_id) AS rank FROM p) SELECT query_id, asset_id, round(x, 5) AS similarity, rank FROM r WHERE rank <= 10""")
def f2(spark, d):
    v = b.vectors(spark, d)
    q = v.filter("asset_id % 100 = 0").select(F.col("asset_id").alias("query_id"), "vector")
    return s.batch_topk(q, v, 10).withColumn("similarity", F.round("similarity", 5))


@query("b5_restrict_exclude", f"WITH {V} SELECT asset_id FROM vectors WHERE library_id = 3 AND asset_id % 7 <> 0")
def b5(spark, d):
    v = b.vectors(spark, d)
    return s.exclude(s.restrict(v, v.filter("library_id = 3")), v.filter("asset_id % 7 = 0")).select("asset_id")


@query("b7_searchable", f"WITH {V}, {b.ASSETS} SELECT v.asset_id, len(vector) AS dim FROM vectors v JOIN assets a USING (asset_id) WHERE status = 'indexed' AND a.library_id IN (0, 1)")
def b7(spark, d):
    return s.searchable(b.vectors(spark, d), b.assets(spark, d), [0, 1]).select("asset_id", F.size("vector").cast("long").alias("dim"))


@query("b12_validate_vectors", f"WITH {V} SELECT count(*) AS n, count(*) FILTER (len(vector) = 64 AND sqrt(list_dot_product(vector, vector)) > 0) AS valid FROM vectors")
def b12(spark, d):
    v = b.vectors(spark, d)
    return v.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(s.valid_vectors(v, 64).agg(F.count(F.lit(1)).alias("valid"))))


@query("b15_asset_vectors", f"WITH {S} SELECT embedding_id, segment_index FROM segments WHERE asset_id = 7")
def b15(spark, d):
    return b.segments(spark, d).filter("asset_id = 7").orderBy("segment_index").select("embedding_id", "segment_index")


@query("c1_embeddings_join_assets", f"WITH {V}, {b.ASSETS} SELECT media_type, count(*) AS n FROM vectors JOIN assets USING (asset_id) GROUP BY media_type")
def c1(spark, d):
    return b.vectors(spark, d).select("asset_id").join(b.assets(spark, d), "asset_id").groupBy("media_type").agg(F.count(F.lit(1)).alias("n"))


PAIRS = "pairs AS (SELECT x.asset_id AS a, y.asset_id AS b, list_dot_product(x.vector, y.vector) AS s FROM vectors x JOIN vectors y ON x.asset_id < y.asset_id)"


@query("c12_similarity_self_join", f"WITH {V}, {PAIRS} SELECT a, b, round(s, 5) AS similarity FROM pairs WHERE s >= 0.4")
def c12(spark, d):
    return s.similarity_self_join(b.vectors(spark, d), 0.4).withColumn("similarity", F.round("similarity", 5))


@query("c13_segment_overlap", f"""WITH {S} SELECT x.embedding_id AS a, y.embedding_id AS b, greatest(0, least(x.end_s, y.end_s) - greatest(x.start_s, y.start_s)) / greatest(1e-9, least(x.end_s - x.start_s, y.end_s - y.start_s)) AS overlap
    FROM segments x JOIN segments y ON x.asset_id = y.asset_id AND x.segment_index < y.segment_index""")
def c13(spark, d):
    seg = b.segments(spark, d).select("embedding_id", "asset_id", "segment_index", F.struct("start_s", "end_s").alias("w"))
    o = seg.select(F.col("embedding_id").alias("eb"), "asset_id", F.col("segment_index").alias("ib"), F.col("w").alias("wb"))
    return seg.join(o, "asset_id").filter("segment_index < ib").select(F.col("embedding_id").alias("a"), F.col("eb").alias("b"), s.overlap_fraction(F.col("w"), F.col("wb")).alias("overlap"))


@query("c14_window_at", f"""WITH {S}, m AS (SELECT DISTINCT asset_id, CAST(asset_id % 40 AS DOUBLE) AS t FROM segments),
    r AS (SELECT m.asset_id, t, segment_index, row_number() OVER (PARTITION BY m.asset_id, t ORDER BY NOT (start_s <= t AND t < end_s), abs(start_s - t), segment_index) AS rn FROM m JOIN segments USING (asset_id))
    SELECT asset_id, t, segment_index FROM r WHERE rn = 1""")
def c14(spark, d):
    seg = b.segments(spark, d)
    return s.window_at(seg, seg.select("asset_id", (F.col("asset_id") % 40).cast("double").alias("t")).distinct())


@query("c20_score", f"WITH {V}, {Q0} SELECT asset_id, round(list_dot_product(vector, qv), 5) AS similarity FROM vectors, q")
def c20(spark, d):
    v = b.vectors(spark, d)
    return s.score(v, query_vector(v)).select("asset_id", F.round("similarity", 5).alias("similarity"))


@query("d22_threshold_sweep", f"""WITH {V}, {PAIRS}, pair2 AS (SELECT a AS i, s, a % 5 = b % 5 AS copy FROM pairs UNION ALL SELECT b, s, a % 5 = b % 5 FROM pairs),
    best AS (SELECT i, max(s) FILTER (copy) AS copy_s, max(s) FILTER (NOT copy) AS false_s FROM pair2 GROUP BY i), t AS (SELECT unnest([0.2, 0.3, 0.4]) AS threshold)
    SELECT CAST(threshold AS DOUBLE) AS threshold, avg(CAST(copy_s >= threshold AS INTEGER)) AS found, avg(CAST(false_s >= threshold AS INTEGER)) AS wrong FROM best, t GROUP BY threshold""")
def d22(spark, d):
    best = s.best_by_group(b.vectors(spark, d).withColumn("copies", F.expr("asset_id % 5")), "copies")
    t = best.withColumn("threshold", F.explode(F.array(F.lit(0.2), F.lit(0.3), F.lit(0.4))))
    return t.groupBy("threshold").agg(F.avg((F.col("same") >= F.col("threshold")).cast("int")).alias("found"), F.avg((F.col("other") >= F.col("threshold")).cast("int")).alias("wrong"))


@query("d22_similarity_quantiles", f"""WITH {V}, {PAIRS}, pair2 AS (SELECT a AS i, s, a % 5 = b % 5 AS copy FROM pairs UNION ALL SELECT b, s, a % 5 = b % 5 FROM pairs), best AS (SELECT i, max(s) FILTER (NOT copy) AS s FROM pair2 GROUP BY i), q AS (SELECT unnest([0.5, 0.9, 0.99, 1.0]) AS quantile)
    SELECT CAST(quantile AS DOUBLE) AS quantile, round(CASE quantile WHEN 0.5 THEN (SELECT quantile_cont(s, 0.5) FROM best) WHEN 0.9 THEN (SELECT quantile_cont(s, 0.9) FROM best) WHEN 0.99 THEN (SELECT quantile_cont(s, 0.99) FROM best) ELSE (SELECT max(s) FROM best) END, 5) AS similarity FROM q""")
def d22b(spark, d):
    """Linear quantiles of the nearest vector of another group."""
    best = s.best_by_group(b.vectors(spark, d).withColumn("copies", F.expr("asset_id % 5")), "copies")
    at = [0.5, 0.9, 0.99, 1.0]
    found = quantiles(best, [], "other", at)
    return found.select(F.posexplode("q").alias("k", "x")).select(F.get(F.array(*map(F.lit, at)), F.col("k")).alias("quantile"), F.round("x", 5).alias("similarity"))


@query("d23_variant_agreement", f"""WITH {V}, t AS (SELECT asset_id, list_dot_product(vector, vector[1:32] || list_transform(vector[33:64], lambda x: 0.0)) / sqrt(list_dot_product(vector[1:32], vector[1:32])) AS c FROM vectors)
    SELECT round(avg(c), 6) AS mean_cosine, round(min(c), 6) AS min_cosine FROM t""")
def d23(spark, d):
    half = F.concat(truncate_dim("vector", 32), F.array_repeat(F.lit(0.0), 32))
    t = b.vectors(spark, d).select(dot("vector", half).alias("c"))
    return t.agg(F.round(F.avg("c"), 6).alias("mean_cosine"), F.round(F.min("c"), 6).alias("min_cosine"))


@query("d28_stored_window_check", f"WITH {S} SELECT asset_id, count(*) AS n, bool_and(list_dot_product(vector, vector) / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(vector, vector))) > 0.98) AS same FROM segments GROUP BY asset_id")
def d28(spark, d):
    seg = b.segments(spark, d)
    again = seg.select("embedding_id", l2_normalize("vector").alias("fresh"))
    c = dot("vector", "fresh") / l2_norm("vector")
    return seg.join(again, "embedding_id").groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(c > 0.98).alias("same"))


@query("d29_candidates_searched", f"WITH {V}, {b.ASSETS} SELECT count(*) AS candidates FROM vectors v JOIN assets a USING (asset_id) WHERE status = 'indexed' AND media_type IN ('image', 'video')")
def d29(spark, d):
    return s.searchable(b.vectors(spark, d), b.assets(spark, d).filter(F.col("media_type").isin("image", "video"))).agg(F.count(F.lit(1)).alias("candidates"))


HITS = f"{S}, {V}, {Q0}, hits AS (SELECT embedding_id, segments.asset_id, segment_index, start_s, end_s, list_dot_product(segments.vector, qv) AS x FROM segments, q)"


def hits(spark, d):
    return s.score(b.segments(spark, d), query_vector(b.vectors(spark, d)))


@query("e1_rank_results", f"WITH {HITS} SELECT embedding_id, round(x, 5) AS similarity, row_number() OVER (ORDER BY x DESC, embedding_id) AS rank FROM hits ORDER BY x DESC, embedding_id LIMIT 50")
def e1(spark, d):
    top = hits(spark, d).orderBy(F.desc("similarity"), "embedding_id").limit(50)
    return s.rank_results(top, "embedding_id").select("embedding_id", F.round("similarity", 5).alias("similarity"), "rank")


@query("e2_best_window_per_asset", f"WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY x DESC, embedding_id) AS rn FROM hits) SELECT asset_id, embedding_id, round(x, 5) AS similarity FROM r WHERE rn = 1")
def e2(spark, d):
    return s.best_window_per_asset(hits(spark, d)).select("asset_id", "embedding_id", F.round("similarity", 5).alias("similarity"))


@query("e3_group_hits", f"""WITH {HITS}, o AS (SELECT asset_id, list([segment_index] ORDER BY x DESC, embedding_id) AS l, max(x) AS top FROM hits GROUP BY 1),
    k AS (SELECT asset_id, len(l) AS n, top, list_reduce(l, lambda a, h: CASE WHEN len(list_filter(a, lambda s: abs(s - h[1]) < 2)) = 0 THEN list_concat(a, h) ELSE a END) AS kept FROM o)
    SELECT asset_id, asset_id * 5 + kept[1] AS best, list_transform(kept[2:], lambda s: asset_id * 5 + s) AS others, CAST(n - len(kept) AS INTEGER) AS suppressed FROM k ORDER BY top DESC, best LIMIT 40""")
def e3(spark, d):
    return s.group_hits(hits(spark, d), 40).select("asset_id", F.col("best.embedding_id").alias("best"), F.transform("others", lambda o: o["embedding_id"]).alias("others"), "suppressed")


@query("e3_group_hits_no_extra", f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY x DESC, embedding_id) AS rn FROM hits)
    SELECT asset_id, embedding_id AS best, 0 AS suppressed FROM r WHERE rn = 1 ORDER BY x DESC, embedding_id LIMIT 40""")
def e3b(spark, d):
    return s.group_hits(hits(spark, d), 40, max_extra=0).select("asset_id", F.col("best.embedding_id").alias("best"), "suppressed")


TYPED = f"{V}, {Q0}, {b.ASSETS}, t AS (SELECT asset_id, media_type, list_dot_product(vector, qv) AS x FROM vectors JOIN assets USING (asset_id), q WHERE status = 'indexed')"


def typed(spark, d):
    v = b.vectors(spark, d)
    a = b.assets(spark, d).filter("status = 'indexed'").select("asset_id", "media_type")
    return s.score(v, query_vector(v)).join(a, "asset_id")


@query("e4_per_type_rank", f"WITH {TYPED}, r AS (SELECT *, row_number() OVER (PARTITION BY media_type ORDER BY x DESC, asset_id) AS rank FROM t) SELECT asset_id, media_type, rank FROM r WHERE rank <= 8")
def e4(spark, d):
    return s.rank_results(typed(spark, d), by="media_type", keep=8).select("asset_id", "media_type", "rank")


@query("e4_global_rank", f"WITH {TYPED} SELECT asset_id, media_type, row_number() OVER (ORDER BY x DESC, asset_id) AS rank FROM t ORDER BY x DESC, asset_id LIMIT 12")
def e4b(spark, d):
    top = typed(spark, d).orderBy(F.desc("similarity"), "asset_id").limit(12)
    return s.rank_results(top).select("asset_id", "media_type", "rank")


@query("g1_union_by_media_type", f"WITH {TYPED}, r AS (SELECT *, row_number() OVER (PARTITION BY media_type ORDER BY x DESC, asset_id) AS rank FROM t) SELECT media_type, count(*) AS n FROM r WHERE rank <= 8 GROUP BY media_type")
def g1(spark, d):
    t = typed(spark, d)
    parts = [s.rank_results(t.filter(F.col("media_type") == m), keep=8) for m in ("image", "video", "audio")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("media_type").agg(F.count(F.lit(1)).alias("n"))


@query("g1_union_ranked", f"WITH {TYPED}, r AS (SELECT *, row_number() OVER (PARTITION BY media_type ORDER BY x DESC, asset_id) AS rank FROM t) SELECT media_type, asset_id, round(x, 5) AS similarity, rank FROM r WHERE rank <= 8")
def g1_ranked(spark, d):
    """The rankings of each media type, one below the other."""
    t = typed(spark, d)
    parts = [s.rank_results(t.filter(F.col("media_type") == m), keep=8) for m in ("image", "video", "audio")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("media_type", "asset_id", F.round("similarity", 5).alias("similarity"), "rank")


@query("e7_nearest_other", f"""WITH {V}, {PAIRS}, pair2 AS (SELECT a AS i, b AS j, s FROM pairs UNION ALL SELECT b, a, s FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS rn FROM pair2 WHERE s <= 0.9999)
    SELECT i AS asset_id, j AS nearest, round(s, 5) AS similarity FROM r WHERE rn = 1""")
def e7(spark, d):
    v = b.vectors(spark, d)
    top = s.batch_topk(v.select(F.col("asset_id").alias("query_id"), "vector"), v, 1, others_to=0.9999)
    return top.select(F.col("query_id").alias("asset_id"), F.col("asset_id").alias("nearest"), F.round("similarity", 5).alias("similarity"))


@query("f3_rank_within", f"WITH {V}, {Q0}, ids AS (SELECT event_id AS asset_id FROM events) SELECT asset_id, round(coalesce(list_dot_product(vector, qv), -2), 5) AS similarity FROM ids LEFT JOIN vectors USING (asset_id), q")
def f3(spark, d):
    v = b.vectors(spark, d)
    ids = b.read(spark, d, "events").select(F.col("event_id").alias("asset_id"))
    return s.rank_within(ids, v, query_vector(v)).select("asset_id", F.round("similarity", 5).alias("similarity"))


@query("f8_video_moments", f"WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY x DESC, embedding_id) AS rn FROM hits) SELECT asset_id, segment_index FROM r WHERE rn = 1 ORDER BY x DESC, embedding_id LIMIT 4")
def f8(spark, d):
    return s.best_window_per_asset(hits(spark, d), 4).select("asset_id", "segment_index")


@query("h20_norms", f"WITH {V} SELECT asset_id, round(sqrt(list_dot_product(vector, vector)), 5) AS norm FROM vectors")
def h20(spark, d):
    return b.vectors(spark, d).select("asset_id", F.round(l2_norm("vector"), 5).alias("norm"))


@query("h21_truncate_dim", f"WITH {V} SELECT asset_id, round(vector[1] / sqrt(list_dot_product(vector[1:16], vector[1:16])), 5) AS first FROM vectors")
def h21(spark, d):
    return b.vectors(spark, d).select("asset_id", F.round(truncate_dim("vector", 16)[0], 5).alias("first"))


@query("g7_topk_overlap", f"""WITH {V}, p AS (SELECT a.asset_id AS q, v.asset_id, list_dot_product(a.vector, v.vector) AS x, list_dot_product(a.vector[1:32], v.vector[1:32]) / sqrt(list_dot_product(v.vector[1:32], v.vector[1:32])) AS y
    FROM vectors a, vectors v WHERE a.asset_id % 100 = 0), r AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY x DESC, asset_id) AS rx, row_number() OVER (PARTITION BY q ORDER BY y DESC, asset_id) AS ry FROM p)
    SELECT q AS query_id, count(*) FILTER (rx <= 10 AND ry <= 10) AS common FROM r GROUP BY q""")
def g7(spark, d):
    v = b.vectors(spark, d)
    small = v.withColumn("vector", truncate_dim("vector", 32))
    tops = [s.batch_topk(x.filter("asset_id % 100 = 0").select(F.col("asset_id").alias("query_id"), "vector"), x, 10).groupBy("query_id").agg(F.collect_set("asset_id").alias(n)) for x, n in ((v, "a"), (small, "b"))]
    return tops[0].join(tops[1].hint("merge"), "query_id").select("query_id", F.size(F.array_intersect("a", "b")).cast("long").alias("common"))


@query("e6_rank_of_truth", f"""WITH {V}, p AS (SELECT c.asset_id AS caption, w.asset_id // 5 AS clip, max(list_dot_product(c.vector, w.vector)) AS x FROM vectors c, vectors w WHERE c.asset_id % 5 = 0 AND w.asset_id % 5 <> 0 GROUP BY 1, 2),
    r AS (SELECT *, rank() OVER (PARTITION BY caption ORDER BY x DESC) AS rank FROM p) SELECT caption, rank FROM r WHERE clip = caption // 5""")
def e6(spark, d):
    return caption_ranks(spark, d)


def caption_ranks(spark, d):
    """Rank of the right clip for each caption: 1 + clips that are strictly better, by the best window of a clip."""
    v = b.vectors(spark, d)
    captions = v.filter("asset_id % 5 = 0").selectExpr("asset_id as query", "asset_id div 5 as truth", "vector")
    return s.rank_of_truth(captions, v.filter("asset_id % 5 <> 0").selectExpr("asset_id div 5 as grp", "vector")).withColumnRenamed("query", "caption")


@query("d19_caption_retrieval", f"""WITH {V}, p AS (SELECT c.asset_id AS caption, w.asset_id // 5 AS clip, max(list_dot_product(c.vector, w.vector)) AS x FROM vectors c, vectors w WHERE c.asset_id % 5 = 0 AND w.asset_id % 5 <> 0 GROUP BY 1, 2),
    r AS (SELECT *, rank() OVER (PARTITION BY caption ORDER BY x DESC) AS rank FROM p), t AS (SELECT caption, rank FROM r WHERE clip = caption // 5)
    SELECT avg(CAST(rank <= 1 AS INTEGER)) AS r1, avg(CAST(rank <= 5 AS INTEGER)) AS r5, avg(CAST(rank <= 10 AS INTEGER)) AS r10, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS map10, quantile_cont(rank, 0.5) AS median_rank, 10.0 / count(*) AS chance FROM t""")
def d19(spark, d):
    t = staged(caption_ranks(spark, d))
    within = [F.avg((F.col("rank") <= k).cast("int")).alias(f"r{k}") for k in (1, 5, 10)]
    return t.agg(*within, F.round(F.avg(F.when(F.col("rank") <= 10, 1 / F.col("rank")).otherwise(0.0)), 6).alias("map10"), (F.lit(10.0) / F.count(F.lit(1))).alias("chance")).crossJoin(F.broadcast(quantiles(t, [], "rank", [0.5]).select(F.col("q")[0].alias("median_rank"))))  # one row each


@query("d20_bootstrap_ci")
def d20(spark, d):
    """95 % interval of R@10 over clips drawn again with replacement."""
    return ev.bootstrap_ci(caption_ranks(spark, d).select(F.col("caption").alias("id"), (F.col("rank") <= 10).cast("int").alias("value")))


@query("l1_search_text", f"""WITH {V}, {b.ASSETS}, {Q0}, ok AS (SELECT asset_id, library_id AS lib FROM assets WHERE status = 'indexed' AND media_type = 'image' AND live_photo IS NULL AND taken_at >= TIMESTAMP '2024-01-01' AND taken_at < TIMESTAMP '2024-01-09'),
    s AS (SELECT asset_id, list_dot_product(vector, qv) AS x FROM vectors JOIN ok USING (asset_id), q) SELECT asset_id, round(x, 5) AS similarity, row_number() OVER (ORDER BY x DESC, asset_id) AS rank FROM s ORDER BY x DESC, asset_id LIMIT 20""")
def l1(spark, d):
    from ..operators.catalog import MediaFilter, scope

    v, a = b.vectors(spark, d), b.assets(spark, d)
    ok = scope(a, when=MediaFilter(ranges=[("2024-01-01", "2024-01-09")]))
    return s.rank_results(s.cosine_topk(s.searchable(v, ok), query_vector(v), 20)).select("asset_id", F.round("similarity", 5).alias("similarity"), "rank")


@query("l2_cross_modal", f"WITH {TYPED}, r AS (SELECT *, row_number() OVER (PARTITION BY media_type ORDER BY x DESC, asset_id) AS rank FROM t WHERE asset_id <> 0) SELECT media_type, asset_id, rank, media_type <> 'image' AS experimental FROM r WHERE rank <= 5")
def l2(spark, d):
    t = typed(spark, d).filter("asset_id <> 0")
    return s.rank_results(t, by="media_type", keep=5).select("media_type", "asset_id", "rank", (F.col("media_type") != "image").alias("experimental"))


@query("j1_embed_with_fallback", "SELECT doc_id, 64 AS dim, CAST(1.0 AS DOUBLE) AS norm, CAST(NULL AS VARCHAR) AS error FROM documents")
def j1(spark, d):
    docs = b.read(spark, d, "documents").selectExpr("doc_id", "text")
    return s.encode(docs, s.hash_encoder, "text", "doc_id").select("doc_id", F.size("vector").alias("dim"), F.round(l2_norm("vector"), 5).alias("norm"), "error")


#: Photos by falling degree, then id, each with its neighbours; one row of `steps` for each photo that is visited.
STARS = f"""WITH RECURSIVE {V}, {PAIRS}, near AS (SELECT a, b, s FROM pairs WHERE s >= {{least}}), edges AS (SELECT a AS u, b AS v, s FROM near UNION ALL SELECT b, a, s FROM near), visits AS (SELECT u, list(v ORDER BY v) AS vs, row_number() OVER (ORDER BY count(*) DESC, u) AS k FROM edges GROUP BY u),
    steps AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS leader, CAST([] AS BIGINT[]) AS members, CAST([] AS BIGINT[]) AS taken UNION ALL
        SELECT k, CASE WHEN len(members) > 0 THEN u END AS leader, members, CASE WHEN len(members) > 0 THEN list_concat(taken, members, [u]) ELSE taken END AS taken
        FROM (SELECT v.k, u, taken, CASE WHEN list_contains(taken, u) THEN CAST([] AS BIGINT[]) ELSE list_filter(vs, lambda x: NOT list_contains(taken, x)) END AS members FROM steps s JOIN visits v ON v.k = s.k + 1)),
    stars AS (SELECT leader, unnest(members) AS member FROM steps WHERE leader IS NOT NULL)"""


@query("l10_lookalikes", STARS.format(least=0.3) + " SELECT leader, member, round(s, 5) AS similarity FROM stars JOIN edges ON u = leader AND v = member")
def l10(spark, d):
    return lookalikes.stars_of(b.vectors(spark, d), 0.3, spark)


@query("l10_lookalike_pairs", f"WITH {V}, {PAIRS} SELECT a, b FROM pairs WHERE s >= 0.3")
def l10b(spark, d):
    return s.similarity_self_join(b.vectors(spark, d), 0.3).select("a", "b")


@query("e9_best_shot", f"""WITH {b.BOXES}, g AS (SELECT content_hash, box_no, score AS sharpness, round((x1 - x0) * (y1 - y0), 6) AS pixels FROM boxes), t AS (SELECT *, max(sharpness) OVER (PARTITION BY content_hash) AS top FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY pixels DESC, sharpness DESC, box_no) AS rn FROM t WHERE sharpness >= 0.9 * top) SELECT content_hash, box_no AS best FROM r WHERE rn = 1""")
def e9(spark, d):
    shots = b.boxes(spark, d).selectExpr("content_hash as grp", "box_no as id", "score as sharpness", "round((x1 - x0) * (y1 - y0), 6) as pixels")
    return lookalikes.best_shot(shots).select(F.col("grp").alias("content_hash"), F.col("id").alias("best"))


@query("e10_group_budget", f"""WITH {b.HASHED}, g AS (SELECT content_hash, count(*) AS n, min(asset_id) AS first FROM hashed GROUP BY content_hash HAVING count(*) > 1),
    r AS (SELECT *, sum(n) OVER (ORDER BY n DESC, first ROWS UNBOUNDED PRECEDING) AS total FROM g) SELECT content_hash, n FROM r WHERE total <= 60""")
def e10(spark, d):
    g = b.hashed_assets(spark, d).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("asset_id").alias("first")).filter("n > 1")
    return lookalikes.group_budget(g, 60).select("content_hash", "n")


@query("d26_group_identical", f"WITH {b.HASHED} SELECT library_id, count(DISTINCT content_hash) = 1 AS identical FROM hashed GROUP BY library_id")
def d26(spark, d):
    return b.hashed_assets(spark, d).groupBy("library_id").agg((F.count_distinct("content_hash") == 1).alias("identical"))
