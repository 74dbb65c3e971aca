"""Evaluation: A7, A8, D13-D18, D24, D27, H29, L11."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators.blocks import numbered
from ..registry import query
from ..sources import bindings as b
from ..sources.staging import staged

J = b.JUDGED
HIT = "SELECT query, CASE WHEN bool_or(rank <= {k} AND grade > 0) THEN 1.0 WHEN bool_and(grade IS NOT NULL) FILTER (rank <= {k}) THEN 0.0 END AS value FROM judged GROUP BY query"
RECALL = "SELECT query, CASE WHEN bool_and(grade IS NOT NULL) AND count(*) FILTER (grade > 0) > 0 THEN count(*) FILTER (grade > 0 AND rank <= {k}) / count(*) FILTER (grade > 0) END AS value FROM pool GROUP BY query"
#: The pool of a query: its ranked candidates that a modulus keeps, so that some pools are fully judged.
POOL = "pool AS (SELECT query, candidate, rank, grade FROM judged WHERE grade IS NOT NULL OR substr(query, 4)::INT % 3 = 0)"
NDCG = """SELECT query, CASE WHEN o.judged AND i.judged AND idcg > 0 THEN dcg / idcg END AS value FROM (SELECT query, bool_and(grade IS NOT NULL) AS judged, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM own WHERE rank <= 10 GROUP BY query) o JOIN
    (SELECT query, bool_and(grade IS NOT NULL) AS judged, sum(CASE WHEN i <= 10 THEN (pow(2, grade) - 1) / log2(i + 1) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC NULLS LAST, candidate) AS i FROM pool) GROUP BY query) i USING (query)"""
OWN = "own AS (SELECT query, candidate, grade, row_number() OVER (PARTITION BY query ORDER BY rank) AS rank FROM pool)"


def pool(judged):
    return judged.filter("grade is not null or cast(substr(query, 4) as int) % 3 = 0")


def own(p):
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank")))


@query("a7_captions_long", "SELECT p_partkey AS clip, unnest(string_split(p_name, ' ')) AS caption FROM part")
def a7(spark, d):
    return b.read(spark, d, "part").select(F.col("p_partkey").alias("clip"), F.explode(F.filter(F.split("p_name", " "), lambda s: F.trim(s) != "")).alias("caption"))


@query("a8_read_judgements", f"WITH {J} SELECT query, candidate, grade FROM judged WHERE grade IS NOT NULL")
def a8(spark, d):
    """Judgements as a JSON map for each query, read back as rows; null: unknown is left out."""
    maps = b.judged(spark, d).filter("grade is not null").groupBy("query").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("candidate").cast("string"), "grade")))).alias("json"))
    return maps.select("query", F.explode(F.from_json("json", "map<string,int>")).alias("candidate", "grade")).withColumn("candidate", F.col("candidate").cast("long"))


@query("d13_hit_at_k", f"WITH {J} {HIT.format(k=5)}")
def d13(spark, d):
    return ev.hit_at_k(b.judged(spark, d), 5)


@query("d14_recall_at_k", f"WITH {J}, {POOL} {RECALL.format(k=20)}")
def d14(spark, d):
    p = pool(b.judged(spark, d))
    return ev.recall_at_k(p, p, 20)


@query("d15_ndcg_at_k", f"WITH {J}, {POOL}, {OWN}, n AS ({NDCG}) SELECT query, round(value, 6) AS value FROM n")
def d15(spark, d):
    return ev.ndcg_at_k(own(p := pool(b.judged(spark, d))), p, 10).withColumn("value", F.round("value", 6))


@query("d16_metric_aggregate", f"WITH {J}, h AS ({HIT.format(k=1)}) SELECT round(avg(value), 4) AS mean, count(value) AS n, count(*) - count(value) AS excluded FROM h")
def d16(spark, d):
    return ev.aggregate(ev.hit_at_k(b.judged(spark, d), 1))


REPORT = f"""WITH {J}, {POOL}, {OWN}, r AS (SELECT 'hit@1' AS metric, * FROM ({HIT.format(k=1)}) UNION ALL SELECT 'hit@5', * FROM ({HIT.format(k=5)}) UNION ALL SELECT 'recall@5', * FROM ({RECALL.format(k=5)}) UNION ALL SELECT 'ndcg@10', * FROM ({NDCG}))
    SELECT metric, round(avg(value), 4) AS mean, count(value) AS n, count(*) - count(value) AS excluded FROM r GROUP BY metric"""


def report(spark, d):
    j = staged(b.judged(spark, d))  # read four times
    p = pool(j)
    parts = {"hit@1": ev.hit_at_k(j, 1), "hit@5": ev.hit_at_k(j, 5), "recall@5": ev.recall_at_k(p, p, 5), "ndcg@10": ev.ndcg_at_k(own(p), p, 10)}
    rows = None
    for name, values in parts.items():
        one = values.select(F.lit(name).alias("metric"), "value")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("metric").agg(F.round(F.avg("value"), 4).alias("mean"), F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("excluded"))


@query("d17_eval_report", REPORT)
def d17(spark, d):
    return report(spark, d)


MODES = "modes AS (SELECT DISTINCT query, CASE substr(query, 4)::INT % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'image' ELSE 'image+text' END AS mode FROM judged)"
BY_MODE = f"""WITH {J}, {POOL}, {OWN}, {MODES}, r AS (SELECT 'hit@1' AS metric, * FROM ({HIT.format(k=1)}) UNION ALL SELECT 'hit@5', * FROM ({HIT.format(k=5)}) UNION ALL SELECT 'recall@5', * FROM ({RECALL.format(k=5)}) UNION ALL SELECT 'ndcg@10', * FROM ({NDCG})),
    names AS (SELECT unnest(['hit@1', 'hit@5', 'recall@5', 'ndcg@10']) AS metric), report AS (SELECT mode, metric, round(avg(value), 4) AS mean, count(value) AS n, count(*) - count(value) AS excluded FROM modes JOIN names ON true LEFT JOIN r USING (query, metric) GROUP BY mode, metric)"""


def modes(j):
    n = F.expr("cast(substr(query, 4) as int) % 3")
    return j.select("query").distinct().withColumn("mode", F.when(n == 0, "text").when(n == 1, "image").otherwise("image+text"))


def by_mode(spark, d):
    j = staged(b.judged(spark, d))  # read several times
    p = pool(j)
    return ev.report_by_mode(j, p, own(p), modes(j)), modes(j)


@query("d17_report_by_mode", BY_MODE + " SELECT * FROM report")
def d17_modes(spark, d):
    return by_mode(spark, d)[0]


@query("l11_report", BY_MODE + f""", timed AS (SELECT mode, n_chars AS ms, row_number() OVER (PARTITION BY mode ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY mode) AS n FROM documents JOIN modes ON query = source),
    latency AS (SELECT mode, max(ms) FILTER (i = n // 2) AS median_ms, max(ms) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95_ms, count(*) AS requests FROM timed GROUP BY mode) SELECT * FROM report JOIN latency USING (mode)""")
def l11_report(spark, d):
    """Metrics of each mode beside the latency of its requests; the length of a document is its time."""
    report, which = by_mode(spark, d)
    timed = b.read(spark, d, "documents").select(F.col("source").alias("query"), F.col("n_chars").alias("ms")).join(F.broadcast(which), "query")  # a row a source
    latency = ev.latency_percentiles(timed, "mode", "ms").join(timed.groupBy("mode").agg(F.count(F.lit(1)).alias("requests")).hint("merge"), "mode")
    return report.join(latency.select("mode", F.col("median").alias("median_ms"), F.col("p95").alias("p95_ms"), "requests").hint("merge"), "mode")


@query("l11_label_coverage", f"WITH {J} SELECT query, count(*) FILTER (rank <= 10) AS shown, count(grade) FILTER (rank <= 10) AS judged, count(*) FILTER (grade IS NULL) AS unlabelled FROM judged GROUP BY query")
def l11(spark, d):
    top = F.col("rank") <= 10
    return b.judged(spark, d).groupBy("query").agg(F.count_if(top).alias("shown"), F.count_if(top & F.col("grade").isNotNull()).alias("judged"), F.count_if(F.col("grade").isNull()).alias("unlabelled"))


@query("d18_latency_percentiles", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (i = n // 2) AS median, max(value) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95 FROM r GROUP BY event_type")
def d18(spark, d):
    return ev.latency_percentiles(b.read(spark, d, "events"), "event_type", "value")


@query("d24_expected_hits", f"WITH {J}, c AS (SELECT query, min(rank) AS best FROM judged WHERE candidate % 9 = 0 GROUP BY query) SELECT count(*) AS cases, count(*) FILTER (best = 1) AS hit1, count(*) FILTER (best <= 10) AS hit10 FROM c")
def d24(spark, d):
    best = b.judged(spark, d).filter("candidate % 9 = 0").groupBy("query").agg(F.min("rank").alias("best"))
    return best.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("best") == 1).alias("hit1"), F.count_if(F.col("best") <= 10).alias("hit10"))


@query("d27_peak_envelope", """WITH s AS (SELECT event_type AS source, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, value AS x, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    k AS (SELECT source, CASE WHEN i < (n % 50) * (n // 50 + 1) THEN i // (n // 50 + 1) ELSE n % 50 + (i - (n % 50) * (n // 50 + 1)) // greatest(n // 50, 1) END AS bucket, max(abs(x)) AS peak FROM s GROUP BY 1, 2)
    SELECT source, bucket, round(peak / max(peak) OVER (PARTITION BY source), 6) AS peak FROM k""")
def d27(spark, d):
    e = numbered(b.read(spark, d, "events").select("event_type", "event_id", "value"), ["event_type"], ["event_id"])
    s = e.select(F.col("event_type").alias("source"), (F.col("rn") - 1).cast("long").alias("i"), F.col("value").alias("x"))
    return ev.peak_envelope(s, 50).withColumn("peak", F.round("peak", 6))


@query("h29_dcg_gain", f"WITH {J} SELECT query, candidate, round((pow(2, grade) - 1) / log2(rank + 1), 6) AS gain FROM judged WHERE grade IS NOT NULL")
def h29(spark, d):
    return b.judged(spark, d).filter("grade is not null").select("query", "candidate", F.round(ev.gain(F.col("grade"), F.col("rank")), 6).alias("gain"))
