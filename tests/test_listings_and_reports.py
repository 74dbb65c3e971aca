"""Listings, names of files, reports by mode."""

from pyspark.sql import functions as F

from mediaframe.functions import media
from mediaframe.operators import catalog as c
from mediaframe.operators import evaluation as ev


def test_listing_is_clamped_and_counts_all(spark):
    rows = spark.range(2500).selectExpr("id as asset_id", "concat('f', lpad(id, 5, '0')) as rel_path", "if(id % 5 = 0, null, timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id)) as taken_at")
    for limit, n in ((0, 1), (-3, 1), (7, 7), (9999, 2000)):
        got = c.listing(rows, limit).collect()
        assert len(got) == n and {r.total for r in got} == {2500} and sorted(r["rank"] for r in got) == list(range(1, n + 1))
    first = c.listing(rows, 2).orderBy("rank").collect()
    assert [r.asset_id for r in first] == [1, 2]
    assert c.listing(rows.limit(0), 5).count() == 0


def test_names(spark):
    df = spark.createDataFrame([("abcdef", "trips/2024.05/sea.side.mp4", 75.25, 80.0), ("0", ".hidden", 0.0, 3600.04), ("ff", "noext", 1.0, 2.0)], "h string, p string, a double, b double")
    got = [tuple(r) for r in df.select(media.thumb_path(F.col("h"), F.col("a")), media.clip_name(F.col("p"), F.col("a"), F.col("b"))).collect()]
    assert got == [("ab/abcdef-w75.250.jpg", "sea.side_01m15_3s-01m20_0s.mp4"), ("0/0-w0.000.jpg", ".hidden_00m00_0s-60m00_0s.mp4"), ("ff/ff-w1.000.jpg", "noext_00m01_0s-00m02_0s.mp4")]


def test_ideal_ranking_by_counts_of_grades(spark):
    """nDCG by grade counts equals that of the sorted pool; an unjudged candidate makes it unknown."""
    import math

    rows = [("a", i, i, g) for i, g in enumerate([0, 2, 1, 2, 0, 1, 2], 1)] + [("b", 1, 1, 1), ("b", 2, 2, None)] + [("c", 1, 1, 0)]
    ranked = spark.createDataFrame(rows, "query string, candidate long, rank int, grade int")
    got = {r["query"]: r.value for r in ev.ndcg_at_k(ranked, ranked, 5).collect()}
    gain = lambda gs: sum((2 ** g - 1) / math.log2(i + 1) for i, g in enumerate(gs, 1))
    assert abs(got["a"] - gain([0, 2, 1, 2, 0]) / gain([2, 2, 2, 1, 1])) < 1e-12 and got["b"] is None and got["c"] is None


def test_report_by_mode(spark):
    rows = [("q1", 1, 1, 2), ("q1", 2, 2, 0), ("q2", 1, 1, 0), ("q2", 2, 2, 1), ("q3", 1, 1, None)]
    ranked = spark.createDataFrame(rows, "query string, candidate long, rank int, grade int")
    modes = spark.createDataFrame([("q1", "text"), ("q2", "text"), ("q3", "image"), ("q4", "image")], "query string, mode string")
    got = {(r.mode, r.metric): (r["mean"], r.n, r.excluded) for r in ev.report_by_mode(ranked, ranked, ranked, modes).collect()}
    assert got["text", "hit@1"] == (0.5, 2, 0) and got["text", "recall@5"] == (1.0, 2, 0) and got["image", "hit@1"] == (None, 0, 2)
    assert len(got) == 8
