"""Components, stars of look-alikes, corrections, and searches that refuse."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaframe.operators import detections as det
from mediaframe.operators import graph, lookalikes
from mediaframe.operators import search as s


def plain_stars(pairs):
    near = {}
    for a, b, _ in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    taken, out = set(), set()
    for u in sorted(near, key=lambda x: (-len(near[x]), x)):
        if u not in taken and (free := near[u] - taken):
            taken |= {u, *free}
            out |= {(u, m) for m in free}
    return out


def graph_of(seed):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(g * 100, g * 100 + 12), 2))) for g in range(6) for _ in range(20)}
    return [(a, b, 0.9) for a, b in sorted(edges)]


@pytest.mark.parametrize("small", [1, 15, 100_000])
def test_stars_whole_and_by_rounds(spark, small):
    pairs = graph_of(small)
    df = spark.createDataFrame(pairs, "a long, b long, similarity double")
    assert {(r.leader, r.member) for r in lookalikes.stars(df, spark, small=small).collect()} == plain_stars(pairs)


def test_a_path_of_ten_thousand_photos_ends(spark):
    df = spark.range(10_000).selectExpr("id as a", "id + 1 as b", "0.95D as similarity")
    got = {(r.leader, r.member) for r in lookalikes.stars(df, spark).collect()}
    assert got == plain_stars([(i, i + 1, 0) for i in range(10_000)])


def test_rounds_have_a_bound(spark):
    df = spark.range(60).selectExpr("id as a", "id + 1 as b", "0.95D as similarity")
    with pytest.raises(RuntimeError):
        lookalikes._stars_by_rounds(df, 3)
    with pytest.raises(RuntimeError):
        graph.components(df, most=2)


def test_components(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (201, 203), (203, 200)]
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200, 203: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_pairs_no_stars(spark):
    none = spark.createDataFrame([], "a long, b long, similarity double")
    assert lookalikes.stars(none, spark).count() == 0
    v = spark.createDataFrame([(i, [1.0, 0.0] if i < 4 else [0.0, 1.0] if i < 6 else [-1.0, 0.1 * i]) for i in range(8)], "asset_id long, vector array<double>")
    rows = {r.level: (r.threshold, r.groups, r.photos) for r in lookalikes.level_summary(v, spark).collect()}
    assert rows["strict"][1:] == (3, 8) and set(rows) == {"strict", "normal", "loose"}


def test_review_order(spark):
    stars = spark.createDataFrame([(1, 2, 0.95), (1, 3, 0.97), (5, 6, 0.91)], "leader long, member long, similarity double")
    facts = spark.createDataFrame([(1, "a", 10.0, 5), (2, "a", 9.5, 9), (3, "a", 1.0, 99), (5, "x", 1.0, 1), (6, "y", 3.0, 1)], "asset_id long, content_hash string, sharpness double, pixels long")
    rows = sorted(lookalikes.review(stars, facts, 1000).collect(), key=lambda r: r["rank"])
    assert [(r["rank"], r.grp, r.member, r.best, r.identical) for r in rows] == [(1, 1, 2, True, True), (2, 1, 1, False, True), (3, 1, 3, False, True), (4, 2, 6, True, False), (5, 2, 5, False, False)]
    assert lookalikes.review(stars, facts, 4).count() == 3


def test_corrections_are_stored_by_content(spark):
    shown = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h1"), (4, "h4")], "rank int, content_hash string")
    before = spark.createDataFrame([("h2", "dog", "user", 1), ("h2", "cat", "user", 1), ("h9", "dog", "model", 0)], "content_hash string, label string, verifier string, present int")
    verdicts, rest = det.apply_corrections(shown, [-1, 2, 4], "dog", before)
    assert {tuple(r) for r in verdicts.collect()} == {("h2", "dog", "user", 0), ("h4", "dog", "user", 0), ("h2", "cat", "user", 1), ("h9", "dog", "model", 0)}
    assert sorted(r["rank"] for r in rest.collect()) == [1, 3]
    for ranks in ([5], [0], [-2]):
        with pytest.raises(Exception, match="has 4 photos"):
            det.apply_corrections(shown, ranks, "dog", before)[0].collect()


@pytest.fixture
def library(spark):
    assets = spark.createDataFrame([(i, 1 + i // 10, "video" if i % 2 else "image", "indexed", None, f"f{i}") for i in range(20)], "asset_id long, library_id int, media_type string, status string, live_photo long, rel_path string")
    rows = []
    for i in range(20):
        for k, m in enumerate(["image"] if i % 2 == 0 else ["video-visual", "video-visual", "video-audio", "video-joint"]):
            rows.append((10 * i + k, i, "now" if i < 10 else "old", m, None if m == "image" else 4.0 * k, None if m == "image" else 4.0 * k + 8, [float(np.cos(i + k)), float(np.sin(i + k))]))
    return assets, spark.createDataFrame(rows, "embedding_id long, asset_id long, profile_key string, modality string, start_s double, end_s double, vector array<double>")


def test_search_by_signal_and_state(spark, library):
    assets, vectors = library
    rows = s.search(assets, vectors, [1.0, 0.0], "now", 5, hydrate=["rel_path"]).orderBy("rank").collect()
    assert [r.asset_id for r in rows] == sorted(range(0, 10, 2), key=lambda i: -np.cos(i)) and rows[0].rel_path == f"f{rows[0].asset_id}"
    assert {r.index_state for r in rows} == {"partial"}
    for signal, k in (("audio", 2), ("joint", 3)):
        found = s.search(assets, vectors, [1.0, 0.0], "now", 50, ["video"], signal, libraries=[1]).collect()
        assert {r.embedding_id for r in found} == {10 * i + k for i in range(1, 10, 2)} and {r.index_state for r in found} == {"ready"}
    both = s.search(assets, vectors, [1.0, 0.0], "now", 50, ["image", "video"], libraries=[1]).collect()
    assert len(both) == 10 and sum(r.suppressed for r in both) == 5  # the second visual window overlaps the first by half
    with pytest.raises(KeyError):
        s.modalities_for(["video"], "smell")
    assert s.modalities_for(["image", "video", "image"], "joint") == ["image", "video-joint"]


def test_an_index_of_other_profiles_is_refused(spark, library):
    assets, vectors = library
    with pytest.raises(Exception, match="another profile"):
        s.search(assets.filter("library_id = 2"), vectors, [1.0, 0.0], "now", 5).collect()
        s.refuse_incompatible(assets.filter("library_id = 2"), vectors, "now", spark.range(1)).collect()
    empty = s.refuse_incompatible(assets.limit(0), vectors, "now", spark.range(1))
    assert empty.count() == 0


def test_found_photos_come_up_from_far_down(spark):
    """The photo with the object is 41st of 60; 20 are asked for."""
    assets = spark.range(60).select(F.col("id").alias("asset_id"), F.lit(1).alias("library_id"), F.lit("image").alias("media_type"), F.lit("indexed").alias("status"), F.lit(None).cast("long").alias("live_photo"))
    segments = spark.range(60).selectExpr("id as embedding_id", "id as asset_id", "array(1D - id / 100D, 0D) as vector")
    found, checked = spark.createDataFrame([(40,)], "asset_id long"), spark.range(50).withColumnRenamed("id", "asset_id")
    rows = s.search_grouped(assets, segments, [1.0, 0.0], None, 20, found, checked).orderBy("rank").collect()
    assert [r.asset_id for r in rows] == [40, *range(19)] and rows[0].object_check == "found"


@pytest.mark.parametrize("least, pairs, batch", [(0.3, 0, 40), (0.3, 0, 1000), (0.3, 10_000, 1), (0.9, 0, 50)])
def test_stars_of_vectors_without_pairs(spark, least, pairs, batch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 12))
    x[:150] = x[0] + 1e-3 * rng.standard_normal((150, 12))
    x[150:200] = x[150]
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    rows = [(i, j, float(s[i, j])) for i in range(700) for j in range(i + 1, 700) if s[i, j] >= least]
    v = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)] + [(-1, []), (-2, None)], "asset_id long, vector array<double>")
    got = lookalikes.stars_of(v, least, spark, pairs=pairs, batch=batch).collect()
    assert len(got) == len({r.member for r in got}) and {(r.leader, r.member) for r in got} == plain_stars(rows)
    assert all(abs(r.similarity - s[r.leader, r.member]) < 1e-5 for r in got)
