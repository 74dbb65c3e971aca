"""Totals, ranks, quantiles and carried values by ranges of rows, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaframe.operators import blocks, evaluation, lookalikes
from mediaframe.operators import search as s


@pytest.fixture
def ranges(spark):
    """Many ranges, also for few rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_running_totals_and_numbers(spark, ranges):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randrange(9)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    got = {r.i: (r.upto, r.rn) for r in blocks.numbered(blocks.running_total(df, ["g"], ["i"], "v"), ["g"], ["i"]).collect()}
    for g, i, _ in rows:
        before = [v for h, k, v in rows if h == g and k <= i]
        assert got[i] == (sum(before), len(before))
    every = {r.i: r.upto for r in blocks.running_total(df, [], [F.desc("i")], "v").collect()}
    assert every == {i: sum(v for _, k, v in rows if k >= i) for _, i, _ in rows}


def test_budget_counts_over_many_ranges(spark, ranges):
    rows = [(1 + i % 5, i) for i in range(100)]
    got = {(r.n, r.first) for r in lookalikes.group_budget(spark.createDataFrame(rows, "n long, first long"), 150).collect()}
    total, want = 0, set()
    for n, first in sorted(rows, key=lambda x: (-x[0], x[1])):
        if total + n > 150:
            break
        total += n
        want.add((n, first))
    assert got == want


@pytest.mark.parametrize("at", [[0.0, 0.5, 0.95, 1.0], [0.33]])
def test_quantiles(spark, ranges, at):
    rng = np.random.default_rng(2)
    rows = [("a", float(x)) for x in np.round(rng.normal(size=151), 1)] + [("b", 3.0), (None, 1.0), (None, 2.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for r in blocks.quantiles(df, ["g"], "v", at).collect():
        assert np.allclose(r.q, np.quantile([v for g, v in rows if g == r.g and v is not None], at))
    whole = blocks.quantiles(df, [], "v", at).first().q
    assert np.allclose(whole, np.quantile([v for _, v in rows if v is not None], at))
    lat = {r.g: (r.median, r.p95) for r in evaluation.latency_percentiles(df, "g", "v").collect()}
    xs = sorted(v for g, v in rows if g == "a")
    assert lat["a"] == (xs[len(xs) // 2], xs[round(0.95 * (len(xs) - 1))])


def plain_window(windows, t):
    best = None
    for start, end, idx in windows:
        key = (not start <= t < end, abs(start - t), idx)
        best = min(best or key, key)
    return best and best[2]


@pytest.mark.parametrize("kind", ["tiled", "gaps", "nested", "ties"])
def test_window_at(spark, ranges, kind):
    rng = random.Random(kind)
    segments, moments = [], []
    for asset in range(3):
        at = 0
        for i in range(60 if asset else 150):
            if kind == "tiled":
                w = (4.0 * i, 4.0 * i + 8)
            elif kind == "gaps":
                at += rng.randrange(1, 9)
                w = (float(at), at + float(rng.randrange(1, 4)))
            elif kind == "nested":
                a = rng.randrange(300)
                w = (float(a), a + float(rng.choice([1, 5, 40, 300])))
            else:
                a = 10 * rng.randrange(6)
                w = (float(a), a + float(rng.choice([1, 2, 30])))
            segments.append((asset, i, *w))
        moments += [(asset, float(rng.randrange(-20, 700)) / 2) for _ in range(150)]
    moments.append((9, 1.0))
    got = {(r.asset_id, r.t): r.segment_index for r in s.window_at(spark.createDataFrame(segments, "asset_id long, segment_index int, start_s double, end_s double"), spark.createDataFrame(moments, "asset_id long, t double")).collect()}
    assert got == {(a, t): plain_window([(x, y, i) for b, i, x, y in segments if b == a], t) for a, t in moments}


def test_one_long_recording(spark):
    """10,000 windows and 10,000 moments of one asset do not meet each other."""
    windows = spark.range(10_000).selectExpr("1L as asset_id", "cast(id as int) as segment_index", "id * 5D as start_s", "id * 5D + 10 as end_s")
    moments = spark.range(10_000).selectExpr("1L as asset_id", "id * 5D + 7.5 as t")
    found = s.window_at(windows, moments)
    assert found.filter("segment_index = cast(floor(t / 5) as int)").count() == 9_999  # and one after the last start but one
    assert found.count() == 10_000


def test_half_of_all_points_in_one_town(spark):
    """Broadcast towns and merged ones name alike, at the date line, near a pole, and in a crowd."""
    from mediaframe.functions import geo

    rng = random.Random(4)
    towns = [(i, f"T{i}", f"R{i % 3}", "C" if i % 3 else f"R{i % 3}", rng.uniform(-90, 90) if i > 20 else 10 + i / 9, rng.uniform(-180, 180) if i > 20 else 179.9 - i / 5, rng.randrange(1, 10 ** 6)) for i in range(150)]
    spots = [(i, 11.0 + rng.random() / 50, 179.0 + rng.random()) for i in range(200)] + [(200 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(200)] + [(400, 89.9, 10.0), (401, -89.95, -170.0)]

    def km(a, b, c, d):
        a, b, c, d = map(np.radians, (a, b, c, d))
        return 2 * 6371 * np.arcsin(min(1, np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2)))

    def place(lat, lon):
        near = [(km(lat, lon, t[4], t[5]), t) for t in towns]
        close = [(-t[6] / (x + 1) ** 2, t[0], t) for x, t in near if x <= 30]
        far = [(x, t[0], t) for x, t in near if x <= 150]
        if not far:
            return None
        parts = min(close)[2][1:4] if close else min(far)[2][2:4]
        return ", ".join(dict.fromkeys(p for p in parts if p))

    p = spark.createDataFrame(spots, "point_id long, lat double, lon double")
    t = spark.createDataFrame(towns, "town_id long, name string, region string, country string, lat double, lon double, population long")
    want = {i: place(a, b) for i, a, b in spots}
    for most in (1000, 0):
        assert {r.point_id: r.place for r in geo.nearest_place(p, t, most).collect()} == want
