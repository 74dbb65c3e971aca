import datetime as dt
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mediaframe.functions import geo, media, pixels, textmine, vectors
from mediaframe.functions.timewords import find_time
from mediaframe.operators import blocks, catalog, detections, evaluation, lookalikes, places, search, selections


@pytest.fixture(scope="module")
def few(spark):
    return spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.9, 0.1, 0.0]), ("c", [0.0, 1.0, 0.0]), ("d", [-1.0, 0.0, 0.0])], "asset_id string, vector array<float>")


def test_topk_order_exclusion_and_dimension(few):
    ids = [r.asset_id for r in search.cosine_topk(few, [1.0, 0.0, 0.0], 10).collect()]
    assert ids == ["a", "b", "c", "d"]
    assert [r.asset_id for r in search.cosine_topk(search.exclude(few, few.filter("asset_id = 'a'")), [1.0, 0.0, 0.0], 2).collect()] == ["b", "c"]
    assert search.cosine_topk(few.limit(0), [1.0, 0.0, 0.0], 3).count() == 0
    with pytest.raises(PySparkException):
        search.cosine_topk(few, [1.0, 0.0], 1).collect()


def test_best_of_with_ties():
    x = np.array([[1.0, 3, 3, 3, 0], [2, 2, 2, 2, 2], [-np.inf, 5, -np.inf, -np.inf, 4]])
    row, col = blocks.best_of(x, 3)
    assert list(zip(row.tolist(), col.tolist(), strict=True)) == [(0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (2, 1), (2, 4)]


def test_numbered_across_ranges(spark):
    df = spark.range(500).selectExpr("if(id % 3 = 0, null, id % 5) as g", "id").repartition(4)
    got = blocks.numbered(df, ["g"], ["id"]).collect()
    for g in {r.g for r in got}:
        ids = sorted(r.id for r in got if r.g == g)
        assert [r.rn for r in sorted((r for r in got if r.g == g), key=lambda r: r.id)] == list(range(1, len(ids) + 1))
    assert len(got) == 500


def test_free_names_ask_for_free_ones(spark):
    names = ["a.jpg", "A.jpg", "a (2).jpg", "b.jpg", "b (2).jpg", "B.jpg", "b.jpg", "b (2).jpg", "c.png", "c.png", "a.jpg", "a (2).jpg", "b (2) (2).jpg"]
    want, taken = [], set()
    for name in names:
        stem, ext = name.rsplit(".", 1)
        n, got = 1, name
        while got.lower() in taken:
            n += 1
            got = f"{stem} ({n}).{ext}"
        taken.add(got.lower())
        want.append(got)
    df = spark.createDataFrame([(i, n.rsplit(".", 1)[0], "." + n.rsplit(".", 1)[1]) for i, n in enumerate(names)], "id long, stem string, ext string")
    assert [r.name for r in selections.free_names(df).orderBy("id").collect()] == want


def test_searchable_rejects_mixed_dimensions(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "asset_id long, vector array<double>")
    a = spark.createDataFrame([(1, "indexed", 0), (2, "indexed", 0), (3, "failed", 0)], "asset_id long, status string, library_id int")
    with pytest.raises(Exception, match="more than one dimension"):
        search.searchable(v, a).collect()
    assert search.searchable(v.filter("asset_id = 1"), a).count() == 1 and search.searchable(v.filter("asset_id > 2"), a).count() == 0


def test_batch_topk_and_self_join_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((120, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "asset_id long, vector array<double>")
    got = search.batch_topk(v.limit(9).select(F.col("asset_id").alias("query_id"), "vector"), v, 5).collect()
    s = x @ x.T
    for q in {r.query_id for r in got}:
        assert [r.asset_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == np.argsort(-s[q], kind="stable")[:5].tolist()
    some = search.batch_topk(v.withColumnRenamed("asset_id", "query_id"), v, 3, rows=50, others_to=0.6).collect()
    for q in range(120):
        order = [j for j in np.argsort(-s[q], kind="stable") if j != q and s[q, j] <= 0.6][:3]
        assert [r.asset_id for r in sorted((r for r in some if r.query_id == q), key=lambda r: r.rank)] == order
    best = {r.asset_id: (r.same, r.other) for r in search.best_by_group(v.withColumn("g", F.col("asset_id") % 7), "g", rows=50).collect()}
    for q in range(120):
        like = np.array([j % 7 == q % 7 for j in range(120)])
        assert np.allclose(best[q], (max(s[q, j] for j in np.flatnonzero(like) if j != q), s[q, ~like].max()))
    asked = v.filter("asset_id < 40").selectExpr("asset_id as query", "asset_id % 9 as truth", "vector")
    ranks = {r["query"]: r["rank"] for r in search.rank_of_truth(asked, v.filter("asset_id >= 40").selectExpr("asset_id % 9 as grp", "vector"), rows=20).collect()}
    for q in range(40):
        scores = [max(s[q, j] for j in range(40, 120) if j % 9 == g) for g in range(9)]
        assert ranks[q] == 1 + sum(x > scores[q % 9] + 1e-9 for x in scores)
    assert search.batch_topk(v.limit(0).withColumnRenamed("asset_id", "query_id"), v, 3).count() == search.similarity_self_join(v.limit(0), 0.1).count() == 0
    for rows in (200, 60, 25):
        pairs = {(r.a, r.b) for r in search.similarity_self_join(v, 0.5, rows=rows).collect()}
        assert pairs == {(i, j) for i in range(120) for j in range(i + 1, 120) if s[i, j] >= 0.5}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0]), (5, None)], "asset_id long, vector array<double>")
    assert [r.asset_id for r in search.valid_vectors(df, 2).collect()] == [1]
    assert df.filter("asset_id = 1").select(vectors.l2_normalize("vector").alias("v")).first().v == [0.6, 0.8]
    with pytest.raises(PySparkException):
        df.filter("asset_id = 2").select(vectors.l2_normalize("vector")).collect()


def reference_groups(hits, limit, max_extra=5, max_overlap=0.5):
    groups = {}
    for h in sorted(hits, key=lambda h: (-h[1], h[0])):
        g = groups.setdefault(h[4], [[], 0])
        if not g[0]:
            g[0].append(h)
        elif len(g[0]) <= max_extra:
            free = all(max(0, min(h[3], k[3]) - max(h[2], k[2])) / min(h[3] - h[2], k[3] - k[2]) < max_overlap for k in g[0])
            g[0].append(h) if free else g.__setitem__(1, g[1] + 1)
    best = sorted(groups.items(), key=lambda x: (-x[1][0][0][1], x[1][0][0][0]))[:limit]
    return [(a, [h[0] for h in g[0]], g[1]) for a, g in best]


def test_group_hits_against_brute_force(spark):
    rng = np.random.default_rng(3)
    hits = [(i, round(float(rng.random()), 3), float(s), float(s + 8), int(rng.integers(0, 6))) for i, s in enumerate(rng.integers(0, 40, 150))]
    df = spark.createDataFrame(hits, "embedding_id long, similarity double, start_s double, end_s double, asset_id long")
    for extra in (0, 2, 5):
        got = [(r.asset_id, [r.best.embedding_id, *(o.embedding_id for o in r.others)], r.suppressed) for r in search.group_hits(df, 4, extra).collect()]
        assert got == reference_groups(hits, 4, extra)


def test_stars_against_brute_force(spark):
    rng = np.random.default_rng(5)
    for n in (4, 12, 30):
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.2]
        df = spark.createDataFrame([(a, b, 0.95) for a, b in pairs], "a long, b long, similarity double")
        near = {i: {b if a == i else a for a, b in pairs if i in (a, b)} for i in range(n)}
        taken, want = set(), set()
        for i in sorted((i for i in near if near[i]), key=lambda i: (-len(near[i]), i)):
            if i not in taken:
                own = {j for j in near[i] if j not in taken}
                taken |= own | {i}
                want |= {(i, j) for j in own}
        assert {(r.leader, r.member) for r in lookalikes.stars(df, spark).collect()} == want


def test_best_shot(spark):
    df = spark.createDataFrame([(1, 1, 100.0, 10), (1, 2, 95.0, 20), (1, 3, 50.0, 99), (2, 4, 5.0, 1)], "grp long, id long, sharpness double, pixels long")
    assert {(r.grp, r.id) for r in lookalikes.best_shot(df).collect()} == {(1, 2), (2, 4)}


def test_metrics_with_unknown_judgements(spark):
    rows = [("q1", "a", 1, None), ("q1", "b", 2, 0), ("q2", "a", 1, 2), ("q2", "b", 2, 1), ("q3", "a", 1, 0), ("q3", "b", 2, 0)]
    df = spark.createDataFrame(rows, "query string, candidate string, rank int, grade int")
    assert {r.query: r.value for r in evaluation.hit_at_k(df, 2).collect()} == {"q1": None, "q2": 1.0, "q3": 0.0}
    assert {r.query: r.value for r in evaluation.recall_at_k(df, df, 1).collect()} == {"q1": None, "q2": 0.5, "q3": None}
    assert {r.query: r.value for r in evaluation.ndcg_at_k(df, df, 2).collect()} == {"q1": None, "q2": 1.0, "q3": None}
    a = evaluation.aggregate(evaluation.hit_at_k(df, 2)).first()
    assert (a.mean, a.n, a.excluded) == (0.5, 2, 1)


def test_windows(spark):
    cases = {4.4: [(0.0, 4.4)], 10.0: [(0.0, 10.0)], 17.5: [(0.0, 10.0), (5.0, 15.0), (7.5, 17.5)], 10.7: [(0.0, 10.7)]}
    df = spark.createDataFrame([(d,) for d in cases], "d double").select("d", media.plan_windows(F.col("d"), 10.0, 5.0).alias("w"))
    assert {r.d: [(w.start_s, w.end_s) for w in r.w] for r in df.collect()} == cases
    long = spark.createDataFrame([(1800.0,), (50.3,)], "d double").select("d", F.size(media.plan_windows(F.col("d"), 10.0, 10.0)).alias("n"))
    assert {r.d: r.n for r in long.collect()} == {1800.0: 180, 50.3: 5}


TODAY = dt.date(2031, 5, 14)  # a Wednesday


@pytest.mark.parametrize(("text", "want", "label", "rest"), [
    ("boats from 2003 until 2001", ("2001-01-01", "2004-01-01", []), "from 2001 to 2003", "boats"), ("kites since june 2017", ("2017-06-01", "2031-05-15", []), "since June 2017", "kites"),
    ("kites since 2017", ("2017-01-01", "2031-05-15", []), "since 2017", "kites"), ("what was yesterday?", ("2031-05-13", "2031-05-14", []), "from yesterday", "what was?"),
    ("snow from last winter", ("2030-12-01", "2031-03-01", []), "from winter 2030–2031 (December–February)", "snow"), ("last autumn", ("2030-09-01", "2030-12-01", []), "from autumn 2030 (September–November)", ""),
    ("last month", ("2031-04-01", "2031-05-01", []), "from last month (April 2031)", ""), ("this week", ("2031-05-12", "2031-05-15", []), "from this week", ""), ("past year", ("2030-05-15", "2031-05-15", []), "from the last 365 days", ""),
    ("this year", ("2031-01-01", "2032-01-01", []), "from this year (2031)", ""), ("boats in the fall", ("", "", [9, 10, 11]), "from fall (any year)", "boats"), ("during january", ("", "", [1]), "from January (any year)", ""),
    ("may 2029", ("2029-05-01", "2029-06-01", []), "from May 2029", ""), ("geese shot in sept 2018 here", ("2018-09-01", "2018-10-01", []), "from September 2018", "geese here"), ("in sept", ("", "", [9]), "from September (any year)", ""),
    ("last may", ("2030-05-01", "2030-06-01", []), "from May 2030", ""), ("cows in 1998", ("1998-01-01", "1999-01-01", []), "from 1998", "cows"), ("spring of 2020", ("2020-03-01", "2020-06-01", []), "from spring 2020 (March–May)", ""),
    ("you may sit", None, None, None), ("the march of ants", None, None, None), ("spring dress", None, None, None), ("room 20199", None, None, None), ("on may day", None, None, None), ("", None, None, None),
])
def test_time_phrases(text, want, label, rest):
    assert textmine.time_phrase(text, TODAY) == want
    found = find_time(text, TODAY)
    assert (found.label, found.rest) == (label, rest) if want else found is None


def test_intents_and_tags(spark):
    rows = [("how many dogs are there?", False), ("show me cars", False), ("which of those have dogs", True), ("which of those have dogs", False), ("more cats or dogs?", True), ("describe photo 2", True), ("hello", False)]
    df = spark.createDataFrame(rows, "t string, prev boolean").select(textmine.classify_intent(F.col("t"), F.col("prev")).alias("i"), textmine.tag_labels(F.col("t")).alias("l"), textmine.clean_query(F.col("t")).alias("c"))
    got = df.collect()
    assert [r.i for r in got] == ["count", "search", "refine", "none", "compare", "describe", "chat"]
    assert got[0].l == ["dog"] and got[4].l == ["cat", "dog"]
    two = spark.createDataFrame([("a traffic light and a teddy bear, dogs",), ("",)], "t string").select(textmine.tag_labels(F.col("t")).alias("l")).collect()
    assert [r.l for r in two] == [["traffic light", "teddy bear", "dog"], []]
    c = spark.createDataFrame([("give me pictures of car",), ("Please show me some photos with dogs?",), ("find me",)], "t string").select(textmine.clean_query(F.col("t")).alias("c")).collect()
    assert [r.c for r in c] == ["car", "dogs", "me"]


def test_more_requests(spark):
    rows = [("is this not a dog?", True), ("please save those as the Alps album", True), ("save the day", True), ("draw a wide picture of a cow", False), ("make a reel of those", False), ("take out the bin", False), ("swap the cow for a horse", True),
            ("swap the cow for a horse", False), ("what do you see in the second one", True), ("tell me about dogs", True), ("more rain or sun", False), ("help", False)]
    df = spark.createDataFrame(rows, "t string, prev boolean")
    t = F.col("t")
    got = df.select(textmine.classify_intent(t, F.col("prev")).alias("i"), textmine.create_request(t).alias("c"), textmine.selection_name(t).alias("s"), textmine.photo_places(t).alias("p")).collect()
    assert [r.i for r in got] == ["explain", "save", "none", "create", "create", "edit", "edit", "none", "describe", "none", "none", "chat"]
    assert got[1].s == "Alps" and tuple(got[3].c) == ("image", "wide") and tuple(got[4].c) == ("video", "vertical") and got[8].p == [2] and got[0].c is None
    flags = spark.createDataFrame([("two puppies",), ("a puppy",), ("the bus",), ("buses",), ("three benches",), ("sheep",), ("boxes",)], "t string").select(textmine.is_plural(t).alias("p")).collect()
    assert [r.p for r in flags] == [True, False, False, True, True, True, False]


def test_colours_at_their_limits():
    at = lambda c, h, s, v: bool(pixels.of_colour(np.array([h]), np.array([s]), np.array([v]), c)[0])
    assert at("red", 240.5, 110.5, 60.5) and not at("purple", 240.5, 200, 200) and at("purple", 240, 71, 51) and not at("red", 240, 200, 200)
    assert at("orange", 10, 121, 91) and not at("orange", 26, 121, 91) and not at("blue", 150, 80, 200) and at("grey", 0, 39, 190) and at("white", 0, 39, 191) and at("black", 9, 255, 49)


def test_places(spark):
    known = spark.createDataFrame([(1, "Palolem, Goa, India"), (2, "Paris, France"), (3, "São Paulo, Brazil"), (4, None)], "asset_id long, place string")
    assert {r.asset_id for r in places.within(known, "Goa, India").collect()} == {1}
    rows = spark.createDataFrame([(1, "everything from goa"), (2, "photos in sao paulo"), (3, "Paris sunsets"), (4, "from nowhere")], "id long, t string")
    assert {r.id: r.name for r in textmine.extract_place(rows, "t", known, "id").collect()} == {1: "Goa", 2: "São Paulo", 3: "Paris"}


def test_nearest_place_against_brute_force(spark):
    rng = np.random.default_rng(7)
    pts = [(i, float(rng.uniform(-89.5, 89.5)), float(rng.uniform(-180, 180))) for i in range(150)] + [(900, 10.0, 179.9), (901, 89.3, 10.0)]
    towns = [(i, f"T{i}", f"R{i % 5}", f"C{i % 3}" if i % 4 else f"R{i % 5}", float(np.clip(p[1] + rng.normal(0, 0.6), -89.9, 89.9)), float((p[2] + rng.normal(0, 0.6) + 180) % 360 - 180), float(rng.integers(1, 10**6))) for i, p in enumerate(pts)]
    towns += [(997, "East", "R", "C", 10.0, -179.9, 5000.0), (998, "Pole", "R", "C", 89.4, -170.0, 500.0)]

    def km(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(h)))

    want = {}
    for i, la, lo in pts:
        d = [(km((la, lo), (t[4], t[5])), t) for t in towns]
        best = min(d, key=lambda x: x[0])
        near = [x for x in d if x[0] <= 30]
        if best[0] > 150:
            want[i] = None
        else:
            t = max(near, key=lambda x: x[1][6] / (x[0] + 1) ** 2)[1] if near else best[1]
            want[i] = ", ".join(dict.fromkeys([t[1], t[2], t[3]] if near else [t[2], t[3]]))
    got = geo.nearest_place(spark.createDataFrame(pts, "point_id long, lat double, lon double"),
                            spark.createDataFrame(towns, "town_id long, name string, region string, country string, lat double, lon double, population double"))
    assert {r.point_id: r.place for r in got.collect()} == want


def test_filters_and_merges(spark):
    a = spark.createDataFrame([(1, dt.datetime(2024, 7, 1), "Goa, India"), (2, None, None)], "asset_id long, taken_at timestamp_ntz, place string")
    assert [r.asset_id for r in a.filter(catalog.MediaFilter(months=[7]).to_column()).collect()] == [1]
    assert a.filter(catalog.MediaFilter().to_column()).count() == 2
    with pytest.raises(ValueError):
        catalog.date_place_filter(a, "2024-02-01", "2024-01-01")
    old = spark.createDataFrame([("p", 1, "h", 5, "indexed"), ("q", 2, "h2", 5, "missing"), ("r", 3, "h3", 5, "indexed")], "rel_path string, asset_id long, content_hash string, size long, status string")
    new = spark.createDataFrame([("p", "changed", 6, 9), ("q", "h2", 5, 9), ("s", "h4", 7, 9)], "rel_path string, content_hash string, size long, new_id long")
    once = catalog.upsert_assets(old, new)
    assert {r.rel_path: (r.asset_id, r.status) for r in once.collect()} == {"p": (1, "pending"), "q": (2, "pending"), "r": (3, "indexed"), "s": (9, "pending")}
    assert sorted(catalog.upsert_assets(once, new).collect()) == sorted(once.collect())


def test_selections(spark):
    items = spark.createDataFrame([(1, 10, 1, None, None), (1, 11, 2, 0.0, 5.0)], "selection_id long, asset_id long, position int, start_s double, end_s double")
    more = spark.createDataFrame([(1, 10, 1, None, None), (1, 11, 2, 1.0, 5.0), (1, 12, 3, None, None)], items.schema)
    added = selections.add_items(items, more)
    assert sorted((r.asset_id, r.position) for r in added.collect()) == [(10, 1), (11, 2), (11, 3), (12, 4)]
    assert selections.add_items(added, more).count() == 4
    names = selections.free_names(spark.createDataFrame([(1, "A", ".jpg"), (2, "a", ".JPG"), (3, "b", ".jpg")], "id long, stem string, ext string"))
    assert {r.id: r.name for r in names.collect()} == {1: "A.jpg", 2: "a (2).JPG", 3: "b.jpg"}


def test_boxes(spark):
    df = spark.createDataFrame([("h", "car", '[[0.9, [0, 0, 0.5, 0.5]], [0.6, [0.1, 0.1, 0.2, 0.2]]]')], "content_hash string, label string, boxes_json string")
    rows = detections.read_boxes(df).collect()
    assert [(r.score, r.x1) for r in rows] == [(0.9, 0.5), (0.6, 0.2)]
    assert [detections.read_boxes(df).select(detections.band(F.col("score")).alias("b")).collect()[i].b for i in (0, 1)] == ["sure", "maybe"]


def test_encoder_falls_back_to_single_items(spark):
    def encoder():
        def fn(items):
            if "bad" in items:
                raise ValueError("no")
            return [np.array([3.0, 4.0]) for _ in items]

        return fn

    df = spark.createDataFrame([(1, "x"), (2, "bad"), (3, "y")], "id long, t string").coalesce(1)
    got = {r.id: (r.vector, r.error) for r in search.encode(df, encoder, "t", "id").collect()}
    assert got == {1: ([0.6, 0.8], None), 2: (None, "ValueError: no"), 3: ([0.6, 0.8], None)}


def test_metadata(spark):
    df = spark.createDataFrame([("2024:07:01 10:00:00", None), ("0000:00:00 00:00:00", "2023:01:02 03:04:05"), ("x", "y")], "a string, b string")
    got = df.select(media.parse_exif_date(F.col("a"), F.col("b")).alias("t")).collect()
    assert [r.t for r in got] == [dt.datetime(2024, 7, 1, 10), dt.datetime(2023, 1, 2, 3, 4, 5), None]
    g = spark.createDataFrame([("+12.5-056.25/",), ("+00+000/",), ("x",)], "t string").select(geo.parse_iso6709(F.col("t")).alias("g")).collect()
    assert [(r.g.lat, r.g.lon) if r.g else None for r in g] == [(12.5, -56.25), None, None]
    r = spark.createDataFrame([("30000/1001",), ("25/0",), ("25",), (None,)], "t string").select(F.round(media.parse_rate(F.col("t")), 3).alias("r")).collect()
    assert [x.r for x in r] == [29.97, 0.0, 25.0, 0.0]


def test_nearest_other_of_many_copies(spark, tmp_path):
    import pandas as pd

    from mediaframe.registry import QUERIES

    x = np.random.default_rng(4).standard_normal((40, 8))
    x[:12] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pd.DataFrame({"vec_id": np.arange(40), "label": 0, "embedding": x.tolist()}).to_parquet(tmp_path / "embeddings.parquet")
    s = x @ x.T
    s[s > 0.9999] = -2
    got = {r.asset_id: r.nearest for r in QUERIES["e7_nearest_other"](spark, str(tmp_path)).collect()}
    assert got == {i: int(s[i].argmax()) for i in range(40)}


def test_bootstrap_interval_holds_the_normal_one(spark):
    rng = np.random.default_rng(1)
    x = rng.random(2000) < 0.3
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, value double")
    got = evaluation.bootstrap_ci(df).first()
    sd = (x.mean() * (1 - x.mean()) / len(x)) ** 0.5
    assert abs(got.low - (x.mean() - 1.96 * sd)) < 0.004 and abs(got.high - (x.mean() + 1.96 * sd)) < 0.004
    assert evaluation.bootstrap_ci(df.repartition(5)).first() == pytest.approx(got)
    assert evaluation.bootstrap_ci(df.limit(0)).first().low is None


def test_follow_ups(spark):
    said = {"ok do it": "confirm", "it's fine": "confirm", "now put a bus there": "redo", "swap it for a tree": "redo", "there is still a smudge": "retry", "make it neater": "retry", "nice": None}
    got = spark.createDataFrame([(k,) for k in said], "t string").select("t", textmine.follow_up(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in got} == said


def test_ranks_count_differences_below_any_tolerance(spark):
    """Equal windows are ties, and one that is better by 1e-12 is better, whatever else is in its block."""
    right = np.random.default_rng(3).standard_normal((3000, 8)) / 10
    right[:, 0] = 0.5
    right[1:3000:3, 1:], right[1:3000:3, 0] = right[0, 1:], np.where(np.arange(1000) % 2, 0.5, 0.5 + 1e-12)
    right[2::3] = -1
    asked = spark.createDataFrame([(1, 0, [1.0] + [0.0] * 7), (2, 2, [1.0, 0.25] + [0.0] * 6)], "query long, truth long, vector array<double>")
    windows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(right)], "grp long, vector array<double>")
    for rows in (None, 100):
        ranks = {r["query"]: r["rank"] for r in search.rank_of_truth(asked, windows, rows=rows).collect()}
        assert ranks == {1: 501, 2: 2001}


def test_nearest_of_groups_by_blocks_that_grow(spark):
    """A row is dealt to a fixed number of blocks however many rows there are, and two blocks meet once."""
    from mediaframe.operators import blocks

    assert [-(-n // blocks.rows_of_block(n)) for n in (10_256, 102_564, 615_384)] == [12, 12, 12]
    x = np.random.default_rng(6).standard_normal((1300, 4))
    x[:300] = x[0]
    names = np.array(["a", "b", "c"])[np.arange(1300) % 3]
    v = spark.createDataFrame([(i, str(g), y.tolist()) for i, (g, y) in enumerate(zip(names, x, strict=True))], "asset_id long, g string, vector array<double>")
    got = {r.asset_id: (r.same, r.other) for r in search.best_by_group(v, "g").collect()}
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    like = names[:, None] == names
    assert np.allclose([got[i] for i in range(1300)], np.stack([np.where(like, s, -np.inf).max(1), np.where(like, -np.inf, s).max(1)], axis=1))


def test_points_of_one_place_meet_towns_once(spark, tmp_path):
    """2,000 points of one place and key meet each town as a few rows of the join, and all are in the result."""
    import pandas as pd

    from mediaframe.registry import QUERIES

    ids = np.concatenate([6_120_00 * np.arange(1, 1001), 6_120_00 * np.arange(1, 1001) + 6_120_000_000, [7]])
    pd.DataFrame({"c_custkey": ids}).to_parquet(tmp_path / "customer.parquet")
    pd.DataFrame({"s_suppkey": [100, 200, 307]}).to_parquet(tmp_path / "supplier.parquet")
    found = QUERIES["h22_haversine_gravity"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(ids") < plan.index("Join Inner")  # the join is below the points
    got = found.toPandas()
    assert sorted(zip(got.point_id, got.town_id)) == sorted([(i, t) for i in ids[:-1].tolist() for t in (100, 200)] + [(7, 307)])
    assert got[got.point_id != 7].groupby("town_id")["km"].nunique().tolist() == [1, 1]
