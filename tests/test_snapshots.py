"""Versions of a table: touched buckets only, replays, crashes, writers at the same time."""

import pytest
from pyspark.sql import functions as F

from mediaframe.operators import catalog as c
from mediaframe.sources import media
from mediaframe.sources.snapshots import Conflict, Snapshots

ROWS = "id long, value string"


def put(old, new):
    return c.replace_keys(old, new, ["id"])


@pytest.fixture
def store(spark, tmp_path):
    return Snapshots(spark, str(tmp_path / "table"), ["id"], 16)


def values(df):
    rows = [(r.id, r.value) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return dict(rows)


def test_one_changed_row_rewrites_one_bucket(spark, store):
    first = store.merge(spark.range(500).select("id", F.lit("a").alias("value")), put, ROWS)
    second = store.merge(spark.createDataFrame([(7, "b")], ROWS), put, ROWS)
    moved = [b for b in first["files"] if first["files"][b] != second["files"][b]]
    assert len(first["files"]) == 16 and len(moved) == 1
    assert values(store.read()) == {i: "b" if i == 7 else "a" for i in range(500)}
    assert values(store.read(1)) == dict.fromkeys(range(500), "a")
    gone = store.merge(spark.createDataFrame([(7, "")], ROWS), lambda old, new: old.join(new, "id", "left_anti"), ROWS)
    assert gone["version"] == 3 and 7 not in values(store.read())


def test_replays_and_empty_changes_make_no_version(spark, store):
    for _ in range(2):
        store.merge(spark.createDataFrame([(1, "a")], ROWS), put, ROWS, tag="batch-0")
    assert store.versions() == [1]
    store.merge(spark.createDataFrame([], ROWS), put, ROWS, tag="batch-1")
    assert store.versions() == [1] and values(store.read()) == {1: "a"}


def test_crash_before_the_manifest_is_harmless(spark, store, monkeypatch):
    store.merge(spark.createDataFrame([(1, "a"), (2, "a")], ROWS), put, ROWS)
    with monkeypatch.context() as m:
        m.setattr(Snapshots, "_commit", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.merge(spark.createDataFrame([(1, "b")], ROWS), put, ROWS, tag="x")
    assert values(store.read()) == {1: "a", 2: "a"}
    store.merge(spark.createDataFrame([(1, "b")], ROWS), put, ROWS, tag="x")
    assert values(store.read()) == {1: "b", 2: "a"}
    store.expire(keep=1)
    assert values(store.read()) == {1: "b", 2: "a"} and store.versions() == [2]
    folders = [p for p in (__import__("pathlib").Path(store.root) / "data").glob("*/_bucket=*")]
    assert len(folders) == len(store.manifest()["files"])


def test_second_of_two_writers_is_told(spark, store):
    store.merge(spark.createDataFrame([(1, "a")], ROWS), put, ROWS)
    other = Snapshots(spark, store.root, ["id"], 16)

    def slow(old, new):
        other.merge(spark.createDataFrame([(2, "other")], ROWS), put, ROWS)
        return put(old, new)

    with pytest.raises(Conflict):
        store.merge(spark.createDataFrame([(1, "mine")], ROWS), slow, ROWS)
    assert values(store.read()) == {1: "a", 2: "other"}


def test_wrong_use_is_an_error(spark, store):
    with pytest.raises(ValueError):
        store.read()
    store.merge(spark.createDataFrame([(1, "a")], ROWS), put, ROWS)
    with pytest.raises(ValueError):
        Snapshots(spark, store.root, ["id"], 8).merge(spark.createDataFrame([(1, "a")], ROWS), put, ROWS)
    with pytest.raises(ValueError):
        store.merge(spark.createDataFrame([(1, "a")], ROWS), lambda old, new: spark.range(100).select("id", F.lit("x").alias("value")), ROWS)


def test_embeddings_of_changed_assets(spark, tmp_path):
    kind = "asset_id long, profile_key string, modality string, segment_index int, vector array<double>"
    store = media.embedding_store(spark, str(tmp_path / "e"), 8)
    media.merge_embeddings(store, spark.createDataFrame([(i, "p", "image", 0, [1.0, 0.0]) for i in range(40)] + [(1, "q", "image", 0, [1.0, 0.0])], kind), 2)
    before = store.manifest()
    new = [(1, "p", "image", 7, [0.0, 1.0]), (1, "p", "image", 3, [1.0, 1.0]), (3, "p", "image", 0, [float("nan"), 1.0]), (3, "p", "image", 1, [1.0, 1.0])]
    after = media.merge_embeddings(store, spark.createDataFrame(new, kind), 2)
    assert len([b for b in before["files"] if before["files"][b] != after["files"][b]]) <= 2
    got = {(r.asset_id, r.profile_key, r.segment_index): list(r.vector) for r in store.read().collect()}
    assert got[1, "p", 0] == [1.0, 1.0] and got[1, "p", 1] == [0.0, 1.0] and got[1, "q", 0] == [1.0, 0.0]
    assert got[3, "p", 0] == [1.0, 0.0] and len(got) == 42  # the asset with a broken vector keeps what it had


def test_detections_of_changed_hashes(spark, tmp_path):
    kind = "content_hash string, detector string, label string, score double"
    store = Snapshots(spark, str(tmp_path / "d"), ["content_hash"], 8)
    store.merge(spark.createDataFrame([("a", "d1", "cat", 0.9), ("a", "d2", "dog", 0.8), ("b", "d1", "cat", 0.7)], kind), c.replace_detections, kind)
    store.merge(spark.createDataFrame([("a", "d1", None, None)], kind), c.replace_detections, kind)
    assert {(r.content_hash, r.detector, r.label) for r in store.read().collect()} == {("a", "d2", "dog"), ("b", "d1", "cat")}
