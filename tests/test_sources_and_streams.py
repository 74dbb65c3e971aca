import hashlib
import json
import struct
import time
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaframe.functions import pixels
from mediaframe.sources import media
from mediaframe.streaming import watch


def bmp(path, rgb, w=8, h=6):
    row = bytes(reversed(rgb)) * w
    row += b"\0" * (-len(row) % 4)
    body = row * h
    path.write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body)


def test_scan_and_hash(spark, tmp_path):
    for name, data in {"a.JPG": b"1", "sub/b.png": b"22", ".hidden.jpg": b"3", "note.txt": b"4", "sub/.h/c.jpg": b"5", "d.mp3": b"6"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = media.scan_media_files(spark, str(tmp_path), content=True)
    got = {r.rel_path: (r.media_type, r.content_hash) for r in media.hash_content(files).collect()}
    assert got == {"a.JPG": ("image", hashlib.sha256(b"1").hexdigest()), "sub/b.png": ("image", hashlib.sha256(b"22").hexdigest()), "d.mp3": ("audio", hashlib.sha256(b"6").hexdigest())}
    s = media.folder_signature(files.withColumn("library_id", F.lit(1)), ["library_id"]).first()
    assert (s.n, s.bytes) == (3, 4)


def test_images(spark, tmp_path):
    bmp(tmp_path / "red.bmp", (200, 10, 10))
    bmp(tmp_path / "grey.bmp", (120, 120, 120))
    img = media.read_decoded_images(spark, str(tmp_path)).withColumn("box", F.array(*[F.lit(x) for x in (0.0, 0.0, 1.0, 1.0)]))
    args = ["data", "width", "height", "nChannels"]
    rows = img.select("origin", pixels.sharpness(*args).alias("s"), *[pixels.colour_share(c)(*args, "box").alias(c) for c in ("red", "grey", "blue")]).collect()
    got = {r.origin.rsplit("/", 1)[1]: (r.s, r.red, r.grey, r.blue) for r in rows}
    assert got == {"red.bmp": (0.0, 1.0, 0.0, 0.0), "grey.bmp": (0.0, 0.0, 1.0, 0.0)}
    checker = np.indices((8, 8)).sum(0) % 2 * 255.0
    assert pixels.laplacian_variance(np.repeat(checker[:, :, None], 3, 2)) > 1e5


def test_tables_from_files(spark, tmp_path):
    towns = spark.createDataFrame([("Goa", "", "India", 15.0, 74.0, 5.0)], "name string, region string, country string, lat double, lon double, population double")
    media.write_gazetteer(towns, str(tmp_path / "g"))
    assert [tuple(r) for r in media.read_gazetteer(spark, str(tmp_path / "g")).collect()] == [("Goa", "", "India", 15.0, 74.0, 5.0)]
    (tmp_path / "p.json").write_text(json.dumps({"licence": "CC0", "items": {"a.jpg": {"title": "A"}, "b.jpg": {"licence": "BY"}}}))
    assert {r.rel_path: r.licence for r in media.read_provenance(spark, str(tmp_path / "p.json")).collect()} == {"a.jpg": "CC0", "b.jpg": "BY"}
    (tmp_path / "l.json").write_text(json.dumps({"_meta": {"x": "y"}, "q1": {"a": 2, "b": 0}}))
    assert sorted(tuple(r) for r in media.read_judgements(spark, str(tmp_path / "l.json")).collect()) == [("q1", "a", 2), ("q1", "b", 0)]


def test_write_embeddings(spark, tmp_path):
    kind = "asset_id long, profile_key string, modality string, segment_index int, vector array<double>"
    old = spark.createDataFrame([(1, "p", "image", 0, [1.0, 0.0]), (2, "p", "image", 0, [1.0, 0.0])], kind)
    new = spark.createDataFrame([(1, "p", "image", 7, [0.0, 1.0]), (1, "p", "image", 3, [1.0, 1.0]), (3, "p", "image", 0, [float("nan"), 1.0]), (3, "p", "image", 1, [1.0, 1.0])], kind)
    got = spark.read.parquet(media.write_embeddings(spark, old, new, str(tmp_path), 2)).collect()
    assert sorted((r.asset_id, r.segment_index) for r in got) == [(1, 0), (1, 1), (2, 0)]
    v = media.synthetic_vectors(spark, 5, 8).collect()
    assert all(abs(np.linalg.norm(r.vector) - 1) < 1e-6 for r in v)


def test_detect_runs_once_a_hash(spark):
    def detector():
        def fn(data):
            if data == b"bad":
                raise ValueError("broken")
            return [("car", 0.9, (0, 0, 1, 1))]

        return fn

    df = spark.createDataFrame([("h", b"x"), ("h", b"x"), ("i", b"bad")], "content_hash string, content binary")
    assert {(r.content_hash, r.label, r.error) for r in media.detect(df, detector).collect()} == {("h", "car", None), ("i", None, "ValueError: broken")}


def test_settling():
    states = [("a", None, False)]
    baseline, pending, out = None, None, []
    for seen in "aabbbcdd":
        baseline, pending, changed = watch.settle(baseline, pending, seen)
        out.append(changed)
    assert out == [False, False, False, True, False, False, False, True] and states


@pytest.fixture
def typed_state(spark):
    with watch.configured(spark, watch.DRAINED):
        yield


def test_watch_stream(spark, tmp_path, typed_state):
    rows = [(1, i, s) for i, s in enumerate("aabbbcdd")] + [(2, 0, "x"), (2, 1, ""), (2, 2, "y"), (2, 3, "y")]
    spark.createDataFrame(rows, "library_id long, poll long, signature string").coalesce(1).write.json(str(tmp_path / "in"))
    polls = spark.readStream.schema("library_id long, poll long, signature string").json(str(tmp_path / "in"))
    q = watch.watch_folders(polls).writeStream.format("memory").queryName("watched").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.library_id, r.poll) for r in spark.table("watched").collect()) == [(1, 3), (1, 7)]


def test_watch_survives_restarts_and_asks_again(spark, tmp_path, typed_state):
    """Each run is a restart from the checkpoint; a failed import is asked for again after a while, once."""
    kind = "library_id long, poll long, signature string, failed boolean"

    def run(name, rows, retry=timedelta(milliseconds=1)):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("".join(json.dumps(dict(zip(("library_id", "poll", "signature", "failed"), r, strict=True))) + "\n" for r in rows))
        polls = spark.readStream.schema(kind).json(str(tmp_path / "in"))
        stream = watch.watch_folders(polls, retry=retry).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        stream.trigger(availableNow=True).start().awaitTermination()
        return sorted((r.library_id, r.poll, r.signature, r.attempt) for r in spark.read.schema(watch.WATCHED).parquet(str(tmp_path / "out")).collect())

    assert run("1", [(1, 0, "a", None), (2, 0, "a", None)]) == []
    assert run("2", [(1, 1, "b", None), (2, 1, "c", None)]) == []
    asked = [(1, 2, "b", 1)]
    assert run("3", [(1, 2, "b", None), (2, 2, "d", None)]) == asked  # library 2 is still changing
    assert run("4", [(1, 3, "b", True)]) == asked  # it failed: the timer is set
    time.sleep(0.1)
    asked = sorted([*asked, (1, 2, "b", 2), (2, 4, "d", 1)])
    assert run("5", [(2, 4, "d", None)]) == asked
    assert run("6", [(2, 5, "d", None)]) == asked  # not asked for a third time
    assert run("7", [(1, 6, "b", True), (2, 6, "old", True)], retry=timedelta(hours=1)) == asked  # not yet due; and not its last import
    assert run("8", [(1, 7, "", None)]) == asked  # unwatched: nothing is due any more
    assert run("9", [(1, 8, "z", None), (1, 9, "z", None)]) == asked  # a new first sight


def test_incremental_import_replays_do_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "rel_path string, content_hash string, size long, new_id long, seq long"

    def put(name, rows):
        (tmp_path / "in" / name).write_text("".join(json.dumps(dict(zip(("rel_path", "content_hash", "size", "new_id", "seq"), r, strict=True))) + "\n" for r in rows))

    def run():
        watch.incremental_import(spark, str(tmp_path / "in"), str(tmp_path / "cat"), str(tmp_path / "ck"), schema).awaitTermination()
        return {r.rel_path: (r.asset_id, r.content_hash, r.status) for r in watch.latest_snapshot(spark, str(tmp_path / "cat")).collect()}

    put("1.json", [("a", "h1", 1, 1, 1), ("b", "h2", 1, 2, 1)])
    first = run()
    assert first == {"a": (1, "h1", "pending"), "b": (2, "h2", "pending")} and run() == first
    put("2.json", [("a", "h9", 1, 7, 2)])
    assert run() == {"a": (1, "h9", "pending"), "b": (2, "h2", "pending")}


def test_streams_read_tables_of_many_files(spark, tmp_path):
    from mediaframe.registry import QUERIES

    for name, parts in (("events", 3), ("embeddings", 2)):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(parts).write.parquet(f"{tmp_path}/{name}.parquet")
    for query in ("i4_two_sinks", "i1_watch_stream", "i3_first_per_hash_stream"):
        got, want = (sorted(map(tuple, QUERIES[query](spark, d).collect())) for d in (str(tmp_path), "/root/testdata/sf0.001"))
        assert got == want, query
