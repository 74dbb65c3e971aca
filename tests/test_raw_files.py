"""Files written from rows: whole, replayable, below their root; bitmaps come back as they were."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaframe.functions import pixels
from mediaframe.sources import media
from mediaframe.sources.rawfiles import write_files


def test_files_hold_their_bytes_and_replays_change_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a/b/x.bin", b"\x00\xff"), ("y.JPG", b"abc"), ("empty.txt", None)], "p string, c binary").repartition(3)
    for _ in range(2):
        write_files(rows, str(tmp_path / "root"), F.col("p"), F.col("c"))
    found = {str(f.relative_to(tmp_path / "root")): f.read_bytes() for f in (tmp_path / "root").rglob("*") if f.is_file()}
    assert found == {"a/b/x.bin": b"\x00\xff", "y.JPG": b"abc", "empty.txt": b""}
    write_files(rows.limit(0), str(tmp_path / "none"), F.col("p"), F.col("c"))
    write_files(rows.filter("p = 'y.JPG'"), str(tmp_path / "root"), F.col("p"), F.lit("über"))
    assert (tmp_path / "root/y.JPG").read_bytes() == "über".encode() and (tmp_path / "root/empty.txt").exists()


@pytest.mark.parametrize("path", ["../up.txt", "/etc/x", "a//b", "a/./b", "", None])
def test_paths_outside_the_root_fail(spark, tmp_path, path):
    rows = spark.createDataFrame([(path, b"x")], "p string, c binary")
    with pytest.raises(Exception, match="rel_path|path below"):
        write_files(rows, str(tmp_path / "root"), F.col("p"), F.col("c"))
    assert not [f for f in tmp_path.rglob("*") if f.is_file()]


def test_other_columns_and_overwriting_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([("x", b"x")], "rel_path string, content binary")
    write_files(rows, str(tmp_path), F.col("rel_path"), F.col("content"))
    with pytest.raises(Exception, match="only appends"):
        rows.write.format("rawfiles").mode("overwrite").save(str(tmp_path))
    with pytest.raises(Exception, match="rawfiles takes"):
        rows.withColumnRenamed("content", "bytes").write.format("rawfiles").mode("append").save(str(tmp_path))


def test_bitmaps_come_back(spark, tmp_path):
    rng = np.random.default_rng(3)
    made = {(w, h): rng.integers(0, 256, 3 * w * h, np.uint8).tobytes() for w in (1, 2, 3, 4, 7) for h in (1, 3, 8)}
    rows = spark.createDataFrame([(w, h, d) for (w, h), d in made.items()] + [(2, 2, b"short"), (None, 1, b"abc"), (0, 0, b"")], "w int, h int, d binary")
    files = rows.select("w", "h", pixels.bmp("d", "w", "h").alias("c"))
    assert files.filter("c is null").count() == 3
    write_files(files.filter("c is not null"), str(tmp_path), F.format_string("%d/%d.bmp", "w", "h"), F.col("c"))
    write_files(spark.range(1), str(tmp_path), F.lit("no.bmp"), F.lit("no picture"))
    assert {(r.width, r.height): bytes(r.data) for r in media.read_decoded_images(spark, str(tmp_path)).collect()} == made


def test_small_images_are_read_many_a_task(spark, tmp_path):
    rows = spark.range(200).select("id", pixels.bmp(F.unhex(F.repeat(F.lit("10"), 12)), F.lit(2), F.lit(2)).alias("content"))
    root = write_files(rows, str(tmp_path / "many"), F.concat(F.col("id") % 40, F.lit("/"), "id", F.lit(".bmp")), F.col("content"))
    found = media.read_decoded_images(spark, root, together=1000, few=2)
    assert found.rdd.getNumPartitions() == 2 and found.select("origin").distinct().count() == 200
