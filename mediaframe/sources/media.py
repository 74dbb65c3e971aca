"""Sources of a media catalog: file listings, gazetteers, provenance, decoded images, vectors."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import is_valid, l2_normalize
from .snapshots import Snapshots

#: Fixed extensions by media type.
EXTENSIONS = {"image": "jpg jpeg png webp heic gif bmp tif tiff", "audio": "mp3 wav flac m4a ogg opus aac", "video": "mp4 mov mkv webm m4v avi"}


def scan_media_files(spark: SparkSession, root: str, types: tuple[str, ...] = ("image", "audio", "video"), content: bool = False) -> DataFrame:
    """rel_path, ext, media_type, size, modified of the files under root; hidden files and folders are
    left out (Spark also passes over names with an underscore in front). Bytes are read only if
    content is asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit(root.rstrip("/").split(":", 1)[-1].lstrip("/"))
    path = F.regexp_replace("path", r"^\w+:/*", "")
    rel = F.expr("substring(p, length(b) + 2)")
    kind = F.create_map(*[x for t in types for e in EXTENSIONS[t].split() for x in (F.lit(e), F.lit(t))])
    out = (files.withColumn("p", path).withColumn("b", base).withColumn("rel_path", rel).withColumn("ext", F.lower(F.regexp_extract("rel_path", r"\.([^./]+)$", 1)))
           .withColumn("media_type", kind[F.col("ext")]).filter(F.col("media_type").isNotNull() & ~F.col("rel_path").rlike(r"(^|/)\.")))
    return out.select("rel_path", "ext", "media_type", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))


def hash_content(files: DataFrame) -> DataFrame:
    return files.withColumn("content_hash", F.sha2("content", 256))


def folder_signature(files: DataFrame, by: list[str]) -> DataFrame:
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.sum(F.unix_micros("modified")).alias("mtimes"))


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Headerless tab-separated towns; gzip is read as such."""
    rows = spark.read.schema("name string, region string, country string, lat double, lon double, population double").csv(path, sep="\t")
    return rows.na.fill("", ["name", "region", "country"])


def write_gazetteer(towns: DataFrame, path: str) -> None:
    towns.select("name", "region", "country", "lat", "lon", "population").write.csv(path, sep="\t", compression="gzip", emptyValue="")


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """A sidecar {"licence": .., "items": {file: record}} as one row a file; a record without a licence has the data set's."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "licence string, items map<string, struct<title:string, author:string, url:string, licence:string>>").alias("j"))
    return raw.select("j.licence", F.explode("j.items").alias("rel_path", "r")).select("rel_path", "r.title", "r.author", "r.url", F.coalesce("r.licence", "licence").alias("licence"))


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """{query: {candidate: grade}} as rows; the entry _meta is none."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, string>").alias("j"))
    each = raw.select(F.explode("j").alias("query", "m")).filter("query <> '_meta'")
    return each.select("query", F.explode(F.from_json("m", "map<string, int>")).alias("candidate", "grade"))


def read_decoded_images(spark: SparkSession, path: str, together: int = 10, few: int = 32) -> DataFrame:
    """origin, width, height, channels and pixel bytes (BGR) of the images in all folders below path,
    decoded by Spark's own source; files that are no images are left out. Spark counts 4 MB for opening a
    file, so that a partition has some 32 small ones: `together` of them are one task, if there are more than
    `few`. Files in more than 32 folders are listed by tasks, others by the driver."""
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    parts = images.rdd.getNumPartitions()
    dealt = images.coalesce(max(few, -(-parts // together))) if parts > few else images
    return dealt.select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")


def synthetic_vectors(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """Seeded unit vectors with ids from 0, for tests of scale. The same seed gives the same vectors as
    long as the number of partitions (spark.default.parallelism) is the same."""
    raw = spark.range(n).withColumn("vector", F.array(*[F.randn(seed + i) for i in range(dim)]))
    return raw.select(F.col("id").alias("asset_id"), l2_normalize("vector").cast("array<float>").alias("vector"))


EMBEDDINGS = "asset_id long, profile_key string, modality string, segment_index int, vector array<double>"


def _dense(new: DataFrame, dim: int) -> DataFrame:
    """Vectors of assets of which all are valid, with segments numbered from 0."""
    bad = new.filter(~is_valid("vector", dim)).select("asset_id").distinct()
    w = Window.partitionBy("asset_id", "profile_key", "modality").orderBy("segment_index")
    return new.join(bad, "asset_id", "left_anti").withColumn("segment_index", F.row_number().over(w) - 1)


def write_embeddings(spark: SparkSession, old: DataFrame | None, new: DataFrame, root: str, dim: int) -> str:
    """A whole snapshot in one folder, whose path is returned: all vectors of the (asset_id, profile_key,
    modality) in new replace the old ones, segment_index is dense, an asset with an invalid vector is left
    out as a whole. For changes of a large table see `merge_embeddings`."""
    keys = ["asset_id", "profile_key", "modality"]
    good = _dense(new, dim)
    every = good if old is None else old.join(good.select(*keys).distinct(), keys, "left_anti").unionByName(good.select(*old.columns))
    path = f"{root.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    every.write.partitionBy("profile_key", "modality").parquet(path)
    return path


def embedding_store(spark: SparkSession, root: str, buckets: int = 64) -> Snapshots:
    return Snapshots(spark, root, ["asset_id"], buckets)


def merge_embeddings(store: Snapshots, new: DataFrame, dim: int, tag: str | None = None) -> dict:
    """As `write_embeddings`, but only the buckets of the assets in new are rewritten."""
    keys = ["asset_id", "profile_key", "modality"]

    def apply(old: DataFrame, rows: DataFrame) -> DataFrame:
        good = _dense(rows, dim)
        return old.join(good.select(*keys).distinct(), keys, "left_anti").unionByName(good.select(*old.columns))

    return store.merge(new, apply, EMBEDDINGS, tag)


def detect(photos: DataFrame, detector, batch: int = 16) -> DataFrame:
    """content_hash, label, score, box rows of a detector made once a task; one run for each hash.
    A photo that fails is a row with its error."""
    def run(parts):
        fn = detector()
        for part in parts:
            rows = []
            for h, data in zip(part["content_hash"], part["content"], strict=True):
                try:
                    rows += [(h, label, float(score), list(map(float, box)), None) for label, score, box in fn(data)]
                except Exception as e:
                    rows.append((h, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["content_hash", "label", "score", "box", "error"])

    one = photos.dropDuplicates(["content_hash"]).select("content_hash", "content")
    return one.mapInPandas(run, "content_hash string, label string, score double, box array<double>, error string")
