"""Tables in versions: Parquet folders by key bucket, and a manifest that lists those of each version.

A change reads and writes only the buckets that hold its keys; the others go on as they are. A version is
there once its manifest is, which comes into being by one rename that fails if the name is taken, so
readers see no half-written state, a crash leaves nothing but unlisted folders, and of two writers who
start from one version the second is told.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import staged

KEPT_TAGS = 1000


class Conflict(RuntimeError):
    """Another writer has made the next version."""


class Snapshots:
    """A table at `root`, dealt into `buckets` by its key columns. Both are fixed by the first version."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], buckets: int = 64) -> None:
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """version, schema, key, buckets (number), files (bucket to folder), tags of the changes in it."""
        there = self.versions()
        if not there or version is not None and version not in there:
            return None
        stream = self._fs.open(self._path(f"manifests/v{there[-1] if version is None else version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one by default; a table without a version is an error."""
        found = self.manifest(version)
        if found is None:
            raise ValueError(f"{self.root} has no such version")
        return self._rows(found, list(found["files"]))

    def _rows(self, manifest: dict, buckets: list[str]) -> DataFrame:
        paths = [f"{self.root}/{manifest['files'][b]}" for b in buckets if b in manifest["files"]]
        if not paths:
            return self.spark.createDataFrame([], manifest["schema"])
        return self.spark.read.schema(manifest["schema"]).parquet(*paths)

    def bucket_of(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def merge(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], schema: str, tag: str | None = None) -> dict:
        """The next version: in each bucket that a key of `changes` falls into, the rows become
        apply(old rows of those buckets, changes). Returns its manifest. A change whose tag a version has
        already is not made again (the last 1,000 tags are kept); changes without rows make no version but the first.
        Raises Conflict if another writer was first; nothing of this change is then seen."""
        found = self.manifest() or {"version": 0, "schema": schema, "key": self.key, "buckets": self.buckets, "files": {}, "tags": []}
        if (found["key"], found["buckets"]) != (self.key, self.buckets):
            raise ValueError(f"{self.root} is dealt by {found['key']} into {found['buckets']}")
        if tag is not None and tag in found["tags"]:
            return found
        told = staged(changes, "changes")
        touched = sorted(r[0] for r in told.select(self.bucket_of()).distinct().collect())
        if not touched:
            return found if found["version"] else self._commit(found | {"version": 1})
        files, folder = dict(found["files"]), f"data/{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], found["schema"]).columns
        rows = apply(self._rows(found, [str(b) for b in touched]), told).select(*columns).withColumn("_bucket", self.bucket_of())
        rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        made = {x.getPath().getName().removeprefix("_bucket=") for x in self._fs.listStatus(self._path(folder)) if x.isDirectory()}
        if not made <= {str(b) for b in touched}:
            raise ValueError("a change made rows outside the buckets of its keys")
        for b in map(str, touched):
            files.pop(b, None)
            if b in made:
                files[b] = f"{folder}/_bucket={b}"
        return self._commit(found | {"version": found["version"] + 1, "files": files, "tags": ([*found["tags"], tag] if tag is not None else found["tags"])[-KEPT_TAGS:]})

    def _commit(self, manifest: dict) -> dict:
        """Publishes a manifest by a rename that does not overwrite."""
        self._fs.mkdirs(self._path("manifests"))
        own, name = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/v{manifest['version']:012d}.json")
        stream = self._fs.create(own, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self._fs.makeQualified(own), self._fs.makeQualified(name), none)
        except Exception as e:
            self._fs.delete(own, False)
            if self._fs.exists(name):
                raise Conflict(f"{self.root} has a version {manifest['version']}") from e
            raise
        return manifest

    def expire(self, keep: int = 2) -> None:
        """Deletes all versions but the last `keep`, and the folders that none of them lists. Not while a
        writer is at work: its folders are not listed yet."""
        there = self.versions()
        for v in there[:-keep]:
            self._fs.delete(self._path(f"manifests/v{v:012d}.json"), False)
        used = {f for v in there[-keep:] for f in self.manifest(v)["files"].values()}
        if self._fs.exists(self._path("data")):
            for commit in self._fs.listStatus(self._path("data")):
                for b in self._fs.listStatus(commit.getPath()):
                    if f"data/{commit.getPath().getName()}/{b.getPath().getName()}" not in used:
                        self._fs.delete(b.getPath(), True)
                if not self._fs.listStatus(commit.getPath()):
                    self._fs.delete(commit.getPath(), True)
