"""Streams: folder watching, incremental imports, one row for each hash."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..sources.snapshots import Snapshots

#: Typed state and timers need this store; set it before the stream starts.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: A run that ends when all is read makes no batches without rows: with timers there would always be another.
DRAINED = STATE_STORE | {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}

WATCHED = "library_id long, poll long, signature string, attempt int"


@contextmanager
def configured(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session while a stream starts."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def settle(baseline: str | None, pending: str | None, seen: str) -> tuple[str, str | None, bool]:
    """Baseline, pending and whether to import: the first sight is the baseline; a change has to be
    seen alike twice."""
    if baseline is None or seen == baseline:
        return baseline or seen, None, False
    return (seen, None, True) if seen == pending else (baseline, seen, False)


class FolderWatch(StatefulProcessor):
    """State of one library: `folder` (the signature that was imported, one seen once) and `import` (the
    last import asked for and how often it was). A failed import sets a timer, at which it is asked for
    again; both states are forgotten when no poll has come for `forget`."""

    def __init__(self, retry: timedelta, forget: timedelta) -> None:
        self.retry_ms, self.forget_ms = (max(1, int(t.total_seconds() * 1000)) for t in (retry, forget))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folder = handle.getValueState("folder", "baseline string, pending string", self.forget_ms)
        self.asked = handle.getValueState("import", "poll long, signature string, attempt int", self.forget_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        baseline, pending = self.folder.get() if self.folder.exists() else (None, None)
        last = self.asked.get() if self.asked.exists() else None
        due = False
        for row in sorted(rows, key=lambda r: (r.poll, r.failed or False)):
            if row.failed:  # of an import: only the last one is worth another attempt
                due = due or last is not None and row.signature == last[1]
            elif not row.signature:
                baseline = pending = last = None
                due = False
            else:
                baseline, pending, changed = settle(baseline, pending, row.signature)
                if changed:
                    last, due = (row.poll, row.signature, 1), False
                    yield Row(library_id=key[0], poll=row.poll, signature=row.signature, attempt=1)
        for state, value in ((self.folder, None if baseline is None else (baseline, pending)), (self.asked, last)):
            if value is not None:
                state.update(value)
            elif state.exists():
                state.clear()
        if due or last is None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if due:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.retry_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.asked.exists():
            poll, signature, attempt = self.asked.get()
            self.asked.update((poll, signature, attempt + 1))
            yield Row(library_id=key[0], poll=poll, signature=signature, attempt=attempt + 1)

    def close(self) -> None:
        pass


def watch_folders(polls: DataFrame, retry: timedelta = timedelta(seconds=20), forget: timedelta = timedelta(days=30)) -> DataFrame:
    """library_id, poll, signature, attempt of the imports to make, from a stream of polls (library_id, poll,
    signature and, if there is such a column, failed).

    The first sight of a library is its baseline; a change counts when it is seen alike at two polls in a
    row. An empty signature means that the library is not watched any more, and forgets it. A row with
    failed = true says that the import of that signature could not be made; it is asked for again after
    `retry`. A library without polls for `forget` is forgotten. Polls of one micro-batch are taken in
    order; the session needs STATE_STORE."""
    rows = polls if "failed" in polls.columns else polls.withColumn("failed", F.lit(False))
    return rows.select("library_id", "poll", "signature", "failed").groupBy("library_id").transformWithState(FolderWatch(retry, forget), WATCHED, "Append", "ProcessingTime")


def first_per_hash(stream: DataFrame, key: str = "content_hash") -> DataFrame:
    return stream.dropDuplicates([key])


CATALOG = "rel_path string, asset_id long, content_hash string, size long, status string"


def incremental_import(spark: SparkSession, root: str, catalog: str, checkpoint: str, schema: str, file_format: str = "json", buckets: int = 64, files: int = 1000):
    """Starts a stream of listings (rel_path, content_hash, size, new_id, seq) that are merged into the
    catalog's versions (`Snapshots`), `files` of them at a time: a batch rewrites the buckets of its paths.
    A replayed batch changes nothing. Only the first batch may start from nothing."""
    from ..operators.catalog import upsert_assets

    def merge(batch: DataFrame, epoch: int) -> None:
        store = Snapshots(batch.sparkSession, catalog, ["rel_path"], buckets)
        if epoch and not store.versions():
            raise ValueError(f"{catalog} has no version before batch {epoch}: its rows would be lost")
        latest = batch.groupBy("rel_path").agg(F.max_by(F.struct("content_hash", "size", "new_id"), "seq").alias("r")).select("rel_path", "r.*")
        store.merge(latest, upsert_assets, CATALOG, tag=f"{checkpoint}#{epoch}")

    stream = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files).load(root)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_snapshot(spark: SparkSession, catalog: str) -> DataFrame:
    """The last version of a catalog."""
    return Snapshots(spark, catalog, ["rel_path"]).read()


def two_phase(assets: DataFrame, vectors: DataFrame) -> DataFrame:
    """What can be seen while vectors still come: every asset, and whether it can be searched."""
    v = vectors.select("asset_id").distinct().withColumn("searchable", F.lit(True))
    return assets.join(v, "asset_id", "left").withColumn("searchable", F.coalesce("searchable", F.lit(False)))


def two_sinks(spark: SparkSession, listing: DataFrame, vectors: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Runs a stream of catalog rows and then one of their vectors, each into its own table: what is
    imported can be browsed before any vector is there. Returns both tables, which are read afresh."""
    for name, stream in (("catalog", listing), ("embeddings", vectors)):
        run = stream.writeStream.format("parquet").option("path", f"{root}/{name}").option("checkpointLocation", f"{root}/{name}-state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(listing.schema).parquet(f"{root}/catalog"), spark.read.schema(vectors.schema).parquet(f"{root}/embeddings")
