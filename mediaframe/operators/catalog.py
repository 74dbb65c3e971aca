"""Catalog rows: filters, gaps, listings, incremental merges of snapshots."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class MediaFilter:
    """Half-open date ranges (any of them), months of any year, places. Empty parts match all; a
    row without the date or place that a part looks at never matches."""

    ranges: list[tuple[str, str]] = field(default_factory=list)
    months: list[int] = field(default_factory=list)
    places: list[str] = field(default_factory=list)

    def to_column(self) -> Column:
        out = F.lit(True)
        if self.ranges:
            hit = F.lit(False)
            for a, b in self.ranges:
                hit = hit | ((F.col("taken_at") >= F.to_timestamp_ntz(F.lit(a))) & (F.col("taken_at") < F.to_timestamp_ntz(F.lit(b))))
            out = out & hit
        if self.months:
            out = out & F.month("taken_at").isin(self.months)
        if self.places:
            out = out & F.col("place").isin(self.places)
        return F.coalesce(out, F.lit(False))


def scope(assets: DataFrame, libraries: list | None = None, when: MediaFilter | None = None, media: tuple = ("image",), statuses: tuple = ("indexed",)) -> DataFrame:
    """Rows to browse or search; stills of live photos are hidden."""
    keep = F.col("media_type").isin(*media) & F.col("status").isin(*statuses) & F.col("live_photo").isNull()
    if libraries is not None:
        keep = keep & F.col("library_id").isin(libraries)
    return assets.filter(keep & when.to_column() if when else keep)


MOST_LISTED = 2000


def listing(rows: DataFrame, limit: int = 500) -> DataFrame:
    """rank, the columns of rows, total: the first `limit` (1 to 2,000) of what a filter has left, oldest first,
    undated ones last, and how many there are in all."""
    top = rows.orderBy(F.asc_nulls_last("taken_at"), "rel_path").limit(max(1, min(limit, MOST_LISTED)))  # a bounded number of rows
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_last("taken_at"), "rel_path")))
    return ranked.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))


def date_place_filter(assets: DataFrame, date_from: str | None = None, date_to: str | None = None, places: list[str] | None = None) -> DataFrame:
    """Both days count; open ends; from after to is an error."""
    if date_from and date_to and date_from > date_to:
        raise ValueError("date_from is after date_to")
    when = MediaFilter(places=places or [])
    keep = when.to_column()
    if date_from or date_to:
        keep = keep & F.col("taken_at").isNotNull()
        if date_from:
            keep = keep & (F.col("taken_at") >= F.to_timestamp_ntz(F.lit(date_from)))
        if date_to:
            keep = keep & (F.col("taken_at") < F.to_timestamp_ntz(F.lit(date_to)) + F.expr("interval 1 day"))
    return assets.filter(keep)


def import_diff(existing: DataFrame, scanned: DataFrame) -> DataFrame:
    """key, outcome: new, changed (hash differs), unchanged, missing; a missing file that returns is pending again."""
    e = existing.select(F.col("rel_path"), F.col("content_hash").alias("old"), F.col("status").alias("was"))
    s = scanned.select("rel_path", F.col("content_hash").alias("now"))
    j = e.join(s, "rel_path", "full")
    outcome = (F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("old") != F.col("now"), "changed").when(F.col("was") == "missing", "returned").otherwise("unchanged"))
    return j.select("rel_path", outcome.alias("outcome"))


def upsert_assets(existing: DataFrame, scanned: DataFrame) -> DataFrame:
    """The next snapshot: ids stay; changed content is pending again; same content only refreshes
    the size; what was missing and returns is pending; rows that were not scanned stay."""
    e = existing.select("rel_path", "asset_id", F.col("content_hash").alias("old"), F.col("status").alias("was"), F.col("size").alias("size0"))
    s = scanned.select("rel_path", F.col("content_hash").alias("now"), F.col("size").alias("size1"), F.col("new_id"))
    j = e.join(s, "rel_path", "full")
    status = (F.when(F.col("now").isNull(), F.col("was")).when(F.col("old").isNull() | (F.col("old") != F.col("now")) | (F.col("was") == "missing"), "pending").otherwise(F.col("was")))
    return j.select("rel_path", F.coalesce("asset_id", "new_id").alias("asset_id"), F.coalesce("now", "old").alias("content_hash"), F.coalesce("size1", "size0").alias("size"), status.alias("status"))


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys that new has, and new: the merge that plain Parquet lacks."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_detections(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the boxes of each (content_hash, detector) in new replaced; a row without a label says that
    a detector has run and found nothing, and leaves none."""
    return replace_keys(old, new, ["content_hash", "detector"]).filter("label is not null and label <> ''")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*keys, "_r.*")


def reuse_vectors(pending: DataFrame, donors: DataFrame) -> DataFrame:
    """For each pending asset the donor (smallest id) with the same content."""
    best = donors.groupBy("content_hash").agg(F.min("asset_id").alias("donor"))
    return pending.join(best, "content_hash").select("asset_id", "donor")


def pair_live(videos: DataFrame, images: DataFrame, most_s: float = 5.0, order: str = "rel_path") -> DataFrame:
    """Short videos and the photo of the same library and stem; of several photos the last path."""
    stem = F.lower(F.regexp_replace("rel_path", r"\.[^./]*$", ""))
    v = videos.filter(F.col("duration") <= most_s).select("library_id", stem.alias("stem"), F.col("asset_id").alias("video"))
    i = images.select("library_id", stem.alias("stem"), F.col("asset_id").alias("image"), F.col(order).alias("o"))
    return v.join(i, ["library_id", "stem"]).groupBy("video").agg(F.max_by("image", "o").alias("image"))


def filter_gaps(assets: DataFrame, dated: bool, placed: bool) -> DataFrame:
    """undated, unplaced: rows that a filter of that kind cannot see; null where no such filter is used."""
    count = lambda used, c: (F.count_if(F.col(c).isNull()) if used else F.lit(None).cast("long"))
    return assets.agg(count(dated, "taken_at").alias("undated"), count(placed, "place").alias("unplaced"))


def reuse_segments(pending: DataFrame, vectors: DataFrame, donors: DataFrame, keys: tuple[str, ...] = ("profile_key", "modality")) -> DataFrame:
    """All segments, in order, of the donor (smallest id) with the same content, for each pending asset."""
    pairs = reuse_vectors(pending, donors.join(vectors.select("asset_id").distinct(), "asset_id", "left_semi"))
    own = vectors.withColumnRenamed("asset_id", "donor")
    return pairs.join(own, "donor").select("asset_id", "donor", *keys, "segment_index", *[c for c in vectors.columns if c not in ("asset_id", "segment_index", *keys)])


def index_state(assets: DataFrame, vectors: DataFrame, profile: str, by: str = "library_id") -> DataFrame:
    """by, total, searchable, other_profile_vectors, state: empty (no row), incompatible (vectors of other
    profiles only), not_indexed, partial or ready; failed and missing files are not waited for."""
    v = vectors.groupBy("asset_id").agg(F.bool_or(F.col("profile_key") == profile).alias("own"), F.bool_or(F.col("profile_key") != profile).alias("other"))
    s = assets.join(v, "asset_id", "left").groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("own") & (F.col("status") == "indexed")).alias("searchable"), F.count_if(F.col("other")).alias("other_profile_vectors"),
        F.count_if(~F.col("status").isin("failed", "missing")).alias("wanted"))
    state = F.when((F.col("searchable") == 0) & (F.col("other_profile_vectors") > 0), "incompatible").when(F.col("searchable") == 0, "not_indexed").when(F.col("searchable") < F.col("wanted"), "partial").otherwise("ready")
    return s.select(by, "total", "searchable", "other_profile_vectors", state.alias("state"))


def drop_changed_vectors(vectors: DataFrame, existing: DataFrame, scanned: DataFrame) -> DataFrame:
    """Vectors of assets whose content is still the same after an import."""
    changed = import_diff(existing, scanned).filter("outcome = 'changed'").join(existing.select("rel_path", "asset_id"), "rel_path")
    return vectors.join(changed.select("asset_id"), "asset_id", "left_anti")


def mark_status(assets: DataFrame, marks: DataFrame) -> DataFrame:
    """Statuses and reasons of marks (asset_id, new_status, reason); a row that is fine again has no reason."""
    out = assets.join(marks, "asset_id", "left")
    return out.withColumn("status", F.coalesce("new_status", "status")).withColumn("reason", F.when(F.col("status").isin("failed", "missing"), F.col("reason"))).drop("new_status")


def live_status(videos: DataFrame, pairs: DataFrame) -> DataFrame:
    """asset_id, live_photo, changed: the photo of each video now, and whether that is another one than before."""
    now = videos.join(pairs.select(F.col("video").alias("asset_id"), F.col("image").alias("now")), "asset_id", "left")
    return now.select("asset_id", F.col("now").alias("live_photo"), (~F.col("now").eqNullSafe(F.col("live_photo"))).alias("changed"))


def rekey(vectors: DataFrame, profiles: DataFrame) -> DataFrame:
    """vectors under the first profile (by key) of the same space: profiles is (profile_key, space). Where
    two rows of an asset and segment meet, the one that was there under that key stays, then the smallest row id."""
    target = profiles.withColumn("target", F.min("profile_key").over(Window.partitionBy("space"))).select("profile_key", "target")
    moved = vectors.join(target, "profile_key")
    keys, others = ["asset_id", "modality", "segment_index", "target"], [c for c in vectors.columns if c not in ("asset_id", "modality", "segment_index", "profile_key")]
    order = F.struct((F.col("profile_key") != F.col("target")).alias("moved"), *others[:1])
    return moved.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_r")).select("asset_id", F.col("target").alias("profile_key"), "modality", "segment_index", "_r.*")


def cascade_delete(library, assets: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """assets and vectors without those of a library; items of selections keep their snapshots and are not touched."""
    gone = assets.filter(F.col("library_id") == library).select("asset_id")
    return assets.filter(~F.col("library_id").eqNullSafe(library)), vectors.join(gone, "asset_id", "left_anti")


def settled_changes(polls: DataFrame) -> DataFrame:
    """Polls (library_id, poll, signature) at which a change is settled: not as at the first poll, and
    as at the one before."""
    w = Window.partitionBy("library_id").orderBy("poll")
    seen = polls.withColumn("before", F.lag("signature").over(w)).withColumn("base", F.first("signature").over(w))
    return seen.filter("signature <> base and signature = before").select("library_id", "poll")
