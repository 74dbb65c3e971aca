"""Ordered selections of assets: positions, manifests, names of exported files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .blocks import numbered


def reorder(items: DataFrame, by: list[str]) -> DataFrame:
    return items.withColumn("position", F.row_number().over(Window.partitionBy("selection_id").orderBy(*by)))


def add_items(items: DataFrame, new: DataFrame) -> DataFrame:
    """new at the end, but for those that are there already (same asset and same range, where no
    range equals no range)."""
    o = items.select(*[F.col(c).alias(f"o_{c}") for c in ("selection_id", "asset_id", "start_s", "end_s")])
    same = (F.col("selection_id") == F.col("o_selection_id")) & (F.col("asset_id") == F.col("o_asset_id")) & F.col("start_s").eqNullSafe(F.col("o_start_s")) & F.col("end_s").eqNullSafe(F.col("o_end_s"))
    fresh = new.join(o, same, "left_anti")
    top = items.groupBy("selection_id").agg(F.max("position").alias("top"))
    number = F.row_number().over(Window.partitionBy("selection_id").orderBy("position"))
    placed = fresh.join(top, "selection_id", "left").withColumn("position", F.coalesce("top", F.lit(0)) + number).drop("top")
    return items.unionByName(placed.select(*items.columns))


def item_status(items: DataFrame, there: DataFrame) -> DataFrame:
    """ok, missing (no content), removed (no asset) or changed (another hash than the snapshot's)."""
    t = there.select("asset_id", "content_hash", F.lit(True).alias("known"))
    status = F.when(F.col("known").isNull(), "removed").when(F.col("content_hash").isNull(), "missing").when(F.col("content_hash") != F.col("snapshot"), "changed").otherwise("ok")
    return items.join(t, "asset_id", "left").withColumn("status", status)


def validate_ranges(ranges: DataFrame, least_s: float = 0.5, most_s: float = 600.0) -> DataFrame:
    """end_s cut to the duration; reason says why a range is no clip."""
    cut = ranges.withColumn("end_s", F.least("end_s", "duration"))
    length = F.col("end_s") - F.col("start_s")
    reason = F.when(F.col("start_s") < 0, "starts before 0").when(length <= 0, "empty").when(length < least_s, "too short").when(length > most_s, "too long")
    return cut.withColumn("reason", reason)


def manifest(items: DataFrame) -> DataFrame:
    """One nested record of items in order for each selection, ready for write.json; with a pair of
    dimensions and a pair of seconds (or null) where items have those columns."""
    status = F.when(F.col("state") == "F", "ok").when(F.col("state") == "O", "changed").otherwise("missing")
    pair = lambda x, y, name: [F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.array(x, y)).alias(name)] if {x, y} <= set(items.columns) else []
    item = F.struct("position", "asset_id", status.alias("status"), F.format_string("p/%d.jpg", "asset_id").alias("source"), *pair("width", "height", "dims"), *pair("start_s", "end_s", "segment"))
    return items.groupBy("selection_id").agg(F.array_sort(F.collect_list(item)).alias("items"))


def export_rows(items: DataFrame) -> DataFrame:
    """items with row: file, clip (a part of a video), or why it is skipped. A part has start_s."""
    part = F.col("start_s").isNotNull()
    kind = F.when(F.col("status") != "ok", "skipped: not there").when(part & (F.col("media_type") == "video"), "clip").when(part & (F.col("media_type") == "audio"), "skipped: part of a sound").when(part, "skipped: part of a picture")
    return items.withColumn("row", kind.otherwise("file"))


def free_names(files: DataFrame) -> DataFrame:
    """id, name: names that no two files share, whatever the case. In order of id, a file whose name
    is taken gets " (2)", " (3)" and so on, the first that is free.

    Names only meet where they have the same root (without numbers in brackets) and extension. Where
    all files of a root have the same name, that is their number in order, by ranges of rows. Only
    roots of several names ("a.jpg" and "a (2).jpg") are walked through one by one."""
    root = F.concat(F.regexp_replace(F.lower("stem"), r"( \(\d+\))+$", ""), F.lower("ext"))
    rows = files.select("id", "stem", "ext", root.alias("root"), F.lower(F.concat("stem", "ext")).alias("low"))
    kinds = rows.groupBy("root").agg((F.min("low") != F.max("low")).alias("mixed"))
    both = staged(rows.join(kinds.hint("merge"), "root"))
    n = F.col("n")
    plain = numbered(both.filter("not mixed"), ["low"], ["id"], "n").select("id", F.when(n == 1, F.concat("stem", "ext")).otherwise(F.concat("stem", F.lit(" ("), n, F.lit(")"), "ext")).alias("name"))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        taken, last, names = set(), {}, []
        group = group.sort_values("id")
        for stem, ext in zip(group["stem"], group["ext"], strict=True):
            key = (stem + ext).lower()
            n, name = last.get(key, 0) + 1, stem + ext
            while (name := stem + ext if n == 1 else f"{stem} ({n}){ext}").lower() in taken:
                n += 1
            last[key] = n
            taken.add(name.lower())
            names.append(name)
        return pd.DataFrame({"id": group["id"], "name": names})

    kind = dict(files.dtypes)["id"]
    return plain.unionByName(both.filter("mixed").groupBy("root").applyInPandas(walk, f"id {kind}, name string"))
