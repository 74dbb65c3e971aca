"""Detected boxes: confidence bands, counts, matches, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import replace_keys

SURE, KEEP = 0.75, 0.5


def band(score: Column, sure: float = SURE, keep: float = KEEP) -> Column:
    return F.when(score >= sure, "sure").when(score >= keep, "maybe").otherwise("dropped")


def read_boxes(detections: DataFrame, column: str = "boxes_json") -> DataFrame:
    """One row for each box of a JSON list [[score, [x0, y0, x1, y1]], ...]."""
    kind = "array<array<string>>"
    each = F.explode(F.from_json(F.col(column), kind)).alias("b")
    rows = detections.select(*[c for c in detections.columns if c != column], each)
    box = F.from_json(F.col("b")[1], "array<double>")
    return rows.select(*[c for c in rows.columns if c != "b"], F.col("b")[0].cast("double").alias("score"), *[box[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


def area(prefix: str = "") -> Column:
    p = [F.col(prefix + c) for c in ("x0", "y0", "x1", "y1")]
    return F.greatest(F.lit(0.0), p[2] - p[0]) * F.greatest(F.lit(0.0), p[3] - p[1])


def exact_area() -> Column:
    """In units of the four places that coordinates have, so that equal areas are equal."""
    p = [F.round(F.col(c) * 10000).cast("long") for c in ("x0", "y0", "x1", "y1")]
    return F.greatest(F.lit(0), p[2] - p[0]) * F.greatest(F.lit(0), p[3] - p[1])


def clamp(column: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), column)), 4)


def iou(a: str, b: str) -> Column:
    """Of boxes with columns <a>x0.. and <b>x0..; 0 for an empty union."""
    ax, bx = ({c: F.col(p + c) for c in ("x0", "y0", "x1", "y1")} for p in (a, b))
    inter = F.greatest(F.lit(0.0), F.least(ax["x1"], bx["x1"]) - F.greatest(ax["x0"], bx["x0"])) * F.greatest(F.lit(0.0), F.least(ax["y1"], bx["y1"]) - F.greatest(ax["y0"], bx["y0"]))
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def prefixed(boxes: DataFrame, p: str, keys: tuple[str, ...]) -> DataFrame:
    return boxes.select(*[F.col(c) if c in keys else F.col(c).alias(p + c) for c in boxes.columns])


def count_objects(boxes: DataFrame, label: str, sure: float = SURE) -> DataFrame:
    """content_hash, n (sure boxes) and best score; n = 0: maybe there."""
    b = boxes.filter((F.col("label") == label) & (F.col("score") >= KEEP))
    return b.groupBy("content_hash").agg(F.count_if(F.col("score") >= sure).alias("n"), F.max("score").alias("best"))


def object_summary(boxes: DataFrame, sure: float = SURE) -> DataFrame:
    per = boxes.filter(F.col("score") >= sure).groupBy("label", "content_hash").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("label").agg(F.count(F.lit(1)).alias("photos"), F.sum("n").alias("objects")).orderBy(F.desc("photos"), "label")


def detections_for(runs: DataFrame, boxes: DataFrame, sure: float = SURE) -> DataFrame:
    """Counts by label of every checked photo; checked and empty is an empty map, unchecked no row."""
    per = boxes.filter(F.col("score") >= sure).groupBy("content_hash", "label").agg(F.count(F.lit(1)).alias("n"))
    maps = per.groupBy("content_hash").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("counts"))
    return runs.join(maps, "content_hash", "left").withColumn("counts", F.coalesce("counts", F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<bigint>))")))


def coverage(photos: DataFrame, runs: DataFrame) -> DataFrame:
    """Files (not hashes) in scope and those that the detector has looked at."""
    r = runs.select("content_hash").distinct().withColumn("seen", F.lit(True))
    return photos.join(r, "content_hash", "left").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("seen")).alias("checked"))


def without_corrections(photos: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Photos that no user has said the label is absent from."""
    return photos.join(verdicts.filter("present = 0").select("content_hash"), "content_hash", "left_anti")


def apply_corrections(shown: DataFrame, ranks: list[int], label: str, verdicts: DataFrame, verifier: str = "user") -> tuple[DataFrame, DataFrame]:
    """The user says that the photos at these ranks of an answer (rank, content_hash, ..) lack the label; -1 is
    the last. Returns the verdicts (content_hash, label, verifier, present) with these in place of older
    ones of the same key, and the rest of the answer. Copies of a photo share its verdict. A rank
    that the answer lacks is an error when a result is computed."""
    last = shown.agg(F.coalesce(F.max("rank"), F.lit(0)).cast("int").alias("last"))
    wanted = shown.sparkSession.createDataFrame([(r,) for r in sorted(set(ranks))], "pick int")
    pick = F.when(F.col("pick") == -1, F.col("last")).otherwise(F.col("pick"))
    valid = F.when(pick.between(1, F.col("last")), pick).otherwise(F.raise_error(F.concat(F.lit("the answer has "), F.col("last").cast("string"), F.lit(" photos"))).cast("int"))
    picks = F.broadcast(wanted.crossJoin(F.broadcast(last)).select(valid.alias("rank")).distinct())  # as many rows as ranks
    told = shown.join(picks, "rank").select("content_hash", F.lit(label).alias("label"), F.lit(verifier).alias("verifier"), F.lit(0).alias("present")).distinct()
    return replace_keys(verdicts, told, ["content_hash", "label", "verifier"]), shown.join(picks, "rank", "left_anti")


def match_boxes(truth: DataFrame, predicted: DataFrame, least_iou: float = 0.5, sure: float = SURE) -> DataFrame:
    """For each photo the largest true box that a sure prediction of its label covers."""
    p = prefixed(predicted.filter(F.col("score") >= sure), "p_", ("content_hash", "label"))
    hit = truth.join(p, ["content_hash", "label"]).withColumn("iou", iou("", "p_")).filter(F.col("iou") >= least_iou)
    return hit.groupBy("content_hash").agg(F.max_by(F.struct("label", "box_no"), F.struct(exact_area().alias("area"), (-F.col("box_no")).alias("b"), "label")).alias("m")).select("content_hash", "m.label", "m.box_no")


def survive(before: DataFrame, after: DataFrame, kept: float = 0.5, removed: float = 0.3) -> DataFrame:
    """kept: a box of the label overlaps enough afterwards; removed: none does even a little."""
    a = prefixed(after, "a_", ("content_hash", "label"))
    best = before.join(a, ["content_hash", "label"], "left").groupBy("content_hash", "label", "box_no").agg(F.max(F.when(F.col("a_box_no").isNotNull(), iou("", "a_")).otherwise(0.0)).alias("best"))
    return best.select("content_hash", "label", "box_no", (F.col("best") >= kept).alias("kept"), (F.col("best") < removed).alias("removed"))


def main_object(boxes: DataFrame, sure: float = SURE) -> DataFrame:
    b = boxes.filter(F.col("score") >= sure)
    return b.groupBy("content_hash").agg(F.max_by("label", F.struct(exact_area().alias("area"), (-F.col("box_no")).alias("b"), "label")).alias("label"))


def top_refine(ranked: DataFrame, sure: int = 3) -> DataFrame:
    return ranked.withColumn("maybe", F.col("rank") > sure)


def multi_label(boxes: DataFrame, labels: list[str], sure: float = SURE, cap_sure: int = 48, cap_maybe: int = 24) -> DataFrame:
    """Photos of any of the labels without repeats, sure ones first in the order of labels; caps as
    in the answer they are shown in."""
    order = F.create_map(*[x for i, l in enumerate(labels) for x in (F.lit(l), F.lit(i))])
    b = boxes.filter(F.col("label").isin(labels) & (F.col("score") >= KEEP))
    per = b.groupBy("content_hash", "label").agg(F.max("score").alias("best"), F.count_if(F.col("score") >= sure).alias("n"))
    one = per.groupBy("content_hash").agg(F.min(F.struct((F.col("n") == 0).alias("maybe"), order[F.col("label")].alias("o"), (-F.col("n")).alias("neg"), (-F.col("best")).alias("negb"))).alias("k"))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("k", "content_hash"))  # of the few that are left
    parts = [one.filter(F.col("k.maybe") == m).orderBy("k", "content_hash").limit(cap).withColumn("place", place) for m, cap in ((False, cap_sure), (True, cap_maybe))]
    return parts[0].unionByName(parts[1]).select("content_hash", F.col("k.maybe").alias("maybe"), "place")


def example_per_label(boxes: DataFrame, labels: int = 6, sure: float = SURE) -> DataFrame:
    """For the most frequent labels, in order, the first photo that no earlier label has taken. Each
    label needs at most `labels` candidates, so the choice folds over a tiny table."""
    per = boxes.filter(F.col("score") >= sure).groupBy("label", "content_hash").agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy("label").agg(F.count(F.lit(1)).alias("photos")).orderBy(F.desc("photos"), "label").limit(labels)
    w = Window.partitionBy("label").orderBy(F.desc("n"), "content_hash")
    few = per.join(F.broadcast(top), "label").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= labels)
    each = few.groupBy("label", "photos").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "content_hash"))), lambda x: x["content_hash"]).alias("c"))
    listed = each.agg(F.array_sort(F.collect_list(F.struct((-F.col("photos")).alias("neg"), "label", "c"))).alias("l"))
    pick = F.aggregate("l", F.expr("cast(array() as array<struct<label:string,content_hash:bigint>>)"), lambda acc, x: F.concat(acc, F.array(F.struct(
        x["label"].alias("label"), F.element_at(F.array_except(x["c"], F.transform(acc, lambda a: a["content_hash"])), 1).alias("content_hash")))))
    return listed.select(F.explode(pick).alias("e")).select("e.*")
