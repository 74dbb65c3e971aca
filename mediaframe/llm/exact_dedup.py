"""Exact duplicates by a tree-merge of sorted digest runs; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, keep_keyed, keyed, runs_for, stage

KEYS = ["_sha", "_len", "_xx"]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max",
                fan_in: int = 16, rows_per_run: int = 8192) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Every document becomes a digest (SHA-256 of its text, verified by a second, unrelated 64-bit
    hash and the length). Digests are dealt into runs by a hash of the id. Each run is sorted and
    reduced to one row for each digest, then `fan_in` neighbouring runs meet at a time, are merged
    in order and keep the best identifier, until one run is left: ceil(log(runs) / log(fan_in))
    rounds. A run is split over partitions by the digest, so the last rounds are as parallel as
    the first, and a digest that holds a third of all rows reaches a round as at most `fan_in`
    rows. The winners go back through the same (digest, run) pairs.

    keep: "max" or "min" identifier stays. Null text counts as empty. A null id loses to any other.
    Of repeated rows (same id, same text) one is kept, the others are not. An empty table gives an
    empty result. Other columns of docs are ignored.
    """
    best = F.max if keep == "max" else F.min
    text = F.coalesce(F.col(text_col), F.lit(""))
    digests = docs.select(
        F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("_sha"), F.length(text).alias("_len"),
        F.xxhash64(text, F.lit(7)).alias("_xx"))
    rows = stage(digests, "digests")
    runs = runs_for(rows.count(), rows_per_run)
    run_of = F.pmod(F.xxhash64("_row"), F.lit(runs))
    # Nulls lose: the flag comes first in the order.
    flag = F.col("_id").isNotNull() if keep == "max" else F.col("_id").isNull()
    level = (rows.select(*KEYS, run_of.alias("_run"), F.struct(flag.alias("f"), F.col("_id").alias("id"), F.col("_row").alias("row")).alias("_best"))
             .groupBy(*KEYS, "_run").agg(best("_best").alias("_best"), F.count(F.lit(1)).alias("_n")))
    while runs > 1:
        runs = -(-runs // fan_in)
        level = (level.withColumn("_run", F.floor(F.col("_run") / F.lit(fan_in)))
                 .groupBy(*KEYS, "_run").agg(best("_best").alias("_best"), F.sum("_n").alias("_n")))
    winners = level.select(*KEYS, F.col("_best.id").alias("keep_id"), F.col("_best.row").alias("_keep_row"), F.col("_n").alias("group_size"))
    out = attach(rows, winners, KEYS, F.xxhash64("_row"), runs_for(rows.count(), rows_per_run))
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", (F.col("_row") == F.col("_keep_row")).alias("kept"),
                      F.lower(F.hex("_sha")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """docs without the rows that `exact_dedup` drops: one row of each text stays; columns as in docs,
    whatever their names.

    The row that stays has the largest (or smallest) id; a null id loses to any other, and of rows
    that repeat id and text one stays. Null text counts as empty. An empty table gives an empty one."""
    rows = keyed(docs, id_col, text_col)
    flag = F.col("id").isNotNull() if keep == "max" else F.col("id").isNull()
    verdict = exact_dedup(rows.select(F.struct(flag.alias("f"), "id", "k1", "k2").alias("key"), "text"), "key", "text", keep)
    kept = verdict.filter("kept").select("key.k1", "key.k2")
    return keep_keyed(rows, kept)
