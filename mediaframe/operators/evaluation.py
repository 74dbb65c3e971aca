"""Retrieval metrics with incomplete judgements: an unjudged candidate is unknown, never irrelevant.

Rankings are rows (query, candidate, rank, grade); grade is null where nobody has judged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import running_total


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def hit_at_k(ranked: DataFrame, k: int) -> DataFrame:
    """1 if something relevant is in the top k; 0 only if all of it is judged (or it is empty)."""
    top = F.col("rank") <= k
    relevant = F.max(F.when(top & (F.col("grade") > 0), 1).otherwise(0))
    judged = F.coalesce(F.bool_and(F.when(top, F.col("grade").isNotNull())), F.lit(True))
    return ranked.groupBy("query").agg(F.when(relevant == 1, 1.0).when(judged, 0.0).alias("value"))


def recall_at_k(ranked: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """Share of the pool's relevant candidates in the top k; null unless the whole pool is judged and
    has one. pool: query, candidate, grade."""
    found = ranked.filter((F.col("rank") <= k) & (F.col("grade") > 0)).groupBy("query").agg(F.count_distinct("candidate").alias("found"))
    p = pool.groupBy("query").agg(F.bool_and(F.col("grade").isNotNull()).alias("judged"), F.count_if(F.col("grade") > 0).alias("relevant"))
    return p.join(found, "query", "left").select("query", F.when(F.col("judged") & (F.col("relevant") > 0), F.coalesce("found", F.lit(0)) / F.col("relevant")).alias("value"))


def ndcg_at_k(ranked: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """Ideal from the pool; null if something of the top k or the pool is unjudged, or nothing is relevant."""
    from pyspark.sql import Window

    own = ranked.filter(F.col("rank") <= k).groupBy("query").agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"), F.bool_and(F.col("grade").isNotNull()).alias("judged"))
    # Only how many there are of a grade matters for the ideal: grades are few, however large the pool.
    grades = pool.groupBy("query", "grade").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("query").orderBy(F.desc_nulls_last("grade")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = grades.withColumn("last", F.least(F.sum("n").over(w), F.lit(k))).withColumn("first", F.sum("n").over(w) - F.col("n") + 1)
    shares = F.when(F.col("grade").isNotNull() & (F.col("first") <= F.col("last")), F.aggregate(F.sequence("first", "last"), F.lit(0.0), lambda s, i: s + gain(F.col("grade"), i)))
    best = upto.groupBy("query").agg(F.sum(shares).alias("idcg"), F.bool_and(F.col("grade").isNotNull()).alias("all"))
    return own.join(best, "query").select("query", F.when(F.col("judged") & F.col("all") & (F.col("idcg") > 0), F.col("dcg") / F.col("idcg")).alias("value"))


def aggregate(values: DataFrame) -> DataFrame:
    """Mean of what is known to four places, how many, and how many are left out."""
    return values.agg(F.round(F.avg("value"), 4).alias("mean"), F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("excluded"))


def latency_percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Upper median and nearest-rank 95th percentile, neither interpolated. Values are counted before
    they are ranked, and ranked by ranges, so that a group is not gathered."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(by).agg(F.sum("n").alias("all"))
    upto = running_total(counts, [by], [value], "n").alias("a").join(sizes.hint("merge").alias("b"), F.col(f"a.{by}").eqNullSafe(F.col(f"b.{by}"))).select("a.*", "b.all")
    mid, p95 = F.floor(F.col("all") / 2), F.bround(0.95 * (F.col("all") - 1))
    return upto.groupBy(by).agg(F.min(F.when(F.col("upto") > mid, F.col(value))).alias("median"), F.min(F.when(F.col("upto") > p95, F.col(value))).alias("p95"))


def report_by_mode(ranked: DataFrame, pool: DataFrame, own: DataFrame, modes: DataFrame) -> DataFrame:
    """mode, metric, mean, n, excluded of Hit@1 and Hit@5 of rankings, Recall@5 and nDCG@10 against the pool (own:
    rankings of pool candidates only), for each mode of search. modes: query, mode; a query without a
    value for a metric counts as excluded."""
    parts = {"hit@1": hit_at_k(ranked, 1), "hit@5": hit_at_k(ranked, 5), "recall@5": recall_at_k(pool, pool, 5), "ndcg@10": ndcg_at_k(own, pool, 10)}
    rows = None
    for name, values in parts.items():
        one = modes.join(values.hint("merge"), "query", "left").select("mode", F.lit(name).alias("metric"), "value")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("mode", "metric").agg(F.round(F.avg("value"), 4).alias("mean"), F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("excluded"))


def peak_envelope(samples: DataFrame, buckets: int) -> DataFrame:
    """source, bucket, peak: largest |x| of near-equal runs (the first ones a sample longer), over the
    source's peak. samples: source, i (0-based), x."""
    sizes = samples.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    s = samples.join(sizes.hint("merge"), "source").withColumn("q", F.expr(f"n div {buckets}")).withColumn("r", F.expr(f"n % {buckets}"))
    bucket = F.when(F.col("i") < F.col("r") * (F.col("q") + 1), F.expr("i div (q + 1)")).otherwise(F.col("r") + F.expr("(i - r * (q + 1)) div greatest(q, 1)"))
    peaks = s.groupBy("source", bucket.alias("bucket")).agg(F.max(F.abs("x")).alias("peak"))
    top = peaks.groupBy("source").agg(F.max("peak").alias("top"))  # of a few buckets a source
    return peaks.join(top.hint("merge"), "source").select("source", "bucket", (F.col("peak") / F.col("top")).alias("peak"))


#: Cumulative shares of a Poisson variable of mean one: 0, 1, 2, ... times.
POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])


def bootstrap_ci(values: DataFrame, replicates: int = 1000, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """low, high: quantiles of the mean of values (id, value) over replicates of rows drawn again with
    replacement. Each replicate gives a row a Poisson weight of mean one that a hash of id and
    replicate decides, so that a partition returns two sums for each replicate, whatever its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, bottom = np.zeros(replicates), np.zeros(replicates)
        salt = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            h, x = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            for at in range(0, len(h), 256):
                u = h[at: at + 256, None] ^ salt
                u = (u ^ (u >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
                u = ((u ^ (u >> np.uint64(33))) >> np.uint64(11)) / float(1 << 53)
                w = np.searchsorted(POISSON, u)
                top += x[at: at + 256] @ w
                bottom += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(top), pa.array(bottom)], names=["replicate", "top", "bottom"])

    sums = values.filter("value is not null").select(F.xxhash64("id"), F.col("value").cast("double")).mapInArrow(run, "replicate long, top double, bottom double")
    means = sums.groupBy("replicate").agg((F.sum("top") / F.sum("bottom")).alias("m"))
    return means.agg(F.percentile("m", F.lit(low)).alias("low"), F.percentile("m", F.lit(high)).alias("high"))


@F.pandas_udf(T.DoubleType())
def trimmed_mean(x: pd.Series) -> float:
    """A grouped aggregate: the mean without the lowest and highest tenth. A group is one task's rows; for groups
    of bounded size."""
    x = x.dropna().sort_values()
    cut = len(x) // 10
    return float(x.iloc[cut: len(x) - cut].mean()) if len(x) else float("nan")
