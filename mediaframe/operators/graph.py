"""Components of a graph, by joins whose rows never exceed a few times the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """node, comp (the smallest id that links reach) for each node of links (a, b). Steps alternate: each node
    hangs its larger neighbours on the smallest one, then its smaller ones; rounds grow with the logarithm
    of the longest path. Runs when called; more than `most` rounds are an error."""
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(most):
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            tops = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(tops)
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.filter("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = staged(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least.hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = staged(hung.filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    raise RuntimeError(f"components have not settled in {most} rounds")
