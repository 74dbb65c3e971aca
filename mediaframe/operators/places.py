"""Place names of any depth: "town, region, country"."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.StringType())
def _unaccented(texts: pa.Array) -> pa.Array:
    return pa.compute.replace_substring_regex(pa.compute.utf8_normalize(texts, form="NFKD"), r"\p{Mn}", "")


def fold(text: Column) -> Column:
    """Lower case, trimmed, without accents."""
    return _unaccented(F.lower(F.trim(text)))


def parts(place: Column) -> Column:
    return F.filter(F.transform(F.split(place, ","), lambda p: F.trim(p)), lambda p: p != "")


def suffixes(place: Column) -> Column:
    """Every trailing sub-path, the whole first."""
    p = parts(place)
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ", "))


def within(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose place is name or lies in it; both tests reach the Parquet scan."""
    return rows.filter((F.col("place") == name) | F.col("place").endswith(f", {name}"))


def levels(rows: DataFrame) -> DataFrame:
    """level, depth, n: counts for every suffix, a roll-up over names of any depth."""
    exploded = rows.filter("place is not null").select(F.explode(suffixes(F.col("place"))).alias("level"))
    return exploded.groupBy("level").agg(F.count(F.lit(1)).alias("n")).select("level", F.size(parts(F.col("level"))).alias("depth"), "n")


def points(rows: DataFrame) -> DataFrame:
    known = rows.filter("place is not null and gps_lat is not null")
    return known.groupBy("place").agg(F.round(F.avg("gps_lat"), 4).alias("lat"), F.round(F.avg("gps_lon"), 4).alias("lon"), F.count(F.lit(1)).alias("n"))
