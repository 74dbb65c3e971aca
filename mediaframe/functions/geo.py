"""Distances on the earth and the nearest-place join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged

EARTH_KM, NEAR_KM, FAR_KM = 6371.0, 30.0, 150.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def gravity(population: Column, km: Column) -> Column:
    return population / F.pow(km + 1, 2)


def _meet(points: DataFrame, towns: DataFrame, km: float, degrees: float, hint: str) -> DataFrame:
    """points with each town within km. They meet in the grid cells of `degrees` of latitude, which must be
    more than km: a point is a row in each cell around it. The band of longitudes that km can span
    grows with 1 / cos(latitude) and wraps at 180 degrees; near the poles it is the whole ring."""
    cell = lambda x: F.floor(x / F.lit(degrees)).cast("int")
    ring = round(360 / degrees)
    widest = F.abs(F.col("lat")) + F.lit(degrees)
    band = F.when(widest >= 89, 180.0).otherwise(F.least(F.lit(180.0), F.lit(degrees) / F.cos(F.radians(widest))))
    rows = F.sequence(cell(F.col("lat")) - 1, cell(F.col("lat")) + 1)
    columns = F.array_distinct(F.transform(F.sequence(cell(F.col("lon") - band), cell(F.col("lon") + band)), lambda c: F.pmod(c, F.lit(ring))))
    around = points.select("point_id", "lat", "lon", F.explode(rows).alias("la"), columns.alias("los")).select("point_id", "lat", "lon", "la", F.explode("los").alias("lo"))
    there = towns.withColumn("la", cell(F.col("tlat"))).withColumn("lo", F.pmod(cell(F.col("tlon")), F.lit(ring)))
    return around.join(there.hint(hint), ["la", "lo"]).withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("tlat"), F.col("tlon"))).filter(F.col("km") <= km)


def nearest_place(points: DataFrame, towns: DataFrame, most_towns: int = 200_000) -> DataFrame:
    """point_id, place: the name of the most attractive town within 30 km, else region and country
    of the nearest one within 150 km, else null; empty and repeated parts are left out. Ids of points
    are distinct.

    Cells of 30 km come first; only points without a town there look into those of 150 km. Towns are
    written and counted when this is called: so many are broadcast, and points, half of which may be
    in one town, stay where they are; more meet by a merge join, whose crowded cells Spark splits."""
    known = staged(towns.select("town_id", "name", "region", "country", "population", F.col("lat").alias("tlat"), F.col("lon").alias("tlon")), "towns")
    hint = "broadcast" if known.count() <= most_towns else "merge"
    facts = F.struct("name", "region", "country")
    attractive = F.struct((-gravity(F.col("population"), F.col("km"))).alias("by"), "town_id")
    close = staged(_meet(points, known, NEAR_KM, 0.3, hint).groupBy("point_id").agg(F.min_by(facts, attractive).alias("b")), "close")
    rest = points.join(close.select("point_id").hint("merge"), "point_id", "left_anti")
    far = _meet(rest, known, FAR_KM, 1.5, hint).groupBy("point_id").agg(F.min_by(facts, F.struct("km", "town_id")).alias("b"))
    text = lambda *parts: F.array_join(F.array_distinct(F.filter(F.array(*[F.col(f"b.{p}") for p in parts]), lambda p: p != "")), ", ").alias("place")
    named = close.select("point_id", text("name", "region", "country")).unionByName(far.select("point_id", text("region", "country")))
    return points.select("point_id").join(named.hint("merge"), "point_id", "left")


def dms_to_degrees(d: Column, m: Column, s: Column, ref: Column, most: float) -> Column:
    """Degrees to six places, null if out of range."""
    v = (d + m / 60 + s / 3600) * F.when(F.upper(ref).isin("S", "W"), -1).otherwise(1)
    return F.when(F.abs(v) <= most, F.round(v, 6))


def parse_iso6709(tag: Column) -> Column:
    """struct(lat, lon) of +12.34-056.78/, null if it is none."""
    pattern = r"^([+-]\d{1,2}(?:\.\d+)?)([+-]\d{1,3}(?:\.\d+)?)"
    lat, lon = (F.regexp_extract(tag, pattern, k).try_cast("double") for k in (1, 2))
    ok = lat.isNotNull() & lon.isNotNull() & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon")))
