"""Metadata values of media files: dates, rates, sizes, windows, admission rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_exif_date(original: Column, digitised: Column) -> Column:
    """YYYY:MM:DD hh:mm:ss, the original first; null if neither is a date."""
    def one(c: Column) -> Column:
        return F.try_to_timestamp(F.substring(F.trim(c), 1, 19), F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")

    return F.coalesce(one(original), one(digitised))


def parse_container_date(local: Column, utc: Column, zone: str) -> Column:
    """A local creation date wins; one in UTC is moved to the zone; before 1971 it is no date."""
    a = F.try_to_timestamp(F.substring(local, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    u = F.from_utc_timestamp(F.try_to_timestamp(F.substring(utc, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")), zone)
    found = F.coalesce(a, u).cast("timestamp_ntz")
    return F.when(F.year(found) >= 1971, found)


def parse_rate(rate: Column) -> Column:
    """"30000/1001" to frames a second; 0 for a zero denominator or no rate."""
    p = F.split(rate, "/")
    return F.coalesce(F.try_divide(F.try_element_at(p, F.lit(1)).try_cast("double"), F.coalesce(F.try_element_at(p, F.lit(2)).try_cast("double"), F.lit(1.0))), F.lit(0.0))


def display_size(w: Column, h: Column, rotation: Column) -> Column:
    turned = F.pmod(rotation, F.lit(180)) == 90
    return F.struct(F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"))


def scaled_size(w: Column, h: Column, most: int) -> Column:
    """Fits the longer side, even numbers, at least 2, never larger than it was."""
    k = F.least(F.lit(1.0), most / F.greatest(w, h))

    def even(x: Column) -> Column:
        return F.greatest(F.lit(2), F.floor(x * k / 2) * 2).cast("int")

    return F.struct(even(w).alias("width"), even(h).alias("height"))


def fmt_ts(seconds: Column) -> Column:
    """75.25 as "01m15_3s"."""
    tenths = F.round(seconds * 10).cast("long")
    return F.format_string("%02dm%02d_%ds", F.expr("0L") + F.floor(tenths / 600), F.floor(tenths / 10) % 60, tenths % 10)


def thumb_path(content_hash: Column, start: Column) -> Column:
    """Where the picture of a window is kept, by content and start: two characters of the hash are the folder."""
    return F.concat(F.substring(content_hash, 1, 2), F.lit("/"), content_hash, F.format_string("-w%.3f.jpg", start))


def clip_name(rel_path: Column, start: Column, end: Column) -> Column:
    """The name of an exported moment of a video: its stem and both times."""
    stem = F.regexp_replace(F.regexp_replace(rel_path, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return F.concat(stem, F.lit("_"), fmt_ts(start), F.lit("-"), fmt_ts(end), F.lit(".mp4"))


def plan_windows(duration: Column, window: float, stride: float, min_tail: float = 1.0) -> Column:
    """Windows [start, end) over the media's own time. A short file is one window; windows slide by
    stride; a tail of min_tail or more gets a window that ends with the file, a shorter one makes
    the last window longer. Three decimals."""
    n = F.floor((duration - window) / stride + 1e-9).cast("int")
    slid = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.struct((i * F.lit(float(stride))).alias("start_s"), (i * F.lit(float(stride)) + window).alias("end_s")))
    reached = F.greatest(n, F.lit(0)) * F.lit(float(stride)) + window
    tail = duration - reached
    last = F.element_at(slid, -1)
    longer = F.concat(F.slice(slid, 1, F.size(slid) - 1), F.array(F.struct(last["start_s"].alias("start_s"), duration.alias("end_s"))))
    extra = F.concat(slid, F.array(F.struct((duration - window).alias("start_s"), duration.alias("end_s"))))
    whole = F.array(F.struct(F.lit(0.0).alias("start_s"), duration.alias("end_s")))
    plan = F.when(duration <= window, whole).when(tail >= min_tail, extra).when(tail > 1e-9, longer).otherwise(slid)
    return F.transform(plan, lambda w: F.struct(F.round(w["start_s"], 3).alias("start_s"), F.round(w["end_s"], 3).alias("end_s")))


def sample_times(start: Column, seconds: Column, fps: float) -> Column:
    """Centres of frame slots, before the end."""
    n = F.greatest(F.lit(1), F.ceil(seconds * fps)).cast("int")
    return F.filter(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.round((i + 0.5) / fps, 3)), lambda t: t < seconds)


def admit() -> Column:
    """First reason to reject a probed file, null if none. Columns: media_type, bytes, format, pixels, duration."""
    b, d = F.col("bytes"), F.col("duration")
    image = F.coalesce(F.when(b == 0, "empty"), F.when(b > 200 * 2**20, "too large"), F.when(~F.col("format").isin("jpeg", "png", "webp", "heic", "gif", "bmp", "tiff"), "format"), F.when(F.col("pixels") > 80_000_000, "too many pixels"))
    audio = F.coalesce(F.when(b > 2**30, "too large"), F.when(d <= 0, "no sound"), F.when(d > 4 * 3600, "too long"))
    video = F.coalesce(F.when(~F.col("format").isin("mp4", "mov", "mkv", "webm"), "format"), F.when(b > 8 * 2**30, "too large"), F.when(d > 6 * 3600, "too long"))
    return F.when(F.col("media_type") == "image", image).when(F.col("media_type") == "audio", audio).otherwise(video)


def profile_key(profile: Column) -> Column:
    """Names a vector space: hash of the fields that define it, in order of their names."""
    return F.substring(F.sha2(F.to_json(profile), 256), 1, 16)
