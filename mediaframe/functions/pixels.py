"""Pixel measures of decoded images (Spark's image source: BGR bytes)."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of named colours in hue, saturation and value from 0 to 255. Hues: from the first to below the
#: second number, purple to its second number itself, red below 10 or above 240.
HUES = {"red": (240, 10), "orange": (10, 26), "yellow": (26, 46), "green": (46, 120), "blue": (130, 190), "purple": (190, 240)}
#: Saturation and value have to be above these.
ABOVE = {"red": (110, 60), "orange": (120, 90), "yellow": (110, 100), "green": (70, 50), "blue": (80, 50), "purple": (70, 50)}
#: Colours without a hue: saturation below 40; white has a value above 190, grey one from 70 to 190; black has a value below 50.
PALE, WHITE, GREY, BLACK = 40, 190, 70, 50
SAME_COLOUR = {"gray": "grey", "silver": "grey"}
SURE, MAYBE = 0.10, 0.04


def to_array(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)[:, :, :3].astype(np.float64)


def encode_bmp(data: bytes, width: int, height: int) -> bytes:
    """An uncompressed bitmap file of BGR pixels: lines from the bottom up, each filled to four bytes."""
    lines = np.zeros((height, -(-3 * width // 4) * 4), np.uint8)
    lines[:, : 3 * width] = np.frombuffer(data, np.uint8).reshape(height, 3 * width)[::-1]
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + lines.size, 0, 0, 54, 40, width, height, 1, 24, 0, lines.size, 2835, 2835, 0, 0) + lines.tobytes()


@F.arrow_udf(T.BinaryType())
def bmp(data: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    """Pixels as a bitmap file; null where a value is null or the bytes are not width x height x 3."""
    rows = zip(data.to_pylist(), width.to_pylist(), height.to_pylist(), strict=True)
    return pa.array([encode_bmp(d, w, h) if None not in (d, w, h) and w > 0 and h > 0 and len(d) == 3 * w * h else None for d, w, h in rows], pa.binary())


def laplacian_variance(img: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian of the grey image; below 3 pixels a side 0."""
    grey = img @ np.array([0.114, 0.587, 0.299]) if img.shape[2] == 3 else img[:, :, 0]
    if min(grey.shape) < 3:
        return 0.0
    inner = grey[:-2, 1:-1] + grey[2:, 1:-1] + grey[1:-1, :-2] + grey[1:-1, 2:] - 4 * grey[1:-1, 1:-1]
    return float(inner.var())


def hsv(img: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b, g, r = img[:, :, 0], img[:, :, 1], img[:, :, 2]
    top, low = img.max(2), img.min(2)
    d = np.where(top == low, 1, top - low)
    hue = np.where(top == r, (g - b) / d % 6, np.where(top == g, (b - r) / d + 2, (r - g) / d + 4)) / 6 * 255
    return np.where(top == low, 0, hue), np.where(top > 0, (top - low) / np.maximum(top, 1) * 255, 0), top


def of_colour(h: np.ndarray, s: np.ndarray, v: np.ndarray, colour: str) -> np.ndarray:
    """Where hue, saturation and value are of a named colour."""
    if colour == "black":
        return v < BLACK
    if colour in ("white", "grey"):
        return (s < PALE) & ((v > WHITE) if colour == "white" else (v >= GREY) & (v <= WHITE))
    a, b = HUES[colour]
    if a > b:
        hue = (h > a) | (h < b)
    else:
        hue = (h >= a) & ((h <= b) if colour == "purple" else (h < b))
    return hue & (s > ABOVE[colour][0]) & (v > ABOVE[colour][1])


def share_of_colour(img: np.ndarray, colour: str) -> float:
    hit = of_colour(*hsv(img), SAME_COLOUR.get(colour, colour))
    return float(hit.mean()) if hit.size else 0.0


def band(share: Column) -> Column:
    """What the share of a colour in the best box of a photo says: sure, maybe or null."""
    return F.when(share >= SURE, "sure").when(share >= MAYBE, "maybe")


@F.pandas_udf(T.DoubleType())
def sharpness(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series) -> pd.Series:
    return pd.Series([laplacian_variance(to_array(*x)) for x in zip(data, width, height, channels, strict=True)])


def colour_share(colour: str):
    """Share of a box's pixels (x0, y0, x1, y1 in fractions) that have the colour."""
    @F.pandas_udf(T.DoubleType())
    def share(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series, box: pd.Series) -> pd.Series:
        out = []
        for d, w, h, c, (x0, y0, x1, y1) in zip(data, width, height, channels, box, strict=True):
            img = to_array(d, w, h, c)
            part = img[int(y0 * h): max(int(y0 * h) + 1, round(y1 * h)), int(x0 * w): max(int(x0 * w) + 1, round(x1 * w))]
            out.append(share_of_colour(part, colour) if part.shape[2] == 3 else 0.0)
        return pd.Series(out)

    return share


def best_box_share(colour: str):
    """The largest share of the colour in any of a photo's boxes; null without boxes."""
    @F.pandas_udf(T.DoubleType())
    def share(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series, boxes: pd.Series) -> pd.Series:
        out = []
        for d, w, h, c, found in zip(data, width, height, channels, boxes, strict=True):
            img = to_array(d, w, h, c)
            parts = [img[int(y0 * h): max(int(y0 * h) + 1, round(y1 * h)), int(x0 * w): max(int(x0 * w) + 1, round(x1 * w))] for x0, y0, x1, y1 in (found if found is not None else [])]
            out.append(max((share_of_colour(p, colour) if p.shape[2] == 3 else 0.0 for p in parts), default=None))
        return pd.Series(out, dtype=float)

    return share
