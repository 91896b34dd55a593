"""Pixel masks: sets of pixels to keep, as tables of (x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stream import EventStream


def _grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    n = max(0, int(width) * int(height))
    return spark.range(n).select((F.col("id") % max(1, width)).cast("int").alias("x"), F.floor(F.col("id") / max(1, width)).cast("int").alias("y"))


def _centre():
    return F.col("x") + F.lit(0.5), F.col("y") + F.lit(0.5)


def rect_mask(spark: SparkSession, width: int, height: int, x0: float, y0: float, w: float, h: float) -> DataFrame:
    """Pixels whose centre lies in the rectangle."""
    cx, cy = _centre()
    return _grid(spark, width, height).where((cx >= x0) & (cx < x0 + w) & (cy >= y0) & (cy < y0 + h))


def ellipse_mask(spark: SparkSession, width: int, height: int, cx: float, cy: float, rx: float, ry: float) -> DataFrame:
    if rx <= 0 or ry <= 0:
        return _grid(spark, width, height).where(F.lit(False))
    px, py = _centre()
    u, v = (px - F.lit(cx)) / F.lit(float(rx)), (py - F.lit(cy)) / F.lit(float(ry))
    return _grid(spark, width, height).where(u * u + v * v <= 1)


def circle_mask(spark: SparkSession, width: int, height: int, cx: float, cy: float, r: float) -> DataFrame:
    return ellipse_mask(spark, width, height, cx, cy, r, r)


def polygon_mask(spark: SparkSession, width: int, height: int, points) -> DataFrame:
    """Pixels whose centre an odd number of edges lies to the right of; fewer than three points hold none."""
    pts = [(float(a), float(b)) for a, b in points]
    if len(pts) < 3:
        return _grid(spark, width, height).where(F.lit(False))
    px, py = _centre()
    crossings = F.lit(0)
    for (xa, ya), (xb, yb) in zip(pts, pts[1:] + pts[:1]):
        if ya == yb:
            continue
        spans = (F.lit(ya) <= py) != (F.lit(yb) <= py)
        at = F.lit(xa) + (py - F.lit(ya)) * F.lit((xb - xa) / (yb - ya))
        crossings = crossings + (spans & (px < at)).cast("int")
    return _grid(spark, width, height).where(crossings % 2 == 1)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def invert(mask: DataFrame, width: int, height: int) -> DataFrame:
    return _grid(mask.sparkSession, width, height).exceptAll(mask.distinct())


def from_array(spark: SparkSession, array) -> DataFrame:
    """A mask from a boolean array [height, width]."""
    import numpy as np

    ys, xs = np.nonzero(np.asarray(array))
    return spark.createDataFrame([(int(x), int(y)) for x, y in zip(xs, ys)], "x int, y int")


def to_array(mask: DataFrame, width: int, height: int):
    import numpy as np

    out = np.zeros((height, width), bool)
    for r in mask.collect():  # a sensor's pixels at most
        out[r["y"], r["x"]] = True
    return out


def mask(s: EventStream, keep: DataFrame) -> EventStream:
    """Events on the mask's pixels.  The mask has a row for each pixel at most."""
    return s.with_(s.df.join(F.broadcast(keep.select("x", "y").distinct()), ["x", "y"], "left_semi").select(*s.columns))


def drop_masked_pixels(s: EventStream, drop: DataFrame) -> EventStream:
    return s.with_(s.df.join(F.broadcast(drop.select("x", "y").distinct()), ["x", "y"], "left_anti").select(*s.columns))
