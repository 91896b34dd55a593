"""Random augmentations: each a pure function of the stream, the seed and the slice, however it is partitioned."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..stream import EventStream
from . import transforms


def uniform(seed: int, salt: str, *columns) -> Column:
    """A number in [0, 1) by hash of the seed and the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(int(seed)).cast("long"), F.lit(salt), *columns), 11) / F.lit(float(1 << 53))


def _once(s: EventStream, p: float, seed: int, salt: str) -> Column:
    """Whether a slice is changed: never at p <= 0, always at p >= 1."""
    return uniform(seed, salt, *s.keys) < F.lit(float(p))


def random_flip_x(s: EventStream, p: float = 0.5, seed: int = 0) -> EventStream:
    return s.mapped(x=F.when(_once(s, p, seed, "flip_x"), s.meta.width - 1 - F.col("x")).otherwise(F.col("x")))


def random_flip_y(s: EventStream, p: float = 0.5, seed: int = 0) -> EventStream:
    return s.mapped(y=F.when(_once(s, p, seed, "flip_y"), s.meta.height - 1 - F.col("y")).otherwise(F.col("y")))


def random_polarity_flip(s: EventStream, p: float = 0.5, seed: int = 0) -> EventStream:
    return s.mapped(p=F.col("p") != _once(s, p, seed, "polarity"))


def random_crop(s: EventStream, width: int, height: int, seed: int = 0) -> EventStream:
    """A window at a random place; the whole sensor if it isn't larger."""
    w, h = s.sensor_size
    if width >= w and height >= h:
        return s
    width, height = min(width, w), min(height, h)
    place = lambda salt, room: F.floor(uniform(seed, salt, *s.keys) * (room + 1)).cast("int")
    return s.mapped(width, height, x=F.col("x") - place("crop_x", w - width), y=F.col("y") - place("crop_y", h - height))


def event_drop(s: EventStream, p: float = 0.1, seed: int = 0) -> EventStream:
    return s.with_(s.df.where(uniform(seed, "event", *s.keys, "seq") >= F.lit(float(p))))


def pixel_dropout(s: EventStream, p: float = 0.1, seed: int = 0) -> EventStream:
    return s.with_(s.df.where(uniform(seed, "pixel", *s.keys, "x", "y") >= F.lit(float(p))))


def _gauss(seed: int, salt: str, *columns) -> tuple[Column, Column]:
    u = F.lit(1.0) - uniform(seed, salt + "_u", *columns)
    v = uniform(seed, salt + "_v", *columns)
    r = F.sqrt(F.lit(-2.0) * F.ln(u))
    return r * F.cos(v * (2 * math.pi)), r * F.sin(v * (2 * math.pi))


def spatial_jitter(s: EventStream, sigma: float = 1.0, seed: int = 0) -> EventStream:
    gx, gy = _gauss(seed, "space", *s.keys, "seq")
    return s.mapped(*s.sensor_size, x=F.col("x") + F.round(gx * sigma).cast("int"), y=F.col("y") + F.round(gy * sigma).cast("int"))


def time_jitter(s: EventStream, sigma_ms: float = 1.0, seed: int = 0) -> EventStream:
    g, _ = _gauss(seed, "time", *s.keys, "seq")
    return transforms.sort_by_time(s.mapped(t=F.col("t") + F.round(g * s.meta.ticks(sigma_ms)).cast("long")))


def time_reversal(s: EventStream, p: float = 0.5, seed: int = 0) -> EventStream:
    """Time runs backwards and brightness changes turn around."""
    bounds = s.df.groupBy(*s.keys).agg((F.min("t") + F.max("t")).alias("_ends"))
    df = s.df.join(F.broadcast(bounds), list(s.keys)) if s.keys else s.df.join(F.broadcast(bounds), F.lit(True))
    turn = _once(s, p, seed, "reverse")
    changed = df.withColumns({"t": F.when(turn, F.col("_ends") - F.col("t")).otherwise(F.col("t")), "p": F.col("p") != turn, "seq": F.when(turn, -F.col("seq")).otherwise(F.col("seq"))})
    return transforms.sort_by_time(s.with_(changed.select(*s.columns)))
