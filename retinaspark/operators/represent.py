"""Representations: streams to frames in long form (keys, c, y, x, value).

Cells that aren't there are zero.  ``frames.dense`` fills them in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stream import EventStream


@dataclass(frozen=True)
class Frame:
    """Cells of frames, and what they are: one frame for each combination of ``keys``."""

    df: DataFrame
    kind: str
    channels: tuple[str, ...]
    width: int
    height: int
    dtype: str
    keys: tuple[str, ...] = ()

    @property
    def shape(self) -> tuple[int, int, int]:
        return len(self.channels), self.height, self.width


def _frame(s: EventStream, df: DataFrame, kind: str, channels, dtype: str, width=None, height=None) -> Frame:
    kinds = {"u8": "int", "u16": "int", "u64": "long", "f32": "float"}
    out = df.select(*s.keys, F.col("c").cast("int").alias("c"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("value").cast(kinds[dtype]).alias("value"))
    return Frame(out, kind, tuple(channels), width or s.meta.width, height or s.meta.height, dtype, s.keys)


def _with_bounds(s: EventStream) -> DataFrame:
    """The events with their slice's last time in ``t_max``; one small row for each slice."""
    bounds = s.df.groupBy(*s.keys).agg(F.max("t").alias("t_max"))
    return s.df.join(F.broadcast(bounds), list(s.keys)) if s.keys else s.df.join(F.broadcast(bounds), F.lit(True))


def _with_last(s: EventStream, latest: DataFrame, t: str = "t") -> DataFrame:
    """Rows of pixels' latest events, with their slice's last time in ``t_max``: the latest of the latest.

    Both sides come from one aggregation, whose shuffle is made once, so events are read once.
    """
    bounds = latest.groupBy(*s.keys).agg(F.max(t).alias("t_max"))
    return latest.join(F.broadcast(bounds), list(s.keys)) if s.keys else latest.join(F.broadcast(bounds), F.lit(True))


def _age(s: EventStream) -> Column:
    return F.greatest(F.col("t_max") - F.col("t"), F.lit(0)) * F.lit(s.meta.scale_ms)


def _scaled(counts: DataFrame, s: EventStream) -> DataFrame:
    """Counts to 0..255 of the frame's largest, halves rounded up."""
    top = counts.groupBy(*s.keys).agg(F.max("value").alias("m"))
    joined = counts.join(F.broadcast(top), list(s.keys)) if s.keys else counts.join(F.broadcast(top), F.lit(True))
    return joined.withColumn("value", F.expr("(value * 255 + m div 2) div m"))


def binary(s: EventStream) -> Frame:
    """1 where an event was."""
    df = s.df.groupBy(*s.keys, "y", "x").agg(F.lit(1).alias("value")).withColumn("c", F.lit(0))
    return _frame(s, df, "binary", ["event"], "u8")


def count(s: EventStream, normalize: bool = False) -> Frame:
    """Events of each pixel."""
    df = s.df.groupBy(*s.keys, "y", "x").agg(F.count("*").alias("value")).withColumn("c", F.lit(0))
    return _frame(s, _scaled(df, s) if normalize else df, "count", ["count"], "u8" if normalize else "u64")


def polarity(s: EventStream, normalize: bool = True, downsample: int = 1) -> Frame:
    """Events of each cell of ``downsample`` pixels by polarity."""
    k = max(1, int(downsample))
    df = s.df.groupBy(*s.keys, F.expr(f"y div {k}").alias("y"), F.expr(f"x div {k}").alias("x"), F.when(F.col("p"), 0).otherwise(1).alias("c")).agg(F.count("*").alias("value"))
    return _frame(s, _scaled(df, s) if normalize else df, "polarity", ["positive", "negative"], "u8" if normalize else "u64", -(-s.meta.width // k), -(-s.meta.height // k))


def voxel(s: EventStream, bins: int = 9, window_ms: float | None = None) -> Frame:
    """Signed votes over time bins, split between the two nearest."""
    window = s.meta.span(window_ms)
    df = _with_bounds(s).withColumn("age", _age(s)).where(F.col("age") <= window)
    sign = F.when(F.col("p"), 1.0).otherwise(-1.0)
    if bins == 1:
        votes = df.select(*s.keys, "y", "x", F.lit(0).alias("c"), sign.alias("w"))
    else:
        pos = (1 - F.col("age") / F.lit(window)) * (bins - 1)
        lo = F.least(F.floor(pos), F.lit(bins - 1)).cast("int")
        part = pos - F.floor(pos)
        both = F.array(F.struct(lo.alias("c"), (sign * (1 - part)).alias("w")), F.struct((lo + 1).alias("c"), (sign * part).alias("w")))
        votes = df.select(*s.keys, "y", "x", F.explode(both).alias("v")).select(*s.keys, "y", "x", "v.c", "v.w").where((F.col("c") < bins) & (F.col("w") != 0))
    return _frame(s, votes.groupBy(*s.keys, "c", "y", "x").agg(F.sum("w").alias("value")), "voxel", [f"bin_{i}" for i in range(bins)], "f32")


def _planes() -> Column:
    return F.when(F.col("p"), 0).otherwise(1).alias("c")


def tsurf(s: EventStream, tau_ms: float | None = None) -> Frame:
    """exp(-age / tau) of each pixel's latest event by polarity."""
    tau = s.meta.span(tau_ms)
    latest = _with_last(s, s.df.groupBy(*s.keys, _planes(), "y", "x").agg(F.max("t").alias("t")))
    return _frame(s, latest.withColumn("value", F.exp(-_age(s) / F.lit(tau))), "tsurf", ["positive", "negative"], "f32")


def atsurf(s: EventStream, tau_ms: float | None = None) -> Frame:
    """The mean of exp(-age / tau) over each pixel's events by polarity."""
    tau = s.meta.span(tau_ms)
    df = _with_bounds(s).groupBy(*s.keys, _planes(), "y", "x").agg(F.avg(F.exp(-_age(s) / F.lit(tau))).alias("value"))
    return _frame(s, df, "atsurf", ["positive", "negative"], "f32")


def tencode(s: EventStream, window_ms: float | None = None) -> Frame:
    """Each pixel's latest event: its polarity's plane at 255, its age in the middle one."""
    window = s.meta.span(window_ms)
    # a pixel has an event in the window if its latest one is
    latest = _with_last(s, _latest(s)).withColumn("age", _age(s)).where(F.col("age") <= window)
    old = F.least(F.greatest(F.round(F.col("age") / F.lit(window) * 255), F.lit(0)), F.lit(255))
    planes = F.array(F.struct(F.when(F.col("p"), 0).otherwise(2).alias("c"), F.lit(255).cast("int").alias("value")), F.struct(F.lit(1).alias("c"), old.cast("int").alias("value")))
    cells = latest.select(*s.keys, "y", "x", F.explode(planes).alias("v")).select(*s.keys, "y", "x", "v.c", "v.value").where("value > 0")
    return _frame(s, cells, "tencode", ["positive", "age", "negative"], "u8")


def _latest(s: EventStream) -> DataFrame:
    """Each pixel's latest event: t, p."""
    return s.df.groupBy(*s.keys, "y", "x").agg(F.max(F.struct("t", "seq", "p")).alias("e")).select(*s.keys, "y", "x", F.col("e.t").alias("t"), F.col("e.p").alias("p"))


def _signed_counts(s: EventStream) -> DataFrame:
    return s.df.groupBy(*s.keys, "y", "x").agg(F.count_if("p").alias("pos"), F.count_if(~F.col("p")).alias("neg"))


def _unit(c: Column, alpha: Column) -> Column:
    # single precision, as the 8-bit result is cut off, not rounded
    c, alpha = c.cast("float"), alpha.cast("float")
    return F.when(alpha > 0, (F.least(c, alpha) / alpha).cast("float")).otherwise(F.lit(0).cast("float"))


def countmask(s: EventStream, pct: float = 99.0, white_frame: bool = False) -> Frame:
    """Counts by polarity, cut off at a percentile of all that aren't zero, and a plane of activity."""
    counts = _signed_counts(s)
    pooled = counts.select(*s.keys, F.explode(F.array("pos", "neg")).alias("n")).where("n > 0")
    alpha = pooled.groupBy(*s.keys).agg(F.percentile("n", F.lit(pct / 100.0)).alias("alpha"))
    joined = counts.join(F.broadcast(alpha), list(s.keys)) if s.keys else counts.join(F.broadcast(alpha), F.lit(True))
    byte = lambda c: (_unit(F.col(c), F.col("alpha")) * F.lit(255).cast("float")).cast("int")
    planes = F.array(*[F.struct(F.lit(i).alias("c"), v.alias("value")) for i, v in enumerate((byte("pos"), F.lit(255), byte("neg")))])
    cells = joined.select(*s.keys, "y", "x", F.explode(planes).alias("v")).select(*s.keys, "y", "x", "v.c", "v.value")
    frame = _frame(s, cells if white_frame else cells.where("value > 0"), "countmask", ["positive", "activity", "negative"], "u8")
    return _inverted(frame) if white_frame else frame


def _inverted(f: Frame) -> Frame:
    from .frames import filled

    full = filled(f)
    return Frame(full.df.withColumn("value", F.lit(255) - F.col("value")), f.kind, f.channels, f.width, f.height, f.dtype, f.keys)


def redblue(s: EventStream, pct: float = 99.0, white_frame: bool = True) -> Frame:
    """Red for OFF-free, blue for ON-free pixels on white; every cell is there, as the background isn't zero."""
    counts = _signed_counts(s)
    tops = counts.groupBy(*s.keys).agg(*[F.percentile(F.when(F.col(c) > 0, F.col(c)), F.lit(pct / 100.0)).alias(f"a_{c}") for c in ("pos", "neg")])
    joined = counts.join(F.broadcast(tops), list(s.keys)) if s.keys else counts.join(F.broadcast(tops), F.lit(True))
    cap = F.lit(1 << 24)
    pos, neg = (_unit(F.least(F.col(c), cap), F.coalesce(f"a_{c}", F.lit(0))) for c in ("pos", "neg"))
    fade = lambda v: ((F.lit(1).cast("float") - v) * F.lit(255).cast("float")).cast("int")
    wins = pos >= neg
    colours = [F.when(wins, 255).otherwise(fade(neg)), F.when(wins, fade(pos)).otherwise(fade(neg)), F.when(wins, fade(pos)).otherwise(255)]
    planes = F.array(*[F.struct(F.lit(i).alias("c"), v.cast("int").alias("value")) for i, v in enumerate(colours)])
    cells = joined.select(*s.keys, "y", "x", F.explode(planes).alias("v")).select(*s.keys, "y", "x", "v.c", "v.value")
    from .frames import filled

    return filled(_frame(s, cells, "redblue", ["red", "green", "blue"], "u8"), 255)


def mcts_windows(max_window_ms: float) -> list[float]:
    return [max_window_ms ** (i / 4) for i in range(5)]


def mcts(s: EventStream, max_window_ms: float | None = None, windows_ms=None) -> Frame:
    """Linear time surfaces for several windows; negative planes come first."""
    windows = [float(v) for v in (windows_ms or mcts_windows(s.meta.span(max_window_ms)))]
    n = len(windows)
    latest = _with_last(s, s.df.groupBy(*s.keys, "p", "y", "x").agg(F.max("t").alias("t"))).withColumn("age", _age(s))
    planes = F.array(*[F.struct(F.when(F.col("p"), n + i).otherwise(i).alias("c"), F.when(F.col("age") <= v, 1 - F.col("age") / F.lit(v)).otherwise(0.0).alias("value")) for i, v in enumerate(windows)])
    cells = latest.select(*s.keys, "y", "x", F.explode(planes).alias("v")).select(*s.keys, "y", "x", "v.c", "v.value").where("value > 0")
    return _frame(s, cells, "mcts", [f"{sign}_{v:g}ms" for sign in ("negative", "positive") for v in windows], "f32")


def pset(s: EventStream) -> DataFrame:
    """Points (x, y, t, p) from 0 to 1, and p as -1 or 1, in stream order."""
    bounds = s.df.groupBy(*s.keys).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    df = s.df.join(F.broadcast(bounds), list(s.keys)) if s.keys else s.df.join(F.broadcast(bounds), F.lit(True))
    w, h = s.sensor_size
    unit = lambda c, n: (F.col(c) / F.lit(float(n - 1))).cast("float") if n > 1 else F.lit(0.0).cast("float")
    t = F.when(F.col("t1") > F.col("t0"), (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))).otherwise(0.0)
    return df.select(*s.keys, "seq", unit("x", w).alias("x"), unit("y", h).alias("y"), t.cast("float").alias("t"), F.when(F.col("p"), 1.0).otherwise(-1.0).cast("float").alias("p"))


def raw_image(s: EventStream, decay_ms: float | None = None) -> Frame:
    """Each pixel's latest polarity, fading with age: from -1 to 1, nothing beyond 6.5 decays."""
    decay = s.meta.span(decay_ms)
    latest = _with_last(s, _latest(s)).withColumn("age", _age(s)).where(F.col("age") <= 6.5 * decay)
    return _frame(s, latest.withColumn("value", F.when(F.col("p"), 1.0).otherwise(-1.0) * F.exp(-F.col("age") / F.lit(decay))).withColumn("c", F.lit(0)), "intensity", ["intensity"], "f32")


def event_rate(s: EventStream, bin_ms: float = 1.0) -> DataFrame:
    """Events in bins from the first one on, empty bins included; rates are by the whole bin."""
    width = max(1, int(s.meta.ticks(bin_ms) + 0.5))
    bounds = s.df.groupBy(*s.keys).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    df = s.df.join(F.broadcast(bounds), list(s.keys)) if s.keys else s.df.join(F.broadcast(bounds), F.lit(True))
    counts = df.groupBy(*s.keys, F.expr(f"(t - t0) div {width}").alias("bin")).agg(F.count("*").alias("count"), F.count_if("p").alias("positive"))
    bins = bounds.select(*s.keys, "t0", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(t1 - t0) div {width}"))).alias("bin"))
    n = F.coalesce("count", F.lit(0))
    pos = F.coalesce("positive", F.lit(0))
    return bins.join(counts, [*s.keys, "bin"], "left").select(*s.keys, (F.col("t0") + F.col("bin") * width).alias("t"), n.alias("count"), pos.alias("positive"), (n - pos).alias("negative"), (n / F.lit(width * s.meta.scale_ms / 1000.0)).alias("rate"))


def cloud(f: Frame) -> DataFrame:
    """The cells of frames that aren't zero as points: x, y, z (the channel) and value."""
    return f.df.where("value <> 0").select(*f.keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("c").cast("double").alias("z"), F.col("value").cast("double").alias("value"))


def event_cloud(s: EventStream, depth: float = 1.0) -> DataFrame:
    """Events as points: x, y, z from 0 at the slice's first time to ``depth`` at its last, and p."""
    bounds = s.df.groupBy(*s.keys).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    df = s.df.join(F.broadcast(bounds), list(s.keys)) if s.keys else s.df.join(F.broadcast(bounds), F.lit(True))
    z = F.when(F.col("t1") > F.col("t0"), (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")) * F.lit(float(depth))).otherwise(0.0)
    return df.select(*s.keys, "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), z.alias("z"), "p")


def pixel_counts(s: EventStream) -> DataFrame:
    return s.df.groupBy(*s.keys, "x", "y").agg(F.count("*").alias("count"))


#: Representations by name, with what they take.
REGISTRY = {
    "binary": binary, "count": count, "polarity": polarity, "voxel": voxel, "tsurf": tsurf, "atsurf": atsurf,
    "tencode": tencode, "countmask": countmask, "redblue": redblue, "mcts": mcts, "pset": pset,
}


def register(name: str, make) -> None:
    """Add a representation: a function of a stream and options that returns a Frame."""
    REGISTRY[name] = make


def flatten(s: EventStream, name: str = "polarity", **options):
    """A representation by name."""
    if options.pop("binary", False):
        return binary(s)
    try:
        make = REGISTRY[name]
    except KeyError:
        raise ValueError(f"no representation {name!r}; there are {', '.join(REGISTRY)}") from None
    return make(s, **options)
