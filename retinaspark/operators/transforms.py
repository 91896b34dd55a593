"""Geometry, time, polarity and order of event streams."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.camera import Camera
from ..stream import EventStream


#: Time units of a range that one task sorts: 50 ms, five million events at the rate of the fastest sensors.
SORT_BIN = 50_000


def _half_away(c):
    # Spark rounds halves away from zero, as geometry here wants
    return F.round(c).cast("long")


def crop(s: EventStream, x0: int, y0: int, width: int, height: int) -> EventStream:
    """The window of ``width`` x ``height`` at (x0, y0), with its corner as the new origin."""
    return s.mapped(width, height, x=F.col("x") - x0, y=F.col("y") - y0)


def roi(s: EventStream, x0: int, y0: int, width: int, height: int) -> EventStream:
    """The events of a window of the sensor, where they are."""
    return s.with_(s.df.where((F.col("x") >= x0) & (F.col("x") < x0 + width) & (F.col("y") >= y0) & (F.col("y") < y0 + height)))


def rate_cap(s: EventStream, max_rate: float, bin_ms: float = 1.0) -> EventStream:
    """At most ``max_rate`` events a second: of each bin of time the first that fit."""
    width = max(1, int(s.meta.ticks(bin_ms) + 0.5))
    most = max(1, int(max_rate * width * s.meta.scale_ms / 1000.0))
    bin_ = F.expr(f"t div {width}")
    place = F.row_number().over(Window.partitionBy(*s.keys, bin_).orderBy("seq"))
    return s.with_(s.df.withColumn("_place", place).where(F.col("_place") <= most).select(*s.columns))


def flip_x(s: EventStream) -> EventStream:
    return s.mapped(x=s.meta.width - 1 - F.col("x"))


def flip_y(s: EventStream) -> EventStream:
    return s.mapped(y=s.meta.height - 1 - F.col("y"))


def rotate90(s: EventStream, k: int = 1) -> EventStream:
    """Quarter turns clockwise."""
    w, h = s.sensor_size
    turned = {
        0: (w, h, F.col("x"), F.col("y")),
        1: (h, w, h - 1 - F.col("y"), F.col("x")),
        2: (w, h, w - 1 - F.col("x"), h - 1 - F.col("y")),
        3: (h, w, F.col("y"), w - 1 - F.col("x")),
    }[k % 4]
    return s.mapped(turned[0], turned[1], x=turned[2], y=turned[3])


def transpose(s: EventStream) -> EventStream:
    return s.mapped(s.meta.height, s.meta.width, x=F.col("y"), y=F.col("x"))


def translate(s: EventStream, dx: int, dy: int) -> EventStream:
    return s.mapped(*s.sensor_size, x=F.col("x") + dx, y=F.col("y") + dy)


def resize(s: EventStream, width: int, height: int) -> EventStream:
    """Rebin to another sensor size; every event stays.  A sensor without extent is left as it is."""
    w, h = s.sensor_size
    if width <= 0 or height <= 0:
        return s.with_(s.df.where(F.lit(False)), width=max(width, 0), height=max(height, 0))
    if not w or not h or (w, h) == (width, height):
        return s
    return s.mapped(width, height, x=F.expr(f"cast(cast(x as bigint) * {int(width)} div {w} as int)"), y=F.expr(f"cast(cast(y as bigint) * {int(height)} div {h} as int)"))


def scale(s: EventStream, sx: float, sy: float | None = None) -> EventStream:
    """Resize by factors."""
    sy = sx if sy is None else sy
    return resize(s, math.floor(s.meta.width * sx + 0.5), math.floor(s.meta.height * sy + 0.5))


def warp_affine(s: EventStream, matrix) -> EventStream:
    """Map pixels by a 2 x 3 matrix, to the nearest pixel."""
    (a, b, c), (d, e, f) = [[float(v) for v in r] for r in matrix]
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    moved = s.df.withColumns({"x": _half_away(x * a + y * b + F.lit(c)), "y": _half_away(x * d + y * e + F.lit(f))})
    return _placed(s, moved)


def warp_perspective(s: EventStream, matrix) -> EventStream:
    """Map pixels by a 3 x 3 homography; points at infinity go."""
    m = [[float(v) for v in r] for r in matrix]
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    u, v, w = (x * r[0] + y * r[1] + F.lit(r[2]) for r in m)
    ok = s.df.where(w != 0)
    return _placed(s, ok.withColumns({"x": _half_away(u / F.nullif(w, F.lit(0.0))), "y": _half_away(v / F.nullif(w, F.lit(0.0)))}))


def _placed(s: EventStream, moved) -> EventStream:
    w, h = s.sensor_size
    inside = moved.where((F.col("x") >= 0) & (F.col("x") < w) & (F.col("y") >= 0) & (F.col("y") < h))
    return s.with_(inside.select(*[F.col(c).cast("int").alias(c) if c in "xy" else F.col(c) for c in s.columns]))


def undistort(s: EventStream, camera: Camera) -> EventStream:
    """Move pixels to where a lens without distortion would have them."""
    table = s.df.sparkSession.createDataFrame(camera.table(*s.sensor_size), "x int, y int, u int, v int")
    # the table has a row for each pixel of the sensor at most
    joined = s.df.join(F.broadcast(table), ["x", "y"])
    return s.with_(joined.select(*[F.col({"x": "u", "y": "v"}.get(c, c)).alias(c) for c in s.columns]))


def time_window(s: EventStream, t0: int | None = None, t1: int | None = None) -> EventStream:
    """Events at t0 <= t < t1."""
    df = s.df
    if t0 is not None:
        df = df.where(F.col("t") >= t0)
    if t1 is not None:
        df = df.where(F.col("t") < t1)
    return s.with_(df)


def time_shift(s: EventStream, dt: int) -> EventStream:
    return s.mapped(t=F.col("t") + F.lit(int(dt)))


def time_scale(s: EventStream, factor: float) -> EventStream:
    return s.mapped(t=F.round(F.col("t") * F.lit(float(factor))).cast("long"))


def normalize_time(s: EventStream) -> EventStream:
    """Times from each slice's first on."""
    if s.keys:
        return s.mapped(t=F.col("t") - F.min("t").over(s.over()))
    # one stream: its first time is one row, not a window in one task
    first = s.df.agg(F.min("t").alias("first_t"))
    return s.with_(s.df.join(F.broadcast(first), F.lit(True)).select(*[(F.col("t") - F.col("first_t")).alias("t") if c == "t" else c for c in s.columns]))


def numbered(s: EventStream, name: str = "place"):
    """The events with their place in the slice's order, from 0, without one task for all of a long stream.

    Runs of ``seq`` are counted first; a place is the count of the runs before,
    and the row number within the run.
    """
    run = 100_000
    df = s.df.withColumn("_run", F.floor(F.col("seq") / run))
    counts = df.groupBy(*s.keys, "_run").agg(F.count("*").alias("_n"))
    before = s.over().orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*s.keys, "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(s.over("_run").orderBy("seq")) - 1
    return df.withColumn("_at", within).join(starts, [*s.keys, "_run"]).withColumn(name, F.col("_at") + F.col("_start")).drop("_run", "_at", "_start")


def decimate(s: EventStream, k: int) -> EventStream:
    """Every k-th event, the first one included."""
    k = max(1, int(k))
    if k == 1:
        return s
    return s.with_(numbered(s).where(F.col("place") % k == 0).select(*s.columns))


def filter_polarity(s: EventStream, positive) -> EventStream:
    return s.with_(s.df.where(F.col("p") == F.lit(bool(positive > 0) if not isinstance(positive, bool) else positive)))


def invert_polarity(s: EventStream) -> EventStream:
    return s.mapped(p=~F.col("p"))


def sort_by_time(s: EventStream) -> EventStream:
    """Order by time; events at one time keep their order.  ``seq`` is numbered anew."""
    order = F.row_number().over(s.over().orderBy("t", "seq")).cast("long") - 1
    if s.keys:
        return s.with_(s.df.withColumn("seq", order).select(*s.columns))
    # ranges of t are sorted apart, and the counts before them added
    ranked = s.df.withColumn("_bin", F.floor(F.col("t") / SORT_BIN))
    counts = ranked.groupBy("_bin").agg(F.count("*").alias("_n"))
    starts = counts.select("_bin", (F.sum("_n").over(s.over().orderBy("_bin")) - F.col("_n")).alias("_start"))
    within = F.row_number().over(s.over("_bin").orderBy("t", "seq")).cast("long") - 1
    return s.with_(ranked.withColumn("_at", within).join(starts, "_bin").withColumn("seq", F.col("_at") + F.col("_start")).select(*s.columns))


def concat(s: EventStream, others) -> EventStream:
    """The streams one after the other, on a sensor that holds them all."""
    parts = [s, *others]
    tops, offset = [], 0
    for part in parts:
        tops.append(offset)
        last = part.df.agg(F.max("seq")).first()[0]
        offset += 0 if last is None else last + 1
    dfs = [p.df.select(*[(F.col("seq") + o).alias("seq") if c == "seq" else F.col(c) for c in s.columns]) for p, o in zip(parts, tops)]
    return s.with_(reduce(lambda a, b: a.unionByName(b), dfs), width=max(p.meta.width for p in parts), height=max(p.meta.height for p in parts))


def max_events(s: EventStream, n: int) -> EventStream:
    """The first n events."""
    return s.with_(s.df.orderBy("seq").limit(int(n)))


def skip_before(s: EventStream, t: int) -> EventStream:
    return time_window(s, t0=t)
