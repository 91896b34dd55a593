"""Lazy recordings: slices by time, count or sliding windows, operators put off, frames for all slices in one plan."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.units import duration_us, scale_us
from ..operators import augment, clock, features, filters, frames, masks, motion, represent, transforms
from ..stream import EventStream


@dataclass(frozen=True)
class Slicing:
    """``dt``: slices of that many time units from ``origin`` on; ``n``: slices of n events; ``step``: a window starts so often."""

    dt: int | None = None
    n: int | None = None
    step: int | None = None
    offset: int | None = None


def sliced(s: EventStream, how: Slicing) -> tuple[EventStream, DataFrame]:
    """The stream with a ``slice_id``, and the table of all slices, empty ones included: slice_id, t0, t1."""
    base = transforms.skip_before(s, how.offset) if how.offset is not None else s
    spark = s.df.sparkSession
    if how.n:
        n = int(how.n)
        df = transforms.numbered(base).withColumn("slice_id", F.expr(f"place div {n}")).drop("place")
        out = EventStream(df.select(*base.columns, "slice_id"), base.meta, ("slice_id",))
        return out, df.groupBy("slice_id").agg(F.min("t").alias("t0"), (F.max("t") + 1).alias("t1"))
    span = base.time_span()
    dt = int(how.dt)
    if dt <= 0:
        raise ValueError("a slice needs a length")
    meta = replace(s.meta, span_ms=dt * s.meta.scale_ms)
    if span is None:
        empty = base.df.withColumn("slice_id", F.lit(0).cast("long"))
        return EventStream(empty, meta, ("slice_id",)), spark.createDataFrame([], "slice_id long, t0 long, t1 long")
    origin = span[0] if how.offset is None else max(span[0], how.offset)
    step = int(how.step or dt)
    last = (span[1] - origin) // step
    ids = spark.range(last + 1).select(F.col("id").alias("slice_id"), (F.lit(origin) + F.col("id") * step).alias("t0"), (F.lit(origin) + F.col("id") * step + dt).alias("t1"))
    at = F.col("t") - F.lit(origin)
    if step == dt:
        df = base.df.withColumn("slice_id", F.expr(f"(t - {origin}) div {dt}"))
    else:
        # an event is in the windows that start after t - dt and not after t
        first = F.greatest(F.floor((at - dt) / step) + 1, F.lit(0)).cast("long")
        ends = F.least(F.floor(at / step), F.lit(last)).cast("long")
        df = base.df.withColumn("slice_id", F.explode(F.when(first <= ends, F.sequence(first, ends)).otherwise(F.array().cast("array<bigint>"))))
    return EventStream(df.select(*base.columns, "slice_id"), meta, ("slice_id",)), ids


class EventReader:
    """A recording in slices.  Operators are put off and run on each slice; nothing runs before a result is asked for."""

    def __init__(self, stream: EventStream, slicing: Slicing, hot_pixel_filter: bool = False, hot_pixel_std: float = 3.0) -> None:
        self.source, self.slicing = stream, slicing
        if hot_pixel_filter:
            self.source = filters.hot_pixel_filter(stream, hot_pixel_std)
        self.operators: tuple = ()
        self.repr: tuple[str, dict] | None = None
        if slicing.dt or slicing.n:
            self.stream, self.slices = sliced(self.source, slicing)
        else:
            # windows only: there are no numbered slices
            self.stream, self.slices = self.source, None

    def _with(self, **changes) -> "EventReader":
        out = object.__new__(EventReader)
        out.__dict__ |= self.__dict__ | changes
        return out

    def apply(self, operator, *args, **options) -> "EventReader":
        """Put off any operator from stream to stream."""
        def put_off(s: EventStream) -> EventStream:
            return operator(s, *args, **options)

        return self._with(stream=put_off(self.stream), operators=(*self.operators, put_off))

    def with_repr(self, name: str, **options) -> "EventReader":
        return self._with(repr=(name, options))

    def _shown(self, s: EventStream):
        return s if self.repr is None else represent.flatten(s, self.repr[0], **self.repr[1])

    def _window(self, s: EventStream):
        """The operators and the representation, on a window that isn't one of the slices."""
        return self._shown(reduce(lambda x, f: f(x), self.operators, s))

    def frames(self):
        """The representation of all slices."""
        if self.repr is None:
            raise ValueError("with_repr() says what to make")
        return represent.flatten(self.stream, self.repr[0], **self.repr[1])

    def __len__(self) -> int:
        if self.slices is None:
            raise ValueError("open with dt_ms or max_events for numbered slices")
        return self.slices.count()

    @property
    def n_slices(self) -> int:
        return len(self)

    def n_events(self) -> int:
        return self.source.n_events()

    def time_span(self):
        return self.source.time_span()

    def slice(self, n: int):
        """The n-th slice, from the end if negative.  The scan gets the slice's times as a filter too."""
        size = len(self)
        k = n + size if n < 0 else n
        if not 0 <= k < size:
            raise IndexError(n)
        t0, t1 = self.slices.where(F.col("slice_id") == k).select("t0", "t1").first()
        plain = self.stream.df.where(F.col("slice_id") == k)
        if not self.operators and self.slicing.dt:
            # the filter on times reaches the scan, the one on slice_id can't
            plain = plain.where((F.col("t") >= t0) & (F.col("t") < t1))
        return self._shown(EventStream(plain.drop("slice_id"), self.stream.meta))

    def slice_time(self, t0: int, t1: int | None = None):
        """The events at t0 <= t < t1, with operators and representation."""
        s = transforms.time_window(self.source, t0, t1)
        return self._window(s if t1 is None else s.with_(span_ms=(t1 - t0) * s.meta.scale_ms))

    def slice_count(self, i0: int, i1: int):
        """The events with places i0 <= i < i1 in the recording, with operators and representation."""
        df = transforms.numbered(self.source).where((F.col("place") >= max(0, i0)) & (F.col("place") < i1))
        return self._window(self.source.with_(df.select(*self.source.columns)))

    def __getitem__(self, n: int):
        return self.slice(n)

    def batch(self, indices: list[int]):
        """Frames of the chosen slices."""
        f = self.frames()
        return replace(f, df=f.df.where(F.col("slice_id").isin([int(i) for i in indices])))

    def windows(self, step: int | None = None, span: int | None = None, **units) -> "EventReader":
        """Windows of ``span`` that start every ``step``, in time units or as ``step_ms``, ``span_us`` and so on.

        ``step`` is the slices' length if not given, ``span`` the step; without
        either, the slices themselves, be they by time or by number.  Operators,
        representation and offset go on.
        """
        step, span = (self._duration(name, value, units) for name, value in (("step", step), ("span", span)))
        if units:
            raise TypeError(f"unknown arguments: {', '.join(units)}")
        if step is None and span is None and self.slicing.n:
            return self
        step = step or self.slicing.dt
        if not step:
            raise ValueError("windows need a step, or slices by time")
        out = EventReader(self.source, Slicing(dt=span or step, step=step, offset=self.slicing.offset))
        return reduce(lambda r, f: r.apply(f), self.operators, out)._with(repr=self.repr)

    def _duration(self, name: str, value, units: dict) -> int | None:
        given = {k: units.pop(k) for k in [*units] if k.rsplit("_", 1)[0] == name}
        us = duration_us(name, **given)
        if us is None or value is not None:
            if us is not None:
                raise ValueError(f"{name} is given twice")
            return None if value is None else int(value)
        return int(us / 1000 / self.source.meta.scale_ms + 0.5)

    def __iter__(self):
        """Slice by slice; for all at once in one plan there are ``frames`` and ``stream``."""
        return (self.slice(n) for n in range(len(self)))

    def save(self, path: str, *, format: str | None = None, **options) -> None:
        """Write the whole recording, operators done, in any format; slices are written together, in order."""
        from ..sources.files import save

        s = self.stream
        save(EventStream(s.df.select("x", "y", "t", "p", "seq"), s.meta), path, format=format, **options)

    def alongside(self, samples: DataFrame, t: str = "t") -> DataFrame:
        """Frames, IMU readings or other samples on the same clock, with the slice they fall in."""
        length = self.slicing.dt
        if not length:
            length = max(1, int(self.slices.agg(F.max(F.col("t1") - F.col("t0"))).first()[0] or 1))
        return clock.alongside(self.slices, samples, length, t)

    def sliding_counts(self, by_polarity: bool = False) -> DataFrame:
        """slice_id, c, y, x, value of the slices' event counts, for windows that overlap.

        Events are counted once, in panes as long as windows have in common;
        windows add up their panes, so a wide window costs no more events.
        """
        dt, step = self.slicing.dt, self.slicing.step or self.slicing.dt
        if not dt:
            raise ValueError("sliding counts are of windows of time")
        pane = math.gcd(dt, step)
        plain = reduce(lambda x, f: f(x), self.operators, EventReader(self.source, Slicing(dt=pane, offset=self.slicing.offset)).stream)
        c = F.when(F.col("p"), 0).otherwise(1) if by_polarity else F.lit(0)
        panes = plain.df.groupBy("slice_id", c.alias("c"), "y", "x").agg(F.count("*").alias("value"))
        last = self.slices.agg(F.max("slice_id").alias("_last"))
        # pane k is in the windows that start after k * pane - dt and not after k * pane
        first = F.greatest(F.floor((F.col("slice_id") * pane - dt) / step) + 1, F.lit(0)).cast("long")
        ends = F.least(F.floor(F.col("slice_id") * pane / step), F.col("_last")).cast("long")
        windows = F.explode(F.when(first <= ends, F.sequence(first, ends)).otherwise(F.array().cast("array<bigint>")))
        spread = panes.join(F.broadcast(last), F.lit(True)).select(windows.alias("window"), "c", "y", "x", "value")
        return spread.groupBy(F.col("window").alias("slice_id"), "c", "y", "x").agg(F.sum("value").alias("value"))

    def summary(self) -> DataFrame:
        """n_events of every slice, empty ones included."""
        counts = self.stream.df.groupBy("slice_id").agg(F.count("*").alias("n_events"))
        return self.slices.join(counts, "slice_id", "left").select("slice_id", "t0", "t1", F.coalesce("n_events", F.lit(0)).alias("n_events"))


def open_stream(stream: EventStream, *, dt_ms: float | None = None, max_events: int | None = None, offset: int | None = None, step_ms: float | None = None, **options) -> EventReader:
    """A reader with slices of ``dt_ms`` or of ``max_events``; one of them, not both."""
    if (dt_ms is None) == (max_events is None):
        raise ValueError("give dt_ms or max_events")
    ticks = lambda ms: None if ms is None else int(stream.meta.ticks(ms) + 0.5)
    return EventReader(stream, Slicing(ticks(dt_ms), max_events, ticks(step_ms), offset), **options)


def open(spark, source, *, max_events: int | None = None, repr: str | None = None, hot_pixel_filter: bool = False, hot_pixel_std: float = 3.0, downsample: int | None = None, sensor_size=None, time_unit: str = "us", order: str | None = None, topic: str | None = None, **durations) -> EventReader:
    """A reader of a recording: a file's path, a stream, or an array.

    Slices are by ``dt_ms`` (or ``dt_s``, ``dt_us``, ``dt_ns``) or by
    ``max_events``; without either there are windows only.  ``offset`` (in
    milliseconds, or ``offset_us`` and so on) is the time that slices start at.
    ``downsample`` is for ``repr="polarity"``.
    """
    from ..sources import files

    dt = duration_us("dt", **{k: v for k, v in durations.items() if k.rsplit("_", 1)[0] == "dt"})
    offsets = {k: v for k, v in durations.items() if k == "offset" or k.startswith("offset_")}
    unknown = {k for k in durations if k.rsplit("_", 1)[0] != "dt" and k not in offsets}
    if unknown:
        raise TypeError(f"unknown arguments: {', '.join(sorted(unknown))}")
    if len([v for v in offsets.values() if v is not None]) > 1:
        raise ValueError("offset is given in several units")
    if dt is not None and max_events is not None:
        raise ValueError("give dt or max_events, not both")
    if downsample is not None and (repr != "polarity" or downsample < 1):
        raise ValueError("downsample is a whole number from 1 on, for repr='polarity'")
    if isinstance(source, EventStream):
        stream = source
    elif isinstance(source, (str, os.PathLike)):
        stream = files.load(spark, os.fspath(source), sensor_size=sensor_size, time_unit=time_unit, order=order or "txyp", topic=topic)
    else:
        stream = files.from_numpy(spark, source, sensor_size=sensor_size, time_unit=time_unit, order=order or "xytp")
    ticks = lambda us: None if us is None else int(us / 1000 / stream.meta.scale_ms + 0.5)
    offset = next((int(round(v * scale_us(k.partition("_")[2] or "ms") / 1000 / stream.meta.scale_ms)) for k, v in offsets.items() if v is not None), None)
    reader = EventReader(stream, Slicing(ticks(dt), max_events, None, offset), hot_pixel_filter, hot_pixel_std)
    return reader if repr is None else reader.with_repr(repr, **({} if downsample is None else {"downsample": downsample}))


#: Operators that readers and streams have as methods.
OPERATORS = {f.__name__: f for f in (
    transforms.crop, transforms.roi, transforms.rate_cap, transforms.flip_x, transforms.flip_y, transforms.rotate90, transforms.transpose, transforms.translate, transforms.resize, transforms.scale,
    transforms.warp_affine, transforms.warp_perspective, transforms.undistort, masks.mask, transforms.time_window, transforms.time_shift, transforms.time_scale,
    transforms.normalize_time, transforms.decimate, transforms.filter_polarity, transforms.invert_polarity, transforms.sort_by_time,
    augment.random_flip_x, augment.random_flip_y, augment.random_polarity_flip, augment.random_crop, augment.event_drop, augment.pixel_dropout,
    augment.spatial_jitter, augment.time_jitter, augment.time_reversal,
    filters.background_activity_filter, filters.refractory_filter, filters.hot_pixel_filter, features.efast, features.harris_corners,
)}


def _save(s: EventStream, path: str, **options) -> None:
    """Write the stream, a simulation's result for one, in any format."""
    from ..sources.files import save

    save(s, path, **options)


def consume(s: EventStream, make, schema: str) -> DataFrame:
    """Fold each slice's events, in order, by an object of one's own.

    ``make()`` gives an object with ``push(x, y, t, p)`` and ``result()``, a row
    or rows as ``schema`` says; slices are folded in parallel, each in a task.
    """
    from pyspark.sql.types import StructType

    if not s.keys:
        raise ValueError("slices are folded; open the stream with dt_ms or max_events")
    out = StructType([*s.df.select(*s.keys).schema.fields, *StructType.fromDDL(schema).fields])
    names, keys = [f.name for f in StructType.fromDDL(schema).fields], s.keys

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        consumer, pdf = make(), pdf.sort_values("seq")
        for x, y, t, p in zip(pdf["x"].tolist(), pdf["y"].tolist(), pdf["t"].tolist(), pdf["p"].tolist()):
            consumer.push(x, y, t, p)
        rows = consumer.result()
        made = pd.DataFrame(rows if isinstance(rows, list) else [rows], columns=names)
        for i, k in enumerate(keys):
            made.insert(i, k, pdf[k].iloc[0])
        return made

    return s.df.select(*s.columns).groupBy(*s.keys).applyInPandas(run, out)


def _attach() -> None:
    for name, f in OPERATORS.items():
        setattr(EventStream, name, f)
        setattr(EventReader, name, lambda self, *a, _f=f, **k: self.apply(_f, *a, **k))
    more = (transforms.concat, transforms.max_events, transforms.skip_before, motion.optical_flow, motion.iwe, motion.contrast_maximise, represent.flatten, represent.count, represent.voxel, represent.tsurf, represent.atsurf, represent.tencode, represent.countmask, represent.redblue, represent.mcts, represent.pset, represent.raw_image, represent.event_rate, represent.pixel_counts)
    for f in more:
        setattr(EventStream, f.__name__, f)
    EventStream.save = _save
    EventStream.consume = consume
    for f in (frames.resize, frames.connected_components, frames.numpy, frames.dense, frames.filled, frames.blobs):
        setattr(represent.Frame, f.__name__, f)


_attach()
