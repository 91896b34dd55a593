"""Denoising: background activity, refractory periods, hot pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stream import EventStream
from . import masks
from .around import Around, around_events

BLOCK = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dy) != (0, 0)]
CROSS = [(0, -1), (-1, 0), (1, 0), (0, 1)]


def background_activity_filter(s: EventStream, dt: int, neighbourhood: str = "block") -> EventStream:
    """Keep an event if a neighbouring pixel, not its own, had one at most ``dt`` before."""
    offsets, dt, size, columns = {"block": BLOCK, "cross": CROSS}[neighbourhood], int(dt), s.sensor_size, s.columns

    def work(a: Around) -> pd.DataFrame:
        keep = np.zeros(a.n, bool)
        for at in a.pieces(a.timed):
            for dx, dy in offsets:
                there, t = a.latest(at, dx, dy)
                keep[at] |= there & (a.t[at] - t <= dt)
        return a.rows.loc[keep, columns]

    return s.with_(around_events(s, work, s.df.select(*columns).schema, 1))


def kept_apart(ts: np.ndarray, new: np.ndarray, dt: int, last: int | None = None) -> np.ndarray:
    """Which times are ``dt`` or more after the last kept one before them; ``new``: a pixel's first.

    ``last``: the time kept last by the first pixel, before these.  A time that
    far behind the one before it is kept in any case and starts a run; all runs
    go from one kept time to the next together.
    """
    n = len(ts)
    gap = np.diff(ts, prepend=ts[:1])
    if (gap[~new] < 0).any():
        keep, held = np.zeros(n, bool), last
        for i in range(n):
            if new[i]:
                held = None
            if held is None or ts[i] - held >= dt:
                keep[i], held = True, int(ts[i])
        return keep
    head = new | (gap >= dt)
    head[0] = new[0] or last is None
    run = np.cumsum(head)
    # times of all runs on one line, runs far apart
    line = (ts - ts.min()) + run * (int(ts.max() - ts.min()) + int(dt) + 1)
    ends = np.append(np.flatnonzero(np.diff(run)) + 1, n)
    end_of = dict(zip(run[ends - 1].tolist(), ends.tolist()))
    now = np.flatnonzero(head)
    stop = np.array([end_of[k] for k in run[now].tolist()], np.int64)
    keep = np.zeros(n, bool)
    keep[now] = True
    if not head[0]:
        first = int(np.searchsorted(line[: ends[0]], line[0] + (last - ts[0]) + dt))
        if first < ends[0]:
            keep[first], now, stop = True, np.append(now, first), np.append(stop, ends[0])
    while len(now):
        then = np.maximum(np.searchsorted(line, line[now] + dt), now + 1)
        go = then < stop
        now, stop = then[go], stop[go]
        keep[now] = True
    return keep


def refractory_filter(s: EventStream, dt: int, refresh: str = "kept") -> EventStream:
    """Drop events less than ``dt`` after the pixel's last one ("all") or its last kept one ("kept")."""
    dt = int(dt)
    if refresh == "all":
        before = F.lag("t").over(s.over("x", "y").orderBy("seq"))
        df = s.df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("t") - F.col("_before") >= dt))
        return s.with_(df.select(*s.columns))
    if refresh != "kept":
        raise ValueError("refresh is 'all' or 'kept'")

    cells = [*s.keys, "x", "y"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a pixel's events may go on in the next batch, so what was kept last is carried over
        held, last = None, None
        for pdf in parts:
            if not len(pdf):
                continue
            values = [pdf[k].to_numpy() for k in cells]
            new = np.ones(len(pdf), bool)
            new[1:] = np.any([v[1:] != v[:-1] for v in values], axis=0)
            new[0] = held is None or any(v[0] != h for v, h in zip(values, held))
            ts = pdf["t"].to_numpy()
            keep = kept_apart(ts, new, dt, None if new[0] else last)
            held, tail = [v[-1] for v in values], np.flatnonzero(keep)
            start = int(np.flatnonzero(new)[-1]) if new.any() else 0
            last = int(ts[tail[-1]]) if len(tail) and tail[-1] >= start else last
            yield pdf[keep]

    ordered = s.df.select(*s.columns).repartition(*cells).sortWithinPartitions(*cells, "seq")
    return s.with_(ordered.mapInPandas(run, s.df.select(*s.columns).schema))


def hot_pixels(s: EventStream, n_std: float = 3.0) -> DataFrame:
    """Pixels with more events than mean + n_std standard deviations of the active ones, per slice."""
    counts = s.df.groupBy(*s.keys, "x", "y").agg(F.count("*").alias("c"))
    bar = counts.groupBy(*s.keys).agg((F.avg("c") + F.lit(float(n_std)) * F.stddev_pop("c")).alias("bar"))
    joined = counts.join(F.broadcast(bar), list(s.keys)) if s.keys else counts.join(F.broadcast(bar), F.lit(True))
    return joined.where(F.col("c") > F.col("bar")).select(*s.keys, "x", "y")


def hot_pixel_filter(s: EventStream, n_std: float = 3.0) -> EventStream:
    """Drop the events of hot pixels."""
    hot = hot_pixels(s, n_std)
    if not s.keys:
        return masks.drop_masked_pixels(s, hot)
    return s.with_(s.df.join(hot, [*s.keys, "x", "y"], "left_anti").select(*s.columns))
