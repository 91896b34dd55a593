"""Corners: eFAST and Harris on the latest times around each event."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..stream import EventStream
from .around import Around, around_events

# The circles of radius 3 and 4 around a pixel, clockwise from the top.
RING_3 = [(0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1), (-3, 0), (-3, 1), (-2, 2), (-1, 3)]
RING_4 = [(0, 4), (1, 4), (2, 3), (3, 2), (4, 1), (4, 0), (4, -1), (3, -2), (2, -3), (1, -4), (0, -4), (-1, -4), (-2, -3), (-3, -2), (-4, -1), (-4, 0), (-4, 1), (-3, 2), (-2, 3), (-1, 4)]
#: Lengths of the arcs of newer pixels that make a corner.
ARC_3, ARC_4, BORDER = (3, 6), (4, 8), 4


def _has_arc(times: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Whether some arc of lo..hi places is strictly newer than all the rest of its ring; a ring is a column."""
    n = len(times)
    twice = np.concatenate([times, times])
    found = np.zeros(times.shape[1], bool)
    # least and latest of the k + 1 places from each one on
    least, most = [times], [times]
    for k in range(1, n - lo):
        least.append(np.minimum(least[-1], twice[k: k + n]))
        most.append(np.maximum(most[-1], twice[k: k + n]))
    for k in range(lo, hi + 1):
        found |= (least[k - 1] > np.roll(most[n - k - 1], -k, axis=0)).any(axis=0)
    return found


def efast(s: EventStream) -> EventStream:
    """Keep events at corners of the surface of latest times of their polarity."""
    size, columns, never = s.sensor_size, s.columns, -(2**63)

    def work(a: Around) -> pd.DataFrame:
        keep = np.zeros(a.n, bool)
        for at in a.pieces(a.inside(BORDER, size)):
            for ring, arc in ((RING_3, ARC_3), (RING_4, ARC_4)):
                at = at[_has_arc(np.stack([np.where(*a.latest(at, dx, dy), never) for dx, dy in ring]), *arc)]
            keep[at] = True
        return a.rows.loc[keep, columns]

    # events without a polarity have a surface of their own
    polarity = F.coalesce(F.col("p").cast("int"), F.lit(2))
    return s.with_(around_events(s, work, s.df.select(*columns).schema, BORDER, polarity))


def harris_corners(s: EventStream, threshold: float = 0.0) -> EventStream:
    """Keep events where the surface of latest times has gradients in two directions.

    Over a 9 x 9 window, central differences count where a pixel and its four
    neighbours have fired; det / trace**2 - 0.04 must be above the threshold.
    """
    size, scale, margin, columns = s.sensor_size, s.meta.scale_ms, 5, s.columns
    around = range(-margin, margin + 1)

    def work(a: Around) -> pd.DataFrame:
        keep = np.zeros(a.n, bool)
        for at in a.pieces(a.inside(margin, size)):
            # times of each event's window by row and column; its corners aren't needed
            p = np.full((len(around), len(around), len(at)), np.nan)
            for dy in around:
                for dx in around:
                    if abs(dx) + abs(dy) < 2 * margin:
                        there, t = a.latest(at, dx, dy)
                        p[dy + margin, dx + margin, there] = t[there] * scale
            gx, gy = (p[1:-1, 2:] - p[1:-1, :-2]) / 2, (p[2:, 1:-1] - p[:-2, 1:-1]) / 2
            ok = ~(np.isnan(gx) | np.isnan(gy) | np.isnan(p[1:-1, 1:-1]))
            gx, gy = np.where(ok, gx, 0.0), np.where(ok, gy, 0.0)
            xx, xy, yy = (gx * gx).sum((0, 1)), (gx * gy).sum((0, 1)), (gy * gy).sum((0, 1))
            tr = xx + yy
            with np.errstate(invalid="ignore", divide="ignore"):
                keep[at] = (ok.sum((0, 1)) >= 3) & (tr > 0) & ((xx * yy - xy * xy) / (tr * tr) - 0.04 > threshold)
        return a.rows.loc[keep, columns]

    return s.with_(around_events(s, work, s.df.select(*columns).schema, margin))
