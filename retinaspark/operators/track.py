"""Tracking of blobs over frames."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames
from .represent import Frame


@dataclass
class Track:
    id: int
    cx: float
    cy: float
    vx: float = 0.0
    vy: float = 0.0
    area: int = 0
    age: int = 0
    missed: int = 0


@dataclass
class Tracker:
    """Predicts tracks by their velocity and pairs them with the nearest blobs, closest pairs first."""

    connectivity: int = 8
    min_area: int = 4
    max_distance: float = 20.0
    max_missed: int = 3
    tracks: list[Track] = field(default_factory=list)
    _next: int = 1

    def reset(self) -> None:
        """Forget the tracks; numbers go on, so none is ever used again."""
        self.tracks = []

    def step(self, blobs: list[tuple]) -> list[Track]:
        """Take one frame's blobs, as centres or as centres and areas; returns the tracks."""
        blobs = [(b[0], b[1], b[2] if len(b) > 2 else 0) for b in blobs]
        at = [(t.cx + t.vx, t.cy + t.vy) for t in self.tracks]
        pairs = sorted((((px - bx) ** 2 + (py - by) ** 2) ** 0.5, i, j) for i, (px, py) in enumerate(at) for j, (bx, by, _) in enumerate(blobs))
        used_t, used_b = set(), set()
        for d, i, j in pairs:
            if d > self.max_distance:
                break
            if i in used_t or j in used_b:
                continue
            used_t.add(i)
            used_b.add(j)
            t, (bx, by, area) = self.tracks[i], blobs[j]
            t.vx, t.vy, t.cx, t.cy, t.area, t.missed = bx - t.cx, by - t.cy, bx, by, area, 0
        for i, t in enumerate(self.tracks):
            t.age += 1
            if i not in used_t:
                t.cx, t.cy = at[i]
                t.missed += 1
        self.tracks = [t for t in self.tracks if t.missed <= self.max_missed]
        for j, (bx, by, area) in enumerate(blobs):
            if j not in used_b:
                self.tracks.append(Track(self._next, bx, by, area=area))
                self._next += 1
        return self.tracks

    def update(self, frame: Frame) -> list[Track]:
        """Take one frame."""
        rows = frames.blobs(frame, self.connectivity, self.min_area).orderBy("label").collect()
        return self.step([(r["cx"], r["cy"], r["area"]) for r in rows])


def track(f: Frame, order: str = "slice_id", connectivity: int = 8, min_area: int = 4, max_distance: float = 20.0, max_missed: int = 3) -> DataFrame:
    """The tracks after each frame, frames taken by ``order``; other keys part independent trackers."""
    found = frames.blobs(f, connectivity, min_area)
    rest = [k for k in f.keys if k != order]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tracker, rows = Tracker(connectivity, min_area, max_distance, max_missed), []
        by = {n: g.sort_values("label") for n, g in pdf.groupby(order)}
        for n in range(int(pdf[order].min()), int(pdf[order].max()) + 1):
            g = by.get(n)
            for t in tracker.step([] if g is None else list(zip(g["cx"], g["cy"], g["area"]))):
                rows.append({order: n, "track_id": t.id, "cx": t.cx, "cy": t.cy, "vx": t.vx, "vy": t.vy, "area": t.area, "age": t.age, "missed": t.missed} | {k: pdf[k].iloc[0] for k in rest})
        return pd.DataFrame(rows, columns=[*rest, order, "track_id", "cx", "cy", "vx", "vy", "area", "age", "missed"])

    head = "".join(f"{x.name} {x.dataType.simpleString()}, " for x in found.select(*rest).schema) if rest else ""
    grouped = found.groupBy(*rest) if rest else found.groupBy(F.lit("all"))
    return grouped.applyInPandas(run, head + f"{order} long, track_id int, cx double, cy double, vx double, vy double, area long, age int, missed int")
