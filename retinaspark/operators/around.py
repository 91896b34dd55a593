"""Latest times around events, over blocks of the stream and tiles of the sensor side by side.

A block of ``seq`` begins with the last event that each pixel had before it, a
tile has a halo of pixels: no group grows with the recording, and none waits
for another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stream import EventStream

#: Pixels of a tile's side; the least span of ``seq`` in a block; rows that are looked at together.
TILE, BLOCK, ROWS, PIECE = 64, 1 << 15, 1 << 16, 1 << 13


class Around:
    """``rows`` in order within each ``group``, and the latest times at the pixels around them.

    Events of another group or ``bank`` aren't seen, nor those without a time or off the sensor.
    """

    def __init__(self, rows: pd.DataFrame, group: np.ndarray, size: tuple[int, int], reach: int):
        self.rows, self.n = rows, len(rows)
        # far off the sensor, out of everything's reach, is as good as farther
        self.x, self.y = (rows[c].to_numpy(np.int64).clip(-reach - 1, n + reach) for c, n in (("x", size[0]), ("y", size[1])))
        self.own, self.timed = rows["own"].to_numpy(bool), rows["t"].notna().to_numpy()
        self.t = np.where(self.timed, rows["t"], 0).astype(np.int64)
        self.seen = self.timed & self.inside(0, size)
        x0, y0 = int(self.x.min()) - reach, int(self.y.min()) - reach
        self.wide, high = int(self.x.max()) - x0 + 1 + reach, int(self.y.max()) - y0 + 1 + reach
        bank = rows["bank"].to_numpy(np.int64)
        cell = ((group * (int(bank.max()) + 1) + bank) * high + self.y - y0) * self.wide + self.x - x0
        self.order = np.argsort(cell, kind="stable")
        self.key = cell * self.n + np.arange(self.n)
        there = self.order[self.seen[self.order]]
        self.keys, self.times = np.append(-1, self.key[there]), np.append(0, self.t[there])

    def inside(self, border: int, size: tuple[int, int]) -> np.ndarray:
        return (self.x >= border) & (self.x < size[0] - border) & (self.y >= border) & (self.y < size[1] - border)

    def pieces(self, asking: np.ndarray) -> Iterator[np.ndarray]:
        """Places of own rows that ask, pixel by pixel, some at a time."""
        at = self.order[(asking & self.own)[self.order]]
        for i in range(0, len(at), PIECE):
            yield at[i: i + PIECE]

    def latest(self, at: np.ndarray, dx: int, dy: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether the pixel there had an event up to each of these rows, and its latest time."""
        want = self.key[at] + (dy * self.wide + dx) * self.n
        i = np.searchsorted(self.keys, want, side="right") - 1
        return self.keys[i] >= want - at, self.times[i]


def gathered(parts: Iterator[pd.DataFrame], least: int) -> Iterator[list[pd.DataFrame]]:
    """Batches until they have ``least`` rows together."""
    some, n = [], 0
    for pdf in parts:
        if len(pdf):
            some.append(pdf)
            n += len(pdf)
        if n >= least:
            yield some
            some, n = [], 0
    if some:
        yield some


def around_events(s: EventStream, work: Callable[[Around], pd.DataFrame], schema, reach: int, bank: Column | None = None) -> DataFrame:
    """Run ``work`` on the events with the latest times up to ``reach`` pixels around each, of the same ``bank``.

    ``work`` must return rows of own events only: others are the halo, or came before.
    """
    w, h = s.sensor_size
    keys, nx, ny, span = list(s.keys), -(-max(1, w) // TILE), -(-max(1, h) // TILE), max(BLOCK, 8 * w * h)
    groups = [*keys, "_tx", "_ty", "_block"]
    ev = s.df.where("x is not null and y is not null").select(*s.columns, F.expr(f"seq div {span}").alias("_block"), (F.lit(0) if bank is None else bank).cast("int").alias("bank"))
    # each pixel's last event of a block goes to the blocks up to the one that has the pixel's next; blocks are numbered, as seq may leap
    one = Window.partitionBy(*keys)
    blocks = ev.select(*keys, "_block").distinct().select(*keys, "_block", F.row_number().over(one.orderBy("_block")).alias("_n"), F.count("*").over(one).alias("_most"))
    last = ev.where(f"t is not null and x >= 0 and x < {w} and y >= 0 and y < {h}").groupBy(*keys, "_block", "bank", "x", "y").agg(F.max_by("t", "seq").alias("t"), F.max("seq").alias("seq"))
    then = F.lead("_n").over(Window.partitionBy(*keys, "bank", "x", "y").orderBy("_n"))
    carried = last.join(blocks, [*keys, "_block"]).withColumn("_until", F.coalesce(then, "_most")).where("_until > _n")
    carried = carried.select(*keys, "bank", "x", "y", "t", "seq", F.explode(F.expr("sequence(_n + 1, cast(_until as int))")).alias("_n")).join(blocks.select(*keys, "_n", "_block"), [*keys, "_n"])
    both = ev.withColumn("own", F.lit(True)).unionByName(carried.drop("_n").withColumns({"p": F.lit(False), "own": F.lit(False)}))

    def tile(c: str, n: int, by: int = 0) -> str:
        return f"cast(greatest(least(floor(({c} + {by}) / {TILE}), {n - 1}), 0) as int)"

    for c, n in (("x", nx), ("y", ny)):
        both = both.withColumn(f"_t{c}", F.explode(F.expr(f"sequence({tile(c, n, -reach)}, {tile(c, n, reach)})"))) if n > 1 else both.withColumn(f"_t{c}", F.lit(0))
    both = both.withColumn("own", F.expr(f"own and _tx = {tile('x', nx)} and _ty = {tile('y', ny)}"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a group may go on in the next batch: its pixels' last events are carried over
        held = None
        for some in gathered(parts, ROWS):
            pdf = pd.concat(some if held is None else [held, *some], ignore_index=True)
            new = np.any([v[1:] != v[:-1] for v in (pdf[k].to_numpy() for k in groups)], axis=0)
            group = np.append(0, np.cumsum(new))
            around = Around(pdf, group, (w, h), reach)
            yield work(around)
            tail = pdf[(group == group[-1]) & around.seen]
            held = tail.drop_duplicates(["bank", "x", "y"], keep="last").assign(own=False)

    return both.repartition(*groups).sortWithinPartitions(*groups, "seq").mapInPandas(run, schema)
