"""Events from frames: a pixel model, pixels in parallel, frames in order."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SensorMeta
from ..stream import EventStream
from .augment import uniform

#: Up to this luma the log is a line.
LINEAR_UP_TO = 20.0


@dataclass(frozen=True)
class SimulatorConfig:
    pos_thres: float = 0.2
    neg_thres: float = 0.2
    sigma_thres: float = 0.03
    refractory_us: int = 100
    cutoff_hz: float = 200.0
    leak_rate_hz: float = 1.0
    shot_noise_rate_hz: float = 10.0
    seed: int = 0
    upsample: str | int = "off"
    max_events_per_pixel: float = 1.0
    max_upsample: int = 64

    @classmethod
    def ideal(cls, **changes) -> "SimulatorConfig":
        """No noise, leak, low-pass or refractory period."""
        return replace(cls(sigma_thres=0.0, refractory_us=0, cutoff_hz=0.0, leak_rate_hz=0.0, shot_noise_rate_hz=0.0), **changes)


def linear_luma(r: int, g: int, b: int) -> float:
    """Luma from 0 to 255 of sRGB bytes, mixed in linear light."""
    lin = [c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in (r, g, b)]
    return 255.0 * (0.2126 * lin[0] + 0.7152 * lin[1] + 0.0722 * lin[2])


def lin_log(v):
    """Log intensity, a line through zero for dark values."""
    if hasattr(v, "_jc"):
        return F.when(v <= LINEAR_UP_TO, v * F.lit(math.log(LINEAR_UP_TO) / LINEAR_UP_TO)).otherwise(F.ln(v))
    v = np.asarray(v, float)
    return np.where(v <= LINEAR_UP_TO, v * (math.log(LINEAR_UP_TO) / LINEAR_UP_TO), np.log(np.maximum(v, 1e-9)))


def interpolate(frames: DataFrame, factor: int = 2, between=None) -> DataFrame:
    """Frames between each two: (frame, t, y, x, luma), numbered anew; linear, or by ``between``.

    ``between(a, b, share)`` makes the [H, W] luma at a share of the way between
    two frames, by a model for one; each pair of frames is a group of its own.
    """
    if factor <= 1:
        return frames
    if between is not None:
        return _modelled(frames, factor, between)
    w = Window.partitionBy("y", "x").orderBy("frame")
    pairs = frames.withColumns({"t1": F.lead("t").over(w), "l1": F.lead("luma").over(w)})
    steps = pairs.select("frame", "t", "y", "x", "luma", "t1", "l1", F.explode(F.sequence(F.lit(0), F.when(F.col("t1").isNull(), 0).otherwise(factor - 1))).alias("k"))
    a = F.col("k") / F.lit(float(factor))
    return steps.select((F.col("frame") * factor + F.col("k")).alias("frame"), F.when(F.col("k") == 0, F.col("t")).otherwise(F.round(F.col("t") + (F.col("t1") - F.col("t")) * a).cast("long")).alias("t"), "y", "x", F.when(F.col("k") == 0, F.col("luma")).otherwise(F.col("luma") + (F.col("l1") - F.col("luma")) * a).alias("luma"))


def _modelled(frames: DataFrame, factor: int, between) -> DataFrame:
    both = frames.select("*", F.explode(F.array(F.col("frame"), F.col("frame") - 1)).alias("pair"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["pair"].iloc[0])
        images, times = {}, {}
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        for n, g in pdf.groupby("frame"):
            images[n] = np.zeros((h, w))
            images[n][g["y"], g["x"]] = g["luma"]
            times[n] = int(g["t"].iloc[0])
        if first not in images:
            return pd.DataFrame(columns=["frame", "t", "y", "x", "luma"])
        made = [(first * factor, times[first], images[first])]
        if first + 1 in images:
            for k in range(1, factor):
                share = k / factor
                made.append((first * factor + k, int(math.floor(times[first] + (times[first + 1] - times[first]) * share + 0.5)), np.asarray(between(images[first], images[first + 1], share), float)))
        y, x = np.divmod(np.arange(h * w), w)
        return pd.concat([pd.DataFrame({"frame": n, "t": t, "y": y, "x": x, "luma": image.ravel()}) for n, t, image in made])

    return both.groupBy("pair").applyInPandas(run, "frame long, t long, y int, x int, luma double")


def substeps(frames: DataFrame, config: SimulatorConfig) -> DataFrame:
    """frame and steps: into how many steps the way to each frame is cut."""
    if config.upsample == "off":
        return frames.select("frame").distinct().withColumn("steps", F.lit(1))
    if config.upsample != "adaptive":
        return frames.select("frame").distinct().withColumn("steps", F.lit(max(1, min(int(config.upsample), 4096))))
    w = Window.partitionBy("y", "x").orderBy("frame")
    jump = frames.select("frame", F.abs(lin_log(F.col("luma")) - F.lag(lin_log(F.col("luma"))).over(w)).alias("d"))
    # only the positive threshold counts here
    budget = config.max_events_per_pixel * config.pos_thres
    most = min(config.max_upsample, 4096)
    return jump.groupBy("frame").agg(F.least(F.greatest(F.ceil(F.coalesce(F.max("d"), F.lit(0.0)) / budget), F.lit(1)), F.lit(most)).cast("int").alias("steps"))


_NEVER = -(2**62)
#: Bins of luma that noise is tabulated for, the share of noise at full luma, and the least share of bandwidth.
NOISE_BINS, BRIGHT_NOISE, LEAST_BANDWIDTH = 256, 0.25, 0.1


def _draws(seed: int, x: np.ndarray, y: np.ndarray, step: int, salt: int) -> np.ndarray:
    """A number in [0, 1) for each pixel, by hash: the same in any tile."""
    h = (x.astype(np.uint64) << np.uint64(32)) ^ y.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + step * 0xD1342543DE82EF95 + salt * 0xA24BAED4963EE407) % 2**64)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(33))) >> np.uint64(11)) / float(1 << 53)


class _Pixels:
    """The state of a tile's pixels, in single precision; a step moves any of them at once."""

    def __init__(self, cfg: SimulatorConfig, x: np.ndarray, y: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        self.cfg, self.x, self.y, self.pos, self.neg = cfg, x, y, pos.astype(np.float32), neg.astype(np.float32)
        n = len(x)
        self.low, self.base = np.zeros(n, np.float32), np.zeros(n, np.float32)
        self.t, self.luma, self.last_t, self.started = np.zeros(n, np.int64), np.zeros(n), np.full(n, _NEVER, np.int64), np.zeros(n, bool)
        self.steps, self.out = 0, []

    def frame(self, i: np.ndarray, t: int, luma: np.ndarray, steps: int) -> None:
        """Take a frame's values of the pixels ``i``; the first one a pixel gets sets its state."""
        new = i[~self.started[i]]
        first = luma[~self.started[i]]
        self.low[new] = self.base[new] = lin_log(first).astype(np.float32)
        self.t[new], self.luma[new] = t, first
        old, luma = i[self.started[i]], luma[self.started[i]]
        self.started[new] = True
        t0, l0 = self.t[old], self.luma[old]
        for k in range(1, steps + 1):
            until = np.full(len(old), t) if k == steps else t0 + np.rint((t - t0) * k / steps).astype(np.int64)
            self._step(old, until, l0 + (luma - l0) * k / steps)

    def _step(self, i: np.ndarray, until: np.ndarray, luma: np.ndarray) -> None:
        cfg, start, one = self.cfg, self.t[i], np.float32(1)
        dt = ((until - start) * 1e-6).astype(np.float32)
        target, share = lin_log(luma).astype(np.float32), (luma / 255.0).astype(np.float32)
        if cfg.cutoff_hz > 0:
            band = np.float32(LEAST_BANDWIDTH) + np.float32(1 - LEAST_BANDWIDTH) * share
            way = np.clip(dt * (np.float32(2 * math.pi * cfg.cutoff_hz) * band), 0, 1)
            target = np.where(dt > 0, self.low[i] + way * (target - self.low[i]), target)
        self.low[i] = target
        if cfg.leak_rate_hz > 0:
            self.base[i] -= self.pos[i] * np.float32(cfg.leak_rate_hz) * dt
        delta = target - self.base[i]
        up = delta > 0
        theta, size = np.where(up, self.pos[i], self.neg[i]), np.abs(delta)
        n = np.floor(size / theta).astype(np.int64)
        for k in range(1, int(n.max(initial=0)) + 1):
            some = n >= k
            way = np.minimum(np.float32(k) * theta[some] / size[some], one).astype(float)
            self._fire(i[some], start[some] + ((until - start)[some] * way).astype(np.int64), up[some])
        self.base[i] += np.where(up, one, -one) * n.astype(np.float32) * theta
        if cfg.shot_noise_rate_hz > 0:
            bin_ = np.floor(np.clip(share, 0, 1) * (NOISE_BINS - 1)) / (NOISE_BINS - 1)
            chance = 1 - np.exp(-cfg.shot_noise_rate_hz * (1 - (1 - BRIGHT_NOISE) * bin_) * dt / 2)
            for salt, positive in ((0, True), (2, False)):
                some = (_draws(cfg.seed, self.x[i], self.y[i], self.steps, salt) < chance) & (dt > 0)
                j = i[some]
                part = _draws(cfg.seed, self.x[j], self.y[j], self.steps, salt + 1)
                self._fire(j, start[some] + (part * (until - start)[some]).astype(np.int64), np.full(len(j), positive))
        self.steps += 1
        self.t[i], self.luma[i] = until, luma

    def _fire(self, i: np.ndarray, t: np.ndarray, positive: np.ndarray) -> None:
        ok = t - self.last_t[i] >= self.cfg.refractory_us
        i, t, positive = i[ok], t[ok], positive[ok]
        self.last_t[i] = t
        self.out.append((self.x[i], self.y[i], np.maximum(t, 0), positive))


class Simulator:
    """A simulator for frames that come one by one, from a camera or a renderer; it holds one interval's events.

    ``push`` takes [H, W] luma from 0 to 255 and gives the events since the last
    frame as columns x, y, t, p, in order of (t, y, x, p).  Thresholds are drawn
    from the seed, as in ``simulate``'s, but by another generator.
    """

    def __init__(self, width: int, height: int, config: SimulatorConfig = SimulatorConfig()) -> None:
        self.config, self.width, self.height = config, width, height
        self.reset()

    def reset(self) -> None:
        n, cfg = self.width * self.height, self.config
        at = np.arange(n)
        x, y = at % self.width, at // self.width
        def thresholds(base: float, salt: int) -> np.ndarray:
            gauss = np.sqrt(-2 * np.log(1 - _draws(cfg.seed, x, y, 0, salt))) * np.cos(2 * math.pi * _draws(cfg.seed, x, y, 0, salt + 1))
            return np.maximum(base + gauss * cfg.sigma_thres, max(0.1 * base, 1e-3))

        self.pixels = _Pixels(cfg, x, y, thresholds(cfg.pos_thres, 10), thresholds(cfg.neg_thres, 12))
        self.before: np.ndarray | None = None

    def _steps(self, luma: np.ndarray) -> int:
        cfg = self.config
        if cfg.upsample == "off" or self.before is None:
            return 1
        if cfg.upsample != "adaptive":
            return max(1, min(int(cfg.upsample), 4096))
        jump = np.abs(lin_log(luma) - lin_log(self.before)).max(initial=0.0)
        return max(1, min(math.ceil(jump / (cfg.max_events_per_pixel * cfg.pos_thres)), cfg.max_upsample, 4096))

    def push(self, t: int, luma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        luma = np.asarray(luma, float).ravel()
        if len(luma) != self.width * self.height:
            raise ValueError("the frame isn't of the sensor's size")
        self.pixels.out = []
        self.pixels.frame(np.arange(len(luma)), int(t), luma, self._steps(luma))
        self.before = luma
        if not self.pixels.out:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        x, y, when, p = (np.concatenate(c) for c in zip(*self.pixels.out))
        order = np.lexsort((p, x, y, when))
        return x[order], y[order], when[order], p[order]


def simulate(frames: DataFrame, width: int, height: int, config: SimulatorConfig = SimulatorConfig(), tile: int = 32) -> EventStream:
    """Events of frames given as rows (frame, t in microseconds, y, x, luma from 0 to 255).

    The first frame sets the pixels' state.  Pixels don't depend on each other:
    tiles of ``tile`` pixels run in parallel, whatever the cluster, all pixels of
    one at a time, with noise by a hash of pixel and step.  Times within a frame
    are cut to whole microseconds.  Events are in order of (t, y, x, p).
    """
    steps = substeps(frames, config)
    jobs = frames.join(F.broadcast(steps), "frame")
    jobs = jobs.withColumn("tx", F.expr(f"x div {tile}")).withColumn("ty", F.expr(f"y div {tile}"))
    gauss = F.sqrt(-2 * F.ln(1 - uniform(config.seed, "thres_u", "y", "x"))) * F.cos(uniform(config.seed, "thres_v", "y", "x") * (2 * math.pi))
    floor = lambda v: F.greatest(F.lit(v) + gauss * F.lit(config.sigma_thres), F.lit(max(0.1 * v, 1e-3)))
    jobs = jobs.withColumns({"pos": floor(config.pos_thres), "neg": floor(config.neg_thres)})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "y", "x"])
        code = pdf["y"].to_numpy(np.int64) << 32 | pdf["x"].to_numpy(np.int64)
        codes, first, at = np.unique(code, return_index=True, return_inverse=True)
        pixels = _Pixels(config, codes & 0xFFFFFFFF, codes >> 32, pdf["pos"].to_numpy()[first], pdf["neg"].to_numpy()[first])
        t, luma, steps, frame = (pdf[c].to_numpy() for c in ("t", "luma", "steps", "frame"))
        edges = np.flatnonzero(np.diff(frame, prepend=frame[0] - 1, append=frame[-1] + 1))
        for lo, hi in zip(edges, edges[1:]):
            pixels.frame(at[lo:hi], int(t[lo]), luma[lo:hi].astype(float), int(steps[lo]))
        x, y, when, positive = (np.concatenate(c) for c in zip(*pixels.out)) if pixels.out else (np.zeros(0, int),) * 3 + (np.zeros(0, bool),)
        return pd.DataFrame({"x": x, "y": y, "t": when, "p": positive.astype(bool)})

    made = jobs.groupBy("tx", "ty").applyInPandas(run, "x int, y int, t long, p boolean")
    meta = SensorMeta(width, height)
    # numbered by ranges of time, so no task orders all events
    df = made.withColumn("_bin", F.expr("t div 100000"))
    counts = df.groupBy("_bin").agg(F.count("*").alias("_n"))
    starts = counts.select("_bin", (F.sum("_n").over(Window.orderBy("_bin")) - F.col("_n")).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_bin").orderBy("t", "y", "x", "p")).cast("long") - 1
    df = df.withColumn("_at", within).join(starts, "_bin").withColumn("seq", F.col("_at") + F.col("_start")).select("x", "y", "t", "p", "seq")
    return EventStream(df, meta)
