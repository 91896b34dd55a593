"""Live streams: windows with a watermark, stateful denoising, a recorder, and pipelines that look back."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, masks, transforms
from ..schema import EVENT_SCHEMA, SensorMeta
from ..stream import EventStream


def with_clock(df: DataFrame, meta: SensorMeta, delay_ms: float) -> DataFrame:
    """Adds ``ts``, the event time, with a watermark; events later than the delay are dropped."""
    ts = F.timestamp_micros(F.round(F.col("t") * F.lit(meta.scale_ms * 1000)).cast("long")).alias("ts")
    return df.select("*", ts).withWatermark("ts", f"{int(delay_ms * 1000)} microseconds")


def _window(dt_ms: float, step_ms: float | None, origin: int = 0):
    """Windows on a grid that goes through ``origin``, in microseconds."""
    us = lambda ms: f"{int(ms * 1000)} microseconds"
    step = step_ms or dt_ms
    return F.window("ts", us(dt_ms), us(step), f"{int(origin) % int(step * 1000)} microseconds")


def live_counts(df: DataFrame, meta: SensorMeta, dt_ms: float, *, step_ms: float | None = None, delay_ms: float | None = None, origin: int = 0) -> DataFrame:
    """Events by pixel and polarity of each window of a streaming DataFrame; windows without events don't appear.

    ``origin``: a time that a window starts at, such as the first event's.
    """
    clocked = with_clock(df, meta, dt_ms if delay_ms is None else delay_ms)
    inside = clocked.where((F.col("x") >= 0) & (F.col("x") < meta.width) & (F.col("y") >= 0) & (F.col("y") < meta.height))
    grouped = inside.groupBy(_window(dt_ms, step_ms, origin).alias("w"), "y", "x", F.when(F.col("p"), 0).otherwise(1).alias("c"))
    return grouped.agg(F.count("*").alias("value")).select(F.unix_micros("w.start").alias("t0"), "c", "y", "x", "value")


def live_rate(df: DataFrame, meta: SensorMeta, bin_ms: float, *, delay_ms: float | None = None) -> DataFrame:
    """t, count, positive, negative and rate of each bin that has events."""
    clocked = with_clock(df, meta, bin_ms if delay_ms is None else delay_ms)
    out = clocked.groupBy(_window(bin_ms, None).alias("w")).agg(F.count("*").alias("count"), F.count_if("p").alias("positive"))
    return out.select(F.unix_micros("w.start").alias("t"), "count", "positive", (F.col("count") - F.col("positive")).alias("negative"), (F.col("count") / F.lit(bin_ms / 1000.0)).alias("rate"))


def live_sessions(df: DataFrame, meta: SensorMeta, gap_ms: float, *, delay_ms: float | None = None) -> DataFrame:
    """Bursts: runs of events of one polarity with no gap of ``gap_ms``."""
    clocked = with_clock(df, meta, gap_ms if delay_ms is None else delay_ms)
    out = clocked.groupBy(F.session_window("ts", f"{int(gap_ms * 1000)} microseconds").alias("w"), "p").agg(F.count("*").alias("count"))
    return out.select(F.unix_micros("w.start").alias("t0"), F.unix_micros("w.end").alias("t1"), "p", "count")


def live_refractory(df: DataFrame, dt: int, refresh: str = "kept") -> DataFrame:
    """The refractory filter over a streaming DataFrame: a pixel's state is the time that restarted its dead time."""
    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["t", "seq"])
        last = state.get[0] if state.exists else None
        keep = []
        for t in rows["t"]:
            ok = last is None or t - last >= dt
            keep.append(ok)
            if ok or refresh == "all":
                last = int(t)
        state.update((last,))
        yield rows.loc[keep, ["x", "y", "t", "p", "seq"]]

    return df.groupBy("x", "y").applyInPandasWithState(run, EVENT_SCHEMA, "last long", "append", "NoTimeout")


def live_count_windows(df: DataFrame, meta: SensorMeta, n: int, *, delay_ms: float = 1000.0) -> DataFrame:
    """Events by pixel and polarity of each window of ``n`` events; ``seq`` numbers the stream's events without gaps.

    A window is told when it is full.
    """
    clocked = with_clock(df, meta, delay_ms).withColumn("window", F.expr(f"seq div {int(n)}"))
    inside = clocked.where((F.col("x") >= 0) & (F.col("x") < meta.width) & (F.col("y") >= 0) & (F.col("y") < meta.height))
    return inside.groupBy("window", "y", "x", F.when(F.col("p"), 0).otherwise(1).alias("c")).agg(F.count("*").alias("value"), F.min("t").alias("t0"), F.max("t").alias("t1"))


def live_background(df: DataFrame, meta: SensorMeta, dt: int, neighbourhood: str = "block", tile: int = 32) -> DataFrame:
    """The background activity filter over a streaming DataFrame.

    Tiles of the sensor are parts of their own, each with the pixels beside it;
    the state is the latest time of each of those pixels.
    """
    offsets = {"block": filters.BLOCK, "cross": filters.CROSS}[neighbourhood]
    side = tile + 2
    reach = lambda c, n: F.sequence(F.greatest(F.expr(f"({c} - 1) div {tile}"), F.lit(0)), F.least(F.expr(f"({c} + 1) div {tile}"), F.lit((n - 1) // tile)))
    spread = df.select("*", F.explode(reach("x", meta.width)).alias("tx")).select("*", F.explode(reach("y", meta.height)).alias("ty"))

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tx, ty = key
        rows = pd.concat(list(parts)).sort_values(["t", "seq"])
        last = np.frombuffer(state.get[0], np.int64).copy() if state.exists else np.full(side * side, -(2**62), np.int64)
        u, v = rows["x"].to_numpy() - tx * tile + 1, rows["y"].to_numpy() - ty * tile + 1
        own = (u >= 1) & (u <= tile) & (v >= 1) & (v <= tile)
        keep = np.zeros(len(rows), bool)
        for i, (a, b, t) in enumerate(zip(u.tolist(), v.tolist(), rows["t"].tolist())):
            if own[i]:
                keep[i] = any(t - last[(b + dy) * side + a + dx] <= dt for dx, dy in offsets)
            last[b * side + a] = t
        state.update((last.tobytes(),))
        yield rows.loc[keep, ["x", "y", "t", "p", "seq"]]

    return spread.groupBy("tx", "ty").applyInPandasWithState(run, EVENT_SCHEMA, "last binary", "append", "NoTimeout")


def hot_pixel_batches(write, folder: str, n_std: float = 3.0):
    """For ``foreachBatch``: counts add up over batches, hot pixels' events go, ``write(batch, number)`` gets the rest.

    The counts are a table below ``folder`` for each batch, a row for each active
    pixel, so that a batch that runs again starts from the one before it.
    """
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = batch.groupBy("x", "y").agg(F.count("*").alias("c"))
        if number > 0:
            now = now.unionByName(spark.read.parquet(f"{folder}/counts-{number - 1}")).groupBy("x", "y").agg(F.sum("c").alias("c"))
        now.write.mode("overwrite").parquet(f"{folder}/counts-{number}")
        counts = spark.read.parquet(f"{folder}/counts-{number}")
        bar = counts.agg((F.avg("c") + F.lit(float(n_std)) * F.stddev_pop("c")).alias("bar"))
        hot = counts.join(F.broadcast(bar), F.lit(True)).where("c > bar").select("x", "y")
        write(batch.join(hot, ["x", "y"], "left_anti"), number)

    return run


def record(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Write every micro-batch of a streaming DataFrame to Parquet; exactly once by its checkpoint."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Processor:
    """A filter for windows that come one by one; ``lookback`` says how far back it must see."""

    lookback = 0

    def process(self, window: tuple[int, int], stream: EventStream) -> EventStream:
        raise NotImplementedError

    def reset(self) -> None:
        """Forget what was seen."""


class _WithHistory(Processor):
    def __init__(self, lookback: int) -> None:
        self.lookback, self.history = int(lookback), None

    def filtered(self, stream: EventStream) -> EventStream:
        raise NotImplementedError

    def process(self, window, stream):
        t0, t1 = window
        both = stream if self.history is None else stream.with_(self.history.df.unionByName(stream.df))
        self.history = transforms.time_window(both, t1 - self.lookback, t1)
        return transforms.time_window(self.filtered(both), t0, t1)

    def reset(self) -> None:
        self.history = None


class BackgroundProcessor(_WithHistory):
    def __init__(self, dt: int, neighbourhood: str = "block") -> None:
        super().__init__(dt)
        self.neighbourhood = neighbourhood

    def filtered(self, stream):
        return filters.background_activity_filter(stream, self.lookback, self.neighbourhood)


class RefractoryProcessor(_WithHistory):
    def __init__(self, dt: int, refresh: str = "kept") -> None:
        super().__init__(dt)
        self.refresh = refresh

    def filtered(self, stream):
        return filters.refractory_filter(stream, self.lookback, self.refresh)


class HotPixelProcessor(Processor):
    """Counts add up over windows; the present one is counted before it is judged."""

    def __init__(self, n_std: float = 3.0) -> None:
        self.n_std, self.counts = n_std, None

    def process(self, window, stream):
        now = stream.df.groupBy("x", "y").agg(F.count("*").alias("c"))
        self.counts = now if self.counts is None else self.counts.unionByName(now).groupBy("x", "y").agg(F.sum("c").alias("c"))
        if self.counts.sparkSession.sparkContext.getCheckpointDir():
            # else the plan would grow with every window
            self.counts = self.counts.checkpoint()
        bar = self.counts.agg((F.avg("c") + F.lit(float(self.n_std)) * F.stddev_pop("c")).alias("bar"))
        hot = self.counts.join(F.broadcast(bar), F.lit(True)).where("c > bar")
        return masks.drop_masked_pixels(stream, hot)

    def reset(self) -> None:
        self.counts = None


class Pipeline:
    """Processors one after the other."""

    def __init__(self, processors: list[Processor]) -> None:
        self.processors = processors

    @property
    def lookback(self) -> int:
        return sum(p.lookback for p in self.processors)

    def process(self, window: tuple[int, int], stream: EventStream) -> EventStream:
        return reduce(lambda s, p: p.process(window, s), self.processors, stream)

    def reset(self) -> None:
        for p in self.processors:
            p.reset()


@dataclass(frozen=True)
class BiasConfig:
    """Rates to keep between, steps of the two controls, and their bounds."""

    low_rate: float = 1e5
    high_rate: float = 1e6
    refractory: tuple[float, float] = (0.0, 1.0)
    threshold: tuple[float, float] = (0.0, 1.0)
    fast_step: float = 0.1
    slow_step: float = 0.02
    patience: int = 5


@dataclass(frozen=True)
class BiasState:
    refractory: float = 0.0
    threshold: float = 0.5
    above: int = 0
    below: int = 0
    turns: int = 0
    state: str = "settled"


def bias_step(config: BiasConfig, s: BiasState, rate: float) -> BiasState:
    """One step of the control: the refractory period answers at once, the thresholds after ``patience`` windows."""
    clip = lambda v, b: min(max(v, b[0]), b[1])
    if config.low_rate <= rate <= config.high_rate:
        return replace(s, above=0, below=0, state="settled")
    up = rate > config.high_rate
    turned = (s.below > 0 and up) or (s.above > 0 and not up)
    above, below = (s.above + 1, 0) if up else (0, s.below + 1)
    refractory = clip(s.refractory + (config.fast_step if up else -config.fast_step), config.refractory)
    threshold = s.threshold
    if max(above, below) % config.patience == 0:
        threshold = clip(threshold + (config.slow_step if up else -config.slow_step), config.threshold)
    turns = s.turns + turned
    railed = (refractory, threshold) == ((config.refractory[1], config.threshold[1]) if up else (config.refractory[0], config.threshold[0]))
    return BiasState(refractory, threshold, above, below, turns, "railed" if railed else "hunting" if turns > 2 else "adjusting")


def bias_series(rates: DataFrame, config: BiasConfig = BiasConfig()) -> DataFrame:
    """The control's states over a rate table (t, rate); one short row a window, folded in order."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, rows = BiasState(), []
        for t, rate in pdf.sort_values("t")[["t", "rate"]].itertuples(index=False):
            s = bias_step(config, s, rate)
            rows.append((t, s.refractory, s.threshold, s.state))
        return pd.DataFrame(rows, columns=["t", "refractory", "threshold", "state"])

    return rates.select("t", "rate").groupBy(F.lit("all")).applyInPandas(run, "t long, refractory double, threshold double, state string")
