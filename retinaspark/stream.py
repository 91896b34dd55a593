"""Event streams: a DataFrame of events, its sensor, and the columns that part it into slices."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .schema import SensorMeta


@dataclass(frozen=True)
class EventStream:
    """Events in ``df`` (x, y, t, p, seq and the ``keys``); each combination of keys is a stream of its own."""

    df: DataFrame
    meta: SensorMeta
    keys: tuple[str, ...] = ()

    def with_(self, df: DataFrame | None = None, **meta) -> "EventStream":
        return replace(self, df=self.df if df is None else df, meta=replace(self.meta, **meta) if meta else self.meta)

    @property
    def columns(self) -> list[str]:
        return ["x", "y", "t", "p", "seq", *self.keys]

    @property
    def sensor_size(self) -> tuple[int, int]:
        return self.meta.width, self.meta.height

    def over(self, *more: str) -> Window:
        """A window over each slice, and ``more``."""
        return Window.partitionBy(*self.keys, *more)

    def in_order(self, *more: str) -> Window:
        return self.over(*more).orderBy("seq")

    def mapped(self, width: int | None = None, height: int | None = None, keep: Column | None = None, **columns: Column) -> "EventStream":
        """Replace columns at once, then drop events off the sensor if its size is given."""
        df = self.df.select(*[columns.get(c, F.col(c)).alias(c) for c in self.columns])
        if keep is not None:
            df = df.where(keep)
        if width is None:
            return self.with_(df)
        inside = (F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)
        return self.with_(df.where(inside), width=int(width), height=int(height))

    def n_events(self) -> int:
        return self.df.count()

    def __len__(self) -> int:
        return self.n_events()

    def stats(self) -> DataFrame:
        """Number of events, first and last time, duration and mean rate of each slice."""
        out = self.df.groupBy(*self.keys).agg(F.count("*").alias("n_events"), F.min("t").alias("t_min"), F.max("t").alias("t_max"))
        ms = (F.col("t_max") - F.col("t_min")) * F.lit(self.meta.scale_ms)
        return out.withColumn("duration_ms", ms).withColumn("mean_rate", F.when(ms > 0, F.col("n_events") / (ms / 1000.0)))

    def time_span(self) -> tuple[int, int] | None:
        r = self.df.agg(F.min("t"), F.max("t")).first()
        return None if r[0] is None else (r[0], r[1])

    def numpy(self):
        """(N, 4) array of x, y, t, p in stream order; for small streams."""
        import numpy as np

        rows = self.df.orderBy("seq").select("x", "y", "t", F.col("p").cast("int")).toPandas()
        return rows.to_numpy(np.int64)
