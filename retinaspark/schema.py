"""The event table's schema and its sensor's description."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

#: x and y in pixels, t in microseconds, p true for ON, seq the place in the stream.
EVENT_SCHEMA = StructType([
    StructField("x", IntegerType()),
    StructField("y", IntegerType()),
    StructField("t", LongType()),
    StructField("p", BooleanType()),
    StructField("seq", LongType()),
])

#: What ``window_ms`` and the like are if neither they nor a slice's length are given.
DEFAULT_SPAN_MS = 30.0


@dataclass(frozen=True)
class SensorMeta:
    """Sensor size, milliseconds of a time unit, and the slices' length if there is one."""

    width: int
    height: int
    scale_ms: float = 0.001
    span_ms: float | None = None

    def resized(self, width: int, height: int) -> "SensorMeta":
        return replace(self, width=int(width), height=int(height))

    def span(self, given: float | None = None) -> float:
        if given is not None:
            return float(given)
        return float(self.span_ms) if self.span_ms is not None else DEFAULT_SPAN_MS

    def ticks(self, ms: float) -> float:
        """Milliseconds in time units."""
        return ms / self.scale_ms
