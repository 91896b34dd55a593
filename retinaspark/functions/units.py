"""Time units: synonyms, conversion to microseconds, inference, and durations given in one of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of time units and their microseconds.
UNITS = {
    "s": 1e6, "sec": 1e6, "secs": 1e6, "second": 1e6, "seconds": 1e6,
    "ms": 1e3, "msec": 1e3, "millisecond": 1e3, "milliseconds": 1e3,
    "us": 1.0, "usec": 1.0, "microsecond": 1.0, "microseconds": 1.0,
    "ns": 1e-3, "nsec": 1e-3, "nanosecond": 1e-3, "nanoseconds": 1e-3,
}


def scale_us(unit: str) -> float:
    """Microseconds of a unit."""
    try:
        return UNITS[unit.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown time unit {unit!r}") from None


def to_us(value: Column, unit: str) -> Column:
    """A column of times in microseconds, rounded half away from zero."""
    return F.round(value.cast("double") * F.lit(scale_us(unit))).cast("long")


def infer_unit(span: float, fractional: bool) -> str:
    """The unit of a recording: seconds if times have fractions, else by how long they run."""
    if fractional or span < 1e3:
        return "s"
    return "ns" if span > 1e11 else "us"


def duration_us(name: str, value=None, **units) -> int | None:
    """One duration given as ``name`` (ms), ``name_s``, ``name_ms``, ``name_us`` or ``name_ns``; None if not given."""
    given = {k: v for k, v in ({f"{name}_ms": value} | {k: v for k, v in units.items() if v is not None}).items() if v is not None}
    if value is not None and f"{name}_ms" in units and units[f"{name}_ms"] is not None:
        raise ValueError(f"{name} is given twice")
    if len(given) > 1:
        raise ValueError(f"{name} is given in several units: {', '.join(given)}")
    if not given:
        return None
    (key, amount), = given.items()
    us = amount * scale_us(key.rsplit("_", 1)[1])
    if us < 0.5:
        raise ValueError(f"{key}={amount} is below half a microsecond")
    return int(us + 0.5)
