"""Sensors' settings for control of the event rate: what a recording was, or is to be, taken with."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Preset:
    """A measuring period, the wanted band of events a second, and the bounds and steps of biases.

    ``calibrate``: periods that measure the scene first, to put the band about
    what it gives; 0 takes ``target_rate`` as it is.
    """

    period_ms: float
    target_rate: tuple[float, float]
    calibrate: int
    throttle_range: tuple[int, int]
    max_slew: int
    patience: int
    step: int
    photoreceptor: tuple[int, int]
    follower: tuple[int, int]
    on_threshold: tuple[int, int]
    off_threshold: tuple[int, int]

    def check(self) -> "Preset":
        low, high = self.target_rate
        if not (math.isfinite(low) and math.isfinite(high) and 0 <= low < high):
            raise ValueError("target_rate is (low, high), from 0 on, low below high")
        if self.period_ms <= 0 or self.max_slew < 1:
            raise ValueError("period_ms is above zero, max_slew at least 1")
        for name in ("throttle_range", "photoreceptor", "follower", "on_threshold", "off_threshold"):
            if getattr(self, name)[0] > getattr(self, name)[1]:
                raise ValueError(f"{name} is (low, high)")
        return self

    def changed(self, **changes) -> "Preset":
        """With other values; a band that is given is not measured, unless ``calibrate`` is given too."""
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise TypeError(f"unknown settings: {', '.join(sorted(unknown))}")
        given = {k: v for k, v in changes.items() if v is not None}
        if "target_rate" in given:
            given.setdefault("calibrate", 0)
        return replace(self, **given).check()


_LADDER = (0, 2040)
# The settings of two sensors.
PRESETS = {
    "davis346": Preset(300, (5e5, 2.5e6), 4, (801, 1084), 16, 2, 6, _LADDER, _LADDER, _LADDER, _LADDER),
    "evk4": Preset(300, (5e6, 2.5e7), 4, (0, 235), 12, 2, 2, (60, 160), (55, 130), (83, 140), (35, 76)),
}


def preset(sensor: str, **changes) -> Preset:
    """A sensor's settings, with changes."""
    try:
        return PRESETS[sensor].changed(**changes)
    except KeyError:
        raise ValueError(f"no settings for {sensor!r}; there are {', '.join(PRESETS)}") from None
