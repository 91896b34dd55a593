"""Pinhole cameras with Brown-Conrady distortion."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Fixed-point steps of undistortion.
STEPS = 20


@dataclass(frozen=True)
class Camera:
    fx: float
    fy: float
    cx: float
    cy: float
    k1: float = 0.0
    k2: float = 0.0
    p1: float = 0.0
    p2: float = 0.0
    k3: float = 0.0

    @property
    def distortion(self) -> tuple[float, ...]:
        return self.k1, self.k2, self.p1, self.p2, self.k3

    def _bend(self, x, y):
        r2 = x * x + y * y
        radial = 1 + r2 * (self.k1 + r2 * (self.k2 + r2 * self.k3))
        dx = 2 * self.p1 * x * y + self.p2 * (r2 + 2 * x * x)
        dy = self.p1 * (r2 + 2 * y * y) + 2 * self.p2 * x * y
        return radial, dx, dy

    def distort_point(self, u, v):
        """Where an ideal pixel lands in the distorted image."""
        x, y = (np.asarray(u, float) - self.cx) / self.fx, (np.asarray(v, float) - self.cy) / self.fy
        radial, dx, dy = self._bend(x, y)
        return (x * radial + dx) * self.fx + self.cx, (y * radial + dy) * self.fy + self.cy

    def undistort_point(self, u, v):
        """The ideal pixel of a distorted one, by fixed-point steps."""
        x0, y0 = (np.asarray(u, float) - self.cx) / self.fx, (np.asarray(v, float) - self.cy) / self.fy
        x, y = x0, y0
        for _ in range(STEPS):
            radial, dx, dy = self._bend(x, y)
            x, y = (x0 - dx) / radial, (y0 - dy) / radial
        return x * self.fx + self.cx, y * self.fy + self.cy

    def table(self, width: int, height: int) -> list[tuple[int, int, int, int]]:
        """(x, y, new x, new y) of the pixels that stay on the sensor; the size of the sensor at most."""
        ys, xs = np.mgrid[0:height, 0:width]
        u, v = self.undistort_point(xs, ys)
        u, v = (np.sign(a) * np.floor(np.abs(a) + 0.5) for a in (u, v))
        ok = np.isfinite(u) & np.isfinite(v) & (u >= 0) & (u < width) & (v >= 0) & (v < height)
        return [tuple(map(int, r)) for r in np.column_stack([xs[ok], ys[ok], u[ok], v[ok]])]
