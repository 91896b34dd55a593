"""Optical flow, images of warped events, contrast maximisation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.camera import Camera
from ..stream import EventStream
from .represent import Frame, _frame, register

# When a flow is full, when its direction alone is known, when there is none; the largest exponent of "soe".
FULL_DET, COHERENT, NO_TRACE, MOST_EXPONENT = 1e-3, 0.35, 1e-12, 32.0
# The blur before each objective.
BLUR = {"variance": 1.0, "sos": 1.0, "soe": 2.5}


def optical_flow(s: EventStream, window: int = 3) -> Frame:
    """Pixels per millisecond by least squares on the surface of latest times.

    Where gradients have one direction only, the flow is along their mean, if
    they agree: |sum|^2 is at least ``COHERENT`` of n times the sum of squares.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    keys = list(s.keys)
    surface = s.df.groupBy(*keys, "y", "x").agg((F.max("t") * F.lit(s.meta.scale_ms)).alias("v"))

    def beside(dx: int, dy: int, name: str) -> DataFrame:
        return surface.select(*keys, (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col("v").alias(name))

    on = [*keys, "y", "x"]
    g = surface.join(beside(1, 0, "e"), on).join(beside(-1, 0, "w"), on).join(beside(0, 1, "s"), on).join(beside(0, -1, "n"), on)
    g = g.select(*on, ((F.col("e") - F.col("w")) / 2).alias("gx"), ((F.col("s") - F.col("n")) / 2).alias("gy"))
    shift = lambda: F.explode(F.sequence(F.lit(-window), F.lit(window)))
    spread = g.select("*", shift().alias("dx")).select("*", shift().alias("dy")).select(*keys, (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "gx", "gy")
    sums = spread.groupBy(*on).agg(F.sum(F.col("gx") * F.col("gx")).alias("a"), F.sum(F.col("gx") * F.col("gy")).alias("b"), F.sum(F.col("gy") * F.col("gy")).alias("c"), F.sum("gx").alias("u"), F.sum("gy").alias("w"), F.count("*").alias("n"))
    sums = sums.join(surface.select(*on), on, "left_semi")
    a, b, c, u, w, n = (F.col(k) for k in "abcuwn")
    tr, det = a + c, a * c - b * b
    # the plane t = gx x + gy y moves by one pixel each gradient milliseconds
    full = det > F.lit(FULL_DET) * tr * tr
    coherent = (u * u + w * w) / (n * tr) >= F.lit(COHERENT)
    mx, my = u / n, w / n
    norm = F.nullif(mx * mx + my * my, F.lit(0.0))
    fx = F.when(full, (c * u - b * w) / F.nullif(det, F.lit(0.0))).when(coherent, mx / norm)
    fy = F.when(full, (a * w - b * u) / F.nullif(det, F.lit(0.0))).when(coherent, my / norm)
    rows = sums.where(tr > NO_TRACE).select(*on, fx.alias("fx"), fy.alias("fy")).where("fx is not null and fy is not null")
    cells = rows.select(*on, F.explode(F.array(F.struct(F.lit(0).alias("c"), F.col("fx").alias("value")), F.struct(F.lit(1).alias("c"), F.col("fy").alias("value")))).alias("q")).select(*on, "q.c", "q.value")
    return _frame(s, cells, "flow", ["flow_x", "flow_y"], "f32")


def _warp(x, y, dt, params, model: str, camera: Camera | None, m):
    """Pixels moved back by ``dt`` seconds; works on arrays and on columns."""
    if model == "translation":
        return x - dt * params[0], y - dt * params[1]
    if model != "rotation":
        raise ValueError("model is 'translation' or 'rotation'")
    if camera is None:
        raise ValueError("rotation needs a camera")
    wx, wy, wz = params
    u, v = (x - camera.cx) / camera.fx, (y - camera.cy) / camera.fy
    du = u * v * wx - (1 + u * u) * wy + v * wz
    dv = (1 + v * v) * wx - u * v * wy - u * wz
    return (u - dt * du) * camera.fx + camera.cx, (v - dt * dv) * camera.fy + camera.cy


def iwe(s: EventStream, params, model: str = "translation", camera: Camera | None = None, time_reference: str = "midpoint") -> Frame:
    """Events moved along their motion to one time, spread over the four pixels around."""
    bounds = s.df.groupBy(*s.keys).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    df = s.df.join(F.broadcast(bounds), list(s.keys)) if s.keys else s.df.join(F.broadcast(bounds), F.lit(True))
    ref = {"midpoint": (F.col("t0") + F.col("t1")) / 2.0, "start": F.col("t0"), "end": F.col("t1")}[time_reference]
    dt = (F.col("t") - ref) * F.lit(s.meta.scale_ms / 1000.0)
    u, v = _warp(F.col("x").cast("double"), F.col("y").cast("double"), dt, [F.lit(float(p)) for p in params], model, camera, F)
    moved = df.select(*s.keys, u.alias("u"), v.alias("v")).withColumns({"x": F.floor("u"), "y": F.floor("v")}).withColumns({"a": F.col("u") - F.col("x"), "b": F.col("v") - F.col("y")})
    a, b = F.col("a"), F.col("b")
    votes = F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y"), (wa * wb).alias("w")) for i, wa in ((0, 1 - a), (1, a)) for j, wb in ((0, 1 - b), (1, b))])
    w, h = s.sensor_size
    cells = moved.select(*s.keys, F.explode(votes).alias("q")).select(*s.keys, "q.x", "q.y", "q.w").where((F.col("w") > 0) & (F.col("x") >= 0) & (F.col("x") < w) & (F.col("y") >= 0) & (F.col("y") < h))
    return _frame(s, cells.groupBy(*s.keys, "y", "x").agg(F.sum("w").alias("value")).withColumn("c", F.lit(0)), "intensity", ["intensity"], "f32")


def _image(x, y, dt, params, model, camera, shape):
    h, w = shape
    u, v = _warp(x, y, dt, params, model, camera, np)
    i, j = np.floor(u), np.floor(v)
    a, b = u - i, v - j
    out = np.zeros(h * w)
    for di, wa in ((0, 1 - a), (1, a)):
        for dj, wb in ((0, 1 - b), (1, b)):
            ii, jj = i + di, j + dj
            ok = (ii >= 0) & (ii < w) & (jj >= 0) & (jj < h)
            out += np.bincount((jj[ok] * w + ii[ok]).astype(np.int64), weights=(wa * wb)[ok], minlength=h * w)
    return out.reshape(h, w)


def gaussian_blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur with the edge's values beyond it."""
    if sigma <= 0:
        return image
    r = min(max(math.ceil(3 * sigma), 1), 32)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = np.pad(image, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        image = sum(w * np.take(pad, range(i, i + image.shape[axis]), axis) for i, w in enumerate(k))
    return image


def contrast(image: np.ndarray, objective: str) -> float:
    if objective == "variance":
        return float(image.var())
    if objective == "sos":
        return float((image * image).mean())
    if objective == "soe":
        return float(np.exp(np.minimum(image, MOST_EXPONENT)).mean())
    raise ValueError("objective is 'variance', 'sos' or 'soe'")


def nelder_mead(f, start, step: float, iterations: int, tolerance: float):
    """The place and value of a smallest value of ``f``, and the iterations taken."""
    n = len(start)
    points = [np.array(start, float)]
    for i in range(n):
        p = points[0].copy()
        p[i] += step
        points.append(p)
    values = [f(p) for p in points]
    for it in range(iterations):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if max(np.abs(p - points[0]).max() for p in points[1:]) < tolerance:
            return points[0], values[0], it
        centre, worst = np.mean(points[:-1], axis=0), points[-1]
        reflected = 2 * centre - worst
        fr = f(reflected)
        if fr < values[0]:
            further = 3 * centre - 2 * worst
            fe = f(further)
            points[-1], values[-1] = (further, fe) if fe < fr else (reflected, fr)
        elif fr < values[-2]:
            points[-1], values[-1] = reflected, fr
        else:
            inner = 0.5 * (centre + (reflected if fr < values[-1] else worst))
            fi = f(inner)
            if fi < min(fr, values[-1]):
                points[-1], values[-1] = inner, fi
            else:
                points = [points[0]] + [(p + points[0]) / 2 for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    k = int(np.argmin(values))
    return points[k], values[k], iterations


def contrast_maximise(s: EventStream, model: str = "translation", objective: str = "variance", camera: Camera | None = None, blur_sigma: float | None = None, initial=None, initial_step: float = 50.0, max_iterations: int = 200, tolerance: float = 1e-3, time_reference: str = "midpoint") -> DataFrame:
    """params, score, score_at_rest, improvement, iterations of each slice: one optimiser a slice, slices in parallel.

    ``blur_sigma``: 1, or 2.5 for "soe", if not given.  A slice is a group, so it
    has to be a window of a recording, not all of it.
    """
    blur = BLUR.get(objective, 1.0) if blur_sigma is None else blur_sigma
    keys = list(s.keys)
    n = 2 if model == "translation" else 3
    shape, unit = (s.meta.height, s.meta.width), s.meta.scale_ms / 1000.0
    start = [0.0] * n if initial is None else [float(v) for v in initial]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf["t"].to_numpy(float)
        ref = {"midpoint": (t.min() + t.max()) / 2, "start": t.min(), "end": t.max()}[time_reference]
        x, y, dt = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), (t - ref) * unit

        def score(p):
            return contrast(gaussian_blur(_image(x, y, dt, p, model, camera, shape), blur), objective)

        best, value, its = nelder_mead(lambda p: -score(p), start, initial_step, max_iterations, tolerance)
        rest = score([0.0] * n)
        row = {k: pdf[k].iloc[0] for k in keys} | {"params": [float(v) for v in best], "score": -value, "score_at_rest": rest, "improvement": -value / rest if rest else 1.0, "iterations": its}
        return pd.DataFrame([row])

    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in s.df.select(*keys).schema) if keys else ""
    grouped = s.df.groupBy(*keys) if keys else s.df.groupBy(F.lit("all"))
    return grouped.applyInPandas(run, head + "params array<double>, score double, score_at_rest double, improvement double, iterations int")


register("flow", optical_flow)
