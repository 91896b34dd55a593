"""Frames to frames: filling, resizing, labels, blobs, batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .represent import Frame

#: Cells of a dense result that are made at most, unless the caller says otherwise.
MOST_CELLS = 1 << 28


def _slices(f: Frame) -> DataFrame:
    return f.df.select(*f.keys).distinct() if f.keys else f.df.sparkSession.range(1).select()


def _replaced(f: Frame, df: DataFrame, **changes) -> Frame:
    from dataclasses import replace

    return replace(f, df=df, **changes)


def filled(f: Frame, value: float = 0) -> Frame:
    """All cells of the frames that have any, those that weren't there at ``value``."""
    c, h, w = f.shape
    n = c * h * w
    cells = _slices(f).select(*f.keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")) if n else f.df.select(*f.keys, F.lit(0).alias("i")).limit(0)
    cells = cells.select(*f.keys, F.expr(f"i div {max(1, h * w)}").cast("int").alias("c"), F.expr(f"(i % {max(1, h * w)}) div {max(1, w)}").cast("int").alias("y"), (F.col("i") % max(1, w)).cast("int").alias("x"))
    joined = cells.join(f.df, [*f.keys, "c", "y", "x"], "left")
    return _replaced(f, joined.select(*f.keys, "c", "y", "x", F.coalesce("value", F.lit(value)).cast(f.df.schema["value"].dataType).alias("value")))


def dense(f: Frame, most_cells: int = MOST_CELLS) -> DataFrame:
    """One row for each frame, with its cells in an array in [c, y, x] order."""
    c, h, w = f.shape
    if c * h * w > most_cells:
        raise ValueError(f"a frame of {c * h * w} cells is above {most_cells}")
    zero = F.array_repeat(F.lit(0).cast(f.df.schema["value"].dataType), c * h * w)
    at = (F.col("c") * (h * w) + F.col("y") * w + F.col("x")).alias("i")
    rows = f.df.select(*f.keys, at, "value").groupBy(*f.keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("m"))
    return rows.select(*f.keys, F.transform(zero, lambda v, i: F.coalesce(F.element_at("m", i), v)).alias("data"))


def numpy(f: Frame) -> np.ndarray:
    """[C, H, W] array of a single frame, or of all frames with one key stacked in its order."""
    kind = {"u8": np.uint8, "u16": np.uint16, "u64": np.uint64, "f32": np.float32}[f.dtype]
    pdf = f.df.toPandas()
    if not f.keys:
        out = np.zeros(f.shape, kind)
        out[pdf["c"], pdf["y"], pdf["x"]] = pdf["value"]
        return out
    groups = sorted(pdf.groupby(list(f.keys)), key=lambda g: g[0])
    if len(groups) * int(np.prod(f.shape)) > MOST_CELLS:
        raise ValueError("too many cells for one array")
    out = np.zeros((len(groups), *f.shape), kind)
    for n, (_, g) in enumerate(groups):
        out[n, g["c"], g["y"], g["x"]] = g["value"]
    return out


def collate(frames: list[Frame], key: str = "batch") -> Frame:
    """Frames of one shape as one batch, numbered in order."""
    if not frames:
        raise ValueError("there are no frames")
    if len({f.shape for f in frames}) > 1:
        raise ValueError("the frames' shapes differ")
    df = None
    for i, f in enumerate(frames):
        part = f.df.select(F.lit(i).alias(key), "c", "y", "x", "value")
        df = part if df is None else df.unionByName(part)
    return _replaced(frames[0], df, keys=(key,))


def _weights(old: int, new: int, pooling: str) -> list[tuple[int, int, float]]:
    """(old place, new place, weight) along one axis."""
    out = []
    if new <= old:
        for j in range(new):
            lo, hi = -(-j * old // new), -(-(j + 1) * old // new)
            for i in range(lo, hi):
                out.append((i, j, 1.0 if pooling == "sum" else 1.0 / (hi - lo)))
        return out
    for j in range(new):
        at = min(max((j + 0.5) * old / new - 0.5, 0.0), old - 1.0)
        lo = int(math.floor(at))
        part = at - lo
        out.append((lo, j, 1.0 - part))
        if part > 0:
            out.append((min(lo + 1, old - 1), j, part))
    return out


def resize(f: Frame, width: int, height: int, pooling: str = "average") -> Frame:
    """Shrink by the mean (or sum) of each new cell's bin, grow by linear interpolation."""
    if pooling not in ("average", "sum"):
        raise ValueError("pooling is 'average' or 'sum'")
    if width <= 0 or height <= 0:
        raise ValueError("a frame needs an extent")
    spark = f.df.sparkSession
    # tables of a few entries for each row and column of the frame
    wx = spark.createDataFrame(_weights(f.width, width, pooling), "x int, nx int, wx double")
    wy = spark.createDataFrame(_weights(f.height, height, pooling), "y int, ny int, wy double")
    cells = f.df.join(F.broadcast(wx), "x").join(F.broadcast(wy), "y")
    out = cells.groupBy(*f.keys, "c", F.col("ny").alias("y"), F.col("nx").alias("x")).agg(F.sum(F.col("value") * F.col("wx") * F.col("wy")).alias("value"))
    whole = f.dtype != "f32"
    dtype = ("u64" if whole else "f32") if pooling == "sum" else f.dtype
    kind = {"u8": "int", "u16": "int", "u64": "long", "f32": "float"}[dtype]
    value = F.round(F.round("value", 9)) if whole else F.col("value")
    out = out.select(*f.keys, "c", "y", "x", value.cast(kind).alias("value"))
    return _replaced(f, out.where("value <> 0"), width=width, height=height, dtype=dtype)


def connected_components(f: Frame, connectivity: int = 8) -> Frame:
    """Labels from 1 on of the connected cells with any channel not zero, in scan order of their first pixel.

    A frame is one group: its size is the sensor's, whatever the stream's.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    keys, near = list(f.keys), [(-1, 0), (0, -1)] + [(-1, -1), (-1, 1)] * (connectivity == 8)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pixels = sorted(set(zip(pdf["y"].tolist(), pdf["x"].tolist())))
        root = {p: p for p in pixels}

        def find(p):
            while root[p] != p:
                root[p] = root[root[p]]
                p = root[p]
            return p

        for y, x in pixels:
            for dy, dx in near:
                q = (y + dy, x + dx)
                if q in root:
                    a, b = find((y, x)), find(q)
                    root[max(a, b)] = min(a, b)
        number, rows = {}, []
        for p in pixels:
            r = find(p)
            rows.append((number.setdefault(r, len(number) + 1), *p))
        out = pd.DataFrame(rows, columns=["value", "y", "x"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        out["c"] = 0
        return out[[*keys, "c", "y", "x", "value"]]

    schema = f.df.select(*keys, "c", "y", "x", F.lit(0).cast("long").alias("value")).schema
    on = f.df.where("value <> 0")
    grouped = on.groupBy(*keys) if keys else on.groupBy(F.lit("all"))
    return _replaced(f, grouped.applyInPandas(label, schema), kind="labels", channels=("labels",), dtype="u64")


def blobs(f: Frame, connectivity: int = 8, min_area: int = 1) -> DataFrame:
    """label, cx, cy, x0, y0, x1, y1 (inclusive) and area of each component of at least ``min_area`` pixels."""
    labels = f if f.kind == "labels" else connected_components(f, connectivity)
    out = labels.df.groupBy(*f.keys, F.col("value").alias("label")).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("area"))
    return out.where(F.col("area") >= min_area)
