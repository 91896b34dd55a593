"""ONNX models over frames: batch inference, and recurrent models that carry state from slice to slice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames
from .represent import Frame

_sessions: dict = {}


def _session(path: str):
    """One session for each worker and model file."""
    if path not in _sessions:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        _sessions[path] = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
    return _sessions[path]


class Model:
    """A model with one frame in and one array out; the file must be where every executor can read it."""

    def __init__(self, path: str) -> None:
        self.path = path

    @property
    def inputs(self) -> list[tuple[str, list]]:
        return [(i.name, i.shape) for i in _session(self.path).get_inputs()]

    @property
    def outputs(self) -> list[tuple[str, list]]:
        return [(o.name, o.shape) for o in _session(self.path).get_outputs()]

    def __call__(self, array: np.ndarray) -> np.ndarray:
        s = _session(self.path)
        return s.run(None, {s.get_inputs()[0].name: np.asarray(array, np.float32)})[0]

    def run_named(self, feeds: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        s = _session(self.path)
        return dict(zip((o.name for o in s.get_outputs()), s.run(None, {k: np.asarray(v, np.float32) for k, v in feeds.items()})))

    def over(self, f: Frame, batch: int = 16) -> DataFrame:
        """keys and ``output`` (flat) of every frame."""
        path, shape, keys = self.path, f.shape, list(f.keys)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = Model(path)
            for pdf in parts:
                for lo in range(0, len(pdf), batch):
                    piece = pdf.iloc[lo: lo + batch]
                    data = np.stack([np.asarray(d, np.float32).reshape(shape) for d in piece["data"]])
                    yield piece[keys].assign(output=[o.ravel().tolist() for o in model(data)])

        rows = frames.dense(f)
        schema = rows.select(*keys, F.array(F.lit(0.0)).alias("output")).schema
        return rows.mapInPandas(run, schema)


class StatefulModel:
    """A model whose outputs feed inputs of its next step: ``state_map`` is output name to input name."""

    def __init__(self, path: str, state_map: dict[str, str]) -> None:
        self.model, self.state_map, self.state = Model(path), dict(state_map), {}

    def reset(self) -> None:
        self.state = {}

    def __call__(self, data: np.ndarray) -> dict[str, np.ndarray]:
        feeds = {}
        for name, shape in self.model.inputs:
            if name in self.state_map.values():
                feeds[name] = self.state.get(name, np.zeros([d if isinstance(d, int) else 1 for d in shape], np.float32))
            else:
                feeds[name] = data
        out = self.model.run_named(feeds)
        self.state = {i: out[o] for o, i in self.state_map.items()}
        return {k: v for k, v in out.items() if k not in self.state_map}

    def over(self, f: Frame, order: str = "slice_id") -> DataFrame:
        """The first output of every frame, frames taken by ``order``; other keys part independent states."""
        path, state_map, shape = self.model.path, self.state_map, f.shape
        rest = [k for k in f.keys if k != order]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            model, out = StatefulModel(path, state_map), []
            pdf = pdf.sort_values(order)
            for d in pdf["data"]:
                out.append(next(iter(model(np.asarray(d, np.float32).reshape(1, *shape)).values())).ravel().tolist())
            return pdf[[*rest, order]].assign(output=out)

        rows = frames.dense(f)
        schema = rows.select(*rest, order, F.array(F.lit(0.0)).alias("output")).schema
        grouped = rows.groupBy(*rest) if rest else rows.groupBy(F.lit("all"))
        return grouped.applyInPandas(run, schema)


def normalized_bins(f: Frame) -> Frame:
    """A voxel grid with mean 0 and deviation 1 over its cells that aren't zero, as reconstruction networks want it."""
    on = f.df.where("value <> 0")
    told = on.groupBy(*f.keys).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    joined = on.join(F.broadcast(told), list(f.keys)) if f.keys else on.join(F.broadcast(told), F.lit(True))
    value = F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s")).otherwise(F.col("value") - F.col("_m"))
    from dataclasses import replace

    return replace(f, df=joined.select(*f.keys, "c", "y", "x", value.cast("float").alias("value")))
