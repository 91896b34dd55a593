"""Features learned from time surfaces by competing units."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stream import EventStream
from .around import BLOCK, Around, around_events, gathered

#: An event that waits for the fold, and how many go together.
EVENT, PACKET = np.dtype([("x", "<i4"), ("y", "<i4"), ("t", "<i8")]), 256


@dataclass
class FEAST:
    """Learns ``n_features`` units a polarity; each event's patch goes to the nearest unit within its threshold.

    A unit that takes a patch moves towards it and draws its threshold in; when
    none does, all thresholds widen.  Learning is one fold over the stream of each bank.
    """

    n_features: int = 100
    patch: int = 11
    tau_ms: float = 30.0
    eta: float = 1e-3
    delta_i: float = 1e-3
    delta_e: float = 3e-3
    per_polarity: bool = True
    seed: int = 0
    weights: np.ndarray | None = None
    thresholds: np.ndarray | None = None
    missed_rate: float = field(default=float("nan"))

    def __post_init__(self) -> None:
        if self.patch % 2 == 0:
            raise ValueError("patch must be odd")

    def get_params(self) -> dict:
        return {k: getattr(self, k) for k in ("n_features", "patch", "tau_ms", "eta", "delta_i", "delta_e", "per_polarity", "seed")}

    @property
    def banks(self) -> int:
        return 2 if self.per_polarity else 1

    @property
    def _bank(self) -> Column:
        return F.when(F.col("p"), 0).otherwise(1) if self.per_polarity else F.lit(0)

    def _patches(self, a: Around, size: tuple[int, int], scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, patches) of own events that have a whole one, some at a time; not yet of unit length."""
        r = self.patch // 2
        for at in a.pieces(a.timed & a.inside(r, size)):
            now, v = a.t[at] * scale, np.zeros((len(at), self.patch**2))
            for k in range(self.patch**2):
                there, t = a.latest(at, k % self.patch - r, k // self.patch - r)
                v[there, k] = np.exp((t[there] * scale - now[there]) / self.tau_ms)
            yield at, v

    def _learn(self, parts: Iterator[pd.DataFrame], w: np.ndarray, th: np.ndarray, size: tuple[int, int], scale: float) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Units and thresholds of one bank after its events, which come in order in ``parts`` (x, y, t), then misses and patches."""
        w, th, missed, seen, held = w.copy(), th.copy(), 0, 0, None
        for some in gathered(parts, max(1024, (1 << 22) // self.patch**2)):
            rows = pd.concat([p.assign(own=True, bank=0) for p in some], ignore_index=True)
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            a = Around(rows, np.zeros(len(rows), np.int64), size, self.patch // 2)
            patches, whole = np.empty((a.n, self.patch**2)), np.zeros(a.n, bool)
            for at, v in self._patches(a, size, scale):
                patches[at], whole[at] = v, True
            for i in np.flatnonzero(whole).tolist():
                v = patches[i]
                v = v / math.sqrt(v.dot(v))
                d = 1 - w @ v
                d[d > th] = np.inf
                k = int(d.argmin())
                if math.isinf(d[k]):
                    missed += 1
                    th += self.delta_e
                else:
                    u = (1 - self.eta) * w[k] + self.eta * v
                    w[k] = u / math.sqrt(u.dot(u))
                    th[k] = max(th[k] - self.delta_i, 0.0)
            seen += int(whole.sum())
            held = rows[a.seen].drop_duplicates(["x", "y"], keep="last").assign(own=False)
        return w, th, missed, seen

    def fit(self, s: EventStream, epochs: int = 1) -> "FEAST":
        """Learn from the stream, in order; each bank's fold is one task, which holds some batches of its events at a time.

        Events are put in order and packed by blocks in many tasks, so the fold's own task orders only packets.
        """
        model, size, scale = FEAST(**self.get_params()), s.sensor_size, s.meta.scale_ms
        w, th, missed, seen = self.weights, self.thresholds, 0, 0
        if w is None:
            w = np.random.default_rng(self.seed).random((self.banks, self.n_features, self.patch**2))
            w /= np.linalg.norm(w, axis=2, keepdims=True)
            th = np.full((self.banks, self.n_features), 0.5)
        w, th = w.copy(), th.copy()

        def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                group = pdf[["bank", "block"]].to_numpy()
                ends = np.append(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1, len(pdf))
                cuts = [i for a, b in zip(np.append(0, ends), ends) for i in range(a, b, PACKET)]
                data = pdf[["x", "y", "t"]].to_records(index=False).astype(EVENT)
                yield pd.DataFrame({"bank": pdf["bank"].to_numpy()[cuts], "seq": pdf["seq"].to_numpy()[cuts], "data": [data[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(pdf)])]})

        def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                for i in range(0, len(pdf), 64):
                    yield pd.DataFrame(np.frombuffer(b"".join(pdf["data"].iloc[i: i + 64]), EVENT))

        def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # a task may have both banks, one after the other
            ordered = ((bank, some) for pdf in parts for bank, some in pdf.groupby("bank"))
            for bank, group in itertools.groupby(ordered, lambda x: x[0]):
                u, v, miss, n = model._learn(unpack(some for _, some in group), w[bank], th[bank], size, scale)
                yield pd.DataFrame([{"bank": bank, "w": u.ravel().tolist(), "th": v.tolist(), "missed": miss, "seen": n}])

        ev = s.df.where("x is not null and y is not null and t is not null").select("x", "y", "t", "seq", self._bank.cast("int").alias("bank"), F.expr(f"seq div {BLOCK}").alias("block"))
        packets = ev.repartition("bank", "block").sortWithinPartitions("bank", "block", "seq").mapInPandas(pack, "bank int, seq long, data binary")
        for _ in range(epochs):
            # of three tasks the two banks fall to different ones
            learned = packets.repartition(2 * self.banks - 1, "bank").sortWithinPartitions("bank", "seq").mapInPandas(learn, "bank int, w array<double>, th array<double>, missed long, seen long").collect()
            if not learned:
                return self
            for row in learned:
                w[row["bank"]], th[row["bank"]] = np.array(row["w"]).reshape(w.shape[1:]), row["th"]
            missed, seen = sum(row["missed"] for row in learned), sum(row["seen"] for row in learned)
        self.weights, self.thresholds, self.missed_rate = w, th, missed / seen if seen else 0.0
        return self

    def transform(self, s: EventStream) -> DataFrame:
        """seq and keys of each event with its ``feature``: bank * n_features + unit, -1 without a whole patch."""
        if self.weights is None:
            raise ValueError("fit the model first")
        size, scale, model, keys = s.sensor_size, s.meta.scale_ms, self, s.keys

        def work(a: Around) -> pd.DataFrame:
            out, bank = np.full(a.n, -1), a.rows["bank"].to_numpy()
            for at, v in model._patches(a, size, scale):
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                for b in range(model.banks):
                    mine = bank[at] == b
                    out[at[mine]] = b * model.n_features + (v[mine] @ model.weights[b].T).argmax(axis=1)
            return a.rows.assign(feature=out).loc[a.own, [*keys, "seq", "feature"]]

        schema = s.df.select(*s.keys, "seq", F.lit(0).cast("int").alias("feature")).schema
        return around_events(s, work, schema, self.patch // 2, self._bank)

    def histogram(self, s: EventStream) -> DataFrame:
        return self.transform(s).where("feature >= 0").groupBy(*s.keys, "feature").agg(F.count("*").alias("count"))

    def feature_images(self) -> np.ndarray:
        return self.weights.reshape(self.banks, self.n_features, self.patch, self.patch)

    def save(self, path: str) -> None:
        np.savez(path, weights=self.weights, thresholds=self.thresholds, missed_rate=self.missed_rate, **self.get_params())

    @classmethod
    def load(cls, path: str) -> "FEAST":
        with np.load(path) as z:
            out = cls(**{k: z[k].item() for k in cls().get_params()})
            out.weights, out.thresholds, out.missed_rate = z["weights"], z["thresholds"], float(z["missed_rate"])
        return out
