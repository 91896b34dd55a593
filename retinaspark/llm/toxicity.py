"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text, lower-cased, is read as its UTF-8 bytes with white space runs as one
space.  Its features are the 4-, 5- and 6-byte sequences it holds, hashed to
2**22 buckets; how often doesn't matter.  For each bucket, r is the log of the
ratio of its smoothed share in toxic texts to that in others.  Buckets in too
few texts, or that tell too little, are left out.  A logistic model is then fit
on the features times r, and its weights times r are what scoring adds up.

Fitting takes a bounded sample: at most ``max_rows`` labelled texts, those with
the smallest hashes of the id, none longer than ``longest`` bytes, and of their
features the ``most`` (20,000) that tell most.  Scoring takes all texts, whole;
long ones go piece by piece, so beside a text's own bytes, some copies of them,
memory is bounded.

Nulls: a null text counts as empty.  An empty text gets the score of the bias
alone.  Labels null or for missing documents are not used; a document labelled
twice counts each time.  With no labels, or labels of one kind, the score is the
share of toxic ones (0 with none).  Repeated rows score alike.  Other columns stay
as they are; the score's name gets an underscore before it if it is taken.  An
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing

BITS = 22
SIZES = (4, 5, 6)
_CHUNK = 1 << 18
_SALT = np.uint64(0x9FB21C651E98DF25)


@dataclass
class Model:
    """``weight`` by bucket (0: no feature), ``bias``, and the ratio scale it was fit with."""

    weight: np.ndarray
    bias: float


def _prepared(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    text = pc.utf8_lower(column.fill_null(""))
    text = pc.replace_substring_regex(text, r"[\x09-\x0D\x20]+", " ")
    return hashing.buffers(pc.binary_join_element_wise(" ", text, " ", ""))


def features(data: np.ndarray, at: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every feature of each row once; ``keep``: only such buckets."""
    rows, buckets = [], []
    value = hashing._BYTE[data] if len(data) else np.zeros(0, np.uint64)
    ends = np.repeat(at[1:], np.diff(at))
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for n in SIZES:
        m = len(data) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * _SALT + value[k: k + m]
        b = (hashing.mix(h) >> np.uint64(64 - BITS)).astype(np.int64)
        ok = np.arange(m) + n <= ends[:m]
        if keep is not None:
            ok &= keep[b]
        rows.append(row[:m][ok])
        buckets.append(b[ok])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique((np.concatenate(rows) << BITS) | np.concatenate(buckets))
    return both >> BITS, both & ((1 << BITS) - 1)


def fit(texts: pa.Array, labels: np.ndarray, *, min_texts: int = 4, most: int = 20_000, rounds: int = 100, ridge: float = 1e-3) -> Model:
    """A model from texts and their 0/1 labels."""
    y = np.asarray(labels, np.float64)
    size = 1 << BITS
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(size, np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    # texts that have a bucket, all and toxic ones: a few bytes for each bucket, floats for those that count alone
    held, pos = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for lo, hi in common.chunks(texts, _CHUNK):
        r, b = features(*_prepared(texts.slice(lo, hi - lo)))
        for counts, here in ((held, b), (pos, b[y[r + lo] == 1])):
            bucket, n = np.unique(here, return_counts=True)
            counts[bucket] += n.astype(np.int32)
    n1, n0 = y.sum(), len(y) - y.sum()
    seen = np.flatnonzero(held >= max(min_texts, 1))
    total, toxic = held[seen].astype(float), pos[seen].astype(float)
    del held, pos
    # how surprising the split of a bucket's texts is
    told = (toxic - total * n1 / len(y)) ** 2 / (total * n1 * n0 / len(y) ** 2 + 1e-9)
    chosen = np.flatnonzero(told > 6.6)
    if len(chosen) > most:
        chosen = np.sort(chosen[np.argsort(-told[chosen], kind="stable")[:most]])
    ratio = np.log((toxic[chosen] + 1) / (n1 + 2)) - np.log((total[chosen] - toxic[chosen] + 1) / (n0 + 2))
    chosen = seen[chosen]
    slot, keep, parts = np.zeros(size, np.int32), np.zeros(size, bool), []
    slot[chosen], keep[chosen] = np.arange(len(chosen)), True
    for lo, hi in common.chunks(texts, _CHUNK):
        r, b = features(*_prepared(texts.slice(lo, hi - lo)), keep)
        parts.append(((r + lo).astype(np.int32), slot[b]))
    row, col = (np.concatenate(x) for x in zip(*parts))
    del slot, keep, parts
    x = ratio[col]
    # full-batch accelerated gradient descent on the logistic loss
    norm = np.bincount(row, weights=x * x, minlength=len(y)).max() + 1
    w, v, bias, vb = np.zeros(len(chosen)), np.zeros(len(chosen)), float(np.log(n1 / n0)), 0.0
    step, w0, b0 = 4.0 / norm, w.copy(), bias
    for k in range(rounds * 10):
        mom = k / (k + 3)
        v, vb = w + mom * (w - w0), bias + mom * (bias - b0)
        z = np.bincount(row, weights=x * v[col], minlength=len(y)) + vb
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        w0, b0 = w, bias
        w = v - step * (np.bincount(col, weights=x * g[row], minlength=len(chosen)) / len(y) * 20 + ridge * v)
        bias = vb - step * g.mean() * 20
    weight = np.zeros(size, np.float32)
    weight[chosen] = w * ratio
    return Model(weight, bias)


def score(model: Model, texts: pa.Array) -> np.ndarray:
    """Scores from 0 to 1."""
    out = np.full(len(texts), model.bias)
    keep = model.weight != 0
    for lo, hi in common.chunks(texts, _CHUNK):
        data, at = _prepared(texts.slice(lo, hi - lo))
        if hi - lo == 1 and len(data) > 4 * _CHUNK:
            # pieces that share as many bytes as a feature may lack
            parts = [data[i: i + _CHUNK + max(SIZES) - 1] for i in range(0, len(data), _CHUNK)]
            found = np.unique(np.concatenate([features(p, np.array([0, len(p)]), keep)[1] for p in parts]))
            out[lo] += model.weight[found].sum(dtype=np.float64)
            continue
        row, bucket = features(data, at, keep)
        out[lo:hi] += np.bincount(row, weights=model.weight[bucket], minlength=hi - lo)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def held_out(key):
    """Whether a document's id, as text, has CRC-32 2 modulo 4 (null: false)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 5000, longest: int = 200_000) -> Model:
    """Fit on at most ``max_rows`` labelled documents that aren't held out, of at most ``longest`` bytes each."""
    known = labels.select(labels["doc_id"].alias("doc_id"), labels["toxic"].cast("double").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0.0, 1.0))
    # the limit below bounds what is broadcast
    chosen = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    texts = common.only(docs, doc_id="doc_id", text="text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").toArrow().sort_by([("doc_id", "ascending")]).combine_chunks()
    column = texts["text"].combine_chunks() if texts.num_rows else pa.array([], pa.string())
    model = fit(column, texts["toxic"].to_numpy())
    del texts, column
    common.release()
    return model


def classify(docs: DataFrame, model: Model, *, threshold: float = 0.3, text: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs``, and its texts' score from 0 to 1."""
    score_col = common.free_name(docs, score_col)
    from pyspark.sql.types import DoubleType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(model.weight), model.weight[model.weight != 0], model.bias))
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, values, bias = shared.value
        weight = np.zeros(1 << BITS, np.float32)
        weight[where] = values
        held = Model(weight, bias)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(held, batch.column(place)))], names=[*batch.schema.names, score_col])
        common.release()

    return docs.mapInArrow(run, schema)
