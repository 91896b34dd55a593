"""Exact top-k search by inner product: tiled matrix products, partial selection, tree merging.

Vectors become integers, floor(scale * x).  Queries are packed into blocks of at
most ``BLOCK`` vectors, written to the shared folder.  Each task holds shards of
at most ``SHARD`` bytes of candidates and reads the query blocks one at a time:
neither side is ever in memory, broadcast or collected as a whole.  Each tile of
a block and a stretch of the shard is one matrix product; the tile's best k of
each query join those of the tiles before.  A shard's lists are merged within
groups of shards first, then across groups, by ranking with a limit that Spark
applies before each shuffle too.

Products are done in doubles, which is exact while dimension times the largest
components stays below 2**53; other tiles use Python's integers, and scores that
don't fit 64 bits are set to the nearest that does.

Nulls: rows with a null id, a null vector, or null or non-finite components take
no part.  Vectors are only compared with those of their own dimension.  Equal
scores rank by id; candidates with equal ids each count, in any order; a
query's own id is no candidate.  Query rows with equal ids are answered one by
one.  Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK, TILE, SHARD = 256, 8192, 1 << 26


def _matrices(batch: pa.RecordBatch, scale: float):
    """(ids, integer-valued doubles) of the batch's usable rows, by dimension."""
    ids, vectors = batch.column(0), batch.column(1)
    if not len(ids):
        return
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    ok = (sizes >= 0) & ids.is_valid().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    for d in np.unique(sizes[ok]):
        rows = np.flatnonzero(ok & (sizes == d))
        with np.errstate(over="ignore"):
            m = np.floor(scale * values[start[rows][:, None] + np.arange(d)])
        fine = np.isfinite(values[start[rows][:, None] + np.arange(d)]).all(axis=1) & np.isfinite(m).all(axis=1)
        if fine.any():
            yield int(d), ids[rows[fine]], m[fine]


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    if q.shape[1] == 0:
        return np.zeros((len(q), len(c)), np.int64)
    if np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2**53:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _best(qi: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """Of flat (query, id, score) entries the k best of each query."""
    order = np.lexsort((ids, -scores.astype(object) if len(scores) and scores.min() == -(2**63) else -scores, qi))
    qi, ids, scores = qi[order], ids[order], scores[order]
    first = np.searchsorted(qi, qi, "left")
    keep = np.arange(len(qi)) - first < k
    return qi[keep], ids[keep], scores[keep]


def _shard(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int):
    """The k best candidates of a shard for each query of a block."""
    held = (np.zeros(0, np.int64),) * 3
    for lo in range(0, len(ids), TILE):
        part = ids[lo: lo + TILE]
        s = _scores(q, c[lo: lo + TILE])
        usable = q_ids[:, None] != part[None, :]
        if s.shape[1] > k:
            s[~usable] = -(2**63)
            bar = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            usable &= s >= bar[:, None]
        qi, ci = np.nonzero(usable)
        held = _best(*(np.concatenate(x) for x in zip(held, (qi, part[ci], s[qi, ci]))), k)
    return held


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 10, scale: float = 1024.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` best candidates."""
    spark = vectors.sparkSession
    wanted = queries.select(queries[key].cast("long").alias("id"), queries[vector].cast("array<double>").alias("v"))
    pool = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def packed(d):
            ids, m = (np.concatenate(x) for x in zip(*held.pop(d)))
            for lo in range(0, len(ids), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([ids[lo: lo + BLOCK]], pa.list_(pa.int64())), pa.array([m[lo: lo + BLOCK].tobytes()], pa.binary())], names=["d", "ids", "data"])

        for batch in batches:
            for d, ids, m in _matrices(batch, scale):
                held.setdefault(d, []).append((ids, m))
                if sum(len(x) for x, _ in held[d]) >= BLOCK:
                    yield from packed(d)
        for d in [*held]:
            yield from packed(d)

    folder_uri = common.fresh_dir(spark, "query-blocks")
    wanted.mapInArrow(pack, "d int, ids array<long>, data binary").write.parquet(folder_uri)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        fs, folder = common.filesystem(folder_uri)
        files = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(folder)) if x.path.endswith(".parquet"))
        part, n = TaskContext.get().partitionId(), 0

        def answer(d, pieces):
            ids, c = (np.concatenate(x) for x in zip(*pieces))
            for f, path in enumerate(files):
                with fs.open_input_file(path) as raw:
                    row = 0
                    for block in pq.ParquetFile(raw).iter_batches(batch_size=4):
                        for dim, q_ids, data in zip(*(x.to_pylist() for x in block.columns)):
                            row += 1
                            if dim != d:
                                continue
                            q_ids = np.array(q_ids, np.int64)
                            q = np.frombuffer(data, np.float64).reshape(len(q_ids), d)
                            qi, best, scores = _shard(q_ids, q, ids, c, k)
                            size = len(qi)
                            yield pa.RecordBatch.from_arrays([pa.array(q_ids[qi]), pa.array(((f << 40) + row * BLOCK + qi).astype(np.int64)), pa.array(np.full(size, part * 1000 + n)), pa.array(best), pa.array(scores)], names=["query_id", "place", "shard", "vec_id", "score"])

        held: dict = {}
        for batch in batches:
            for d, ids, m in _matrices(batch, scale):
                held.setdefault(d, []).append((ids, m))
                if sum(x.nbytes for _, x in held[d]) >= SHARD:
                    yield from answer(d, held.pop(d))
                    n += 1
        for d, pieces in held.items():
            yield from answer(d, pieces)

    lists = pool.mapInArrow(run, "query_id long, place long, shard long, vec_id long, score long")
    # lists of groups of shards are merged first, then those of all groups
    by = [F.desc("score"), F.asc("vec_id")]
    rank = F.row_number().over(Window.partitionBy("query_id", "place", "group").orderBy(*by))
    groups = lists.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(16))).withColumn("rank", rank).where(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("query_id", "place").orderBy(*by))
    return groups.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
