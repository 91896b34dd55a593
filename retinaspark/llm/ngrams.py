"""LM scoring: stupid backoff from n-gram count tables, computed relationally.

A word's score is its n-gram's count over its context's count if the n-gram is
in the tables, else ``alpha`` times its score with a context one word shorter; a
single word's is its count over all words.  Counts cover the whole corpus.
Where the corpus is the documents themselves, every n-gram of a document is in
it, if only by that document; so n-grams of two words or more that occur fewer
than ``min_count`` times (2; 1 keeps all) don't count as seen, and what one
document alone says backs off.  A document's score is the sum of its words'
log10 scores, and the mean of them.

1. Explode.  Each task takes a chunk of documents at a time and sends the
   chunk's distinct n-grams, with how often it has them, to the ranges of their
   56-bit hashes, packed into one row of bytes for each range.
2. Count and join.  Each range of an order has a task of its own, which adds its
   entries up: that is its part of the count tables.  The exploded n-grams are
   in that task too, so the join to them takes no other shuffle; each chunk gets
   its counts, in the order of its entries.
3. Sum.  Each task takes its chunks again, puts the counts to the n-grams and
   adds up the documents' scores.

So n-grams cross the network once, as hashes in sorted runs, and counts
once, in as few bytes as they need; a frequent n-gram is one entry a chunk, and
no key is hot.  Ranges grow in number with the input; a task holds one.  Step 3
relies on step 1's chunks: a checksum of each is compared, and another order of
rows is an error, not a wrong score (write such a DataFrame first).  Of 10**9
different n-grams seven pairs or so share a hash.

Nulls: a null or empty text has no words, sum 0 and a null mean.  Rows with a
null or equal id each get their own score.  Words that a corpus other than the
documents doesn't have count as ``unknown``.  Extra columns are not looked at.
An empty corpus scores as one with a single unknown word.  Very long texts are
a chunk of their own, in some 60 times their bytes of memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing

#: Bytes of text in a chunk, and for each hash range.
CHUNK, PER_RANGE = 8 << 20, 16 << 20


def _chunks(batches: Iterator[pa.RecordBatch]):
    """(number, word hashes, first word of each row and the end, batch, first row) of each chunk."""
    n = 0
    for batch in batches:
        column = batch.column("text")
        for lo, hi in common.chunks(column, CHUNK):
            hashes, first, *_ = hashing.batch_words(column.slice(lo, hi - lo))
            yield n, hashes, first, batch, lo
            n += 1


def _grams(hashes: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """The k-grams of rows, in order, in 56 bits."""
    h = hashes if k == 1 else hashing.grams(hashes, k)[hashing.inside(first, k, len(hashes))]
    return h >> np.uint64(8)


def _planes(h: np.ndarray) -> bytes:
    """Sorted hashes byte by byte, high bytes first: those hardly change, so they compress."""
    return np.ascontiguousarray(h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:].T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(7, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 1:] = planes.T
    return out.view(">u8").ravel().astype(np.uint64)


def _small(c: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs, after a byte that says how many."""
    top = int(c.max()) if len(c) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + c.astype(f"<u{width}").tobytes()


def _unsmall(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _entries(rows: DataFrame, order: int, ranges: int, corpus: bool, asks: bool) -> DataFrame:
    """k, r, part, n, check, hashes, counts: a chunk's n-grams in a range.  ``asks``: the chunk wants counts back."""
    def explode(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() if asks else -1
        for n, hashes, first, *_ in _chunks(batches):
            check = zlib.crc32(hashes.tobytes(), zlib.crc32(first.tobytes()))
            out = []
            for k in range(1, order + 1):
                h, c = np.unique(_grams(hashes, first, k), return_counts=True)
                r = ((h >> np.uint64(24)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(r)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(h)]):
                    if b > a:
                        out.append((k, int(r[a]), part, n, check, _planes(h[a:b]), _small(c[a:b] if corpus else np.zeros(b - a, np.int64))))
            if out:
                types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["k", "r", "part", "n", "check", "hashes", "counts"])
        common.release()

    return rows.select("text").mapInArrow(explode, "k int, r int, part int, n int, check long, hashes binary, counts binary")


def _answered(entries: DataFrame, order: int, ranges: int, min_count: int) -> DataFrame:
    """part, n, k, r, check, counts: what each chunk asked for; part -1: the words in a range, in ``check``."""
    def answer(held):
        k, r = held[0][0], held[0][1]
        hashes = [_unplanes(x[5]) for x in held]
        counts = np.concatenate([_unsmall(x[6]) for x in held])
        u, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(u)).astype(np.int64)
        words = int(total.sum()) if k == 1 else 0
        if k > 1:
            total[total < min_count] = 0
        out, lo = [(-1, 0, k, r, words, b"")], 0
        for x, h in zip(held, hashes):
            if x[2] >= 0:
                out.append((x[2], x[3], k, r, x[4], _small(total[at[lo: lo + len(h)]])))
            lo += len(h)
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["part", "n", "k", "r", "check", "counts"])

    def run(batches):
        held: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:2] != held[0][:2]:
                    yield answer(held)
                    held = []
                held.append(row)
        if held:
            yield answer(held)
        common.release()

    # range r of order k has task r * order + k - 1 for itself
    dealt = entries.repartitionById(ranges * order, (F.col("r") * order + F.col("k") - 1).cast("int")).sortWithinPartitions("k", "r")
    return dealt.mapInArrow(run, "part int, n int, k int, r int, check long, counts binary")


def score(docs: DataFrame, corpus: DataFrame | None = None, *, order: int = 3, min_count: int = 2, alpha: float = 0.4, unknown: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, log10_score, mean_log10) of each row of ``docs`` by the counts of ``corpus`` (default: of ``docs``)."""
    spark = docs.sparkSession
    rows = common.only(docs, doc_id=key, text=text)
    size = (docs if corpus is None else corpus).agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    ranges = max(8, -(-size // PER_RANGE))
    if corpus is None:
        entries = _entries(rows, order, ranges, True, True)
    else:
        entries = _entries(rows, order, ranges, False, True).union(_entries(common.only(corpus, text=text), order, ranges, True, False))
    folder_uri = common.fresh_dir(spark, "ngram-counts")
    # a folder for each task of step 3, with its chunks' counts
    _answered(entries, order, ranges, min_count).repartitionById(ranges, F.pmod("part", F.lit(ranges)).cast("int")).sortWithinPartitions("part", "n", "k", "r").write.partitionBy("part").option("compression", "zstd").parquet(folder_uri)
    schema = "part int, n int, k int, r int, check long, counts binary"
    total = spark.read.schema(schema).parquet(folder_uri).where("part = -1").agg(F.sum("check")).first()[0] or 1

    def add_up(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        fs, folder = common.filesystem(f"{folder_uri}/part={TaskContext.get().partitionId()}")
        files = [x.path for x in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if x.path.endswith(".parquet")]
        told: dict = {}
        for path in files:
            with fs.open_input_file(path) as raw:
                for batch in pq.ParquetFile(raw).iter_batches(columns=["n", "k", "r", "check", "counts"]):
                    for n, k, r, check, counts in zip(*(c.to_pylist() for c in batch.columns)):
                        told.setdefault((n, k), []).append((r, check, counts))
        for n, hashes, first, batch, lo in _chunks(batches):
            check = zlib.crc32(hashes.tobytes(), zlib.crc32(first.tobytes()))
            counted = []
            for k in range(1, order + 1):
                mine = sorted(told.pop((n, k), []))
                if any(c != check for _, c, _ in mine):
                    raise ValueError("the documents' rows came in another order than before; write them first")
                u, at = np.unique(_grams(hashes, first, k), return_inverse=True)
                c = np.concatenate([_unsmall(x) for *_, x in mine]) if mine else np.zeros(0, np.int64)
                if len(c) != len(u):
                    raise ValueError("the documents' rows came in another order than before; write them first")
                counted.append(c[at])
            # from one word of context to the next, wherever there is one
            one = np.where(counted[0] > 0, counted[0], unknown)
            s = np.log10(one) - np.log10(total)
            for k in range(2, order + 1):
                at = hashing.inside(first, k, len(hashes))
                c = counted[k - 1]
                before = np.zeros(len(hashes), np.int64)
                starts = hashing.inside(first, k - 1, len(hashes)) if k > 2 else np.arange(len(hashes))
                before[starts] = counted[k - 2]
                ok = c > 0
                with np.errstate(divide="ignore"):
                    s[at + k - 1] = np.where(ok, np.log10(np.maximum(c, 1)) - np.log10(np.maximum(before[at], 1)), np.log10(alpha) + s[at + k - 1])
            words = np.diff(first)
            # sums of each row by itself, so that long chunks don't blur short rows
            part = np.add.reduceat(np.append(s, 0.0), first[:-1])
            part = np.where(words > 0, part, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(words)), pa.array(words), pa.array(part), pa.array(np.where(words > 0, part / np.maximum(words, 1), 0.0), mask=words == 0)], names=["doc_id", "n_words", "log10_score", "mean_log10"])
        common.release()

    schema = rows.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("log10_score"), F.lit(None).cast("double").alias("mean_log10")).schema
    return rows.mapInArrow(add_up, schema)
