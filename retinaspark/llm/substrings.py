"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

A document repeats a window of ``window`` words if a document with a smaller id
holds the same words in a row.  Every window has an anchor: of the ``window/2``
word sequences in it the one with the smallest hash, the first of equal ones.
Two equal windows have equal anchors at equal places.

1. Index.  Anchors of all documents are counted by hash; those in one document
   only can be in no repeated window and go.  For each other anchor the
   occurrence in the smallest document, the first one there, becomes its
   reference.  References stand in blocks of ``BLOCK`` words of their documents;
   the anchors are the index of the blocks.
2. Parse.  From left to right, a document's next indexed anchor starts a factor:
   it goes on along the reference block as long as the anchors that follow point
   to the same places of it.  Each such stretch meets its block in a join, words
   are compared one by one, and factors are as long as they agree, also before
   the first and behind the last anchor, as far as windows with these anchors
   reach.  The next factor starts at the next anchor, in whatever block.  Factors
   of ``window`` words or more are duplicate spans.
3. Boundaries.  Windows about an anchor that a factor does not hold cross one of
   its ends, so they hold the word beyond it and ``window/2`` words of the factor
   beside it.  If two documents have these words, those windows are compared by
   their hashes, and of equal ones all but the smallest document's become spans.
4. Spans of each document are merged and their words removed.

A factor's reference is the smallest document that has its anchors, not the
longest match of all; what another document shares beyond it is what step 3 is
for, so that no window is missed.

Anchors are one in ``window/4`` words or so.  Words are compared by 64-bit
hashes of each word, windows across ends by two 64-bit hashes.  A passage in
a third of all documents is one reference, and its occurrences meet it in a join
of two written tables, which Spark splits where it is skewed; least and largest
ids by hash are taken before the shuffle.  Documents' texts are not shuffled: what
was found about a row is sent to the partition that has it.  That relies on reading
the rows in one order each time; checksums of the texts are compared, and another
order is an error (write such a DataFrame first).

Nulls: a null text has no words.  Rows with a null id come after all others and
don't serve as references to each other.  Of rows with equal ids none removes
words of another.  Extra columns are not looked at.  An empty table gives an
empty table.  Texts are worked on whole, a few at a time; a task's memory is
some 30 times the longest one's bytes, and at least that for 2 MB.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing

_LAST = 2**63 - 1
#: Entries that a task puts in one batch, or so.
_GATHER = 1 << 14
#: Words of a reference block.
BLOCK = 128


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """Positions of the smallest hash, the first of equal ones, in each stretch of ``span``."""
    n = len(grams)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= span:
        return np.array([int(grams.argmin())])
    # the smallest of each stretch by doubling: best[i] is the place of it in grams[i : i + step]
    best, step = np.arange(n), 1
    while step < span:
        add = min(step, span - step)
        left, right = best[: n - step - add + 1], best[add: n - step + 1]
        best = np.where(grams[right] < grams[left], right, left)
        step += add
    return np.unique(best)


def _check(text: pa.Scalar) -> int:
    """A checksum of a text."""
    data = text.as_buffer()
    return zlib.crc32(data) if data is not None else 0


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of stretches, one stretch after the other."""
    before = np.cumsum(size) - size
    return np.repeat(begin - before, size) + np.arange(int(size.sum()))


def _packed(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """Stretches of 64-bit values as binary values."""
    at = np.zeros(len(size) + 1, np.int32)
    np.cumsum(8 * size, out=at[1:])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, first value of each and the end) of what ``_packed`` made."""
    data, at = hashing.buffers(column)
    return data.view(np.uint64), at // 8


def _numbered(batches: Iterator[pa.RecordBatch]):
    """(batch, number of its first row): rows are numbered by partition and place in it."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 33
    for batch in batches:
        yield batch, at
        at += batch.num_rows


def _aside(df: DataFrame, name: str, stays: bool = False) -> str:
    """Write a table with ``row_no`` to a folder for each partition of the documents."""
    uri = common.noted(common.fresh_dir(df.sparkSession, name), stays)
    parts = df.withColumn("part", F.shiftright("row_no", 33).cast("int"))
    parts.repartition("part").sortWithinPartitions("part", "row_no").write.partitionBy("part").option("compression", "zstd").parquet(uri)
    return uri


def _own(uri: str):
    """The tables that ``_aside`` wrote for this task's partition."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs
    from pyspark import TaskContext

    fs, folder = common.filesystem(f"{uri}/part={TaskContext.get().partitionId()}")
    for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as raw:
                yield pq.ParquetFile(raw).read()


def _sorted(uri: str, *order: str) -> dict[str, np.ndarray] | None:
    """The columns of all rows that ``_own`` yields, in order."""
    held = [*_own(uri)]
    if not held:
        return None
    whole = pa.concat_tables(held).sort_by([(c, "ascending") for c in order])
    return {c: whole[c].to_numpy() for c in whole.column_names}


def spans(docs: DataFrame, *, window: int = 50) -> DataFrame:
    """(row_no, check, lo, hi): stretches of words to remove; row_no is a row's partition and place in it (see ``_numbered``)."""
    half = window // 2
    reach = window - half  # a window that holds an anchor starts at most so far before it
    stretch = window - half + 1  # anchors' candidates in a window

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, names = [], 0, ["anchor", "key", "row_no", "check", "at"]
        for batch, base in _numbered(batches):
            column, keys = batch.column("text"), batch.column("key").to_numpy()
            for lo, hi in common.chunks(column):
                hashes, first, *_ = hashing.batch_words(column.slice(lo, hi - lo))
                for r in np.flatnonzero(np.diff(first) >= window).tolist():
                    g = hashing.grams(hashes[first[r]: first[r + 1]], half)
                    at = anchors(g, stretch)
                    n = len(at)
                    held.append((g[at].view(np.int64), np.full(n, keys[lo + r]), np.full(n, base + lo + r), np.full(n, _check(column[lo + r])), at.astype(np.int32)))
                    size += n
                    if size >= _GATHER:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)
        common.release()

    found = common.written(docs.mapInArrow(occurrences, "anchor long, key long, row_no long, check long, at int"), "anchors")
    shared = found.groupBy("anchor").agg(F.max("key").alias("last"), F.min(F.struct("key", "row_no", "at")).alias("ref")).where("ref.key < last").select("anchor", F.col("ref.row_no").alias("ref_row"), F.col("ref.at").alias("ref_at"), F.col("ref.key").alias("ref_key"))
    shared = common.written(shared, "index")
    mine = found.join(shared, "anchor").select("row_no", "check", "at", "ref_row", "ref_at", "ref_key")
    # rows' shared anchors go to where the rows are; the texts stay there
    mine_uri = _aside(mine, "row-anchors")
    names = ["ref_row", "block", "part", "row_no", "check", "key", "ref_key", "x", "lo", "hi", "ref_x", "words"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of documents whose anchors follow one block, and the blocks' words (part false)."""
        own = _sorted(mine_uri, "row_no", "at")
        if own is None:
            return
        for batch, base in _numbered(batches):
            column, keys = batch.column("text"), batch.column("key").to_numpy()
            for lo, hi in common.chunks(column):
                a, b = np.searchsorted(own["row_no"], [base + lo, base + hi])
                if a == b:
                    continue
                row, check, at, ref_row, ref_at, ref_key = (own[c][a:b].astype(np.int64) for c in ("row_no", "check", "at", "ref_row", "ref_at", "ref_key"))
                r = row - base - lo
                some = np.flatnonzero(np.diff(r, prepend=-1))
                if any(_check(column[lo + int(r[i])]) != check[i] for i in some):
                    raise ValueError("the documents' rows came in another order than before; write them first")
                hashes, first, *_ = hashing.batch_words(column.slice(lo, hi - lo))
                is_ref = (ref_row == row) & (ref_at == at)
                for part in (True, False):
                    i = np.flatnonzero(is_ref != part)
                    if not len(i):
                        continue
                    block = ref_at[i] // BLOCK
                    new = (np.diff(r[i]) != 0) | (np.diff(block) != 0)
                    if part:
                        new |= (np.diff(ref_row[i]) != 0) | (np.diff(ref_at[i] - at[i]) != 0) | (np.diff(at[i]) > stretch)
                    cut = np.concatenate([[0], np.flatnonzero(new) + 1, [len(i)]])
                    f, l = i[cut[:-1]], i[cut[1:] - 1]
                    begin, n = first[r[f]], np.diff(first)[r[f]]
                    x, y = np.maximum(at[f] - reach, 0), np.minimum(at[l] + half + reach, n)
                    columns = [ref_row[f], block[cut[:-1]], np.full(len(f), part), row[f], check[f], keys[lo + r[f]], ref_key[f], x.astype(np.int32), at[f].astype(np.int32), (at[l] + half).astype(np.int32), (ref_at[f] - at[f] + x).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), _packed(hashes[_ragged(begin + x, y - x)], y - x)], names=names)
        common.release()

    seen = common.written(docs.mapInArrow(parse, "ref_row long, block long, part boolean, row_no long, check long, key long, ref_key long, x int, lo int, hi int, ref_x int, words binary"), "parse")
    blocks = seen.where("not part").select("ref_row", "block", F.col("x").alias("block_x"), F.col("words").alias("ref_words"))
    pairs = seen.where("part").join(blocks, ["ref_row", "block"])

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stretches' factors: long ones are spans; ends come with the hashes of the windows across them."""
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            row, check, key, ref_key, x0, lo, hi, ref_x, block_x = (batch.column(c).to_numpy().astype(np.int64) for c in ("row_no", "check", "key", "ref_key", "x", "lo", "hi", "ref_x", "block_x"))
            w, first = _unpacked(batch.column("words"))
            ref, ref_first = _unpacked(batch.column("ref_words"))
            size = np.diff(first)
            owner = np.repeat(np.arange(len(size)), size)
            there = np.arange(len(w)) - first[owner] + (ref_x - block_x)[owner]
            same = (there >= 0) & (there < np.diff(ref_first)[owner])
            same[same] = w[same] == ref[(there + ref_first[:-1][owner])[same]]
            # stretches of words that agree, in one row each
            edge = np.zeros(len(w) + 1, bool)
            edge[first[:-1]] = True
            begin = np.flatnonzero(same & (np.concatenate([[True], ~same[:-1]]) | edge[:-1]))
            end = np.flatnonzero(same & (np.concatenate([~same[1:], [True]]) | edge[1:] | (np.arange(len(w)) == len(w) - 1))) + 1
            p = owner[begin]
            x, y = begin - first[p], end - first[p]
            held = (y - x >= half) & (x < (hi - x0)[p]) & (y > (lo - x0)[p])
            p, x, y = p[held], x[held], y[held]
            whole = (key > ref_key)[p] & (y - x >= window)
            out = [(row[p][whole], check[p][whole], key[p][whole], (x0[p] + x)[whole].astype(np.int32), (x0[p] + y)[whole].astype(np.int32), None, np.zeros(whole.sum(), np.int64))]
            # windows across an end that the words of the row go beyond
            wide, across = hashing.grams(w, window), hashing.grams(w, half + 1)
            for side in ("left", "right"):
                if side == "left":
                    i = np.flatnonzero(x > 0)
                    a, b, key_at = x[i] - reach, x[i] - 1, x[i] - 1
                else:
                    i = np.flatnonzero(y < size[p])
                    a, b, key_at = y[i] - window + 1, y[i] - half, y[i] - half
                a, b = np.maximum(a, 0), np.minimum(b, size[p[i]] - window)
                ok = a <= b
                i, a, b, key_at = i[ok], a[ok], b[ok], key_at[ok]
                q = p[i]
                told = hashing.mix(across[first[q] + key_at] + np.uint64(side == "left")).view(np.int64)
                out.append((row[q], check[q], key[q], (x0[q] + a).astype(np.int32), np.full(len(q), -1, np.int32), told, b - a + 1, wide[_ragged(first[q] + a, b - a + 1)]))
            for row_, check_, key_, lo_, hi_, told, n, *values in out:
                if len(row_):
                    packed = _packed(values[0], n) if values else pa.nulls(len(row_), pa.binary())
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (row_, check_, key_, lo_, hi_)), pa.array(told) if values else pa.nulls(len(row_), pa.int64()), packed], names=["row_no", "check", "key", "lo", "hi", "end", "windows"])
        common.release()

    factors = common.written(pairs.select("row_no", "check", "key", "ref_key", "x", "lo", "hi", "ref_x", "words", "block_x", "ref_words").mapInArrow(factor, "row_no long, check long, key long, lo int, hi int, end long, windows binary"), "factors")
    whole = factors.where("end is null").select("row_no", "check", "lo", "hi")
    ends = common.written(factors.where("end is not null").groupBy("end").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("end"), "ends")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each window across an end."""
        for batch in batches:
            h, first = _unpacked(batch.column("windows"))
            size = np.diff(first)
            i = np.repeat(np.arange(len(size)), size)
            columns = [batch.column(c).to_numpy()[i] for c in ("end", "row_no", "check", "key")]
            lo = batch.column("lo").to_numpy()[i] + np.arange(len(h)) - first[i]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(lo.astype(np.int32)), pa.array(h.view(np.int64))], names=["end", "row_no", "check", "key", "lo", "h"])

    windows = factors.where("end is not null").join(ends, "end", "left_semi").select("end", "row_no", "check", "key", "lo", "windows").mapInArrow(across, "end long, row_no long, check long, key long, lo int, h long")
    windows = common.written(windows, "windows")
    least = common.written(windows.groupBy("end", "h").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("end", "h", "least"), "least")
    # windows overlap and are found by several ends: their starts become bits, 64 in a row
    more = windows.join(least, ["end", "h"]).where("key > least").select("row_no", "check", F.expr("lo div 64").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("lo") % 64).alias("bit"))
    more = more.groupBy("row_no", "check", "at").agg(F.bit_or("bit").alias("bits"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stretches that runs of windows cover."""
        for batch in batches:
            bits = np.ascontiguousarray(batch.column("bits").to_numpy())
            edge = np.diff(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8), axis=1, prepend=0, append=0)
            r, first = np.nonzero(edge == 1)
            after = np.nonzero(edge == -1)[1]
            base = batch.column("at").to_numpy()[r] * 64
            columns = [batch.column(c).to_numpy()[r] for c in ("row_no", "check")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array((base + first).astype(np.int32)), pa.array((base + after - 1 + window).astype(np.int32))], names=["row_no", "check", "lo", "hi"])

    return whole.union(more.mapInArrow(merged, "row_no long, check long, lo int, hi int"))


def prepared(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, text, and the key to compare by: null ids come after all others."""
    return docs.select(docs[key].cast("long").alias("id"), F.coalesce(docs[key].cast("long"), F.lit(_LAST)).alias("key"), docs[text].cast("string").alias("text"))


def dedup(docs: DataFrame, *, window: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n_words, n_removed, spans, kept_sha256) of each row; ``text`` is what is left, words joined by one space."""
    rows = prepared(docs, key, text)
    with common.temporary(docs.sparkSession), common.batches_of(docs.sparkSession, 1000):
        cut_uri = _aside(spans(rows, window=window), "spans", stays=True)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = {"row_no": np.zeros(0, np.int64), "check": np.zeros(0, np.int64), "lo": np.zeros(0, np.int32), "hi": np.zeros(0, np.int32)}
        own = _sorted(cut_uri, "row_no") or none
        numbers, checks, los, his = (own[c] for c in ("row_no", "check", "lo", "hi"))
        span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        types = (pa.string(), pa.int64(), pa.int64(), span, pa.string())

        def row(t: pa.Scalar, number: int):
            words = (t.as_py() or "").encode().split()
            a, b = np.searchsorted(numbers, [number, number + 1])
            merged, left = [], words
            if a < b:
                if _check(t) != checks[a] or his[a:b].max() > len(words):
                    raise ValueError("the documents' rows came in another order than before; write them first")
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, los[a:b], 1)
                np.add.at(gone, his[a:b], -1)
                gone = np.cumsum(gone) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[:-1].astype(np.int8), [0]])))
                merged = [{"lo": int(x), "hi": int(y)} for x, y in zip(edge[::2], edge[1::2])]
                left = [w for w, x in zip(words, gone) if not x]
            kept = b" ".join(left)
            return kept.decode(), len(words), len(words) - len(left), merged, hashlib.sha256(kept).hexdigest()

        for batch, base in _numbered(batches):
            # a few texts at a time: their words and what is left are held as Python objects
            for lo, hi in common.chunks(batch.column("text"), 1 << 19):
                out = [row(t, base + lo + i) for i, t in enumerate(batch.column("text").slice(lo, hi - lo))]
                columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), *columns], names=["key", "text", "n_words", "n_removed", "spans", "kept_sha256"])
        common.release()

    return rows.mapInArrow(apply, "key long, text string, n_words long, n_removed long, spans array<struct<lo int, hi int>>, kept_sha256 string")
