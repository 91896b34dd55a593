"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint's 64 bits are cut into 16 segments of 4, and the counts of ones
in the segments are its place in a grid of 16 dimensions.  One differing bit
moves one coordinate by one, so the Manhattan distance of two places is at most
the Hamming distance of the fingerprints: places further apart than the radius
can't link.

The range join on the grid meets in the middle: two places at distance 2 or less
have a cell at distance 1 or less from both.  So each distinct fingerprint goes
to its own cell and the up to 32 beside it, and only fingerprints that meet in a
cell are compared, bit by bit.

A cell with more than ``crowd`` fingerprints isn't compared in pairs.  There
each fingerprint sends itself and those of its one-bit neighbours that lie in
the cell as keys; two fingerprints differ by 2 bits or less exactly if they have
such a key in common, and all that share one link to the smallest of them.  That
gives the same components, and work in proportion to the members.

Copies share a fingerprint and are one node from the start.  Components come
from stars (see components.py); nothing is gathered on the driver.

Nulls: a null text has no words, like an empty one: fingerprint zero, which
links as any other.  A null doc_id is kept and gets its component's smallest
doc_id that isn't null (null if there is none).  Rows with equal doc_ids each
stay.  Extra columns are not looked at.  Very long texts are hashed some words at
a time.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SEGMENTS, WIDTH = 16, 4
_BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a text as an unsigned integer."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, _BLOCK):
        hi = min(lo + _BLOCK, n)
        if shingle == 3 and len(words) >= 3:
            made = map(b"%b %b %b".__mod__, zip(words[lo:hi], words[lo + 1: hi + 1], words[lo + 2: hi + 2]))
        else:
            made = (b" ".join(words[i: i + shingle]) for i in range(lo, hi))
        h = np.fromiter((digest(x, 42) for x in made), "<u8", hi - lo)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp as a signed 64-bit integer."""
    rows = common.only(docs, doc_id=key, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
        common.release()

    return rows.mapInArrow(run, rows.select("doc_id", F.lit(0).cast("long").alias("fp")).schema)


def _place(fp):
    """The cell of a fingerprint: 16 counts from 0 to 4, three bits each."""
    out = F.lit(0).cast("long")
    for k in range(SEGMENTS):
        # the sign bit is in the last segment, so shift first and mask then
        count = F.bit_count(F.shiftrightunsigned(fp, WIDTH * k).bitwiseAND(F.lit(15).cast("long"))).cast("long")
        out = out.bitwiseOR(F.shiftleft(count, 3 * k))
    return out


def _cells(cell):
    """A cell and those beside it, in an array."""
    beside = []
    for k in range(SEGMENTS):
        count = F.shiftright(cell, 3 * k).bitwiseAND(F.lit(7).cast("long"))
        beside += [F.when(count < WIDTH, cell + F.lit(1 << 3 * k)), F.when(count > 0, cell - F.lit(1 << 3 * k))]
    return F.filter(F.array(cell, *beside), lambda c: c.isNotNull())


def _flips(fp):
    return F.concat(F.array(fp), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def links(nodes: DataFrame, *, crowd: int = 48) -> DataFrame:
    """(a, b): links whose components are those of all pairs of fingerprints that differ by 2 bits or less.

    ``nodes``: distinct fingerprints, in ``fp``, written so that reading again is cheap.
    """
    spread = nodes.select("fp", F.explode(_cells(_place(F.col("fp")))).alias("cell"))
    full = common.written(spread.groupBy("cell").count().where(F.col("count") > crowd).select("cell"), "crowded")
    n_full = full.count()
    if n_full:
        # a cell's key is 8 bytes; only so many are broadcast, more are joined by shuffle
        few = n_full <= 100_000
        side = F.broadcast(full) if few else full
        thin = spread.join(side, "cell", "left_anti")
        dense = spread.join(side, "cell", "left_semi")
    else:
        thin, dense = spread, None
    met = thin.groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("m")).where(F.size("m") > 1)
    pairs = met.select("m", F.posexplode("m").alias("i", "a")).select("a", F.explode(F.filter(F.slice("m", F.col("i") + 2, F.size("m")), lambda b: F.bit_count(b.bitwiseXOR(F.col("a"))) <= 2)).alias("b"))
    if dense is None:
        return pairs
    keys = dense.select("fp", "cell", F.explode(_flips(F.col("fp"))).alias("mid")).where(_place(F.col("mid")) == F.col("cell")).select("fp", "mid")
    least = keys.groupBy("mid").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").select("mid", "b")
    return pairs.union(keys.join(least, "mid").where("fp != b").select(F.col("fp").alias("a"), "b"))


def cluster(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    marked = common.written(fingerprints(docs, key=key, text=text, shingle=shingle), "fingerprints")
    # short rows that each become many: dealt out so that all cores have some
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, marked.count() // 50_000 + 1)
    nodes = common.written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")).repartition(parts), "nodes")
    roots = components(links(nodes.select("fp")))
    grouped = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = grouped.join(ids, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hexed(fp):
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
