"""Near copies by the exact overlap of their shingles.

Texts are sets of ``shingle`` lower-case words in a row (all words, if there are
fewer).  Two are near if their sets' Jaccard similarity is 0.8 or more, in whole
numbers: 9 |A and B| >= 4 (|A| + |B|).

Near texts share four fifths of their shingles, so a text with more than a fifth
of its own is near none.  Shingles of the whole table are counted for that, packed
and in turns, and only the other texts go on: unrelated texts that have lines in
common would make candidates by the square of the table.

Candidates come from prefixes: in any order of all shingles, near sets share one
of the first n // 5 + 1 of each.  Rare shingles come first, by the number of all
those texts that have them, and of equal ones the smaller hash, so that common
lines make few candidates.  A candidate also has to be near by its size and by
the places of the shared shingle, else it can't be; the rest are compared, text
by text, in parts that bound the texts sent at once.

Linked texts are one class, and texts of a class needn't be compared any more.
Where more than ``crowd`` prefixes have a shingle, first the ``crowd`` that have it
nearest to their front ask all others, then twice as many, until that finds no link:
a large group of near copies is then a class or few, after comparisons in proportion
to its members.  At last all texts that aren't in the largest class of a shingle's
prefixes ask those of other classes, so no link between classes is left out.

Of the texts that links connect, be it by way of others, the one with the smallest
hash stays.  Texts without words have no shingles and stay.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, hashing
from .components import components

#: Shingles are counted in so many turns, by their hash, in 2**BUCKETS buckets each; a turn's shuffle goes before the next.
TURNS, BUCKETS = 2, 11
#: In place of a text's place in its chunk: of more than one there.
_KNOWN = 0xFFFF
#: Candidates are compared in parts of this many a text of the table, at least LEAST_PAIRS: each brings two texts with it.
PAIRS_A_TEXT, LEAST_PAIRS = 0.25, 10_000


def _sets(column: pa.Array, shingle: int):
    """(row, sorted distinct shingles) of each text that has words."""
    for lo, hi in common.chunks(column):
        hashes, first, *_ = hashing.batch_words(pc.ascii_lower(column.slice(lo, hi - lo).fill_null("")))
        for i, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist())):
            if b > a:
                yield lo + i, np.unique(hashing.grams(hashes[a:b], min(shingle, b - a)))


def _runs(batches, key: str, columns: list[str]):
    """(key, rows) of each run of equal keys in sorted batches; a row holds the columns' values."""
    held, now = [], None
    for batch in batches:
        for k, *row in zip(batch.column(key).to_pylist(), *[batch.column(c).to_pylist() for c in columns]):
            if held and k != now:
                yield now, held
                held = []
            now = k
            held.append(row)
    if held:
        yield now, held


def _blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values, the first to ends[0], the next to ends[1] and so on."""
    where = np.concatenate([[0], ends]).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(values))])


def _repeats(texts: DataFrame, shingle: int, turn: int) -> DataFrame:
    """(id, n, r): each text's number of shingles, and how many of this turn's it shares with another text.

    Shingles are sent by chunks of texts, packed, to the bucket of their upper
    bits; back to the chunk go the places of texts whose shingles were met twice.
    A chunk sends a shingle once, so none is many in its bucket.
    """
    def cut(batches):
        for batch in batches:
            for lo, hi in _chunked(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                sets = list(_sets(part.column("text"), shingle))
                if not sets:
                    continue
                own = [s[s % np.uint64(TURNS) == turn] for _, s in sets]
                g, at = np.concatenate(own), np.repeat(np.arange(len(own)), [len(s) for s in own]).astype(np.uint16)
                order = np.argsort(g)
                g, at = g[order], at[order]
                first = np.ones(len(g), bool)
                first[1:] = g[1:] != g[:-1]
                again = ~first
                again[:-1] |= ~first[1:]
                known = at[again]
                sent = np.where(again, _KNOWN, at)[first].astype(np.uint16)
                g = g[first]
                bucket = (g >> np.uint64(64 - BUCKETS)).astype(np.int32)
                ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1 if len(g) else np.zeros(0, np.int64)
                ids = part.column("id").take(pa.array([i for i, _ in sets]))
                chunk = ids[0].as_py()
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([pa.array(bucket[ends - 1]), pa.array([chunk % (1 << BUCKETS)], pa.int32())]),
                    pa.array([chunk] * (len(ends) + 1), pa.int64()),
                    pa.concat_arrays([_blobs(g, ends), pa.nulls(1, pa.binary())]),
                    pa.concat_arrays([_blobs(sent, ends), pa.array([known.tobytes()])]),
                    pa.concat_arrays([pa.nulls(len(ends), pa.binary()), pa.array([ids.to_numpy().tobytes()])]),
                    pa.concat_arrays([pa.nulls(len(ends), pa.binary()), pa.array([np.array([len(s) for _, s in sets], np.int32).tobytes()])]),
                ], names=["bucket", "chunk", "g", "at", "ids", "n"])
        common.release()

    def back(found: dict):
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([np.concatenate(x).tobytes() for x in found.values()], pa.binary()), pa.nulls(len(found), pa.binary()), pa.nulls(len(found), pa.binary())], names=["chunk", "at", "ids", "n"])

    def met(batches):
        found, size = {}, 0
        for _, rows in _runs(batches, "bucket", ["chunk", "g", "at", "ids", "n"]):
            facts = [(c, at, ids, n) for c, g, at, ids, n in rows if g is None]
            if facts:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in facts], pa.int64()), *[pa.array([x[k] for x in facts], pa.binary()) for k in (1, 2, 3)]], names=["chunk", "at", "ids", "n"])
            rows = [(c, np.frombuffer(g, np.uint64), np.frombuffer(at, np.uint16)) for c, g, at, *_ in rows if g is not None]
            if len(rows) < 2:
                continue
            g = np.concatenate([x[1] for x in rows])
            order = np.argsort(g)
            same = g[order[1:]] == g[order[:-1]]
            twice = np.zeros(len(g), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            lo = 0
            for c, own, at in rows:
                at = at[twice[lo: lo + len(own)]]
                at = at[at != _KNOWN]
                lo += len(own)
                if len(at):
                    found.setdefault(c, []).append(at)
                    size += len(at)
            if size > 1 << 21:
                yield back(found)
                found, size = {}, 0
        if found:
            yield back(found)
        common.release()

    def summed(batches):
        for _, rows in _runs(batches, "chunk", ["at", "ids", "n"]):
            ids, n = next((np.frombuffer(ids, np.int64), np.frombuffer(n, np.int32)) for _, ids, n in rows if ids is not None)
            r = sum(np.bincount(np.frombuffer(at, np.uint16), minlength=len(ids)) for at, *_ in rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(r.astype(np.int32))], names=["id", "n", "r"])

    sent = texts.select("id", "text").mapInArrow(cut, "bucket int, chunk long, g binary, at binary, ids binary, n binary")
    returned = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(met, "chunk long, at binary, ids binary, n binary")
    return returned.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(summed, "id long, n int, r int")


def _chunked(column: pa.Array):
    """Chunks of a text column whose places fit in 16 bits, below the mark."""
    for lo, hi in common.chunks(column, 1 << 23):
        for at in range(lo, hi, _KNOWN):
            yield at, min(at + _KNOWN, hi)


def _sharing(texts: DataFrame, shingle: int) -> DataFrame:
    """The texts that can be near others: near texts share four fifths of their shingles, so no more than a fifth is a text's own."""
    spark = texts.sparkSession
    found = []
    for turn in range(TURNS):
        with common.batches_of(spark, 2000):
            found.append(common.written(_repeats(texts, shingle, turn), "near-repeats"))
        common.let_go(spark)
    counts = functools.reduce(DataFrame.union, found).groupBy("id").agg(F.first("n").alias("n"), F.sum("r").alias("r"))
    able = counts.where("n - r <= n div 5").select("id")
    return common.written(texts.join(able, "id", "left_semi"), "near-sharing", stays=True)


def prefixes(texts: DataFrame, shingle: int) -> DataFrame:
    """(g, id, n, at): the shingles of each text's prefix that another text has, the number of all its shingles, and the place among them."""
    def run(batches):
        for batch in batches:
            found = list(_sets(batch.column("text"), shingle))
            sizes = np.array([len(s) for _, s in found], np.int32)
            ids = batch.column("id").take(pa.array(np.repeat([i for i, _ in found], sizes).astype(np.int64)))
            g = np.concatenate([s for _, s in found]).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(g), ids, pa.array(np.repeat(sizes, sizes))], names=["g", "id", "n"])
        common.release()

    sets = common.written(texts.select("id", "text").mapInArrow(run, "g long, id long, n int"), "near-sets")
    often = common.written(sets.groupBy("g").agg(F.count("*").alias("c")).where("c > 1"), "near-often")
    common.let_go(texts.sparkSession)
    # a text's own shingles come first, as many as it has in common with none
    text = Window.partitionBy("id")
    placed = sets.join(often, "g").select("g", "id", "n", (F.row_number().over(text.orderBy("c", "g")) - 1 + F.col("n") - F.count("*").over(text)).cast("int").alias("at"))
    return placed.where("at <= n div 5")


def _may(n, at, m, bt):
    """Whether two sets can be near whose first shared shingle has these places in them."""
    return F.lit(9) * F.least(n - at, m - bt) >= F.lit(4) * (n + m)


def _near(pairs: DataFrame, texts: DataFrame, shingle: int, whole: int) -> DataFrame:
    """Of pairs (a, b) of ids, those whose texts are near, written.  ``whole``: the number of texts of the whole table."""
    spark = texts.sparkSession
    with common.temporary(spark):
        asked = common.written(pairs.distinct(), "near-candidates")
        parts = int(asked.count() // max(LEAST_PAIRS, PAIRS_A_TEXT * whole)) + 1
        done = []
        for part in range(parts):
            with common.temporary(spark):
                some = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == part)
                done.append(common.written(_compared(some, texts, shingle), "near-compared", stays=True))
        return common.written(functools.reduce(DataFrame.union, done), "near-links", stays=True)


def _compared(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    asked = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    some = common.written(texts.join(asked, "id", "left_semi"), "near-texts")
    both = pairs.join(some.select(F.col("id").alias("a"), F.col("text").alias("s")), "a").join(some.select(F.col("id").alias("b"), F.col("text").alias("t")), "b")

    def run(batches):
        for batch in batches:
            s, t = dict(_sets(batch.column("s"), shingle)), dict(_sets(batch.column("t"), shingle))
            keep = [i for i in range(batch.num_rows) if 9 * len(np.intersect1d(s[i], t[i], True)) >= 4 * (len(s[i]) + len(t[i]))]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
        common.release()

    return both.mapInArrow(run, "a long, b long")


def copies(texts: DataFrame, *, shingle: int = 5, crowd: int = 24) -> DataFrame:
    """(id) of the texts that go.  ``texts``: id and text, distinct ids, written so that reading again is cheap."""
    with common.temporary(texts.sparkSession):
        return common.written(_gone(texts, shingle, crowd), "near-gone", stays=True)


def _gone(texts: DataFrame, shingle: int, crowd: int) -> DataFrame:
    common.let_go(texts.sparkSession)
    whole = texts.count()
    with common.temporary(texts.sparkSession):
        texts = _sharing(texts, shingle)
    with common.temporary(texts.sparkSession):
        # what stands in one prefix alone makes no candidates: most goes after two shuffles of short rows
        keys = common.written(prefixes(texts, shingle), "prefixes")
        shared = common.written(keys.groupBy("g").agg(F.count("*").alias("c")).where("c > 1"), "near-shared")
        common.let_go(texts.sparkSession)
        packed = keys.select("g", "id", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at").cast("long")).alias("na")).join(shared, "g")
        keys = packed.select("g", "id", F.shiftright("na", 32).cast("int").alias("n"), F.col("na").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).cast("int").alias("at"), "c")
        keys = common.written(keys, "near-keys", stays=True)
    crowds = common.written(keys.where(F.col("c") > crowd).withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("at", "id"))), "near-crowds")
    classes, done, more = None, 0, crowd
    while True:
        members = _classed(crowds.where(F.col("rank") > done), classes).withColumn("asks", F.col("rank") <= done + more)
        links = _near(_pairs(members), texts, shingle, whole)
        if links.isEmpty():
            break
        classes = _joined(links, classes)
        done, more = done + more, 2 * more
    members = common.written(_classed(keys, classes), "near-classed")
    most = members.groupBy("g", "class").agg(F.count("*").alias("size")).groupBy("g").agg(F.max(F.struct("size", "class")).alias("most"))
    members = common.written(members.join(most, "g").withColumn("asks", F.col("class") != F.col("most.class")).drop("most"), "near-members")
    classes = _joined(_near(_pairs(members), texts, shingle, whole), classes)
    return classes.where("node != root").select(F.col("node").alias("id"))


def _classed(keys: DataFrame, classes: DataFrame | None) -> DataFrame:
    """Keys with the class of their text: the smallest text that it is linked to so far, or itself."""
    if classes is None:
        return keys.withColumn("class", F.col("id"))
    return keys.join(classes, keys["id"] == classes["node"], "left").withColumn("class", F.coalesce("root", "id")).drop("node", "root")


def _joined(links: DataFrame, classes: DataFrame | None) -> DataFrame:
    """(node, root): the classes that further links make, written."""
    if classes is not None:
        links = links.union(classes.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return common.written(components(links), "near-classes")


def _pairs(members: DataFrame) -> DataFrame:
    """(a, b): of two texts of different classes that meet in a shingle, and of which one asks, those that can be near."""
    x, y = members.where("asks").alias("x"), members.alias("y")
    once = ~F.col("y.asks") | (F.col("x.id") < F.col("y.id"))
    may = _may(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at"))
    both = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.class") != F.col("y.class")) & once & may)
    return both.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
