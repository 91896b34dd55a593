"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Texts and items are read as lower-case words without ASCII punctuation.  The
seeds of an item are all its ``n``-word sequences (the whole item if it is
shorter), however often the corpus has them: an edited copy may keep none but
common ones, and copies themselves make seeds common.  Rare as they are in the
corpus, seeds of a benchmark leave few places; a cut by their counts would lose
copies that many documents hold.

One pass over the corpus joins passages to items by the seeds: a broadcast join
on the seeds' hashes, made in the tasks by looking up sorted arrays.  Each place
where an item's seeds gather is aligned, unless it has too few of the item's
words to reach the threshold by any alignment.  Whole texts are read and only
findings are shuffled.  Items go to the tasks in blocks of at most ``block`` of
them and ``BYTES`` or so of their texts, so memory is bounded for any benchmark;
each block takes a pass.  A task works on texts of 2 MB together, or one longer
one, and on ``PAIRS`` seeds of items or so, or all of one text's.

The score is the local alignment's (2 for a word that agrees, -1 for another or
for a gap) over that of the whole item with itself.  Documents at ``threshold``
or more hold a copy, be it edited; ``first_word`` and ``end_word`` are where the
alignment starts and ends.

Nulls: null texts hold nothing, null or empty items are never found, and a null
doc_id is kept with its findings.  Equal items each count.  Of several places
for an item in one document the best counts, of equal ones the first.  Repeated
rows each have their findings.  Extra columns are not looked at.  Item ids may be
of any type.  Without documents or items there are no findings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing

#: Bytes of items' texts in a block, and seeds of items that a task looks at together.
BYTES, PAIRS = 16 << 20, 1 << 20
_APART = hashing.SPACE.copy()
_APART[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80), *range(0x00, 0x20)]] = True


def _words(texts: pa.Array):
    lower = pc.utf8_lower(texts.fill_null(""))
    hashes, first, *_ = hashing.batch_words(lower, _APART)
    return hashes, first


class Items:
    """A block of benchmark items, ready to be looked for."""

    def __init__(self, texts: list[str | None], n: int) -> None:
        hashes, first = _words(pa.array(texts, pa.string()))
        self.words = [hashes[a:b] for a, b in zip(first, first[1:])]
        self.sets = [np.unique(w, return_counts=True) for w in self.words]
        self.n = n
        seed, item, at, size = [], [], [], []
        for i, w in enumerate(self.words):
            k = min(n, len(w))
            if not k:
                continue
            g = hashing.grams(w, k)
            seed.append(g)
            item.append(np.full(len(g), i))
            at.append(np.arange(len(g)))
            size.append(np.full(len(g), k))
        self.seed, self.item, self.at, self.size = (np.concatenate(x) if x else np.zeros(0, d) for x, d in ((seed, np.uint64), (item, np.int64), (at, np.int64), (size, np.int64)))
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.item, self.at, self.size = (x[order] for x in (self.seed, self.item, self.at, self.size))
        self.unique, self.start = np.unique(self.seed, return_index=True)
        self.end = np.append(self.start[1:], len(self.seed))
        self.sizes = np.unique(self.size)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.unique >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position, place in ``unique``) of every seed in the rows."""
        where, which = [], []
        for k in self.sizes:
            g = hashing.grams(hashes, int(k))
            pos = np.flatnonzero(self.bits[(g >> np.uint64(44)).astype(np.int64)]) if len(self.unique) else np.zeros(0, np.int64)
            u = np.searchsorted(self.unique, g[pos])
            u[u == len(self.unique)] = 0
            ok = self.unique[u] == g[pos] if len(pos) else np.zeros(0, bool)
            pos, u = pos[ok], u[ok]
            ok = pos + k <= first[np.searchsorted(first, pos, "right")] if len(pos) else ok[ok]
            ok = ok & (self.size[self.start[u]] == k)
            where.append(pos[ok])
            which.append(u[ok])
        return (np.concatenate(where), np.concatenate(which)) if where else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def most(self, i: int, text: np.ndarray) -> int:
        """A bound on the score of any alignment of item ``i`` in a text: 2 for each word that they share."""
        own, n = self.sets[i]
        at = np.searchsorted(own, text)
        at[at == len(own)] = 0
        return 2 * int(np.minimum(np.bincount(at[own[at] == text], minlength=len(own)), n).sum())


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment's score, and its start and end in the text."""
    best, start, end = 0, 0, 0
    ramp = np.arange(len(text) + 1)
    row, origin = np.zeros(len(text) + 1, np.int64), ramp.copy()
    for w in item:
        new, begun = row - 1, origin.copy()
        across = row[:-1] + np.where(text == w, 2, -1)
        better = across >= new[1:]
        new[1:][better], begun[1:][better] = across[better], origin[:-1][better]
        begun[new <= 0] = ramp[new <= 0]
        np.maximum(new, 0, out=new)
        # gaps in the item: the best of new[j - d] - d
        top = np.maximum.accumulate(new + ramp)
        row, origin = top - ramp, begun[np.maximum.accumulate(np.where(new + ramp == top, ramp, 0))]
        k = int(row.argmax())
        if row[k] > best:
            best, start, end = int(row[k]), int(origin[k]), k
    return best, start, end


def _places(pos: np.ndarray, at: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Stretches of text where an item's seeds gather: (first, end) word positions."""
    begin = np.sort(pos - at)
    slack = max(4, length // 2)
    cuts = np.flatnonzero(np.diff(begin) > slack) + 1
    return [(int(x[0]) - slack, int(x[-1]) + length + slack) for x in np.split(begin, cuts)]


def _found(items: Items, hashes: np.ndarray, first: np.ndarray, threshold: float):
    """(row, item, score, first word, end word) of the items found in rows of words."""
    where, which = items.hits(hashes, first)
    order = np.argsort(where, kind="stable")
    where, which = where[order], which[order]
    doc = np.searchsorted(first, where, "right") - 1
    # a row for each seed and item; documents together, as many as make up a bounded number of them
    n_of = (items.end - items.start)[which]
    total, lo = np.cumsum(n_of), 0
    while lo < len(where):
        most = (total[lo - 1] if lo else 0) + PAIRS
        hi = int(np.searchsorted(total, most, "right"))
        hi = int(np.searchsorted(doc, doc[min(max(hi, lo), len(doc) - 1)], "left")) if hi < len(doc) else hi
        if hi <= lo:
            hi = int(np.searchsorted(doc, doc[lo], "right"))
        n = n_of[lo:hi]
        pos = np.repeat(where[lo:hi], n)
        s = np.repeat(items.start[which[lo:hi]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        d, item, at = np.repeat(doc[lo:hi], n), items.item[s], items.at[s]
        order = np.lexsort((pos, item, d))
        d, item, pos, at = d[order], item[order], pos[order], at[order]
        cuts = np.flatnonzero((np.diff(d) != 0) | (np.diff(item) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(d)]):
            r, i = int(d[a]), int(item[a])
            words, best = items.words[i], (0, 0, 0)
            for x, y in _places(pos[a:b], at[a:b], len(words)):
                x, y = max(x, int(first[r])), min(y, int(first[r + 1]))
                if items.most(i, hashes[x:y]) < threshold * 2 * len(words):
                    continue
                score, start, end = align(words, hashes[x:y])
                if score > best[0]:
                    best = (score, x + start - int(first[r]), x + end - int(first[r]))
            if best[0] >= threshold * 2 * len(words):
                yield r, i, best[0] / (2 * len(words)), best[1], best[2]
        lo = hi


def find(docs: DataFrame, benchmark: DataFrame, *, n: int = 3, threshold: float = 0.5, block: int = 20_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) of the items found in documents."""
    spark = docs.sparkSession
    rows = common.only(docs, doc_id=key, text=text)
    items = benchmark.select(benchmark["item_id"].alias("item_id"), benchmark["text"].alias("text"), F.xxhash64(benchmark["item_id"].cast("string"), benchmark["text"]).alias("h"))
    n_items, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # a block's rows: about `block`, as hashes are even
    n_blocks = max(1, -(-n_items // block), -(-size // BYTES))
    schema = rows.select("doc_id").schema.add("item", "integer").add("score", "double").add("first_word", "integer").add("end_word", "integer")
    found = None
    for k in range(n_blocks):
        part = items.where(F.pmod("h", F.lit(n_blocks)) == k).orderBy("h").select("item_id", "text").toArrow()
        sought = spark.sparkContext.broadcast(Items(part["text"].to_pylist(), n))

        def look(batches: Iterator[pa.RecordBatch], sought=sought) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column, out = batch.column("text"), []
                for lo, hi in common.chunks(column):
                    out += [(lo + r, *rest) for r, *rest in _found(sought.value, *_words(column.slice(lo, hi - lo)), threshold)]
                if out:
                    d, *rest = zip(*out)
                    types = (pa.int32(), pa.float64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), *[pa.array(c, t) for c, t in zip(rest, types)]], names=["doc_id", "item", "score", "first_word", "end_word"])
            common.release()

        names = spark.createDataFrame([(i, x) for i, x in enumerate(part["item_id"].to_pylist())], items.select(F.lit(0).alias("item"), "item_id").schema)
        # a block's ids, one short row an item
        here = rows.mapInArrow(look, schema).join(F.broadcast(names), "item").select("doc_id", "item_id", "score", "first_word", "end_word")
        found = here if found is None else found.union(here)
    return found
