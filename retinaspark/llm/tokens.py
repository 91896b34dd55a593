"""Token-id output: flat files of unsigned integers with 64-bit document offsets.

Format, in one folder:

* ``part-<k>-<id>.bin``: the ids of the part's documents one after the other, as
  little-endian unsigned integers of 2 or 4 bytes;
* ``part-<k>-<id>.off``: n + 1 little-endian 64-bit offsets, in ids, of the
  part's n documents in its ``.bin`` file;
* ``part-<k>-<id>.doc``: the documents' keys in the same order (Arrow IPC);
* ``manifest`` (Parquet): for each part its number, file stem, documents and
  ids, and ``base``, the ids of all parts before it.

A document's place in the whole is its part's base plus its offset.  Bases are
prefix sums of the parts' counts, so no part waits for another.  A task that is
run again writes files of another name; only those that the manifest lists
count.

Nulls: a null text counts as empty; a null key comes first.  An empty text is
just the end id.  Documents with equal keys all stay, side by side; extra
columns are not looked at.  An empty table gives an empty manifest.  Very long
texts are encoded in parts that are cut where the tokenizer starts anew.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Pre-tokens that an encoder keeps the ids of, or so: the first, which the frequent are among.
CACHE = 300_000
#: Bytes of text that are worked on at a time; longer texts are cut.
CHUNK = 8 << 20
#: Pieces that are Python strings at a time.
BLOCK = 1 << 14


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of stretches, one stretch after the other."""
    before = np.cumsum(size) - size
    return np.repeat(begin - before, size) + np.arange(int(size.sum()))


def _joined(words: pa.Array) -> str:
    """Words with a space between them."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()


class Encoder:
    """Ids of texts, by the tokenizers library.

    A byte-level BPE tokenizer works on each of its pre-tokens alone, and a
    single space between two other characters always starts a new one.  So a
    column of texts is split there, each distinct piece is encoded once, and the
    texts' ids are gathered from the pieces'.  Pieces with characters that
    regular expressions of different libraries may class differently, and texts
    with other runs of white space or with a special token, go through the
    library's whole pipeline.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.split = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.special = [x["content"] for x in spec.get("added_tokens") or []]
        self.model = self.tokenizer.model
        # The pattern of byte-level pre-tokenizers, and their letters for bytes.
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.space = self.letters[0x20]
        #: A character that isn't surely classed alike everywhere, or white space at the start.
        self.odd = "^\n|[^\\x21-\\x7E\nÀ-ÖØ-öø-ſ]"
        self.shown = {c: "".join(self.letters[b] for b in chr(c).encode()) for c in range(0x180)}
        # the place and the number of pre-tokens' ids in ``flat``, by number
        self.index: dict[str, int] = {}
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _ids(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens one after the other, and how many each has; those not kept go to the model."""
        get, begin, size, flat = self.index.get, self.begin, self.size, self.flat
        number = np.array([get(t, -1) for t in found], np.int64)
        at = np.flatnonzero(number < 0).tolist()
        if at:
            new = list(dict.fromkeys([found[i] for i in at]))
            new.sort(key=str.isascii)
            k = next((i for i, t in enumerate(new) if t.isascii()), len(new))
            mapped = "\0".join(new[:k]).translate(self.shown | {0: "\0"}).split("\0") if k else []
            if k < len(new):
                mapped += "\0".join(new[k:]).replace(" ", self.space).replace("\n", self.letters[0x0A]).split("\0")
            made = [*map(self.model.tokenize, mapped)]
            n = np.fromiter(map(len, made), np.int64, len(made))
            ids = np.array([x.id for m in made for x in m], "<u4")
            numbers = dict(zip(new, range(len(size), len(size) + len(new))))
            number[at] = [numbers[found[i]] for i in at]
            begin, size, flat = np.concatenate([begin, len(flat) + np.cumsum(n) - n]), np.concatenate([size, n]), np.concatenate([flat, ids])
            if len(self.index) < CACHE:
                self.index.update(numbers)
                self.begin, self.size, self.flat = begin, size, flat
        n = size[number]
        return flat[_ragged(begin[number], n)], n

    def _pieces(self, distinct: pa.Array):
        """(ids, begin, size, uncut) of distinct pieces with a space before each; ``uncut``: it can't be cut off before that space."""
        begin, size, uncut, ids, total = [], [], [], [], 0
        # some at a time, for they become Python strings
        for lo in range(0, len(distinct), BLOCK):
            some = distinct.slice(lo, BLOCK)
            odd = pc.match_substring_regex(some, self.odd).to_numpy(zero_copy_only=False)
            plain = ~odd & (pc.binary_length(some).to_numpy(zero_copy_only=False) > 0)
            b, n, u = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64), np.zeros(len(some), bool)
            if plain.any():
                words = some.filter(pa.array(plain))
                found = self.pattern.findall(" " + _joined(words))
                made, k = self._ids(found)
                ids.append(made)
                # each of these pieces starts with the only space in it
                n[plain] = np.add.reduceat(k, np.flatnonzero([t[0] == " " for t in found]))
                b[plain] = total + np.cumsum(n[plain]) - n[plain]
                total += len(made)
            for i in np.flatnonzero(odd).tolist():
                word = some[i].as_py()
                if word[0].isspace():
                    u[i] = True
                else:
                    ids.append(np.array(self.whole(" " + word), "<u4"))
                    b[i], n[i] = total, len(ids[-1])
                    total += len(ids[-1])
            begin.append(b)
            size.append(n)
            uncut.append(u)
        return [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((ids, "<u4"), (begin, np.int64), (size, np.int64), (uncut, bool))]

    def encode(self, column: pa.Array, after_space: bool = False):
        """(ids, number of ids of each row, first row, end) of runs of rows.

        ``after_space``: the texts go on after a space that they don't hold.
        """
        column, n = column.fill_null(""), len(column)
        whole = np.ones(n, bool)
        if self.split:
            whole = pc.match_substring_regex(column, r"^ | $|  ").to_numpy(zero_copy_only=False).copy()
            for s in self.special:
                whole |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(whole), "", column), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        coded = lists.flatten().dictionary_encode()
        del lists
        codes, distinct = coded.indices.to_numpy().copy(), coded.dictionary
        ids, begin, size, uncut = self._pieces(distinct)
        first = bounds[:-1]
        if uncut.any():
            bad = uncut[codes]
            if not after_space:
                bad[first] = False
            whole[np.searchsorted(bounds, np.flatnonzero(bad), "right") - 1] = True
        # first pieces, which have no space before them, and whole texts
        opening = first[~whole] if not after_space else first[:0]
        u, back = np.unique(codes[opening], return_inverse=True)
        others = [self.whole(w) if w else [] for w in distinct.take(pa.array(u)).to_pylist()]
        codes[opening] = len(size) + 1 + back
        for i in np.flatnonzero(whole).tolist():
            text = column[i].as_py()
            codes[bounds[i]: bounds[i + 1]] = len(size)  # no ids
            codes[bounds[i]] = len(size) + 1 + len(others)
            others.append(self.whole(" " + text if after_space else text) if text else [])
        sizes = np.array([0, *map(len, others)], np.int64)
        begin = np.concatenate([begin, len(ids) + np.cumsum(sizes) - sizes])
        size = np.concatenate([size, sizes])
        ids = np.concatenate([ids, *[np.array(o, "<u4") for o in others]])
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + 8 * BLOCK, "right")) - 1)
            here = codes[bounds[lo]: bounds[hi]]
            n_ids = size[here]
            yield ids[_ragged(begin[here], n_ids)], np.add.reduceat(n_ids, bounds[lo:hi] - bounds[lo]), lo, hi
            lo = hi

    def cut(self, text: str) -> list[str]:
        """A long text in parts that encode alone: each but the first goes on after a space left out."""
        import re

        if not self.split or any(" " in s for s in self.special):
            return [text]
        out, at, safe = [], 0, re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
        while len(text) - at > CHUNK:
            m = safe.search(text, at + CHUNK // 2)
            if m is None:
                break
            out.append(text[at: m.start()])
            at = m.end()
        return [*out, text[at:]]

    def chunked(self, column: pa.Array):
        """(ids, number of ids of each row, first row, end) of runs of rows."""
        for lo, hi in common.chunks(column, CHUNK):
            rows = column.slice(lo, hi - lo).cast(pa.string())
            if hi - lo == 1 and (pc.binary_length(rows)[0].as_py() or 0) > 2 * CHUNK:
                made = [x[0] for k, part in enumerate(self.cut(rows[0].as_py())) for x in self.encode(pa.array([part]), k > 0)]
                yield np.concatenate(made), np.array([sum(map(len, made))]), lo, hi
            else:
                for ids, sizes, a, b in self.encode(rows):
                    yield ids, sizes, lo + a, lo + b


@functools.cache
def encoder(path: str) -> Encoder:
    """This process's encoder of a vocabulary; Python workers run many tasks."""
    return Encoder(path)


def write(docs: DataFrame, out_dir: str, tokenizer: str, *, key: str = "doc_id", text: str = "text", order: list | None = None, end_id: int = 2, width: int = 2) -> DataFrame:
    """Encode ``docs`` and write the files to ``out_dir``; returns the manifest.

    ``order``: columns to order by (default: the key).  ``width``: bytes of an
    id, 2 or 4; ids that don't fit are an error.  Rows are dealt out by ranges
    of the order, with a hash of the text as the last column so that rows of one
    key can part.
    """
    kind = {2: "<u2", 4: "<u4"}[width]
    spark = docs.sparkSession
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), *[c.alias(f"o{i}") for i, c in enumerate(order or [docs[key]])])
    by = [f"o{i}" for i in range(len(order or [key]))]
    rows = rows.repartitionByRange(*by, F.xxhash64("text")).sortWithinPartitions(*by, F.xxhash64("text")).select("key", "text")
    key_type = rows.schema["key"].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder = encoder(tokenizer)
        fs, folder = common.filesystem(out_dir)
        stem = f"part-{part:06d}-{uuid.uuid4().hex}"
        fs.create_dir(folder, recursive=True)
        n_docs, at = 0, 0
        out = off = keys = keys_file = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out, off = fs.open_output_stream(f"{folder}/{stem}.bin"), fs.open_output_stream(f"{folder}/{stem}.off")
                off.write(np.array([0], "<i8").tobytes())
                keys_file = fs.open_output_stream(f"{folder}/{stem}.doc")
                keys = pa.ipc.new_stream(keys_file, pa.schema([("key", batch.schema.field("key").type)]))
            for ids, sizes, lo, hi in coder.chunked(batch.column("text")):
                if width == 2 and ids.size and ids.max() > 0xFFFF:
                    raise ValueError("an id doesn't fit 2 bytes; use width=4")
                # each row's ids, and the end id behind them
                ends = np.cumsum(sizes + 1)
                row = np.full(int(ends[-1]), end_id, kind)
                row[np.arange(len(ids)) + np.repeat(np.arange(hi - lo), sizes)] = ids
                out.write(row.tobytes())
                off.write((at + ends).astype("<i8").tobytes())
                at += int(ends[-1])
            keys.write_batch(pa.record_batch([batch.column("key")], names=["key"]))
            n_docs += batch.num_rows
        if out is not None:
            keys.close()
            for f in (keys_file, off, out):
                f.close()
            common.release()
            yield pa.RecordBatch.from_pydict({"part": [part], "stem": [stem], "n_docs": [n_docs], "n_tokens": [at]}, schema=pa.schema([("part", pa.int64()), ("stem", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    parts = common.written(rows.mapInArrow(encode, "part long, stem string, n_docs long, n_tokens long"), "token-parts")
    # One row for each part file, so this window's single partition holds a few bytes for each.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))
    base.withColumn("width", F.lit(width)).write.parquet(f"{out_dir}/manifest")
    return spark.read.parquet(f"{out_dir}/manifest").withColumn("key_type", F.lit(key_type.simpleString()))


def read(spark: SparkSession, out_dir: str, key_type: str = "long", *, ids: bool = False) -> DataFrame:
    """The documents in the files: key, start, n_tokens, ids_crc32, and with ``ids`` the ids.

    The files are memory-mapped where they are local files, else read by range.
    """
    manifest = spark.read.parquet(f"{out_dir}/manifest")
    n = max(1, manifest.count())
    schema = f"key {key_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, folder = common.filesystem(out_dir)
        opened = pa.memory_map if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file
        for batch in batches:
            for row in batch.to_pylist():
                kind, width = {2: "<u2", 4: "<u4"}[row["width"]], row["width"]
                stem = f"{folder}/{row['stem']}"
                with opened(f"{stem}.bin") as data, opened(f"{stem}.off") as off, fs.open_input_stream(f"{stem}.doc") as keys:
                    done = 0
                    for part in pa.ipc.open_stream(keys):
                        at = np.frombuffer(off.read_at(8 * (part.num_rows + 1), 8 * done), "<i8")
                        done += part.num_rows
                        crc, held = np.zeros(part.num_rows, np.int64), []
                        for i in range(part.num_rows):
                            x = np.frombuffer(data.read_at(int(at[i + 1] - at[i]) * width, int(at[i]) * width), kind).astype("<u4")
                            crc[i] = zlib.crc32(x.tobytes())
                            if ids:
                                held.append(x.astype(np.int64))
                        columns = [part.column(0), pa.array(at[:-1] + row["base"]), pa.array(np.diff(at)), pa.array(crc)]
                        names = ["key", "start", "n_tokens", "ids_crc32"]
                        yield pa.RecordBatch.from_arrays(columns + ([pa.array(held, pa.list_(pa.int64()))] if ids else []), names=names + ["ids"] * ids)

    return manifest.repartition(n, "part").mapInArrow(load, schema)
