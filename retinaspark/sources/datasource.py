"""Recordings as a Spark data source: ``spark.read.format("events").load("recording.raw")``, and a table of events written as part files.

    spark.dataSource.register(EventFiles)

Options of reading: ``format`` (default: by the path's ending), ``order`` and
``time_unit`` of text.  Options of writing: ``format`` (dat, raw or text) and the
sensor's ``width`` and ``height``; each task writes a file of its own, in the order
it gets the rows in.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..schema import EVENT_SCHEMA
from . import codecs, files


class Stretch(InputPartition):
    """A range of a file's bytes, and the decoder's state where it starts."""

    def __init__(self, lo: int, hi: int, state: codecs.RawState = codecs.RawState()) -> None:
        super().__init__((lo, hi))
        self.lo, self.hi, self.state = lo, hi, state


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class EventReader(DataSourceReader):
    """Reads formats whose ranges decode apart: dat, text, and raw after a scan for its states."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.kind = options.get("format") or files.detect_format(self.path)
        self.order, self.unit = options.get("order", "txyp"), options.get("time_unit", "us")
        if self.kind not in ("dat", "text", "raw"):
            raise ValueError(f"{self.kind} files are read by load()")

    def _plain(self):
        """(ranges, decoder) of formats without state."""
        made, _ = files._text(None, self.path, self.order, self.unit) if self.kind == "text" else files._dat(None, self.path)
        return made

    def _raw(self):
        """(start, size, bytes of a word, bits of the time's high part, scanner, decoder, places of a word) of a raw file."""
        head, size = files._head(self.path)
        start, text = codecs.header_of(head)
        if b"evt 3" in text.lower() or b"evt3" in text.lower():
            return start, size, 2, 12, codecs.scan_evt3, codecs.read_evt3, 12
        return start, size, 4, 28, codecs.scan_evt2, codecs.read_evt2, 1

    def partitions(self) -> list[Stretch]:
        if self.kind != "raw":
            return [Stretch(lo, hi) for lo, hi in self._plain()[0]]
        start, size, unit, bits, scan, _, _ = self._raw()
        out, state, (f, p) = [], codecs.RawState(), files._fs(self.path)
        ranges = [(start + a, start + b) for a, b in files._ranges(0, size - start, unit)]
        with f.open_input_file(p) as raw:
            for lo, hi in ranges:
                out.append(Stretch(lo, hi, state))
                if len(ranges) > 1:
                    state = codecs.after(state, scan(raw.read_at(hi - lo, lo)), bits)
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        f, p = files._fs(self.path)
        lo, hi = partition.lo, partition.hi
        with f.open_input_file(p) as raw:
            if self.kind != "raw":
                columns = self._plain()[1](raw, lo, hi)
            else:
                start, _, unit, _, _, work, places = self._raw()
                *columns, place = work(raw.read_at(hi - lo, lo), partition.state)
                columns.append(place + (lo - start) // unit * places)
        for i in range(0, len(columns[0]), 500_000):
            yield files._batch(*(c[i: i + 500_000] for c in columns))


class EventWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.kind = options["path"], options.get("format", "dat")
        self.size = int(options["width"]), int(options["height"])
        if self.kind not in ("dat", "raw", "text"):
            raise ValueError(f"{self.kind} files are written by save()")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        f, p = files._fs(self.path)
        f.create_dir(p, recursive=True)
        name, sink, n = f"part-{uuid.uuid4().hex}.{ {'dat': 'dat', 'raw': 'raw', 'text': 'txt'}[self.kind] }", None, 0
        for batch in iterator:
            if batch.num_rows:
                sink = sink or files.EventSink(f"{self.path.rstrip('/')}/{name}", *self.size, format=self.kind)
                sink._write([np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in "xytp"])
                n += batch.num_rows
        if sink is not None:
            sink.finish()
        return Written(f"{p}/{name}" if n else "", n)

    def commit(self, messages) -> None:
        """Files of tasks that ran twice have other names than those that count; they go."""
        f, p = files._fs(self.path)
        kept = {m.path.rsplit("/", 1)[-1] for m in messages if m is not None and m.path}
        from pyarrow import fs

        for info in f.get_file_info(fs.FileSelector(p, allow_not_found=True)):
            if info.base_name.startswith("part-") and info.base_name not in kept:
                f.delete_file(info.path)


class EventFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "events"

    def schema(self) -> StructType:
        return EVENT_SCHEMA

    def reader(self, schema: StructType) -> EventReader:
        return EventReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> EventWriter:
        return EventWriter(dict(self.options))
