"""Reading recordings into streams and writing them out.

Parquet is the native form: sorted by time, so windows prune row groups.  Other
formats are read by tasks: fixed-size records and text in byte ranges, formats
whose decoder has state a file at a time.  ``seq`` is the place in the file, so
it doesn't depend on partitions.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import scale_us
from ..schema import EVENT_SCHEMA, SensorMeta
from ..stream import EventStream
from . import codecs

#: Formats that were added: name to a function of (spark, path) that gives (DataFrame of events, sensor size or None).
READERS: dict = {}
#: Bytes of a file that one task decodes, where ranges can be decoded apart.
RANGE = 32 << 20
FORMATS = {".parquet": "parquet", ".txt": "text", ".csv": "text", ".npz": "npz", ".dat": "dat", ".raw": "raw", ".aedat": "aedat2", ".h5": "hdf5", ".hdf5": "hdf5", ".bag": "rosbag", ".aedat4": "aedat4", ".zip": "e2vid", ".png": "png"}
NAMES = ["x", "y", "t", "p", "seq"]


def register_format(name: str, suffix: str, read) -> None:
    """Add a format: files with the suffix are read by ``read(spark, path)``, which gives (x, y, t, p, seq) and the sensor's size or None."""
    FORMATS[suffix.lower()], READERS[name] = name, read


def detect_format(path: str) -> str:
    try:
        return FORMATS[PurePosixPath(path).suffix.lower()]
    except KeyError:
        raise ValueError(f"no format is known for {path!r}") from None


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else str(PurePosixPath("/") / path))


def _head(path: str, n: int = 1 << 16) -> tuple[bytes, int]:
    f, p = _fs(path)
    with f.open_input_file(p) as raw:
        return raw.read(n), raw.size()


def _batch(x, y, t, p, seq) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((x, y, t, p, seq), types)], names=NAMES)


def _decoded(spark: SparkSession, path: str, ranges: list[tuple[int, int]], decode) -> DataFrame:
    """``decode(bytes, offset) -> (x, y, t, p, seq)`` over byte ranges of a file; without a session the two as they are."""
    if spark is None:
        return ranges, decode
    jobs = spark.createDataFrame(ranges, "lo long, hi long").repartition(max(1, len(ranges)), "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, p = _fs(path)
        for batch in batches:
            for lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                with f.open_input_file(p) as raw:
                    columns = decode(raw, lo, hi)
                for i in range(0, len(columns[0]), 500_000):
                    yield _batch(*(c[i: i + 500_000] for c in columns))

    return jobs.mapInArrow(run, EVENT_SCHEMA)


def _ranges(start: int, size: int, unit: int = 1) -> list[tuple[int, int]]:
    step = RANGE // unit * unit
    return [(lo, min(lo + step, size)) for lo in range(start, size, step)] or [(start, start)]


def _sized(df: DataFrame, size: tuple[int, int] | None) -> EventStream:
    if size is None:
        r = df.agg(F.max("x"), F.max("y")).first()
        size = (0, 0) if r[0] is None else (r[0] + 1, r[1] + 1)
    w, h = size
    inside = df.where((F.col("x") >= 0) & (F.col("x") < w) & (F.col("y") >= 0) & (F.col("y") < h))
    return EventStream(inside, SensorMeta(w, h))


def from_numpy(spark: SparkSession, events, *, sensor_size=None, time_unit: str = "us", order: str = "xytp") -> EventStream:
    """An (N, 4) array or a structured one as a stream; coordinates are rounded, p > 0 is ON."""
    a = np.asarray(events)
    if a.dtype.names:
        named = {codecs.role(n): a[n] for n in a.dtype.names}
        cols = [np.asarray(named[c], float) for c in "xytp"]
    else:
        cols = [a[:, order.index(c)].astype(float) for c in "xytp"]
    rnd = lambda v: (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(np.int64)
    if len(cols[0]) and (min(cols[0].min(), cols[1].min()) < -0.5 or max(cols[0].max(), cols[1].max()) > 65535.4):
        raise ValueError("a coordinate is off any sensor")
    table = pa.Table.from_batches([_batch(rnd(cols[0]), rnd(cols[1]), rnd(cols[2] * scale_us(time_unit)), cols[3] > 0, np.arange(len(cols[0])))])
    df = spark.createDataFrame(table, schema=EVENT_SCHEMA) if len(cols[0]) else spark.createDataFrame([], EVENT_SCHEMA)
    return _sized(df, sensor_size)


def _text(spark, path, order, unit):
    head, size = _head(path)
    start, names = 0, None
    for line in head.split(b"\n"):
        fields = line.replace(b",", b" ").lstrip(b"#").split()
        roles = [codecs.role(f.decode("latin-1")) for f in fields]
        if line.startswith(b"#") or not line.strip() or {"x", "y", "t", "p"} <= set(roles):
            if {"x", "y", "t", "p"} <= set(roles):
                names = [r or "-" for r in roles]
            start += len(line) + 1
            continue
        break
    order = names or list(order)
    scale = scale_us(unit)

    def decode(raw, lo, hi):
        # a line belongs to the range that it starts in
        raw.seek(max(lo - 1, start))
        at = raw.tell()
        if lo > start:
            at += len(raw.readline())
        if at >= hi:
            return codecs.parse_text(b"", order, 0, scale)
        raw.seek(at)
        data = raw.read(hi - at)
        if data and not data.endswith(b"\n"):
            data += raw.readline()
        return codecs.parse_text(data, order, at, scale)

    return _decoded(spark, path, _ranges(min(start, size), size), decode), None


def _npz(spark, path):
    f, p = _fs(path)
    with f.open_input_file(p) as raw, np.load(io.BytesIO(raw.read())) as z:
        size = None
        if "event_data" in z:
            e = z["event_data"]
            cols = [e[c] for c in "xytp"]
            size = (640, 480)
            if len(e) and (e["x"].max() >= 640 or e["y"].max() >= 480):
                raise ValueError("an event is off the sensor")
        else:
            cols = [z[c] for c in "xytp"]
            if "width" in z:
                size = int(z["width"]), int(z["height"])
    n = len(cols[0])
    table = pa.Table.from_batches([_batch(cols[0].astype(np.int32), cols[1].astype(np.int32), cols[2].astype(np.int64), cols[3] > 0, np.arange(n))])
    return (spark.createDataFrame(table, schema=EVENT_SCHEMA) if n else spark.createDataFrame([], EVENT_SCHEMA)), size


def _dat(spark, path):
    head, size = _head(path)
    start, text = codecs.header_of(head)
    start += 2

    def decode(raw, lo, hi):
        x, y, t, p = codecs.decode_dat(raw.read_at((hi - lo) // 8 * 8, lo))
        return x, y, t, p, np.arange(len(x)) + (lo - start) // 8

    return _decoded(spark, path, [(start + a, start + b) for a, b in _ranges(0, size - start, 8)], decode), codecs.geometry(text)


def _whole(spark, path, start, size, work):
    def decode(raw, lo, hi):
        x, y, t, p = work(raw.read_at(hi - lo, lo))
        return x, y, t, p, np.arange(len(x))

    return _decoded(spark, path, [(start, size)], decode)


def _raw(spark, path):
    """Ranges of words are scanned first; that gives each range the decoder's state where it starts, then all are decoded apart."""
    head, size = _head(path)
    start, text = codecs.header_of(head)
    evt3 = b"evt 3" in text.lower() or b"evt3" in text.lower()
    unit, bits, scan, work = (2, 12, codecs.scan_evt3, codecs.read_evt3) if evt3 else (4, 28, codecs.scan_evt2, codecs.read_evt2)
    ranges = [(start + a, start + b) for a, b in _ranges(0, size - start, unit)]
    state, states = codecs.RawState(), {}
    if len(ranges) > 1:
        jobs = spark.createDataFrame(ranges, "lo long, hi long").repartition(len(ranges), "lo")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f, p = _fs(path)
            for batch in batches:
                for lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                    with f.open_input_file(p) as raw:
                        yield pa.RecordBatch.from_pydict({"lo": [lo], "done": [json.dumps(scan(raw.read_at(hi - lo, lo)))]})

        # a short row for each range of a file
        done = {r["lo"]: json.loads(r["done"]) for r in jobs.mapInArrow(run, "lo long, done string").collect()}
    for lo, _ in ranges:
        states[lo] = state
        if len(ranges) > 1:
            state = codecs.after(state, done[lo], bits)

    def decode(raw, lo, hi):
        x, y, t, p, place = work(raw.read_at(hi - lo, lo), states[lo])
        return x, y, t, p, place + (lo - start) // unit * (12 if evt3 else 1)

    return _decoded(spark, path, ranges, decode), codecs.geometry(text)


def _aedat2(spark, path, sensor_size):
    head, size = _head(path)
    start = 0
    while head[start: start + 1] == b"#":
        start = head.find(b"\n", start) + 1
    w, h = sensor_size or codecs.geometry(head[:start]) or (240, 180)
    return _whole(spark, path, start, size, lambda data: codecs.decode_aedat2(data, h)), (w, h)


def load(spark: SparkSession, path: str, *, format: str | None = None, sensor_size=None, time_unit: str = "us", order: str = "txyp", offset: int | None = None, max_events: int | None = None, topic: str | None = None) -> EventStream:
    """A recording as a stream.  ``offset`` cuts by time first, then ``max_events`` by number; ``topic`` is for bags."""
    kind = format or detect_format(path)
    if kind in READERS:
        df, size = READERS[kind](spark, path)
    elif kind == "parquet":
        df, size = spark.read.parquet(path), None
        if "width" in df.columns:
            r = df.select("width", "height").first()
            size = None if r is None else tuple(r)
        df = df.select("x", "y", "t", "p", "seq")
    elif kind == "text":
        df, size = _text(spark, path, order, time_unit)
    elif kind == "npz":
        df, size = _npz(spark, path)
    elif kind == "dat":
        df, size = _dat(spark, path)
    elif kind == "raw":
        df, size = _raw(spark, path)
    elif kind == "aedat2":
        df, size = _aedat2(spark, path, sensor_size)
    elif kind == "aedat4":
        from . import aedat4

        df, size = aedat4.read(spark, path)
    elif kind == "rosbag":
        from .rosbag import read_bag

        df, size = read_bag(spark, path, topic=topic).df, None
    else:
        raise NotImplementedError(f"{kind} files need a library that isn't part of this package")
    s = _sized(df, sensor_size or size)
    if offset is not None:
        s = s.with_(s.df.where(F.col("t") >= int(offset)))
    if max_events is not None:
        s = s.with_(s.df.orderBy("seq").limit(int(max_events)))
    return s


def save(s: EventStream, path: str, *, format: str | None = None, evt: int = 2) -> None:
    """Write a stream.  Parquet is written by all tasks, ordered by time ranges; other formats are one file, written from
    batches in order that pass through the driver one by one."""
    kind = format or detect_format(path)
    w, h = s.sensor_size
    if kind == "parquet":
        s.df.select("x", "y", "t", "p", "seq", F.lit(w).alias("width"), F.lit(h).alias("height")).repartitionByRange("t", "seq").sortWithinPartitions("t", "seq").write.parquet(path)
        return
    if kind == "rosbag":
        from .rosbag import write_bag

        write_bag(s, path)
        return
    with EventSink(path, w, h, format=kind, evt=evt) as sink:
        sink.append(s)


def by_ranges(df: DataFrame, rows: int = 200_000) -> Iterator[list[np.ndarray]]:
    """The columns of stretches of a DataFrame, in order: tasks pack ``rows`` rows or so each, the driver has one at a time."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def packed():
            out = io.BytesIO()
            np.savez(out, *[np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(held[0].num_columns)])
            return pa.RecordBatch.from_pydict({"data": [out.getvalue()]}, schema=pa.schema([("data", pa.binary())]))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= rows:
                yield packed()
                held, n = [], 0
        if held:
            yield packed()

    for r in df.mapInArrow(pack, "data binary").toLocalIterator(prefetchPartitions=True):
        with np.load(io.BytesIO(bytes(r["data"]))) as z:
            yield [z[name] for name in z.files]


class _Forward:
    """An output stream that an archive can be written to from front to back."""

    def __init__(self, out) -> None:
        self.out = out

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        self.out.flush()


class EventSink:
    """Writes windows of a stream to one file as they come; later windows must not go back in time for ``raw``."""

    def __init__(self, path: str, width: int, height: int, *, format: str | None = None, evt: int = 2) -> None:
        self.kind, self.path, self.size, self.evt = format or detect_format(path), path, (width, height), evt
        if self.kind not in ("text", "npz", "dat", "raw", "aedat2", "e2vid-text", "e2vid", "aedat4"):
            raise NotImplementedError(f"{self.kind} files can't be written")
        f, p = _fs(path)
        self.out, self.n_events, self.last, self.parts = f.open_output_stream(p), 0, None, []
        self.zip = None
        if self.kind == "e2vid":
            # one text file in the archive, packed as it comes
            self.file, self.zip = self.out, zipfile.ZipFile(_Forward(self.out), "w", zipfile.ZIP_DEFLATED)
            self.out = self.zip.open("events.txt", "w", force_zip64=True)
        self.out.write({"dat": codecs.dat_header(width, height), "raw": codecs.pack_header(f"evt {evt}.0", f"geometry {width}x{height}"), "aedat2": b"#!AER-DAT2.0\r\n# geometry %dx%d\r\n" % (width, height), "e2vid-text": f"{width} {height}\n".encode(), "e2vid": f"{width} {height}\n".encode(), "aedat4": b""}.get(self.kind, b""))

    def append(self, s: EventStream) -> None:
        if s.sensor_size != self.size:
            raise ValueError("the sensor's size has changed")
        # ranges of the order come one by one, each as columns
        ordered = s.df.select("x", "y", "t", "p", "seq").orderBy("seq").select("x", "y", "t", "p")
        for columns in by_ranges(ordered):
            self._write(columns)

    def _write(self, columns: list) -> None:
        x, y, t, p = columns
        if self.kind in ("raw", "e2vid-text", "e2vid") and ((np.diff(t) < 0).any() or self.last is not None and t[0] < self.last):
            raise ValueError("times must not go backwards")
        self.last = int(t[-1])
        self.n_events += len(t)
        if self.kind == "text":
            self.out.write("".join(f"{c} {a} {b} {int(d)}\n" for a, b, c, d in zip(x, y, t, p)).encode())
        elif self.kind in ("e2vid-text", "e2vid"):
            self.out.write(codecs.e2vid_lines(*self.size, x, y, t, p).split("\n", 1)[1].encode())
        elif self.kind == "dat":
            self.out.write(codecs.encode_dat(x, y, t, p))
        elif self.kind == "raw":
            self.out.write((codecs.encode_evt2 if self.evt == 2 else codecs.encode_evt3)(x, y, t, p))
        elif self.kind == "aedat4":
            from . import aedat4

            if self.n_events == len(t):
                self.out.write(aedat4.file_header(*self.size))
            for i in range(0, len(t), 8192):
                self.out.write(aedat4.packet(*(c[i: i + 8192] for c in (x, y, t, p))))
        elif self.kind == "aedat2":
            self.out.write(codecs.encode_aedat2(x, y, t, p, self.size[1]))
        else:
            self.parts.append((x, y, t, p))

    def flush(self) -> None:
        self.out.flush()

    def finish(self) -> None:
        if self.kind == "aedat4" and not self.n_events:
            from . import aedat4

            self.out.write(aedat4.file_header(*self.size))
        if self.kind == "npz":
            cols = [np.concatenate(c) if self.parts else np.zeros(0) for c in (zip(*self.parts) if self.parts else [()] * 4)]
            buffer = io.BytesIO()
            np.savez(buffer, x=cols[0].astype(np.uint16), y=cols[1].astype(np.uint16), t=cols[2].astype(np.int64), p=cols[3].astype(np.uint8), width=np.uint64(self.size[0]), height=np.uint64(self.size[1]), timestamp_scale_ms=0.001)
            self.out.write(buffer.getvalue())
        self.out.close()
        if self.zip is not None:
            self.zip.close()
            self.file.close()

    def __enter__(self) -> "EventSink":
        return self

    def __exit__(self, *_) -> None:
        self.finish()


def save_frame(frame, path: str, colors: str | None = None, normalize: bool = True) -> None:
    """A single frame as npz or PNG."""
    from ..functions import render
    from ..operators import frames

    data = frames.numpy(frame)
    f, p = _fs(path)
    with f.open_output_stream(p) as out:
        if path.endswith(".png"):
            out.write(render.png(render.render_frame(data, frame.kind, colors, normalize)))
        else:
            buffer = io.BytesIO()
            np.savez(buffer, data=data, kind=frame.kind, channel_names=np.array(frame.channels))
            out.write(buffer.getvalue())


def load_frame(path: str) -> tuple[np.ndarray, str, list[str]]:
    """data, kind and channel names of a frame in npz, or a PNG as grey."""
    from ..functions import render

    f, p = _fs(path)
    with f.open_input_file(p) as raw:
        data = raw.read()
    if path.endswith(".png"):
        image = render.read_png(data)
        return (image[..., 0] if image.shape[2] < 3 else render.luma(image))[None], "intensity", ["intensity"]
    with np.load(io.BytesIO(data)) as z:
        return z["data"], str(z["kind"]), [str(c) for c in z["channel_names"]]


def save_mask(mask: np.ndarray, path: str) -> None:
    from ..functions import render

    f, p = _fs(path)
    with f.open_output_stream(p) as out:
        out.write(render.png(np.where(mask, 255, 0).astype(np.uint8)))


def load_mask(path: str) -> np.ndarray:
    """True where a PNG isn't black or wholly transparent."""
    from ..functions import render

    f, p = _fs(path)
    with f.open_input_file(p) as raw:
        image = render.read_png(raw.read())
    alpha = image[..., -1] > 0 if image.shape[2] in (2, 4) else True
    colour = image[..., : image.shape[2] - (image.shape[2] in (2, 4))]
    return (colour > 0).any(axis=2) & alpha


def export_png(frame, out_dir: str, colors: str | None = None, normalize: bool = True, prefix: str = "frame_", start: int = 0, digits: int = 5) -> DataFrame:
    """A PNG file for each frame, written by the tasks; returns the keys and paths."""
    from ..functions import render
    from ..operators import frames

    keys, shape, kind = list(frame.keys), frame.shape, frame.kind
    rows = frames.dense(frame)
    number = F.col(keys[0]) if keys else F.lit(0)
    schema = rows.select(*keys, F.lit("").alias("path")).schema

    def run(batches):
        f, folder = _fs(out_dir)
        f.create_dir(folder, recursive=True)
        for pdf in batches:
            paths = []
            for data, n in zip(pdf["data"], pdf["n"]):
                path = f"{folder}/{prefix}{int(n) + start:0{digits}d}.png"
                with f.open_output_stream(path) as out:
                    out.write(render.png(render.render_frame(np.asarray(data).reshape(shape), kind, colors, normalize)))
                paths.append(path)
            yield pdf.assign(path=paths)[[*keys, "path"]]

    return rows.withColumn("n", number).mapInPandas(run, schema)
