"""AEDAT 4 files: packets of FlatBuffers, packed with LZ4, Zstandard or not at all.

Reading: the packets' headers are walked once, eight bytes each, and ranges of
packets are decoded by tasks.  Writing: packets of a bounded number of events.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import files

# The format's first line, its numbers of packings, and an event's layout.
MAGIC = b"#!AER-DAT4.0\r\n"
PACKINGS = {0: None, 1: "lz4", 2: "lz4", 3: "zstd", 4: "zstd"}
EVENT = np.dtype({"names": ["t", "x", "y", "p"], "formats": ["<i8", "<i2", "<i2", "u1"], "offsets": [0, 8, 10, 12], "itemsize": 16})
FRAME_FORMATS = {0: 1, 8: 2, 16: 3, 24: 4}


class Table:
    """A FlatBuffers table: its fields by number, at their places in the bytes."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at
        self.shape = at - struct.unpack_from("<i", data, at)[0]
        self.size, = struct.unpack_from("<H", data, self.shape)

    @classmethod
    def root(cls, data: bytes) -> "Table":
        """Of bytes that start with their length."""
        return cls(data, 4 + struct.unpack_from("<I", data, 4)[0])

    def place(self, field: int) -> int | None:
        entry = 4 + 2 * field
        offset = struct.unpack_from("<H", self.data, self.shape + entry)[0] if entry < self.size else 0
        return self.at + offset if offset else None

    def number(self, field: int, kind: str, default):
        at = self.place(field)
        return default if at is None else struct.unpack_from(kind, self.data, at)[0]

    def vector(self, field: int) -> tuple[int, int]:
        """(first byte, length) of a vector or string."""
        at = self.place(field)
        if at is None:
            return 0, 0
        at += struct.unpack_from("<I", self.data, at)[0]
        return at + 4, struct.unpack_from("<I", self.data, at)[0]


def _unpacked(data: bytes, how: str | None) -> bytes:
    return data if how is None else pa.input_stream(pa.BufferReader(data), compression=how).read()


def header(path: str) -> dict:
    """packing, end of the header, place of the packet table (or -1), and streams: number to (kind, (width, height) or None)."""
    head, _ = files._head(path)
    if not head.startswith(MAGIC):
        raise ValueError("not an AEDAT 4 file")
    n, = struct.unpack_from("<I", head, len(MAGIC))
    if len(MAGIC) + 4 + n > len(head):
        head, _ = files._head(path, len(MAGIC) + 4 + n)
    table = Table.root(head[len(MAGIC): len(MAGIC) + 4 + n])
    at, size = table.vector(2)
    streams = {}
    for node in ElementTree.fromstring(table.data[at: at + size] or b"<dv/>").iter("node"):
        attrs = {a.get("key"): a.text for a in node.findall("attr")}
        if "typeIdentifier" in attrs and (node.get("name") or "").isdigit():
            info = {a.get("key"): a.text for child in node.findall("node") for a in child.findall("attr")}
            streams[int(node.get("name"))] = attrs["typeIdentifier"], (int(info["sizeX"]), int(info["sizeY"])) if {"sizeX", "sizeY"} <= set(info) else None
    return {"packing": PACKINGS[table.number(0, "<i", 0)], "start": len(MAGIC) + 4 + n, "table": table.number(1, "<q", -1), "streams": streams}


def packets(path: str, about: dict) -> Iterator[tuple[int, int, int]]:
    """(stream, first byte, size) of each packet."""
    f, p = files._fs(path)
    with f.open_input_file(p) as raw:
        end = about["table"] if about["table"] > 0 else raw.size()
        at = about["start"]
        while at + 8 <= end:
            stream, size = struct.unpack("<ii", raw.read_at(8, at))
            yield stream, at + 8, size
            at += 8 + size


def _events(data: bytes) -> np.ndarray:
    at, n = Table.root(data).vector(0)
    return np.frombuffer(data, EVENT, n, at)


def read(spark: SparkSession, path: str, stream: int | None = None) -> tuple[DataFrame, tuple[int, int] | None]:
    """The events of a stream (default: the first of events), and the sensor's size."""
    about = header(path)
    kinds = {k: v for k, v in about["streams"].items() if v[0] == "EVTS"}
    if stream is None:
        stream = min(kinds, default=0)
    ranges: list[list[int]] = []
    for number, at, size in packets(path, about):
        if ranges and at + size - ranges[-1][0] <= files.RANGE:
            ranges[-1][1] = at + size
        else:
            ranges.append([at - 8, at + size])
    how = about["packing"]

    def decode(raw, lo, hi):
        data, at, parts, places = raw.read_at(hi - lo, lo), 0, [], []
        while at + 8 <= len(data):
            number, size = struct.unpack_from("<ii", data, at)
            if number == stream:
                e = _events(_unpacked(data[at + 8: at + 8 + size], how))
                parts.append(e)
                # a packet's place in the file, then the event's in the packet
                places.append((np.int64(lo + at) << 24) + np.arange(len(e)))
            at += 8 + size
        e = np.concatenate(parts) if parts else np.zeros(0, EVENT)
        return e["x"].astype(np.int32), e["y"].astype(np.int32), e["t"].astype(np.int64), e["p"] > 0, np.concatenate(places) if places else np.zeros(0, np.int64)

    return files._decoded(spark, path, [tuple(r) for r in ranges] or [(0, 0)], decode), kinds.get(stream, (None, None))[1]


def read_frames(path: str, stream: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(time, [H, W] or [H, W, C] bytes) of a stream of frames, one after the other."""
    about = header(path)
    if stream is None:
        stream = min((k for k, v in about["streams"].items() if v[0] == "FRME"), default=-1)
    f, p = files._fs(path)
    with f.open_input_file(p) as raw:
        for number, at, size in packets(path, about):
            if number == stream:
                data = _unpacked(raw.read_at(size, at), about["packing"])
                t = Table.root(data)
                c, w, h = FRAME_FORMATS[t.number(5, "<b", 0)], t.number(6, "<h", 0), t.number(7, "<h", 0)
                first, n = t.vector(10)
                image = np.frombuffer(data, np.uint8, n, first).reshape(h, w, c)
                yield t.number(0, "<q", 0), image[..., 0] if c == 1 else image


def file_header(width: int, height: int, packing: int = 1) -> bytes:
    """What a file with one stream of events starts with."""
    info = (
        '<dv version="2.0"><node name="outInfo" path="/outInfo/"><node name="0" path="/outInfo/0/">'
        f'<attr key="compression" type="string">{["NONE", "LZ4", "LZ4_HIGH", "ZSTD", "ZSTD_HIGH"][packing]}</attr>'
        '<attr key="typeIdentifier" type="string">EVTS</attr>'
        f'<node name="info" path="/outInfo/0/info/"><attr key="sizeX" type="int">{width}</attr><attr key="sizeY" type="int">{height}</attr></node>'
        "</node></node></dv>"
    ).encode()
    # root, name, shape of the table (two bytes of padding before it), the table: packing, no packet table, the text's place
    body = struct.pack("<I4s5H2x", 20, b"IOHE", 10, 20, 4, 8, 16) + struct.pack("<iiqI", 12, packing, -1, 4) + struct.pack("<I", len(info)) + info + b"\0"
    return MAGIC + struct.pack("<I", len(body)) + body


def packet(x, y, t, p, packing: int = 1) -> bytes:
    """Events as a packet of stream 0."""
    e = np.zeros(len(t), EVENT)
    e["t"], e["x"], e["y"], e["p"] = t, x, y, p
    body = struct.pack("<I4s3H2x", 16, b"EVTS", 6, 8, 4) + struct.pack("<iI", 8, 4) + struct.pack("<I", len(e)) + e.tobytes()
    data = struct.pack("<I", len(body)) + body
    if PACKINGS[packing]:
        out = pa.BufferOutputStream()
        with pa.output_stream(out, compression=PACKINGS[packing]) as packed:
            packed.write(data)
        data = out.getvalue().to_pybytes()
    return struct.pack("<ii", 0, len(data)) + data
