"""ROS 1 bags: event arrays, IMU samples, images and camera calibrations.

A bag's index at its end lists connections and chunks; each chunk is a task, and
chunks outside a time range aren't read.  Chunks are plain or bz2; others need a
library that isn't part of this package.
"""

from __future__ import annotations

import bz2
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.camera import Camera
from ..stream import EventStream
from .files import _decoded, _fs, _sized

MAGIC = b"#ROSBAG V2.0\n"
#: The topic that is read unless another is named.
TOPIC = "/davis/left/events"
# Record kinds.
MESSAGE, BAG, INDEX, CHUNK, CHUNK_INFO, CONNECTION = 2, 3, 4, 5, 6, 7
EVENT = np.dtype([("x", "<u2"), ("y", "<u2"), ("s", "<u4"), ("ns", "<u4"), ("p", "u1")])


def _fields(data: bytes) -> dict[str, bytes]:
    out, at = {}, 0
    while at < len(data):
        n, = struct.unpack_from("<I", data, at)
        name, _, value = data[at + 4: at + 4 + n].partition(b"=")
        out[name.decode()] = value
        at += 4 + n
    return out


def _records(data: bytes) -> Iterator[tuple[int, dict[str, bytes], bytes]]:
    """(kind, header, body) of the records in a stretch of a bag."""
    at = 0
    while at < len(data):
        n, = struct.unpack_from("<I", data, at)
        head = _fields(data[at + 4: at + 4 + n])
        m, = struct.unpack_from("<I", data, at + 4 + n)
        yield head["op"][0], head, data[at + 8 + n: at + 8 + n + m]
        at += 8 + n + m


def _u32(b: bytes) -> int:
    return struct.unpack("<I", b)[0]


def _time(b: bytes) -> int:
    s, ns = struct.unpack("<II", b)
    return s * 1_000_000 + ns // 1000


def index(path: str) -> tuple[dict[int, tuple[str, str]], list[tuple[int, int, int, int]]]:
    """Connections (topic, type) by number, and chunks (start, end, first time, last time)."""
    fs, p = _fs(path)
    with fs.open_input_file(p) as raw:
        size = raw.size()
        if raw.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a ROS 1 bag")
        n, = struct.unpack("<I", raw.read(4))
        at = struct.unpack("<Q", _fields(raw.read(n))["index_pos"])[0]
        raw.seek(at)
        tail = raw.read(size - at)
    connections, chunks = {}, []
    for kind, head, body in _records(tail):
        if kind == CONNECTION:
            connections[_u32(head["conn"])] = head["topic"].decode(), _fields(body)["type"].decode()
        elif kind == CHUNK_INFO:
            chunks.append((struct.unpack("<Q", head["chunk_pos"])[0], _time(head["start_time"]), _time(head["end_time"])))
    chunks.sort()
    ends = [c[0] for c in chunks[1:]] + [at]
    return connections, [(c[0], e, c[1], c[2]) for c, e in zip(chunks, ends)]


def topics(path: str) -> list[tuple[str, str]]:
    return sorted(set(index(path)[0].values()))


def _messages(data: bytes, wanted: set[int]) -> Iterator[tuple[int, bytes]]:
    """(time, body) of the wanted connections' messages in a chunk and what follows it."""
    for kind, head, body in _records(data):
        if kind != CHUNK:
            continue
        how = head["compression"]
        if how == b"bz2":
            body = bz2.decompress(body)
        elif how == b"lz4":
            body = pa.input_stream(pa.BufferReader(body), compression="lz4").read()
        elif how != b"none":
            raise NotImplementedError(f"chunks packed with {how.decode()} need a library that isn't part of this package")
        for inner, h, message in _records(body):
            if inner == MESSAGE and _u32(h["conn"]) in wanted:
                yield _time(h["time"]), message


def _header(m: bytes) -> tuple[int, int]:
    """The stamp of a message's header, and where the header ends."""
    n = _u32(m[12:16])
    return _time(m[4:12]), 16 + n


def _string(m: bytes, at: int) -> tuple[str, int]:
    n = _u32(m[at: at + 4])
    return m[at + 4: at + 4 + n].decode(), at + 4 + n


def _chosen(path: str, kind: str, topic: str | None) -> tuple[set[int], list]:
    connections, chunks = index(path)
    names = {t for t, k in connections.values() if k.endswith(kind)}
    if topic is None:
        topic = TOPIC if TOPIC in names else min(names, default=None)
    return {c for c, (t, _) in connections.items() if t == topic}, chunks


def read_bag(spark: SparkSession, path: str, *, topic: str | None = None, sensor_size=None) -> EventStream:
    """The events of a topic as a stream."""
    wanted, chunks = _chosen(path, "/EventArray", topic)

    def decode(raw, lo, hi):
        parts = []
        for _, m in _messages(raw.read_at(hi - lo, lo), wanted):
            _, at = _header(m)
            parts.append(np.frombuffer(m, EVENT, _u32(m[at + 8: at + 12]), at + 12))
        e = np.concatenate(parts) if parts else np.zeros(0, EVENT)
        t = e["s"].astype(np.int64) * 1_000_000 + e["ns"] // 1000
        # a chunk's place in the file, then the event's in the chunk
        return e["x"].astype(np.int32), e["y"].astype(np.int32), t, e["p"] > 0, (np.int64(lo) << 24) + np.arange(len(e))

    df = _decoded(spark, path, [(a, b) for a, b, *_ in chunks] or [(0, 0)], decode)
    return _sized(df, sensor_size)


def _side(path: str, kind: str, topic: str | None, t0: int | None, t1: int | None) -> Iterator[tuple[int, bytes]]:
    wanted, chunks = _chosen(path, kind, topic)
    fs, p = _fs(path)
    with fs.open_input_file(p) as raw:
        for a, b, first, last in chunks:
            if (t0 is not None and last < t0) or (t1 is not None and first >= t1):
                continue
            for _, m in _messages(raw.read_at(b - a, a), wanted):
                stamp, at = _header(m)
                if (t0 is None or stamp >= t0) and (t1 is None or stamp < t1):
                    yield stamp, m[at:]


def read_imu(spark: SparkSession, path: str, *, topic: str | None = None, t0_us: int | None = None, t1_us: int | None = None) -> DataFrame:
    """t, angular velocity and linear acceleration in SI units; IMU rates are a thousandth of event rates."""
    rows = []
    for t, m in _side(path, "/Imu", topic, t0_us, t1_us):
        v = struct.unpack_from("<37d", m)
        rows.append((t, list(v[13:16]), list(v[25:28])))
    return spark.createDataFrame(rows, "t long, angular_velocity array<double>, linear_acceleration array<double>")


def read_frames(path: str, *, topic: str | None = None, t0_us: int | None = None, t1_us: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(t, [H, W] image) one by one."""
    for t, m in _side(path, "/Image", topic, t0_us, t1_us):
        h, w = struct.unpack_from("<II", m)
        encoding, at = _string(m, 8)
        step, n = struct.unpack_from("<II", m, at + 1)
        data = m[at + 9: at + 9 + n]
        kind = np.dtype("<u2") if "16" in encoding else np.dtype("u1")
        image = np.frombuffer(data, kind).reshape(h, step // kind.itemsize)
        channels = 3 if encoding.startswith(("rgb", "bgr")) else 1
        image = image[:, : w * channels].reshape(h, w, channels)
        yield t, image[..., 0] if channels == 1 else image.mean(axis=2).astype(kind)


def read_camera_info(path: str, *, topic: str | None = None) -> Camera | None:
    for _, m in _side(path, "/CameraInfo", topic, None, None):
        _, at = _string(m, 8)
        n = _u32(m[at: at + 4])
        d = list(struct.unpack_from(f"<{n}d", m, at + 4)) + [0.0] * 5
        k = struct.unpack_from("<9d", m, at + 4 + 8 * n)
        return Camera(k[0], k[4], k[2], k[5], k1=d[0], k2=d[1], p1=d[2], p2=d[3], k3=d[4])
    return None


def _pack(fields: dict[str, bytes], body: bytes) -> bytes:
    head = b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k.encode() + b"=" + v for k, v in fields.items())
    return struct.pack("<I", len(head)) + head + struct.pack("<I", len(body)) + body


def _stamp(us: int) -> bytes:
    return struct.pack("<II", us // 1_000_000, us % 1_000_000 * 1000)


def write_bag(s: EventStream, path: str, topic: str = TOPIC, per_message: int = 100_000) -> None:
    """A stream as a bag of event arrays, a chunk for each message; batches pass through the driver in order."""
    w, h = s.sensor_size
    fs, p = _fs(path)
    link = _pack({"conn": struct.pack("<I", 0), "topic": topic.encode(), "op": bytes([CONNECTION])}, b"".join(struct.pack("<I", len(f)) + f for f in (b"topic=" + topic.encode(), b"type=dvs_msgs/EventArray", b"md5sum=*", b"message_definition=")))
    chunks, body = [], b""

    def chunk(rows):
        x, y, t, on = (np.array(c) for c in zip(*rows))
        e = np.zeros(len(rows), EVENT)
        e["x"], e["y"], e["s"], e["ns"], e["p"] = x, y, t // 1_000_000, t % 1_000_000 * 1000, on
        message = struct.pack("<I", len(chunks)) + _stamp(int(t[-1])) + struct.pack("<III", 0, h, w) + struct.pack("<I", len(e)) + e.tobytes()
        inner = link + _pack({"conn": struct.pack("<I", 0), "time": _stamp(int(t[-1])), "op": bytes([MESSAGE])}, message)
        return _pack({"compression": b"none", "size": struct.pack("<I", len(inner)), "op": bytes([CHUNK])}, inner), int(t[0]), int(t[-1])

    # the header says where the index is, so chunks go to a file beside it first
    with fs.open_output_stream(f"{p}.part") as part:
        at, held = 0, []

        def put():
            nonlocal at, held
            data, first, last = chunk(held)
            part.write(data)
            chunks.append((at, first, last))
            at, held = at + len(data), []

        for r in s.df.orderBy("seq").select("x", "y", "t", "p").toLocalIterator(prefetchPartitions=True):
            held.append(r)
            if len(held) == per_message:
                put()
        if held:
            put()
    blank = 4096
    start = len(MAGIC) + blank
    fields = {"index_pos": struct.pack("<Q", start + at), "conn_count": struct.pack("<I", 1), "chunk_count": struct.pack("<I", len(chunks)), "op": bytes([BAG])}
    bare = len(_pack(fields, b""))
    head = _pack(fields, b" " * (blank - bare))
    for pos, first, last in chunks:
        body += _pack({"ver": struct.pack("<I", 1), "chunk_pos": struct.pack("<Q", start + pos), "start_time": _stamp(first), "end_time": _stamp(last), "count": struct.pack("<I", 1), "op": bytes([CHUNK_INFO])}, struct.pack("<II", 0, 1))
    with fs.open_output_stream(p) as out, fs.open_input_stream(f"{p}.part") as part:
        out.write(MAGIC + head)
        while data := part.read(1 << 22):
            out.write(data)
        out.write(link + body)
    fs.delete_file(f"{p}.part")
