"""Event file formats to and from arrays: pure functions on bytes."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np

Columns = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]

# Names that columns of text and array files go by.
ROLES = {
    "x": {"x", "xs", "x_pos", "x_coordinate", "col", "column"},
    "y": {"y", "ys", "y_pos", "y_coordinate", "row"},
    "t": {"t", "ts", "time", "times", "timestamp", "timestamps", "t_us"},
    "p": {"p", "ps", "pol", "polarity", "polarities", "on"},
}


def role(name: str) -> str | None:
    """x, y, t or p of a column's name."""
    name = name.strip().lower()
    return next((r for r, names in ROLES.items() if name in names), None)


def header_of(head: bytes) -> tuple[int, bytes]:
    """Length of a ``%`` header, and its text."""
    at = 0
    while head[at: at + 1] == b"%":
        end = head.find(b"\n", at)
        if end < 0:
            break
        at = end + 1
    return at, head[:at]


def geometry(header: bytes) -> tuple[int, int] | None:
    """Sensor size in a header, if it says one."""
    text = header.decode("latin-1").lower()
    if m := re.search(r"geometry[ =:]+(\d+)x(\d+)", text):
        return int(m[1]), int(m[2])
    w, h = re.search(r"width[ =:]+(\d+)", text), re.search(r"height[ =:]+(\d+)", text)
    return (int(w[1]), int(h[1])) if w and h else None


def decode_dat(data: bytes) -> Columns:
    """8-byte records: 32 bits of time, then x (14), y (14), polarity (1)."""
    r = np.frombuffer(data, "<u4").reshape(-1, 2)
    a = r[:, 1]
    return (a & 0x3FFF).astype(np.int32), (a >> 14 & 0x3FFF).astype(np.int32), r[:, 0].astype(np.int64), (a >> 28 & 1).astype(bool)


def encode_dat(x, y, t, p) -> bytes:
    t = np.asarray(t, np.int64)
    if len(t) and (t.min() < 0 or t.max() > 0xFFFFFFFF):
        raise ValueError("times must fit 32 bits")
    a = np.asarray(x, np.uint32) & 0x3FFF | (np.asarray(y, np.uint32) & 0x3FFF) << 14 | np.asarray(p, np.uint32) << 28
    return np.column_stack([t.astype(np.uint32), a]).astype("<u4").tobytes()


def dat_header(width: int, height: int) -> bytes:
    return f"% Data file containing CD events.\n% Version 2\n% Width {width}\n% Height {height}\n% end\n".encode() + bytes([0x0C, 8])


def _held(mask: np.ndarray, values: np.ndarray, before: int = 0) -> np.ndarray:
    """Each place's latest value where the mask was set, ``before`` if it never was."""
    at = np.where(mask, np.arange(len(mask)), -1)
    at = np.maximum.accumulate(at)
    return np.where(at < 0, before, values[np.maximum(at, 0)])


def _unwrapped(high: np.ndarray, mask: np.ndarray, bits: int) -> np.ndarray:
    """High time parts with the wraps counted in."""
    seen = high[mask].astype(np.int64)
    wraps = np.concatenate([[0], np.cumsum(np.diff(seen) < -(1 << bits - 1))]) if len(seen) else np.zeros(0, np.int64)
    out = np.zeros(len(high), np.int64)
    out[mask] = seen + (wraps << bits)
    return out


@dataclass(frozen=True)
class RawState:
    """What a ``.raw`` decoder knows at some word: a checkpoint that decoding can go on from."""

    high: int | None = None
    wraps: int = 0
    low: int = 0
    y: int = 0
    base: int = 0
    on: int = 0


def read_evt2(data: bytes, state: RawState = RawState()) -> tuple[np.ndarray, ...]:
    """32-bit words: OFF (0) and ON (1) with 6 low bits of time, 11 of x and y; TIME_HIGH (8) with 28 bits.

    x, y, t, p, and each event's place: the number of its word.
    """
    w = np.frombuffer(data[: len(data) // 4 * 4], "<u4")
    led = state.high is not None
    if led:
        w = np.concatenate([np.array([8 << 28 | state.high], "<u4"), w])
    kind = w >> 28
    tick = kind == 8
    high = _held(tick, _unwrapped(w & 0x0FFFFFFF, tick, 28)) + (state.wraps << 28)
    ok = np.flatnonzero((kind < 2) & np.logical_or.accumulate(tick)) if len(w) else np.zeros(0, np.int64)
    w, high, kind = w[ok], high[ok], kind[ok]
    return (w >> 11 & 0x7FF).astype(np.int32), (w & 0x7FF).astype(np.int32), high << 6 | (w >> 22 & 0x3F).astype(np.int64), kind == 1, ok - led


def decode_evt2(data: bytes) -> Columns:
    """All events of a file's words: x, y, t, p."""
    return read_evt2(data)[:4]


def decode_evt3(data: bytes) -> Columns:
    """All events of a file's words: x, y, t, p."""
    return read_evt3(data)[:4]


def scan_evt2(data: bytes) -> dict:
    """What a stretch of words does to a decoder's state."""
    w = np.frombuffer(data[: len(data) // 4 * 4], "<u4")
    return _scanned_ticks((w & 0x0FFFFFFF)[w >> 28 == 8], 28)


def _scanned_ticks(ticks: np.ndarray, bits: int) -> dict:
    if not len(ticks):
        return {}
    return {"first": int(ticks[0]), "high": int(ticks[-1]), "wraps": int((np.diff(ticks.astype(np.int64)) < -(1 << bits - 1)).sum())}


def scan_evt3(data: bytes) -> dict:
    """What a stretch of words does to a decoder's state; ``moved`` is how far vectors go on from the last base."""
    w = np.frombuffer(data[: len(data) // 2 * 2], "<u2").astype(np.int64)
    kind, body = w >> 12, w & 0xFFF
    out = _scanned_ticks(body[kind == 8], 12)
    times = np.flatnonzero((kind == 6) | (kind == 8))
    if len(times):
        out["low"] = int(body[times[-1]]) if kind[times[-1]] == 6 else 0
    rows, bases = np.flatnonzero(kind == 0), np.flatnonzero(kind == 3)
    if len(rows):
        out["y"] = int(body[rows[-1]] & 0x7FF)
    since = int(bases[-1]) if len(bases) else 0
    out["moved"] = int(12 * (kind[since:] == 4).sum() + 8 * (kind[since:] == 5).sum())
    if len(bases):
        out |= {"base": int(body[since] & 0x7FF), "on": int(body[since] >> 11 & 1)}
    return out


def after(state: RawState, done: dict, bits: int) -> RawState:
    """The state behind a stretch that was scanned."""
    wraps = state.wraps + done.get("wraps", 0)
    if "first" in done and state.high is not None:
        wraps += done["first"] - state.high < -(1 << bits - 1)
    return RawState(done.get("high", state.high), wraps, done.get("low", state.low), done.get("y", state.y), done.get("base", state.base) + done.get("moved", 0), done.get("on", state.on))


def encode_evt2(x, y, t, p) -> bytes:
    t = np.asarray(t, np.int64)
    if len(t) and ((np.diff(t) < 0).any() or t[0] < 0):
        raise ValueError("times must not go backwards")
    high = t >> 6
    new = np.ones(len(t), bool)
    new[1:] = high[1:] != high[:-1]
    events = np.asarray(p, np.uint32) << 28 | (t & 0x3F).astype(np.uint32) << 22 | np.asarray(x, np.uint32) << 11 | np.asarray(y, np.uint32)
    ticks = np.uint32(8) << np.uint32(28) | (high & 0x0FFFFFFF).astype(np.uint32)
    out = np.zeros(len(t) + int(new.sum()), "<u4")
    at = np.arange(len(t)) + np.cumsum(new)
    out[at] = events
    out[at[new] - 1] = ticks[new]
    return out.tobytes()


def read_evt3(data: bytes, state: RawState = RawState()) -> tuple[np.ndarray, ...]:
    """16-bit words with state: y (0), x with polarity (2), vectors (3 base, 4 of 12, 5 of 8), time low (6) and high (8).

    x, y, t, p, and each event's place: the number of its word, by 12, and its place in the vector.
    """
    w = np.frombuffer(data[: len(data) // 2 * 2], "<u2").astype(np.int64)
    lead = [] if state.high is None else [8 << 12 | state.high, 6 << 12 | state.low]
    lead += [state.y, 3 << 12 | state.on << 11 | state.base & 0x7FF]
    w = np.concatenate([np.array(lead, np.int64), w])
    kind, body = w >> 12, w & 0xFFF
    tick = kind == 8
    high = _held(tick, _unwrapped(body, tick, 12)) + (state.wraps << 12)
    low = _held((kind == 6) | tick, np.where(kind == 6, body, 0))
    t = high << 12 | low
    y = _held(kind == 0, body & 0x7FF)
    base = kind == 3
    length = np.where(kind == 4, 12, np.where(kind == 5, 8, 0))
    moved = np.cumsum(length)
    start = _held(base, body & 0x7FF) + moved - length - _held(base, moved)
    pol = _held(base, body >> 11 & 1)
    begun = np.logical_or.accumulate(tick)
    one = np.flatnonzero((kind == 2) & begun)
    vec = np.flatnonzero((length > 0) & begun)
    row, col = np.nonzero((body[vec, None] >> np.arange(12) & 1).astype(bool) & (np.arange(12) < length[vec][:, None]))
    at = np.concatenate([one, vec[row]])
    place = np.concatenate([one, vec[row]]) * 12 + np.concatenate([np.zeros(len(one), np.int64), col])
    xs = np.concatenate([body[one] & 0x7FF, start[vec[row]] + col])
    ps = np.concatenate([body[one] >> 11 & 1, pol[vec[row]]])
    order = np.argsort(place, kind="stable")
    at = at[order]
    return xs[order].astype(np.int32), y[at].astype(np.int32), t[at], ps[order].astype(bool), place[order] - 12 * len(lead)


def encode_evt3(x, y, t, p) -> bytes:
    t = np.asarray(t, np.int64)
    if len(t) and ((np.diff(t) < 0).any() or t[0] < 0):
        raise ValueError("times must not go backwards")
    out, high, low, row = [], None, None, None
    for a, b, c, d in zip(np.asarray(x).tolist(), np.asarray(y).tolist(), t.tolist(), np.asarray(p).tolist()):
        if c >> 12 != high:
            high, low = c >> 12, None
            out.append(0x8000 | high & 0xFFF)
        if c & 0xFFF != low:
            low = c & 0xFFF
            out.append(0x6000 | low)
        if b != row:
            row = b
            out.append(b)
        out.append(0x2000 | int(bool(d)) << 11 | a)
    return np.array(out, "<u2").tobytes()


def decode_aedat2(data: bytes, height: int) -> Columns:
    """8-byte big-endian records of address and time; y counts from the bottom, the 32-bit clock wraps."""
    r = np.frombuffer(data[: len(data) // 8 * 8], ">u4").reshape(-1, 2).astype(np.int64)
    r = r[r[:, 0] >> 31 == 0]
    clock = r[:, 1]
    wraps = np.concatenate([[0], np.cumsum(np.diff(clock) < -(1 << 31))]) if len(clock) else clock
    a = r[:, 0]
    return (a >> 12 & 0x3FF).astype(np.int32), (height - 1 - (a >> 22 & 0x1FF)).astype(np.int32), clock + (wraps << 32), (a >> 11 & 1).astype(bool)


def encode_aedat2(x, y, t, p, height: int) -> bytes:
    a = np.asarray(x, np.int64) << 12 | (height - 1 - np.asarray(y, np.int64)) << 22 | np.asarray(p, np.int64) << 11
    return np.column_stack([a, np.asarray(t, np.int64) & 0xFFFFFFFF]).astype(">u4").tobytes()


def encode_udp(x, y, p, t=None, most: int = 1400) -> list[bytes]:
    """Datagrams of 32-bit words: x with its top bit set, y with polarity as its top bit; a time word after each if given."""
    w = (np.asarray(x, np.uint32) | 0x8000) << 16 | np.asarray(p, np.uint32) << 15 | np.asarray(y, np.uint32) & 0x7FFF
    words = w[:, None] if t is None else np.column_stack([w, np.asarray(t, np.int64) & 0x7FFFFFFF])
    per = most // (4 * words.shape[1])
    return [words[i: i + per].astype("<u4").tobytes() for i in range(0, len(words), per)]


def decode_udp(packet: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """x, y, p and the times if the datagram has them: every second word then lacks the top bit."""
    w = np.frombuffer(packet[: len(packet) // 4 * 4], "<u4")
    timed = len(w) > 1 and len(w) % 2 == 0 and not (w[1::2] >> 31).any()
    e = w[::2] if timed else w
    e = e[e >> 31 == 1]
    return (e >> 16 & 0x7FFF).astype(np.int32), (e & 0x7FFF).astype(np.int32), (e >> 15 & 1).astype(bool), w[1::2].astype(np.int64) if timed else None


def parse_text(data: bytes, order: str, offset: int, scale: float) -> tuple[np.ndarray, ...]:
    """Events of whole lines: columns, and each line's byte offset."""
    rows, at = [], offset
    place = [order.index(c) for c in "xytp"]
    for line in data.split(b"\n"):
        size = len(line) + 1
        text = line.partition(b"#")[0].replace(b",", b" ").split()
        if len(text) >= 4:
            try:
                v = [float(text[i]) for i in place]
            except ValueError:
                at += size
                continue
            if v[0] != int(v[0]) or v[1] != int(v[1]):
                raise ValueError(f"a pixel isn't whole: {line!r}")
            rows.append((int(v[0]), int(v[1]), int(np.floor(abs(v[2] * scale) + 0.5) * (1 if v[2] >= 0 else -1)), v[3] > 0, at))
        at += size
    x, y, t, p, s = zip(*rows) if rows else ((),) * 5
    return np.array(x, np.int32), np.array(y, np.int32), np.array(t, np.int64), np.array(p, bool), np.array(s, np.int64)


def e2vid_lines(width: int, height: int, x, y, t, p) -> str:
    """The text of ``width height``, then seconds, x, y, polarity."""
    return f"{width} {height}\n" + "".join(f"{a / 1e6:.6f} {b} {c} {int(d)}\n" for a, b, c, d in zip(t, x, y, p))


def pack_header(*lines: str) -> bytes:
    return "".join(f"% {x}\n" for x in lines).encode()


def rosbag_time(us: int) -> bytes:
    """A time as seconds and nanoseconds."""
    return struct.pack("<II", us // 1_000_000, us % 1_000_000 * 1000)
