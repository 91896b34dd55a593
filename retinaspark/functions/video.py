"""Animated PNG and GIF files, written frame by frame."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable

import numpy as np


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_apng(out, images: Iterable[np.ndarray], count: int, fps: float) -> int:
    """Write ``count`` images of [H, W, 3] bytes to a binary file; returns how many there were."""
    n = seq = 0
    for image in images:
        image = np.ascontiguousarray(image, np.uint8)
        h, w = image.shape[:2]
        if n == 0:
            out.write(b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + _chunk(b"acTL", struct.pack(">II", count, 0)))
        out.write(_chunk(b"fcTL", struct.pack(">IIIIIHHBB", seq, w, h, 0, 0, 1000, int(round(fps * 1000)) if fps < 65 else 65000, 0, 0)))
        seq += 1
        data = zlib.compress(b"".join(b"\0" + r.tobytes() for r in image), 6)
        if n == 0:
            out.write(_chunk(b"IDAT", data))
        else:
            out.write(_chunk(b"fdAT", struct.pack(">I", seq) + data))
            seq += 1
        n += 1
    out.write(_chunk(b"IEND", b""))
    return n


def _lzw(pixels: np.ndarray) -> bytes:
    """GIF image data of 8-bit pixels in codes of nine bits: the table is cleared before codes would grow."""
    # 254 pixels between clear codes (256), the end code (257) last
    n = len(pixels)
    codes = np.insert(pixels.astype(np.uint16), np.arange(0, max(n, 1), 254), 256) if n else np.array([256], np.uint16)
    codes = np.append(codes, 257).astype(np.uint16)
    bits = (codes[:, None] >> np.arange(9) & 1).astype(np.uint8).ravel()
    data = np.packbits(bits, bitorder="little").tobytes()
    blocks = b"".join(bytes([len(data[i: i + 255])]) + data[i: i + 255] for i in range(0, len(data), 255))
    return bytes([8]) + blocks + b"\0"


def write_gif(out, images: Iterable[np.ndarray], fps: float) -> int:
    """Write images of [H, W, 3] bytes to a binary file in 252 colours (6 x 7 x 6 levels); returns how many there were."""
    levels = [np.round(np.linspace(0, 255, k)).astype(np.uint8) for k in (6, 7, 6)]
    palette = np.stack(np.meshgrid(*levels, indexing="ij"), axis=-1).reshape(-1, 3)
    table = palette.tobytes() + bytes(3 * (256 - len(palette)))
    n = 0
    for image in images:
        h, w = image.shape[:2]
        if n == 0:
            out.write(b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF7, 0, 0) + table + b"!\xff\x0bNETSCAPE2.0\x03\x01\0\0\0")
        i = [np.rint(image[..., c] / 255 * (k - 1)).astype(int) for c, k in enumerate((6, 7, 6))]
        out.write(b"!\xf9\x04" + struct.pack("<BHB", 4, max(2, int(round(100 / fps))), 0) + b"\0" + b"," + struct.pack("<HHHHB", 0, 0, w, h, 0) + _lzw((i[0] * 42 + i[1] * 6 + i[2]).ravel()))
        n += 1
    out.write(b";" if n else b"")
    return n


def save_video(frame, path: str, fps: float = 30.0, colors: str | None = None, clim: float | None = None, max_frames: int | None = None) -> int:
    """An animated PNG, or a GIF by the path's ending, of a sequence of frames, one scale for all: the largest extent of the first eight.

    Frames are made by the tasks and pass through the driver one by one, in order.
    """
    from ..operators import frames
    from . import render

    key = frame.keys[0]
    rows = frames.dense(frame).orderBy(key)
    if max_frames is not None:
        rows = rows.limit(int(max_frames))
    count = rows.count()
    first = [np.asarray(r["data"]).reshape(frame.shape) for r in rows.limit(8).collect()]
    scale = render.sequence_scale(first, frame.kind, clim)
    images = (render.render_frame(np.asarray(r["data"]).reshape(frame.shape), frame.kind, colors, clim=scale) for r in rows.toLocalIterator())
    with open(path, "wb") as out:
        return write_gif(out, images, fps) if path.lower().endswith(".gif") else write_apng(out, images, count, fps)
