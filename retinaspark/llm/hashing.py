"""Hashes of words and word n-grams over whole Arrow batches, by numpy alone.

A word's hash is a polynomial over its bytes, read off prefix sums modulo
2**64, and mixed; an n-gram's is a polynomial over its words' hashes.  Both are
the same in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_R = 0x9E3779B97F4A7C15 | 1
_Q = 0xC2B2AE3D27D4EB4F | 1
_PIECE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base % 2**64, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
_cache: dict = {}


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _cache.get(base)
    if have is None or len(have[0]) <= n:
        n = max(n, _PIECE + 1024)
        have = _cache[base] = (_powers(base, n), _powers(pow(base, -1, 2**64), n))
    return have


#: True for the six bytes that part words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _spans(data: np.ndarray, space: np.ndarray, bounds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    word = ~space[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    if bounds is not None and len(bounds):
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _tables(_R, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def words(data: np.ndarray, bounds: np.ndarray | None = None, space: np.ndarray = SPACE):
    """(starts, ends, hashes) of the words in a byte array.

    ``bounds`` are offsets that no word crosses.  Long arrays are worked off in
    pieces, so that the extra memory stays bounded but for one longer word.
    """
    starts, ends = _spans(data, space, bounds)
    if len(data) <= _PIECE:
        return starts, ends, _hash(data, starts, ends)
    out, i = [], 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + _PIECE, "right")))
        hi = int(ends[j - 1])
        out.append(_hash(data[lo:hi], starts[i:j] - lo, ends[i:j] - lo))
        i = j
    return starts, ends, np.concatenate(out) if out else np.zeros(0, np.uint64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the rows' offsets in them (null: empty)."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    at = np.frombuffer(where, kind, count=column.offset + len(column) + 1)[column.offset:].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
    return np.frombuffer(data, np.uint8)[at[0]: at[-1]], at - at[0]


def batch_words(column: pa.Array, space: np.ndarray = SPACE):
    """(hashes, first word of each row and the end, starts, ends, bytes) of a string column."""
    data, at = buffers(column)
    starts, ends, hashes = words(data, at, space)
    return hashes, np.searchsorted(starts, at, "left"), starts, ends, data


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each position on that has as many; rows are not looked at."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    if n <= 8:
        out = np.zeros(m, np.uint64)
        for k in range(n):
            out = out * np.uint64(_Q) + hashes[k: k + m]
        return mix(out)
    out, step = [], _PIECE
    for lo in range(0, m, step):
        part = hashes[lo: min(lo + step, m) + n - 1]
        up, down = _tables(_Q, len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        k = len(part) - n + 1
        out.append(mix((sums[n:] - sums[:k]) * down[:k]))
    return np.concatenate(out)


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Positions whose n-gram lies in one row, given the rows' first words and the end."""
    m = total - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    row = np.searchsorted(first, np.arange(m), "right") - 1
    return np.flatnonzero(np.arange(m) + n <= first[row + 1])
