"""Vectorised word hashing for whole Arrow string columns (numpy, no per-word Python)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Lower-cases ASCII letters; ASCII white space, controls and punctuation become blanks. Other bytes stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
for _c in range(128):
    if not chr(_c).isalnum():
        FOLD[_c] = 32
#: Keeps every byte but ASCII white space, which becomes a blank.
RAW = np.arange(256, dtype=np.uint8)
RAW[[9, 10, 11, 12, 13, 28, 29, 30, 31]] = 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, a bijection on 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = _MUL) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) and not pa.types.is_large_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]] if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def words(col: pa.Array, fold: np.ndarray = FOLD, step: int = 2 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: 64-bit hash, row, first byte and end byte within its row's text. Works on runs of rows of about
    ``step`` bytes, which bounds the memory of the sums."""
    data, off = buffers(col)
    parts, at = [], 0
    while at < len(off) - 1:
        stop = max(at + 1, int(np.searchsorted(off, off[at] + step, side="right")) - 1)
        h, row, s, e = _words(data[off[at] : off[stop]], off[at : stop + 1] - off[at], fold)
        parts.append((h, row + at, s, e))
        at = stop
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return _words(data[:0], np.zeros(1, np.int64), fold)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _words(data: np.ndarray, off: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    data = fold[data]
    solid = data != 32
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last[:-1] &= ~solid[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * up[:n], out=sums[1:])
    h = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    row = np.searchsorted(off, s, side="right") - 1
    return h, row, s - off[row], e - off[row]


def grams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all word n-grams; a row with fewer words has one gram of all its words."""
    if not len(h):
        return h, row
    k = np.uint64(0x100000001B3)
    m = len(h) - n + 1
    if m > 0:
        g = h[:m].copy()
        for i in range(1, n):
            g = g * k + h[i : m + i]
        whole = row[:m] == row[n - 1 :]
        g, r = mix(g[whole]), row[:m][whole]
    else:
        g, r = h[:0], row[:0]
    count = np.bincount(row)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        start = np.searchsorted(row, short)
        extra = np.empty(len(short), np.uint64)
        for j, (s, d) in enumerate(zip(start, short)):
            x = np.uint64(0)
            for v in h[s : s + count[d]]:
                x = np.uint64((int(x) * int(k) + int(v)) & 0xFFFFFFFFFFFFFFFF)
            extra[j] = x
        g, r = np.concatenate([g, mix(extra + np.uint64(n))]), np.concatenate([r, short])
        o = np.argsort(r, kind="stable")
        g, r = g[o], r[o]
    return g, r
