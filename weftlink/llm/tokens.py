"""Vectorised word scanning and hashing over Arrow string columns.

A column is taken as its UTF-8 bytes; words are maximal runs of bytes outside a separator class.
Every word gets a 64-bit hash, every document a slice of the word arrays. A word's bytes are taken eight at a
time, each step a bijection of what is added, so words of up to eight bytes never collide with words as long as
they; others, and sequences of words, collide by chance only (about 2**-64 for two given ones).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_500_000

_P = np.uint64(0x9E3779B97F4A7C1B)
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_Q = np.random.default_rng(987654321).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

#: [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
PUNCT = np.zeros(256, bool)
PUNCT[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > SLICE_BYTES + 1:
        return _make_powers(n)
    if 0 not in _POW or len(_POW[0][0]) < n:
        _POW[0] = _make_powers(min(SLICE_BYTES + 1, 1 << n.bit_length()))
    return _POW[0]


def _make_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P), np.full(n, np.uint64(pow(int(_P), -1, 2**64)))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64's finaliser; a bijection for every seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; nulls are empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if off is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of stretches of bytes; what a stretch has beyond LONG bytes is digested by itself."""
    size = ends - starts
    room = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", room, strides=(1,))
    out = mix(mix(size.astype(np.uint64), 50) ^ (eight[starts] & _HEAD[np.minimum(size, 8)]), 51)
    live, d = np.flatnonzero(size > 8), 8
    while len(live) and d < LONG:
        out[live] = mix(out[live] ^ (eight[starts[live] + d] & _HEAD[np.minimum(size[live] - d, 8)]), 51)
        d += 8
        live = live[size[live] > d]
    for i in live.tolist():
        rest = int.from_bytes(hashlib.blake2b(data[starts[i] + LONG : ends[i]], digest_size=8).digest(), "little")
        out[i] = mix(out[i : i + 1] ^ np.uint64(rest), 52)[0]
    return out


@dataclass
class Words:
    """Words of consecutive documents: document d owns words bounds[d]:bounds[d+1]."""

    data: np.ndarray  # the bytes as given
    offsets: np.ndarray  # document byte offsets
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def scan(data: np.ndarray, offsets: np.ndarray, seps: np.ndarray = SPACE, lower: bool = False) -> Words:
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(data, offsets, z, z, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    low = _LOWER[data] if lower else data
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~seps[low]
    begin = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begin[cuts] = inside[1:-1][cuts]
    end[cuts - 1] = inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(data, offsets, starts, ends, word_hashes(low, starts, ends), np.searchsorted(starts, offsets))


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) in runs of rows of about `limit` bytes; a longer text is a run of its own."""
    data, offsets = column_bytes(col)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), rows)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A quick hash of the `size` bytes at every place, for choices that any hash serves, never for equality."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[:n], out=total[1:], dtype=np.uint64)
        return (total[size:] - total[:-size]) * down[: n - size + 1]


def grams(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word sequences within documents and the word at which each starts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total += hashes[j : j + n] * _Q[j % 64]
    good = np.ones(n, bool)
    for b in bounds[1:-1]:
        good[max(0, b - k + 1) : b] = False
    at = np.flatnonzero(good)
    return mix(total[at], 1), at


def sequence_hash(hashes: np.ndarray) -> np.ndarray:
    """One hash for a whole sequence of words, apart from those of grams()."""
    with np.errstate(over="ignore"):
        total = np.uint64(len(hashes))
        for j, h in enumerate(hashes):
            total = total + h * _Q[j % 64]
        return mix(np.array([total], np.uint64), 2)
