"""Vectorised access to the text column of Arrow batches.

Everything here works on the UTF-8 bytes of a slice of rows at once, so no
Python object is made for a word or a character.  Slices are bounded in bytes
(``CHUNK_BYTES``); a longer text forms a slice of its own.  Null texts count
as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of the near-duplicate and language-model contracts: anything but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Words of the decontamination contract: digits, letters and all that is not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BYTE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    size = max(CHUNK_BYTES, 1 << max(1, n - 1).bit_length())
    if size not in _POWERS:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        both = []
        for b in (_BASE, inverse):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS.clear()
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the row boundaries (n + 1 offsets from 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of at most ``limit`` bytes, or one row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


class Words:
    """The words of a slice of rows: start, end (bytes), row, and a 64-bit hash of each.

    ``first[i]:first[i + 1]`` are row i's words.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashed: bool = True, lower: bool = True):
        self.data = LOWER[raw] if lower else raw
        inside = np.zeros(len(raw) + 2, dtype=bool)
        inside[1:-1] = table[self.data]
        cut = np.zeros(len(raw) + 1, dtype=bool)
        cut[offsets] = True
        at, was = inside[1:], inside[:-1]
        self.start = np.flatnonzero(at & (~was | cut))
        self.end = np.flatnonzero(was & (~at | cut))
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        if hashed:
            up, down = _powers(len(raw) + 1)
            total = np.zeros(len(raw) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.data] * up[: len(raw)], out=total[1:])
            self._total, self._down = total, down
            self.hash = mix64((total[self.end] - total[self.start]) * down[self.start])

    def prefix_hash(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words longer than k bytes, and hashes of their first k bytes (equal to a k-byte word's)."""
        at = np.flatnonzero(self.end - self.start > k)
        a = self.start[at]
        return at, mix64((self._total[a + k] - self._total[a]) * self._down[a])

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def joined(self, i: int, j: int) -> bytes:
        """Words i to j - 1 with a space between."""
        return b" ".join(self.word(k) for k in range(i, j))


def run_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n consecutive words within a row, and the index of each run's first word."""
    h = words.hash
    if len(h) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    m = len(h) - n + 1
    out = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[j : j + m]
    at = np.flatnonzero(words.row[:m] == words.row[n - 1 :])
    return mix64(out[at]), at


def key64(data: bytes) -> int:
    """A stable signed 64-bit hash of bytes."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)
