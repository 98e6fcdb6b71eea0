"""Sets of lines as arrays: prefixes, maps and size classes.

The Arrow form of line deduplication used these; no query does now.  They stay
for ``tests/llm/test_line_maps.py``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ._text import mix64, text_bytes

BITS = 20
NEAR = 24  # bits of a map of (word, size class)

M48, M40 = np.uint64((1 << 48) - 1), np.uint64((1 << 40) - 1)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of bytes; ends are the n + 1 boundaries in data."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 48-bit hashes of a column of sets, and the boundaries of its rows."""
    raw, ends = text_bytes(column)
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view(np.uint64).ravel(), ends // 6


def _prefixes(batch: pa.RecordBatch, rarity: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Postings of a batch of (lid, n, k1, words): word, grade, lid, n, place, two halves of a 128-bit map, k1."""
    lid, n, k = (np.asarray(batch.column(j)) for j in range(3))
    words, ends = _hashes(batch.column(3))
    place = words >> np.uint64(41)
    flag = np.uint64(1) << (place & np.uint64(63))
    maps = [np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == j, flag, np.uint64(0)), ends[:-1]) for j in range(2)]
    row = np.repeat(np.arange(len(n)), n)
    keys = (row.astype(np.uint64) << np.uint64(48)) | (rarity[(words & np.uint64((1 << BITS) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(40)) | (words & M40)
    keys.sort()
    spot = np.arange(len(keys)) - ends[:-1][row]
    grade = ((keys >> np.uint64(40)) & np.uint64(255)).astype(np.uint8)
    lone = np.zeros(len(n), bool)
    lone[np.unique(k, return_index=True)[1]] = True  # copies within the batch post once, by the first
    lone &= n * 100 // percent > n  # other sizes admit equal sets only
    keep = lone[row] & (grade > 0) & (spot < (n + (-n * percent) // 100 + 1)[row])
    at = row[keep]
    return keys[keep] & M40, grade[keep], lid[at], n[at], spot[keep].astype(np.int32), maps[0][at], maps[1][at], k[at]


def _places(word: np.ndarray, n: np.ndarray, percent: int, step: int = 0) -> np.ndarray:
    """The bit of a word in the size class ``step`` from that of n.  Sizes that can be similar are one class apart at most:
    a class is a little wider than the ratio of such sizes, so that rounding moves none further."""
    size = np.floor(np.log(n) / (1.0001 * max(np.log(100 / percent), 0.01))).astype(np.int64) + step
    return (mix64(word ^ ((size + 1).astype(np.uint64) << np.uint64(40))) >> np.uint64(64 - NEAR)).astype(np.int64)
