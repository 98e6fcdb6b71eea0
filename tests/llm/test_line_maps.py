"""The maps of line sets, and the postings that open lines ask for."""

import numpy as np
import pyarrow as pa

from cuesta.llm import linededup
from cuesta.llm._text import mix64


def batch(sets):
    words = np.concatenate(sets)
    raw = words.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :6]
    ends = np.cumsum([0, *map(len, sets)]) * 6
    n = [len(s) for s in sets]
    return pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int64()), pa.array(n, pa.int32()), pa.array(range(len(n)), pa.int64()), linededup._binary(raw, ends)], names=["lid", "n", "k1", "words"])


def test_words_shared_do_not_hide_words_that_differ():
    """Two long lines with 0.7 of their words in common are no candidates, though they share a rare word."""
    pool = np.unique(mix64(np.arange(1, 4001, dtype=np.uint64)) & linededup.M48)
    rng, left = np.random.default_rng(0), 0
    for _ in range(100):
        some = rng.choice(pool, 92, replace=False)
        one, two = np.sort(some[:80]), np.sort(np.concatenate([some[12:80], some[80:]]))
        _, _, _, n, _, bits, more, _ = linededup._prefixes(batch([one, two]), np.full(1 << linededup.BITS, 9, np.uint8), 80)
        first = [np.flatnonzero(n == 80)[0], len(n) - 1]
        apart = int(np.bitwise_count(bits[first[0]] ^ bits[first[1]])) + int(np.bitwise_count(more[first[0]] ^ more[first[1]]))
        assert apart <= 24  # as many words as differ, at most
        left += apart > 14
    assert left > 85  # 160 - 2 * 72 = 16 may differ


def test_similar_sizes_are_in_classes_side_by_side():
    for percent in (50, 80, 85, 99, 100):
        for n in range(1, 3000):
            most = n * 100 // percent
            word = np.full(3, 77, np.uint64)
            asked = {int(linededup._places(word[:1], np.array([n]), percent, step)[0]) for step in (-1, 0, 1)}
            sizes = np.array([n, most, -(-n * percent // 100)])
            assert set(linededup._places(word, sizes, percent).tolist()) <= asked
