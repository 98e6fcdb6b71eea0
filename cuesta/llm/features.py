"""Dense features of texts, computed for a slice of rows at once from the UTF-8 bytes.

``FEATURES`` names the columns.  Rates are per word, per letter or per byte;
empty texts give zeros.
"""

from __future__ import annotations

import numpy as np

from ._text import NOT_SPACE, Words

FEATURES = [
    "log_words",
    "capital_share",
    "digit_share",
    "punctuation_share",
    "exclamations_per_word",
    "symbols_per_word",
    "bars_per_word",
    "repeat_share",
    "distinct_share",
    "word_bytes",
    "lines_per_word",
    "short_line_share",
    "capital_word_share",
    "marked_word_share",
    "mixed_word_share",
    "bare_word_share",
]


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars.encode())] = True
    return t


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER_CASE = _table("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _table("0123456789")
_MARKS = _table("!\"'(),-.:;?")
_SYMBOLS = _table("#$%&*+/<=>@[\\]^_`{|}~")


def dense(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, len(FEATURES)) float64 for the texts raw[offsets[i]:offsets[i + 1]]."""
    n = len(offsets) - 1
    words = Words(raw, offsets, NOT_SPACE)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    def by_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(words.row, values, n)

    def inside(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[words.end] - total[words.start]

    upper, lower = _UPPER[raw], _LOWER_CASE[raw]
    digit, mark, symbol = _DIGIT[raw], _MARKS[raw], _SYMBOLS[raw]
    size = np.maximum(np.diff(offsets), 1).astype(float)
    w = np.maximum(words.counts, 1).astype(float)
    up_in, low_in, digit_in = inside(upper), inside(lower), inside(digit)
    odd_in = inside(mark | symbol)
    length = (words.end - words.start).astype(float)
    same = np.zeros(len(words.hash), dtype=bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    distinct = np.array([len(np.unique(words.hash[a:b])) for a, b in zip(words.first[:-1], words.first[1:], strict=True)], dtype=float)
    breaks = np.flatnonzero(raw == 10)
    lines = count(raw == 10) + (np.diff(offsets) > 0)
    line_of = np.searchsorted(breaks, words.start)  # lines of different rows differ in row
    new_line = np.ones(len(line_of), dtype=bool)
    new_line[1:] = (line_of[1:] != line_of[:-1]) | (words.row[1:] != words.row[:-1])
    at = np.flatnonzero(new_line)
    short = np.bincount(words.row[at], np.diff(np.append(at, len(line_of))) < 4, n)
    filled = np.maximum(np.bincount(words.row[at], minlength=n), 1)
    ends_odd = (mark | symbol)[words.end - 1] if len(words.end) else np.zeros(0, bool)
    return np.column_stack(
        [
            np.log1p(words.counts),
            count(upper) / np.maximum(count(upper) + count(lower), 1),
            count(digit) / size,
            count(mark | symbol) / size,
            count(raw == ord("!")) / w,
            count(symbol) / w,
            count(raw == ord("|")) / w,
            by_word(same) / w,
            distinct / w,
            by_word(length) / w,
            lines / w,
            short / filled,
            by_word((up_in > 1) & (low_in == 0)) / w,
            by_word(ends_odd) / w,
            by_word((odd_in + digit_in - ends_odd > 0) & (up_in + low_in > 0)) / w,
            by_word(odd_in == length) / w,
        ]
    )
