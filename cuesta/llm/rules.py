"""Quality rules: counts with fixed limits, and a hashed n-gram logistic regression with a calibrated probability.

The counts of a text are its words, their characters, symbols, repeated lines
and words in repeated windows of eight words.  Two limits on them decide
``base_failed``.  All other texts are judged by the model: its features are the
shares of hashed word 1- and 2-grams and of 3- and 5-byte sequences among the
text's own, learned from labelled rows by logistic regression, and its margin
is mapped to a probability by a sigmoid fitted on rows that the weights did not
see.  A text is kept if that probability is ``LEAST_PROBABILITY`` or more.

Learning uses a bounded sample of labelled rows (``MAX_ROWS``, the ids least by
hash); counts and scores are for whole texts.  Repeated lines are compared as
text, repeated windows by 64-bit hashes within one text.

Null and empty texts have no words, fail the limits and have the probability of
the prior.  Repeated labels count as often as they occur, null labels teach
nothing; with one class only, or none, the probability is that class's share
(without labels 1, so that the limits alone decide).  Repeated rows are judged
alike, an empty table gives an empty result, and columns of docs other than
doc_id and text pass through ``judged`` unless they have one of its names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import NOT_SPACE, Words, chunks, mix64, run_hashes, text_bytes
from .quality import labelled

MAX_ROWS = 2_000
BITS = 18
LEAST_PROBABILITY = 0.3
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of the words
WINDOW = 8
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Kinds of features: word 1- and 2-grams, 3- and 5-byte sequences; each kind's shares add up to 1.
KINDS = 4


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(words: Words, n: int = WINDOW) -> np.ndarray:
    """Words of each row inside runs of n words that the row holds twice or more."""
    h, at = run_hashes(words, n)
    inside = np.zeros(len(words.start) + 1, np.int64)
    order = np.lexsort((h, words.row[at]))
    h, row = h[order], words.row[at][order]
    same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    first = at[order[twice]]
    np.add.at(inside, first, 1)
    np.add.at(inside, first + n, -1)
    return np.bincount(words.row, np.cumsum(inside)[:-1] > 0, len(words.counts)).astype(np.int64)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def counts(texts: list[str], raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    words = Words(raw, offsets, NOT_SPACE, lower=False)
    starts = (raw & 0xC0) != 0x80  # a character's first byte
    return {
        "n_words": words.counts,
        "word_chars": _per_row(NOT_SPACE[raw] & starts, offsets),
        "n_symbols": _per_row(SYMBOLS[raw], offsets),
        "n_dup_lines": np.array([repeated_lines(t) for t in texts], np.int64),
        "n_repeat_words": repeated_words(words),
    }


def features(raw: np.ndarray, offsets: np.ndarray):
    """(row, bucket) of every n-gram occurrence, kind by kind; bucket < KINDS << BITS."""
    words = Words(raw, offsets, NOT_SPACE)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    shift = np.uint64(64 - BITS)
    yield words.row.astype(np.int32), (words.hash >> shift).astype(np.int32)
    h, at = run_hashes(words, 2)
    yield words.row[at].astype(np.int32), (h >> shift).astype(np.int32) + (1 << BITS)
    data = words.data.astype(np.uint64)
    for k, n in ((2, 3), (3, 5)):
        m = max(0, len(data) - n + 1)
        x = np.zeros(m, np.uint64)
        for j in range(n):
            x = (x << np.uint64(8)) | data[j : j + m]
        at = np.flatnonzero(row[:m] == row[n - 1 :]) if m else np.empty(0, np.int64)
        x = (x[at] * np.uint64(0x9E3779B97F4A7C15)) >> shift
        yield row[at], x.astype(np.int32) + (k << BITS)


class Judge:
    """weights by bucket, and the sigmoid from margin to probability."""

    def __init__(self, weights: np.ndarray | None, slope: float, level: float, prior: float):
        self.weights, self.slope, self.level, self.prior = weights, slope, level, prior

    def margin(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        out = np.zeros(n)
        for row, bucket in features(raw, offsets):
            out += np.bincount(row, self.weights[bucket], n) / np.maximum(np.bincount(row, minlength=n), 1)
        return out

    def probability(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(offsets) - 1, self.prior)
        z = self.slope * self.margin(raw, offsets) + self.level
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        return np.where(np.diff(offsets) == 0, self.prior, p)


def featured(sample: DataFrame) -> DataFrame:
    """sample(id, text, y) to (id, y, bucket, share): the distinct buckets of every text, packed."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                buckets, shares = [[] for _ in range(hi - lo)], [[] for _ in range(hi - lo)]
                for row, bucket in features(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
                    key, n = np.unique(row.astype(np.int64) << 32 | bucket, return_counts=True)
                    row, bucket = (key >> 32).astype(np.int64), (key & 0xFFFFFFFF).astype(np.int32)
                    total = np.bincount(row, n, hi - lo)
                    edges = np.searchsorted(row, np.arange(hi - lo + 1))
                    for i in range(hi - lo):
                        buckets[i].append(bucket[edges[i] : edges[i + 1]])
                        shares[i].append((n[edges[i] : edges[i + 1]] / max(total[i], 1)).astype(np.float32))
                packed = [pa.array([np.concatenate(x).tobytes() for x in column], pa.binary()) for column in (buckets, shares)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), *packed], names=["id", "y", "bucket", "share"])

    return sample.mapInArrow(run, "id long, y double, bucket binary, share binary")


def _logistic(bucket: np.ndarray, share: np.ndarray, row: np.ndarray, y: np.ndarray, rounds: int, scale: float) -> np.ndarray:
    """Weights of share * scale by accelerated gradient steps with a penalty on their squares."""
    n, dims = len(y), KINDS << BITS
    share = share * np.float32(scale)
    half = y.mean()
    weight = np.where(y > 0.5, 0.5 / half, 0.5 / (1 - half)) / n  # both classes weigh the same
    w, ahead, penalty = np.zeros(dims), np.zeros(dims), 1e-4
    size = np.bincount(row, share.astype(float) ** 2, n)
    step = 1 / (0.25 * size.max() + penalty)
    for t in range(rounds):
        margin = np.bincount(row, share * ahead[bucket], n)
        error = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - (y > 0.5)) * weight
        gradient = np.bincount(bucket, share * error[row], dims) + penalty * ahead / n
        nxt = ahead - step * n * gradient
        ahead, w = nxt + t / (t + 3) * (nxt - w), nxt
    return w * scale


def calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and level of the sigmoid of least log loss (targets drawn in a little, so that separable rows end)."""
    up, down = (y > 0.5).sum(), (y <= 0.5).sum()
    to = np.where(y > 0.5, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.column_stack([margin, np.ones(len(y))])
    spread = max(float(margin.std()), 1e-9)
    x[:, 0] /= spread
    v = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -35, 35)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(curve, x.T @ (p - to))
        v -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return max(float(v[0]), 0.0) / spread, float(v[1])


def fit(docs: DataFrame, labels: DataFrame, out: Column, label: str = "quality", max_rows: int = MAX_ROWS, rounds: int = 120, scale: float = 30.0) -> Judge:
    """Learn from labels(doc_id, <label>) of rows where ``out`` is false; a third of them calibrates."""
    rows = featured(labelled(docs, labels, label, out, max_rows)).where("length(bucket) > 0").orderBy("id", "y").limit(max_rows).toArrow()
    y = rows["y"].to_numpy()
    if len(np.unique(y > 0.5)) < 2:
        return Judge(None, 0.0, 0.0, float((y > 0.5).mean()) if len(y) else 1.0)
    bucket = [np.frombuffer(x.as_buffer(), np.int32) for x in rows["bucket"]]
    share = [np.frombuffer(x.as_buffer(), np.float32) for x in rows["share"]]
    part = np.random.default_rng(13).random(len(y)) < 1 / 3
    if len(np.unique(y[part] > 0.5)) < 2 or len(np.unique(y[~part] > 0.5)) < 2:
        part = np.zeros(len(y), bool)  # too few rows to set some apart: the same ones calibrate

    def flat(rows: np.ndarray):
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(bucket[i]) for i in rows])
        return np.concatenate([bucket[i] for i in rows]), np.concatenate([share[i] for i in rows]), row

    learn, rest = np.flatnonzero(~part), np.flatnonzero(part if part.any() else ~part)
    w = _logistic(*flat(learn), y[learn], rounds, scale)
    b, s, row = flat(rest)
    slope, level = calibrated(np.bincount(row, s * w[b], len(rest)), y[rest])
    return Judge(w.astype(np.float32), slope, level, float((y > 0.5).mean()))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judged(docs: DataFrame, model: Judge, least: float = LEAST_PROBABILITY) -> DataFrame:
    """docs with COUNTS, base_failed, kept and probability; columns of docs with these names are replaced."""
    docs = docs.drop(*COUNTS, "base_failed", "kept", "probability")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")
    own = [f"c{i}" for i in range(len(names))]

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(at))
            for lo, hi in chunks(offsets):
                data, ends = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                part = batch.slice(lo, hi - lo)
                n = counts([t or "" for t in part.column(at).to_pylist()], data, ends)
                failed = (n["n_words"] < LEAST_WORDS) | (100 * n["n_repeat_words"] > MOST_REPEATED * n["n_words"])
                p = shared.value.probability(data, ends)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(n[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(~failed & (p >= least)), pa.array(p, pa.float64())], names=[*own, *COUNTS, "base_failed", "kept", "probability"])

    fields = [T.StructField(c, f.dataType) for c, f in zip(own, docs.schema.fields, strict=True)]
    fields += [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("probability", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType(fields)).toDF(*names, *COUNTS, "base_failed", "kept", "probability")


def digest(docs: DataFrame, labels: DataFrame, out: Column) -> DataFrame:
    """The contract's columns, and the probability; out(doc_id) marks rows kept out of learning."""
    model = fit(docs, labels, out)
    return judged(docs.select("doc_id", "text"), model).drop("text")
