"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in hinge features of its dense features.  From
labelled documents come preference pairs (a good one over a bad one); the
probability that a beats b is the logistic of the difference of strengths, so
the weights minimise logistic loss on feature differences.  A threshold is a
quantile of the strengths: the share of documents that are bad.  Scores in 0
to 1 are the logistic of the strength, moved so that the threshold falls on
``cut``.

Learning uses a bounded sample of labelled rows (``max_rows``, the ids least by
hash); features and scores are for whole texts.  Null and empty texts have the
features of an empty text.  Repeated labels count as often as they occur, null
labels teach nothing; with one class only, or none, every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import chunks, text_bytes
from .features import FEATURES, dense

MAX_ROWS = 20_000


def labelled(docs: DataFrame, labels: DataFrame, label: str, out: Column, max_rows: int) -> DataFrame:
    """(id, text, y) of at most max_rows labelled rows outside ``out``: the sample's ids are few, so they are broadcast."""
    some = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~out)
        .select(F.col("doc_id").alias("id"), F.col(label).cast("double").alias("y"))
        .orderBy(F.xxhash64("id"), "id", "y")
        .limit(max_rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("id")).select("id", "text", "y")


def featured(docs: DataFrame) -> DataFrame:
    """docs(id, text, y) to (id, y, x)."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                x = dense(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    return docs.mapInArrow(run, "id long, y double, x array<double>")


def collected(frame: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and feature rows of a bounded sample, in the order of ids."""
    t = frame.select("id", "y", "x").toArrow()
    if t.num_rows == 0:
        return np.empty(0, np.int64), np.empty(0), np.empty((0, len(FEATURES)))
    ids, y = t["id"].to_numpy(), t["y"].to_numpy()
    x = np.array(t["x"].to_pylist())
    order = np.lexsort((y, ids))
    return ids[order], y[order], x[order]


class PairRanker:
    """Bradley-Terry model of strengths that are linear in hinge features."""

    def __init__(self, knots: int = 4, pairs_per_row: int = 8, penalty: float = 1e-3, rounds: int = 40, cut: float = 0.3, seed: int = 5):
        self.knots, self.pairs, self.penalty, self.rounds, self.cut, self.seed = knots, pairs_per_row, penalty, rounds, cut, seed
        self.weights: np.ndarray | None = None
        self.threshold = 0.0

    def _hinges(self, x: np.ndarray) -> np.ndarray:
        parts = [(x - self.mean) / self.spread]
        for k in self.at:
            parts.append(np.clip((x - k) / self.spread, 0, 6))
        return np.clip(np.concatenate(parts, axis=1), -8, 8)

    def fit(self, x: np.ndarray, y: np.ndarray) -> PairRanker:
        good, bad = np.flatnonzero(y > 0.5), np.flatnonzero(y <= 0.5)
        if not len(good) or not len(bad):
            return self
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.at = np.quantile(x, [0.5, 0.8, 0.95, 0.99][: self.knots], axis=0)
        z = self._hinges(x)
        rng = np.random.default_rng(self.seed)
        n = self.pairs * len(x)
        difference = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
        w = np.zeros(z.shape[1])
        for _ in range(self.rounds):  # Newton's method on the penalised loss
            p = 1 / (1 + np.exp(np.clip(difference @ w, -40, 40)))
            gradient = -difference.T @ p / n + self.penalty * w
            curve = (difference * (p * (1 - p))[:, None]).T @ difference / n + self.penalty * np.eye(len(w))
            step = np.linalg.solve(curve, gradient)
            w -= step
            if np.abs(step).max() < 1e-7:
                break
        self.weights = w
        # A pair's odds are the difference of two strengths; the threshold is the quantile below which the bad ones lie.
        self.threshold = float(np.quantile(z @ w, len(bad) / len(x)))
        return self

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self._hinges(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        shift = np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold + shift, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, out: Column, label: str = "quality", max_rows: int = MAX_ROWS, **options) -> PairRanker:
    """Learn from labels(doc_id, <label>) of rows where ``out`` is false."""
    _, y, x = collected(featured(labelled(docs, labels, label, out, max_rows)))
    return PairRanker(**options).fit(x, y)


def scored(docs: DataFrame, score_batch, shared) -> DataFrame:
    """docs with score: score_batch(shared value, raw, offsets) on slices of the text column."""
    docs = docs.drop("score")
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(at))
            for lo, hi in chunks(offsets):
                s = score_batch(shared.value, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(s, pa.float64())], names=[*(f"c{i}" for i in range(len(names))), "score"])

    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType())])).toDF(*names, "score")


def score(docs: DataFrame, model: PairRanker) -> DataFrame:
    """docs with score (0 to 1, higher is better)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda m, raw, offsets: m.score(dense(raw, offsets)), shared)


def digest(docs: DataFrame, labels: DataFrame, out: Column, cut: float = 0.3) -> DataFrame:
    """The contract's columns; out(doc_id) marks rows kept out of learning."""
    model = fit(docs, labels, out, cut=cut)
    return score(docs.select("doc_id", "text", out.alias("held_out")), model).select("doc_id", "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"))
