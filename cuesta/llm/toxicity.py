"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are the general dense ones (capitals, punctuation, ...) and lexicon
features: densities of a fixed word list, of words and of word beginnings
learned from the labels, their nearness to second-person pronouns, and
obfuscation (letters mixed with digits or signs; list words found only after
such spellings are undone).

The learned lexicon holds terms whose log odds between toxic and other
documents exceed ``z`` standard errors.  For training, each half of the sample
is featured with the lexicon of the other half, so trees see term features as
they will be on new text; a third of the sample, not used for the trees, fits
the isotonic map from margin to probability.

Learning uses a bounded sample of labelled rows (``max_rows``), and of its terms
the ``max_terms`` whose odds differ most surely: terms of that sample, whatever
the corpus.  If a third of the sample, or the rest, lacks a class, the trees and
the calibration learn from the same rows.  Null and empty texts are scored like an empty text; with one class only, or none, the
score is that class's (0 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import stored
from ._text import ALNUM, LOWER, Words, chunks, text_bytes
from .features import dense
from .quality import MAX_ROWS, collected, labelled, scored

# Common insults and second-person pronouns (English, German, French, Spanish).
INSULTS = (
    "idiot idiots moron morons stupid dumb imbecile loser losers scum trash garbage filth filthy pathetic worthless useless disgusting clown clowns "
    "fool fools jerk pig pigs vermin bastard bitch asshole shit fuck fucking hate disgrace coward liar "
    "idiotisch dumm dummkopf trottel abschaum arschloch schwein wertlos erbärmlich ekelhaft versager "
    "imbécile stupide crétin débile abruti ordure déchet minable connard salaud "
    "idiota estúpido estúpida imbécil basura asqueroso inútil patético payaso escoria"
).split()
SECOND_PERSON = "you your yours yourself u ur ya du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split()

STEMS = (5, 6, 7, 8)
_PLAIN = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"013457@$!", b"oieastasi", strict=True):
    _PLAIN[_a] = _b
_SPELLED = ALNUM.copy()
_SPELLED[[ord(c) for c in "@$!*"]] = True


def _hashes(words: list[str]) -> np.ndarray:
    raw = " ".join(words).encode()
    data = np.frombuffer(raw, np.uint8)
    return np.unique(Words(data, np.array([0, len(data)]), ALNUM).hash)


FIXED, SECOND = _hashes(INSULTS), _hashes(SECOND_PERSON)


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


class Lexicon:
    """Sorted hashes of words, and of word beginnings by length."""

    def __init__(self, words: np.ndarray, stems: dict[int, np.ndarray]):
        self.words, self.stems = np.unique(words), {k: np.unique(v) for k, v in stems.items()}


def lexicon_features(raw: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    n = len(offsets) - 1
    words = Words(raw, offsets, ALNUM)
    w = np.maximum(words.counts, 1).astype(float)
    fixed, learned = _in(words.hash, FIXED), _in(words.hash, lexicon.words)
    stem = np.zeros(len(words.hash), dtype=bool)
    for k, known in lexicon.stems.items():
        at, h = words.prefix_hash(k)
        stem[at[_in(h, known)]] = True
    any_ = fixed | learned | stem
    near = np.zeros(len(any_), dtype=bool)
    person = np.flatnonzero(_in(words.hash, SECOND))
    hit = np.flatnonzero(any_)
    if len(person) and len(hit):
        for side in (np.searchsorted(person, hit), np.searchsorted(person, hit) - 1):
            p = person[np.clip(side, 0, len(person) - 1)]
            near[hit[(np.abs(p - hit) <= 4) & (words.row[p] == words.row[hit])]] = True
    spelled = Words(_PLAIN[raw], offsets, _SPELLED)
    odd = np.concatenate([[0], np.cumsum(_PLAIN[raw] != raw)])
    changed = odd[spelled.end] > odd[spelled.start]
    hidden = changed & (_in(spelled.hash, FIXED) | _in(spelled.hash, lexicon.words))

    def total(mask: np.ndarray, rows: np.ndarray = words.row) -> np.ndarray:
        return np.bincount(rows, mask, n)

    sums = [total(m) for m in (fixed, learned, stem, any_, near)] + [total(hidden, spelled.row), total(changed, spelled.row)]
    return np.column_stack([np.log1p(s) for s in sums] + [100 * s / w for s in sums])


def featured(docs: DataFrame, one: Lexicon, two: Lexicon) -> DataFrame:
    """docs(id, text, y, half) to (id, y, x): rows of half 0 by lexicon two, of half 1 by lexicon one."""
    shared = docs.sparkSession.sparkContext.broadcast((two, one))

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            half = batch.column(3).to_numpy()
            for lo, hi in chunks(offsets):
                data, ends = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                by = [lexicon_features(data, ends, x) for x in shared.value]
                x = np.concatenate([dense(data, ends), np.where(half[lo:hi, None] == 0, by[0], by[1])], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    return docs.mapInArrow(run, "id long, y double, x array<double>")


def term_counts(docs: DataFrame) -> DataFrame:
    """(k, term, t0, f0, t1, f1): documents with the term by label (t: toxic) and half; k is 0 for words, else a beginning's length."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            group = (batch.column(2).to_numpy() > 0.5) * 1 + 2 * batch.column(3).to_numpy()
            for lo, hi in chunks(offsets):
                words = Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM)
                for k in (0, *STEMS):
                    at, h = (np.arange(len(words.hash)), words.hash) if k == 0 else words.prefix_hash(k)
                    order = np.lexsort((h, words.row[at]))
                    h, row = h[order], words.row[at][order]
                    new = np.ones(len(h), dtype=bool)
                    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                    terms, back = np.unique(h[new], return_inverse=True)
                    counts = np.zeros((len(terms), 4), dtype=np.int64)
                    np.add.at(counts, (back, group[lo:hi][row[new]]), 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), k, np.int32)), pa.array(terms.view(np.int64)), *(pa.array(counts[:, i].copy()) for i in (1, 0, 3, 2))], names=["k", "term", "t0", "f0", "t1", "f1"])

    return docs.mapInArrow(run, "k int, term long, t0 long, f0 long, t1 long, f1 long").groupBy("k", "term").agg(*(F.sum(c).alias(c) for c in ("t0", "f0", "t1", "f1")))


def _z(t: Column, f: Column, toxic: int, other: int) -> Column:
    """Log odds ratio of a term over its standard error."""
    odds = F.log((t + 0.5) / (F.lit(toxic) - t + 0.5)) - F.log((f + 0.5) / (F.lit(other) - f + 0.5))
    return odds / F.sqrt(1 / (t + 0.5) + 1 / (f + 0.5))


def learn_lexicons(docs: DataFrame, z: float, max_terms: int) -> tuple[Lexicon, Lexicon, Lexicon]:
    """Lexicons of half 0, half 1 and all of docs(id, text, y, half)."""
    n = {(r["half"], r["y"] > 0.5): r["n"] for r in docs.groupBy("half", (F.col("y") > 0.5).cast("double").alias("y")).agg(F.count("*").alias("n")).collect()}
    size = [[n.get((h, x), 0) for x in (True, False)] for h in (0, 1)]
    c = term_counts(docs)
    both = _z(F.col("t0") + F.col("t1"), F.col("f0") + F.col("f1"), size[0][0] + size[1][0], size[0][1] + size[1][1])
    scores = [_z(F.col("t0"), F.col("f0"), *size[0]), _z(F.col("t1"), F.col("f1"), *size[1]), both]
    rows = c.where("t0 + t1 >= 3").select("k", "term", *(s.alias(f"z{i}") for i, s in enumerate(scores))).where(F.greatest("z0", "z1", "z2") >= z).orderBy(F.desc("z2"), "k", "term").limit(max_terms).toArrow()
    k, term = rows["k"].to_numpy(), rows["term"].to_numpy().view(np.uint64)
    out = []
    for i in range(3):
        on = rows[f"z{i}"].to_numpy() >= z
        out.append(Lexicon(term[on & (k == 0)], {s: term[on & (k == s)] for s in STEMS}))
    return out[0], out[1], out[2]


class Trees:
    """Gradient-boosted regression trees on binned features, logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 2.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.trees: list[tuple[list[tuple[int, float]], np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.concatenate([np.quantile(c, np.linspace(0, 1, self.bins)[1:-1]), np.quantile(c[c > 0], np.linspace(0, 1, 9)) if (c > 0).any() else []])) for c in x.T]
        codes = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
        width = max(map(len, cuts)) + 1
        margin = np.full(len(x), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-margin))
            g, h = q - y, np.maximum(q * (1 - q), 1e-6)
            leaf = np.zeros(len(x), dtype=np.int64)
            splits: list[tuple[int, float]] = []
            for level in range(self.depth):  # an oblivious tree: one split for all leaves of a level
                best, gain = None, 1e-6
                for f, cut in enumerate(cuts):
                    if not len(cut):
                        continue
                    slot = leaf * width + codes[:, f]
                    gs = np.bincount(slot, g, (1 << level) * width).reshape(-1, width).cumsum(axis=1)
                    hs = np.bincount(slot, h, (1 << level) * width).reshape(-1, width).cumsum(axis=1)
                    gl, hl = gs[:, : len(cut)], hs[:, : len(cut)]
                    gr, hr = gs[:, -1:] - gl, hs[:, -1:] - hl
                    won = (gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.ridge)).sum(axis=0)
                    won[(hl.sum(axis=0) < 0.1) | (hr.sum(axis=0) < 0.1)] = 0
                    i = int(won.argmax())
                    if won[i] > gain:
                        best, gain = (f, float(cut[i]), i), won[i]
                if best is None:
                    break
                splits.append(best[:2])
                leaf = 2 * leaf + (codes[:, best[0]] > best[2])
            if not splits:
                break
            n = 1 << len(splits)
            value = -self.rate * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + self.ridge)
            self.trees.append((splits, value))
            margin += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for splits, value in self.trees:
            leaf = np.zeros(len(x), dtype=np.int64)
            for f, cut in splits:
                leaf = 2 * leaf + (x[:, f] > cut)
            out += value[leaf]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing steps by pooling adjacent violators: block means of x and of y.

    Equal x are one point with the mean of their y, so their order does not matter.
    """
    points, place, count = np.unique(x, return_inverse=True, return_counts=True)
    blocks: list[list[float]] = []
    for a, b, n in zip((points * count).tolist(), np.bincount(place, y, len(points)).tolist(), count.tolist(), strict=True):
        blocks.append([a, b, float(n)])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, trees: Trees, at: np.ndarray, to: np.ndarray):
        self.lexicon, self.trees, self.at, self.to = lexicon, trees, at, to

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return np.full(len(offsets) - 1, float(self.to[0]) if len(self.to) else 0.0)
        x = np.concatenate([dense(raw, offsets), lexicon_features(raw, offsets, self.lexicon)], axis=1)
        return np.clip(np.interp(self.trees.margin(x), self.at, self.to), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, out: Column, label: str = "toxic", max_rows: int = MAX_ROWS, z: float = 3.0, max_terms: int = 20_000) -> ToxicityModel:
    """Learn from labels(doc_id, <label>) of rows where ``out`` is false."""
    sample = stored(labelled(docs, labels, label, out, max_rows).withColumn("half", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2)).cast("int")))
    one, two, all_ = learn_lexicons(sample, z, max_terms)
    ids, y, x = collected(featured(sample, one, two))
    y = (y > 0.5).astype(float)
    if len(np.unique(y)) < 2:
        return ToxicityModel(all_, Trees(), np.empty(0), y[:1])
    third = np.random.default_rng(11).random(len(y)) < 1 / 3
    if len(np.unique(y[third])) < 2 or len(np.unique(y[~third])) < 2:
        third = np.ones(len(y), dtype=bool)
        trees = Trees().fit(x, y)
    else:
        trees = Trees().fit(x[~third], y[~third])
    at, to = isotonic(trees.margin(x[third]), y[third])
    return ToxicityModel(all_, trees, at, to)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with score (0 to 1, higher is more toxic)."""
    return scored(docs, lambda m, raw, offsets: m.score(raw, offsets), docs.sparkSession.sparkContext.broadcast(model))


def digest(docs: DataFrame, labels: DataFrame, out: Column, cut: float = 0.5) -> DataFrame:
    """The contract's columns; out(doc_id) marks rows kept out of learning."""
    model = fit(docs, labels, out)
    return score(docs.select("doc_id", "text", out.alias("held_out")), model).select("doc_id", "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: ToxicityModel, cut: float = 0.5) -> DataFrame:
    """The rows of docs that score below cut; columns stay as they are."""
    kept = docs.columns
    return score(docs.withColumnsRenamed({"score": "_score"}), model).where(F.col("score") < cut).drop("score").toDF(*kept)
