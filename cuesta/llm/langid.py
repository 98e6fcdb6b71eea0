"""Language identification with bit-sliced Bloom filters over character n-grams.

For every language the n-grams that make up at least ``rate`` of its n-grams
in the training texts are kept (so at most 1 / rate of them).  One bit-sliced
Bloom filter holds all languages: slot s has a mask with a bit per language,
and the AND of the k slots of an n-gram gives every language that contains it.
A text's n-grams are looked up at once; the hits of each language are counted,
the hits expected by chance (its filter's fill to the power k) are taken off,
and the language with most left wins.

n-grams run over lower-cased letters; any run of other characters counts as
one space, also before and after the text.  Ties go to the first language in
sorted order, and a text none of whose n-grams is known to the one most common
in training.  Null texts and texts without a letter are ``und`` with score 0.
Rows without a language, or without text, teach nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import stored
from ._text import chunks, mix64, text_bytes

UND = "und"
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes of texts and the boundaries between texts; a text without letters has none."""
    folded = [t.lower() for t in texts]
    code = np.frombuffer("\n".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in folded])
    starts = ends - np.array([len(t) + 1 for t in folded])
    low = _letters()
    letter = low[np.minimum(code, len(low) - 1)]
    padded = np.zeros(len(code) + 2, dtype=np.uint64)
    padded[1:-1] = np.where(letter, code, np.uint32(0))
    keep = np.ones(len(padded), dtype=bool)
    keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)  # one space for a run of others
    row = np.zeros(len(padded), dtype=np.int32)
    row[1:-1] = np.repeat(np.arange(len(texts), dtype=np.int32), ends - starts)[: len(code)]
    row[-1] = len(texts) - 1
    c, r = padded[keep], row[keep]
    if len(c) < n:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    m = len(c) - n + 1
    h = np.zeros(m, dtype=np.uint64)
    spaces = np.zeros(m, dtype=np.int8)
    for j in range(n):
        h = h * np.uint64(0x100000001B3) + c[j : j + m]
        if 0 < j < n - 1:
            spaces += c[j : j + m] == 0
    good = spaces == 0  # no n-gram reaches over a space into the next word, so none joins two texts
    if n == 1:
        good = c[:m] != 0
    owner = r[n // 2 : n // 2 + m] if n > 1 else r[:m]
    h, owner = mix64(h[good]), owner[good]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point below 0x30000 is a letter; the last entry stands for the rest."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x30000)), bool, 0x30000))
    return _LETTERS[0]


def gram_counts(docs: DataFrame, n: int) -> DataFrame:
    """(lang, gram, c) over docs(lang, text)."""

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            _, offsets = text_bytes(batch.column(1))
            for lang in sorted(set(langs)):
                part = batch.filter(pa.array(langs == lang))
                _, offsets = text_bytes(part.column(1))
                sums: list[tuple[np.ndarray, np.ndarray]] = []
                for lo, hi in chunks(offsets):
                    h, _ = grams(part.column(1).slice(lo, hi - lo).to_pylist(), n)
                    sums.append(np.unique(h, return_counts=True))
                keys = np.concatenate([k for k, _ in sums])
                values, back = np.unique(keys, return_inverse=True)
                total = np.bincount(back, np.concatenate([c for _, c in sums]), len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(total)], names=["lang", "gram", "c"])

    return docs.select("lang", "text").where("lang is not null and text is not null").mapInArrow(count, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


class LanguageFilters:
    """The bit-sliced Bloom filter: one row of 64-bit language masks per slot, a slice per 64 languages."""

    def __init__(self, known: dict[str, np.ndarray], weights: dict[str, int], n: int, bits_per_gram: int = 24, k: int = 3):
        self.langs, self.n, self.k = sorted(known), n, k
        most = max((len(g) for g in known.values()), default=1)
        self.slots = 1 << max(10, int(most * bits_per_gram - 1).bit_length())
        slices = max(1, -(-len(self.langs) // 64))
        wide = next(t for t, b in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(self.langs) <= b or b == 64)
        self.masks = np.zeros((slices, self.slots), dtype=wide)
        self.chance = np.zeros(len(self.langs))
        for i, lang in enumerate(self.langs):
            bit = self.masks.dtype.type(1 << (i % 64))
            at = self._slots(known[lang])
            for s in at:
                self.masks[i // 64][s] |= bit
            fill = np.count_nonzero(self.masks[i // 64] & bit) / self.slots
            self.chance[i] = fill**k
        self.common = max(self.langs, key=lambda x: (weights[x], x)) if self.langs else UND

    def _slots(self, h: np.ndarray) -> list[np.ndarray]:
        return [((h * salt) >> np.uint64(32)) & np.uint64(self.slots - 1) for salt in _SALTS[: self.k]]

    def masks_of(self, h: np.ndarray) -> np.ndarray:
        """The language mask of each n-gram, by slice."""
        at = self._slots(h)
        out = self.masks[:, at[0]]
        for s in at[1:]:
            out &= self.masks[:, s]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        h, bounds = grams(texts, self.n)
        total = np.diff(bounds)
        found = self.masks_of(h)
        hits = np.zeros((len(self.langs), len(texts)))
        for i in range(len(self.langs)):
            bit = found.dtype.type(1 << (i % 64))
            seen = np.concatenate([[0], np.cumsum((found[i // 64] & bit) != 0)])
            hits[i] = seen[bounds[1:]] - seen[bounds[:-1]]
        true = np.maximum(0, (hits - total * self.chance[:, None]) / (1 - self.chance[:, None]))
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts))
        best = true.argmax(axis=0)
        score = np.where(total > 0, true.max(axis=0) / np.maximum(total, 1), 0.0)
        blank = [not t and not any(map(str.isalpha, text)) for t, text in zip(total, texts, strict=True)]
        names = [UND if u else self.langs[b] if s > 0 else self.common for u, b, s in zip(blank, best, score, strict=True)]
        return names, np.clip(score, 0, 1)


def fit(docs: DataFrame, n: int = 4, rate: float = 1e-5) -> LanguageFilters:
    """Filters of the languages in docs(lang, text).

    An n-gram is kept for a language if it makes up ``rate`` of it.
    """
    counts = stored(gram_counts(docs, n))
    totals = counts.groupBy("lang").agg(F.sum("c").alias("all"))
    kept = counts.join(F.broadcast(totals.where("lang is not null")), "lang").where(F.col("c") >= F.col("all") * rate)
    got = kept.select("lang", "gram", "all").toArrow()
    langs, grams_, alls = np.array(got["lang"].to_pylist(), dtype=object), got["gram"].to_numpy().view(np.uint64), got["all"].to_numpy()
    known = {x: grams_[langs == x] for x in set(langs)}
    return LanguageFilters(known, {x: int(alls[langs == x][0]) for x in known}, n)


def predict(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """docs with lang_pred and score (share of the text's n-grams that the language explains)."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            _, offsets = text_bytes(batch.column(at))
            for lo, hi in chunks(offsets):
                part = batch.slice(lo, hi - lo)
                langs, scores = shared.value.predict([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*(f"c{i}" for i in range(len(names))), "lang_pred", "score"])

    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema).toDF(*names, "lang_pred", "score")


def digest(docs: DataFrame, out: Column, **options) -> DataFrame:
    """The contract's columns: fit on rows where ``out`` is false, predict all of docs(doc_id, text, lang)."""
    model = fit(docs.where(~out), **options)
    return predict(docs.select("doc_id", "text", out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
