"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

A text's tokens are its words (ASCII lower-cased, split at ASCII white space)
and one end.  The probability of a token is that of its class given the
history, times that of the token within its class:

* The most frequent tokens fill ``FREQUENT`` classes of ``MEMBERS`` each, by
  rank; within such a class the token follows a softmax as well.
* All other tokens fall into ``RARE`` classes by their last two bytes; within
  such a class they have add-one unigram probabilities over the training
  tokens of the class, one share being kept for unknown ones.

Class and member logits are sums of weights of hashed features of the history:
the token before, the one before that (a skip feature) and the two together.
Weights are trained by distributed gradient updates: in each round every task
runs Adagrad over its share of the training texts, from the same weights, and
the results are averaged by number of tokens (iterative parameter mixing).
Every training text is used in one round.  Scoring runs over slices of texts
in numpy, gathering only the weight rows that occur.

Counts of tokens cover all training texts.  Tokens that make up at least
``hot`` of them, at most 1 / hot by definition, are broadcast; all others meet
their counts in a shuffled join, so nothing that grows with the vocabulary is
broadcast or collected.

Defined cases: null and empty texts have the end only; with no training text
all counts are 0; repeated rows give equal results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import stored
from ._text import NOT_SPACE, Words, chunks, key64, mix64, text_bytes

FREQUENT, MEMBERS, RARE = 16, 16, 16
CLASSES = FREQUENT + RARE
CLASS_ROWS, MEMBER_ROWS = 1 << 13, 1 << 11
BATCH = 1 << 14
TASK_BYTES = 24 << 20
BLOCK = 1 << 14
END = np.uint64(key64(b"\0end") & (1 << 64) - 1)


@dataclass
class Tokens:
    """Tokens of a slice of texts, ends included: hash, row, the two before, and the class of rare ones."""

    hash: np.ndarray
    row: np.ndarray
    before: np.ndarray
    second: np.ndarray
    rare: np.ndarray
    counts: np.ndarray


def tokens(raw: np.ndarray, offsets: np.ndarray) -> Tokens:
    words = Words(raw, offsets, NOT_SPACE)
    n = len(words.counts)
    counts = words.counts + 1
    ends = np.cumsum(counts) - 1
    h = np.full(int(counts.sum()), END, dtype=np.uint64)
    inner = np.ones(len(h), dtype=bool)
    inner[ends] = False
    h[inner] = words.hash
    rare = np.zeros(len(h), dtype=np.int64)
    if len(words.end):
        last = words.data[words.end - 1].astype(np.int64)
        prior = np.where(words.end - words.start > 1, words.data[np.maximum(words.end - 2, 0)], 0).astype(np.int64)
        rare[inner] = (last * 7 + prior * 3) % RARE
    starts = ends - counts + 1
    before = np.concatenate([[END], h[:-1]])
    before[starts] = END
    second = np.concatenate([[END], before[:-1]])
    second[starts] = END
    return Tokens(h, np.repeat(np.arange(n), counts), before, second, rare, counts)


def slices(column: pa.Array):
    """(first row, tokens) of each slice of a text column."""
    raw, offsets = text_bytes(column)
    for lo, hi in chunks(offsets):
        yield lo, tokens(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def token_counts(texts: DataFrame) -> DataFrame:
    """(h, rare, c): how often each token occurs in texts(text), with its rare class."""

    def run(batches):
        for batch in batches:
            parts = []
            for _, t in slices(batch.column(0)):
                h, first, c = np.unique(t.hash, return_index=True, return_counts=True)
                parts.append((h, t.rare[first], c))
            if not parts:
                continue
            h, first, back = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
            c = np.bincount(back, np.concatenate([p[2] for p in parts]), len(h)).astype(np.int64)
            rare = np.concatenate([p[1] for p in parts])[first].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rare), pa.array(c)], names=["h", "rare", "c"])

    return texts.select("text").mapInArrow(run, "h long, rare int, c long").groupBy("h").agg(F.max("rare").alias("rare"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Totals, the tokens of many occurrences, and the classes."""

    total: int
    distinct: int
    hot: np.ndarray  # sorted hashes
    hot_count: np.ndarray
    member: np.ndarray  # per hot token: its place among the frequent ones, or -1
    rare_total: np.ndarray = field(default_factory=lambda: np.ones(RARE))  # N + V + 1 of each rare class
    prior: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES, np.float32))
    member_prior: np.ndarray = field(default_factory=lambda: np.zeros(FREQUENT * MEMBERS, np.float32))

    def place(self, h: np.ndarray) -> np.ndarray:
        """Index among the hot tokens, or -1."""
        if not len(self.hot):
            return np.full(len(h), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)
        return np.where(self.hot[at] == h, at, -1)

    def classes(self, t: Tokens, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each token, and its place among the frequent tokens (-1 for rare ones)."""
        member = np.where(place >= 0, self.member[place], -1) if len(self.member) else np.full(len(place), -1)
        return np.where(member >= 0, member // MEMBERS, FREQUENT + t.rare), member


def vocabulary(counts: DataFrame, hot: float) -> Vocabulary:
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = sums["n"], sums["v"]
    top = counts.where(F.col("c") >= max(1.0, n * hot)).toArrow()
    h, rare, c = top["h"].to_numpy().view(np.uint64), top["rare"].to_numpy(), top["c"].to_numpy()
    order = np.argsort(h)
    h, rare, c = h[order], rare[order], c[order]
    member = np.full(len(h), -1, dtype=np.int64)
    rank = np.lexsort((h, -c))[: FREQUENT * MEMBERS]
    member[rank] = np.arange(len(rank))
    total, distinct = np.zeros(RARE), np.zeros(RARE)
    for r in counts.groupBy("rare").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        total[r["rare"]], distinct[r["rare"]] = r["n"], r["v"]
    taken = member >= 0
    np.subtract.at(total, rare[taken], c[taken])
    np.subtract.at(distinct, rare[taken], 1)
    share = np.zeros(CLASSES)
    np.add.at(share, member[taken] // MEMBERS, c[taken])
    share[FREQUENT:] = total
    of_member = np.full(FREQUENT * MEMBERS, -30.0)  # places without a token
    of_member[member[taken]] = np.log(c[taken])
    return Vocabulary(n, v, h, c, member, total + distinct + 1, np.log(share + 1).astype(np.float32), of_member.astype(np.float32))


def feature_rows(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed rows of the history features: the token before, the skip over it, and both."""
    a = mix64(t.before)
    b = mix64(t.second + np.uint64(0x51ED270B))
    c = mix64(t.before * np.uint64(0x9E3779B97F4A7C15) ^ t.second)
    return a, b, c


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


class Model:
    """Weights: class logits by feature row, member logits by feature row, both on top of the priors."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.by_class = np.zeros((CLASS_ROWS, CLASSES), dtype=np.float32)
        self.by_member = np.zeros((MEMBER_ROWS, FREQUENT * MEMBERS), dtype=np.float32)

    def logits(self, rows: tuple[np.ndarray, ...], lo: int, hi: int) -> tuple[np.ndarray, list[np.ndarray]]:
        at = [(r[lo:hi] & np.uint64(CLASS_ROWS - 1)).astype(np.int64) for r in rows]
        z = self.vocab.prior + self.by_class[at[0]] + self.by_class[at[1]] + self.by_class[at[2]]
        return z, at

    def member_logits(self, rows: tuple[np.ndarray, ...], at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        columns = group[:, None] * MEMBERS + np.arange(MEMBERS)
        lines = [((r[at] >> np.uint64(20)) & np.uint64(MEMBER_ROWS - 1)).astype(np.int64) for r in rows[:2]]
        z = self.vocab.member_prior[columns] + self.by_member[lines[0][:, None], columns] + self.by_member[lines[1][:, None], columns]
        return z, [*lines, columns]

    def train(self, t: Tokens, state: dict[str, np.ndarray], rate: float) -> None:
        """Adagrad steps over the tokens, in batches."""
        groups, member = self.vocab.classes(t, self.vocab.place(t.hash))
        rows = feature_rows(t)
        for lo in range(0, len(t.hash), BATCH):
            hi = min(lo + BATCH, len(t.hash))
            z, at = self.logits(rows, lo, hi)
            g = _softmax(z)
            g[np.arange(hi - lo), groups[lo:hi]] -= 1
            g /= np.float32(np.sqrt(hi - lo))
            flat = np.concatenate(at)
            grad = np.column_stack([np.bincount(flat, np.tile(g[:, k], 3), CLASS_ROWS) for k in range(CLASSES)]).astype(np.float32)
            state["class"] += grad * grad
            self.by_class -= rate * grad / np.sqrt(state["class"])
            some = lo + np.flatnonzero(member[lo:hi] >= 0)
            if len(some):
                z, (a, b, columns) = self.member_logits(rows, some, groups[some])
                g = _softmax(z)
                g[np.arange(len(some)), member[some] % MEMBERS] -= 1
                g /= np.float32(np.sqrt(len(some)))
                width = FREQUENT * MEMBERS
                where = np.concatenate([(a[:, None] * width + columns).ravel(), (b[:, None] * width + columns).ravel()])
                grad = np.bincount(where, np.tile(g.ravel(), 2), MEMBER_ROWS * width).astype(np.float32).reshape(MEMBER_ROWS, width)
                state["member"] += grad * grad
                self.by_member -= rate * grad / np.sqrt(state["member"])

    def log10(self, t: Tokens, place: np.ndarray) -> np.ndarray:
        """log10 probability of each token, but for the log10(c + 1) of rare tokens."""
        groups, member = self.vocab.classes(t, place)
        rows = feature_rows(t)
        out = np.empty(len(t.hash))
        for lo in range(0, len(t.hash), BATCH):
            hi = min(lo + BATCH, len(t.hash))
            z, _ = self.logits(rows, lo, hi)
            top = z.max(axis=1)
            out[lo:hi] = z[np.arange(hi - lo), groups[lo:hi]] - top - np.log(np.exp(z - top[:, None]).sum(axis=1))
            some = lo + np.flatnonzero(member[lo:hi] >= 0)
            if len(some):
                z, _ = self.member_logits(rows, some, groups[some])
                top = z.max(axis=1)
                out[some] += z[np.arange(len(some)), member[some] % MEMBERS] - top - np.log(np.exp(z - top[:, None]).sum(axis=1))
        out /= np.log(10)
        rare = member < 0
        out[rare] -= np.log10(self.vocab.rare_total[t.rare[rare]])
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([self.by_class.ravel(), self.by_member.ravel()])

    def load(self, flat: np.ndarray) -> None:
        n = self.by_class.size
        self.by_class = flat[:n].reshape(self.by_class.shape).astype(np.float32)
        self.by_member = flat[n:].reshape(self.by_member.shape).astype(np.float32)


def trained(model: Model, texts: DataFrame, text_bytes_total: int, rounds: int, rate: float) -> Model:
    """Rounds of parameter mixing over texts(text, round): every text takes part in one round."""
    spark = texts.sparkSession
    tasks = max(1, -(-text_bytes_total // (TASK_BYTES * rounds)))
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            own = Model(shared.value.vocab)
            own.load(shared.value.flat())
            state = {"class": np.full_like(own.by_class, 0.1), "member": np.full_like(own.by_member, 0.1)}
            seen = 0
            for batch in batches:
                for _, t in slices(batch.column(0)):
                    own.train(t, state, rate)
                    seen += len(t.hash)
            if seen:
                flat = own.flat()
                for i in range(0, len(flat), BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int32()), pa.array([seen], pa.int64()), pa.array([flat[i : i + BLOCK].tobytes()], pa.binary())], names=["block", "seen", "weights"])

        def mean(batches):
            sums: dict[int, np.ndarray] = {}
            seen: dict[int, int] = {}
            for batch in batches:
                for block, n, w in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    part = np.frombuffer(w, np.float32).astype(np.float64) * n
                    sums[block] = sums[block] + part if block in sums else part
                    seen[block] = seen.get(block, 0) + n
            keys = sorted(sums)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([(sums[k] / seen[k]).astype(np.float32).tobytes() for k in keys], pa.binary())], names=["block", "weights"])

        blocks = -(-len(model.flat()) // BLOCK)
        moved = texts.where(F.col("round") == turn).select("text").coalesce(tasks).mapInArrow(run, "block int, seen long, weights binary")
        got = moved.repartition(min(blocks, 16), "block").mapInArrow(mean, "block int, weights binary").collect()
        if got:
            after = Model(model.vocab)
            after.load(np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(got, key=lambda r: r["block"])]))
            model = after
        shared.unpersist()
    return model


def fit(texts: DataFrame, hot: float = 1e-6, rounds: int = 2, rate: float = 0.15) -> tuple[Model, DataFrame]:
    """The model of texts(text), and the table of token counts."""
    counts = stored(token_counts(texts))
    vocab = vocabulary(counts, hot)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    dealt = texts.select("text", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(rounds)).alias("round"))
    return trained(Model(vocab), dealt, size, rounds, rate), counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) to doc_id, n_tokens, n_known, train_tokens, base_score and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        hot_log = np.log10(m.vocab.hot_count + 1.0)
        base = np.log10(m.vocab.total + m.vocab.distinct + 1.0)
        for batch in batches:
            for lo, t in slices(batch.column(1)):
                n = len(t.counts)
                place = m.vocab.place(t.hash)
                is_hot = place >= 0
                seen = np.zeros(len(place))
                seen[is_hot] = hot_log[place[is_hot]]
                member = np.where(is_hot, m.vocab.member[place], -1) if len(m.vocab.member) else np.full(len(place), -1)
                model_part = m.log10(t, place) + np.where(member < 0, seen, 0.0)
                sums = [np.bincount(t.row, x, n) for x in (is_hot, seen - base, model_part)]
                tail = np.flatnonzero(~is_hot)
                h, row = t.hash[tail], t.row[tail]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(h)))
                bounds = np.searchsorted(row[first], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, n),
                        pa.array(t.counts.astype(np.int64)),
                        pa.array(sums[0].astype(np.int64)),
                        pa.array(sums[1]),
                        pa.array(sums[2]),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(h[first].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(times.astype(np.int32))),
                    ],
                    names=["doc_id", "n_tokens", "known", "base", "model", "tail", "times"],
                )

    made = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, known long, base double, model double, tail array<long>, times array<int>")
    made = stored(made.withColumn("r", F.monotonically_increasing_id()))
    tail = made.select("r", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("r", F.col("x.tail").alias("h"), F.col("x.times").alias("m"))
    low = counts.where(F.col("c") < max(1.0, model.vocab.total * model_hot(model)))
    met = tail.join(low.select("h", "c"), "h").groupBy("r").agg(F.sum("m").alias("more"), F.sum(F.col("m") * F.log10(F.col("c") + 1.0)).alias("logs"))
    zero = F.lit(0)
    return made.drop("tail", "times").join(met, "r", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", zero)).alias("n_known"),
        F.lit(model.vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("logs", F.lit(0.0))).alias("score"),
    )


def model_hot(model: Model) -> float:
    """The least share of a token in the broadcast part (above any token outside it)."""
    return float(model.vocab.hot_count.min() / model.vocab.total) if len(model.vocab.hot_count) else 2.0


def digest(docs: DataFrame, out: Column, **options) -> DataFrame:
    """The contract's columns for docs(doc_id, text); rows where ``out`` is true teach nothing."""
    model, counts = fit(docs.where(~out).select(F.coalesce("text", F.lit("")).alias("text")), **options)
    return score(docs, model, counts).withColumn("held_out", out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
