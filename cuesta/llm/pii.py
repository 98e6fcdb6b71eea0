"""Personal data by patterns and a skip-chain conditional random field.

Four patterns give the base spans (see ``base_spans``); they are found in
linear time whatever the text.  Candidates of a looser shape (numbers with
separators, addresses with a spelled-out or bare @) are the nodes of a
conditional random field with labels none, email, ip, card and phone.  Unary
potentials are log-linear in shape features; neighbouring candidates share a
chain potential, and candidates of a document with equal or similar content,
however far apart, share a skip potential.  Loopy belief propagation gives
each node's marginals; a candidate that is no base span becomes one more span
if its marginal for a kind is at least ``sure``, whether its document has base
spans or not.

Weights are learned by hiding base spans: a hidden one is shown in the looser
shapes that its kind is also written in, and the field must tell it from the
candidates that are neither base nor like a base span.  Pairs of like candidates
count where both are base or neither is, so a skip edge carries a kind from a
mention that the patterns know to those that they do not.  What a kind cannot be
is ruled out for every candidate (``possible``): a card has 16 to 19 digits and
passes Luhn, a phone has 8 to 15 digits, an ip four parts of at most 255, an
email an @, spelled out or not, and a host with a dot.  All is counted in one
pass, which leaves a table as large as the number of different shapes.
Skip edges tie each occurrence to
the last and to the first alike, so their number is linear in the candidates.

Defined cases: null and empty texts have no spans; repeated rows give equal
results; documents without a digit, @ or spelled-out @ are not looked at further.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS]
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE = re.compile(r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[ ().-]*+[0-9])*+|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|[\[(]at[\])]) ?[A-Za-z0-9.-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++)*")
_WORTH = re.compile(r"[0-9@]").search
_CANDIDATES = re.compile(r"[0-9@]|[\[(]at[\])]").search

Span = tuple[str, int, int]
#: Pairs of like candidates of each label that are taken to have been seen agreeing, so that kinds without repeats agree too.
ALIKE = 50.0


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """From each @ back over the local part and on over the host, so every character is passed a bounded number of times."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            out.append(("email", start, host.end()))
            done = host.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, by kind and start; code points, end exclusive."""
    if not _WORTH(text):
        return []
    out = emails(text)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


_EMAIL = re.compile(r"[a-z0-9._%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)+").fullmatch
_PARTS = re.compile(r"[0-9]{1,3}( ?\. ?[0-9]{1,3}){3}").fullmatch


def possible(s: str, digits: str, address: str | None) -> tuple[bool, ...]:
    """Which labels a candidate can have, whatever speaks for them."""
    if address is not None:
        return (True, _EMAIL(address) is not None, False, False, False)
    ip = _PARTS(s) is not None and all(int(x) <= 255 for x in s.split("."))
    return (True, False, ip, 16 <= len(digits) <= 19 and luhn(digits), 8 <= len(digits) <= 15)


def hidden(shape: tuple[int, ...], kind: str) -> list[tuple[tuple[int, ...], int]]:
    """Shapes that a base span of this kind would have, written in ways that the patterns do not know, with their weights
    in hundredths.  Bare numbers are mostly something else, so they need more than their shape."""
    if kind == "email":
        return [(shape, 100)]
    if kind == "phone":
        address, digits, dots, dashes, spaces, _, bracket, word = shape
        return [((address, n, dots, dashes, spaces, 0, bracket, word), 60) for n in (digits, max(digits - 1, 0))]
    return [(shape, 60)]


class Node:
    __slots__ = ("base", "can", "end", "key", "label", "shape", "start")

    def __init__(self, text: str, start: int, end: int, kind: str | None = None):
        self.start, self.end = start, end
        s = text[start:end]
        self.label = LABELS.index(kind) if kind else 0
        self.base = kind is not None
        digits = _digits(s)
        address = "@" in s or "at)" in s or "at]" in s
        if address:
            plain = re.sub(r" ?[\[(]at[\])] ?", "@", re.sub(r" ?[\[(]dot[\])] ?", ".", s)).replace(" ", "").lower()
            self.key = "a" + plain
            s = plain  # spelled out or not, an address has one shape
        else:
            self.key = "d" + digits if len(digits) >= 7 else ""
        self.can = possible(s, digits, plain if address else None)
        before = text[max(0, start - 12) : start].split()
        word = before[-1].strip(":=\"'").lower() if before else ""
        self.shape = (
            int(address),
            min(len(digits), 20),
            min(s.count("."), 4),
            min(s.count("-"), 4),
            min(s.count(" "), 4),
            int(s[:1] == "+"),
            int("(" in s),
            int(word in ("tel", "phone", "call", "mail", "email", "ip", "card", "fax")),
        )


def nodes(text: str, base: list[Span]) -> list[Node]:
    """Candidates in text order: every base span, and loose matches that overlap none."""
    kinds = {(a, b): k for k, a, b in reversed(base)}
    spans = sorted(kinds)
    found = [Node(text, a, b, kinds[a, b]) for a, b in spans]
    i = 0
    for m in _LOOSE.finditer(text):
        a, b = m.span()
        if sum(c.isdigit() for c in m.group()) < 7 and "@" not in m.group() and "at" not in m.group():
            continue
        while i < len(spans) and spans[i][1] <= a:
            i += 1
        if not any(x < b and a < y for x, y in spans[max(0, i - 1) : i + 4]):
            found.append(Node(text, a, b))
    found.sort(key=lambda n: (n.start, n.end))
    return found


def skip_edges(items: list[Node]) -> list[tuple[int, int]]:
    """Pairs of like candidates: equal keys, equal last nine digits, or equal local parts of an address."""
    by: dict[str, list[int]] = {}
    for i, n in enumerate(items):
        if not n.key:
            continue
        names = [n.key, "t" + n.key[-9:] if n.key[0] == "d" and len(n.key) > 9 else "l" + n.key.split("@")[0]]
        for name in names:
            by.setdefault(name, []).append(i)
    pairs = set()
    for group in by.values():
        for a, b in zip(group, group[1:], strict=False):
            pairs.add((a, b))
            pairs.add((group[0], b))
    return sorted(pairs)


class Field:
    """Potentials of the field: unary weights by shape feature, chain and skip tables."""

    def __init__(self, unary: dict[tuple, np.ndarray], chain: np.ndarray, skip: np.ndarray, sure: float = 0.9, rounds: int = 12):
        self.unary, self.chain, self.skip, self.sure, self.rounds = unary, chain, skip, sure, rounds

    @staticmethod
    def learn(shapes: Counter, chain: np.ndarray, skip: np.ndarray, steps: int = 300, **options) -> Field:
        """Log-linear unary weights by gradient descent; pair tables as smoothed log agreement over chance."""
        rows = sorted(shapes)
        feats = sorted({(i, v) for shape, _ in rows for i, v in enumerate(shape)})
        index = {f: j for j, f in enumerate(feats)}
        x = np.zeros((len(rows), len(feats) + 1))
        y = np.array([label for _, label in rows], dtype=np.int64)
        c = np.array([shapes[r] for r in rows], dtype=float)
        for i, (shape, _) in enumerate(rows):
            x[i, [index[f] for f in enumerate(shape)]] = 1
            x[i, -1] = 1
        w = np.zeros((len(feats) + 1, len(LABELS)))
        if len(rows):
            target = np.eye(len(LABELS))[y]
            square = np.full_like(w, 1e-8)
            for _ in range(steps):
                z = x @ w
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                g = x.T @ ((p - target) * c[:, None]) / c.sum() + 1e-4 * w
                square += g * g
                w -= 0.5 * g / np.sqrt(square)
        unary: dict[tuple, np.ndarray] = {f: w[j] for f, j in index.items()}
        unary[()] = w[-1]

        def table(t: np.ndarray, least: float, alike: float = 0.0) -> np.ndarray:
            t = t + t.T + least + alike * np.eye(len(LABELS))
            p = t / t.sum()
            m = p.sum(axis=0)
            return np.clip(np.log(p) - np.log(np.outer(m, m)), -12, 6)

        return Field(unary, table(chain, 20.0), table(skip, 0.001, ALIKE), **options)

    def _local(self, n: Node) -> np.ndarray:
        z = self.unary.get((), np.zeros(len(LABELS))).copy()
        for f in enumerate(n.shape):
            if f in self.unary:
                z += self.unary[f]
        if n.base:
            z[n.label] += 20  # observed
        else:
            z[~np.array(n.can)] = -1e3
        return z - z.max()

    def marginals(self, items: list[Node], skips: list[tuple[int, int]]) -> np.ndarray:
        """Loopy sum-product with damping over chain and skip edges."""
        k = len(LABELS)
        edges = [(i, i + 1, self.chain) for i in range(len(items) - 1) if items[i + 1].start - items[i].end < 40] + [(a, b, self.skip) for a, b in skips]
        local = np.array([self._local(n) for n in items])
        if not edges:
            p = np.exp(local)
            return p / p.sum(axis=1, keepdims=True)
        a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        pot = np.exp(np.array([e[2] for e in edges] * 2))
        msg = np.zeros((len(src), k))
        for _ in range(self.rounds):
            belief = local.copy()
            np.add.at(belief, dst, msg)
            out = belief[src] - msg[back]
            out = np.einsum("eij,ei->ej", pot, np.exp(out - out.max(axis=1, keepdims=True)))
            new = np.log(np.maximum(out / out.sum(axis=1, keepdims=True), 1e-30))
            msg = 0.5 * msg + 0.5 * new
        belief = local.copy()
        np.add.at(belief, dst, msg)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def more(self, text: str, base: list[Span]) -> list[Span]:
        """Spans that the field adds to the base ones."""
        if not _CANDIDATES(text):
            return []
        items = nodes(text, base)
        if all(n.base for n in items):
            return []
        p = self.marginals(items, skip_edges(items))
        out = []
        for i, n in enumerate(items):
            label = int(p[i, 1:].argmax()) + 1
            if not n.base and p[i, label] >= self.sure:
                out.append((LABELS[label], n.start, n.end))
        return out


def _each_text(column: pa.Array):
    for t in column:
        yield t.as_py() or ""


def learn(docs: DataFrame, **options) -> Field:
    """The field of docs(text), from counts over all of them."""

    def run(batches):
        shapes: Counter = Counter()
        chain, skip = np.zeros((5, 5), dtype=np.int64), np.zeros((5, 5), dtype=np.int64)
        for batch in batches:
            for text in _each_text(batch.column(0)):
                if not _CANDIDATES(text):
                    continue
                items = nodes(text, base_spans(text))
                pairs = skip_edges(items)
                like = {i for a, b in pairs for i in (a, b) if items[a].base or items[b].base}
                for i, n in enumerate(items):
                    if n.base:
                        for shape, weight in hidden(n.shape, KINDS[n.label - 1]):
                            shapes[shape, n.label] += weight
                    elif i not in like and not n.can[1]:  # a whole address that is spelled out speaks for itself
                        shapes[n.shape, 0] += 100
                told = [n.base or i not in like for i, n in enumerate(items)]
                for i, (n, m) in enumerate(zip(items, items[1:], strict=False)):
                    if m.start - n.end < 40 and told[i] and told[i + 1]:
                        chain[n.label, m.label] += 1
                for a, b in pairs:
                    if items[a].base == items[b].base:
                        skip[items[a].label, items[b].label] += 1
        rows = [("shape", ",".join(map(str, s)), label, c) for (s, label), c in shapes.items()]
        for name, t in (("chain", chain), ("skip", skip)):
            rows += [(name, str(i), j, int(t[i, j])) for i, j in zip(*np.nonzero(t), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([int(r[2]) for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64())], names=["what", "key", "label", "c"]
        )

    counted = docs.select("text").mapInArrow(run, "what string, key string, label int, c long").groupBy("what", "key", "label").agg(F.sum("c").alias("c")).collect()
    shapes: Counter = Counter()
    tables = {"chain": np.zeros((5, 5)), "skip": np.zeros((5, 5))}
    for r in counted:
        if r["what"] == "shape":
            shapes[tuple(map(int, r["key"].split(","))), r["label"]] = r["c"]
        else:
            tables[r["what"]][int(r["key"]), r["label"]] = r["c"]
    return Field.learn(shapes, tables["chain"], tables["skip"], **options)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """docs with base and spans, arrays of struct(kind, start, end) by kind and start; spans holds base and what the field adds."""
    docs = docs.drop("base", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = docs.columns
    at = names.index("text")
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                both: list[list] = [[], []]
                for text in _each_text(part.column(at)):
                    base = base_spans(text)
                    both[0].append(base)
                    both[1].append(sorted(base + shared.value.more(text, base), key=lambda s: (KINDS.index(s[0]), s[1], s[2])))
                lists = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in row] for row in rows], arrow) for rows in both]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], names=[*(f"c{i}" for i in range(len(names))), "base", "spans"])

    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("base", span), T.StructField("spans", span)])).toDF(*names, "base", "spans")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
            done = b
    return "".join([*out, text[done:]])


def _joined(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == F.lit(kind)))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for docs(doc_id, text)."""
    docs = docs.select("doc_id", "text")
    found = find(docs, learn(docs))
    counts = [_count(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def base_digest(text: str) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text)).encode()).hexdigest()
