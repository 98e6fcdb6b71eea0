"""Alignment of two tokenizers over a corpus.

Both tokenizers cut the same bytes, so an A token and a B token are linked in a
document where their byte ranges overlap.  Every overlap is one interval
between neighbouring token ends, and offsets where both sides end cut the
tokens into groups.  A pair of ids counts once for each document that holds it
linked.

The plan, every table of it stored before the next step reads it:

1. Documents are encoded in Arrow batches.  A block of documents leaves one
   row for each of its documents, and one packed row for each stripe of its
   links: distinct id pairs, their documents in the block, and the links
   themselves.  Stripe s holds the A ids that are s modulo ``STRIPES``, so
   frequent ids, which have small numbers, lie in different stripes.
2. Packed pair counts are partitioned by stripe (and salt), and added into a
   dense matrix, A ids of the stripe by B ids, with ``np.add.at``: first by
   salt, then by stripe alone.  Row maxima give each A id's highest count.
3. The links are partitioned by (stripe, salt) with the counts of their stripe
   sorted before them, so a task holds one dense matrix and streams the links
   past it.
4. Scores come back packed by block and are added up beside the documents.

A salt is a part of the blocks; there are so many that a stripe's links of
one salt take ``PART_BYTES``, whatever the corpus.  A task holds one matrix
and one block at a time, never a stripe's links.

Null and empty texts, and texts whose tokens do not give back their bytes, have
no tokens: zeros and an empty digest.  Repeated rows are documents of their
own, also with equal or null ids.  An empty table gives an empty result.
Other columns of the documents are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import dropped, stored
from ._text import chunks, text_bytes

STRIPES = 384
#: Links of a block: its rows are written when it has so many (one document may have more).
BLOCK_LINKS = 1_500_000
BLOCK_ROWS = 8_192
PART_BYTES = 32 << 20
SPACE = "▁"


@functools.lru_cache(maxsize=2)
def _side_a(path: str, ranks_path: str | None, pattern: str | None):
    """A function from texts to lists of ids, and the bytes of every id.

    With the same vocabulary as ranks, tiktoken encodes (a third of the time); else the JSON file's own library does.
    """
    import json

    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    table = {c: i for i, c in enumerate(_byte_characters())}
    special = {x["id"] for x in read.get("added_tokens", ()) if x.get("special")}
    pieces = {i: bytes(table[c] for c in t) for t, i in read["model"]["vocab"].items() if i not in special}
    if ranks_path is None:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        return (lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]), pieces
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if any(ranks.get(b) != i for i, b in pieces.items()) or len(ranks) != len(pieces):
        raise ValueError("the ranks are not the vocabulary's")
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return (lambda texts: [own.encode_ordinary(t) for t in texts]), pieces


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible in Latin-1, else from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [""] * 256
    for b in seen:
        out[b] = chr(b)
    for k, b in enumerate(b for b in range(256) if b not in set(seen)):
        out[b] = chr(256 + k)
    return out


@functools.lru_cache(maxsize=2)
def _side_b(path: str):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    for i in range(own.vocab_size()):
        if own.is_byte(i):
            pieces[i] = bytes([int(own.id_to_piece(i)[3:5], 16)])
        elif not own.is_control(i):
            pieces[i] = own.id_to_piece(i).replace(SPACE, " ").encode()
    return (lambda texts: own.encode(texts, num_threads=1)), pieces


class Vocabulary:
    """The bytes and decimal digits of every id, for gathering by arrays of ids."""

    def __init__(self, pieces: dict[int, bytes]):
        self.size = max(pieces) + 1
        self.length = np.array([len(pieces.get(i, b"")) for i in range(self.size)])
        self.first = np.concatenate([[0], np.cumsum(self.length)])
        self.bytes = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(self.size)), np.uint8)
        digits = [str(i).encode() for i in range(self.size)]
        self.digits = np.array([len(d) for d in digits])
        self.width = int(self.digits.max())
        self.text = np.frombuffer(b"".join(d.ljust(self.width, b"\0") for d in digits), np.uint8).reshape(-1, self.width)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(n) else 0
        return self.bytes[np.arange(total) + np.repeat(self.first[ids] - ends + n, n)]


@functools.lru_cache(maxsize=2)
def _sides(a_path: str, b_path: str, ranks_path: str | None, pattern: str | None):
    (one, a), (two, b) = _side_a(a_path, ranks_path, pattern), _side_b(b_path)
    return one, Vocabulary(a), two, Vocabulary(b)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in lists], dtype=np.int64)
    return np.fromiter((i for x in lists for i in x), np.int64, int(n.sum())), np.concatenate([[0], np.cumsum(n)])


def _whole(ids: np.ndarray, first: np.ndarray, voc: Vocabulary, want: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows whose tokens' bytes, joined, are want[ends[i]:ends[i + 1]]."""
    size = np.concatenate([[0], np.cumsum(voc.length[ids])])[first]
    got = voc.joined(ids)
    ok = np.diff(size) == np.diff(ends)
    if ok.all():
        differ = np.concatenate([[0], np.cumsum(got != want)])
        return differ[ends[1:]] == differ[ends[:-1]]
    for i in np.flatnonzero(ok):
        ok[i] = np.array_equal(got[size[i] : size[i + 1]], want[ends[i] : ends[i + 1]])
    return ok


def _kept(ids: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first)
    return ids[np.repeat(keep, n)], np.concatenate([[0], np.cumsum(np.where(keep, n, 0))])


def _digests(a, a_group, b, b_group, groups, va: Vocabulary, vb: Vocabulary, group_first: np.ndarray) -> list[str]:
    """Digest of every row's groups; groups are numbered over all rows, row i has group_first[i]:group_first[i + 1]."""
    na, nb = len(a), len(b)
    a_first, b_first = np.searchsorted(a_group, np.arange(groups + 1)), np.searchsorted(b_group, np.arange(groups + 1))
    at_a, at_b = np.arange(na) + b_first[a_group], np.arange(nb) + a_first[b_group + 1]
    width = max(va.width, vb.width) + 1
    line, used = np.zeros((na + nb, width), np.uint8), np.zeros(na + nb, np.int64)
    line[at_a, : va.width], used[at_a] = va.text[a], va.digits[a]
    line[at_b, : vb.width], used[at_b] = vb.text[b], vb.digits[b]
    mark = np.full(na + nb, ord(","), np.uint8)
    mark[at_a[a_first[1:] - 1]] = ord("|")
    mark[at_b[b_first[1:] - 1]] = ord(";")
    line[np.arange(na + nb), used] = mark
    flat = line[np.arange(width) <= used[:, None]]
    ends = np.concatenate([[0], np.cumsum(used + 1)])[(a_first + b_first)[group_first]]
    raw = flat.tobytes()
    return [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class Aligned:
    """Links of a slice of texts: per row counts and digests, and (row, a, b) of every link."""

    def __init__(self, texts: list[str], sides):
        encode_a, va, encode_b, vb = sides
        a, a_first = _flat(encode_a([" " + t if t else "" for t in texts]))
        b, b_first = _flat(encode_b(texts))
        parts = [(" " + t).encode() if t else b"" for t in texts]
        want = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        keep = _whole(a, a_first, va, want, ends) & _whole(b, b_first, vb, want, ends)
        (a, a_first), (b, b_first) = _kept(a, a_first, keep), _kept(b, b_first, keep)
        a_ends, b_ends = np.cumsum(va.length[a]), np.cumsum(vb.length[b])
        size = np.concatenate([[0], np.cumsum(np.where(keep, np.diff(ends), 0))])
        cut, both = np.zeros(int(size[-1]) + 1, np.uint8), 0
        cut[a_ends] += 1
        cut[b_ends] += 2
        both = np.flatnonzero(cut == 3)
        stops = np.flatnonzero(cut)
        self.n_a, self.n_b = np.diff(a_first), np.diff(b_first)
        at = np.searchsorted(stops, size, side="right")
        self.n_links = np.diff(at)
        of = np.searchsorted(both, size, side="right")
        self.n_groups = np.diff(of)
        self.row = np.repeat(np.arange(len(texts)), self.n_links)
        self.a, self.b = a[np.searchsorted(a_ends, stops)], b[np.searchsorted(b_ends, stops)]
        self.digests = _digests(a, np.searchsorted(both, a_ends), b, np.searchsorted(both, b_ends), len(both), va, vb, of)


LINKS = "block long, stripe int, pairs binary, documents binary, rows binary, place binary, times binary"
DOCS = "doc_id long, row int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _packed(block: int, size: int, row: np.ndarray, a: np.ndarray, b: np.ndarray, stripes: int, wide: int) -> Iterator[pa.RecordBatch]:
    """One row for each stripe of a block: link i lies in document rows[i] with pair pairs[place[i]], times[i] times."""
    key = ((a % stripes) * wide + (a // stripes) * size + b) * BLOCK_ROWS + row
    key, times = np.unique(key, return_counts=True)
    pair, row = key // BLOCK_ROWS, key % BLOCK_ROWS
    new = np.flatnonzero(np.diff(pair, prepend=-1))
    place = np.cumsum(np.diff(pair, prepend=-1) != 0) - 1
    documents = np.diff(np.append(new, len(pair)))
    distinct = pair[new]
    stripe = distinct // wide
    heads = np.flatnonzero(np.diff(stripe, prepend=-1))
    rows = []
    for x, y in zip(heads.tolist(), [*heads[1:].tolist(), len(distinct)], strict=True):
        lo, hi = int(new[x]), int(new[y]) if y < len(new) else len(pair)
        rows.append((block, int(stripe[x]), (distinct[x:y] % wide).astype(np.uint32).tobytes(), documents[x:y].astype(np.uint32).tobytes(), row[lo:hi].astype(np.uint16).tobytes(), (place[lo:hi] - x).astype(np.uint32).tobytes(), times[lo:hi].astype(np.uint32).tobytes()))
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 64], strict=True), kinds, strict=True)], names=[f.split()[0] for f in LINKS.split(", ")])


def _null_columns(n: int, schema: str) -> list[pa.Array]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return [pa.nulls(n, kinds[f.split()[1]]) for f in schema.split(", ")]


def encoded(docs: DataFrame, a_path: str, b_path: str, ranks_path: str | None, pattern: str | None) -> DataFrame:
    """Rows of LINKS (stripe is set) and rows of DOCS (stripe is null) of every block."""
    names = [f.split()[0] for f in f"{LINKS}, {DOCS}".split(", ")]

    def run(batches):
        from pyspark import TaskContext

        sides = _sides(a_path, b_path, ranks_path, pattern)
        size, wide = sides[3].size, -(-sides[1].size // STRIPES) * sides[3].size
        block, held, rows, links = TaskContext.get().partitionId() << 33, [], 0, 0

        def flush():
            row, a, b = (np.concatenate([h[i] for h in held]) for i in range(3))
            if len(row):
                for out in _packed(block, size, row, a, b, STRIPES, wide):
                    yield pa.RecordBatch.from_arrays([*out.columns, *_null_columns(out.num_rows, DOCS)], names=names)

        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                for x in range(lo, hi, BLOCK_ROWS):
                    y = min(hi, x + BLOCK_ROWS)
                    got = Aligned([t or "" for t in batch.column(1).slice(x, y - x).to_pylist()], sides)
                    if held and (rows + y - x > BLOCK_ROWS or links + len(got.row) > BLOCK_LINKS):
                        yield from flush()
                        block, held, rows, links = block + 1, [], 0, 0
                    held.append((got.row + rows, got.a, got.b))
                    counts = [pa.array(c, pa.int64()) for c in (got.n_a, got.n_b, got.n_groups, got.n_links)]
                    own = [batch.column(0).slice(x, y - x).cast(pa.int64()), pa.array(np.arange(rows, rows + y - x), pa.int32()), *counts, pa.array(got.digests, pa.string())]
                    empty = _null_columns(y - x, LINKS)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(y - x, block)), *empty[1:], *own], names=names)
                    rows, links = rows + y - x, links + len(got.row)
        if held:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, f"{LINKS}, {DOCS}")


def _summed(parts: DataFrame, keys: list[str], size: int, rows: int, tasks: int) -> DataFrame:
    """Packed counts (keys, pairs, documents) added up in a dense matrix for each value of keys."""

    def run(batches):
        matrix, key, kinds = np.zeros(rows * size, np.int64), None, [pa.int32()] * len(keys)

        def out():
            at = np.flatnonzero(matrix)
            row = [pa.array([k], t) for k, t in zip(key, kinds, strict=True)]
            full = pa.RecordBatch.from_arrays([*row, pa.array([at.astype(np.uint32).tobytes()], pa.binary()), pa.array([matrix[at].tobytes()], pa.binary())], names=[*keys, "pairs", "documents"])
            matrix[at] = 0
            return full

        for batch in batches:
            n = len(keys)
            for *now, pairs, documents in zip(*(batch.column(i).to_pylist() for i in range(n)), batch.column(n), batch.column(n + 1), strict=True):
                if key is not None and now != key:
                    yield out()
                key = now
                counts = np.frombuffer(documents.as_buffer(), np.uint32 if "salt" in keys else np.int64)
                np.add.at(matrix, np.frombuffer(pairs.as_buffer(), np.uint32), counts.astype(np.int64))
        if key is not None:
            yield out()

    dealt = parts.select(*keys, "pairs", "documents").repartition(tasks, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, ", ".join([*(f"{k} int" for k in keys), "pairs binary", "documents binary"]))


def _scored(counts: DataFrame, links: DataFrame, size: int, rows: int, tasks: int) -> DataFrame:
    """For each packed row of links: its documents' n_best and count_sum (block, rows, best, total)."""
    none = F.lit(None).cast("binary")
    both = counts.select("stripe", "salt", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), "pairs", "documents", none.alias("place"), none.alias("times")).unionAll(
        links.select("stripe", "salt", F.lit(1), "block", "pairs", F.col("rows"), "place", "times")
    )

    def run(batches):
        matrix, best, filled = np.zeros(rows * size, np.int64), None, np.empty(0, np.uint32)
        for batch in batches:
            out = []
            for kind, block, pairs, second, place, times in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), *(batch.column(i) for i in (4, 5, 6, 7)), strict=True):
                at = np.frombuffer(pairs.as_buffer(), np.uint32)
                if kind == 0:
                    matrix[filled] = 0
                    filled = at
                    np.add.at(matrix, at, np.frombuffer(second.as_buffer(), np.int64))
                    best = matrix.reshape(rows, size).max(axis=1)
                    continue
                at = at[np.frombuffer(place.as_buffer(), np.uint32)]
                n, by = np.frombuffer(times.as_buffer(), np.uint32).astype(np.int64), np.frombuffer(second.as_buffer(), np.uint16)
                count = matrix[at]
                which, back = np.unique(by, return_inverse=True)
                won, total = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
                np.add.at(won, back, np.where(count == best[at // size], n, 0))
                np.add.at(total, back, count * n)
                out.append((block, which.tobytes(), won.tobytes(), total.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), *[pa.binary()] * 3], strict=True)], names=["block", "rows", "best", "total"])

    dealt = both.repartition(tasks, "stripe", "salt").sortWithinPartitions("stripe", "salt", "kind")
    return dealt.mapInArrow(run, "block long, rows binary, best binary, total binary")


def _gathered(scores: DataFrame, docs: DataFrame, tasks: int) -> DataFrame:
    """The documents of every block beside the sums of its packed scores."""
    own = [f.split()[0] for f in DOCS.split(", ")]
    both = scores.select("block", F.lit(0).alias("kind"), "rows", "best", "total", *(F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in DOCS.split(", "))).unionAll(
        docs.select("block", F.lit(1), *(F.lit(None).cast("binary") for _ in range(3)), *own)
    )

    def run(batches):
        sums, of = np.zeros((2, BLOCK_ROWS), np.int64), None
        for batch in batches:
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1, [len(blocks)]])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                if of != blocks[lo]:
                    sums[:], of = 0, blocks[lo]
                if kinds[lo] == 0:
                    for rows, best, total in zip(*(batch.column(i).slice(lo, hi - lo) for i in (2, 3, 4)), strict=True):
                        at = np.frombuffer(rows.as_buffer(), np.uint16)
                        sums[0, at] += np.frombuffer(best.as_buffer(), np.int64)
                        sums[1, at] += np.frombuffer(total.as_buffer(), np.int64)
                    continue
                part = batch.slice(lo, hi - lo)
                at = part.column(6).to_numpy()
                yield pa.RecordBatch.from_arrays([part.column(5), *(part.column(i) for i in (7, 8, 9, 10)), pa.array(sums[0, at]), pa.array(sums[1, at]), part.column(11)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    dealt = both.repartition(tasks, "block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align(docs: DataFrame, a_path: str, b_path: str, ranks_path: str | None = None, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of documents (doc_id, counts, n_best, count_sum, groups_sha256), and packed counts of the id pairs by stripe.

    a_path is a byte-level BPE's JSON file (ranks_path and pattern: the same vocabulary as ranks, for speed; ids are
    the same), b_path a sentencepiece model that adds the leading space itself.
    """
    spark = docs.sparkSession
    made = stored(encoded(docs, a_path, b_path, ranks_path, pattern))
    links, rows = made.where("stripe IS NOT NULL"), made.where("stripe IS NULL")
    _, va, _, vb = _sides(a_path, b_path, ranks_path, pattern)
    high = -(-va.size // STRIPES)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    volume = links.agg(F.sum(F.length("place") * 2.5)).first()[0] or 0
    salts = max(1, math.ceil(volume / (STRIPES * PART_BYTES)))
    tasks = max(tasks, min(STRIPES * salts, math.ceil(volume / PART_BYTES)))
    links = links.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    some = stored(_summed(links, ["stripe", "salt"], vb.size, high, tasks))
    counts = stored(_summed(some.drop("salt"), ["stripe"], vb.size, high, tasks))
    spread = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    scores = stored(_scored(spread, links, vb.size, high, tasks))
    out = stored(_gathered(scores, rows, tasks))
    dropped(spark, made, some, scores)
    return out, counts


def pair_counts(counts: DataFrame, size: int) -> DataFrame:
    """The packed counts as rows (a, b, documents); size is the number of B ids."""

    def run(batches):
        for batch in batches:
            for stripe, pairs, documents in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                at = np.frombuffer(pairs.as_buffer(), np.uint32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at // size * STRIPES + stripe), pa.array(at % size), pa.array(np.frombuffer(documents.as_buffer(), np.int64))], names=["a", "b", "documents"])

    return counts.select("stripe", "pairs", "documents").mapInArrow(run, "a long, b long, documents long")


def digest(docs: DataFrame, a_path: str, b_path: str, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The contract's columns."""
    out, counts = align(docs, a_path, b_path, ranks_path, pattern)
    dropped(docs.sparkSession, counts)
    return out
