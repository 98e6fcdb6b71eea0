"""Benchmark decontamination by a hash set of normalised test n-grams.

Words are maximal runs of digits, ASCII letters and non-ASCII characters,
ASCII lower-cased.  Each benchmark item gives its windows of ``n`` consecutive
words (an item of fewer words gives one shorter window).  Training texts are
scanned window by window against a hash set; every hash hit is confirmed on
the words themselves, so results are exact.

Up to ``broadcast_bytes`` of benchmark text the windows are broadcast.  Beyond
it a fixed-size Bloom filter is broadcast and the surviving windows meet the
benchmark's in a shuffled equi-join; both ways give the same rows.

Defined cases: null, empty and word-less texts have no words and are clean;
null or word-less items have no windows; repeated items each count; repeated
documents are reported one by one; an empty benchmark leaves all clean.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import stored
from ._text import ALNUM, Words, chunks, run_hashes, text_bytes

BROADCAST_BYTES = 2 << 20
BLOOM_BITS = 1 << 27


def item_windows(items: pa.Table | pa.RecordBatch, n: int) -> Iterator[tuple[int, int, bytes, str]]:
    """(hash, length, window, item id) of each window; words of a window are joined by a space."""
    ids = items.column(0).to_pylist()
    raw, offsets = text_bytes(items.column(1))
    for lo, hi in chunks(offsets):
        words = Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM)
        whole = {int(c) for c in words.counts if 0 < c < n}
        for size in sorted(whole | {n}):
            hashes, at = run_hashes(words, size)
            keep = words.counts[words.row[at]] == size if size < n else np.ones(len(at), bool)
            for h, i in zip(hashes[keep].tolist(), at[keep].tolist(), strict=True):
                yield h, size, words.joined(i, i + size), ids[lo + words.row[i]]


class WindowSet:
    """Benchmark windows by length: sorted hashes, a bitmap ahead of them, and the windows with their items."""

    def __init__(self, windows: Iterator[tuple[int, int, bytes, str]], bits: int = 22):
        self.bits = bits
        sets: dict[int, dict[int, dict[bytes, set[str]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
        for h, size, window, item in windows:
            sets[size][h][window].add(item)
        self.items = {s: {h: {w: tuple(sorted(i)) for w, i in m.items()} for h, m in x.items()} for s, x in sets.items()}
        self.maps = {}
        for size, by_hash in self.items.items():
            at = np.zeros(1 << bits, dtype=bool)
            at[np.fromiter(by_hash, np.uint64, len(by_hash)) & np.uint64((1 << bits) - 1)] = True
            self.maps[size] = np.packbits(at)

    def opened(self) -> dict[int, np.ndarray]:
        return {s: np.unpackbits(m).astype(bool) for s, m in self.maps.items()}


def _report(words: Words, rows: int, found: list[tuple[int, int, tuple[str, ...]]]) -> list[tuple[list[str], list[int]]]:
    """Per row: its items, and the flat [start, end) word ranges that are hit."""
    items: dict[int, set[str]] = defaultdict(set)
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, size, hit in found:
        row = int(words.row[i])
        items[row].update(hit)
        spans[row].append((i - int(words.first[row]), i - int(words.first[row]) + size))
    out = []
    for row in range(rows):
        merged: list[int] = []
        for a, b in sorted(spans.get(row, ())):
            if merged and a <= merged[-1]:
                merged[-1] = max(merged[-1], b)
            else:
                merged += [a, b]
        out.append((sorted(items.get(row, ())), merged))
    return out


def scan_batch(column: pa.Array, known: WindowSet, maps: dict[int, np.ndarray]) -> tuple[list[int], list[list[str]], list[list[int]]]:
    """Word count, items and hit word ranges of each text of a batch."""
    raw, offsets = text_bytes(column)
    counts: list[int] = []
    items: list[list[str]] = []
    spans: list[list[int]] = []
    mask = np.uint64((1 << known.bits) - 1)
    for lo, hi in chunks(offsets):
        words = Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM)
        found = []
        for size, by_hash in known.items.items():
            hashes, at = run_hashes(words, size)
            likely = np.flatnonzero(maps[size][hashes & mask])
            for h, i in zip(hashes[likely].tolist(), at[likely].tolist(), strict=True):
                if (by_window := by_hash.get(h)) and (hit := by_window.get(words.joined(i, i + size))):
                    found.append((i, size, hit))
        counts += words.counts.tolist()
        for a, b in _report(words, hi - lo, found):
            items.append(a)
            spans.append(b)
    return counts, items, spans


def _scan_broadcast(docs: DataFrame, bench: DataFrame, n: int) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast(WindowSet(item_windows(bench.toArrow(), n)))
    names = docs.columns
    at = names.index("text")

    def scan(batches):
        maps = known.value.opened()
        for batch in batches:
            counts, items, spans = scan_batch(batch.column(at), known.value, maps)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int32()))],
                names=[*(f"c{i}" for i in range(len(names))), "n_words", "items", "hits"],
            )

    return docs.mapInArrow(scan, _out_schema(docs))


def _out_schema(docs: DataFrame) -> T.StructType:
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    return T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hits", T.ArrayType(T.IntegerType()))])


def _scan_shuffled(docs: DataFrame, bench: DataFrame, n: int, bloom_bits: int) -> DataFrame:
    """The way for a benchmark too large to broadcast: Bloom filter, then an equi-join on the window itself."""
    spark = docs.sparkSession

    def windows(batches):
        for batch in batches:
            rows = list(item_windows(batch, n))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] - (1 << 64) if x[0] >> 63 else x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.binary()), pa.array([x[3] for x in rows], pa.string())],
                names=["h", "size", "window", "item"],
            )

    test = bench.mapInArrow(windows, "h long, size int, window binary, item string").distinct()
    sizes = sorted(r["size"] for r in test.select("size").distinct().collect())
    blocks = test.select(F.pmod("h", F.lit(bloom_bits)).alias("b")).groupBy((F.col("b") / F.lit(1 << 16)).cast("long").alias("part")).agg(F.collect_set(F.col("b")).alias("bits"))
    bloom = np.zeros(bloom_bits, dtype=bool)
    for r in blocks.toLocalIterator():
        bloom[r["bits"]] = True
    shared = spark.sparkContext.broadcast(np.packbits(bloom))

    named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # docs may have columns of any name
    keyed = stored(named.withColumn("row", F.monotonically_increasing_id()))  # numbered once: both sides of the join read the same keys, also after a retry
    names = keyed.columns
    at, key = docs.columns.index("text"), len(docs.columns)

    def likely(batches):
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            raw, offsets = text_bytes(batch.column(at))
            ids = np.asarray(batch.column(key))
            for lo, hi in chunks(offsets):
                words = Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM)
                for size in sizes:
                    hashes, first = run_hashes(words, size)
                    found = first[bits[(hashes.view(np.int64) % bloom_bits)]]
                    row = words.row[found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[lo + row]), pa.array((found - words.first[row]).astype(np.int32)), pa.array(np.full(len(found), size, np.int32)), pa.array([words.joined(i, i + size) for i in found.tolist()], pa.binary())],
                        names=["row", "at", "size", "window"],
                    )

    hits = (
        keyed.mapInArrow(likely, "row long, at int, size int, window binary")
        .join(test.select("window", "item"), "window")
        .groupBy("row")
        .agg(F.sort_array(F.collect_set("item")).alias("items"), F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("size")).alias("to")))).alias("runs"))
    )

    def counted(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(at))
            counts = [c for lo, hi in chunks(offsets) for c in Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM, hashed=False).counts.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*(f"c{i}" for i in range(len(names))), "n_words"])

    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(keyed.schema.fields)]
    all_rows = keyed.mapInArrow(counted, T.StructType([*fields, T.StructField("n_words", T.LongType())])).withColumnRenamed(f"c{key}", "row")
    merged = F.aggregate(
        "runs",
        F.array().cast("array<int>"),
        lambda done, r: F.when(F.coalesce(F.try_element_at(done, F.lit(-1)) >= r["at"], F.lit(False)), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.greatest(F.element_at(done, -1), r["to"])))).otherwise(
            F.concat(done, F.array(r["at"], r["to"]))
        ),
    )
    none = F.array().cast("array<string>")
    return all_rows.join(hits, "row", "left").select(*(f"c{i}" for i in range(len(names)) if i != key), "n_words", F.coalesce("items", none).alias("items"), F.when(F.col("runs").isNull(), F.array().cast("array<int>")).otherwise(merged).alias("hits"))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 13, broadcast_bytes: int = BROADCAST_BYTES, bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """All columns of docs, then n_words, items (ids of the items found, sorted as strings) and hits.

    hits lists the merged word ranges [start, end) inside windows, flattened.
    docs needs a column text, benchmark item_id and text.  Columns of docs named
    like a result column are replaced by it (``clean`` keeps them).
    """
    docs = docs.drop("n_words", "items", "hits")
    return _scan(docs, benchmark, n, broadcast_bytes, bloom_bits).toDF(*docs.columns, "n_words", "items", "hits")


def _scan(docs: DataFrame, benchmark: DataFrame, n: int, broadcast_bytes: int = BROADCAST_BYTES, bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """docs' columns as c0, c1, ..., then n_words, items and hits."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text")).where("text is not null and item_id is not null")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("b")).first()["b"]
    return _scan_broadcast(docs, bench, n) if size <= broadcast_bytes else _scan_shuffled(docs, bench, n, bloom_bits)


def n_hit(hits: str = "hits"):
    """Number of hit words from the merged ranges."""
    signed = F.transform(hits, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long"))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda s, x: s + x)


def contaminated(n_hit_words, n_words, share: int = 20):
    """The contract's rule: some words hit, and at least one in ``share``."""
    return (n_hit_words > 0) & (n_hit_words * F.lit(share) >= n_words)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 13, spans: bool = False, **options) -> DataFrame:
    """Documents without contamination; with spans, contaminated ones stay and lose the hit words.

    Columns are those of docs.  Removed spans leave the text before and after them.
    """
    found = _scan(docs, benchmark, n, **options)
    own = [f"c{i}" for i in range(len(docs.columns))]
    if not spans:
        return found.where(~contaminated(n_hit(), F.col("n_words"))).select(*own).toDF(*docs.columns)
    names, at = found.columns, docs.columns.index("text")

    def cut(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            hits = batch.column(names.index("hits")).to_pylist()
            out = [t if not h else cut_words(t, h) for t, h in zip(texts, hits, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.column(i).type) if i == at else batch.column(i) for i in range(len(names))], names=names)

    return found.mapInArrow(cut, found.schema).select(*own).toDF(*docs.columns)


def cut_words(text: str, hits: list[int]) -> str:
    """The text without the words of the given ranges and what stands between them."""
    raw = text.encode()
    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM, hashed=False)
    keep, at = [], 0
    for a, b in zip(hits[::2], hits[1::2], strict=True):
        keep.append(raw[at : words.start[a]])
        at = int(words.end[b - 1])
    return b"".join([*keep, raw[at:]]).decode()


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from a scan."""
    return found.withColumn("_hit", n_hit()).select(
        "doc_id",
        "n_words",
        F.col("_hit").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("_hit"), F.col("n_words")).alias("contaminated"),
    )
