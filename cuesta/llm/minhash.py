"""MinHash near-duplicate detection with circulant signatures.

A document's set holds its distinct shingles of ``shingle`` words (ASCII
lower-cased, split at ASCII white space); a shorter text is one shingle.  One
permutation scatters the shingles over Z(2**32), a second one, shifted
circularly by k, gives coordinate k of the signature (C-MinHash).  Bands of
``rows`` coordinates make candidate buckets; the number of bands is the least
with which a pair at the threshold is missed with probability under ``miss``.

Copies (equal word sequences) form a class and are never compared.  Within a
bucket every class is compared with its lead (the class that meets most others
in its buckets) on the full sets; classes that do not end up in the lead's
component are then compared, in blocks of sets, with all classes that share the
lead.  So every pair of a bucket is either in one component already or
compared: no bucket is capped, no link between components is lost, and n near
copies of one text cost n comparisons.  Only classes that fail with their lead
cost more, in a task for each pair of blocks.

Defined cases: null, empty and blank texts have an empty set and stand alone;
repeated rows form a class; a row without doc_id takes part, gets its
component's id and is not kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import dropped, stored
from ._text import NOT_SPACE, Words, chunks, mix64, run_hashes, text_bytes
from .components import components

BLOCK = 1 << 14
BLOCK_SETS = 256
SEED_SCATTER = np.uint32(0x5BD1E995)


def bands_for(threshold: float, rows: int, miss: float) -> int:
    b = 1
    while (1 - threshold**rows) ** b > miss:
        b += 1
    return b


def signature(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """(sets, k) circulant MinHash coordinates; set i is hashes[starts[i]:starts[i + 1]], none empty."""
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    x = folded ^ SEED_SCATTER  # the scattering permutation
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    out = np.empty((len(starts) - 1, k), dtype=np.uint32)
    lo = 0
    while lo < len(starts) - 1:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + BLOCK, side="right")) - 1)
        part, first = x[starts[lo] : starts[hi]], starts[lo:hi] - starts[lo]
        y, z = np.empty_like(part), np.empty_like(part)
        for j in range(k):
            np.add(part, np.uint32(j), out=y)  # circular shift, then the second permutation
            np.multiply(y, np.uint32(0x9E3779B1), out=y)
            np.right_shift(y, np.uint32(15), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint32(0x85EBCA77), out=y)
            np.right_shift(y, np.uint32(13), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint32(0xC2B2AE3D), out=y)
            out[lo:hi, j] = np.minimum.reduceat(y, first)
        lo = hi
    return out


def shingle_sets(words: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row of a slice, sorted: (hashes, boundaries)."""
    hashes, at = run_hashes(words, shingle)
    row = words.row[at]
    for size in range(1, shingle):
        if (words.counts == size).any():
            h, a = run_hashes(words, size)
            whole = words.counts[words.row[a]] == size
            hashes, row = np.concatenate([hashes, h[whole]]), np.concatenate([row, words.row[a[whole]]])
    order = np.argsort(row, kind="stable")
    hashes, row = hashes[order], row[order]
    bounds = np.searchsorted(row, np.arange(len(words.counts) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.searchsorted(row[new], np.arange(len(words.counts) + 1))


def _sets(batch_column: pa.Array, shingle: int):
    """(first row, words, set hashes, set boundaries) of each slice of a column."""
    raw, offsets = text_bytes(batch_column)
    for lo, hi in chunks(offsets):
        words = Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], NOT_SPACE)
        yield lo, words, *shingle_sets(words, shingle)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sig), bands), dtype=np.uint64)
    parts = sig.astype(np.uint64).reshape(len(sig), bands, rows)
    for j in range(rows):
        keys = mix64((keys + parts[:, :, j]) * np.uint64(0x9FB21C651E98DF25) + np.uint64(j))
    return (keys ^ (np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[None, :]).view(np.int64)


def signed_documents(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, class, n, bands): the class key of the word sequence, the set's size and the band keys.

    bands is null for empty sets and where the same task has given the class's bands before.
    """

    def sign(batches):
        seen: set[bytes] = set()
        for batch in batches:
            ids = batch.column(0)
            for lo, words, hashes, bounds in _sets(batch.column(1), shingle):
                sizes = np.diff(bounds)
                keys = [hashlib.blake2b(words.hash[a:b].tobytes(), digest_size=16).digest() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                fresh = []
                for i, key in enumerate(keys):
                    if sizes[i] and key not in seen:
                        seen.add(key)
                        fresh.append(i)
                if len(seen) > 500_000:
                    seen.clear()
                out: list[np.ndarray | None] = [None] * len(keys)
                if fresh:
                    at = np.array(fresh)
                    starts = np.concatenate([[0], np.cumsum(sizes[at])])
                    picked = np.concatenate([hashes[bounds[i] : bounds[i + 1]] for i in fresh])
                    for i, b in zip(fresh, band_keys(signature(picked, starts, bands * rows), bands, rows), strict=True):
                        out[i] = b
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, len(keys)), pa.array(keys, pa.binary()), pa.array(sizes.astype(np.int64)), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "class", "n", "bands"]
                )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, class binary, n long, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int, bits: int = 1 << 24) -> DataFrame:
    """(id, set) for the doc_ids in wanted(id), and perhaps a few more: a Bloom bitmap of fixed size goes to the scan."""
    spark = docs.sparkSession
    bloom = np.zeros(bits, dtype=bool)
    marked = wanted.select(F.pmod(F.xxhash64("id"), F.lit(bits)).alias("b")).groupBy((F.col("b") / F.lit(1 << 12)).cast("long").alias("part")).agg(F.collect_set("b").alias("bits"))
    for r in marked.toLocalIterator():
        bloom[r["bits"]] = True
    shared = spark.sparkContext.broadcast(np.packbits(bloom))
    keyed = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("b"))

    def build(batches):
        known = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(known[batch.column(2).to_numpy()]))
            for lo, _, hashes, bounds in _sets(batch.column(1), shingle):
                values = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(values)), values], names=["id", "set"])

    return keyed.mapInArrow(build, "id long, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    one = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return both.where(100 * F.col("shared") >= percent * (F.size("sa") + F.size("sb") - F.col("shared"))).select("a", "b")


def residual_links(placed: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK_SETS) -> DataFrame:
    """Links (a, b) between members of a group (the buckets of one lead) in different components.

    placed(lead, lead_label, id, label, n) lists the members.  The ones outside
    their lead's component meet all members, in blocks of about ``block`` sets
    each: a task compares two blocks and returns true links only.
    """
    sizes = placed.groupBy("lead").agg(F.count("*").alias("size"), F.count_if(F.col("label") != F.col("lead_label")).alias("open")).where("open > 0")

    def parts(of: str) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.col(of) / block)).cast("int")

    grouped = placed.join(sizes, "lead").select("*", parts("open").alias("rows"), parts("size").alias("columns"))
    side = F.col("label") != F.col("lead_label")
    rows = grouped.where(side).select("lead", F.lit(0).alias("side"), "id", "label", F.pmod(F.xxhash64("id"), F.col("rows")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"))
    columns = grouped.select("lead", F.lit(1).alias("side"), "id", "label", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod(F.xxhash64("id"), F.col("columns")).cast("int").alias("j"))
    cells = rows.union(columns.select("lead", "side", "id", "label", "i", "j")).join(sets, "id")

    def compare(cell: pa.Table) -> pa.Table:
        side = cell["side"].to_numpy()
        ids, labels = cell["id"].to_numpy(), cell["label"].to_numpy()
        lists = cell["set"].combine_chunks()
        starts = lists.offsets.to_numpy()
        values, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        sizes = np.diff(starts)
        owner = np.repeat(np.arange(len(ids)), sizes)
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        place = np.full(len(ids), -1)
        place[one] = np.arange(len(one))
        place[two] = np.arange(len(two))
        shared = np.zeros((len(one), len(two)), dtype=np.float32)
        width = 1 << 13
        for lo in range(0, len(values), width):  # dense products over bounded runs of shingles
            at = np.flatnonzero((code >= lo) & (code < lo + width))
            bits = [np.zeros((len(x), min(width, len(values) - lo)), dtype=np.float32) for x in (one, two)]
            for k in (0, 1):
                on = at[side[owner[at]] == k]
                bits[k][place[owner[on]], code[on] - lo] = 1
            shared += bits[0] @ bits[1].T
        shared = np.rint(shared).astype(np.int64)
        union = sizes[one][:, None] + sizes[two][None, :] - shared
        x, y = np.nonzero((100 * shared >= percent * union) & (labels[one][:, None] != labels[two][None, :]))
        a, b = ids[one[x]], ids[two[y]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return cells.groupBy("lead", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, rows: int = 4, miss: float = 1e-5) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, kept) of each row of docs(doc_id, text).

    Linked are documents whose sets have a Jaccard similarity of percent/100 or
    more.  component_id is the least doc_id reachable over links; kept is
    doc_id = component_id; n_links counts the verified links of the row's class
    to other classes that the search drew.
    """
    bands = bands_for(percent / 100, rows, miss)
    signed = stored(signed_documents(docs, shingle, bands, rows))
    classes = stored(
        signed.where("n > 0")
        .groupBy("class")
        .agg(F.min("doc_id").alias("id"), F.max("n").alias("n"), F.max("bands").alias("bands"))
        .where("id is not null")
    )
    members = classes.select("id", "n", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    filled = stored(members.join(sizes, "key"))
    known = filled.groupBy("id").agg((-F.sum("size")).alias("rank"))
    ranked = filled.join(known, "id").select("key", "id", "n", "rank")
    leads = ranked.groupBy("key").agg(F.min(F.struct("rank", "id", "n")).alias("lead"))
    buckets = stored(ranked.join(leads, "key").select("key", "id", "n", F.col("lead.id").alias("lead"), F.col("lead.n").alias("lead_n")))

    def in_length(n, m):
        return 100 * F.least(n, m) >= percent * F.greatest(n, m)

    first = stored(buckets.where("id <> lead").where(in_length(F.col("n"), F.col("lead_n"))).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct())
    sets = stored(sets_of(docs, buckets.select("id").distinct(), shingle))
    links = stored(verified(first, sets, percent))
    labels = components(links)

    def label(name: str) -> DataFrame:
        return labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label"))

    placed = stored(
        buckets.select("lead", "id", "n")
        .distinct()
        .join(label("id"), "id", "left")
        .join(label("lead"), "lead", "left")
        .select("id", "n", "lead", F.coalesce("id_label", "id").alias("label"), F.coalesce("lead_label", "lead").alias("lead_label"))
    )
    more = stored(residual_links(placed, sets, percent))
    if not more.isEmpty():
        links = links.union(more)
        labels = components(links)
    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count("*").alias("n_links"))
    of_class = classes.join(labels.withColumnRenamed("node", "id"), "id", "left").join(degree, "id", "left").select("class", F.coalesce("label", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = (
        signed.select("doc_id", F.when(F.col("n") > 0, F.col("class")).alias("class"), F.col("n").alias("n_shingles"))
        .join(of_class, "class", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
    dropped(docs.sparkSession, buckets, first, sets, placed)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay: one document of each component, every document without words.

    Rows that repeat both id and text count once; rows without doc_id stay.
    """
    kept = near_duplicates(docs, **options).where("kept").select(F.col("doc_id").alias("kept")).distinct()
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # docs may have columns of any name
    id_, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    named = rows.join(kept, F.col(id_) == F.col("kept"), "left_semi").dropDuplicates([id_, text])
    return named.union(rows.where(F.col(id_).isNull())).toDF(*docs.columns)
