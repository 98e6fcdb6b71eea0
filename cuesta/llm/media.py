"""Media columns kept as content-defined chunks.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are
the 8-bit mono samples of a WAV file: the stored form.  The file is cut where
a rolling gear hash of the last 16 bytes has ``bits`` zero bits, with least
and largest chunk sizes; so equal passages give equal chunks wherever they
stand.  A medium is an ordered list of chunk digests.

``chunk_store`` writes every chunk to tables in the shared folder.  Digests
that occur more than once, in one medium or in several, are found with Spark
aggregation; each of their chunks is stored once, under its digest.  A chunk
that occurs once is stored in the pack of its only medium, in order, beside
the digests of the medium's other chunks.  ``rebuilt_media`` reads packs and
chunks back, joins by digest what a pack only names, and verifies every file
against the digest taken before it was cut.  The features come from the
samples of files rebuilt so, never from the text.

A fixed-size Bloom filter of the repeated digests tells the packing scan which
chunks occur once: a false hit moves a chunk to the other table, a full filter
moves all of them, and neither changes a result.  Copies of a text are one
medium: all their chunks are repeated ones.

Defined cases: null and empty texts are 64 zero bytes; repeated rows give
repeated, equal results; of docs only ``doc_id`` and ``text`` are read, other
columns are left out; an empty table gives empty tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import stored
from ._text import chunks, text_bytes

GEAR = np.random.default_rng(64).integers(0, 1 << 16, 256, dtype=np.uint16)
LEAST, LARGEST, BITS = 512, 16384, 11
RATE = 8000


def payload(data: bytes) -> bytes:
    """The bytes padded with zeros to a positive multiple of 64."""
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def wav(samples: bytes) -> bytes:
    """An 8-bit mono PCM WAV file of the samples."""
    n = len(samples)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + samples


def samples(media: bytes) -> bytes:
    """The samples of a file made by wav()."""
    kind, size, form, _, fmt, channels, _, _, _, width, mark, n = struct.unpack("<4sI8sIHHIIHH4sI", media[:44])
    if (kind, form, fmt, channels, width, mark) != (b"RIFF", b"WAVEfmt ", 1, 1, 8, b"data") or len(media) != 44 + n or size != 36 + n:
        raise ValueError("not a file of 8-bit mono samples")
    return media[44:]


def cuts(data: bytes, least: int = LEAST, largest: int = LARGEST, bits: int = BITS) -> list[int]:
    """Ends of the chunks of data: content-defined by a gear hash over 16 bytes, so 16 bits of it suffice."""
    n = len(data)
    if n <= least:
        return [n]
    g = GEAR[np.frombuffer(data, np.uint8)]
    h = g.copy()
    for j in range(1, 16):
        h[j:] += g[:-j] << np.uint16(j)
    marks = (np.flatnonzero((h >> np.uint16(16 - bits)) == 0) + 1).tolist()
    out, at = [], 0
    for m in marks:
        while m - at > largest:
            at += largest
            out.append(at)
        if m - at >= least:
            at = m
            out.append(at)
    while n - at > largest:
        at += largest
        out.append(at)
    if at < n:
        out.append(n)
    return out


def split(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest16(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def described(media: bytes) -> tuple[int, str, int, int, str, str]:
    """(payload bytes, payload sha256, crc32 of the last 64, media bytes, media sha256, features) read back from a stored file."""
    body = samples(media)
    x = np.frombuffer(body, np.uint8).astype(np.float64)
    counts = np.bincount(np.frombuffer(body, np.uint8), minlength=256) / len(body)
    some = counts[counts > 0]
    crossings = int(np.count_nonzero(np.diff(x > x.mean())))
    features = f"mean={x.mean():.4f};deviation={x.std():.4f};peak={int(x.max())};crossings={crossings};entropy={float(-(some * np.log2(some)).sum()) + 0.0:.4f}"
    return len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(media), hashlib.sha256(media).hexdigest(), features


def _texts(column: pa.Array):
    """(row, bytes) of a text column."""
    raw, offsets = text_bytes(column)
    for i in range(len(offsets) - 1):
        yield i, raw[offsets[i] : offsets[i + 1]].tobytes()


def _distinct_media(column: pa.Array, seen: set[bytes]):
    """(row, size of the text, key, file or None if this task met it before) of each text."""
    for i, data in _texts(column):
        media = wav(payload(data))
        key = hashlib.sha256(media).digest()
        yield i, len(data), key, None if key in seen else media
        seen.add(key)
        if len(seen) > 500_000:
            seen.clear()


def manifests(docs: DataFrame) -> DataFrame:
    """(doc_id, medium, n_bytes, digests): the key of each text's medium and its ordered chunk digests (null where this task gave them before)."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                keys, sizes, lists = [], [], []
                for _, size, key, media in _distinct_media(batch.column(1).slice(lo, hi - lo), seen):
                    keys.append(key)
                    sizes.append(size)
                    lists.append(None if media is None else [digest16(c) for c in split(media)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.binary()))], names=["doc_id", "medium", "n_bytes", "digests"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, medium binary, n_bytes long, digests array<binary>")


def bloom(shared: DataFrame, bits: int) -> np.ndarray:
    """A packed bitmap of the digests' hashes, gathered in blocks of fixed size."""
    marked = np.zeros(bits, dtype=bool)
    blocks = shared.select(F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(bits)).alias("b")).groupBy((F.col("b") / F.lit(1 << 12)).cast("long").alias("part")).agg(F.collect_set("b").alias("bits"))
    for r in blocks.toLocalIterator():
        marked[r["bits"]] = True
    return np.packbits(marked)


class ChunkStore(NamedTuple):
    """Media as chunks; all three are tables in the shared folder."""

    #: (doc_id, medium, n_bytes, digests): the medium of each document.
    listed: DataFrame
    #: (medium, own_at, own, named_at, named): chunks of one medium only and the digests of its others, with their places.
    packs: DataFrame
    #: (digest, chunk): every other chunk, once.
    chunks: DataFrame


def chunk_store(docs: DataFrame, bits: int = 1 << 24) -> ChunkStore:
    """Cut the media of docs(doc_id, text) and store each distinct chunk once; see the module's text."""
    spark = docs.sparkSession
    listed = stored(manifests(docs))
    repeated = listed.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    marks = spark.sparkContext.broadcast(bloom(repeated, bits))

    def run(batches):
        known = marks.value
        seen: set[bytes] = set()
        given: set[bytes] = set()
        for batch in batches:
            _, offsets = text_bytes(batch.column(0))
            for lo, hi in chunks(offsets):
                rows: list[tuple] = []
                for _, _, key, media in _distinct_media(batch.column(0).slice(lo, hi - lo), seen):
                    if media is None:
                        continue
                    own_at, own, named_at, named = [], [], [], []
                    for i, chunk in enumerate(split(media)):
                        digest = digest16(chunk)
                        at = int.from_bytes(digest[:7], "big") % bits
                        if not known[at >> 3] >> (7 - (at & 7)) & 1:
                            own_at.append(i)
                            own.append(chunk)
                            continue
                        named_at.append(i)
                        named.append(digest)
                        if digest not in given:
                            given.add(digest)
                            rows.append((None, None, None, None, None, digest, chunk))
                    rows.append((key, own_at, own, named_at, named, None, None))
                if len(given) > 500_000:
                    given.clear()
                if rows:
                    kinds = [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=["medium", "own_at", "own", "named_at", "named", "digest", "chunk"])

    made = stored(docs.select("text").mapInArrow(run, "medium binary, own_at array<int>, own array<binary>, named_at array<int>, named array<binary>, digest binary, chunk binary"))
    once = stored(made.where("digest is not null").groupBy("digest").agg(F.min("chunk").alias("chunk")))
    return ChunkStore(listed, made.where("medium is not null").select("medium", "own_at", "own", "named_at", "named"), once)


def rebuilt_media(store: ChunkStore, schema: str = "media binary", each: Callable[[bytes], tuple] = lambda media: (media,)) -> DataFrame:
    """(medium, *schema): each(file) of every medium, the file rebuilt from its stored chunks and verified.

    Packs that name no other chunk are read in place.  Of the others, named
    digests are joined with the stored chunks and gathered by medium with the
    medium's own; such a group is one file, as the row was that it came from.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = [pa.binary(), *(kinds[f.split()[1]] for f in schema.split(", "))]

    def run(batches):
        for batch in batches:
            out = []
            for key, at, parts in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                ordered = dict(zip(at.as_py(), parts.as_py(), strict=True))
                out.append((key.as_py(), *each(rebuilt(key.as_py(), [ordered[i] for i in range(len(ordered))]))))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(arrow)], names=["medium", *names])

    alone = store.packs.where(F.size("named") == 0).select("medium", F.col("own_at").alias("at"), F.col("own").alias("parts"))
    others = store.packs.where(F.size("named") > 0)
    own = others.select("medium", F.explode(F.arrays_zip(F.col("own_at").alias("i"), F.col("own").alias("chunk"))).alias("p")).select("medium", "p.i", "p.chunk")
    named = others.select("medium", F.explode(F.arrays_zip(F.col("named_at").alias("i"), F.col("named").alias("digest"))).alias("p")).select("medium", "p.i", "p.digest")
    named = named.dropDuplicates(["medium", "i"]).join(store.chunks, "digest").select("medium", "i", "chunk")
    gathered = own.union(named).groupBy("medium").agg(F.collect_list(F.struct("i", "chunk")).alias("p")).select("medium", F.col("p.i").alias("at"), F.col("p.chunk").alias("parts"))
    fields = f"medium binary, {schema}"
    return alone.mapInArrow(run, fields).union(gathered.mapInArrow(run, fields)).dropDuplicates(["medium"])


RESULT = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
RESULT_NAMES = [f.split()[0] for f in RESULT.split(", ")]


def described_media(docs: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_bytes, ...): what the stored media of the texts hold when read back.

    The results are stored before documents ask for them, so that the join
    reads two plain tables and a text that many documents hold can be split.
    """
    store = chunk_store(docs, bits)
    results = stored(rebuilt_media(store, RESULT, described))
    return store.listed.select("doc_id", "medium", "n_bytes").join(results, "medium").select("doc_id", "n_bytes", *RESULT_NAMES)


def rebuilt(key: bytes, parts: list[bytes]) -> bytes:
    """The file of ordered chunks, verified against its key."""
    media = b"".join(parts)
    if hashlib.sha256(media).digest() != key:
        raise ValueError("the chunks do not make up the medium")
    return media
