"""Media stored as chunks: what the tables hold, and files rebuilt from them, against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

from cuesta.llm import media

rng = random.Random(5)


def words(n):
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))


PASSAGE = words(3000)
TEXTS = [None, "", "x", "x", words(20_000), words(500) + PASSAGE + words(500), PASSAGE + words(900), "b" * 100_000, *[words(2500)] * 9, "k" * 64]


def plain_cuts(data):
    """Cuts by the definition, byte by byte."""
    out, start, h = [], 0, 0
    for i, byte in enumerate(data):
        h = ((h << 1) + int(media.GEAR[byte])) & 0xFFFF
        size = i + 1 - start
        mark = h >> (16 - media.BITS) == 0
        if size >= media.LARGEST or mark and size >= media.LEAST:
            out.append(i + 1)
            start = i + 1
    return out if out and out[-1] == len(data) else [*out, len(data)]


def test_cuts_by_definition():
    for t in TEXTS:
        data = media.wav(media.payload((t or "").encode()))
        assert media.cuts(data) == plain_cuts(data)


def store(spark, bits):
    docs = spark.createDataFrame([(i, t, t) for i, t in enumerate(TEXTS)], "doc_id long, text string, medium string").repartition(4)
    return docs, media.chunk_store(docs, bits)


def test_every_chunk_is_stored_once_and_every_file_rebuilt(spark):
    files = {hashlib.sha256(f).digest(): f for f in (media.wav(media.payload((t or "").encode())) for t in TEXTS)}
    distinct = {c for f in files.values() for c in media.split(f)}
    for bits in (1 << 24, 64):  # the second filter is full or nearly so
        _, kept = store(spark, bits)
        packs = kept.packs.collect()
        chunks = kept.chunks.collect()
        own = Counter(bytes(c) for p in packs for c in p.own)
        assert all(bytes(r.digest) == media.digest16(bytes(r.chunk)) for r in chunks)
        assert Counter({bytes(r.chunk): 1 for r in chunks}) + own == Counter(distinct)
        assert {bytes(r.medium): bytes(r.media) for r in media.rebuilt_media(kept).collect()} == files


def test_shared_passages_are_named(spark):
    _, kept = store(spark, 1 << 24)
    mixed = [p for p in kept.packs.collect() if p.own and p.named]
    assert len(mixed) >= 2


def test_results_by_plain_python(spark):
    docs, _ = store(spark, 1 << 24)
    rows = media.described_media(docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(TEXTS)))
    for r in rows:
        raw = (TEXTS[r.doc_id] or "").encode()
        body = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(body) + 44, hashlib.sha256(media.wav(body)).hexdigest())
        mean = sum(body) / len(body)
        above = [b > mean for b in body]
        assert r.feature.startswith(f"mean={mean:.4f};")
        assert f";peak={max(body)};crossings={sum(x != y for x, y in zip(above, above[1:]))};" in r.feature
