"""The contract's queries against brute force on the smallest tables, and defined results on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cuesta.llm import bpe, decontaminate, langid, linededup, lm, media, minhash, pii, quality, toxicity
from cuesta.llm import queries as q

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SPACES = re.compile(r"[^ \t-\r]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_bpe(spark, texts):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(public_tokenizers.path(q.VOCABULARY), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in q.op4_bpe_transducer(spark, SF).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_decontamination(spark, texts):
    windows = {}
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = WORDS.findall((item.text or "").translate(LOWER))
        for i in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item.item_id)
    sizes = {len(w) for w in windows}
    for r in q.op5_decontamination(spark, SF).collect():
        w = WORDS.findall(texts[r.doc_id].translate(LOWER))
        hit, items = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    items |= found
                    hit.update(range(i, i + n))
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(items))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_near_duplicates(spark, texts):
    sets = {}
    for d, t in texts.items():
        w = SPACES.findall(t.translate(LOWER))
        sets[d] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    for a in sorted(sets):
        for b, n in Counter(b for x in sets[a] for b in holders[x] if b > a).items():
            if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    for r in q.op6_minhash_near_duplicates(spark, SF).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)


def test_language_model_base(spark, texts):
    end = object()
    tokens = {d: [*SPACES.findall(t.translate(LOWER)), end] for d, t in texts.items()}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    counts = Counter(w for d in texts if not out[d] for w in tokens[d])
    n, v = sum(counts.values()), len(counts)
    rows = q.op7_language_model(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        mine = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(mine), sum(counts[w] > 0 for w in mine), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in mine), rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_personal_data_base(spark, texts):
    for r in q.op8_personal_data(spark, SF).collect():
        assert r.base_sha256 == pii.base_digest(texts[r.doc_id])


def test_media(spark, texts):
    for r in q.op10_media_chunks(spark, SF).collect():
        raw = texts[r.doc_id].encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


@pytest.mark.parametrize(("query", "label", "n", "rest"), [(q.op2_quality_ranking, "quality", 5, 0), (q.op9_toxicity, "toxic", 5, 0)])
def test_held_out_ranking(spark, query, label, n, rest):
    truth = {r.doc_id: r[label] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = query(spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == rest) for r in rows)
    yes = [r.score for r in rows if r.held_out and truth.get(r.doc_id) == 1]
    no = [r.score for r in rows if r.held_out and truth.get(r.doc_id) == 0]
    assert sum((a > b) + (a == b) / 2 for a in yes for b in no) / (len(yes) * len(no)) > 0.8


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in q.op1_language_id(spark, sf).collect() if r.held_out and truth[r.doc_id] is not None]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.9


AWKWARD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\n ", "en", "a"), (4, "same line here now\nsame line here now", "en", None), (4, "same line here now\nsame line here now", "en", None), (None, "x", None, "b"), (5, "word " * 60000, "en", "a")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("rows", [AWKWARD, []], ids=["awkward", "empty"])
@pytest.mark.parametrize("name", ["langid", "linededup", "bpe", "decontaminate", "minhash", "lm", "pii", "media", "quality", "toxicity"])
def test_awkward_rows(spark, rows, name):
    import public_tokenizers

    from cuesta.llm._spark import held_out

    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in (1, 2, 3, 4)] if rows else [], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three"), (2, None), (3, "")] if rows else [], "item_id long, text string")
    run = {
        "langid": lambda: langid.digest(docs, held_out("doc_id", 4, 2)),
        "linededup": lambda: linededup.dedup_lines(docs),
        "bpe": lambda: bpe.digest(docs, public_tokenizers.path(q.VOCABULARY), public_tokenizers.PATTERN),
        "decontaminate": lambda: decontaminate.digest(decontaminate.scan(docs.select("doc_id", "text"), bench, n=13)),
        "minhash": lambda: minhash.near_duplicates(docs, shingle=3, percent=85),
        "lm": lambda: lm.digest(docs.select("doc_id", "text"), held_out("doc_id", 7, 2)),
        "pii": lambda: pii.digest(docs),
        "media": lambda: media.described_media(docs.select("doc_id", "text")),
        "quality": lambda: quality.digest(docs, labels, held_out("doc_id", 5, 0)),
        "toxicity": lambda: toxicity.digest(docs, labels, held_out("doc_id", 5, 0)),
    }[name]
    assert len(run().collect()) == len(rows)


def test_bpe_with_little_memory(spark):
    import public_tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one, two = (sorted(map(tuple, bpe.digest(docs, public_tokenizers.path(q.VOCABULARY), public_tokenizers.PATTERN, *few).collect())) for few in ((), (300, 50, False)))
    assert one == two
