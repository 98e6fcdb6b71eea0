"""Phrase mining against brute force, and defined results on awkward rows."""

import re
from collections import Counter

import numpy as np
import pytest

from cuesta.llm import phrases

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, 5):
                f.update((lang or "und", tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in candidates.items():
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(c[0] == lang and len(c[1]) > len(p) and 100 * b >= 80 * a and any(c[1][i : i + len(p)] == p for i in range(len(c[1]) - len(p) + 1)) for c, b in candidates.items())
        if not inside:
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    rank, got = Counter(), []
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return got


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    words = ["the", "The", "big", "é", "🙂", "old-man", "x|y", "rare1", "a\x0b", "of", "sea"]
    made = [(["en", "de", None, "und"][rng.integers(4)], "".join(words[min(int(rng.geometric(0.3)) - 1, 10)] + [" ", " ", "  ", "\t", ", ", "\n", "? "][rng.integers(7)] for _ in range(rng.integers(0, 60)))) for _ in range(400)]
    return [*made, ("en", None), ("fr", ""), (None, " .,; "), ("en", "x" * 1_000_000), ("es", "new york city hall " * 20_000), *[("de", "same line twice")] * 7]


@pytest.mark.parametrize(("least", "top"), [(5, 2000), (3, 7)])
def test_against_brute_force(spark, rows, monkeypatch, least, top):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 1 << 14)
    monkeypatch.setattr(phrases, "RUN", 500)
    docs = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "doc_id long, lang string, text string, word int").repartition(3)
    got = phrases.collocations(docs, least=least, top=top).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, least, top))


def test_parts_without_a_frequent_key(spark):
    rows = [("en", f"x{i} y{i}, p q") for i in range(40)] + [("en", "a b")] * 3
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=3).collect()
    assert {(r.phrase, r.a) for r in got} == {("a b", 3), ("p q", 40)}


def test_nothing_frequent(spark):
    for few in ([], [("en", "one two three")], [(None, None)]):
        assert phrases.collocations(spark.createDataFrame(few, "lang string, text string")).collect() == []


def test_radix_order_is_stable():
    keys = np.random.default_rng(0).integers(0, 3, (5000, 4)).astype(np.uint16) * np.uint16(20_000)
    order = phrases.radix_order(keys)
    assert order.tolist() == sorted(range(len(keys)), key=lambda i: (keys[i].tolist(), i))


def test_words_that_share_a_hash_are_told_apart():
    class Same:
        hash = np.zeros(4, np.uint64)
        data = np.frombuffer(b"abcabdabcab", np.uint8)
        start, end = np.array([0, 3, 6, 9]), np.array([3, 6, 9, 11])

        def word(self, i):
            return self.data[self.start[i] : self.end[i]].tobytes()

    number, first = phrases._numbered(Same(), np.zeros(4, np.int64))
    assert number.tolist() == [0, 1, 0, 2] and first.tolist() == [0, 1, 3]


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    k = lambda *ids: b"".join(i.to_bytes(4, "big") for i in ids)
    counts = spark.createDataFrame([(k(1), big), (k(2), big - 2), (k(1, 2), big - 3)], "key binary, a long")
    assert [r.score for r in phrases.scored(counts).collect()] == [2_000_000 * (big - 3) // (2 * big - 2)]


def test_a_task_reads_few_blocks_at_once(spark, monkeypatch):
    """The blocks of a task, megabytes each, lie in row groups of a few; a reader holds a group at a time."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(phrases, "BLOCK_BYTES", 1 << 17)
    rng = np.random.default_rng(5)
    rows = [("en", " ".join(map(str, rng.integers(0, 1_000_000, 40_000)))) for _ in range(60)]
    made = phrases.stored(phrases.blocks(spark.createDataFrame(rows, "lang string, text string").coalesce(1)), wide=True)
    groups = [m.row_group(i).num_rows for m in (pq.ParquetFile(p.removeprefix("file:")).metadata for p in made.inputFiles()) for i in range(m.num_row_groups)]
    phrases.dropped(spark, made)
    assert sum(groups) == 60 and max(groups) <= 30
