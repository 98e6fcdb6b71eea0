"""Quality rules against the contract's counts, held-out labels, and awkward rows."""

import re
import zlib

import numpy as np
import pytest

from cuesta.llm import queries as q
from cuesta.llm import rules

WORD = re.compile(r"[^ \t-\r]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside), failed


COLUMNS = [*rules.COUNTS, "base_failed"]


def test_counts_of_every_document(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = q.op13_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == brute(texts[r.doc_id])
        assert r.kept == (not r.base_failed and r.probability >= rules.LEAST_PROBABILITY)


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in q.op13_quality_rules(spark, sf).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in truth]
    good, bad = [r for r in held if truth[r.doc_id] == 1], [r for r in held if truth[r.doc_id] == 0]
    assert sum((a.probability > b.probability) + (a.probability == b.probability) / 2 for a in good for b in bad) > 0.95 * len(good) * len(bad)
    assert sum(r.kept for r in good) >= 0.98 * len(good)


A8 = "a1 a2 a3 a4 a5 a6 a7 a8"
ROWS = [
    (1, None, "u", 1),
    (2, "", "u", 2),
    (3, " \n\n \t", "u", 3),
    (4, f"{A8} x {A8}", "u", 4),
    (4, f"{A8} x {A8}", "u", 4),
    (None, f"{A8}  {A8.upper()} " + " ".join(f"w{i}" for i in range(9)), "u", 5),
    (6, "line one\nline one\n\n\nline one \nline two", "u", 6),
    (7, "x" * 1_000_000, "u", 7),
    (8, "word " * 50_000, "u", 8),
    (9, "é€🙂 #*$ %&|<> " * 7, "u", 9),
]


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(4, 1), (6, 0), (8, 0), (9, 1), (9, None)]], ids=["none", "one class", "few"])
def test_awkward_rows(spark, labels):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, kept string, c0 int")
    from pyspark.sql import functions as F

    model = rules.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(False))
    out = rules.judged(docs, model)
    assert out.columns == ["doc_id", "text", "c0", *rules.COUNTS, "base_failed", "kept", "probability"]
    rows = out.orderBy("c0").collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == brute(r.text)
        assert 0 <= r.probability <= 1 and not (r.base_failed and r.kept)
    if not labels:
        assert all(r.kept == (not r.base_failed) for r in rows)


def test_an_empty_table(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([], "doc_id long, text string")
    assert rules.digest(docs, spark.createDataFrame([], "doc_id long, quality int"), F.lit(False)).collect() == []


def test_the_sigmoid_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    slope, level = rules.calibrated(x, y)
    assert abs(slope - 2) < 0.1 and abs(level + 1) < 0.1
