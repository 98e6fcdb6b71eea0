"""Columns of documents named like the operators' own, large ways, and ties."""

import numpy as np
import pytest

from cuesta.llm import decontaminate, linededup, minhash, toxicity

WINDOW = " ".join(f"w{i}" for i in range(13))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([("i1", WINDOW), ("i2", "short item")], "item_id string, text string")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, f"{WINDOW} tail", "u1", 5, "r1", "k1"), (2, " ".join(f"clean{i}" for i in range(300)), "u2", 6, "r2", "k2"), (3, None, "u3", 7, "r3", "k3")]
    return spark.createDataFrame(rows, "doc_id long, text string, items string, _hit int, _row string, _id string")


@pytest.mark.parametrize("limit", [1 << 20, 0], ids=["broadcast", "large"])
def test_decontamination_keeps_the_columns_of_docs(docs, bench, limit):
    kept = decontaminate.clean(docs, bench, broadcast_bytes=limit)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r["items"], r._hit, r._row) for r in kept.collect()) == [(2, "u2", 6, "r2"), (3, "u3", 7, "r3")]
    cut = {r.doc_id: r for r in decontaminate.clean(docs, bench, spans=True, broadcast_bytes=limit).collect()}
    assert cut[1].text == " tail" and cut[1]["items"] == "u1" and cut[3].text is None


def test_both_ways_of_decontamination_agree(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    one, two = (sorted(map(tuple, decontaminate.digest(decontaminate.scan(docs, bench, broadcast_bytes=b)).collect())) for b in (1 << 30, 0))
    assert one == two


def test_near_duplicates_keep_the_columns_of_docs(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, "a b c d e f", "z"), (4, "", "e")]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _id string"))
    assert kept.columns == ["doc_id", "text", "_id"]
    assert sorted((r.doc_id or 0, r._id) for r in kept.collect()) == [(0, "z"), (1, "x"), (4, "e")]


def test_lines_keep_the_columns_of_docs(spark):
    rows = [(1, "one two three\nfour five six", 9), (2, "Three two ONE\nseven eight nine", 8)]
    out = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, rid int")).collect()}
    assert out[2].text == "seven eight nine" and out[2].rid == 8 and out[1].text == rows[0][1]


def test_equal_margins_are_one_point_of_the_calibration():
    at, to = toxicity.isotonic(np.array([1.0, 1, 1, 1]), np.array([0.0, 0, 0, 1]))
    assert at.tolist() == [1.0] and to.tolist() == [0.25]
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 9, 200).astype(float), rng.integers(0, 2, 200).astype(float)
    order = rng.permutation(200)
    assert all(np.allclose(a, b) for a, b in zip(toxicity.isotonic(x, y), toxicity.isotonic(x[order], y[order]), strict=True))
    assert (np.diff(toxicity.isotonic(x, y)[1]) >= 0).all()
