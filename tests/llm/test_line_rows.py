"""Line dedup on rows that share a doc_id or have none."""

import pytest

from cuesta.llm import linededup

ONE, TWO, THREE = ("one two three four five", "six seven eight nine ten", "aa bb cc dd ee")


@pytest.mark.parametrize("doc_id", [7, None], ids=["shared", "null"])
def test_rows_of_one_id_lose_only_their_own_lines(spark, doc_id):
    docs = spark.createDataFrame([(1, ONE), (doc_id, f"{ONE}\n{TWO}"), (doc_id, f"{THREE}\n{THREE} x\nff gg hh ii jj")], "doc_id long, text string")
    got = sorted(r.text for r in linededup.dedup_lines(docs).collect())
    assert got == sorted([ONE, TWO, f"{THREE}\nff gg hh ii jj"])
    assert sorted((r.n_lines, r.removed) for r in linededup.digest(docs).collect()) == [(1, ""), (2, "0"), (3, "1")]


@pytest.mark.parametrize("doc_id", [7, None], ids=["shared", "null"])
def test_copies_of_one_id_remove_each_other(spark, doc_id):
    docs = spark.createDataFrame([(doc_id, f"{ONE}\n{TWO}")] * 3, "doc_id long, text string").repartition(3)
    assert sorted(r.removed for r in linededup.digest(docs).collect()) == ["", "0,1", "0,1"]
