"""Line dedup against brute force on every line with a word, however short."""

import re
from collections import Counter, defaultdict

import pytest

from cuesta.llm import linededup
from cuesta.llm import queries as q

SF = "/root/testdata/sf0.001"


def brute_force(docs):
    sets, holders, gone = [], defaultdict(list), defaultdict(list)
    for d, text in docs:
        for i, line in enumerate(text.split("\n")):
            w = frozenset(x for x in re.split(r"[ \t-\r]+", line.lower()) if x)
            common = Counter(k for x in w for k in holders[x])
            if any(100 * o >= 80 * (len(w) + len(sets[k]) - o) for k, o in common.items()):
                gone[d].append(i)
            for x in w:
                holders[x].append(len(sets))
            if w:
                sets.append(w)
    return gone


def test_every_line_with_a_word(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if r.text is not None)
    gone = brute_force(docs)
    for r in q.op3_line_dedup(spark, SF).collect():
        assert r.removed == ",".join(map(str, gone[r.doc_id]))


@pytest.mark.parametrize(("earlier", "later", "removed"), [("Contents", "contents", True), ("all rights reserved", "All rights reserved", True), ("a b c d", "a b c d e", True), ("a b c d e", "d c b a", True), ("a b c", "a b c d", False), ("a " * 90, "A " * 70, True), ("", "", False), (" ", "\t", False)])
def test_short_lines(spark, earlier, later, removed):
    docs = spark.createDataFrame([(1, earlier), (2, later)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in linededup.digest(docs).collect()} == {1: 0, 2: int(removed)}
