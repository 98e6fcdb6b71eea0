"""Line dedup in DataFrame functions: its plans, and pairs that only sparse bins, short words or late lines hold."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cuesta.llm import linededup


def brute_force(docs, percent):
    sets, gone = [], {}
    for d, text in docs:
        gone[d] = []
        for i, line in enumerate(text.split("\n")):
            w = {x for x in re.split(r"[ \t-\r]+", line.lower()) if x}
            if w and any(100 * len(w & s) >= percent * len(w | s) for s in sets):
                gone[d].append(i)
            if w:
                sets.append(w)
    return gone


def test_no_python_runs_on_the_executors(spark, monkeypatch):
    plans, store = [], linededup.stored

    def seen(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, *args, **kwargs)

    monkeypatch.setattr(linededup, "stored", seen)
    docs = spark.createDataFrame([(1, "a b c d e\nf g"), (2, "a b c d e f")], "doc_id long, text string")
    path = store(docs)
    out = linededup.digest(path)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {r.doc_id: r.removed for r in out.collect()} == {1: "", 2: "0"}
    assert not [p for p in plans if re.search(r"MapInArrow|InPandas|InArrow|ArrowEval|BatchEval", p)]


@pytest.mark.parametrize("percent", [50, 80, 95])
@pytest.mark.parametrize("short", [0.0, 0.5, 1.0])
def test_changed_lines_against_brute_force(spark, percent, short):
    """Lines of 1 to 60 words, some of them earlier ones with words changed; words of one to three letters, longer ones, or both."""
    rng = random.Random(f"{percent} {short}")
    few = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 3))) for _ in range(120)]
    long_ = ["".join(rng.choices("abcdefgh", k=rng.randint(4, 20))) for _ in range(300)]
    lines: list[list[str]] = []
    while len(lines) < 900:
        if lines and rng.random() < 0.6:
            line = list(rng.choice(lines))
            for _ in range(rng.randint(0, 1 + len(line) * (110 - percent) // 150)):
                at, what = rng.randrange(len(line)), rng.random()
                if what < 0.4 and len(line) > 1:
                    del line[at]
                else:
                    line[at:at + (what < 0.7)] = [rng.choice(few if rng.random() < short else long_)]
        else:
            line = [rng.choice(few if rng.random() < short else long_) for _ in range(rng.randint(1, rng.choice([6, 20, 60])))]
        lines.append(line)
    docs = [(d, "\n".join(" ".join(w) for w in lines[d * 9 : d * 9 + 9])) for d in range(100)]
    got = {r.doc_id: r.removed for r in linededup.digest(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), percent).collect()}
    assert got == {d: ",".join(map(str, g)) for d, g in brute_force(docs, percent).items()}


def test_a_set_of_any_white_space_and_case(spark):
    row = spark.createDataFrame([("A\tb\vB\fc\ra  ", "c b a", "a b c")], "x string, y string, z string").select(*(linededup._set(c).alias(c) for c in "xyz"))
    r = row.select("x", "y", F.size("z").alias("n")).first()
    assert r.x == r.y and len(r.x) == 3 and r.n == 2
