"""The field against mentions that the patterns do not know, planted beside ones that they do, and against look-alikes."""

import numpy as np
import pytest

from cuesta.llm import pii


def luhn_number(rng, ok):
    d = [int(x) for x in rng.integers(0, 10, 15)]
    total = sum(x if i % 2 else x * 2 - 9 * (x > 4) for i, x in enumerate(d))
    last = -total % 10
    return "".join(map(str, [*d, last if ok else (last + 1 + int(rng.integers(9))) % 10]))


@pytest.fixture(scope="module")
def planted():
    """Texts with the spans that are personal (kind, start, end), those of the patterns apart."""
    rng = np.random.default_rng(12)
    filler = "the quick brown fox jumps over a lazy dog and runs away from 3 hounds in 1998".split()
    texts, hidden = [], []
    for k in range(400):
        parts, want = [], []

        def add(s, kind=None):
            parts.append(" ".join(rng.choice(filler, 6)) + " then")  # a number just before would be one candidate with it
            at = len(" ".join(parts)) + 1
            parts.append(f"{s} or")
            if kind:
                want.append((kind, at, at + len(s)))

        area, number = rng.integers(100, 999), "".join(map(str, rng.integers(0, 10, 7)))
        user, host = f"user{k}.name", f"host{k % 17}.example"
        which = k % 5
        if which in (0, 3):
            add(f"+49 {area} {number[:3]} {number[3:]}")
            add(f"0{area} {number[:3]}-{number[3:]}", "phone")  # the national form
        if which in (1, 3):
            add(f"{user}@{host}")
            add(f"{user} [at] {host.replace('.', ' [dot] ')}", "email")
        if which == 2:
            card = luhn_number(rng, True)
            add(" ".join(card[i : i + 4] for i in range(0, 16, 4)))
            add(".".join(card[i : i + 4] for i in range(0, 16, 4)), "card")
        if which == 4:
            wrong = luhn_number(rng, False)
            add(wrong)
            add(wrong)  # a repeated number that is no card
            add(f"order {rng.integers(10**9, 10**10)}")
            add(f"{rng.integers(1000, 9999)}-{rng.integers(1000, 9999)}")
        add(f"{rng.integers(10**7, 10**8)}")
        texts.append(" ".join(parts))
        hidden.append(want)
    return texts, hidden


def test_recall_and_precision_of_hidden_mentions(spark, planted):
    texts, hidden = planted
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.find(docs, pii.learn(docs)).collect()}
    right = wanted = added = 0
    for i, want in enumerate(hidden):
        more = {(s.kind, s.start, s.end) for s in out[i].spans} - {(s.kind, s.start, s.end) for s in out[i].base}
        assert {(s.kind, s.start, s.end) for s in out[i].base} == set(pii.base_spans(texts[i]))
        wanted, added, right = wanted + len(want), added + len(more), right + len(more & set(want))
    assert right >= 0.8 * wanted and right >= 0.95 * added
    for i, text in enumerate(texts):
        if i % 5 == 4:
            assert not [s for s in out[i].spans if s.kind == "card"]


def test_what_a_kind_cannot_be():
    assert pii.possible("4111 1111 1111 1112", "4111111111111112", None) == (True, False, False, False, False)
    assert pii.possible("4111.1111.1111.1111", "4111111111111111", None)[3]
    assert pii.possible("10 . 0 . 0 . 255", "1000255", None)[2] and not pii.possible("10.0.0.256", "1000256", None)[2]
    assert pii.possible("a (at) b", "", "a@b") == (True, False, False, False, False)
    assert pii.possible("a (at) b.c", "", "a@b.c")[1]
