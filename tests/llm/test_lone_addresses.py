"""Personal data that only the field can find, in documents without a base span."""

from cuesta.llm import pii


def test_lone_spelled_out_address(spark):
    names = [a + b for a in "bcdfghjklmnpqrs" for b in ("al", "ed", "io", "um", "ax", "oz", "ey", "ir", "uk", "on", "es", "it", "ar", "ol")][:200]
    plain = [(i, f"mail {n}@{n[::-1]}.com now") for i, n in enumerate(names)]
    docs = spark.createDataFrame([*plain, (200, "mail ann [at] bob [dot] org now"), (201, "look (at) home"), (202, None)], "doc_id long, text string")
    spans = {r.doc_id: (r.n_email, r.spans) for r in pii.digest(docs).collect()}
    assert spans[200] == (0, "email:5:27")
    assert spans[201] == spans[202] == (0, "")
    assert spans[0] == (1, "email:5:16")
