"""Personal data against the contract's patterns themselves, and the transducer's states against the definition of BPE."""

import hashlib
import re

import public_tokenizers

from cuesta.llm import bpe
from cuesta.llm import queries as q

SF = "/root/testdata/sf0.001"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def valid(number: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(number))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def expected(text: str) -> list[tuple[str, int, int]]:
    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and valid(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def test_base_spans_follow_the_patterns(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text or "" for r in rows}
    found = q.op8_personal_data(spark, SF).collect()
    assert len(found) == len(rows)
    for r in found:
        spans = expected(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]


def test_states_are_forgotten_within_a_piece():
    ranks = bpe.read_ranks(public_tokenizers.path(q.VOCABULARY))
    small, large = bpe.Transducer(ranks, max_states=20, max_pairs=50), bpe.Transducer(ranks)
    for piece in (b"", b"a" * 3000, b"ab" * 1500, "zwölf漢字".encode() * 100, b" unaccountably" * 40, bytes(range(256))):
        assert small.encode(piece) == large.encode(piece) == bpe.merged(piece, ranks)
    assert len(small.states) < 40
