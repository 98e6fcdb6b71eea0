"""The aligner against brute force over whole tables, and defined results on awkward rows."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest

from cuesta.llm import alignment
from cuesta.llm import queries as q

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts, libraries):
    """One row for each text: the contract's columns, by loops over tokens."""
    a, b = libraries
    letters = {c: i for i, c in enumerate(alignment._byte_characters())}
    docs, counts = [], Counter()
    for text in texts:
        none = ([], [], [])
        if not text:
            docs.append(none)
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        one = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        two = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, map(b.id_to_piece, ids_b))]
        whole = (" " + text).encode()
        if b"".join(one) != whole or b"".join(two) != whole:
            docs.append(none)
            continue
        links, groups, ga, gb, i, j, ea, eb = [], [], [], [], 0, 0, len(one[0]), len(two[0])
        while True:
            links.append((ids_a[i], ids_b[j]))
            if ea == eb:
                groups.append(([*ga, ids_a[i]], [*gb, ids_b[j]]))
                ga, gb, i, j = [], [], i + 1, j + 1
                if i == len(ids_a):
                    break
                ea, eb = ea + len(one[i]), eb + len(two[j])
            elif ea < eb:
                ga, i = [*ga, ids_a[i]], i + 1
                ea += len(one[i])
            else:
                gb, j = [*gb, ids_b[j]], j + 1
                eb += len(two[j])
        docs.append((links, groups, (len(ids_a), len(ids_b))))
        counts.update(set(links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for links, groups, n in docs:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((*(n or (0, 0)), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, counts


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_every_document_of_the_smallest_table(spark, libraries):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(texts, brute(texts.values(), libraries)[0], strict=True))
    rows = q.op11_token_alignment(spark, sf).collect()
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in rows} == want and len(rows) == len(texts)


ODD = [None, "", " ", "  a", "a", "a", "naïve café — ≠ ✓ 🙂 ́", "<|endoftext|> <unk> <s> </s> <0x41>", "▁ under▁line", "tab\tnew\nline\r\n", "\x00\x01 zero", "word " * 3000, "x" * 200_000, "ﬁ ligature ① ２"]


def test_odd_texts_repeats_and_small_blocks(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "PART_BYTES", 1)  # many salts
    rows = [(None if i == 3 else i // 2, t, i) for i, t in enumerate(ODD)]
    out, counts = alignment.align(spark.createDataFrame(rows, "doc_id long, text string, n_links int").repartition(3), A, B, P.path(q.VOCABULARY), P.PATTERN)
    want, pairs = brute(ODD, libraries)
    assert Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in out.collect()) == Counter((r[0], *w) for r, w in zip(rows, want, strict=True))
    assert {(r.a, r.b): r.documents for r in alignment.pair_counts(counts, 32_000).collect()} == dict(pairs)


def test_an_empty_table(spark):
    out = alignment.digest(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert out.columns == ["doc_id", *COLUMNS] and out.collect() == []


def test_both_libraries_of_side_a_agree(spark):
    texts = ["it's  12,345 naïve   words\n\n  x", "ǅ ͅ ⅷ 🙂‍↔️ ​", ""]
    slow, fast = alignment._side_a(A, None, None)[0], alignment._side_a(A, P.path(q.VOCABULARY), P.PATTERN)[0]
    assert slow(texts) == fast(texts)
