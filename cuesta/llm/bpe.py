"""Byte-level BPE as a lazily determinised finite-state transducer.

A token sequence is the BPE encoding of its bytes exactly when every token
encodes to itself and every two neighbours, joined, encode to just these two.
That makes encoding a regular relation: reading bytes, a nondeterministic
transducer walks the trie of tokens and may end a token wherever the trie
does, if the token may follow the one before.  Exactly one of its paths
survives to the end of a text.

``Transducer`` determinises this machine on demand.  A state is the set of
live hypotheses, each (tokens decided but not common to all, last token, trie
node); what all hypotheses share is emitted at once, so output lags input by
the bounded look-ahead that it takes for the others to die.  A transition is
determinised when it is first asked for.  States are kept up to ``max_states``
and then forgotten, in the middle of a piece if need be: the walk goes on from
its own state.  A piece in which no hypothesis lives on, which a vocabulary
with all 256 bytes rules out, is merged by the definition.

Ids go back to text through ``StreamDecoder``: token bytes pass an incremental
UTF-8 state machine, so a decoder may be fed any cut of an id sequence and
never splits a character.
"""

from __future__ import annotations

import base64
import contextlib
import gc
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._text import chunks, text_bytes

END = -1


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from a file of base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE by its definition: join the adjacent pair of least rank, leftmost first, while there is one."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Encodes byte strings one by one; see the module's text."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 400_000, max_pairs: int = 500_000):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.max_states, self.max_pairs = max_states, max_pairs
        self.pairs: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        prefixes = {t[:i] for t in ranks for i in range(len(t) + 1)}
        number = {p: i for i, p in enumerate(sorted(prefixes))}
        self.trie: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        for p, i in number.items():
            if p:
                self.trie[number[p[:-1]] * 256 + p[-1]] = i
            if p in ranks:
                self.token_at[i] = ranks[p]
        self.root = number[b""]
        self.inner = {k // 256 for k in self.trie}  # nodes that go on
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.begin = self._state((((), END, self.root),))

    def _state(self, live: tuple) -> int:
        if live not in self.index:
            self.index[live] = len(self.states)
            self.states.append(live)
        return self.index[live]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; itself twice for a byte; None if BPE never makes it."""
        if token not in self.halves:
            data = self.tokens[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
                if parts[best] + parts[best + 1] not in self.ranks:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            ends = [self.ranks[x] for x in parts]
            self.halves[token] = (token, token) if len(parts) == 1 else tuple(ends) if len(parts) == 2 else None
        return self.halves[token]

    def _apart(self, a: int, b: int) -> bool:
        """Whether no merge across the seam between a and b comes before those that make a and b.

        The seam's two sides are taken apart from the latest merge back: at each
        point a merge across it may only come later than the merge undone last.
        """
        due = 1 << 60
        while True:
            joint = self.ranks.get(self.tokens[a] + self.tokens[b])
            if joint is not None and joint < due:
                return False
            left, right = self._halves(a)[1], self._halves(b)[0]
            if (a > b and left != a) or right == b:
                if left == a:
                    return True
                due, a = a, left
            else:
                due, b = b + 1, right

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may stand after token a (END: at the start)."""
        if a == END:
            return self._halves(b) is not None
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            ok = self.pairs[a, b] = self._halves(b) is not None and self._apart(a, b)
        return ok

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]] | None:
        """Determinise the transition from state by byte; None if no hypothesis goes on."""
        live = []
        trie, token_at, inner = self.trie, self.token_at, self.inner
        for pending, last, node in self.states[state]:
            to = trie.get(node * 256 + byte)
            if to is None:
                continue
            if to in inner:
                live.append((pending, last, to))
            token = token_at.get(to)
            if token is not None and self.follows(last, token):
                live.append(((*pending, token), token, self.root))
        if not live:
            return None
        n, head = 0, live[0][0]
        if len(live) == 1:
            n = len(head)
        elif head:
            rest = [p for p, _, _ in live[1:]]
            while n < len(head) and all(len(p) > n and p[n] == head[n] for p in rest):
                n += 1
        if n:
            live = [(p[n:], a, t) for p, a, t in live]
        arc = self.arcs[state * 256 + byte] = (self._state(tuple(live)), head[:n])
        return arc

    def _walk(self, piece: bytes) -> list[int]:
        out: list[int] = []
        state, arcs = self.begin, self.arcs
        for byte in piece:
            arc = arcs.get(state * 256 + byte)
            if arc is None:
                if len(self.states) > self.max_states:
                    live = self.states[state]
                    self._forget()
                    state, arcs = self._state(live), self.arcs
                arc = self._step(state, byte)
                if arc is None:
                    return merged(piece, self.ranks)
            state = arc[0]
            out += arc[1]
        for pending, _, node in self.states[state]:
            if node == self.root:
                return out + list(pending)
        return merged(piece, self.ranks)

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self._walk(piece) if piece else []


class Encoder:
    """Splits texts by the pattern and encodes each match, with a bounded memory of pieces.

    A match of a GPT-2 style pattern never goes on into white space after
    something else, so a text may be cut wherever white space follows other
    characters, and the parts be matched one by one.  With ``cut_at_space``
    texts are cut at single spaces and parts that have been met before need no
    matching; texts in which white space stands before a space go the plain way.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = 250_000, cut_at_space: bool = True, max_states: int = 400_000):
        self.split = regex.compile(pattern).findall
        self.machine = Transducer(ranks, max_states)
        self.max_pieces, self.cut = max_pieces, cut_at_space
        self.known: dict[str, tuple[int, ...]] = {}  # ids of " " + part
        self.older: dict[str, tuple[int, ...]] = {}  # the generation before
        self.double = re.compile(r"\s ").search

    def _learn(self, parts: set[str]) -> None:
        """Bring the ids of " " + part into memory."""
        known, older = self.known, self.older
        before = parts.intersection(older)
        known.update(zip(before, map(older.__getitem__, before), strict=True))
        split: dict[str, list[str]] = {}
        need: dict[str, tuple[int, ...]] = {}
        for part in parts - before:
            split[part] = pieces = self.split(" " + part)
            if len(pieces) == 1:  # not in memory, or part were
                need[pieces[0]] = ()
                continue
            for p in pieces:
                if p not in need:
                    need[p] = (known.get(p[1:]) or older.get(p[1:]) or ()) if p[0] == " " else ()
        self._encode_pieces(need)
        for part, pieces in split.items():
            known[part] = need[pieces[0]] if len(pieces) == 1 else tuple(chain.from_iterable(map(need.__getitem__, pieces)))

    def _encode_pieces(self, need: dict[str, tuple[int, ...]]) -> None:
        encode = self.machine.encode
        for p in [p for p, ids in need.items() if not ids]:
            need[p] = tuple(encode(p.encode()))

    def _plain(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(t) for t in texts]
        need: dict[str, tuple[int, ...]] = dict.fromkeys(chain.from_iterable(split), ())
        self._encode_pieces(need)
        return [list(chain.from_iterable(map(need.__getitem__, pieces))) for pieces in split]

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text, in order."""
        cut = [self.cut and not self.double(t) for t in texts]
        parts = [t.split(" ") if c else [] for t, c in zip(texts, cut, strict=True)]
        if len(self.known) > self.max_pieces:
            self.older, self.known = self.known, {}
        self._learn(set(chain.from_iterable(p[1:] for p in parts)).difference(self.known))
        heads = iter(self._plain([p[0] if c else t for t, p, c in zip(texts, parts, cut, strict=True)]))
        known = self.known
        for head, p in zip(heads, parts, strict=True):
            head.extend(chain.from_iterable([known[x] for x in p[1:]]))
            yield head

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))


# States of the incremental UTF-8 machine: 0 between characters; 1 to 3 that many plain
# continuation bytes are due; 4 to 7 the next byte is limited (after E0, ED, F0, F4); 8 bad.
_UTF8_FIRST = [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)]
_UTF8_NEXT = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}
BAD = 8


def utf8_table() -> list[list[int]]:
    table = [[BAD] * 256 for _ in range(9)]
    for a, b, to in _UTF8_FIRST:
        table[0][a : b + 1] = [to] * (b + 1 - a)
    for state, (a, b, to) in _UTF8_NEXT.items():
        table[state][a : b + 1] = [to] * (b + 1 - a)
    return table


class StreamDecoder:
    """Decodes ids piecewise: feed() returns the whole characters' bytes so far, finish() the rest."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.table = utf8_table()
        self.plain = np.array([t != b"" and self._run(0, t) == 0 for t in tokens])
        self.state, self.held = 0, b""

    def _run(self, state: int, data: bytes) -> int:
        for byte in data:
            state = self.table[state][byte]
        return state

    def feed(self, ids: list[int] | np.ndarray) -> bytes:
        parts = [self.held, *map(self.tokens.__getitem__, ids)]
        data = b"".join(parts)
        # A token of whole characters leaves the machine between characters, whatever came before:
        # only what follows the last such token can end inside one.
        whole = np.flatnonzero(self.plain[ids])
        done = at = len(data) - sum(map(len, parts[whole[-1] + 2 :])) if len(whole) else 0
        state = 0
        while at < len(data):
            state = self.table[state][data[at]]
            at += 1
            if state == BAD:  # passed on as it is; the machine starts anew
                state = 0
            if state == 0:
                done = at
        self.held, self.state = data[done:], state
        return data[:done]

    def finish(self) -> bytes:
        rest, self.held, self.state = self.held, b"", 0
        return rest


def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        out[r] = t
    return out


_MACHINES: dict[tuple, tuple[Encoder, StreamDecoder]] = {}


def _machines(ranks: dict[bytes, int], pattern: str, key: str, max_states: int, max_pieces: int) -> tuple[Encoder, StreamDecoder]:
    """One pair of machines per Python worker: it serves all tasks that the worker runs."""
    if (key, pattern, max_states, max_pieces) not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key, pattern, max_states, max_pieces] = (Encoder(ranks, pattern, max_pieces, max_states=max_states), StreamDecoder(token_table(ranks)))
    return _MACHINES[key, pattern, max_states, max_pieces]


class Text:
    """Decimal forms of ids, made once."""

    def __init__(self, n: int):
        self.of = list(map(str, range(n)))

    def joined(self, ids: Iterable[int]) -> bytes:
        return " ".join(map(self.of.__getitem__, ids)).encode()


@contextlib.contextmanager
def _uncollected() -> Iterator[None]:
    """No cyclic garbage collection inside: the memories hold millions of tuples, in no cycles, that it would walk again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _vocabulary(path: str) -> tuple[bytes, str]:
    with open(path, "rb") as f:
        raw = f.read()
    return raw, hashlib.sha256(raw).hexdigest()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def _passes(docs: DataFrame, path: str, pattern: str, schema: str, per_ids, max_states: int = 400_000, max_pieces: int = 250_000, keep: bool = True) -> DataFrame:
    """Every row's columns and what per_ids(decoder, ids) adds.  The vocabulary file is broadcast (under 2 MB)."""
    raw, key = _vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    names = docs.columns
    at = names.index("text")
    added = [x.split()[0] for x in schema.split(",")]
    fields = ", ".join(f"`c{i}` {t}" for i, (_, t) in enumerate(docs.dtypes))

    def run(batches: Iterator[pa.RecordBatch]):
        ranks = parse_ranks(shared.value)
        encoder, decoder = _machines(ranks, pattern, key, max_states, max_pieces) if keep else (Encoder(ranks, pattern, max_pieces, max_states=max_states), StreamDecoder(token_table(ranks)))
        for batch in batches:
            _, offsets = text_bytes(batch.column(at))
            for lo, hi in chunks(offsets, 2 << 20):
                part = batch.slice(lo, hi - lo)
                with _uncollected():
                    rows = [per_ids(decoder, ids) for ids in encoder.encode_all([t or "" for t in part.column(at).to_pylist()])]
                columns = [pa.array([r[i] for r in rows], None if rows and not isinstance(rows[0][i], list) else pa.list_(pa.int32())) for i in range(len(added))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*(f"c{i}" for i in range(len(names))), *added])

    return docs.mapInArrow(run, f"{fields}, {schema}").toDF(*names, *added)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with token_ids array<int>: the ids of each whole text; null and empty texts have none.

    A column of docs named token_ids is replaced.
    """
    return _passes(docs.drop("token_ids"), path, pattern, "token_ids array<int>", lambda d, ids: (ids,))


def decode(docs: DataFrame, path: str) -> DataFrame:
    """docs(token_ids, ...) with decoded string: the text of each id list (bad UTF-8 is replaced)."""
    raw, _ = _vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    docs = docs.drop("decoded")
    names = docs.columns
    fields = ", ".join(f"`c{i}` {t}" for i, (_, t) in enumerate(docs.dtypes))

    def run(batches):
        decoder = StreamDecoder(token_table(parse_ranks(shared.value)))
        for batch in batches:
            out = [(decoder.feed(np.array(ids or [], dtype=np.int64)) + decoder.finish()).decode("utf-8", "replace") for ids in batch.column(names.index("token_ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*(f"c{i}" for i in range(len(names))), "decoded"])

    return docs.mapInArrow(run, f"{fields}, decoded string").toDF(*names, "decoded")


def digest(docs: DataFrame, path: str, pattern: str, max_states: int = 400_000, max_pieces: int = 250_000, keep: bool = True) -> DataFrame:
    """The contract's columns for docs(doc_id, text): every text is encoded, its ids decoded, both hashed.

    ``max_states`` and ``max_pieces`` bound what a worker remembers of the transducer and of the words it has met:
    fewer take less memory and more time, and change no result.  Without ``keep`` a task lets go of them as it ends.
    """
    text = Text(1 + max(read_ranks(path).values()))

    def per_ids(decoder: StreamDecoder, ids: list[int]):
        back = hashlib.sha256()
        for lo in range(0, len(ids), 1 << 16):
            back.update(decoder.feed(ids[lo : lo + (1 << 16)]))
        back.update(decoder.finish())
        return len(ids), hashlib.sha256(text.joined(ids)).hexdigest(), back.hexdigest()

    return _passes(docs.select("doc_id", "text"), path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", per_ids, max_states, max_pieces, keep).drop("text")
