"""Phrase collocations by language: phrases of 2 to 4 words that hold together.

The plan, its larger tables stored before they are read again:

1. Texts are cut into blocks in Arrow batches: a block has its distinct words
   with their counts, and its pieces as runs of local word numbers.
2. Word counts of all blocks, added up, give the dictionary: the (language,
   word) pairs with ``least`` occurrences, numbered by range partitions and
   their offsets.  Local numbers are joined with it, by word and then by block,
   and pieces break at every word that is not in it.
3. Runs of n ids become keys of 4n bytes, shuffled as longs of two ids each.  A
   task sorts its keys by radix, counts runs of equal ones, and Spark deals the
   counted keys out by ranges and sorts them (a single long by radix), so equal
   keys stand together and are added up.  Keys with
   ``least`` occurrences stay.  Only runs whose shorter runs may all be frequent
   are packed; a bitmap of the frequent shorter keys, at most ``MOST_BITS`` bits,
   tells them apart.  It only saves work: a run it lets pass in error is counted
   and found too rare.
4. Cuts, scores, containment and ranks are joins and windows over the
   frequent phrases alone.

Words are compared by their bytes, so counts are exact; scores are computed in
decimals of 38 digits.

A null text has no words, a null language is ``und``.  Repeated rows count as
often as they occur.  An empty table, or one without frequent phrases, gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import dropped, stored
from ._text import Words, chunks, mix64, text_bytes

BLOCK_BYTES = 4 << 20
#: Keys that a task sorts and counts at a time.
RUN = 2_000_000
MOST_BITS = 1 << 29

_CUTS = np.zeros(256, dtype=bool)
_CUTS[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_CUTS
_WORD[[0x20, 0x09]] = False


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start[i]:start[i] + size[i]] of all i, joined."""
    ends = np.cumsum(size)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]


def _numbered(words: Words, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word occurrence, equal where (language, bytes) are, and the first occurrence of each number."""
    key = mix64(words.hash + lang.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    size, at = words.end - words.start, first[number]
    same = (size == size[at]) & (lang == lang[at])
    if same.all():
        step = max(1, len(size) // 8)
        same = all(np.array_equal(gathered(words.data, words.start[i : i + step], size[i : i + step]), gathered(words.data, words.start[at[i : i + step]], size[i : i + step])) for i in range(0, len(size), step))
    if not np.all(same):  # two words share a hash: number them by their bytes
        seen: dict[tuple[int, bytes], int] = {}
        firsts, number = [], np.empty(len(size), np.int64)
        for i in range(len(size)):
            k = (int(lang[i]), words.word(i))
            if k not in seen:
                seen[k] = len(firsts)
                firsts.append(i)
            number[i] = seen[k]
        first = np.array(firsts, dtype=np.int64)
    return number, first


BLOCKS = "block long, run binary, words array<struct<lang:string,word:string,n:long>>, totals array<struct<lang:string,n:long>>"


def _lists(parts: dict[str, pa.Array]) -> pa.Array:
    """One list of structs."""
    inner = pa.StructArray.from_arrays(list(parts.values()), list(parts))
    return pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner)


def blocks(docs: DataFrame) -> DataFrame:
    """docs(lang, text) to BLOCKS: run holds local word numbers from 1 as int32, 0 between pieces."""

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            raw, offsets = text_bytes(batch.column(1))
            codes = names.indices.to_numpy().astype(np.int64)
            for lo, hi in chunks(offsets, BLOCK_BYTES):
                words = Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], _WORD)
                if not len(words.start):
                    continue
                lang = codes[lo:hi][words.row]
                number, first = _numbered(words, lang)
                n = np.bincount(number)
                cuts = np.cumsum(_CUTS[words.data])[words.start]
                fresh = np.flatnonzero((np.diff(cuts) != 0) | (np.diff(words.row) != 0)) + 1
                ids = np.insert(number + 1, fresh, 0).astype(np.int32)
                size = words.end[first] - words.start[first]
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                text = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(gathered(words.data, words.start[first], size)))
                by = np.bincount(lang, minlength=len(names.dictionary))
                full = np.flatnonzero(by)
                own = _lists({"lang": names.dictionary.take(pa.array(lang[first])), "word": text, "n": pa.array(n)})
                totals = _lists({"lang": names.dictionary.take(pa.array(full)), "n": pa.array(by[full])})
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([ids.tobytes()], pa.binary()), own, totals], names=["block", "run", "words", "totals"])
                block += 1

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, BLOCKS)


def numbered(frame: DataFrame, *order: str) -> DataFrame:
    """frame with id from 1, in the order of the columns: range partitions, and the number of rows before each."""
    dealt = stored(frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = {r[0]: r[1] for r in dealt.groupBy(part.alias("part")).count().collect()}  # a row for each partition
    before, first = 0, []
    for p in sorted(sizes):
        first.append((p, before))
        before += sizes[p]
    if before >= 1 << 32:
        raise OverflowError("ids of four bytes do not suffice")
    starts = frame.sparkSession.createDataFrame(first or [(0, 0)], "part long, before long")
    return dealt.join(F.broadcast(starts), part == F.col("part")).withColumn("id", F.col("_at") - F.shiftleft(part, 33) + F.col("before") + 1).drop("_at", "part", "before")


def coded(made: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(run): runs of dictionary ids as uint32, 0 at pieces' ends and in place of other words.

    A block meets its known words as a group of sorted rows: a task holds one block's, however many blocks it has.
    """
    words = made.select(F.col("block").alias("of"), F.posexplode("words").alias("place", "w")).select("of", "place", "w.lang", "w.word")
    known = words.join(dictionary.select("lang", "word", "id"), ["lang", "word"]).select("of", "place", "id")

    def run(block: pa.Table, pairs: pa.Table) -> pa.Table:
        out = []
        for row in block["run"]:
            local = np.frombuffer(row.as_buffer(), np.int32)
            code = np.zeros(int(local.max(initial=0)) + 1, np.uint32)
            code[pairs["place"].to_numpy() + 1] = pairs["id"].to_numpy()
            ids = code[local]
            on = ids != 0
            beside = np.zeros(len(on), bool)  # a word alone between breaks makes no phrase
            beside[1:] |= on[:-1]
            beside[:-1] |= on[1:]
            ids[~beside] = 0
            stay = ids != 0
            stay[1:] |= ids[:-1] != 0
            out.append(ids[stay].tobytes())
        return pa.table({"run": pa.array(out, pa.binary())})

    return made.select("block", "run").groupBy("block").cogroup(known.groupBy("of")).applyInArrow(run, "run binary")


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Order of rows of big-endian 16-bit digits: one stable counting pass a digit, the last digit first."""
    order = np.arange(len(keys))
    for d in range(keys.shape[1] - 1, -1, -1):
        digit = keys[:, d]
        if len(digit) and digit.min() != digit.max():
            order = order[np.argsort(digit[order], kind="stable")]  # radix sort for 16-bit integers
    return order


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ids (uint32), sorted, and how often each occurs."""
    digits = np.empty((len(ids), 2 * ids.shape[1]), np.uint16)
    digits[:, 0::2], digits[:, 1::2] = ids >> np.uint32(16), ids & np.uint32(0xFFFF)
    ids = ids[radix_order(digits)]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return ids[at], np.diff(np.append(at, len(ids)))


def _fixed(keys: np.ndarray) -> pa.Array:
    """Rows of uint32 as big-endian binary keys."""
    width = 4 * keys.shape[1]
    ends = (np.arange(len(keys) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends), pa.py_buffer(keys.astype(">u4").tobytes())])


def _longs(keys: np.ndarray) -> list[np.ndarray]:
    """Rows of uint32 as columns of eight bytes, two ids each: Spark sorts a single one of them by radix."""
    wide = np.zeros((len(keys), keys.shape[1] + keys.shape[1] % 2), np.uint64)
    wide[:, : keys.shape[1]] = keys
    return [(wide[:, i] << np.uint64(32) | wide[:, i + 1]).view(np.int64) for i in range(0, wide.shape[1], 2)]


def _ids(longs: np.ndarray, n: int) -> np.ndarray:
    """The n ids of each row of ``_longs``."""
    both = longs.view(np.uint64)
    return np.stack([both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)], axis=2).reshape(len(longs), 2 * longs.shape[1])[:, :n].astype(np.uint32)


def _marks(ids: np.ndarray, bits: int) -> np.ndarray:
    """A bit number below bits for each row of ids."""
    h = np.zeros(len(ids), np.uint64)
    for j in range(ids.shape[1]):
        h = mix64(h + ids[:, j].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return (h & np.uint64(bits - 1)).astype(np.int64)


def _windows(ids: np.ndarray, n: int, may: np.ndarray | None) -> np.ndarray:
    """Starts of the runs of n ids without a break whose runs of n - 1 all may be frequent."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, np.int64)
    ok = np.ones(m, bool)
    if may is None:
        for j in range(n):
            ok &= ids[j : j + m] != 0
    else:
        bits = 8 * len(may)
        shorter = _windows(ids, n - 1, None)
        mark = _marks(ids[shorter[:, None] + np.arange(n - 1)], bits)
        good = np.zeros(m + 1, bool)
        good[shorter] = may[mark >> 3] >> (mark & 7).astype(np.uint8) & 1
        ok = good[:-1] & good[1:]
    return np.flatnonzero(ok)


def phrase_counts(runs: DataFrame, n: int, least: int, may) -> DataFrame:
    """(key, a): frequent runs of n ids; may is a shared bitmap of the frequent runs of n - 1, None for n = 2."""

    longs = ["k1"] if n == 2 else ["k1", "k2"]

    def packed(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        bitmap = None if may is None else may.value

        def out():
            keys, counts = _counted(np.concatenate(held))
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([*map(pa.array, _longs(keys[i : i + 100_000])), pa.array(counts[i : i + 100_000])], names=[*longs, "a"])

        for batch in batches:
            for row in batch.column(0):
                ids = np.frombuffer(row.as_buffer(), np.uint32)
                at = _windows(ids, n, bitmap)
                held.append(ids[at[:, None] + np.arange(n)])
                size += len(at)
                if size > RUN:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    def added(batches) -> Iterator[pa.RecordBatch]:
        last, sum_ = None, 0

        def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([_fixed(_ids(keys, n)), pa.array(counts)], names=["key", "a"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(len(longs))])
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
            at = np.flatnonzero(new)
            counts = np.add.reduceat(batch.column(len(longs)).to_numpy(), at)
            if last is not None and np.array_equal(keys[0], last):
                counts[0] += sum_
            elif last is not None and sum_ >= least:
                yield out(last[None], np.array([sum_]))
            last, sum_ = keys[at[-1]].copy(), int(counts[-1])
            on = np.flatnonzero(counts[:-1] >= least)
            yield out(keys[at[on]], counts[on])
        if last is not None and sum_ >= least:
            yield out(last[None], np.array([sum_]))

    some = stored(runs.mapInArrow(packed, ", ".join([*(f"{k} long" for k in longs), "a long"])))
    tasks = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(some.repartitionByRange(tasks, *longs).sortWithinPartitions(*longs).mapInArrow(added, "key binary, a long"))
    dropped(runs.sparkSession, some)
    return found


def bitmap(found: DataFrame, n: int):
    """A shared bitmap of the keys: 16 bits for each, at least 2**16, at most MOST_BITS; its stripes are made in tasks."""
    spark = found.sparkSession
    bits = min(MOST_BITS, 1 << max(16, (16 * found.count()).bit_length()))
    stripe = min(bits, 1 << 23)

    def marked(batches):
        for batch in batches:
            keys = np.array([np.frombuffer(k.as_buffer(), ">u4") for k in batch.column(0)], np.uint32).reshape(-1, n)
            yield pa.RecordBatch.from_arrays([pa.array(_marks(keys, bits))], names=["mark"])

    def filled(key, table):
        on = np.zeros(stripe, bool)
        on[table["mark"].to_numpy() % stripe] = True
        return pa.table({"stripe": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    marks = found.select("key").mapInArrow(marked, "mark long").distinct()
    rows = marks.groupBy(F.floor(F.col("mark") / stripe).cast("long").alias("stripe")).applyInArrow(filled, "stripe long, bits binary").collect()  # at most MOST_BITS in all
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r["stripe"] * (stripe // 8) : (r["stripe"] + 1) * (stripe // 8)] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(out)


def _part(key: str, first: Column | int, words: Column | int) -> Column:
    """Bytes of ``words`` ids of a key from word ``first`` (0 is the first one)."""
    return F.substring(key, F.lit(first) * 4 + 1, F.lit(words) * 4)


def scored(counts: DataFrame) -> DataFrame:
    """(key, a, l, r, score) of keys of two words and more, counts(key, a) holding those of one word as well."""
    size = (F.length("key") / 4).cast("int")
    phrases = counts.where(F.length("key") > 4)
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("key", "a", "k", _part("key", 0, F.col("k")).alias("one"), _part("key", F.col("k"), size - F.col("k")).alias("two"))
    of = cuts.join(counts.select(F.col("key").alias("one"), F.col("a").alias("l")), "one").join(counts.select(F.col("key").alias("two"), F.col("a").alias("r")), "two")
    # Sums and products of longs as decimals: 2,000,000 times a long has at most 26 digits.
    score = F.expr("cast((cast(a as decimal(19,0)) * cast(2000000 as decimal(7,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("least")
    return of.groupBy("key", "a").agg(least).select("key", "a", "least.l", "least.r", "least.score")


def contained(counts: DataFrame, percent: int) -> DataFrame:
    """Keys whose words lie inside a longer phrase with percent of their occurrences or more."""
    size = (F.length("key") / 4).cast("int")
    longer = counts.where(F.length("key") > 8)
    inner = longer.select("key", F.col("a").alias("outer"), F.explode(F.sequence(F.lit(2), size - 1)).alias("words"))
    inner = inner.select("key", "outer", "words", F.explode(F.sequence(F.lit(0), size - F.col("words"))).alias("first"))
    most = inner.groupBy(_part("key", F.col("first"), F.col("words")).alias("key")).agg(F.max("outer").alias("outer"))
    big = "cast({} as decimal(19,0)) * cast({} as decimal(3,0))"
    return counts.join(most, "key").where(F.expr(f"{big.format('outer', 100)} >= {big.format('a', percent)}")).select("key")


def collocations(docs: DataFrame, words: int = 4, least: int = 30, percent: int = 80, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    made = stored(blocks(docs), wide=True)
    totals = made.select(F.explode("totals").alias("t")).groupBy("t.lang").agg(F.sum("t.n").alias("n"))
    every = made.select(F.explode("words").alias("w")).groupBy("w.lang", "w.word").agg(F.sum("w.n").alias("f")).where(F.col("f") >= least)
    dictionary = stored(numbered(every, "lang", "word"))
    runs = stored(coded(made, dictionary), wide=True)
    one = dictionary.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("key"), F.col("f").alias("a"))
    found, may = [], None
    for n in range(2, words + 1):
        found.append(phrase_counts(runs, n, least, may))
        may = bitmap(found[-1], n) if n < words else None
    counts = one
    for f in found:
        counts = counts.unionAll(f)
    stay = scored(counts).join(contained(counts.where(F.length("key") > 4), percent), "key", "left_anti")
    spelled = (
        stay.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("key") / 4).cast("int") - 1), lambda i: F.conv(F.hex(_part("key", i, 1)), 16, 10).cast("long"))).alias("place", "id"))
        .join(dictionary.select("id", "lang", "word"), "id")
        .groupBy("key", "lang", "a", "l", "r", "score")
        .agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"])).alias("phrase"))
    )
    order = "ORDER BY score DESC, a DESC, phrase"
    # The first ones of each hash part of a language, then of the language: no task orders all of its phrases.
    few = spelled.withColumn("part", F.expr(f"row_number() OVER (PARTITION BY lang, pmod(xxhash64(phrase), 64) {order})")).where(F.col("part") <= top)
    ranked = few.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})").cast("long")).where(F.col("rank") <= top)
    out = stored(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    dropped(spark, made, dictionary, runs, *found)
    return out
