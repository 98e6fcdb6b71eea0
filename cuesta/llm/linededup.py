"""Line deduplication by an exact set-similarity join.

A line's set holds its distinct words (lower-cased, split at ASCII white
space).  A line is removed if a line earlier in the corpus has a set with
Jaccard similarity of ``percent`` / 100 or more, whether that line itself stays
or not.  Documents are ordered by doc_id (null last), then by a hash of their
text; lines by their place in the document.  Only lines without a word, which
have no similarity, always stay.

1. The text is split once, in document order.  A stored row of each line holds
   its number ``lid`` (ascending with that order), its words as 59-bit hashes with
   their lengths, and a 128-bit key of the set.  Lines with equal keys form a
   class, led by its first line; the others of the class are removed.
2. Similar sets of n and m words differ in at most H = (n + m)(1 - t) / (1 + t)
   words.  Words are dealt to k > H bins by their hash, so at most H bins of a set
   are unlike the other's, and the strongest bin that both have alike is among the
   H + 1 strongest of each.  Strength is the length of a bin's words, then a hash:
   common words are short, so bins of those alone are left out where there are
   others.  The first line of a class posts a hash of each of these bins, and the
   empty bin if fewer than H + 1 hold a word.  The sizes of two lines tell their H
   and so the one of ``steps`` that they meet under; a line posts under each step
   that its possible partners may meet it in.
3. Lines of one posting are compared by 128-bit maps, of which a word flips one
   bit, so bits that differ are words not shared; those left by their whole sets:
   first with the earliest line of the posting, which settles most copies, then
   the open ones with the line just before them, and those still open with all
   others before them.  No group is cut.

All of it is DataFrame functions; sets are exact up to collisions of the hashes.

Defined cases: null texts stay null and empty ones empty; rows that share a
doc_id, or have none, are documents of their own; columns other than text stay
as they are, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._line_arrays import BITS, M48, _binary, _places, _prefixes  # noqa: F401  (for the tests of the form before)
from ._spark import dropped, stored

MAPS = ["s0", "s1"]
MOST = 1 << 28  # no line has so many words


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once; a column of a lower projection may be inlined and computed for each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _set(line: str) -> Column:
    """The set of a line: ascending 59-bit hashes of its words, each followed by the word's length in four bits."""
    spaced = F.lower(line)
    for c in "\t\v\f\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    words = F.array_remove(F.split(spaced, " "), "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.shiftrightunsigned(F.xxhash64(w), 1).bitwiseAND(F.lit(~15)).bitwiseOR(F.least(F.length(w), F.lit(15))))))


def steps(percent: int) -> list[tuple[int, int, int]]:
    """(above, most, bins): sets that differ in more than above and at most most words are compared under so many bins."""
    out, above = [], 0
    while percent < 100 and above < MOST:
        most = max(above + 1, round(above * 1.6))
        out.append((above, most, (13 * (most + 1) + 9) // 10))
        above = most
    return out


def _postings(words: str, percent: int) -> Column:
    """What a set posts: its strongest bins under each step that it may meet a partner in."""

    def apart(both: Column) -> Column:
        return F.floor(both * F.lit(100 - percent) / F.lit(100 + percent) + F.lit(1e-9))

    def strongest(h: Column, step: Column) -> Column:
        """The (at most) most + 1 strongest bins of hashes h that hold a word."""

        def parted(b: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(1), F.size(b)), lambda i: (i == 1) | (F.get(b, i - 1) != F.get(b, i - 2)))
            return _let(starts, ranked)

        def ranked_as(part: Column) -> Column:
            length = F.aggregate(part, F.lit(0).cast("long"), lambda sum_, x: sum_ + x.bitwiseAND(F.lit(15)))
            return F.shiftleft(F.least(length, F.lit(16383)), 48).bitwiseOR(F.shiftrightunsigned(F.xxhash64(part, step["bins"]), 16))

        def ranked(starts: Column) -> Column:
            def one(s: Column, j: Column) -> Column:
                length = F.coalesce(F.get(starts, j + 1), F.size(h) + 1) - s
                return _let(F.slice(h, s, length), ranked_as)

            return F.slice(F.sort_array(F.transform(starts, one), asc=False), F.lit(1), (step["most"] + 1).cast("int"))

        binned = _let(step["bins"], lambda k: F.transform(h, lambda x: F.shiftright(F.shiftright(x, 31) * k, 32)))
        return _let(binned, parted)

    def under(h: Column, step: Column) -> Column:
        def whole(best: Column) -> Column:  # with the empty bin, if that may be all that a partner shares
            return F.when(F.size(best) <= step["most"], F.concat(best, F.array(step["bins"]))).otherwise(best)

        return _let(strongest(h, step), whole)

    n = F.size(words).cast("long")
    least, most = apart(n + F.ceil(n * percent / F.lit(100) - F.lit(1e-9))), apart(n + F.floor(n * F.lit(100) / F.lit(percent) + F.lit(1e-9)))
    rows = F.array(*(F.struct(F.lit(a).cast("long").alias("above"), F.lit(m).cast("long").alias("most"), F.lit(k).cast("long").alias("bins")) for a, m, k in steps(percent)))
    ends = F.struct(least.alias("least"), most.alias("most"))

    def met(r: Column) -> Column:
        some = F.filter(rows, lambda s: (s["above"] < r["most"]) & (s["most"] >= r["least"]))
        return F.transform(some, lambda s: F.struct(F.least(s["most"], r["most"]).alias("most"), s["bins"].alias("bins")))

    return F.flatten(F.transform(_let(ends, met), lambda s: under(F.col(words), s)))


def _split(rows: DataFrame) -> DataFrame:
    """The stored lines with words (ln from 0) of rows(rid, doc_id, text), and for each row one of ln -1 with its doc_id and number of lines."""
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    texts = rows.select("rid", "doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    parts = F.coalesce(F.split("text", "\n"), F.array().cast("array<string>"))
    texts = texts.select("rid", "doc_id", F.concat(F.array(F.lit(None).cast("string")), parts).alias("parts"))
    lines = texts.select("rid", "doc_id", (F.size("parts") - 1).alias("n_lines"), F.posexplode("parts").alias("ln", "line"))
    head = F.col("ln") == 0
    lines = lines.select("rid", F.when(head, F.col("doc_id")).alias("doc_id"), F.when(head, F.col("n_lines")).alias("n_lines"), (F.col("ln") - 1).alias("ln"), F.monotonically_increasing_id().alias("lid"), _set("line").alias("words"))
    lines = lines.where((F.col("ln") < 0) | (F.size("words") > 0))
    return stored(lines.select("*", F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(1), "words", F.lit(2)).alias("k2")))


def _first_of_class(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """The (lid, words) of first lines.  Their numbers are broadcast as a bit a line: a join would shuffle all sets."""
    bits = classes.groupBy(F.shiftright("first", 15).alias("block")).agg(F.expr("bitmap_construct_agg(first & 32767)").alias("bits"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright("lid", 3).bitwiseAND(F.lit(4095)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, F.col("lid").bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1))
    return lines.join(F.broadcast(bits), F.shiftright("lid", 15) == F.col("block")).where(bit == 1).select("lid", "words")


def _need(n: Column, m: Column, percent: int) -> Column:
    """Least overlap of sets of n and m words that are similar enough."""
    return F.ceil(percent * (n + m) / F.lit(100.0 + percent) - F.lit(1e-9))


def _maps(words: str) -> list[Column]:
    """Maps of a set, 128 bits in all; a word flips one of them, so words shared hide none that differ."""

    def one(j: int) -> Column:
        def flip(bits: Column, x: Column) -> Column:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, 5).bitwiseAND(F.lit(63)).cast("int"))
            return F.when(F.shiftright(x, 11).bitwiseAND(F.lit(1)) == j, bits.bitwiseXOR(bit)).otherwise(bits)

        return F.aggregate(words, F.lit(0).cast("long"), flip)

    return [one(j).alias(MAPS[j]) for j in range(len(MAPS))]


def _alike(one: str, two: str, percent: int) -> Column:
    """Whether rows of sizes and maps, their columns headed by one and two, may be similar enough."""
    n, m = F.col(f"{one}n"), F.col(f"{two}n")
    apart = sum((F.bit_count(F.col(f"{one}{x}").bitwiseXOR(F.col(f"{two}{x}"))) for x in MAPS), F.lit(0))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (apart <= n + m - 2 * _need(n, m, percent))


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stored (lid) of the later lines of the stored pairs(b, a) whose whole sets are similar enough."""
    asked = pairs.select(F.col("b").alias("lid")).union(pairs.select("a")).distinct()
    some = stored(sets.join(asked, "lid", "left_semi"))
    one, two = (some.select(F.col("lid").alias(c), F.col("words").alias(f"w{c}")) for c in "ab")
    both = F.size(F.array_intersect("wa", "wb"))
    enough = (100 + percent) * both >= percent * (F.size("wa") + F.size("wb"))
    out = stored(pairs.join(two, "b").join(one, "a").where(enough).select(F.col("b").alias("lid")).distinct())
    dropped(sets.sparkSession, some)
    return out


def _removed(split: DataFrame, percent: int) -> DataFrame:
    """The stored (rid, ln) of every line to remove; drops the table of _split."""
    spark = split.sparkSession
    lines = split.where("ln >= 0")
    classes = stored(lines.groupBy("k1", "k2").agg(F.min("lid").alias("first")).select("first"))
    sets = lines.select("lid", "words")
    leaders = _first_of_class(lines, classes)
    posting = leaders.select("lid", F.explode(_postings("words", percent)).alias("w"))
    by = Window.partitionBy("w").orderBy("lid")
    met = posting.repartition("w").select("w", "lid", F.first("lid").over(by).alias("a"), F.lag("lid").over(by).alias("before"), F.lead("lid").over(by).alias("after"))
    met = stored(met.where(F.col("before").isNotNull() | F.col("after").isNotNull()).select("w", "lid", "a", "before"))
    maps = stored(leaders.select("lid", F.size("words").alias("n"), *_maps("words")))

    def headed(c: str) -> DataFrame:
        return maps.select(F.col("lid").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("n", *MAPS)))

    made = [classes, met, maps]

    def settled(pairs: DataFrame) -> DataFrame:
        """The stored (lid) of the later lines of pairs(b, a) that are similar enough."""
        left = stored(pairs.distinct().join(headed("b"), "b").join(headed("a"), "a").where(_alike("a_", "b_", percent)).select("b", "a"))
        made.extend([left, _similar(left, sets, percent)])
        return made[-1]

    gone = settled(met.where("a < lid").select(F.col("lid").alias("b"), "a"))
    late = stored(met.where("before > a").join(gone, "lid", "left_anti"))
    more = settled(late.select(F.col("lid").alias("b"), F.col("before").alias("a")))
    open_ = stored(late.join(more, "lid", "left_anti").select("w", F.col("lid").alias("b"), "before").join(headed("b"), "b"))
    made += [late, open_]
    others = met.where("lid > a").join(open_.select("w").distinct(), "w", "left_semi").select("w", F.col("lid").alias("a")).join(headed("a"), "a")
    rest = stored(others.join(open_, "w").where("a < before").where(_alike("a_", "b_", percent)).select("b", "a").distinct())
    last = _similar(rest, sets, percent)
    made += [rest, last]
    gone = gone.union(more).union(last)
    stay = classes.select(F.col("first").alias("lid")).join(gone, "lid", "left_anti")
    out = stored(lines.select("rid", "ln", "lid").join(stay, "lid", "left_anti").select("rid", "ln"))
    dropped(spark, split, *made)
    return out


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with the removed lines taken out of text; one row for each of docs, other columns unchanged."""
    rows = stored(docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).withColumn("rid", F.monotonically_increasing_id()))  # docs may have columns of any name
    whole, doc_id = (F.col(f"c{docs.columns.index(c)}") for c in ("text", "doc_id"))
    gone = _removed(_split(rows.select("rid", doc_id.alias("doc_id"), whole.alias("text"))), percent)
    by_row = gone.groupBy("rid").agg(F.collect_set("ln").alias("gone"))
    kept = F.filter(F.split(whole, "\n"), lambda _, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), whole).otherwise(F.array_join(kept, "\n"))
    joined = rows.join(by_row, "rid", "left")
    return joined.select(*(text if c == "text" else F.col(f"c{i}") for i, c in enumerate(docs.columns))).toDF(*docs.columns)


def digest(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Per document: n_lines, n_removed and the removed line numbers, ascending and comma-joined."""
    split = _split(docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id()))
    heads = stored(split.where("ln = -1").select("rid", "doc_id", F.col("n_lines").cast("long").alias("n_lines")))
    gone = _removed(split, percent).groupBy("rid").agg(F.array_sort(F.collect_set("ln")).alias("gone"))
    return heads.join(gone, "rid", "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed")
    )
