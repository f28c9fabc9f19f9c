"""Near-duplicate lines by an exact set-similarity join, in DataFrame functions only.

A line is the set of its distinct lower-case words between white space. Words are ordered by rarity; a line is posted
under its prefix, the first n - ceil(0.8 n) + 1 words in that order, as two sets with Jaccard similarity of 0.8 or
more share a word there; the smaller of two sets needs only n - ceil(8/9 n) + 1 words, which the positional filter sees
to. Length, positional and bit-sketch filters are part of the join condition; what passes is verified on the whole sets.
A line goes when an earlier line, by key, then line number, then text, matches it, whether or not that earlier line
goes too.

One earlier match is enough, so the sets under a word that many share are never paired with each other: in rounds,
those still without a match are held against the first set of each such word, then its first ``ROUNDS``, and only
those that match none of them against the rest. A set that has found a match stops asking and stays as a witness. Words
with ``SHARED`` sets or fewer are joined plainly, which makes at most that many pairs for each of their postings.

Rarity: words are ordered by how often they stand in the corpus, in classes of half a power of two, and within a
class by hash; counts are kept by slots of the words' hashes, so that the tables are bounded. Any fixed order is
exact, and this one keeps frequent words out of prefixes.

Sets, words and places go by 64-bit hashes, posted words by 31 bits of them, which the verification makes good.

Lines without a word stay. Null text stays null. Rows equal in key and text count as one entry and get one result.
A null key sorts first. Other columns pass through whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm._native import bit_map, bit_test
from foliospark.llm._rows import discard, fresh, saved, small, stored

#: Bits of a word's hash that choose its slot, of the counts and of the table of classes (512 KB).
SLOT_BITS = 19
#: Sets of fewer words match only their equals.
LEAST = 4
#: A posted word with more sets than this is joined in rounds: against so many of its first sets, then against all.
SHARED, ROUNDS = 256, (1, 32)
#: Sets of more words than this have a second sketch, over half of their words.
LONG = 96
#: So many wanted places are told to all tasks; more are found by a bit map of their texts and a join.
FEW = 1 << 17
_HASH = (1 << 56) - 1
#: Single bytes whose crc32 have rising first seven bits: a class's byte is turned into its number by one function.
_LEVELS = bytes({zlib.crc32(bytes([b])) >> 25: b for b in range(256)}[k] for k in sorted({zlib.crc32(bytes([b])) >> 25 for b in range(256)}))


def _split(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, th, i, line) of every line of every text."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    return rows.select("key", "th", F.posexplode(F.split("text", "\n")).alias("i", "line"))


def _parts(line: Column) -> Column:
    """What lies between the blanks of a line, lower-case; empty parts too."""
    low = F.lower(line)
    other = F.lit(False)
    for blank in "\t\r\x0b\x0c":
        other = other | line.contains(blank)
    return F.when(other, F.split(low, r"[\s]+")).otherwise(F.split(low, " "))  # one plain space needs no pattern


def _words(line: Column) -> Column:
    """Distinct hashes of a line's words."""
    return F.array_distinct(F.transform(F.array_remove(_parts(line), ""), lambda w: F.xxhash64(w)))


def _counts(lines: DataFrame) -> DataFrame:
    """(slot, n): how often the words of each slot stand in lines, where more than once."""
    words = lines.select(F.explode(_parts(F.col("line"))).alias("word")).where("word != ''").select(F.xxhash64("word").alias("k"))
    slot = F.col("k").bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).cast("int")
    return words.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).where("n > 1")


def _classes(counts: DataFrame) -> Column:
    """The rarity class of the words of each slot, as a byte."""
    level = F.round(F.log2("n") * 2).cast("int")
    rows = counts.select("slot", F.least(level, F.lit(len(_LEVELS) - 1)).alias("level")).toArrow()
    table = np.full(1 << SLOT_BITS, _LEVELS[0], np.uint8)
    table[rows.column("slot").to_numpy()] = np.frombuffer(_LEVELS, np.uint8)[rows.column("level").to_numpy()]
    return F.lit(bytearray(table.tobytes()))


def _sets(lines: DataFrame, classes: Column) -> DataFrame:
    """The lines with w, their words' places in the global order, ascending, and n, how many."""
    byte = lambda h: F.substring(classes, h.bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).cast("int") + 1, F.lit(1))
    place = F.transform(_words(F.col("line")), lambda h: (F.crc32(byte(h)) * F.lit(1 << 31)).bitwiseXOR(h.bitwiseAND(F.lit(_HASH))))
    return lines.withColumn("w", F.sort_array(place)).drop("line").withColumn("n", F.size("w"))


def _sketch(word: Column, bit: Column) -> Column:
    """``bit`` at one of 64 places, by the lowest bits of a word."""
    return F.call_function("shiftleft", bit, word.bitwiseAND(F.lit(63)).cast("int"))


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, th, i): the lines to remove; th is xxhash64 of the text and i counts from 0."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    sketch = F.aggregate("w", zero, lambda a, w: a.bitwiseXOR(_sketch(w, one)))
    half = F.aggregate("w", zero, lambda a, w: a.bitwiseXOR(_sketch(w, F.shiftrightunsigned(w, 6).bitwiseAND(one))))
    prefix = F.transform(F.slice("w", 1, F.col("n") - F.ceil(F.col("n") * 4 / 5).cast("int") + 1), _low)
    about = F.struct("n", sketch.alias("sketch"), F.when(F.col("n") > LONG, half).otherwise(zero).alias("half"), prefix.alias("prefix"))
    split = _split(docs, key, text)
    every = _sets(split, _classes(_counts(split))).select("key", "th", "i", "n", F.xxhash64("w").alias("sid"), F.when(F.col("n") >= LEAST, about).alias("x"))
    table = stored(every)
    lines = table.where("n > 0")

    # distinct sets, each with its earliest place and a short name
    place = F.struct("key", "i", "th")
    sets = stored(lines.groupBy("sid").agg(F.min(place).alias("at"), F.count("*").alias("lines"), F.first("x").alias("x")).withColumn("o", F.monotonically_increasing_id()))
    late = _late(sets.where("x is not null").select("o", "at", "x.*"), docs, key, text).distinct().select("o", F.lit(True).alias("late"))

    # a late set goes with all its places, any other set with all but its first
    first = sets.select("sid", "o", F.col("at").alias("first"), "lines").join(late, "o", "left").where("lines > 1 or late").drop("o", "lines")
    gone = lines.select("sid", "key", "th", "i").join(first, "sid").where(F.col("late").isNotNull() | ~place.eqNullSafe(F.col("first")))
    gone = saved(gone.select("key", "th", "i"))
    discard(sets)
    discard(table)
    return gone


def _late(sets: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(o) of the sets that match an earlier one."""
    posted = sets.select("o", "n", "sketch", "half", F.posexplode("prefix").alias("pos", "token"))
    hot = saved(sets.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("sets")).where(F.col("sets") > SHARED).select("token"))
    late = None
    if not hot.isEmpty():
        hot = small(hot)
        under = sets.select("o", "at", "n", "sketch", "half", F.posexplode("prefix").alias("pos", "token")).join(hot, "token")
        late = _late_in_rounds(under, sets, docs, key, text)
        posted = posted.join(hot, "token", "left_anti")

    # the larger set of a pair is l, so that positions hold e to its shorter prefix; which is the earlier one is seen later
    n, m = F.col("l.n"), F.col("e.n")
    found = stored(_near(posted.alias("l"), posted.alias("e"), (n > m) | (n == m) & (F.col("l.o") > F.col("e.o"))))
    cold = _matched(found, sets, docs, key, text)
    discard(found)
    return cold if late is None else late.unionByName(cold)


def _late_in_rounds(posted: DataFrame, sets: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(o) of the sets that match an earlier one of the same posting."""
    late, seen = saved(sets.select("o").where(F.lit(False))), 0
    posted = stored(posted)
    rank = F.row_number().over(Window.partitionBy("token").orderBy("at"))
    for upto in (*ROUNDS, None):
        asks = posted.join(small(late), "o", "left_anti")
        witnesses = posted if upto is None else posted.withColumn("rank", rank).where(F.col("rank") <= upto).where(F.col("rank") > seen)
        pairs = stored(_near(asks.alias("l"), witnesses.alias("e"), F.col("l.at") > F.col("e.at")))
        if not pairs.isEmpty():
            late = saved(late.unionByName(_matched(pairs, sets, docs, key, text)))
        discard(pairs)
        seen = upto
    discard(posted)
    return late


def _near(left: DataFrame, right: DataFrame, order: Column) -> DataFrame:
    """(l, e, gap) of postings ``l`` and ``e`` in this order that may match by length, position and sketch; gap is how many
    words they differ in at least."""
    n, m, p, q = (F.col(c) for c in ("l.n", "e.n", "l.pos", "e.pos"))
    least = F.ceil((n + m) * 4 / 9)
    differ = {c: F.col(f"l.{c}").bitwiseXOR(F.col(f"e.{c}")) for c in ("sketch", "half")}
    gap = F.when((n > LONG) & (m > LONG), F.bit_count(differ["half"]) + F.bit_count(differ["sketch"].bitwiseXOR(differ["half"]))).otherwise(F.bit_count(differ["sketch"]))
    near = (
        (F.col("l.token") == F.col("e.token")) & order
        & (n * 5 >= m * 4) & (m * 5 >= n * 4)
        & (F.least(n - p, m - q) >= least)
        & (F.bit_count(differ["sketch"]) <= n + m - least * 2) & (gap <= n + m - least * 2)
    )
    return left.join(right, near).select(F.col("l.o").alias("l"), F.col("e.o").alias("e"), gap.alias("gap")).distinct()


def _whole(wanted: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(o, w): the words' hashes of the wanted sets (o, at), saved, read from their places in the texts."""
    wanted = wanted.select("o", "at.*")
    if wanted.limit(FEW + 1).count() <= FEW:
        rows = wanted.select(F.col("key").alias("k"), F.col("th").alias("t")).distinct()
        some = docs.where(F.col(text).isNotNull())
        some = some.join(F.broadcast(rows), F.col(key).eqNullSafe(F.col("k")) & (F.xxhash64(F.col(text)) == F.col("t")), "left_semi")
        lines, spot = _split(some, key, text), F.broadcast(wanted)
    else:
        lines, spot = _wanted_lines(wanted, docs, key, text), wanted
    lines, spot = lines.alias("a"), spot.alias("b")
    same = F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.th") == F.col("b.th")) & (F.col("a.i") == F.col("b.i"))
    found = lines.join(spot, same).select("o", "line").dropDuplicates(["o"])
    return stored(found.select("o", _words(F.col("line")).alias("w")))


def _wanted_lines(wanted: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, th, i, line) of the wanted places, and of few others; one bit map tells texts and lines that surely are not."""
    known = bit_map(wanted.select(F.xxhash64("key", "th").alias("h")).union(wanted.select(F.xxhash64("key", "th", "i"))))
    some = docs.where(F.col(text).isNotNull()).where(known(F.xxhash64(F.col(key), F.xxhash64(F.col(text)))))
    return _split(some, key, text).where(known(F.xxhash64("key", "th", "i")))


def _matched(pairs: DataFrame, sets: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(o) of the later sets of pairs that match. A set is held against the candidate most like it, and against all of
    them only if that one does not match."""
    ids = pairs.select(F.col("l").alias("o")).union(pairs.select("e")).distinct()
    wanted = saved(sets.join(ids, "o").select("o", "at"))
    whole = _whole(wanted, docs, key, text)
    later = F.col("l_at") > F.col("e_at")
    turns = pairs.join(wanted.toDF("l", "l_at"), "l").join(wanted.toDF("e", "e_at"), "e")
    turns = saved(turns.select(F.when(later, F.col("l")).otherwise(F.col("e")).alias("late"), F.when(later, F.col("e")).otherwise(F.col("l")).alias("early"), "gap"))

    def matched(turn: DataFrame) -> DataFrame:
        held = turn.join(whole.toDF("early", "w_early"), "early").select("late", "w_early").join(whole.toDF("late", "w_late"), "late")
        shared = F.size(F.array_intersect("w_early", "w_late"))
        return held.where(shared * 9 >= (F.size("w_early") + F.size("w_late")) * 4).select(F.col("late").alias("o")).distinct()

    first = saved(matched(turns.groupBy("late").agg(F.min(F.struct("gap", "early"))["early"].alias("early"))))
    rest = turns.join(first.select(F.col("o").alias("late")), "late", "left_anti")
    late = saved(first.unionByName(matched(rest)))
    discard(whole)
    return late


def _low(word: Column) -> Column:
    """The lowest 31 bits."""
    return word.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with near-duplicate lines gone from their text, and n_lines and n_removed added (numbered names where
    the rows have those already)."""
    gone = saved(removed_lines(docs, key, text).groupBy("key", "th").agg(F.collect_set("i").alias("gone")))
    k2, th2, list2 = (fresh(docs, f"_{c}") for c in gone.columns)
    lists = gone.toDF(k2, th2, list2)
    parts = F.split(F.col(text), "\n")
    added = fresh(docs, "n_lines"), fresh(docs, "n_removed")

    def result(rows: DataFrame, new: Column, n: Column) -> DataFrame:
        return rows.select(*(new.alias(c) if c == text else F.col(c) for c in docs.columns), F.coalesce(F.size(parts), F.lit(0)).alias(added[0]), n.alias(added[1]))

    # rows that surely lose nothing are not moved
    has = F.coalesce(bit_test(gone.select(F.xxhash64("key", "th").alias("h")), F.xxhash64(F.col(key), F.xxhash64(F.col(text)))), F.lit(False)) & F.col(text).isNotNull()
    joined = docs.where(has).join(lists, F.col(key).eqNullSafe(F.col(k2)) & (F.xxhash64(F.col(text)) == F.col(th2)), "left")
    kept = F.when(F.col(list2).isNull(), F.col(text)).otherwise(F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(F.col(list2), i)), "\n"))
    return result(docs.where(~has), F.col(text), F.lit(0)).unionByName(result(joined, kept, F.coalesce(F.size(F.col(list2)), F.lit(0))))
