"""Byte-level BPE encoding and decoding.

Ranked merges are folded over the bytes of distinct words: the state is a word's pieces and the rank of every
neighbouring pair, and each step joins the leftmost pair of the least rank and looks up its two new pairs. The most
frequent words of the corpus, a bounded table, are folded once and told to the tasks; the distinct rarer ones of a batch
are folded where they stand. Words of up to 40 bytes take each step together, in Arrow batches; longer ones are folded by
higher-order functions with the ranks as a constant table. Decoding looks up each id's bytes and concatenates them.

A word of over 256 bytes is cut at piece boundaries found inside windows of 64, and folded between the cuts, in time with
its length. Where the two pieces at a cut are not the encoding of their bytes, as in one letter repeated, the word is folded
whole, all places of the least rank in a step.

Null text is empty: no ids. Repeated rows get equal results; rows are never dropped; other columns pass through whatever
their names.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm._native import BUCKETS, constant_map, lookup
from foliospark.llm._rows import discard, fresh, most_frequent, stored

#: So many of the most frequent words, of so many bytes at most, are folded once: under 100 MB with their ids.
FREQUENT, LONGEST = 1 << 20, 40
#: Stands for the rank of two pieces that no piece joins.
NONE = 1 << 31
#: Bytes of a window; words of more than four are folded between cuts.
WINDOW = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """bytes -> rank of a rank file: a base64 word and a number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def rank_table(ranks: dict[bytes, int]) -> Column:
    pairs = ((base64.b64encode(k).decode(), v) for k, v in ranks.items())
    return constant_map(pairs, ("binary", "int"), lambda k: zlib.crc32(base64.b64decode(k)) & (BUCKETS - 1))


def split_words(text: Column, pattern: str) -> Column:
    """All matches of the pattern, with classes that know all of Unicode."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def fold(word: Column, table: Column, long: bool = True) -> Column:
    """The ids of a word's bytes (binary), as text with commas. Without ``long``, in time with the square of its length."""

    def encode(ranks: Column) -> Column:
        def rank(piece: Column) -> Column:
            return lookup(ranks, F.crc32(piece).bitwiseAND(F.lit(BUCKETS - 1)), piece)

        def done(state: Column) -> Column:  # no pair is left to join, so the steps that follow have nothing to look through
            return F.struct(state["p"].alias("p"), F.filter(state["r"], lambda x: F.lit(False)).alias("r"))

        def step(state: Column, _) -> Column:
            p, r = state["p"], state["r"]

            def merge(at: Column) -> Column:  # joins pieces at - 1 and at, from 0
                piece = F.concat(F.get(p, at - 1), F.get(p, at))
                none = F.filter(r, lambda x: F.lit(False))

                def joined(c: Column) -> Column:
                    left = F.when(at > 1, F.array(rank(F.concat(F.get(p, at - 2), c)))).otherwise(none)
                    right = F.when(at < F.size(r), F.array(rank(F.concat(c, F.get(p, at + 1))))).otherwise(none)
                    pieces = F.concat(F.slice(p, 1, at - 1), F.array(c), F.slice(p, at + 2, F.size(p)))
                    pairs = F.concat(F.slice(r, 1, F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, F.size(p)))
                    return F.struct(pieces.alias("p"), pairs.alias("r"))

                return _let(piece, joined)

            best = F.array_min(r)
            return F.when(best.isNull(), done(state)).otherwise(_let(F.array_position(r, best).cast("int"), merge))

        def turn(state: Column, n: Column) -> Column:
            """Joins all places of the least rank from left to right, unless a pair that this makes on the way ranks lower."""
            p, r = state["p"], state["r"]

            def merge(best: Column) -> Column:
                at = F.array_position(r, best).cast("int")
                # a 1 for each place; of places that overlap the left one counts
                marks = F.split(F.regexp_replace(F.array_join(F.transform(r, lambda x: F.when(x == best, "1").otherwise("0")), ""), "11", "10"), "")
                both = F.struct(F.concat(F.get(p, at - 1), F.get(p, at)).alias("c"), marks.alias("m"))
                return _let(both, lambda x: joined(best, x["c"], x["m"]))

            def joined(best: Column, c: Column, m: Column) -> Column:
                def piece(x: Column, i: Column) -> Column:
                    old = F.struct(x.alias("p"), F.get(r, i).alias("r"), F.lit(False).alias("new"))
                    new = F.struct(c.alias("p"), F.lit(None).cast("int").alias("r"), F.lit(True).alias("new"))
                    return F.when(F.get(m, i) == "1", new).when(F.get(m, i - 1) == "1", F.lit(None)).otherwise(old)

                def pairs(q: Column) -> Column:
                    return F.transform(
                        F.slice(q, 1, F.size(q) - 1),
                        lambda x, i: F.when(x["new"] | F.get(q, i + 1)["new"], rank(F.concat(x["p"], F.get(q, i + 1)["p"]))).otherwise(x["r"]),
                    )

                def lower(i: Column) -> Column:  # while the place after next is still to be joined
                    return (F.get(m, i) == "1") & (F.get(m, i + 2) == "1") & (rank(F.concat(c, F.get(p, i + 2))) < best)

                between = F.exists(F.sequence(F.lit(0), F.size(r) - 1), lambda i: F.coalesce(lower(i), F.lit(False)))
                q = F.filter(F.transform(p, piece), lambda x: x.isNotNull())
                out = _let(q, lambda q: F.struct(F.transform(q, lambda x: x["p"]).alias("p"), pairs(q).alias("r")))
                after = lambda s: F.exists(s["r"], lambda x: F.coalesce(x < best, F.lit(False)))
                return _let(out, lambda s: F.when(between | after(s), step(state, n)).otherwise(s))

            best = F.array_min(r)
            return F.when(best.isNull(), done(state)).otherwise(_let(best, merge))

        def merged(b: Column, by=step) -> Column:
            """The pieces of some bytes, by joining pairs until none has a rank."""
            n = F.length(b)
            letters = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(b, i, F.lit(1)))
            pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(F.substring(b, i, F.lit(2))))
            start = F.struct(letters.alias("p"), pairs.alias("r"))
            folded = F.aggregate(F.sequence(F.lit(1), n - 1), start, by, lambda s: s["p"])
            return F.when(n > 1, folded).otherwise(F.filter(F.array(b), lambda x: F.length(x) > 0))

        def in_parts(b: Column) -> Column:
            """The pieces of a word that may be long. It is encoded in windows, then between cuts at piece boundaries
            inside them, then the two pieces at each cut: a row of pieces is a word's encoding when each neighbouring two
            are the encoding of their bytes. If some are not, the word is folded whole. A short word is one part."""
            n = F.length(b)
            middle = lambda p: F.aggregate(F.slice(p, 1, F.floor(F.size(p) / 2).cast("int")), F.lit(0), lambda a, x: a + F.length(x))
            ends = lambda parts, j: F.array(F.element_at(F.get(parts, j - 1), -1), F.get(F.get(parts, j), 0))

            def seams(parts: Column, body) -> Column:
                return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), body))

            def between(cuts: Column) -> Column:
                part = lambda j: F.substring(b, F.get(cuts, j - 1) + 1, F.get(cuts, j) - F.get(cuts, j - 1))
                return F.filter(F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), part), lambda x: F.length(x) > 0)

            def phase(state: Column, k: Column) -> Column:
                def after(coded: Column) -> Column:
                    cuts = F.concat(F.array(F.lit(0)), F.transform(coded, lambda p, i: i * WINDOW + middle(p)), F.array(n))
                    joined = seams(coded, lambda j: _let(ends(coded, j), lambda t: F.concat(F.get(t, 0), F.get(t, 1))))
                    agree = F.forall(seams(state["parts"], lambda j: F.get(coded, j - 1) == ends(state["parts"], j)), lambda x: x)
                    todo = F.when(k == 0, _let(cuts, between)).when(k == 1, joined)
                    parts = F.when(k == 1, coded).when((k == 2) & F.coalesce(agree, F.lit(True)), state["parts"])
                    return F.struct(todo.alias("todo"), parts.alias("parts"))

                return _let(F.transform(state["todo"], lambda x: merged(x)), after)

            short = n <= 4 * WINDOW
            windows = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / WINDOW).cast("int")), lambda i: F.substring(b, i * WINDOW + 1, F.lit(WINDOW)))
            start = F.struct(F.when(short, F.array(b)).otherwise(windows).alias("todo"), F.lit(None).cast("array<array<binary>>").alias("parts"))
            phases = F.when(short, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
            return F.aggregate(phases, start, phase, lambda s: F.when(s["parts"].isNull(), merged(b, turn)).otherwise(F.flatten(s["parts"])))

        pieces = in_parts(word) if long else merged(word)
        text = F.array_join(F.transform(pieces, lambda x: rank(x).cast("string")), ",")
        return _let(rank(word), lambda whole: F.when(whole.isNotNull() | (F.length(word) < 2), whole.cast("string")).otherwise(text))

    return _let(table, encode)


class Pieces:
    """The ranks as arrays: every two pieces that join to a third, by both ids as one sorted number, with its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.words = pa.array(ranks.keys(), pa.binary())
        self.ids = np.fromiter(ranks.values(), np.int64, len(ranks))
        self.end = max(ranks.values(), default=-1) + 1  # from here on: bytes without a rank, which have no id
        known = {bytes([b]): self.end + b for b in range(256)} | ranks
        self.bytes = np.array([known[bytes([b])] for b in range(256)], np.int64)
        halves = ((known.get(piece[:i]), known.get(piece[i:]), rank) for piece, rank in ranks.items() for i in range(1, len(piece)))
        pairs = np.array(sorted((a << 32 | b, rank) for a, b, rank in halves if a is not None and b is not None), np.int64).reshape(-1, 2)
        self.pairs, self.joined = np.append(pairs[:, 0], -1), np.append(pairs[:, 1], NONE)  # with one that is never found

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 32 | right
        at = np.searchsorted(self.pairs[:-1], pair)
        return np.where(self.pairs[at] == pair, self.joined[at], NONE)

    def fold(self, words: pa.Array) -> pa.Array:
        """The ids of each word (binary), as text with commas; in each step every unfinished word joins its leftmost pair of
        the least rank. For short words, as there are as many steps as the longest one takes."""
        whole = pc.index_in(words, value_set=self.words)
        at_once = ~whole.is_null().to_numpy(zero_copy_only=False)
        size = np.where(at_once, 0, pc.binary_length(words).to_numpy().astype(np.int64))
        data = np.frombuffer(b"".join(w for w, one in zip(words.to_pylist(), at_once, strict=True) if not one), np.uint8)
        p, owner = self.bytes[data], np.repeat(np.arange(len(words)), size)
        done = [(np.flatnonzero(at_once), self.ids[whole.drop_null().to_numpy()])]
        r = np.full(len(p), NONE, np.int64)
        two = np.flatnonzero(owner[1:] == owner[:-1])
        r[two] = self.rank(p[two], p[two + 1])
        while len(p):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.repeat(np.minimum.reduceat(r, starts), np.diff(np.append(starts, len(p))))
            goes_on = best < NONE
            done.append((owner[~goes_on], p[~goes_on]))
            p, owner, r, best = p[goes_on], owner[goes_on], r[goes_on], best[goes_on]
            at = np.flatnonzero(r == best)
            at = at[np.diff(owner[at], prepend=-1) > 0]
            p[at], r[at] = r[at], NONE
            stays = np.ones(len(p), bool)
            stays[at + 1] = False
            p, owner, r = p[stays], owner[stays], r[stays]
            at -= np.arange(len(at))  # one piece has gone from each word before
            for left in (at[at > 0] - 1, at[at < len(p) - 1]):
                left = left[owner[left] == owner[left + 1]]
                r[left] = self.rank(p[left], p[left + 1])
        owner, p = (np.concatenate(x) for x in zip(*done, strict=True))
        owner, p = owner[p < self.end], p[p < self.end]
        order = np.argsort(owner, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), pa.array(p[order]).cast(pa.string())), ",")


def frequent_words(docs: DataFrame, text: str, pattern: str, pieces: Pieces, most: int = FREQUENT) -> pa.Table:
    """(word, ids) of the most frequent words of all texts."""
    words = docs.select(F.explode(split_words(F.col(text), pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counted = stored(words.where((F.col("n") > 1) & (F.octet_length("word") <= LONGEST)))
    top = most_frequent(counted, "n", most).select("word").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    folded = F.arrow_udf(lambda words: pieces.fold(words.cast(pa.binary())), "string").asNondeterministic()
    known = top.select("word", folded("word").alias("ids")).toArrow()
    discard(counted)
    return known


def _rest(words: pa.Array, pieces: Pieces) -> pa.Array:
    """The ids of words as text, each distinct word folded once; null for those of over ``LONGEST`` bytes."""
    coded = words.cast(pa.binary()).dictionary_encode()
    short = pc.less_equal(pc.binary_length(coded.dictionary), LONGEST)
    place = pc.if_else(short, pc.subtract(pc.cumulative_sum(short.cast(pa.int32())), 1), None)
    return pieces.fold(coded.dictionary.filter(short)).take(place.take(coded.indices))


def _cut(words: pa.Array, ids: pa.Array) -> pa.Array:
    """Lists of words, each with its ids as text or null, to lists of runs."""
    flat, offs = words.flatten(), words.offsets.to_numpy().astype(np.int64)
    offs = offs - offs[0]
    unknown = ids.is_null().to_numpy(zero_copy_only=False)
    lost = np.flatnonzero(unknown)
    kept = ids.drop_null()
    # a run ends before each unknown word and at the end of each row; the unknown word itself is left out of the runs
    rows = len(offs) - 1
    row_of_lost = np.searchsorted(offs, lost, "right") - 1
    outer = np.concatenate([[0], np.cumsum(np.bincount(row_of_lost, minlength=rows) + 1)])
    place = outer[row_of_lost] + np.arange(len(lost)) - np.searchsorted(lost, offs)[row_of_lost]
    begins = np.empty(outer[-1], np.int64)
    begins[outer[:-1]] = offs[:-1]
    begins[place + 1] = lost + 1
    before = np.concatenate([[0], np.cumsum(unknown)])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([begins - before[begins], [len(kept)]]).astype(np.int32)), kept)
    r_at = np.full(outer[-1], -1)
    r_at[place] = lost
    r = flat.cast(pa.binary()).take(pa.array(r_at, mask=r_at < 0))
    return pa.ListArray.from_arrays(pa.array(outer.astype(np.int32)), pa.StructArray.from_arrays([pc.binary_join(lists, ","), r], names=["s", "r"]))


def _runs(known: pa.Table, pieces: Pieces, context):
    """Words to runs: the ids of frequent and short words as text, then the long word that ends the run, if one does."""
    shipped = context.broadcast((known.column("word").combine_chunks(), known.column("ids").combine_chunks(), pieces))

    @F.arrow_udf("array<struct<s:string,r:binary>>")
    def runs(words: pa.Array) -> pa.Array:
        table, ids, pieces = shipped.value
        offs = words.offsets.to_numpy().astype(np.int64)
        at = pc.index_in(words.flatten(), value_set=table)
        out, first = [], 0
        while first < len(words):  # rows of about a million words at a time
            last = max(first + 1, int(np.searchsorted(offs, offs[first] + (1 << 20), "right")) - 1)
            part = words.slice(first, min(last, len(words)) - first)
            flat = part.flatten()
            told = ids.take(at.slice(offs[first] - offs[0], len(flat)))
            lost = told.is_null()
            out.append(_cut(part, pc.replace_with_mask(told, lost, _rest(flat.filter(lost), pieces))))
            first += len(part)
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct([("s", pa.string()), ("r", pa.binary())])))

    return runs.asNondeterministic()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", most: int = FREQUENT) -> DataFrame:
    """The rows with ``ids`` added (a numbered name if taken): the ids as text, with commas."""
    table, pieces = rank_table(ranks), Pieces(ranks)
    known = frequent_words(docs, text, pattern, pieces, most)
    runs = _runs(known, pieces, docs.sparkSession.sparkContext)(split_words(F.col(text), pattern))
    name = fresh(docs, "ids")
    out = docs.withColumn(name, runs)
    whole = F.transform(F.col(name), lambda x: F.concat_ws(",", F.nullif(x["s"], F.lit("")), F.when(x["r"].isNotNull(), fold(x["r"], table))))
    return out.withColumn(name, F.array_join(F.filter(whole, lambda x: x != ""), ","))


def count(ids: Column) -> Column:
    return F.when(ids == "", F.lit(0)).otherwise(F.length(ids) - F.length(F.replace(ids, F.lit(","), F.lit(""))) + 1).cast("bigint")


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """Ids as text with commas to the bytes they stand for."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = F.split(F.lit(",".join(pieces)), ",")
    digits = F.transform(F.split(F.when(ids != "", ids), ","), lambda i: F.get(table, i.cast("int")))
    return F.coalesce(F.unhex(F.array_join(digits, "")), F.lit(b""))
