"""Spelling variants by merging subtrees of tries: words one inserted, deleted or replaced code point apart.

Two such words agree on the first or on the last half of the shorter one, so words meet in groups by those halves, four
for each word. A group of more than ``GROUP`` words is cut again: its words agree outside an open part, and two words one
edit apart also agree on one half of that. So no group is held that is much larger than ``GROUP`` (or than the words that
two open places allow), whatever a frequent beginning or ending.

In a group the words form a trie, cut into heavy paths: at every node the words of all but the largest subtree are copied
without the code point that follows the node, into an errata trie. Where its ends meet each other, or ends below the
heavy child, one code point is replaced; where they meet ends below the node itself, it is skipped. Words that only skip
the heavy child's code point are found by walking the light subtrees beside it. A word is copied once for each light edge
above it, of which there are at most log2 of the group's size, and a walk takes no more steps than the light side has
nodes.

``variants`` takes distinct words with their counts; null words and rows do not count. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm._rows import saved, small

GROUP = 1 << 14
#: Fixed value: letters, without a difference between those that have an accent and the two signs among them.
LETTERS = "A-Za-zÀ-ÿ"


def runs(text: Column, least: int = 1) -> Column:
    """All longest stretches of letters of at least so many code points, A-Z lower-cased. Null has none."""
    found = F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"[{LETTERS}]{{{least},}}"), 0)
    return F.coalesce(found, F.array().cast("array<string>"))


# ---- tries


class _Node:
    __slots__ = ("lo", "hi", "depth", "kids", "ends")

    def __init__(self, lo: int, hi: int):
        self.lo, self.hi, self.depth, self.kids, self.ends = lo, hi, 0, {}, ()


def _agree(a: str, b: str, at: int) -> int:
    """How long a prefix both have, which is at least ``at``."""
    most, step = min(len(a), len(b)), 1
    while at < most and a[at : at + step] == b[at : at + step]:
        at, step = min(at + step, most), step * 2
    while step > 1:
        step //= 2
        if at + step <= most and a[at : at + step] == b[at : at + step]:
            at += step
    return at


class _Trie:
    """Distinct sorted words as a path-compressed trie: a node is a range of them that agree up to its depth. ``ids``
    tells what ends with each word."""

    def __init__(self, words: list[str], ids: list):
        self.words, self.ids, self.nodes = words, ids, []
        self.root = _Node(0, len(words))
        todo = [(self.root, 0)]
        while todo:
            node, least = todo.pop()
            self.nodes.append(node)
            lo, hi = node.lo, node.hi
            node.depth = d = _agree(words[lo], words[hi - 1], least) if hi - lo > 1 else len(words[lo])
            if len(words[lo]) == d:
                node.ends = ids[lo]
                lo += 1
            while lo < hi:
                c = words[lo][d]
                end = bisect_right(words, c, lo, hi, key=lambda w: w[d])
                kid = node.kids[c] = _Node(lo, end)
                todo.append((kid, d + 1))
                lo = end


def _meet(a: _Trie, x: _Node, i: int, b: _Trie, y: _Node, j: int) -> Iterator[tuple]:
    """What ends where a word below ``x``, from place i on, and a word below ``y``, from place j on, coincide."""
    todo = [(x, i, y, j)]
    while todo:
        x, i, y, j = todo.pop()
        n, m = x.depth - i, y.depth - j
        k = min(n, m)
        if k and a.words[x.lo][i : i + k] != b.words[y.lo][j : j + k]:
            continue
        if n == m:
            if x.ends and y.ends:
                yield x.ends, y.ends
            for c in x.kids if len(x.kids) <= len(y.kids) else y.kids:
                if c in x.kids and c in y.kids:
                    todo.append((x.kids[c], x.depth, y.kids[c], y.depth))
        elif n < m:
            kid = x.kids.get(b.words[y.lo][j + n])
            if kid is not None:
                todo.append((kid, x.depth, y, j + n))
        else:
            kid = y.kids.get(a.words[x.lo][i + m])
            if kid is not None:
                todo.append((x, i + m, kid, y.depth))


def near_pairs(words: list[str]) -> set[tuple[int, int]]:
    """Pairs of places in a sorted list of distinct words that are one edit apart, the smaller place first."""
    trie = _Trie(words, [(i,) for i in range(len(words))])
    found: set[tuple[int, int]] = set()

    def pair(left, right):
        found.update((min(p, q), max(p, q)) for p in left for q in right)

    for v in trie.nodes:
        if not v.kids:
            continue
        heavy = max(v.kids.values(), key=lambda n: n.hi - n.lo)
        after = v.depth + 1
        if v.ends and heavy.depth == after:
            pair(v.ends, heavy.ends)  # the word of the node itself, with the heavy code point added
        light = [n for n in v.kids.values() if n is not heavy]
        if not light:
            continue
        rest: dict[str, list[int]] = {}
        for n in light:
            for p in range(n.lo, n.hi):
                rest.setdefault(words[p][after:], []).append(p)
        order = sorted(rest)
        errata = _Trie(order, [rest[w] for w in order])
        for same in errata.ids:  # replaced, both light
            pair(same, same) if len(same) > 1 else None
        for left, right in _meet(errata, errata.root, 0, trie, heavy, after):  # replaced, one of them heavy
            pair(left, right)
        for left, right in _meet(errata, errata.root, 0, trie, v, v.depth):  # a light code point skipped
            pair(left, right)
        for n in light:  # the heavy code point skipped
            for left, right in _meet(trie, n, v.depth, trie, heavy, after):
                pair(left, right)
    return {(p, q) for p, q in found if p != q}


# ---- groups


def _split(rows: DataFrame) -> DataFrame:
    """(key, word, n, short, a, b): every word in the two parts of its group. Words of a group agree on the first ``a`` and
    the last ``b`` code points, and have ``short`` or one more."""
    word, a, b = F.col("word"), F.col("a"), F.col("b")
    inner = F.col("short") - a - b
    left = F.floor(inner / 2).cast("int")
    right = inner - left
    ahead = F.struct(F.xxhash64("key", F.lit(0), F.substring(word, a + 1, left)).alias("key"), (a + left).alias("a"), b.alias("b"))
    behind = F.struct(F.xxhash64("key", F.lit(1), F.substring(word, F.char_length(word) - b - right + 1, right)).alias("key"), a.alias("a"), (b + right).alias("b"))
    return rows.select("word", "n", "short", F.explode(F.array(ahead, behind)).alias("part")).select("part.key", "word", "n", "short", "part.a", "part.b")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of key and word to (word, near, n of near) of each group, both ways."""
    held: list[tuple] = []

    def flush(rows: list[tuple]) -> list[tuple]:
        words = [w for _, w, _ in rows]
        return [out for p, q in near_pairs(words) for out in ((words[p], words[q], rows[q][2]), (words[q], words[p], rows[p][2]))]

    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
    for batch in batches:
        held += zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n")), strict=True)
        out, first = [], 0
        for k in range(1, len(held)):
            if held[k][0] != held[first][0]:
                if k - first > 1:
                    out += flush(held[first:k])
                first = k
        held = held[first:]
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
    if len(held) > 1 and (out := flush(held)):
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)


def near(counts: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, near, near_n): all pairs one edit apart, both ways, once each."""
    size = F.char_length("word")
    rows = counts.select("word", "n", F.explode(F.array(size, size - 1)).alias("short")).where("short >= 0")
    rows = rows.select(F.xxhash64("short").alias("key"), "word", "n", "short", F.lit(0).alias("a"), F.lit(0).alias("b"))
    found = None
    while True:
        rows = saved(_split(rows))
        large = rows.where("short - a - b > 1").groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > group).select("key")
        large = small(saved(large))
        ready = rows.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key", "word")
        some = ready.select("key", "word", "n").mapInArrow(_near, "word string, near string, near_n long")
        found = some if found is None else found.unionByName(some)
        if large.isEmpty():
            return found.distinct()
        rows = rows.join(large, "key", "left_semi")


def variants(counts: DataFrame, ratio: int = 5, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words with counts n of at least 1. The form is the near word of
    greatest n (ties: smallest in code-point order) if that is at least ``ratio`` times the word's, ratio being over 1; the
    root is where the forms end, the word itself if it has none."""
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its word, or the forms would not end")
    counts = saved(counts.where(F.col("word").isNotNull() & F.col("n").isNotNull()).select("word", F.col("n").cast("long").alias("n")))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    told = near(counts, group).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = counts.join(told, "word", "left")
    good = -F.col("best.n") >= F.col("n") * ratio
    table = saved(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.word")).alias("form"), F.when(good, -F.col("best.n")).alias("form_n"))
    )
    ends = saved(table.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:  # twice as far in every turn
        further = ends.join(ends.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        ends = saved(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if ends.where("moved").isEmpty():
            break
        ends = ends.drop("moved")
    out = table.join(ends.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
