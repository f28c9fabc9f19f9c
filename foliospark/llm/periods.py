"""Maximal periodic runs of words, by the runs theorem.

Every run holds a longest Lyndon word, of the length of its period, under one of two orders that differ in which word is
smaller. The longest Lyndon word from a place ends before the next place whose suffix is smaller, which is the next
smaller value of the inverse suffix array; that gives one candidate for each place and order. Its period is extended to
both sides by longest common extensions: range minima, from a sparse table, of the LCP array of the texts and of their
reverses.

Texts of about a megabyte are taken together: words get numbers, words of different texts different ones, and the
numbers of the texts fall for the first order and rise for the second, so that a text's end is less or greater than all
that stands before it. Suffixes are sorted by prefix doubling. A run of at least ``least`` words and ``times`` periods
repeats at least ``least - least / times`` words at its period, so texts in which no two suffixes agree so far are done
when the sorting comes to that length.

A run is (start, length, period) in words from 0, its period being the smallest. Collapsing drops a run's words after its
first period. Null or empty texts have no runs, and their collapsed text is empty. A text is handled whole, in about 400
bytes a word. Rows are never dropped; an empty table gives no rows; other columns pass through whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm import _words as W
from foliospark.llm._rows import fresh

LEAST, TIMES = 24, 3
#: Turns of pointer jumping before the few places that are left are finished one by one.
_JUMPS = 48
FOUND = "struct<n_words:long,runs:array<struct<start:long,length:long,period:long>>,collapsed:string>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def suffix_array(s: np.ndarray, greatest: bool = False, upto: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of ``s`` in order, each one's rank, and those that still tie when ``upto`` symbols have been compared.
    The end counts as less than every symbol, or as greater."""
    n = len(s)
    sa = np.argsort(s, kind="stable")
    rank = np.empty(n, np.int64)
    at, first, second, k = np.arange(n), np.zeros(n, np.int64), s[sa], 1
    while True:
        new = np.ones(len(at), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(at)))
        rank[sa[at]] = np.repeat(at[start], size)
        at = at[np.repeat(size > 1, size)]
        if not len(at) or upto is not None and k >= upto:
            return sa, rank, sa[at]
        i = sa[at]
        first = rank[i]
        second = np.where(i + k < n, rank[np.minimum(i + k, n - 1)], n if greatest else -1)
        order = np.argsort(first * (n + 2) + second, kind="stable")
        sa[at], first, second = i[order], first[order], second[order]
        k *= 2


def next_smaller(a: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value; the length where there is none."""
    n = len(a)
    a = np.append(a, a.min(initial=0) - 1)
    to = np.arange(1, n + 1)
    todo = np.flatnonzero(a[to] > a[:-1])
    for _ in range(_JUMPS):  # all between a place and where it points is greater, at any time, so pointers can be followed
        if not len(todo):
            return to
        to[todo] = to[to[todo]]
        todo = todo[a[to[todo]] > a[todo]]
    if not len(todo):
        return to
    values, places = a.tolist(), to.tolist()
    for i in todo[::-1].tolist():
        j, mine = places[i], values[i]
        while values[j] > mine:
            j = places[j]
        places[i] = j
    return np.array(places)


def _common_prefixes(s: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of each suffix in order and the one before it; 0 for the first."""
    out, h = [0] * len(s), 0
    text, order, places = [*s.tolist(), -1], sa.tolist(), rank.tolist()
    n = len(order)
    for i, r in enumerate(places):
        if r == 0:
            h = 0
            continue
        j = order[r - 1]
        while i + h < n and j + h < n and text[i + h] == text[j + h]:
            h += 1
        out[r] = h
        if h:
            h -= 1
    return np.array(out, np.int32)


def extension(s: np.ndarray, order: tuple | None = None) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of two arrays of different places that tells how far the suffixes there agree; the length may stand for
    the empty suffix."""
    sa, rank, _ = order or suffix_array(s)
    table = [_common_prefixes(s, sa, rank)]
    n = len(s)
    while 2 << len(table) - 1 <= n:
        half = 1 << len(table) - 1
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))

    def extend(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        ok = np.flatnonzero((i < n) & (j < n))
        a, b = rank[i[ok]], rank[j[ok]]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for k in np.unique(level):
            here = level == k
            out[ok[here]] = np.minimum(table[k][lo[here]], table[k][hi[here] - (1 << int(k))])
        return out

    return extend


def _runs(ids: np.ndarray, text: np.ndarray, texts: int, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of words with numbers ``ids``, of texts 0, 1 and so on, by start and period."""
    wide = int(ids.max()) + 1
    down, up = (texts - 1 - text) * wide + ids, text * wide + ids
    order = suffix_array(down)
    n = len(ids)
    starts, ends = [], []
    for to in (next_smaller(order[1]), next_smaller(-suffix_array(up, greatest=True)[1])):
        i = np.arange(n)
        same = np.zeros(n, bool)
        same[to < n] = up[to[to < n]] == up[to < n]
        same[1:] |= up[:-1] == up[to[1:] - 1]
        starts.append(i[same])
        ends.append(to[same])
    i, j = np.concatenate(starts), np.concatenate(ends)
    if not len(i):
        return i, i, i
    ahead = extension(down, order)(i, j)
    back = extension(np.ascontiguousarray(up[::-1]))(n - i, n - j)
    length = j - i + ahead + back
    good = (length >= least) & (length >= times * (j - i))
    found = np.unique(np.stack([(i - back)[good], (j - i)[good], length[good]], 1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def _slice(texts: list[bytes], least: int, times: int) -> tuple[list[int], list[list[tuple]], list[bytes]]:
    """Numbers of words, runs and collapsed texts of some texts."""
    words = [t.split() for t in texts]  # at the six ASCII blanks
    sizes = np.array([len(w) for w in words])
    runs: list[list[tuple]] = [[] for _ in texts]
    number = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    shared = -(-least * (times - 1) // times)
    if len(ids):
        *_, tied = suffix_array(text * len(number) + ids, upto=1 << shared.bit_length() - 1)
        chosen = np.unique(text[tied])
        if len(chosen):
            inside = np.isin(text, chosen)
            where = np.flatnonzero(inside)
            begins = (np.cumsum(sizes) - sizes).tolist()
            for start, length, period in zip(*(x.tolist() for x in _runs(ids[inside], np.searchsorted(chosen, text[inside]), len(chosen), least, times)), strict=True):
                t = int(text[where[start]])
                runs[t].append((int(where[start]) - begins[t], length, period))
    kept = []
    for mine, some in zip(words, runs, strict=True):
        if some:
            stays = np.ones(len(mine), bool)
            for start, length, period in some:
                stays[start + period : start + length] = False
            mine = compress(mine, stays.tolist())
        kept.append(b" ".join(mine))
    return sizes.tolist(), runs, kept


def find(text: Column, least: int = LEAST, times: int = TIMES) -> Column:
    """n_words, runs by start and period, and the collapsed text of each text."""
    if times < 2 or least < 2:
        raise ValueError("a run has at least two words and two periods")

    @F.arrow_udf(FOUND)
    def run(texts: pa.Array) -> pa.Array:
        sizes, runs, kept = [], [], []
        for _, _, data, offs in W.slices(texts):
            raw = data.tobytes()
            for out, more in zip((sizes, runs, kept), _slice([raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], least, times), strict=True):
                out += more
        flat = [r for some in runs for r in some]
        parts = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
        bounds = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32), pa.int32())
        lists = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(parts, fields=list(_RUN)))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), lists, pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])

    return run.asNondeterministic()(text)


def with_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The rows with n_words, runs and collapsed added (numbered names where the rows have those already)."""
    held = fresh(docs, "_found")
    rows = docs.withColumn(held, find(F.col(text), least, times))
    return rows.select(*docs.columns, *(F.col(held)[c].alias(fresh(docs, c)) for c in ("n_words", "runs", "collapsed")))


def greatest(runs: Column) -> Column:
    """Of runs by start and period, the first with the greatest length / period; null if there is none."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
