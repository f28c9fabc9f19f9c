"""Bounded tables as constants inside column expressions, so that a look-up needs neither a join nor Python."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm._rows import saved

BUCKETS = 1 << 15


def constant_map(pairs: Iterable[tuple], kinds: tuple[str, str], place: Callable, buckets: int = BUCKETS) -> Column:
    """(key, value) pairs, a bounded number of them, as a constant array of small buckets; ``place`` gives a key's
    bucket from 0, as the look-up will. It is folded once when the plan is optimised."""
    table: list[tuple[list, list]] = [([], []) for _ in range(buckets)]
    for k, v in pairs:
        ks, vs = table[place(k)]
        ks.append(k)
        vs.append(v)
    text = json.dumps([{"k": ks, "v": vs} for ks, vs in table], separators=(",", ":"), ensure_ascii=False)
    return F.from_json(F.lit(text), f"array<struct<k:array<{kinds[0]}>,v:array<{kinds[1]}>>>")


def lookup(table: Column, bucket: Column, key: Column) -> Column:
    """The value of ``key`` in its bucket (from 0), null if it is not there. The bucket is bound once, as the table
    stands in the plan wherever it is named."""
    cell = F.array(F.get(table, bucket.cast("int")))
    return F.get(F.transform(cell, lambda c: F.get(c["v"], (F.array_position(c["k"], key) - 1).cast("int"))), 0)


def bit_test(hashes: DataFrame, value: Column, log2: int = 24) -> Column:
    """Whether ``value`` is among the hashes ``h``, give or take false positives: a constant bit map of 2**log2 bits."""
    return bit_map(hashes, log2)(value)


def bit_map(hashes: DataFrame, log2: int = 24) -> Callable[[Column], Column]:
    """``bit_test`` for several values by one bit map."""
    spark = hashes.sparkSession
    at = F.pmod("h", F.lit(1 << log2))
    words = hashes.select(F.floor(at / 64).alias("b"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(64)).cast("int")).alias("m")).groupBy("b").agg(F.bit_or("m").alias("m"))
    full = spark.range(1 << (log2 - 6)).withColumnRenamed("id", "b").join(words, "b", "left")
    one = full.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "m"))), lambda x: F.coalesce(x["m"], F.lit(0).cast("bigint"))).alias("bits"))
    table = saved(one)

    def test(value: Column) -> Column:
        place = F.pmod(value, F.lit(1 << log2))
        word = F.element_at(table.scalar(), (F.floor(place / 64) + 1).cast("int"))
        return F.getbit(word, F.pmod(place, F.lit(64)).cast("int")) == 1

    return test
