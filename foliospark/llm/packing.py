"""Packing by optimal length buckets.

A dynamic programme over the global histogram of lengths chooses the bucket boundaries with the least padding;
inside each bucket documents form batches that hold at most a budget of padded tokens.

Null or empty text has length 0 and takes part. A document longer than the budget is a batch of its own. Equal
lengths are ordered by a hash of the key, then the key; repeated rows are separate entries. An empty table gives
no rows. Only the key and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm._rows import saved, small

BUCKETS = 16
#: Padded tokens in a batch.
BUDGET = 32_768
#: Documents numbered together in one task.
SHARD = 2_048
#: A shard of so many times that, as under a key that many rows have, is cut into parts.
UNEVEN = 4


def words(text: Column) -> Column:
    """Words between ASCII blanks; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def boundaries(lengths: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """The at most k upper bounds, ascending and the last the greatest length, that minimise total padding when
    every length is padded to the next bound. Divide and conquer, as the best cut moves one way only."""
    n = len(lengths)
    if n <= k:
        return [int(x) for x in lengths]
    c = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    s = np.concatenate([[0], np.cumsum(lengths.astype(np.float64) * counts)])
    best = lengths * c[1:] - s[1:]
    cuts = []
    for _ in range(1, k):
        new, cut = np.empty(n), np.zeros(n, np.int64)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(j, b) + 1)  # the last length of the earlier buckets; i == j leaves this one empty
            cost = best[i] + lengths[j] * (c[j + 1] - c[i + 1]) - (s[j + 1] - s[i + 1])
            p = int(np.argmin(cost))
            new[j], cut[j] = cost[p], i[p]
            todo += [(lo, j - 1, a, int(i[p])), (j + 1, hi, int(i[p]), b)]
        best = new
        cuts.append(cut)
    out, j = [], n - 1
    for cut in reversed(cuts):
        out.append(int(lengths[j]))
        j = int(cut[j])
    out.append(int(lengths[j]))
    return sorted(set(out))


def histogram(lengths: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, counts) of all distinct lengths; m of them need m * m / 2 words, so there are about 100,000 in 30 GB."""
    rows = sorted(map(tuple, lengths.groupBy(F.col(column).alias("n")).agg(F.count("*").alias("c")).collect()))
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, shard: int = SHARD) -> DataFrame:
    """Per row of ``docs``: key, n_tokens, bucket (from 0), padded_to, batch (from 0 in its bucket), slot (from 0)."""
    size = words(F.col(text)) if length is None else length.cast("bigint")
    rows = saved(docs.select(F.col(key).alias("key"), F.coalesce(size, F.lit(0)).alias("n_tokens")))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # fixed, as the saved rows are
    values, counts = histogram(rows, "n_tokens")
    ups = boundaries(values, counts, buckets) if len(values) else [0]
    inside = [int(counts[(values <= up) & (values > low)].sum()) for low, up in zip([-1, *ups], ups, strict=False)]
    array = lambda xs: F.array(*(F.lit(int(x)).cast("bigint") for x in xs))
    bucket = F.size(F.filter(array(ups), lambda up: up < F.col("n_tokens")))
    of = lambda xs: F.element_at(array(xs), F.col("bucket") + 1)
    cells = rows.withColumn("bucket", bucket).withColumn("shard", F.pmod(F.xxhash64("key"), of([max(1, -(-n // shard)) for n in inside])))

    # equal keys share a shard: one that is too large for that is cut by the rows' places in the saved table
    large = cells.groupBy("bucket", "shard").agg(F.ceil(F.count("*") / shard).cast("bigint").alias("parts")).where(F.col("parts") > UNEVEN)
    large = small(saved(large))
    cells = cells.join(large, ["bucket", "shard"], "left").withColumn("part", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("row"), "parts")))

    # a document's place in its bucket: those in earlier shards, then those before it in its own
    cell = ("bucket", "shard", "part")
    per = cells.groupBy(*cell).agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per.select(*cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    own = Window.partitionBy(*cell).orderBy("n_tokens", F.xxhash64("key"), "key")
    placed = cells.withColumn("i", F.row_number().over(own) - 1).join(ahead, list(cell)).withColumn("place", F.col("ahead") + F.col("i"))
    capacity = of([max(1, budget // max(1, up)) for up in ups])
    return placed.select(
        F.col("key").alias(key),
        "n_tokens",
        F.col("bucket").cast("int").alias("bucket"),
        of(ups).alias("padded_to"),
        F.floor(F.col("place") / capacity).cast("bigint").alias("batch"),
        F.pmod(F.col("place"), capacity).cast("int").alias("slot"),
    )
