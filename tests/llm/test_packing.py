from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import packing
from tests.llm.data import SF, docs, empty


def padding(lengths, counts, ups):
    return sum(c * (min(u for u in ups if u >= n) - n) for n, c in zip(lengths, counts, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_boundaries_have_least_padding(histogram, k):
    lengths = sorted(histogram)
    counts = [histogram[n] for n in lengths]
    got = packing.boundaries(np.array(lengths), np.array(counts), k)
    best = min(padding(lengths, counts, [*c, lengths[-1]]) for r in range(min(k, len(lengths))) for c in combinations(lengths, r))
    assert len(got) <= k and got[-1] == lengths[-1] and padding(lengths, counts, got) == best


def check(rows, n_docs, budget):
    assert len(rows) == n_docs
    assert len({(r.bucket, r.batch, r.slot) for r in rows}) == n_docs
    ups = sorted({r.padded_to for r in rows})
    for r in rows:
        assert r.padded_to == min(u for u in ups if u >= r.n_tokens)
        assert r.slot < max(1, budget // max(1, r.padded_to))
    for b in {r.bucket for r in rows}:
        own = [r for r in rows if r.bucket == b]
        capacity = max(1, budget // max(1, own[0].padded_to))
        assert len({r.batch for r in own}) == -(-len(own) // capacity)


@pytest.mark.parametrize("shard", [3, 2048])
def test_every_row_gets_one_slot(spark, shard):
    check(packing.pack(docs(spark), buckets=4, budget=64, shard=shard).collect(), docs(spark).count(), 64)


def test_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    check(packing.pack(table).collect(), table.count(), packing.BUDGET)


def test_empty(spark):
    assert packing.pack(empty(spark)).collect() == []


def test_keys_that_many_rows_have_are_cut(spark):
    """A third of the rows under one key, a third without a key: no window holds more than a few shards."""
    rows = spark.range(3000).selectExpr("case when id % 3 = 0 then 7 when id % 3 = 1 then id end as doc_id", "concat_ws(' ', array_repeat('w', cast(id % 5 as int))) as text").repartition(5)
    got = packing.pack(rows, buckets=2, budget=64, shard=16)
    check(got.collect(), 3000, 64)
    cells = got._jdf.queryExecution().analyzed().toString()
    assert "parts" in cells and "part" in cells
    assert got.groupBy("doc_id").count().where("doc_id = 7 or doc_id is null").count() == 2


def test_one_long_document_leaves_the_bounds_of_others_exact(spark):
    rows = spark.range(900).selectExpr("id as doc_id", "if(id = 0, 1000000, 1 + id % 30) as n")
    got = packing.pack(rows, text="doc_id", length=F.col("n"), buckets=4, budget=64).collect()
    check(got, 900, 64)
    lengths, counts = zip(*sorted(Counter(r.n_tokens for r in got).items()), strict=True)
    ups = sorted({r.padded_to for r in got})
    best = min(padding(lengths, counts, [*c, lengths[-1]]) for c in combinations(lengths, 3))
    assert padding(lengths, counts, ups) == best and set(ups) <= set(lengths)
