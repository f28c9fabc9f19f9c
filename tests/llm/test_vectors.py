import math
import random

import pytest
from pyspark.sql import functions as F

from foliospark.llm import forest, queries, topk
from tests.llm.data import SF
from tests.oracle import compare

SCHEMA = "vec_id long, embedding array<float>, label int, id long, rank int, score double, v string"


def vectors(seed=1, n=300, dims=6):
    r = random.Random(seed)
    rows = [(i, [round(r.gauss(0, 1), 1) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, [0.5] * dims) for i in range(40)]
    rows += [(100000, None), (100020, [None] + [1.0] * (dims - 1)), (100040, [math.nan] * dims), (100060, [math.inf] * dims), (100080, [0.0] * dims), (None, [1.0] * dims), (20, rows[20][1]), (100100, []), (100120, [2.0, 1.0])]
    return [(i, v, 0, 1, 2, 0.5, "x") for i, v in rows]


def plain(rows, k, scale=None, zeros=True):
    good = {}
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or (not zeros and not any(v)):
            continue
        good[i] = [float(math.floor(scale * float(x))) if scale else float(x) for x in v]
    out = {}
    for q in good:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(good[q], good[c])), c) for c in good if c != q)
            out[q] = [(c, -s) for s, c in scored[:k]]
    return out


def float32(rows):
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], *rest) for i, v, *rest in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("chunk", [16, 4096])
def test_exact_top_k(spark, monkeypatch, chunk):
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "PART", 7)
    rows = vectors()
    got = {}
    for r in topk.search(frame(spark, rows), F.col("id") % 20 == 0, k=20, scale=64).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.id, r.score))
    assert got == plain(float32(rows), 20, 64)


def test_fewer_candidates(spark):
    rows = vectors(n=3)[:3]
    got = topk.search(frame(spark, rows), F.col("id") % 20 == 0, k=20).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.rank)] == [c for c, _ in plain(float32(rows), 20)[0]]
    got = forest.search(frame(spark, rows), F.col("id") % 20 == 0, k=20).collect()
    assert len(got) == 2


def test_query_matches_sql(spark):
    compare(spark, SF, queries.op9_exact_topk, queries._TOPK_SQL)


def test_forest_recall_and_scores(spark):
    rows = float32(vectors(seed=4, n=1500, dims=12))
    want = plain(rows, 20, zeros=False)
    got = {}
    for r in forest.search(frame(spark, rows), F.col("id") % 20 == 0).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.id, r.score))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    kth = {q: v[-1][1] for q, v in want.items()}
    assert sum(s >= kth[q] - 1e-9 for q, v in got.items() for _, s in v) / (20 * len(want)) >= 0.9
    good = {i: v for i, v, *_ in rows if i is not None and v}
    for q, v in got.items():
        assert v == sorted(v, key=lambda x: (-x[1], x[0])) and len({c for c, _ in v}) == 20
        for c, s in v:
            assert math.isclose(s, sum(a * b for a, b in zip(good[q], good[c])), rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("slice_", [7, 100_000])
def test_forest_in_slices_and_below_counted_prefixes(spark, monkeypatch, slice_):
    for name, value in {"SLICE": slice_, "PIECE": 32, "PART": 3, "DEPTH": 3, "CHUNK": 5}.items():
        monkeypatch.setattr(forest, name, value)
    r = random.Random(9)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + r.gauss(0, 0.05) for x in centres[i % 12]]) for i in range(480)]
    rows = float32([(i, v, 0, 1, 2, 0.5, "x") for i, v in rows])
    want = plain(rows, 5, zeros=False)
    got = forest.search(frame(spark, rows), F.col("id") % 20 == 0, k=5).collect()
    assert len(got) == 5 * len(want)
    kth = {q: v[-1][1] for q, v in want.items()}
    assert sum(x.score >= kth[x.query] - 1e-9 for x in got) / len(got) >= 0.9


def test_forest_deep_counts(spark, monkeypatch):
    monkeypatch.setattr(forest, "DEPTH", 2)
    monkeypatch.setattr(forest, "SLICE", 5)
    r = random.Random(3)
    rows = [(i, [r.randrange(2**32) >> r.choice([0, 20]) for _ in range(forest.TREES)]) for i in range(60)]
    table = spark.createDataFrame([(i, c, [1.0], [i]) for i, c in rows], "vid long, codes array<long>, v array<float>, ids array<long>")
    got = forest._Forest(table).deep(table.where("vid < 10")).collect()
    assert len(got) == 10
    for g in got:
        own = rows[g.vid][1]
        for level in range(3, forest.BITS + 1):
            shift = forest.BITS - level
            assert g[f"n{level}"] == sum(c[t] >> shift == own[t] >> shift for _, c in rows for t in range(forest.TREES))


def test_forest_equal_vectors(spark):
    rows = [(i, [0.5, -0.0 if i % 2 else 0.0], 0, 1, 2, 0.5, "x") for i in range(200)] + [(7, [0.5, 0.0], 0, 1, 2, 0.5, "x")] * 50
    rows += [(1000 + i, [0.25, 0.5], 0, 1, 2, 0.5, "x") for i in range(3)]
    got = {}
    for r in forest.search(frame(spark, rows), F.col("id") % 20 == 0, k=5).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.id, r.score))
    assert got == plain(rows, 5, zeros=False)


def test_forest_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = plain(rows, 20, zeros=False)
    hits = sum((r.query_id, r.vec_id) in {(q, c) for q in (r.query_id,) for c, _ in want[q]} for r in queries.op10_forest(spark, sf).collect())
    assert hits / sum(map(len, want.values())) >= 0.9


def test_empty(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert topk.search(rows, F.col("id") % 20 == 0).collect() == []
    assert forest.search(rows, F.col("id") % 20 == 0).collect() == []


def test_equal_vectors_open_few_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(topk, "CHUNK", 16)
    made, scored = [], topk._score

    def counted(asks, *args):
        made.append(asks.count())
        return scored(asks, *args)

    monkeypatch.setattr(topk, "_score", counted)
    rows = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(320)], "vec_id long, embedding array<float>")
    got = topk.search(rows, F.col("id") % 20 == 0, k=5, scale=64).collect()
    for q in range(0, 320, 20):
        assert [r.id for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == [i for i in range(6) if i != q][:5]
    assert sum(made) <= 2 * 16


def test_huge_components_have_a_defined_score(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0, [1e10]), (1, [2e10]), (2, [-1e10])], "vec_id long, embedding array<double>")
    got = topk.search(rows, F.col("id") == 0, k=5, scale=64).collect()
    assert [(r.id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2**63 - 1), (2, -(2**63))]
