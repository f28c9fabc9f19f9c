import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from foliospark.llm import periods, queries
from tests.llm.data import docs, empty


def plain(w, least=24, times=3):
    """Every stretch that keeps a period and cannot be extended, without those that keep a smaller one."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            begin = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - begin + q
            if length >= max(least, times * q) and not any(s <= begin and s + n >= begin + length for s, n, _ in out):
                out.append((begin, length, q))
            i = max(i, begin + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some_texts(rng, n):
    for _ in range(n):
        letters = rng.choice(["a", "ab", "abc", "abcdefghij"])
        w = [rng.choice(letters) for _ in range(rng.randint(0, 70))]
        for _ in range(rng.randint(0, 2)):
            p, k = rng.randint(1, 9), rng.randint(0, len(w))
            w = w[:k] + (w[k : k + p] * 14)[: rng.randint(0, 70)] + w[k:]
        yield " ".join(w)


@pytest.mark.parametrize(("least", "times"), [(24, 3), (4, 2), (7, 3), (10, 4)])
def test_runs(spark, least, times):
    texts = list(some_texts(random.Random(times), 300))
    got = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3).select("text", periods.find(F.col("text"), least, times).alias("f")).select("text", "f.*").collect()
    assert len(got) == len(texts)
    for r in got:
        w = r.text.split()
        want = plain(w, least, times)
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(w) and r.collapsed == collapsed(w, want)


def test_next_smaller_with_long_chains():
    import numpy as np

    rng = np.random.default_rng(1)
    for a in (np.arange(500), np.arange(500)[::-1].copy(), np.concatenate([[-1], np.arange(500)[::-1]]), rng.integers(0, 9, 400), rng.permutation(400)):
        want = [next((j for j in range(i + 1, len(a)) if a[j] < a[i]), len(a)) for i in range(len(a))]
        # equal values do not occur in rank arrays; pointers stop at them
        if len(set(a.tolist())) == len(a):
            assert periods.next_smaller(a).tolist() == want


def test_query(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, t if i % 17 else None) for i, t in enumerate(some_texts(rng, 250))]
    rows += [(1000 + i, " ".join(f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(1, 400)))) for i in range(150)]
    rows += [(None, "a b " * 20), (5000, "\t\n"), (5001, "é\x1cé " * 30), (5002, "x\x0by\x0cz\r" * 9), (5003, "long " * 3000), (5003, "long " * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in queries.op11_periods(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for i, text in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        runs = plain(w)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert sum(1 for r in want if r[0] and 1000 <= r[0] < 2000 and r[1]) >= 5


def test_odd_rows_and_empty(spark):
    table = docs(spark).withColumn("runs", F.lit(1))
    got = periods.with_runs(table)
    assert got.columns == [*table.columns, "n_words", "runs_2", "collapsed"]
    for r in got.collect():
        w = (r.text or "").replace("　", "#").split(" ") if False else [x for x in re.split("[\x20\x09-\x0d]+", r.text or "") if x]
        assert r.n_words == len(w) and [tuple(x) for x in r.runs_2] == plain(w)
    assert periods.with_runs(empty(spark)).collect() == []


def test_a_very_long_text(spark):
    text = "start " + "a b c " * 100_000 + "end"
    got = spark.createDataFrame([(text,)], "text string").select(periods.find(F.col("text")).alias("f")).first().f
    assert [tuple(r) for r in got.runs] == [(1, 300_000, 3)] and got.collapsed == "start a b c end"
