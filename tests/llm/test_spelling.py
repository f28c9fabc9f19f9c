import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from foliospark.llm import queries, spelling
from tests.llm.data import docs, empty


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, ratio=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def check(spark, counts, **more):
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), **more).collect()
    assert len(got) == len(counts)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain(counts)


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefé𝒳"])
def test_pairs_of_a_group(letters):
    rng = random.Random(len(letters))
    for _ in range(300):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 40))})
        assert spelling.near_pairs(words) == {(i, j) for i, j in itertools.combinations(range(len(words)), 2) if one_edit(words[i], words[j])}


def test_variants(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(0, 7))) for _ in range(400)}
    check(spark, {w: rng.choice((1, 4, 5, 25, 126, 700)) for w in words})


def test_large_groups_are_cut(spark):
    """Words that all share both ends, in groups of at most 8."""
    rng = random.Random(6)
    words = {"stem" + "".join(rng.choice("abc") for _ in range(rng.randint(3, 5))) + "ending" for _ in range(250)}
    check(spark, {w: rng.randint(1, 900) for w in words}, group=8)


def test_chains_ties_and_long_words(spark):
    long = "x" * 20_000
    check(spark, {"aaaa": 1, "aaab": 5, "aabb": 25, "abbb": 125, "bbbb": 625, "cccc": 1, "cccd": 7, "ccce": 7, "é": 5, "e": 25, "": 1, long: 2, long + "y": 10, long[:-1] + "z": 11, "y" + long: 50})


def test_runs(spark):
    rows = spark.createDataFrame([("AbcÀÿ÷×d1ef_GĀh",), (None,), ("",)], "t string").select(spelling.runs(F.col("t")).alias("r"), spelling.runs(F.col("t"), 3).alias("s")).collect()
    assert [r.r for r in rows] == [["abcÀÿ÷×d", "ef", "g", "h"], [], []] and rows[0].s == ["abcÀÿ÷×d"]


def test_query_against_plain_words(spark, tmp_path):
    rng = random.Random(7)
    base = ["planet", "planets", "colour", "Colour", "coloured", "Übergang", "Ubergang", "wonder", "wander", "wonders"]
    rows = [(i if i % 50 else None, " ".join(rng.choice(base) + rng.choice(["", " ", "9", "-"]) for _ in range(rng.randint(0, 60))) if i % 40 else None) for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    counts = {}
    for i, text in rows:
        for w in spelling_runs(text or ""):
            h = zlib.crc32(f"{i}:{w}".encode()) if i is not None else 1
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] = counts.get(w, 0) + 1
    want = plain({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op12_spelling(spark, str(tmp_path)).collect()}
    assert got == want and any(v[0] for v in want.values())


def spelling_runs(text):
    import re

    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[A-Za-zÀ-ÿ]+", text)]


def test_odd_rows_and_empty(spark):
    words = docs(spark).select(F.explode(spelling.runs(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    assert spelling.variants(words).count() == words.count()
    assert spelling.variants(empty(spark).selectExpr("text as word", "n")).collect() == []
    assert spelling.variants(spark.createDataFrame([(None, 3), ("a", None), ("b", 1)], "word string, n long")).count() == 1
