import random

import pytest
from pyspark.sql import functions as F

from foliospark.llm import _rows, jaccard
from tests.llm.data import SF, docs, empty, least_linked


def check(spark, table, k, percent):
    entries = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    groups, sizes = least_linked([t for _, t in entries], k, percent)
    want = []
    for i, (key, _) in enumerate(entries):
        keys = [entries[j][0] for j in groups[i] if entries[j][0] is not None]
        want.append((key, sizes[i], min(keys) if keys else None))
    got = [tuple(r) for r in jaccard.components_of(table, k=k, percent=percent).select("doc_id", "n_shingles", "component_id").collect()]
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(got, key=order) == sorted(want, key=order)


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_odd_rows(spark, k, percent):
    check(spark, docs(spark), k, percent)


def test_table(spark):
    check(spark, spark.read.parquet(f"{SF}/documents.parquet"), 4, 85)


def families(seed, n):
    """Families of near copies around the threshold, with shared passages."""
    r = random.Random(seed)
    words = [f"v{i}" for i in range(400)]
    passages = [[r.choice(words) for _ in range(25)] for _ in range(3)]
    out = []
    for _ in range(6):
        base = [r.choice(words) for _ in range(r.choice([12, 60, 120]))]
        for _ in range(n):
            text = [r.choice(words) if r.random() < r.choice([0, 0.01, 0.03, 0.06]) else w for w in base]
            if r.random() < 0.3:
                text = r.choice(passages) + text
            out.append(" ".join(text))
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("small_blocks", [False, True])
def test_families(spark, monkeypatch, small_blocks):
    if small_blocks:
        for name, v in (("BLOCK_DOCUMENTS", 5), ("BLOCK_TOKENS", 600), ("PART_DOCUMENTS", 7), ("PART_TOKENS", 900), ("COMMON", 3)):
            monkeypatch.setattr(jaccard, name, v)
    check(spark, spark.createDataFrame(families(5, 30), "doc_id long, text string").repartition(4), 4, 85)


def test_keep_one(spark):
    kept = jaccard.keep_one(docs(spark)).collect()
    assert kept[0].asDict().keys() == docs(spark).first().asDict().keys()
    ids = [r.doc_id for r in kept]
    # the row without key and with the text of 1 goes, the one without text stays; near texts with their shared part stay
    assert sorted((i for i in ids if i is not None)) == [1, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 16, 17, 18]
    assert [r.text for r in kept if r.doc_id is None] == [None]


def test_empty(spark):
    assert jaccard.components_of(empty(spark)).collect() == []
    assert jaccard.keep_one(empty(spark)).collect() == []


def test_copies_of_an_opened_class_are_read_once(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)] * 300 + [" ".join(base[:-1] + ["other"])] * 2 + [" ".join(reversed(base))]
    table = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(4)
    named = jaccard._prefixes(table.withColumn("th", F.xxhash64("text")), 4, 85).select("cid").distinct()
    got = jaccard._tokens(table, named, 4).collect()
    assert len(got) == len({r.cid for r in got}) == 3
    check(spark, table.withColumnRenamed("key", "doc_id"), 4, 85)


def test_texts_come_in_small_batches(spark, monkeypatch):
    name, seen, saved = "spark.sql.execution.arrow.maxRecordsPerBatch", [], jaccard.saved

    def seen_by(df):
        seen.append(int(spark.conf.get(name)))
        return saved(df)

    before = spark.conf.get(name)
    monkeypatch.setattr(jaccard, "saved", seen_by)
    check(spark, docs(spark), 5, 80)
    assert seen and max(seen) <= 1_000
    assert spark.conf.get(name) == before


def test_groups_of_several_batches(spark, monkeypatch):
    monkeypatch.setattr(_rows, "TEXT_BATCH", 2)
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join([*words[:58], f"u{i}", "end"])) for i in range(40)]
    check(spark, spark.createDataFrame(texts, "doc_id long, text string").repartition(3), 4, 85)
