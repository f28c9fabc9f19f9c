import base64
import gzip
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from foliospark.llm import warc

SCHEMA = "page_id long, url string, html string, `key` string, sha string, first int, `range` int"


def rows(spark):
    long = "<p>" + "word " * 200_000 + "</p>"
    data = [
        (1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, "http://a/3\r\nX-Bad: 1", "<p>x</p>"), (4, "http://ü/ä b?q=1", "é\x00<"), (5, None, None), (6, "", ""), (7, "http://a/7", long),
        (8, "http://a/8", long), (9, "http://a/9", "own"), (9, "http://a/9", "own"), (9, "http://a/9", "own"), (10, "http://a/x", "tie"), (10, "http://a/y", "tie"), (None, "http://n/", "<p>x</p>"), (None, "http://n/2", "alone"),
    ]
    return spark.createDataFrame([(*r, "k", "s", 1, 2) for r in data], SCHEMA)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def files(folder):
    return {n: open(f"{folder}/{n}", "rb").read() for n in sorted(os.listdir(folder)) if n.endswith(".gz")}


def test_round_trip(spark, tmp_path):
    df = rows(spark)
    warc.write(df, str(tmp_path / "w"))
    got = warc.read(spark, str(tmp_path / "w")).collect()
    want = {}
    for r in df.collect():
        want.setdefault(r.html or "", []).append(r)
    assert len(got) == df.count() and len({r.record_id for r in got}) == len(got)
    by_id = {r.record_id: r for r in got}
    for text, same in want.items():
        mine = [r for r in got if r.payload_digest == digest(text)]
        assert sorted(r.key or "" for r in mine) == sorted("" if r.page_id is None else str(r.page_id) for r in same)
        first = [r for r in mine if r.record_type == "response"]
        best = max((-1 if r.page_id is None else r.page_id, r.url or "") for r in same)
        assert len(first) == 1 and (int(first[0].key) if first[0].key else -1) == best[0] and bytes(first[0].payload) == text.encode()
        assert all(r.payload_bytes == len(text.encode()) for r in mine)
        for r in mine:
            if r.record_type == "revisit":
                assert r.to_key == first[0].key and by_id[r.to_id] is first[0] and r.payload is None
    assert not any("X-Bad" in r.uri and "\n" in r.uri for r in got)


def test_small_payloads_are_responses(spark, tmp_path):
    warc.write(rows(spark), str(tmp_path / "w"), least=10)
    got = warc.read(spark, str(tmp_path / "w"), payloads=False).collect()
    assert [r.key for r in got if r.record_type == "revisit"] == ["7"] and all(r.payload is None for r in got)


def test_same_files_from_other_partitions(spark, tmp_path):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).alias("html"))
    few = {"file_bytes": 20_000, "range_bytes": 1 << 20}
    warc.write(pages.repartition(7, F.rand(3)), str(tmp_path / "a"), **few)
    warc.write(pages.coalesce(1), str(tmp_path / "b"), **few)
    a, b = files(tmp_path / "a"), files(tmp_path / "b")
    assert a == b and len({n[:10] for n in a}) == 4 and len(a) > 20
    assert all(len(v) < 40_000 for v in a.values())
    keys = [int(line.split(b": ")[1]) for v in a.values() for line in gzip.decompress(v).split(b"\r\n") if line.startswith(b"X-Source-Key")]
    assert keys == sorted(keys) and len(keys) == 3000
    manifest = json.load(open(next((tmp_path / "a").glob("manifest-*.json"))))
    assert [f["name"] for f in manifest["files"]] == list(a) and all(hashlib.sha256(a[f["name"]]).hexdigest() == f["sha256"] for f in manifest["files"])


def test_failed_job_leaves_the_archive(spark, tmp_path):
    folder = str(tmp_path / "w")
    warc.write(rows(spark), folder)
    before = sorted(os.listdir(folder))
    with pytest.raises(Exception, match="bad row"):
        warc.write(rows(spark).withColumn("html", F.when(F.col("page_id") == 9, F.raise_error(F.lit("bad row"))).otherwise(F.col("html"))), folder)
    assert sorted(os.listdir(folder)) == before
    warc.write(rows(spark).where("page_id = 4"), folder)
    assert warc.read(spark, folder).count() == 1 and len(files(folder)) == 1


def test_crash_before_the_manifest(spark, tmp_path):
    """Files under temporary names, or with final names that no manifest has, are not read."""
    folder = tmp_path / "w"
    warc.write(rows(spark).where("page_id = 4"), str(folder))
    (folder / "_tmp-dead").mkdir()
    (folder / "_tmp-dead" / "x").write_bytes(b"half")
    (folder / "part-00009-00000-dead.warc.gz").write_bytes(b"half")
    assert warc.read(spark, str(folder)).count() == 1


def test_damage_is_told(spark, tmp_path):
    folder = tmp_path / "w"
    warc.write(rows(spark).where("page_id = 4"), str(folder))
    path = next(folder.glob("*.gz"))
    path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace("é".encode(), "è".encode())))
    with pytest.raises(Exception, match="is damaged|ends within"):
        warc.read(spark, str(folder)).collect()


def test_empty(spark, tmp_path):
    warc.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "w"))
    assert warc.read(spark, str(tmp_path / "w")).collect() == []


def test_strings_as_keys(spark, tmp_path):
    df = spark.createDataFrame([("b:ä", "x", "1"), ("a", "y", "1"), (None, "z", "2")], "name string, link string, body string")
    warc.write(df, str(tmp_path / "w"), key="name", uri="link", payload="body", range_bytes=2)
    got = {r.key: (r.record_type, r.to_key) for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert got == {"b:ä": ("response", None), "a": ("revisit", "b:ä"), None: ("response", None)}
