"""State in buckets, files swapped in one step, paced fetches, probing, streams and figures of a run."""

import email.utils
import http.server
import json
import os
import threading
import time
from contextlib import contextmanager
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliospark import schemas
from foliospark.operators import extract, paging, stats
from foliospark.operators.metrics import Run
from foliospark.plans import pipelines
from foliospark.sources import fetch, published, state, tables
from foliospark.streaming import resume
from tests.test_tables import fetches, listing


def records(spark, urls, words=1, day=1, status="Success"):
    return spark.createDataFrame([(u, *[""] * 7, False, words, status, datetime(2024, 1, day)) for u in urls], schemas.EXTRACTED)


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.glob("bucket=*/*.parquet")}


def words_of(spark, path):
    rows = state.read(spark, str(path)).collect()
    assert len({r.url for r in rows}) == len(rows)
    return {r.url: r.Word_Count for r in rows}


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    path = tmp_path / "state"
    urls = [f"u{i}" for i in range(60)]
    assert state.read(spark, str(path)).count() == 0
    state.upsert(records(spark, urls), str(path), buckets=8)
    before = files(path)
    assert len(before) == 8
    touched = state.upsert(records(spark, ["u3", "new"], words=2, day=2), str(path), buckets=4)  # the state keeps its own number
    after = files(path)
    changed = {f.split("/")[0] for f in set(after) - set(before)}
    assert changed == {f"bucket={t}" for t in touched} and 1 <= len(touched) <= 2 and len(after) == 8
    assert {f: t for f, t in before.items() if f.split("/")[0] not in changed} == {f: t for f, t in after.items() if f.split("/")[0] not in changed}
    assert words_of(spark, path) == dict.fromkeys(urls, 1) | {"u3": 2, "new": 2}
    state.upsert(records(spark, ["u3"], words=9, day=1), str(path))  # an older record does not win
    assert words_of(spark, path)["u3"] == 2
    assert state.upsert(records(spark, []), str(path)) == []


def test_append_and_compact(spark, tmp_path):
    path = tmp_path / "state"
    for day in range(1, 5):
        state.append(records(spark, ["a", "b", "a"], words=day, day=day), str(path), buckets=2)
    assert words_of(spark, path) == {"a": 4, "b": 4}
    many = len(files(path))
    assert state.compact(spark, str(path), files=9) == [] and len(files(path)) == many
    state.compact(spark, str(path), files=2)
    assert len(files(path)) <= 2 and words_of(spark, path) == {"a": 4, "b": 4}


@pytest.mark.parametrize("damage", ["garbage", "truncated"])
def test_damaged_files_are_set_aside_and_extracted_again(spark, tmp_path, damage):
    path = tmp_path / "state"
    links = [f"u{i}" for i in range(30)]
    rows, pages = listing(spark, *links), fetches(spark, *links)
    pipelines.enrich_documents(spark, rows, pages, str(path))
    bad = sorted(path.glob("bucket=*/*.parquet"))[3]
    data = bad.read_bytes()
    bad.write_bytes(b"garbage" if damage == "garbage" else data[: len(data) // 2])
    (bad.parent / f".{bad.name}.crc").unlink(missing_ok=True)
    lost = 30 - len(words_of(spark, path))
    assert lost >= 1
    told = []
    with pytest.warns(UserWarning, match="1 unreadable"):
        got = pipelines.enrich_documents(spark, rows, pages, str(path), told=told.append)
    assert got.where("Extraction_Status = 'Success'").count() == 30 and len(words_of(spark, path)) == 30
    assert sum(t["documents"] for t in told) == sum(t["successes"] for t in told) == lost and all(t["documents_per_second"] >= 0 for t in told)
    assert len(list((path / "_unreadable").iterdir())) == 1
    assert state.quarantine(spark, str(path)) == []


def test_a_slice_that_takes_too_long_is_left(spark, tmp_path, monkeypatch):
    extract_documents = extract.documents
    path = str(tmp_path / "state")
    pages = fetches(spark, *"abcdefgh")
    endless = F.udf(lambda u, h: (u == "a" and time.sleep(60)) or h)
    assert not pipelines.in_time(spark, 1, lambda: pages.withColumn("html", endless("url", "html")).collect())
    assert pipelines.in_time(spark, 60, lambda: pages.collect())
    with pytest.raises(ZeroDivisionError):
        pipelines.in_time(spark, 60, lambda: 1 / 0)
    monkeypatch.setattr(pipelines.extract, "documents", lambda rows, **more: extract_documents(rows.withColumn("html", endless("url", "html")), **more))
    with pytest.warns(UserWarning, match="left to the next run"):
        got = pipelines.enrich_documents(spark, listing(spark, *"abcdefgh"), pages, path, slices=2, slice_seconds=15)
    statuses = {r.Document_Link: r.Extraction_Status for r in got.collect()}
    assert statuses["a"] == "" and set(statuses.values()) == {"", "Success"}
    monkeypatch.undo()
    got = pipelines.enrich_documents(spark, listing(spark, *"abcdefgh"), pages, path, slice_seconds=120)
    assert got.where("Extraction_Status = 'Success'").count() == 8
    assert not [d for d in os.listdir(path) if d.startswith("_todo")]


def test_one_csv_file(spark, tmp_path):
    rows = spark.createDataFrame([(2, 'say "x", y\nz', None, [1]), (1, "", " pad ", []), (3, "é\\", "t", None)], "n int, a string, b string, c array<int>").repartition(3).orderBy("n")
    path = published.write_csv(rows, str(tmp_path), name="out.csv")
    assert path == f"{tmp_path}/out.csv" and os.listdir(tmp_path) == ["out.csv"]
    back = tables.read_csv(spark, path, spark.createDataFrame([], "n int, a string, b string, c string").schema)
    assert [tuple(r) for r in back.collect()] == [(1, None, " pad ", "[]"), (2, 'say "x", y\nz', None, "[1]"), (3, "é\\", "t", None)]
    named = published.write_csv(rows.limit(2), str(tmp_path), stem="documents")
    assert os.path.basename(named).startswith("documents_2docs_") and named.endswith(".csv")
    assert open(published.write_csv(rows.limit(0), str(tmp_path), name="none.csv")).read() == "n,a,b,c\n"


def test_a_failed_job_leaves_the_old_file(spark, tmp_path):
    published.write_csv(spark.range(3), str(tmp_path), name="out.csv")
    before = (tmp_path / "out.csv").read_text()
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 70, F.raise_error(F.lit("bad row"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="bad row"):
        published.write_csv(bad, str(tmp_path), name="out.csv")
    assert os.listdir(tmp_path) == ["out.csv"] and (tmp_path / "out.csv").read_text() == before


def test_a_run_killed_before_commit_leaves_the_old_file(spark, tmp_path):
    published.write_csv(spark.range(3), str(tmp_path), name="out.csv")
    before = (tmp_path / "out.csv").read_text()
    writer = published._Writer({"path": str(tmp_path), "name": "out.csv"}, ["id"])
    (tmp_path / writer.aside).mkdir()
    (tmp_path / writer.aside / "part").write_text("1\n2\n")  # all that a killed job can have written
    assert (tmp_path / "out.csv").read_text() == before
    writer.commit([published._Part(0, f"{tmp_path}/{writer.aside}/part", 2)])
    assert (tmp_path / "out.csv").read_text() == "id\n1\n2\n"


def test_a_replaced_table_comes_back_if_the_swap_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "listing")
    tables.write_csv(listing(spark, "a"), path)
    monkeypatch.setattr(tables, "write_csv", lambda df, path: None)  # nothing to swap in
    with pytest.raises(OSError, match="cannot replace"):
        tables.replace_csv(listing(spark, "b"), path)
    assert [r.Document_Link for r in tables.read_csv(spark, path, schemas.DOCUMENT_LISTING).collect()] == ["a"]


ROW = '<div class="row"><div class="col-sm-8"><div class="field-title">t</div></div></div>'


class Site(http.server.BaseHTTPRequestHandler):
    times: list = []
    busy: dict = {}
    last = 17

    def do_GET(self):
        self.times.append((self.path, time.monotonic()))
        if self.busy.get(self.path):
            self.send_response(503)
            self.send_header("Retry-After", self.busy.pop(self.path))
            self.end_headers()
            return
        self.send_response(200)
        if self.path == "/odd":
            self.send_header("Content-Type", "text/html; charset=no-such-charset")
        self.end_headers()
        page = int(self.path.partition("page=")[2] or 0) + 1
        self.wfile.write(f"<h1>{self.path}</h1>{ROW if page <= self.last else ''}".encode())

    def log_message(self, *_):
        pass


@contextmanager
def site():
    Site.times, Site.busy = [], {}
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_port}"
    finally:
        server.shutdown()


def test_pace_over_all_tasks(spark):
    with site() as base:
        links = spark.createDataFrame([(f"{base}/{i}",) for i in range(12)], "url string").repartition(4)
        assert links.rdd.getNumPartitions() == 4
        got = fetch.fetch(links, pause=0.1, tasks=4).collect()
        assert len(got) == 12 and all(r.status == 200 for r in got)
        times = sorted(t for _, t in Site.times)
        assert times[-1] - times[0] > 0.9 and all(b - a > 0.2 for a, b in zip(times, times[3:], strict=False))


def test_retry_after_and_unknown_charset(spark):
    with site() as base:
        Site.busy = {"/a": "1", "/b": email.utils.formatdate(time.time() + 2, usegmt=True)}
        rows = fetch.fetch(spark.createDataFrame([(f"{base}/{x}",) for x in ("a", "b", "odd")], "url string"), pause=0, backoff=0).collect()
        assert {r.status for r in rows} == {200} and all("<h1>" in r.html for r in rows)
        waits = {p: [t for q, t in Site.times if q == p] for p in ("/a", "/b")}
        assert waits["/a"][1] - waits["/a"][0] > 0.95 and len(waits["/b"]) == 2
    assert (fetch.retry_after("7", 0), fetch.retry_after("soon", 0), fetch.retry_after(None, 0)) == (7.0, 0.0, 0.0)
    assert [fetch.host(u) for u in ("http://u:p@A.b:80/x", "No Link", "http://[bad")] == ["a.b:80", "", ""]


@pytest.mark.parametrize("last", [1, 17, 24, 25])
def test_probing_takes_few_fetches(spark, last):
    with site() as base:
        Site.last = last
        assert paging.probe(spark, f"{base}/list?x=1", 25, pause=0) == last
        assert len(Site.times) <= 5


def test_filters_on_url_reach_the_source(spark):
    spark.dataSource.register(fetch.PageFetchSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        with site() as base:
            pages = spark.read.format("page_fetch").options(filters="true", pause="0", backoff="0").load()
            some = pages.where(F.col("url").isin(f"{base}/a", f"{base}/b")).where("status = 200")
            plan = some._jdf.queryExecution().executedPlan().toString()
            assert "status" in (left := plan.split("Filter")[1].split("\n")[0]) and "url" not in left  # the source takes the rest
            assert {r.url for r in some.collect()} == {f"{base}/a", f"{base}/b"}
            assert sorted(p for p, _ in Site.times) == ["/a", "/b"]
            given = spark.read.format("page_fetch").options(filters="true", pause="0", urls=f"{base}/a\n{base}/c").load().where(F.col("url") == f"{base}/c")
            assert [r.url for r in given.collect()] == [f"{base}/c"] and len(Site.times) == 3
            with pytest.raises(Exception, match="needs the option urls"):
                spark.read.format("page_fetch").load().collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_resumed_stream_fetches_nothing_twice(spark, tmp_path):
    spark.dataSource.register(fetch.PageFetchSource)
    links, out, checkpoint = tmp_path / "links.txt", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    with site() as base:
        def run(until):
            stream = spark.readStream.format("page_fetch").options(links=str(links), pause="0").load()
            query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
            began = time.time()
            while len(Site.times) < until and time.time() - began < 60:
                query.processAllAvailable()
            query.processAllAvailable()
            query.stop()

        links.write_text("".join(f"{base}/{i}\n" for i in range(5)) + f"{base}/unfinished")
        run(5)
        with links.open("a") as f:
            f.write(f"-now\n{base}/last\n")
        run(7)
        assert sorted(p for p, _ in Site.times) == ["/0", "/1", "/2", "/3", "/4", "/last", "/unfinished-now"]
        assert spark.read.parquet(out).count() == 7


def landed(spark, folder, *rows):
    spark.createDataFrame([(u, status, error, html, datetime(2024, 1, 1, 0, minute)) for u, status, error, html, minute in rows], schemas.FETCH).coalesce(1).write.mode("append").parquet(folder)


def test_the_later_fetch_wins(spark, tmp_path):
    landing, path, checkpoint = (str(tmp_path / x) for x in ("landing", "state", "checkpoint"))

    def titles():
        resume.extract_landed(spark, landing, path, checkpoint).awaitTermination()
        return {r.url: (r.Document_Title, r.Extraction_Status) for r in state.read(spark, path).collect()}

    landed(spark, landing, ("a", 200, None, "<h1>old</h1>", 1), ("a", 200, None, "<h1>new</h1>", 3), ("a", None, "timed out", None, 2), ("b", 500, None, None, 1), ("b", 200, None, "<h1>good</h1>", 1))
    assert titles() == {"a": ("new", "Success"), "b": ("good", "Success")}
    landed(spark, landing, ("a", 200, None, "<h1>older</h1>", 2), ("b", 200, None, "<h1>better</h1>", 5), ("c", 200, None, "<h1>first</h1>", 1))
    assert titles() == {"a": ("new", "Success"), "b": ("better", "Success"), "c": ("first", "Success")}


def test_figures_without_a_second_scan(spark, tmp_path):
    pages = spark.createDataFrame([(i, ROW * i) for i in range(1, 4)], "page int, html string")
    path, figures = pipelines.publish_listing(pages, "https://s", str(tmp_path))
    assert "_6docs_" in path and figures["documents"] == 6 and figures["first"] == figures["last"] == "No Date" and figures["documents_per_second"] > 0
    run = Run(good=F.col("Extraction_Status") == extract.SUCCESS)
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    rows = run.counting(records(spark, ["a", "b"]).unionByName(records(spark, ["c"], status="Network Error")).withColumn("url", F.udf(count)("url")))
    rows.write.parquet(str(tmp_path / "rows"))
    got = run.figures()
    assert (got["documents"], got["successes"], got["failures"], seen.value) == (3, 2, 1, 3) and got["seconds"] > 0
    report = stats.listing_report(tables.sample_listing(spark, "https://s"), seconds=4.0).first()
    assert report.rows_per_second == 0.5 and json.loads(json.dumps(report.asDict()))["n_rows"] == 2


def test_a_large_csv_file_is_read_in_splits(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("cast(id as string) as Title", "concat('a, \"', id, '\" ') as Date", "cast(id as int) as Page")
    for name, table in (("plain", rows), ("broken", rows.withColumn("Date", F.when(F.col("Page") == 7, "a\n\"b\"\r\nc").otherwise(F.col("Date"))))):
        path = published.write_csv(table, str(tmp_path / name))
        before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
        try:
            for c in before:
                spark.conf.set(c, "64k")
            back = tables.read_csv(spark, path, table.schema)
            assert (back.rdd.getNumPartitions() > 4) == (name == "plain")
            assert sorted(back.collect()) == sorted(table.collect())
        finally:
            for c, v in before.items():
                spark.conf.set(c, v)
