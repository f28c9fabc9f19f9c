"""Sources, sinks, resumable enrichment, streaming."""

import http.server
import threading
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from foliospark import schemas
from foliospark.operators import enrich, stats
from foliospark.plans import pipelines
from foliospark.sources import fetch, state, tables
from foliospark.streaming import resume

SITE = "https://site.example"


def fetches(spark, *urls):
    return spark.createDataFrame([(u, 200, None, f"<h1>Remarks in {u}</h1>", None) for u in urls], schemas.FETCH)


def listing(spark, *links):
    return spark.createDataFrame([("September 1, 2024", "t", x, "c", "r", 1, 0) for x in links], schemas.DOCUMENT_LISTING)


def test_enrichment_resumes(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = listing(spark, "Aa", "Aa", "Bb", None, "No Link")
    got = pipelines.enrich_documents(spark, rows, fetches(spark, "Aa"), path)
    assert got.columns == schemas.DOCUMENT_LISTING.names + schemas.DOCUMENT_DETAIL.names
    by = {r.Document_Link: r for r in got.collect()}
    assert got.count() == 5 and by["Aa"].Location == "Aa" and by["Bb"].Extraction_Status == "Network Error"
    assert (by[None].Extraction_Status, by[None].Word_Count) == ("", None)
    assert state.read(spark, path).count() == 3
    pipelines.enrich_documents(spark, rows, fetches(spark, "Aa", "Bb"), path)
    assert state.read(spark, path).count() == 3  # errors count as done
    got = pipelines.enrich_documents(spark, rows, fetches(spark, "Aa", "Bb"), path, retry_errors=True)
    assert {r.Document_Link: r.Extraction_Status for r in got.collect()}["Bb"] == "Success"
    summary = stats.extraction_summary(got).first()
    assert (summary.n_rows, summary.n_success) == (5, 3)


def test_missing_link_column(spark):
    with pytest.raises(AnalysisException):
        enrich.distinct_links(spark.range(1))


def test_upsert_keeps_the_latest(spark):
    old = spark.createDataFrame([("a", *[""] * 7, False, 1, "Success", datetime(2024, 1, 1)), ("b", *[""] * 7, False, 1, "Success", datetime(2024, 1, 1))], schemas.EXTRACTED)
    new = spark.createDataFrame([("a", *[""] * 7, False, 2, "Success", datetime(2024, 1, 2))], schemas.EXTRACTED)
    assert {r.url: r.Word_Count for r in enrich.upsert(old, new).collect()} == {"a": 2, "b": 1}


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a\nb", 'say "x", y', "l", "c\\d", "é", 1, 0)], schemas.DOCUMENT_LISTING)
    tables.write_csv(rows, str(tmp_path / "a"))
    assert tables.read_csv(spark, str(tmp_path / "a"), schemas.DOCUMENT_LISTING).collect() == rows.collect()
    tables.write_csv(spark.createDataFrame([(["x", "y"],)], "a array<string>"), str(tmp_path / "b"))
    assert tables.read_csv(spark, str(tmp_path / "b"), spark.createDataFrame([], "a string").schema).first()[0] == '["x","y"]'
    assert tables.listing_name(12, datetime(2024, 5, 6, 7, 8, 9)) == "documents_12docs_20240506_070809.csv"
    assert tables.sample_listing(spark, SITE).count() == 2


def test_streamed_extraction(spark, tmp_path):
    landing, path, checkpoint = (str(tmp_path / x) for x in ("landing", "state", "checkpoint"))
    fetches(spark, "Aa", "Aa").write.mode("append").parquet(landing)
    resume.extract_landed(spark, landing, path, checkpoint).awaitTermination()
    fetches(spark, "Aa", "Bb").write.mode("append").parquet(landing)
    resume.extract_landed(spark, landing, path, checkpoint).awaitTermination()
    assert sorted(r.url for r in state.read(spark, path).collect()) == ["Aa", "Bb"]


class Pages(http.server.BaseHTTPRequestHandler):
    failures = {"/busy": 1}

    def do_GET(self):
        code = 404 if self.path == "/none" else 200
        if self.failures.get(self.path, 0):
            self.failures[self.path] -= 1
            code = 503
        self.send_response(code)
        self.end_headers()
        self.wfile.write(f"<h1>{self.path}</h1>".encode())

    def log_message(self, *_):
        pass


def test_live_fetch(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        urls = [f"{base}/a", f"{base}/busy", f"{base}/none", "No Link"]
        spark.dataSource.register(fetch.PageFetchSource)
        got = spark.read.format("page_fetch").options(urls="\n".join(urls), pause="0", backoff="0", slices="2").load()
        want = {urls[0]: 200, urls[1]: 200, urls[2]: 404, urls[3]: None}
        assert {r.url: r.status for r in got.collect()} == want
        links = spark.createDataFrame([(u,) for u in urls], "url string")
        again = fetch.fetch(links, pause=0, backoff=0).collect()
        assert {r.url: r.status for r in again} == want and all((r.error is None) == (r.status == 200) for r in again)
    finally:
        server.shutdown()


def test_listing_plans(spark):
    pages = spark.createDataFrame([(1, '<div class="row"><div class="col-sm-8"><div class="field-title"><a href="/d">T</a></div></div><div class="col-sm-4"></div></div>')], "page int, html string")
    rows, report = pipelines.document_listing(pages, SITE)
    assert report.first().n_rows == rows.count() == 1
    debates = pipelines.debate_listing(pages, SITE)
    got = pipelines.debate_details(debates, fetches(spark, f"{SITE}/x")).collect()
    assert [(r.URL, r.Extracted_Title) for r in got] == [(f"{SITE}/d", "Error: not fetched")]
    assert stats.last_key_counts(rows.withColumn("Year", F.lit(2024)), "Year").first().cnt == 1


def test_csv_is_replaced_by_rows_read_from_it(spark, tmp_path):
    path = str(tmp_path / "listing")
    tables.write_csv(listing(spark, "a", "b"), path)
    tables.replace_csv(tables.read_csv(spark, path, schemas.DOCUMENT_LISTING).where("Document_Link = 'b'"), path)
    assert [r.Document_Link for r in tables.read_csv(spark, path, schemas.DOCUMENT_LISTING).collect()] == ["b"]
    assert [p.name for p in tmp_path.iterdir()] == ["listing"]


def test_failed_connections_are_tried_again():
    url, status, error, html, _ = fetch.fetch_one("http://127.0.0.1:9/", 1, 2, 0.01, "x")
    assert (status, html) == (None, None) and error
    assert fetch.fetch_one("No Link", 1, 2, 100, "x")[2]
