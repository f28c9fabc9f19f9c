"""Page extraction on hand-worked snippets."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark import schemas
from foliospark.functions import html
from foliospark.functions.html import parse
from foliospark.operators import extract, listing, pages, paging
from foliospark.sources import fetch

SITE = "https://site.example"
ROW = (
    '<div class="row"><div class="col-sm-8"><span property="dc:date" content="2024-09-29T00:00:00+00:00">Sep 29</span>'
    '<div class="field-title"><p><a href="/documents/x">A <i>title</i></a></p></div></div>{side}</div>'
)
SIDE = '<div class="col-sm-4"><div class="label-above">{label}</div><a href="/people/y">Someone</a></div>'


def listing_of(spark, html, kind):
    pages = spark.createDataFrame([(1, html)], "page int, html string")
    return [tuple(r) for r in (listing.documents(pages, SITE) if kind == "documents" else listing.debates(pages, SITE)).collect()]


def test_listing_row(spark):
    html = ROW.format(side=SIDE.format(label="Related"))
    assert listing_of(spark, html, "documents") == [("September 29, 2024", "Atitle", f"{SITE}/documents/x", "Someone", f"{SITE}/people/y", 1, 0)]
    assert listing_of(spark, html, "debates") == [("September 29, 2024", "Atitle", f"{SITE}/documents/x", "Someone", f"{SITE}/people/y")]


def test_listing_without_side(spark):
    html = ROW.format(side="")
    assert listing_of(spark, html, "documents")[0][3:5] == ("No Category", "No Link")
    assert listing_of(spark, html, "debates") == []


def test_listing_without_title(spark):
    html = '<div class="row"><div class="col-sm-8"><span property="dc:date">Sep</span></div>' + SIDE.format(label="Related") + "</div>"
    assert listing_of(spark, html, "documents") == []
    assert listing_of(spark, html, "debates") == [("Sep", "", "", "Someone", f"{SITE}/people/y")]


def test_other_label_and_heading_date(spark):
    html = ROW.format(side=SIDE.format(label="See also"))
    assert listing_of(spark, html, "debates")[0][3:] == ("", "")
    assert listing_of(spark, html, "documents")[0][3] == "Someone"
    html = '<div class="row"><div class="col-sm-8"><h4>Fall 2024</h4><div class="field-title">Plain</div></div><div class="col-sm-4"></div></div>'
    assert listing_of(spark, html, "documents") == [("Fall 2024", "Plain", "No Link", "No Category", "No Link", 1, 0)]
    assert listing_of(spark, html, "debates") == [("", "", "", "", "")]


def test_nested_rows_repeat_and_empty_pages_give_none(spark):
    html = f'<DIV CLASS="wide row">{ROW.format(side="")}</DIV>'
    got = listing_of(spark, html, "documents")
    assert len(got) == 2 and got[0] == got[1]
    assert listing_of(spark, "", "documents") == [] and listing_of(spark, None, "documents") == []


def debate_of(spark, html, **options):
    fetches = spark.createDataFrame([("u", 200, None, html, None)], schemas.FETCH)
    return extract.debates(fetches, **options).first()


def debate(body):
    return f'<div class="col-sm-8"><h1> A <b>debate</b></h1><span property="dc:date" content="2024-01-02">Jan</span></div><div class="field-docs-content">{body}</div>'


def test_labels(spark):
    r = debate_of(spark, debate("<p><b>PARTICIPANTS:</b> A Smith;<br>B Jones Jr.; and<br/>C Doe.</p><p><b>Participants:</b> later</p>"))
    assert r.Participants_List == ["A Smith", "B Jones Jr", "and", "C Doe"] and r.Participants == "A Smith; B Jones Jr; and; C Doe"
    assert (r.Extracted_Title, r.Extracted_Date, r.Moderators_List) == ("Adebate", "2024-01-02", [])
    r = debate_of(spark, debate("<p><b>Participants</b>: A; B</p>"))
    assert r.Participants_List == ["Participants : A", "B"]
    for other in ("<p><b>Moderator:</b> A</p>", "<p><strong>Moderators:</strong> A</p>"):
        assert debate_of(spark, debate(other)).Moderators_List == []


def test_transcript_and_inner_html(spark):
    body = "<p>a <b>b</b></p><p>c<br>d</p><script>x</script>"
    r = debate_of(spark, debate(body))
    assert r.Debate_Content_Text == "a\nb\nc\nd" and r.Debate_Content_HTML == body
    assert debate_of(spark, debate(body), paragraph_mode=True).Debate_Content_Text == "a\nb\n\nc\nd"
    assert debate_of(spark, debate("<p>hello world</p>"), limit=6).Debate_Content_Text == "hello..."
    assert debate_of(spark, debate(body), full_html=False).Debate_Content_HTML == ""


def test_debate_errors(spark):
    rows = [("a", None, "timed out", None, None), ("b", 404, None, "<p>", None)]
    got = {r.URL: r.Extracted_Title for r in extract.debates(spark.createDataFrame(rows, schemas.FETCH)).collect()}
    assert got == {"a": "Error: timed out", "b": "Error: HTTP 404"}


def document_of(spark, html, **options):
    return extract.documents(spark.createDataFrame([("u", 200, None, html, None)], schemas.FETCH), **options).first()


def test_document(spark):
    html = (
        '<div class="field-ds-doc-title"><h1>Remarks at the Democratic Convention</h1></div><h1>no</h1><span property="dc:date" content="">September 5, 2024</span>'
        '<div class="field-title"><a>Who</a></div><div class="diet-by-line">President</div>'
        '<div class="field-docs-content"><script>var t="</p>";</script><nav><p>menu</p></nav><p>a <b>b</b></p><p> </p><p>c<br>d e</p><footer><p>end</p></footer></div>'
        '<iframe src="https://www.youtube.com/embed/1"></iframe>'
    )
    r = document_of(spark, html)
    assert tuple(r)[1:] == ("Remarks at the Democratic Convention", "2024-09-05T00:00:00", "ab\\n\\ncd e", "Who", "President", "Speech/Remarks", "Democratic", True, 3, "Success")
    r = document_of(spark, html, paragraph_sep="\n\n", inline_sep=" ")
    assert r.Document_Content == "a b\n\nc d e" and r.Word_Count == 5


def test_unclosed_paragraphs_nest_and_missing_content(spark):
    assert document_of(spark, '<div class="field-docs-content"><p>a<p>b</div>').Document_Content == "ab\\n\\nb"
    r = document_of(spark, "<p>x</p>")
    assert (r.Document_Content, r.Word_Count, r.Extraction_Status, r.Document_Type, r.Video_Available) == ("", 0, "Success", "Document", False)
    assert document_of(spark, '<div class="a embedded-video"></div>').Video_Available


def test_failed_fetches(spark):
    rows = [("a", None, "timed out", None, None), ("b", 500, None, "<h1>x</h1>", None), ("c", 200, None, "<h1>x</h1>", None)]
    got = {r.url: tuple(r)[1:] for r in extract.documents(spark.createDataFrame(rows, schemas.FETCH)).collect()}
    lost = ("", "", "", "", "", "", "", False, 0, "Network Error")
    assert got["a"] == got["b"] == lost and got["c"][-1] == "Success"


@pytest.mark.parametrize(
    "html,pages",
    [
        ('<ul class="pagination"><li class="pager-last"><a href="?page=7">last</a></li></ul>', 8),
        ('<ul class="pagination">' + "".join(f'<li><a href="?page={i}">{i}</a></li>' for i in range(41)) + "</ul>", 25),
        ("", 1),
        (ROW.format(side="") * 999, 1),
        (ROW.format(side="") * 1000, 9),
    ],
)
def test_total_pages(spark, html, pages):
    df = spark.createDataFrame([(html,)], "html string")
    assert paging.total_pages(df, 25, probed=F.lit(9)).first()[0] == pages


def test_page_addresses_and_last_page(spark):
    assert [r.url for r in paging.page_urls(spark, "b?x=1", 3).orderBy("page").collect()] == ["b?x=1", "b?x=1&page=1", "b?x=1&page=2"]
    pages = spark.createDataFrame([(1, ROW.format(side="")), (2, ROW.format(side="")), (3, "")], "page int, html string")
    assert paging.last_valid_page(pages).first()[0] == 2
    assert paging.last_valid_page(pages.where("page = 3")).first()[0] == 1


def test_tree():
    root = parse('<p>a&amp;b<br/>c</div><ul><li>1<li>2</ul><!-- no --><style>s</style>')
    assert root.text("|") == "a&b|c|1|2"
    assert [n.tag for n in root.walk()] == ["p", "br", "ul", "li", "li", "style"]


def test_one_python_pass_above_the_anti_join(spark):
    from foliospark.operators import enrich

    links = spark.range(4).selectExpr("cast(id as string) as url")
    done = spark.createDataFrame([("1", "Success")], "url string, Extraction_Status string")
    fetches = spark.range(4).selectExpr("cast(id as string) as url", "200 as status", "cast(null as string) as error", "'<h1>x</h1>' as html", "cast(null as timestamp) as fetched_at")
    out = extract.documents(fetch.attach(enrich.remaining(links, done), fetches)).where("Word_Count >= 0 and Document_Title = 'x'")
    assert out.count() == 3
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ArrowEvalPython") == 1


BAD = "<![foo[bar]]><p>x"


def test_a_page_that_the_tokenizer_rejects_costs_no_other_page(spark):
    row = '<div class="row"><div class="col-sm-8"><div class="field-title"><a href="/x">t</a></div></div></div>'
    table = spark.createDataFrame([(1, BAD + row), (2, row), (3, None)], "page int, html string").coalesce(1)
    assert sorted(r.Page for r in listing.documents(table, "https://s").collect()) == [1, 2]
    good = "<h1>Remarks</h1>"
    pages_ = spark.createDataFrame([("a", 200, None, BAD + good, None), ("b", 200, None, good, None)], schemas.FETCH).coalesce(1)
    assert {(r.url, r.Document_Title) for r in extract.documents(pages_).collect()} == {("a", "Remarks"), ("b", "Remarks")}
    assert len(extract.debates(pages_).collect()) == 2
    assert sorted(r.total_pages for r in paging.total_pages(table, 9).collect()) == [1, 1, 1]
    assert sorted(table.select(pages.anchors("html").alias("a")).collect()) == [([],), (["/x"],), (["/x"],)]


def test_labelled_blocks_from_the_tree(spark):
    def items(html):
        return debate_of(spark, debate(html)).Participants_List

    assert items("<p><b>Participants:</b> a<b><i>x</i></b>;&#8217;t &mdash; b<br>c &amp; d</p>") == ["a x", "’t — b", "c & d"]
    assert items("<p><b class='k'>Participants:</b> A</p>") == ["Participants:  A"]
    assert items("<p><i><b>Participants:</b></i> A<i>b<br>c</i></p>") == ["Participants:  A b", "c"]
    assert items("<p> <b> participants : </b>A</p>") == ["A"]


def test_discovery(spark):
    full = "".join('<div class="row"><div class="col-sm-8"><div class="field-title">t</div></div></div>' for _ in range(1000))
    table = spark.createDataFrame([(1, full), (2, full), (3, full), (4, "<p>none")], "page int, html string")
    assert paging.discover(table, 25).first().total_pages == 3
    assert paging.discover(table, 2).first().total_pages == 2
    assert paging.discover(table.where("page = 4"), 25).first().total_pages == 1
    assert paging.discover(table.where("page > 4"), 25).first().total_pages == 1


def test_deep_pages_in_linear_time():
    import resource
    import time

    def took(work):
        before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
        out = work()
        assert time.process_time() - began < 5 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
        return out

    def own():
        root = parse('<div class="c">' + "".join(f"<p>paragraph {i}, not closed" for i in range(20_000)))
        return root.page.paragraphs(root.first(cls="c").k, pages.BOILERPLATE, nested=False)

    assert took(own) == [f"paragraph {i}, not closed" for i in range(20_000)]
    root = took(lambda: parse('<div class="c">' + "<p>x" * 20_000))
    inside = took(lambda: root.page.paragraphs(root.first(cls="c").k, pages.BOILERPLATE))
    assert [len(p) for p in inside] == list(range(20_000, 0, -1))
    rows = '<div class="row"><div class="col-sm-8"><div class="field-title"><a href="/x">t</a></div>' * 20_000
    got = took(lambda: [pages._listing_row(r, SITE) for r in parse(rows).all("div", "row")])
    assert len(got) == 20_000 and all(g["link"] == SITE + "/x" for g in got)
    assert took(lambda: len(parse("<p>x</i></div>" * 20_000).strings())) == 20_000
    assert took(lambda: len(pages._labels(parse("<p><b>Participants:</b> x;" * 20_000), ("participants",)))) == 1


def test_own_text_of_nested_paragraphs_and_rows(spark):
    html = '<div class="field-docs-content"><p>a<p>b<nav><p>menu</p>gone</nav><p>c</p>d<template>t</template></p>e</div>'
    assert document_of(spark, html, nested=False).Document_Content.split("\\n\\n") == ["ae", "bd", "c"]
    nested = f'<div class="row">{ROW.format(side="")}</div>'
    table = spark.createDataFrame([(1, nested)], "page int, html string")
    assert listing.documents(table, SITE).count() == 2 and listing.documents(table, SITE, nested=False).count() == 1


def test_players_in_dropped_parts_do_not_count(spark):
    player = '<iframe src="https://www.youtube.com/embed/1"></iframe>'
    assert not document_of(spark, f'<div class="field-docs-content"><header>{player}</header></div>').Video_Available
    assert document_of(spark, f'<div class="field-docs-content">{player}</div>').Video_Available
    assert document_of(spark, f'<header>{player}</header><div class="field-docs-content"></div>').Video_Available


def test_only_the_asked_fields(spark):
    from foliospark.operators.extract import NEEDS

    html = '<div class="a">x</div><h1>Remarks in <b>Las</b> Vegas</h1><h1>two</h1><div class="field-docs-content"><p>a b<p>c</div>'
    late = html + '<div class="field-ds-doc-title"><h1>The title</h1></div>'
    rows = spark.createDataFrame([(str(i), 200, None, h, None) for i, h in enumerate((html, late, "", None, "<h1>open", "<h2>none"))], schemas.FETCH)
    whole = extract.documents(rows)
    for fields in (["Document_Title"], ["Location", "Extraction_Status"], ["Word_Count"], ["Video_Available", "Speaker"], [], list(NEEDS)):
        got = extract.documents(rows, fields=fields)
        assert got.columns == ["url", *(c for c in NEEDS if c in fields)]
        assert sorted(got.collect()) == sorted(whole.select(*got.columns).collect())
    with pytest.raises(ValueError, match="unknown"):
        extract.documents(rows, fields=["Nothing"])
    plan = extract.documents(rows, fields=["Word_Count"])._jdf.queryExecution().analyzed().schema().json()
    assert "Speaker" not in plan


def test_a_page_that_takes_too_long_fails_alone():
    import pandas as pd

    def one(page):
        while page == "endless":
            pass
        return page

    got = pages._each(pd.Series(["a", "endless", "b", "endless", "c"]), one, 0.2, lambda: "failed")
    assert got == ["a", "failed", "b", "failed", "c"]
    assert pages._each(pd.Series([str(i) for i in range(20_000)]), one, 5, lambda: "failed") == [str(i) for i in range(20_000)]


def test_parsing_error_of_a_slow_page(spark):
    slow = '<div class="field-docs-content">' + "<p>x" * 60_000
    rows = [("a", 200, None, "<h1>x</h1>", None), ("b", 200, None, slow, None), ("c", 200, None, "<h1>y</h1>", None)]
    got = extract.documents(spark.createDataFrame(rows, schemas.FETCH).coalesce(1), seconds=0.3).select("url", "Extraction_Status", "Document_Title").collect()
    assert sorted(map(tuple, got)) == [("a", "Success", "x"), ("b", "Parsing Error", ""), ("c", "Success", "y")]


def test_pages_are_dealt_out_before_parsing(spark, tmp_path):
    from foliospark.operators.deal import dealt

    table = spark.range(2500).selectExpr("id as page_id", "concat('u', id) as url", "concat('<article><p>', repeat(sha2(cast(id as string), 512), 30), '</article>') as html")
    table.coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    records = extract.documents(fetch.from_pages(one), container="article").withColumn("task", F.spark_partition_id())
    assert [r["count"] for r in records.groupBy("task").count().collect()] == [2500 // cores] * cores
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan(listing.documents(one.withColumnRenamed("page_id", "page"), SITE))
    # what has a split for each core, or is dealt by a join, or tiny, stays
    table.repartition(2 * cores).write.parquet(str(tmp_path / "many"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert "Repartition" not in plan(dealt(spark.read.parquet(str(tmp_path / "many"))))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert "Repartition" not in plan(dealt(one.join(one.select("url").distinct(), "url")))
    assert "Repartition" not in plan(dealt(spark.createDataFrame([("u", "h")], "url string, html string")))
    assert dealt(one, tasks=5).rdd.getNumPartitions() == 5


def test_streams_are_not_dealt(spark, tmp_path):
    spark.createDataFrame([("u", "<h1>x</h1>")], "url string, html string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, html string").parquet(str(tmp_path / "in"))
    records = extract.documents(fetch.from_pages(stream), fields=["Document_Title"])
    query = records.writeStream.format("memory").queryName("titles").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("titles").collect()] == [("u", "x")]


def test_plain_markup_gives_the_tree_of_the_tokenizer():
    bits = (
        ["<p>", "</p>", '<b class="x &amp; y">', "</b>", "<br>", "<br/>", "<i/>", "text", "a &amp b", " &lt; ", "&#39", "<script>", "</script>", '<script src="a">x<y</p></script>', "<title>t &amp; u</title>", "<title>a<b>"]
        + ["</title>", "<!-- c -->", "<!-->", "<!--->x-->", "<!-- a --!> b -->", "<!doctype html>", "<![if x]>", '<a href="/x?a=1&copy=3">', "</a>", '<A HREF="Q" b>', "<img src=q>", " < ", "</ p>", "<h1>", "</h1>"]
        + ["<template>", "</template>", '<iframe src="//v"></iframe>', "<iframe>x</iframe>", '<p\n a="1"\tb>', '<a a="1" a="2">', '<p a="1"b="2">', "<plaintext>", "<x-y>", "<title/>", "<script/>"]
    )
    r, plain = random.Random(1), 0
    names = [c for c in html.Page.__slots__ if not c.startswith("_")]
    for _ in range(20_000):
        source, until = "".join(r.choices(bits, k=r.randint(1, 9))), r.choice([None, "h1", "p"])
        if (page := html._plain(source, until)) is not None:
            plain, other = plain + 1, html._tolerant(source, until)
            assert all(getattr(page, c) == getattr(other, c) for c in names), source
    assert plain > 2_000


def test_unclosed_references():
    source = '<a href="?x=1&amp;y&copy=2">a &amp b &lt;c&gt; &bogus; &#39;d&#39 &amp;amp &quo</a><![x]>&amp'
    assert parse(source).text() == "a & b <c> &bogus; 'd' &amp &quo&"
    root = parse(source, unclosed=False)
    assert root.text() == "a &amp b <c> &bogus; 'd&#39 &amp &quo&amp"
    assert root.first("a").attrs == {"href": "?x=1&y&copy=2"}


@pytest.mark.parametrize("nested", [True, False])
@pytest.mark.parametrize("sep", ["", " ", " | ", "-"])
def test_words_are_counted_without_texts(spark, sep, nested):
    source = '<div class="c"><p>a b <b>c</b>d<p>e f<script>x y</script><nav>n n</nav> g<br>h</p><p></p> z<template>u<p>v w</p></template></div><p>out</p>'
    box = parse(source).first(cls="c")
    texts = box.page.paragraphs(box.k, pages.BOILERPLATE, sep, nested)
    assert box.page.words(box.k, pages.BOILERPLATE, sep, nested) == sum(len(t.split()) for t in texts) > 5
    rows = spark.createDataFrame([(str(i), 200, None, source * (i % 3), None) for i in range(300)], schemas.FETCH).coalesce(1)
    options = {"container": ".c", "inline_sep": sep, "nested": nested}
    counted = extract.documents(rows, fields=["Word_Count"], **options)
    assert "paragraphs" not in counted._jdf.queryExecution().optimizedPlan().toString()
    whole = extract.documents(rows, **options)
    for r in whole.collect():
        assert r.Word_Count == sum(len(t.split()) for t in r.Document_Content.split(r"\n\n"))
    assert sorted(counted.collect()) == sorted(whole.select("url", "Word_Count").collect())


def test_plain_links_are_joined_as_others():
    from urllib.parse import urljoin

    for site in (SITE, "https://site.example/a/b", "http://h:80"):
        for href in ("/a/b-c", "/a//b", "/a/../b", "//h/x", "/", "", "/a?b", "x", "/a/", "/a;b", "/é"):
            assert pages._joined(site, href) == urljoin(site, href)
