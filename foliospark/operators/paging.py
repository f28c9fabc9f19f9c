"""Page addresses and the number of pages."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.deal import dealt
from foliospark.operators.pages import paging_links


def page_urls(spark: SparkSession, base: str, pages: int) -> DataFrame:
    """(page, page_index, url); the first page is the bare address."""
    return spark.range(1, pages + 1).select(F.col("id").cast("int").alias("page"), (F.col("id") - 1).cast("int").alias("page_index")).select(
        "page", "page_index", page_url(F.lit(base), F.col("page_index")).alias("url")
    )


def page_url(base: Column, index: Column) -> Column:
    return F.when(index == 0, base).otherwise(F.concat(base, F.lit("&page="), index.cast("string")))


def page_number(href: Column) -> Column:
    """The index after 'page=', null if none."""
    return F.nullif(F.regexp_extract(href, r"page=(\d+)", 1), F.lit("")).cast("int")


def total_pages(first_page: DataFrame, max_pages: int, html: str = "html", probed: Column | None = None) -> DataFrame:
    """How many pages a listing has, from its first page: the 'last' link, else the highest numbered link, else the
    row count (under 1000 rows: one page), else ``probed``. Always between 1 and ``max_pages`` where links tell."""
    p = first_page.select(paging_links(F.col(html)).alias("p")).select("p.*")
    last = page_number(F.col("last_href"))
    numbered = F.array_max(F.transform("hrefs", page_number))
    full = F.coalesce(probed, F.lit(1)) if probed is not None else F.lit(1)
    linked = F.coalesce(last, numbered)
    return p.select(
        F.coalesce(F.when(linked.isNotNull(), F.least(linked + 1, F.lit(max_pages))), F.when(F.col("document_rows") >= 1000, full), F.lit(1))
        .cast("int")
        .alias("total_pages")
    )


def discover(pages: DataFrame, max_pages: int, html: str = "html", page: str = "page") -> DataFrame:
    """(total_pages) of a listing from its recorded pages: what its first page tells, and where that is a full page without
    links, the last page with rows, no later than ``max_pages`` (``probe`` finds it in a live listing). One page if the first
    is missing or cannot be read."""
    probed = last_valid_page(pages.where(F.col(page) <= max_pages), html, page).scalar()
    told = total_pages(pages.where(F.col(page) == 1), max_pages, html, probed)
    return told.agg(F.coalesce(F.max("total_pages"), F.lit(1)).cast("int").alias("total_pages"))


def probe(spark: SparkSession, base: str, max_pages: int, **options) -> int:
    """The last page of a live listing that has a document row, by bisection: about log2(max_pages) pages are fetched, one
    after the other. Pages with rows must come before pages without; a hole ends the listing if a probe meets it. A page
    that cannot be fetched counts as one without rows, and the first page as one with rows."""
    from foliospark.sources import fetch

    low, high = 1, max_pages + 1
    while high - low > 1:
        middle = (low + high) // 2
        link = spark.range(1).select(page_url(F.lit(base), F.lit(middle - 1)).alias("url"))
        page = fetch.fetch(link, tasks=1, **options).select(paging_links(F.col("html")).alias("p"))
        low, high = (middle, high) if page.first().p.document_rows >= 1 else (low, middle)
    return low


def last_valid_page(pages: DataFrame, html: str = "html", page: str = "page") -> DataFrame:
    """The highest recorded page with a document row, at least 1; stands for probing, validity being monotone."""
    rows = dealt(pages.select(F.col(page).alias("page"), F.col(html).alias("html"))).select("page", paging_links(F.col("html")).alias("p"))
    return rows.where("p.document_rows >= 1").agg(F.coalesce(F.max("page"), F.lit(1)).cast("int").alias("last_page"))
