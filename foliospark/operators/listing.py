"""Listing pages to metadata rows. Few large files of pages are dealt out before they are parsed."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import dates, text
from foliospark.operators.deal import dealt
from foliospark.operators.pages import SECONDS, listing_rows


def documents(pages: DataFrame, site: str, html: str = "html", page: str = "page", nested: bool = True, seconds: float | None = SECONDS) -> DataFrame:
    """Rows of document listing pages. ``page`` is the 1-based page number. A page without markup gives no rows.

    An enclosing layout row repeats its first entry, as every ``div.row`` counts; with ``nested=False`` it gives none.
    """
    some = dealt(pages.where(F.col(html).isNotNull()).select(F.col(page).cast("int").alias("Page"), F.col(html).alias("html")))
    p = some.select("Page", F.explode(listing_rows(F.col("html"), site, nested, seconds)).alias("r"))
    r = F.col("r")
    date = F.when(r.has_date, F.when(F.coalesce(r.date_content, F.lit("")) != "", dates.format_date(r.date_content)).otherwise(r.date_text))
    return p.where(r.has_main & r.has_title).select(
        date.otherwise(F.coalesce(r.heading, F.lit("No Date"))).alias("Date"),
        F.when(r.has_link, r.title_text).otherwise(r.block_text).alias("Title"),
        F.when(r.has_link, r.link).otherwise("No Link").alias("Document_Link"),
        F.when(r.has_related, r.related_text).otherwise("No Category").alias("Related_Category"),
        F.when(r.has_related, r.related_link).otherwise("No Link").alias("Related_Link"),
        "Page",
        (F.col("Page") - 1).alias("URL_Page_Index"),
    )


def debates(pages: DataFrame, site: str, html: str = "html", nested: bool = True, seconds: float | None = SECONDS) -> DataFrame:
    """Rows of debate listing pages; both columns are needed and absent values are ''."""
    some = dealt(pages.where(F.col(html).isNotNull()).select(F.col(html).alias("html")))
    p = some.select(F.explode(listing_rows(F.col("html"), site, nested, seconds)).alias("r"))
    r = F.col("r")
    none = F.lit("")
    related = (r.label == "Related") & r.has_related
    return p.where(r.has_main & r.has_side).select(
        F.when(r.has_date, dates.format_iso(r.date_content, r.date_text)).otherwise(none).alias("Date"),
        F.when(r.has_link, r.title_text).otherwise(none).alias("Title"),
        F.when(r.has_link, text.absolute_url(r.href, site)).otherwise(none).alias("Debate_Link"),
        F.when(related, r.related_text).otherwise(none).alias("Related_Category"),
        F.when(related, text.absolute_url(r.related_href, site)).otherwise(none).alias("Related_Link"),
    )
