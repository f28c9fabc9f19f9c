"""Detail pages to typed records."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark import schemas
from foliospark.functions import classify, dates, text
from foliospark.operators.pages import SECONDS, debate_detail, document_detail, label_items

# How the labelled paragraphs of a debate begin.
LABELS = ("participants", "moderators")
SUCCESS, NETWORK_ERROR, PARSING_ERROR = "Success", "Network Error", "Parsing Error"


def fetch_failed(error: str = "error", status: str = "status") -> Column:
    return F.col(error).isNotNull() | F.coalesce(F.col(status) >= 400, F.lit(True))


#: What of a page each column of the record is read from.
NEEDS = {
    "Document_Title": ("title",), "Document_Date": ("date",), "Document_Content": ("paragraphs",), "Speaker": ("speaker",), "Speaker_Title": ("speaker_title",),
    "Document_Type": ("title",), "Location": ("title",), "Video_Available": ("video",), "Word_Count": ("words",), "Extraction_Status": (),
}


def documents(
    fetches: DataFrame,
    container: str = ".field-docs-content",
    paragraph_sep: str = r"\n\n",
    inline_sep: str = "",
    multiword_location: bool = False,
    fields: Iterable[str] | None = None,
    nested: bool = True,
    seconds: float | None = SECONDS,
    unclosed: bool = True,
) -> DataFrame:
    """(url, status, error, html) to the document record. A failed fetch or parse gives the defaults and its status; so does
    a page that takes longer than ``seconds``. ``fields``: the columns wanted, of which nothing else is computed.
    ``nested=False``: a paragraph does not repeat those that it contains. ``unclosed=False``: references without their
    semicolon stay as they are written."""
    wanted = list(NEEDS) if fields is None else [c for c in NEEDS if c in set(fields)]
    if unknown := set(fields or ()) - NEEDS.keys():
        raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
    asked = {f for c in wanted for f in NEEDS[c]}
    detail = document_detail(F.when(~fetch_failed(), F.col("html")), container, inline_sep, asked, nested, seconds, unclosed)
    raw = fetches.select("url", fetch_failed().alias("lost"), detail.alias("d"))
    d, none = F.col("d"), F.lit("")
    bad = F.col("lost") | d.failed
    title = F.coalesce(d.title, none)
    value = {
        "Document_Title": lambda: (title, none),
        "Document_Date": lambda: (dates.normalize_date(d.date), none),
        "Document_Content": lambda: (text.paragraphs_text(d.paragraphs, paragraph_sep), none),
        "Speaker": lambda: (d.speaker, none),
        "Speaker_Title": lambda: (d.speaker_title, none),
        "Document_Type": lambda: (classify.document_type(title), none),
        "Location": lambda: (classify.location(title, multiword_location), none),
        "Video_Available": lambda: (d.video, F.lit(False)),
        "Word_Count": lambda: (d.words, F.lit(0).cast("bigint")),
    }

    def column(name: str) -> Column:
        if name == "Extraction_Status":
            return F.when(F.col("lost"), NETWORK_ERROR).when(d.failed, PARSING_ERROR).otherwise(SUCCESS).alias(name)
        good, default = value[name]()
        return F.when(bad, default).otherwise(F.coalesce(good, default)).alias(name)

    return raw.select("url", *map(column, wanted))


def debates(
    fetches: DataFrame,
    main: str = "div.col-sm-8",
    container: str = "div.field-docs-content",
    full_html: bool = True,
    limit: int | None = None,
    paragraph_mode: bool = False,
    seconds: float | None = SECONDS,
    unclosed: bool = True,
) -> DataFrame:
    """(url, status, error, html) to the debate record; a failed fetch puts 'Error: ...' in the title. ``unclosed``: as for
    documents."""
    participants, moderators = LABELS
    raw = fetches.select("url", "error", "status", fetch_failed().alias("lost"), debate_detail(F.when(~fetch_failed(), F.col("html")), main, container, LABELS, seconds, unclosed).alias("d"))
    d, none = F.col("d"), F.lit("")

    def items(label: str) -> Column:
        blocks = F.transform(F.filter(d.labels, lambda b: b.label.startswith(label)), lambda b: label_items(b, label))
        return F.coalesce(F.try_element_at(F.filter(blocks, lambda i: F.size(i) > 0), F.lit(1)), F.array().cast("array<string>"))

    joined = F.array_join(d.blocks, "\n\n") if paragraph_mode else F.array_join(d.strings, "\n")
    return (
        raw.withColumns({"p": items(participants), "m": items(moderators)})
        .select(
            F.col("url").alias("URL"),
            F.when(F.col("lost"), F.concat(F.lit("Error: "), F.coalesce("error", F.concat(F.lit("HTTP "), F.col("status").cast("string")), F.lit("no page")))).when(d.failed, "Error: the page cannot be parsed").otherwise(F.coalesce(d.title, none)).alias("Extracted_Title"),
            F.coalesce(d.date, none).alias("Extracted_Date"),
            F.col("p").alias("Participants_List"),
            text.join_items(F.col("p")).alias("Participants"),
            F.col("m").alias("Moderators_List"),
            text.join_items(F.col("m")).alias("Moderators"),
            F.coalesce(text.truncate(text.clean_whitespace(joined), limit), none).alias("Debate_Content_Text"),
            (F.coalesce(d.inner_html, none) if full_html else none).alias("Debate_Content_HTML"),
        )
        .select(*schemas.DEBATE_DETAIL.names)
    )
