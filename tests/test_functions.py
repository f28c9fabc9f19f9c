"""Text, date and title functions on hand-worked values, and their properties."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foliospark.functions import classify, dates, text
from foliospark.operators import pages, stats


def run(spark, value, *functions):
    df = spark.createDataFrame([(value,)], "x string")
    return tuple(df.select(*(f(F.col("x")) for f in functions)).first())


@pytest.mark.parametrize(
    "value,long,iso",
    [
        ("2024-09-29T00:00:00+00:00", "September 29, 2024", "2024-09-29T00:00:00+00:00"),
        ("2024-09-29T00:00:00Z", "September 29, 2024", "2024-09-29T00:00:00Z"),
        ("2024-09-29T23:30:00-05:00", "September 29, 2024", "2024-09-29T23:30:00-05:00"),
        ("2024-09-29", "September 29, 2024", "2024-09-29T00:00:00"),
        ("October 1, 2024", "October 1, 2024", "2024-10-01T00:00:00"),
        ("9/5/2024", "9/5/2024", "2024-09-05T00:00:00"),
        ("5 September 2024", "5 September 2024", "2024-09-05T00:00:00"),
        ("september 31, 2024", "september 31, 2024", "september 31, 2024"),
        ("  Fall 2024 ", "Fall 2024", "  Fall 2024 "),
        ("", None, ""),
        (None, None, ""),
    ],
)
def test_dates(spark, value, long, iso):
    assert run(spark, value, dates.format_date, dates.normalize_date) == (long, iso)


def test_typed_dates(spark):
    assert run(spark, "October 1, 2024", dates.year_of) == (2024,) and run(spark, "x", dates.year_of) == (None,)
    with pytest.raises(PySparkException):
        run(spark, "x", dates.to_date_strict)


@pytest.mark.parametrize(
    "title,kind,place,full",
    [
        ("Vice Presidential Debate in New York City", "Debate", "New", "New York City"),
        ("Speech at the Democratic Convention", "Speech/Remarks", "Democratic", "Democratic Convention"),
        ("Interview with Martin Luther", "Interview", "Luther", "Luther"),
        ("Statement on Remarks by X", "Speech/Remarks", "", ""),
        ("Inaugural Addresses", "Address", "", ""),
        ("Press Release", "Document", "", ""),
        (None, "Document", "", ""),
    ],
)
def test_titles(spark, title, kind, place, full):
    assert run(spark, title, classify.document_type, classify.location, lambda c: classify.location(c, True)) == (kind, place, full)


def test_text(spark):
    assert run(spark, "\r\n\n  a  b \n\n\n\n c\r\n\n", text.clean_whitespace) == ("a  b\n\nc",)
    assert run(spark, "ab cd", lambda c: text.truncate(c, 3), lambda c: text.truncate(c, 0), lambda c: text.truncate(c, 5)) == ("ab...", "ab cd", "ab cd")
    assert run(spark, " a b　c \n", text.word_count) == (3,) and run(spark, None, text.word_count) == (0,)
    assert run(spark, "<b>Moderators:</b> .;x", lambda c: pages.label_block(c, "moderators")) == (["", "x"],)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(" \t\r\n;.a<b>é", max_size=40))
def test_cleaning_twice_is_cleaning_once_and_items_have_no_semicolon(spark, value):
    once, twice, items = run(spark, value, text.clean_whitespace, lambda c: text.clean_whitespace(text.clean_whitespace(c)), lambda c: pages.label_block(c, "x"))
    assert once == twice and all(";" not in i for i in items)


def test_ratios_without_rows(spark):
    none = spark.createDataFrame([], "Page int, Date string, Related_Category string")
    r = stats.listing_report(none).first()
    assert (r.n_rows, r.rows_per_page, r.coverage_pct) == (0, None, 0.0)
