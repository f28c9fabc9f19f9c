"""Descriptive statistics. Ratios with nothing below the line are null."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double") * 100.0, b.cast("double"))


def counts_by_key(df: DataFrame, key: str) -> DataFrame:
    """Rows per non-null value, by value."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("cnt")).orderBy(key)


def counts_sorted(df: DataFrame, key: str) -> DataFrame:
    """Rows per non-null value, most first, ties by value."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), key)


def top_counts(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    return counts_sorted(df, key).limit(n)


def last_key_counts(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n greatest values and their counts, shown ascending."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("cnt")).orderBy(F.desc(key)).limit(n).orderBy(key)


def listing_report(listing: DataFrame, key: str = "Page", date: str = "Date", category: str = "Related_Category", capacity: int = 25_000, seconds: float | None = None) -> DataFrame:
    """Rows, pages, categories, coverage of ``capacity``, rows per page and the date range as strings sort; and rows per
    second, if it is told how long the listing took (``metrics.Run`` counts while it is written)."""
    speed = [] if seconds is None else [ratio(F.count("*"), F.lit(seconds)).alias("rows_per_second")]
    return listing.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct(key).alias("n_pages"),
        F.countDistinct(category).alias("n_categories"),
        F.min(date).alias("min_date"),
        F.max(date).alias("max_date"),
        percent(F.count("*"), F.lit(capacity)).alias("coverage_pct"),
        ratio(F.count("*"), F.countDistinct(key)).alias("rows_per_page"),
        *speed,
    )


def extraction_summary(enriched: DataFrame) -> DataFrame:
    """One row: documents, successes, speakers, words, videos and their ratios."""
    good = F.count_if(F.col("Extraction_Status") == "Success")
    return enriched.agg(
        F.count("*").alias("n_rows"),
        good.alias("n_success"),
        F.countDistinct("Speaker").alias("n_speakers"),
        F.sum("Word_Count").alias("total_words"),
        F.sum(F.col("Video_Available").cast("int")).alias("n_video"),
        percent(good, F.count("*")).alias("success_pct"),
        ratio(F.sum("Word_Count"), good).alias("words_per_success"),
    )


def listing_sorted(listing: DataFrame, n: int | None = None) -> DataFrame:
    """By page, then date descending as a string, then title and link; optionally the first n."""
    out = listing.orderBy("Page", F.desc("Date"), "Title", "Document_Link")
    return out if n is None else out.limit(n)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"))


def memory(df: DataFrame) -> DataFrame:
    """Bytes of all values: strings and binaries by their length, other plain columns by their width; nulls of a string are
    nothing, and nested columns count as their JSON."""
    width = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "date": 4, "float": 4}

    def size(f) -> Column:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(f.name), F.lit(0))
        return F.coalesce(F.octet_length(F.to_json(f.name)), F.lit(0)) if kind in ("array", "struct", "map") else F.lit(width.get(kind, 8))

    return df.agg(F.sum(sum((size(f) for f in df.schema), F.lit(0)).cast("bigint")).alias("n_bytes"))
