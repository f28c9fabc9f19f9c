"""Resumable enrichment of a metadata table: what is done is a table, and what remains is an anti join."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark import schemas
from foliospark.operators.extract import SUCCESS


def require(df: DataFrame, column: str) -> DataFrame:
    if column not in df.columns:
        raise AnalysisException(f"column {column} is missing; there are {', '.join(df.columns)}")
    return df


def distinct_links(listing: DataFrame, key: str = "Document_Link") -> DataFrame:
    return require(listing, key).where(F.col(key).isNotNull()).select(F.col(key).alias("url")).distinct()


def remaining(links: DataFrame, extracted: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Links not processed yet; ``retry_errors`` takes those again whose extraction failed."""
    done = extracted.where(F.col("Extraction_Status") == SUCCESS) if retry_errors else extracted
    return links.join(done.select("url"), "url", "left_anti")


def latest(records: DataFrame, key: str | tuple[str, ...], *order: str) -> DataFrame:
    """One row per key, the last in ``order``; rows that tie there are equal in all that counts."""
    w = Window.partitionBy(*((key,) if isinstance(key, str) else key)).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(extracted: DataFrame, new: DataFrame) -> DataFrame:
    """The later record of each url wins."""
    return latest(extracted.unionByName(new), "url", "processed_at", "Extraction_Status", "Document_Title")


def lookup(listing: DataFrame, extracted: DataFrame, key: str = "Document_Link") -> DataFrame:
    """The listing with the record's columns. Without a record: '' in strings, null in numbers and booleans."""
    fields = schemas.DOCUMENT_DETAIL
    right = extracted.select(F.col("url").alias("_url"), *fields.names)
    joined = listing.drop(*fields.names).join(right, F.col(key) == F.col("_url"), "left")
    filled = [F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in fields]
    return joined.select(*(F.col(c) for c in listing.columns if c not in fields.names), *filled)
