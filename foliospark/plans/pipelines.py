"""The end-to-end runs."""

from __future__ import annotations

import threading
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark import schemas
from foliospark.operators import enrich, extract, listing, stats
from foliospark.operators.metrics import Run
from foliospark.sources import fetch, published, state


_SLICED = T.StructType([*schemas.FETCH.fields, T.StructField("slice", T.IntegerType())])


def document_listing(pages: DataFrame, site: str) -> tuple[DataFrame, DataFrame]:
    """Listing rows and their report."""
    rows = listing.documents(pages, site)
    return rows, stats.listing_report(rows)


def publish_listing(pages: DataFrame, site: str, folder: str, stem: str = "documents") -> tuple[str, dict]:
    """Write the sorted listing to one CSV file, named by its rows and the time, and count on the way: the file's path and
    the run's figures."""
    run = Run()
    path = published.write_csv(run.counting(stats.listing_sorted(listing.documents(pages, site)), first=F.min("Date"), last=F.max("Date")), folder, stem)
    return path, run.figures()


def debate_listing(pages: DataFrame, site: str) -> DataFrame:
    return listing.debates(pages, site)


def enrich_documents(
    spark: SparkSession, listing_df: DataFrame, fetches: DataFrame, path: str, retry_errors: bool = False, slices: int = 4,
    slice_seconds: float | None = None, told: Callable[[dict], None] | None = None, **options,
) -> DataFrame:
    """Extract what the state at ``path`` lacks and return the listing with all records. The links and their pages are
    written once, by slices of the state's buckets; each slice is merged when it is done, so that a run that fails keeps
    what it has finished. A slice that takes longer than ``slice_seconds`` is given up with a warning and left to the next
    run. ``told`` gets the figures of each slice: documents, successes, failures, seconds, documents a second."""
    state.quarantine(spark, path)
    todo = enrich.remaining(enrich.distinct_links(listing_df), state.read(spark, path), retry_errors)
    aside = f"{path}/_todo-{uuid.uuid4().hex}"
    fetch.attach(todo, fetches).withColumn("slice", state.bucket(F.col("url"), state.BUCKETS) % slices).write.partitionBy("slice").parquet(aside)
    try:
        waiting = spark.read.schema(_SLICED).parquet(aside)
        for i in range(slices):
            run = Run(good=F.col("Extraction_Status") == extract.SUCCESS)
            records = extract.documents(waiting.where(F.col("slice") == i), **options).withColumn("processed_at", F.current_timestamp())
            if not in_time(spark, slice_seconds, lambda rows=run.counting(records): state.upsert(rows, path)):
                warnings.warn(f"slice {i} took more than {slice_seconds} seconds and is left to the next run", stacklevel=2)
            elif told is not None:
                told({"slice": i} | run.figures())
    finally:
        state._remove(spark, aside)
    return enrich.lookup(listing_df, state.read(spark, path))


def in_time(spark: SparkSession, seconds: float | None, work: Callable[[], object]) -> bool:
    """Whether the work's Spark jobs end in time; those under way are cancelled if not."""
    if seconds is None:
        work()
        return True
    context, group, late, ended = spark.sparkContext, f"slice-{uuid.uuid4().hex}", threading.Event(), threading.Event()
    before = [(name, context.getLocalProperty(name)) for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")]

    def stop() -> None:
        wait = seconds
        while not ended.wait(wait):  # again, as jobs may begin later
            late.set()
            context.cancelJobGroup(group)
            wait = 0.5

    context.setJobGroup(group, "a slice of an extraction", interruptOnCancel=True)
    threading.Thread(target=stop, daemon=True).start()
    try:
        work()
    except Exception:
        if not late.is_set():
            raise
        return False
    finally:
        ended.set()
        for name, value in before:
            context.setLocalProperty(name, value)
    return True


def debate_details(listing_df: DataFrame, fetches: DataFrame, **options) -> DataFrame:
    """One record per distinct link; links that were never fetched are error rows."""
    links = listing_df.select(F.col("Debate_Link").alias("url")).distinct()
    return extract.debates(fetch.attach(links, fetches), **options)
