"""Extraction of pages as they land: the stream's checkpoint is the progress record."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliospark import schemas
from foliospark.operators import extract
from foliospark.sources import state

_EPOCH = datetime(1970, 1, 1)


def later_fetches(fetches: DataFrame, delay: str = "7 days") -> DataFrame:
    """Of a stream of fetches those that are later than all of their url so far: of a batch's fetches of a url the last, a
    success before an error of the same time, and none if a later one has gone through before. What has been seen of a url
    is forgotten when the watermark, ``delay`` behind the latest fetch, has passed its time; older fetches are left out. A
    fetch without a time is older than any that has one."""
    timed = fetches.withColumn("fetched_at", F.coalesce("fetched_at", F.lit(_EPOCH).cast("timestamp"))).withWatermark("fetched_at", delay)

    def latest(key: tuple, batches: Iterator, seen: GroupState) -> Iterator:
        if seen.hasTimedOut:
            seen.remove()
            return
        best, row = tuple(seen.get) if seen.exists else (-1, False), None
        for batch in batches:
            for k, (at, good) in enumerate(zip(batch["fetched_at"].astype("int64") // 1000, batch["error"].isna() & (batch["status"].fillna(500) < 400), strict=True)):
                if (int(at), bool(good)) > best:
                    best, row = (int(at), bool(good)), batch.iloc[[k]]
        if row is not None:
            seen.update(best)
            if best[0] // 1000 > seen.getCurrentWatermarkMs():
                seen.setTimeoutTimestamp(best[0] // 1000)
            yield row

    return timed.groupBy("url").applyInPandasWithState(latest, schemas.FETCH, "at long, good boolean", "append", GroupStateTimeout.EventTimeTimeout)


def extract_landed(spark: SparkSession, landing: str, path: str, checkpoint: str, delay: str = "7 days", **options) -> StreamingQuery:
    """Every fetch file that landed since the last run is extracted and added to the state; of a url the later fetch wins,
    within a batch and between batches. Buckets of many files are compacted on the way."""

    def add(batch: DataFrame, _: int) -> None:
        state.append(extract.documents(batch, **options).withColumn("processed_at", F.current_timestamp()), path)
        state.compact(spark, path)

    stream = spark.readStream.schema(schemas.FETCH).parquet(landing)
    return later_fetches(stream, delay).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
