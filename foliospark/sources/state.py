"""What has been extracted so far: one record a url, in hash buckets of the url.

A bucket is a folder, whose name tells its number and how many there are. ``upsert`` merges new records into the buckets
that they fall in and rewrites only those; ``append`` adds a file to them, which is cheap and right for streams; ``compact``
rewrites buckets of many files. Readers get the latest record of each url, and rank records only where a bucket holds more
than one file. New records are written once before they are merged, so that they are not computed again for it.

``quarantine`` moves files that cannot be read, or not to their end, out of the way and warns; what they held is extracted
again. A merge whose last step fails can lose the buckets that it was replacing, with the same result.
"""

from __future__ import annotations

import re
import uuid
import warnings
from collections import Counter
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark import schemas
from foliospark.operators.enrich import latest

BUCKETS = 64
#: ``compact`` rewrites buckets of more files.
FILES = 8
_ORDER = ("processed_at", "Extraction_Status", "Document_Title")
_SCHEMA = T.StructType([*schemas.EXTRACTED.fields, T.StructField("bucket", T.StringType())])
_NAME = re.compile(r"bucket=(\d+)-(\d+)/")


def bucket(url: Column, buckets: int) -> Column:
    """The bucket of a url, from 0."""
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """All records with their buckets; None if there is nothing yet. Unreadable files have no rows."""
    try:
        return spark.read.schema(_SCHEMA).option("ignoreCorruptFiles", "true").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _files(table: DataFrame | None) -> Counter:
    """How many files each bucket has, by its folder's name."""
    found = (_NAME.search(f) for f in table.inputFiles()) if table is not None else ()
    return Counter(f"{m[1]}-{m[2]}" for m in found if m)


def _buckets(files: Counter, default: int) -> int:
    return int(next(iter(files)).split("-")[1]) if files else default


def _folder(url: Column, buckets: int) -> Column:
    return F.concat(F.lpad(bucket(url, buckets).cast("string"), len(str(buckets - 1)), "0"), F.lit(f"-{buckets}"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The latest record of each url; nothing yet is an empty table."""
    table = _table(spark, path)
    if table is None:
        return spark.createDataFrame([], schemas.EXTRACTED)
    several = [b for b, n in _files(table).items() if n > 1]
    if not several:
        return table.select(*schemas.EXTRACTED.names)
    many = F.col("bucket").isin(several)
    return table.where(~many).unionByName(_latest(table.where(many))).select(*schemas.EXTRACTED.names)


def _latest(rows: DataFrame) -> DataFrame:
    """The latest records, a bucket at a time in one task."""
    return latest(rows.repartition("bucket"), ("bucket", "url"), *_ORDER)


def _write(rows: DataFrame, path: str, mode: str) -> None:
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def append(new: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Add the latest of the new records of each url, a file for each bucket that they fall in."""
    buckets = _buckets(_files(_table(new.sparkSession, path)), buckets)
    _write(_latest(new.select(*schemas.EXTRACTED.names).withColumn("bucket", _folder(F.col("url"), buckets))), path, "append")


def upsert(new: DataFrame, path: str, buckets: int = BUCKETS) -> list[str]:
    """Merge new records, the later one of each url winning, and give the names of the buckets that were rewritten."""
    spark, aside = new.sparkSession, f"{path}/_new-{uuid.uuid4().hex}"
    table = _table(spark, path)
    buckets = _buckets(_files(table), buckets)
    new.select(*schemas.EXTRACTED.names).withColumn("bucket", _folder(F.col("url"), buckets)).write.parquet(aside)
    try:
        some = spark.read.schema(_SCHEMA).parquet(aside)
        touched = sorted(r.bucket for r in some.select("bucket").distinct().collect())
        if touched:
            merged = some if table is None else some.unionByName(table.where(F.col("bucket").isin(touched)))
            _write(_latest(merged), path, "overwrite")
    finally:
        _remove(spark, aside)
    return touched


def compact(spark: SparkSession, path: str, files: int = FILES) -> list[str]:
    """Rewrite the buckets of more than so many files to one file each, and give their names."""
    table = _table(spark, path)
    large = sorted(b for b, n in _files(table).items() if n > files)
    if large:
        _write(_latest(table.where(F.col("bucket").isin(large))), path, "overwrite")
    return large


def quarantine(spark: SparkSession, path: str) -> list[str]:
    """Move files that cannot be read to ``_unreadable`` and warn; the names of their buckets. A file counts as read if as
    many urls come out of it as its footer tells."""
    table = _table(spark, path)
    if table is None:
        return []
    name = F.regexp_extract("_metadata.file_path", "[^/]+/[^/]+$", 0).alias("file")
    told = {r.file: r.n for r in table.groupBy(name).agg(F.count("*").alias("n")).collect()}
    came = {r.file: r.n for r in table.groupBy(name).agg(F.count("url").alias("n"), F.count_if(F.col("url").isNull()).alias("none")).select("file", (F.col("n") + F.col("none")).alias("n")).collect()}
    bad = [f for f in table.inputFiles() if (base := "/".join(unquote(f).split("/")[-2:])) not in told or told[base] != came.get(base)]
    for f in bad:
        source = _path(spark, unquote(f))
        fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(_path(spark, f"{path}/_unreadable"))
        if not fs.rename(source, _path(spark, f"{path}/_unreadable/{uuid.uuid4().hex}")):
            raise OSError(f"cannot move {f}")
    if bad:
        warnings.warn(f"{len(bad)} unreadable files of {path} were set aside; their records will be extracted again", stacklevel=2)
    return sorted({m[0][7:-1] for f in bad if (m := _NAME.search(f))})


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _remove(spark: SparkSession, name: str) -> None:
    where = _path(spark, name)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
