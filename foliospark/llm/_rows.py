"""Small things that several operators share."""

from __future__ import annotations

import atexit
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or ``name_2`` and so on when the rows have such a column (case does not count)."""
    taken = {c.lower() for c in df.columns}
    out, n = name, 1
    while out.lower() in taken:
        n += 1
        out = f"{name}_{n}"
    return out


def key_crc(key: Column) -> Column:
    """crc32 of a key written as text; null for a null key."""
    return F.crc32(key.cast("string").cast("binary"))


def most_frequent(counted: DataFrame, count: str, bound: int) -> DataFrame:
    """The rows with the greatest counts, no more than ``bound`` and all or none of an eighth of a power of two. Only a
    histogram of those is gathered; ``counted`` is read twice."""
    level = F.floor(F.log2(count) * 8)
    steps = sorted(map(tuple, counted.where(F.col(count) > 0).groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    least, total = None, 0
    for step, rows in steps:
        total += rows
        if total > bound:
            break
        least = step
    return counted.where((F.col(count) > 0) & (level >= least) if least is not None else F.lit(False))


def _shared_folder(spark: SparkSession) -> str:
    """The application's checkpoint folder below spark.checkpoint.dir. Only where that setting is missing, as in tests,
    is a local folder used."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            import tempfile

            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


@contextmanager
def _tidied(df: DataFrame) -> Iterator[DataFrame]:
    """The same rows, whose shuffle files go as soon as they are written, rather than when the driver next collects garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        yield df.select("*")
    finally:
        conf.set(name, before)


#: Rows of an Arrow batch where rows are whole texts: a few MB, once in the JVM and once in Python for each running task.
TEXT_BATCH = 1_000


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside tells Python at most ``TEXT_BATCH`` rows at a time; for plans that save what they compute."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= TEXT_BATCH:
        spark.conf.set(name, str(TEXT_BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def saved(df: DataFrame) -> DataFrame:
    """The rows checkpointed in the shared folder: lineage ends, and a lost executor costs nothing. The files go when
    nothing refers to them and spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    _shared_folder(df.sparkSession)
    with _tidied(df) as rows:
        return rows.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``saved``, for many flat rows: a compressed table in the shared folder, removed by ``discard`` or when the Python
    process ends."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/table-{uuid.uuid4()}"
    with _tidied(df) as rows:
        rows.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[id(out)] = path
    weakref.finalize(out, _tables.pop, id(out), None)
    atexit.register(_remove, spark, path)
    return out


def scratch(spark: SparkSession, stem: str) -> str:
    """A new name in the shared folder; what is put there goes when the Python process ends."""
    path = f"{_shared_folder(spark)}/{stem}-{uuid.uuid4()}"
    atexit.register(_remove, spark, path)
    return path


_tables: dict[int, str] = {}


def discard(table: DataFrame) -> None:
    """Remove a table that ``stored`` gave, once all that is read from it has been saved."""
    _remove(table.sparkSession, _tables[id(table)])


def small(df: DataFrame, most: int = 1 << 18) -> DataFrame:
    """The saved rows, marked to be broadcast if they are no more than so many; for rows of a few numbers."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
