"""Dealing rows out to tasks before costly work on each."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of a table, as it is stored, that keep a task of page parsing busy for a while.
TASK_BYTES = 1 << 18
_SIMPLE = ("Project", "Filter", "LogicalRelation", "LocalRelation", "LogicalRDD", "Range", "DataSourceV2Relation", "DataSourceV2ScanRelation")


def _scanned(df: DataFrame) -> tuple[int, int] | None:
    """Bytes that the plan reads, and in how many splits; None if something above the scans deals the rows already."""
    plan = df._jdf.queryExecution().optimizedPlan()
    node = plan
    while True:
        if node.nodeName().split(" ")[0] not in _SIMPLE:
            return None
        if node.children().isEmpty():
            break
        node = node.children().apply(0)
    size = int(str(node.stats().sizeInBytes()))
    files = df.inputFiles()
    if not files:
        return size, df.rdd.getNumPartitions()
    conf = df.sparkSession.conf
    most = int(df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get("spark.sql.files.maxPartitionBytes")))
    return size, max(len(files) if size >= len(files) * most // 4 else 0, size // most)


def dealt(rows: DataFrame, task_bytes: int = TASK_BYTES, tasks: int | None = None) -> DataFrame:
    """The rows in as many partitions as there are cores, or one for each ``task_bytes`` if those are fewer, where the scan
    makes less. A scan that has a split for each core stays as it is, as moving whole pages costs more than it would gain;
    so does what a join or an aggregate has dealt. ``tasks`` asks for so many anyway."""
    if tasks is not None:
        return rows.repartition(tasks)
    if rows.isStreaming or not hasattr(rows, "_jdf"):  # a stream's batches, or a plan that is made elsewhere
        return rows
    scanned = _scanned(rows)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if scanned is None or scanned[1] >= cores:
        return rows
    wanted = min(cores, -(-scanned[0] // task_bytes))
    return rows.repartition(wanted) if wanted > max(1, scanned[1]) else rows
