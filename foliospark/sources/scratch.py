"""Folders that last as long as the Python process."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, stem: str) -> str:
    """A new name below spark.checkpoint.dir, which all executors share. Only where that setting is missing and the master
    is local, as in tests, is a local folder used."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
    path = f"{root}/{stem}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
