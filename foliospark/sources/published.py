"""One CSV file for people to take away, in place of a folder of parts.

Tasks write parts beside the file under names of the job; when all are done, the parts are joined in the order of the
partitions and the file gets its name in one step. A job that fails, or is killed before that, leaves what was there. The
joining streams through one process, so this is for listings that someone opens, not for large tables, which
``tables.write_csv`` leaves in parts.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from foliospark.sources.tables import flat, listing_name

_COPY_BYTES = 1 << 20
_QUOTED = re.compile(r'[",\r\n]|^\s|\s$|^$')


def _cell(value: str | None) -> str:
    """Null is nothing; an empty string has its quotes."""
    if value is None:
        return ""
    return '"' + value.replace('"', '""') + '"' if _QUOTED.search(value) else value


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", folder))


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, names: list[str]):
        self.folder, self.stem, self.name, self.names = options["path"].rstrip("/"), options.get("stem", "documents"), options.get("name"), names
        self.job = options.get("job") or uuid.uuid4().hex
        self.aside = f"_csv-{self.job}"

    def write(self, iterator: Iterator) -> _Part:
        from pyspark import TaskContext

        store, root = _open(self.folder)
        store.create_dir(f"{root}/{self.aside}")
        path, rows = f"{root}/{self.aside}/{uuid.uuid4().hex}", 0
        with store.open_output_stream(path) as out:
            for row in iterator:
                out.write((",".join(map(_cell, row)) + "\n").encode())
                rows += 1
        return _Part(TaskContext.get().partitionId(), path, rows)

    def commit(self, messages: list[_Part | None]) -> None:
        store, root = _open(self.folder)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        store.create_dir(f"{root}/{self.aside}")
        whole = f"{root}/{self.aside}/whole"
        with store.open_output_stream(whole) as out:
            out.write((",".join(map(_cell, self.names)) + "\n").encode())
            for part in parts:
                with store.open_input_stream(part.path) as source:
                    while data := source.read(_COPY_BYTES):
                        out.write(data)
        name = self.name or listing_name(sum(p.rows for p in parts), datetime.now(timezone.utc), self.stem)
        store.move(whole, f"{root}/{name}")
        with store.open_output_stream(f"{root}/_csv-{self.job}.name") as out:
            out.write(name.encode())
        store.delete_dir(f"{root}/{self.aside}")

    def abort(self, messages: list[_Part | None]) -> None:
        from pyarrow import fs

        store, root = _open(self.folder)
        if store.get_file_info(f"{root}/{self.aside}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.aside}")


class OneCsvSource(DataSource):
    """``df.write.format("one_csv").option("name", ...).save(folder)``; without a name, ``stem`` and the rows and time."""

    @classmethod
    def name(cls):
        return "one_csv"

    def writer(self, schema: T.StructType, overwrite: bool):
        return _Writer(dict(self.options), schema.names)


def write_csv(df: DataFrame, folder: str, stem: str = "documents", name: str | None = None) -> str:
    """Write the rows, in their order, to one file of ``folder`` and give its path. ``name`` replaces the file of that name;
    otherwise it is made of ``stem``, the number of rows and the time."""
    df.sparkSession.dataSource.register(OneCsvSource)
    job = uuid.uuid4().hex
    text = flat(df)
    when = lambda f: F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX") if isinstance(f.dataType, T.TimestampType) else F.col(f.name).cast("string")
    writer = text.select(*(when(f).alias(f.name) for f in text.schema)).write.format("one_csv").mode("append").option("stem", stem).option("job", job)
    (writer.option("name", name) if name else writer).save(folder)
    store, root = _open(folder)
    with store.open_input_stream(f"{root}/_csv-{job}.name") as source:
        found = source.read().decode()
    store.delete_file(f"{root}/_csv-{job}.name")
    return f"{folder.rstrip('/')}/{found}"
