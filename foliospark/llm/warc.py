"""WARC archives written in shards that depend on the rows alone, and read back.

Records are dealt to ranges of their key and sorted there. The bounds come from a sample of distinct keys, drawn by a
hash of the key and weighted by bytes, so that the same rows give the same files whatever their partitions were. A task
writes its range record by record, each its own gzip member, and begins a new file when the compressed size reaches
``file_bytes``. Headers, record ids and digests are made anew from the rows. Files are written under a folder of the job,
get their names (range, number, digest of the content) when all tasks are done, and count once a manifest names them;
readers take the newest manifest. A lost executor's task is written again under another temporary name, and a job that
fails leaves the archive as it was.

Of records with equal payloads (by SHA-256) of at least ``least`` bytes, the one with the greatest (key, uri) is the
response and keeps the payload; the others are revisits that name it and leave their payloads out before they are dealt.
Smaller ones are all responses. Rows that are equal altogether are numbered in their order, and only the first is the
response.

A null payload is empty. A null key is written without a key and sorts first. A null or empty uri becomes ``urn:key:``
and the key. An empty table gives an archive without files. A record stays in memory while it is written or read; other
columns of the rows do not matter. The folder can be of any store that pyarrow.fs opens.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from foliospark.llm._rows import saved, small

FILE_BYTES = 1 << 30
#: Bytes of payload in a range, until there are ``MOST_RANGES`` of them.
RANGE_BYTES, MOST_RANGES = 1 << 25, 10_000
#: About so many distinct keys are sampled for the bounds.
SAMPLE = 1 << 15
#: Bytes of payload that a batch of the reader holds, and that are read from a file at once.
BATCH_BYTES, READ_BYTES = 1 << 23, 1 << 20
EPOCH = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ROWS = "range int, key string, uri string, date string, body binary, sha1 string, bytes long, response boolean, to_key string, to_uri string"
RECORDS = (
    "key string, record_type string, record_id string, uri string, date string, payload_bytes long, payload_digest string, to_key string, to_id string, payload binary"
)


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", folder))


# ---- dealing


def _bounds(rows: DataFrame, ranges: int, distinct: int) -> list:
    """Keys at which a new range begins, none of them null; fewer where keys are few."""
    if ranges < 2:
        return []
    share = min(1.0, SAMPLE / max(1, distinct))
    some = rows.where(F.col("key").isNotNull() & (F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))))
    weights = sorted(map(tuple, some.groupBy("key").agg((F.sum(F.length("body")) + F.count("*")).alias("n")).collect()))
    total, done, out = sum(n for _, n in weights), 0, []
    for k, n in weights:
        if done * ranges >= total * (len(out) + 1) and len(out) < ranges - 1:
            out.append(k)
        done += n
    return out


def _range(key: Column, bounds: list) -> Column:
    if not bounds:
        return F.lit(0)

    @F.arrow_udf("int")
    def place(keys: pa.Array) -> pa.Array:
        return pa.array([0 if k is None else bisect_right(bounds, k) for k in keys.to_pylist()], pa.int32())

    return place(key)


def write(
    rows: DataFrame, folder: str, key: str = "page_id", uri: str = "url", payload: str = "html", date: str | None = None,
    least: int = 0, file_bytes: int = FILE_BYTES, range_bytes: int = RANGE_BYTES,
) -> None:
    """Write the rows as an archive that takes the place of what ``folder`` holds. ``date``: a column of W3C dates."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    when = F.coalesce(F.col(date).cast("string"), F.lit(EPOCH)) if date else F.lit(EPOCH)
    flat = rows.select(F.col(key).alias("key"), F.col(uri).cast("string").alias("uri"), when.alias("date"), body.alias("body"))
    flat = flat.withColumn("sha", F.unhex(F.sha2("body", 256)))

    total = flat.agg(F.sum(F.length("body") + 1), F.approx_count_distinct("key")).first()
    ranges = max(1, min(MOST_RANGES, -(-(total[0] or 0) // range_bytes)))
    bounds = _bounds(flat, ranges, total[1])

    place = F.struct("key", "uri")
    groups = flat.where(F.length("body") >= least).groupBy("sha").agg(F.max(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    told = flat.join(small(saved(groups.select("sha", "first"))), "sha", "left")
    response = F.col("first").isNull() | place.eqNullSafe(F.col("first"))
    dealt = (
        told.select(
            _range(F.col("key"), bounds).alias("range"), "key", "uri", "date", F.when(response, F.col("body")).alias("body"), F.sha1("body").alias("sha1"),
            F.length("body").cast("long").alias("bytes"), response.alias("response"), F.col("first").isNotNull().alias("shared"), "first.*", "sha",
        ).toDF("range", "key", "uri", "date", "body", "sha1", "bytes", "response", "shared", "to_key", "to_uri", "sha")
        .repartitionById(len(bounds) + 1, F.col("range"))
        .sortWithinPartitions("key", "uri", "sha", "date")
    )
    text = {c: F.col(c).cast("string").alias(c) for c in ("key", "to_key")}
    spark = rows.sparkSession
    spark.dataSource.register(WarcSource)
    columns = [c.split()[0] for c in _ROWS.split(", ")]
    out = dealt.select(*(text.get(c, F.col(c)) for c in columns), "shared")
    out.write.format("warc_shards").mode("append").option("file_bytes", str(file_bytes)).save(folder)


# ---- records


def _digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _record_id(key: str | None, uri: str | None, sha1: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([key, uri, sha1, copy]))}>"


def _target(key: str | None, uri: str | None) -> str:
    return quote(uri, safe="%/:=&?~#+!$,;'@()*[]") if uri else f"urn:key:{quote(key or '')}"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A whole record as a gzip member without a time."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", "sha1:" + _digest(hashlib.sha1(block).digest())), ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def _info(name: str) -> bytes:
    block = b"software: foliospark\r\nformat: WARC File Format 1.1\r\n"
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, name, "", 0)), ("WARC-Date", EPOCH), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def _record(row: dict, copy: int) -> bytes:
    """The record of a row; the second of equal rows that share their payload is a revisit of the first."""
    revisit = not row["response"] or row["shared"] and copy > 0
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(row["key"], row["uri"], row["sha1"], copy)), ("WARC-Date", quote(row["date"], safe=":-+.")),
        ("WARC-Target-URI", _target(row["key"], row["uri"])), ("WARC-Payload-Digest", "sha1:" + _digest(bytes.fromhex(row["sha1"]))), ("Content-Type", "application/http;msgtype=response"),
    ]
    if row["key"] is not None:
        headers.append(("X-Source-Key", quote(row["key"])))
    if revisit:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(row["to_key"], row["to_uri"], row["sha1"], 0)), ("WARC-Refers-To-Target-URI", _target(row["to_key"], row["to_uri"])), ("WARC-Truncated", "length")]
        if row["to_key"] is not None:
            headers.append(("X-Refers-To-Key", quote(row["to_key"])))
    return _member(headers, http if revisit else http + row["body"])


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Shard:
    """One file under its temporary name."""

    def __init__(self, store, path: str, part: int, number: int):
        self.store, self.part, self.number = store, part, number
        self.aside = f"{path}/{uuid.uuid4().hex}"
        self.out, self.sha, self.bytes, self.records = store.open_output_stream(self.aside, compression=None), hashlib.sha256(), 0, 0
        self.add(_info(f"part-{part:05d}-{number:05d}.warc.gz"))
        self.records = 0

    def add(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        name = f"part-{self.part:05d}-{self.number:05d}-{self.sha.hexdigest()[:16]}.warc.gz"
        return {"name": name, "aside": self.aside, "bytes": self.bytes, "records": self.records, "sha256": self.sha.hexdigest()}


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.limit = options["path"].rstrip("/"), int(options.get("file_bytes", FILE_BYTES))
        self.job = f"_tmp-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, path = _open(self.folder)
        store.create_dir(f"{path}/{self.job}")
        done, shard, last, copy = [], None, None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                me = row["range"], row["key"], row["uri"], row["sha1"]
                copy = copy + 1 if me == last else 0
                if shard is not None and (shard.part != row["range"] or shard.bytes >= self.limit):
                    done.append(shard.close())
                    shard = _Shard(store, f"{path}/{self.job}", row["range"], shard.number + 1 if shard.part == row["range"] else 0)
                elif shard is None:
                    shard = _Shard(store, f"{path}/{self.job}", row["range"], 0)
                shard.add(_record(row, copy))
                last = me
        if shard is not None:
            done.append(shard.close())
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        store, path = _open(self.folder)
        store.create_dir(path)
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f["name"])
        for f in files:
            _rename(store, f.pop("aside"), f"{path}/{f['name']}")
        before = _manifests(store, path)
        number = before[-1][0] + 1 if before else 1
        aside = f"{path}/{self.job}.json"
        with store.open_output_stream(aside) as out:
            out.write(json.dumps({"files": files}, indent=1).encode())
        _rename(store, aside, f"{path}/manifest-{number:06d}.json")
        _drop(store, f"{path}/{self.job}")
        kept = {f["name"] for f in files}
        for _, old in before:  # what only older manifests name
            for f in _load(store, old):
                if f["name"] not in kept:
                    _drop(store, f"{path}/{f['name']}")
            _drop(store, old)

    def abort(self, messages: list[_Written | None]) -> None:
        store, path = _open(self.folder)
        _drop(store, f"{path}/{self.job}")


def _rename(store, old: str, new: str) -> None:
    from pyarrow import fs

    if store.get_file_info(new).type == fs.FileType.NotFound:
        store.move(old, new)


def _drop(store, path: str) -> None:
    from pyarrow import fs

    kind = store.get_file_info(path).type
    if kind == fs.FileType.Directory:
        store.delete_dir(path)
    elif kind == fs.FileType.File:
        store.delete_file(path)


def _manifests(store, path: str) -> list[tuple[int, str]]:
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((int(f.base_name[9:-5]), f.path) for f in found if f.base_name.startswith("manifest-") and f.base_name.endswith(".json"))


def _load(store, manifest: str) -> list[dict]:
    with store.open_input_stream(manifest) as source:
        return json.loads(source.read())["files"]


# ---- reading


def _members(source) -> Iterator[bytes]:
    """The gzip members of a stream, one by one."""
    unpack, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or source.read(READ_BYTES)
        if not data:
            if parts:
                raise ValueError("the file ends within a record")
            return
        parts.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []


def _parse(record: bytes) -> dict | None:
    """The fields of a response or revisit, alone in its member; its block must have the digest that the header tells."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(h["content-length"])
    block = rest[:size]
    if rest[size:] != b"\r\n\r\n" or h["warc-block-digest"] != "sha1:" + _digest(hashlib.sha1(block).digest()):
        raise ValueError(f"record {h['warc-record-id']} is damaged")
    if h["warc-type"] not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    key, to = h.get("x-source-key"), h.get("x-refers-to-key")
    out = {
        "key": None if key is None else unquote(key), "record_type": h["warc-type"], "record_id": h["warc-record-id"], "uri": h["warc-target-uri"], "date": h["warc-date"],
        "to_key": None if to is None else unquote(to), "to_id": h.get("warc-refers-to"),
    }
    if h["warc-type"] == "response":
        return out | {"payload_bytes": len(payload), "payload_digest": _digest(hashlib.sha1(payload).digest()), "payload": payload}
    length = next(int(x[15:]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length:"))
    return out | {"payload_bytes": length, "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"), "payload": None}


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.folder, self.names, self.payloads = options["path"].rstrip("/"), names, options.get("payloads", "true") == "true"

    def partitions(self) -> list[_File]:
        store, path = _open(self.folder)
        found = _manifests(store, path)
        if not found:
            raise FileNotFoundError(f"there is no manifest in {self.folder}")
        return [_File(f"{path}/{f['name']}") for f in _load(store, found[-1][1])]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.folder)
        schema = pa.schema([(n, {"payload": pa.binary(), "payload_bytes": pa.int64()}.get(n, pa.string())) for n in self.names])
        if partition is None or not isinstance(partition, _File):
            return
        rows, held = [], 0
        with store.open_input_stream(partition.path, compression=None) as source:
            for row in filter(None, map(_parse, _members(source))):
                held += 200 + (len(row["payload"] or b"") if self.payloads else 0)
                rows.append(row if self.payloads else row | {"payload": None})
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    """``warc_shards``: archives in a folder, as ``write`` makes them and ``read`` gives them."""

    @classmethod
    def name(cls):
        return "warc_shards"

    def schema(self):
        return RECORDS

    def reader(self, schema):
        return _Reader(dict(self.options), schema.names)

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options))


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of an archive: keys as text, digests in bare base32. Every block is held against its digest. Without
    ``payloads`` the responses' payloads are measured but not returned."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc_shards").option("payloads", str(payloads).lower()).load(folder)
