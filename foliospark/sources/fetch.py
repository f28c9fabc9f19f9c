"""Pages by address: a recorded table, or live sources with retries and a pace for each host."""

from __future__ import annotations

import email.utils
import http.client
import time
import urllib.error
import urllib.request
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from foliospark import schemas
from foliospark.operators.deal import dealt

# HTTP statuses that are tried again.
RETRY_STATUSES = frozenset((429, 500, 502, 503, 504))
#: No server is waited for longer than this, whatever it asks for.
LONGEST_WAIT = 300.0


def recorded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FETCH).parquet(path)


def from_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """A table of saved pages as successful fetches, dealt out if it is in few files."""
    return dealt(pages.select(F.col(url).alias("url"), F.col(html).alias("html"))).select(
        "url", F.lit(200).alias("status"), F.lit(None).cast("string").alias("error"), "html", F.lit(None).cast("timestamp").alias("fetched_at")
    )


def attach(links: DataFrame, fetches: DataFrame) -> DataFrame:
    """Each link with its recorded fetch; a link never fetched is an error row."""
    right = fetches.select(F.col("url").alias("_url"), "status", "error", "html", "fetched_at")
    return links.join(right, F.col("url") == F.col("_url"), "left").select(
        "url", "status", F.when(F.col("_url").isNull(), "not fetched").otherwise(F.col("error")).alias("error"), "html", "fetched_at"
    )


def host(url: str) -> str:
    """What a pace is kept for: host and port; '' if the address has none."""
    try:
        return urlsplit(url).netloc.rpartition("@")[2].lower()
    except ValueError:
        return ""


def retry_after(value: str | None, now: float) -> float:
    """Seconds that a Retry-After header asks for, given as a number or a date; 0 if it says nothing."""
    if not value:
        return 0.0
    try:
        return max(0.0, float(value)) if value.strip().isdigit() else max(0.0, email.utils.parsedate_to_datetime(value).timestamp() - now)
    except (TypeError, ValueError):
        return 0.0


def _decoded(data: bytes, charset: str | None) -> str:
    try:
        return data.decode(charset or "utf-8", "replace")
    except LookupError:  # a charset that nobody knows
        return data.decode("utf-8", "replace")


class Pace:
    """At most one request to a host in ``pause`` seconds, whether it is a first try or another."""

    def __init__(self, pause: float):
        self.pause, self.next = pause, defaultdict(float)

    def wait(self, name: str) -> None:
        time.sleep(max(0.0, self.next[name] - time.monotonic()))
        self.next[name] = time.monotonic() + self.pause

    def hold(self, name: str, seconds: float) -> None:
        self.next[name] = max(self.next[name], time.monotonic() + min(seconds, LONGEST_WAIT))


def fetch_one(url: str, timeout: float, retries: int, backoff: float, agent: str, pace: Pace | None = None) -> tuple:
    """(url, status, error, html, time). Retries the usual statuses, failed connections and time-outs with exponential
    pauses, or after the time that the server asks for if that is longer."""
    status, error, html = None, None, None
    pace, name = pace or Pace(0), host(url)
    for attempt in range(retries + 1):
        if attempt:
            pace.hold(name, backoff * 2 ** (attempt - 1))
        pace.wait(name)
        try:
            request = urllib.request.Request(url, headers={"User-Agent": agent})
            with urllib.request.urlopen(request, timeout=timeout) as reply:  # noqa: S310
                status, error, html = reply.status, None, _decoded(reply.read(), reply.headers.get_content_charset())
                break
        except urllib.error.HTTPError as e:
            status, error = e.code, f"HTTP {e.code}"
            if e.code not in RETRY_STATUSES:
                break
            pace.hold(name, retry_after(e.headers.get("Retry-After"), time.time()))
        except (OSError, http.client.HTTPException) as e:
            status, error = None, str(e) or type(e).__name__
        except ValueError as e:
            error = str(e) or type(e).__name__
            break
    return url, status, error, html, datetime.now(timezone.utc)


def fetch(links: DataFrame, pause: float = 0.5, timeout: float = 15, retries: int = 3, backoff: float = 1, agent: str = "Mozilla/5.0", tasks: int | None = None) -> DataFrame:
    """Live fetches of a ``url`` column of any size; write the result before using it twice. All links of a host go to one
    task, which keeps its pace, so the pace holds for the whole run; a task goes round its hosts, so that one is asked while
    others rest."""
    url = F.col("url")
    name = F.coalesce(F.lower(F.regexp_extract(url, r"^[^/?#]*//(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit("")).alias("host")
    turn = F.row_number().over(Window.partitionBy("host").orderBy("url"))
    named = links.select("url", name)
    owned = (named.repartition(tasks, "host") if tasks else named.repartition("host")).withColumn("turn", turn).sortWithinPartitions("turn", "host")

    def run(batches):
        import pandas as pd

        pace = Pace(pause)
        for batch in batches:
            for some in range(0, len(batch), 64):  # what is fetched is passed on before long
                rows = [fetch_one(u, timeout, retries, backoff, agent, pace) for u in batch["url"][some : some + 64]]
                yield pd.DataFrame(rows, columns=schemas.FETCH.names).astype({"status": "Int32"})

    return owned.select("url").mapInPandas(run, schemas.FETCH)


# ---- a data source


@dataclass
class _Slice(InputPartition):
    urls: list[str]


def _slices(urls: Iterable[str], n: int) -> list[_Slice]:
    """The links of each host in one slice, its hosts taking turns."""
    hosts: dict[str, list[str]] = defaultdict(list)
    for u in urls:
        hosts[host(u)].append(u)
    out: list[list[tuple]] = [[] for _ in range(max(1, min(n, len(hosts))))]
    for name, mine in hosts.items():
        out[zlib.crc32(name.encode()) % len(out)] += [(i, name, u) for i, u in enumerate(mine)]
    return [_Slice([u for *_, u in sorted(some)]) for some in out if some]


class _Fetching:
    """What the readers share: options, and reading a slice."""

    def __init__(self, options: dict):
        self.options = options

    def read(self, partition: _Slice) -> Iterator[tuple]:
        o = self.options
        pace = Pace(float(o.get("pause", "0.5")))
        for url in partition.urls if partition is not None else ():
            yield fetch_one(url, float(o.get("timeout", "15")), int(o.get("retries", "3")), float(o.get("backoff", "1")), o.get("agent", "Mozilla/5.0"), pace)


class _Reader(_Fetching, DataSourceReader):
    wanted: list[str] | None = None

    def partitions(self) -> list[_Slice]:
        given = [u for u in self.options.get("urls", "").split("\n") if u]
        if self.wanted is None and not given:
            raise ValueError("page_fetch needs the option urls, or the option filters and a filter on url")
        keep = None if self.wanted is None else {u for u in self.wanted if u}
        chosen = given if keep is None else [u for u in given if u in keep] if given else sorted(keep)
        return _slices(dict.fromkeys(chosen), int(self.options.get("slices", "8"))) or [_Slice([])]


class _FilteredReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on ``url`` choose what is fetched."""
        for f in filters:
            if isinstance(f, EqualTo | In) and tuple(f.attribute) == ("url",):
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.wanted = values if self.wanted is None else [u for u in self.wanted if u in set(values)]
            else:
                yield f


class _StreamReader(_Fetching, DataSourceStreamReader):
    """The offset is a number of bytes of the links' file, at the end of a line. A batch takes all lines that are whole when
    it begins, and its links are held where the stream is planned; what comes in one piece is better fetched by ``fetch``."""

    def _lines(self, start: int, end: int | None = None) -> tuple[list[str], int]:
        """The links from one offset to another, or to the last whole line, and where they end."""
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.options["links"])
        with store.open_input_file(path) as source:
            size = source.size()
            source.seek(min(start, size))
            data = source.read((size if end is None else end) - min(start, size))
        whole = data[: data.rfind(b"\n") + 1]
        return [x.strip() for x in whole.decode("utf-8", "replace").split("\n")], start + len(whole)

    def initialOffset(self) -> dict:
        return {"byte": 0}

    def latestOffset(self) -> dict:
        self.at = self._lines(getattr(self, "at", 0))[1]
        return {"byte": self.at}

    def partitions(self, start: dict, end: dict) -> list[_Slice]:
        links, _ = self._lines(start["byte"], end["byte"])
        return _slices(dict.fromkeys(filter(None, links)), int(self.options.get("slices", "8"))) or [_Slice([])]


class PageFetchSource(DataSource):
    """Pages of the web as a table. ``spark.read.format("page_fetch").option("urls", ...)`` fetches those, a line each. With
    ``option("filters", "true")``, which needs spark.sql.python.filterPushdown.enabled, ``where(F.col("url").isin(...))`` is
    what is fetched.
    ``spark.readStream.format("page_fetch").option("links", file)`` fetches the links that are added to a text file, each
    line once, as the checkpoint remembers how far the file has been read. Options slices, pause, timeout, retries, backoff
    and agent. Register it with ``spark.dataSource.register(PageFetchSource)``."""

    @classmethod
    def name(cls):
        return "page_fetch"

    def schema(self):
        return schemas.FETCH

    def reader(self, schema):
        return (_FilteredReader if self.options.get("filters") == "true" else _Reader)(dict(self.options))

    def streamReader(self, schema):
        return _StreamReader(dict(self.options))
