"""Fetching: addresses are dealt by host, and a fetcher named by the caller gets the pages.

``fetch_pages(urls, {"fetcher": "module:function"})`` fetches a table of addresses. For a short list there is a data source:
``spark.dataSource.register(FetchSource)``, then ``spark.read.format("crawl_fetch").option("urls", json)`` with the same options. The
function takes an address, the number of the attempt and the headers, and gives a ``Response``. The default one reads ``file://``
addresses alone: no network is touched unless the caller's function does so. Other options: ``headers`` (JSON), ``user_agents`` and ``proxies``
(JSON lists, taken in turn), ``retries``, ``backoff``, ``delay`` and ``max_backoff`` in seconds.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice
from pathlib import Path
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.urls import BINARY_EXTENSIONS, hostname
from ..streaming.crawl_stream import polite_step

SCHEMA = "url string, status_code int, content_type string, body string, final_url string, redirect_chain array<string>, error string, attempts int"
# How often and after which statuses a page is asked for again.
RETRIES, BACKOFF, MOST_BACKOFF, RETRIED = 3, 0.4, 30.0, (429, 500, 502, 503, 504)


@dataclass
class Response:
    status: int
    content_type: str
    body: str | None
    final_url: str
    redirects: tuple[str, ...] = ()
    headers: dict[str, str] = field(default_factory=dict)


Fetcher = Callable[[str, int, dict[str, str]], Response]


def read_local(url: str, attempt: int, headers: dict[str, str]) -> Response:
    """A file:// address's file; other schemes are not fetched."""
    parts = urlsplit(url)
    if parts.scheme != "file":
        raise type("InvalidSchema", (ValueError,), {})(parts.scheme)
    path = Path(parts.path)
    if not path.is_file():
        return Response(404, "", None, url)
    return Response(200, "text/html", path.read_text(errors="replace"), url)


def is_binary(url: str) -> bool:
    name = url.split("?")[0].split("#")[0]
    return "." in name and name.rpartition(".")[2].lower() in BINARY_EXTENSIONS


def with_retries(fetch: Fetcher, url: str, headers: dict[str, str], retries: int = RETRIES, backoff: float = BACKOFF, most: float = MOST_BACKOFF, pause: Callable[[float], None] = time.sleep) -> tuple:
    """A row of SCHEMA: the last of at most 1 + ``retries`` attempts. Between them the wait doubles, or is what Retry-After says, up to ``most``."""
    if is_binary(url):
        return url, None, "", None, url, [], None, 0
    for attempt in range(1, retries + 2):
        wait = backoff * 2 ** (attempt - 1)
        try:
            got = fetch(url, attempt, headers)
        except Exception as error:  # whatever a fetcher raises is this page's outcome, by its class
            row = url, None, "", None, url, [], type(error).__name__, attempt
        else:
            row = url, got.status, got.content_type, got.body, got.final_url, list(got.redirects), None, attempt
            if got.status not in RETRIED:
                return row
            asked = got.headers.get("Retry-After", "")
            wait = float(asked) if asked.replace(".", "", 1).isdigit() else wait
        if attempt <= retries:
            pause(min(wait, most))
    return row


def fetch_all(urls: Iterator[str], options: dict[str, str]) -> Iterator[tuple]:
    """Rows of SCHEMA for addresses in turn, those of one host behind one another by the politeness rules.

    A request waits for the host's gap (``delay``) and for what its last answer asked for: refusals (429, 503) double the
    wait up to ``max_backoff``, or tell it as Retry-After; success resets it.
    """
    option = options.get
    module, _, name = option("fetcher", f"{__name__}:read_local").partition(":")
    fetch = getattr(importlib.import_module(module), name)
    agents, proxies, fixed = (json.loads(option(k, default)) for k, default in (("user_agents", "[]"), ("proxies", "[]"), ("headers", "{}")))
    delay, backoff, most = float(option("delay", "0")), float(option("backoff", str(BACKOFF))), float(option("max_backoff", str(MOST_BACKOFF)))
    host, state = None, (float("-inf"), 0.0, 0.0)
    for n, url in enumerate(urls):
        headers = {"User-Agent": agents[n % len(agents)]} if agents else {}
        if proxies:
            headers["Proxy"] = proxies[n % len(proxies)]
        if urlsplit(url).netloc != host:
            host, state = urlsplit(url).netloc, (float("-inf"), 0.0, 0.0)
        last, allowed, _ = state
        time.sleep(max(0.0, max(allowed, last + delay) - time.monotonic()))
        row = with_retries(fetch, url, headers | fixed, int(option("retries", str(RETRIES))), backoff, most)
        # A refusal that stood after all retries makes the host's next address wait as well.
        _, state = polite_step(state, time.monotonic(), row[1], None, delay, most if backoff else 0.0)
        yield row


def fetch_pages(urls: DataFrame, options: dict[str, str]) -> DataFrame:
    """(url) -> rows of SCHEMA, each address once. A host's addresses go to one task and follow one another there, for its sake; no list comes to the driver."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = fetch_all((u for batch in batches for u in batch["url"]), options)
        while some := list(islice(rows, 100)):
            yield pd.DataFrame(some, columns=columns).astype({"status_code": "Int32", "attempts": "int32"})

    one = urls.select("url").where("url IS NOT NULL").distinct().withColumn("host", hostname(F.col("url")))
    return one.repartition("host").sortWithinPartitions("host", "url").select("url").mapInPandas(run, SCHEMA)


class HostPartition(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class FetchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        by_host: dict[str, list[str]] = {}
        for url in dict.fromkeys(json.loads(self.options.get("urls", "[]"))):
            by_host.setdefault(urlsplit(url).netloc, []).append(url)
        return [HostPartition(urls) for urls in by_host.values()] or [HostPartition([])]

    def read(self, partition: HostPartition) -> Iterator[tuple]:
        yield from fetch_all(iter(partition.urls), self.options)


class FetchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "crawl_fetch"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FetchReader(dict(self.options))
