"""Live fetching, in two stages: first requests of all sources, then the pages that their lists name.

First requests are a data source with one partition for each source:

    register(spark)
    spark.read.format("tidewire_fetch").option("plan", plan_of(sources)).load()

gives source_key, url, status, body and fetched_at; a request that fails gives a row without a body. ``requested`` gives
the same of a table of links, dealt by host: a host's pages are asked for in turn, with its delay between them, hosts beside each
other. Written to a landing zone, the rows are what the readers of ``landing`` take.
"""

from __future__ import annotations

import json
import os
import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from datetime import datetime
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewire.plans.session import ship

SCHEMA = "source_key STRING, url STRING, status INT, body BINARY, fetched_at TIMESTAMP_NTZ"
NAME = "tidewire_fetch"


def trusted() -> ssl.SSLContext:
    """TLS settings: the certificates that the environment names, else the system's."""
    for name in ("SSL_CERT_FILE", "REQUESTS_CA_BUNDLE", "CURL_CA_BUNDLE"):
        if os.path.isfile(os.environ.get(name, "")):
            return ssl.create_default_context(cafile=os.environ[name])
    return ssl.create_default_context()


def address(source: dict) -> str:
    """What is fetched first for a source."""
    base = (source.get("base_url") or "").rstrip("/")
    if source.get("fetch_method") == "github":
        return f"https://api.github.com/repos/{base.split('github.com/')[-1]}/releases"
    if source.get("fetch_method") == "huggingface":
        return f"https://huggingface.co/api/models?author={base.split('huggingface.co/')[-1]}&limit=20"
    return source.get("feed_url") or source.get("list_url") or source.get("base_url") or ""


def plan_of(sources: list[dict], urls: dict[str, list[str]] | None = None) -> str:
    """The ``plan`` option: for each source its headers and URLs, by default its address."""
    return json.dumps([{"key": s["key"], "headers": s.get("headers") or {}, "urls": (urls or {}).get(s["key"], [address(s)])} for s in sources])


class Part(InputPartition):
    def __init__(self, source: dict):
        super().__init__(source["key"])
        self.source = source


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.plan = json.loads(options["plan"])
        self.delay, self.timeout = float(options.get("delay", 2.0)), float(options.get("timeout", 30))
        self.agent = options.get("useragent", "tidewire")

    def partitions(self) -> list[Part]:
        return [Part(s) for s in self.plan]

    def read(self, partition: Part) -> Iterator[tuple]:
        source = partition.source
        for k, url in enumerate(source["urls"]):
            if k and self.delay:
                time.sleep(self.delay)
            status, body = answer(url, source["headers"], self.agent, self.timeout)
            yield source["key"], url, status, body, datetime.now()


def answer(url: str, headers: dict[str, str], agent: str, timeout: float) -> tuple[int | None, bytes | None]:
    """Status and body of one request; None for what there is not."""
    headers = {"User-Agent": agent, **headers}
    if "api.github.com/" in url and os.environ.get("GITHUB_TOKEN"):
        headers["Authorization"] = f"Bearer {os.environ['GITHUB_TOKEN']}"
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout, context=trusted() if url.startswith("https") else None) as reply:
            return reply.status, reply.read()
    except urllib.error.HTTPError as e:
        return e.code, None
    except (OSError, ValueError):
        return None, None


def _asked(headers: dict[str, dict], delay: float, timeout: float, agent: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for batch in batches:
        for key, url, host in zip(*(batch.column(c).to_pylist() for c in ("source_key", "url", "host")), strict=True):
            if host == last and delay:
                time.sleep(delay)
            last = host
            status, body = answer(url, headers.get(key) or {}, agent, timeout)
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([url]), pa.array([status], pa.int32()), pa.array([body], pa.binary()), pa.array([datetime.now()], pa.timestamp("us"))], names=["source_key", "url", "status", "body", "fetched_at"])


def requested(links: DataFrame, sources: list[dict], delay: float = 2.0, timeout: float = 30, useragent: str = "tidewire") -> DataFrame:
    """What the pages of ``links`` (source_key, rank, url) answer. To be written at once: reading it again asks again."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]*)", 1))
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = links.select("source_key", "rank", "url", host.alias("host")).repartition(parts, "host").sortWithinPartitions("host", "source_key", "rank")
    return dealt.mapInArrow(partial(_asked, {s["key"]: s.get("headers") or {} for s in sources}, float(delay), float(timeout), useragent), SCHEMA)


class FetchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark).dataSource.register(FetchSource)


def fetched(spark: SparkSession, sources: list[dict], urls: dict[str, list[str]] | None = None, **options: object) -> DataFrame:
    register(spark)
    reader = spark.read.format(NAME).option("plan", plan_of(sources, urls))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()
