"""What the modules of queries share: the registry, the stand-in articles, and their SQL.

The driver's documents stand for articles (``articles_of_documents``); "now" is fixed.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tidewire.plans.session import ship
from tidewire.sources.schema import ARTICLES_SQL, articles_of_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

START, END = datetime(2024, 1, 8), datetime(2024, 2, 5)
AT = "coalesce(published_at, fetched_at)"
IN = f"(({AT}) >= TIMESTAMP '2024-01-08' AND ({AT}) < TIMESTAMP '2024-02-05')"
SINCE = f"({AT} >= TIMESTAMP '2024-01-08')"
DAY = "CASE WHEN published_at IS NULL OR published_at > fetched_at + INTERVAL 1 DAY THEN fetched_at ELSE published_at END::DATE"
#: White space of a text as one blank, none at its ends.
ONE_LINE = "trim(regexp_replace({0}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


def query(sql: str | None = None):
    """Register a query with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def with_articles(body: str, *more: str) -> str:
    return "WITH " + ",\n".join((ARTICLES_SQL, *more)) + "\n" + body


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_of_documents(ship(spark), sf_dir)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stop_words() -> str:
    from tidewire.functions.words import ENGLISH

    return ", ".join(f"'{w}'" for w in sorted(ENGLISH))
