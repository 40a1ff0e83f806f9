"""Reads of articles: recent ones, a range, pending ones, statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import sort_time


def since(at: datetime) -> Column:
    """From ``at`` on; by the fetch where there is no date. The form reaches the Parquet scan."""
    t = F.lit(at).cast("timestamp_ntz")
    return (F.col("published_at") >= t) | (F.col("published_at").isNull() & (F.col("fetched_at") >= t))


def within(start: datetime, end: datetime) -> Column:
    """From ``start`` up to, not including, ``end``."""
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return ((F.col("published_at") >= a) & (F.col("published_at") < b)) | (F.col("published_at").isNull() & (F.col("fetched_at") >= a) & (F.col("fetched_at") < b))


def newest(rows: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = rows.orderBy(sort_time().desc(), F.col("id"))
    return ordered if limit is None else ordered.limit(limit)


def recent(articles: DataFrame, at: datetime, category: str | None = None, source_key: str | None = None, limit: int = 100) -> DataFrame:
    rows = articles.where(since(at))
    if category:
        rows = rows.where(F.col("category") == category)
    if source_key:
        rows = rows.where(F.col("source_key") == source_key)
    return newest(rows, limit)


def ranged(articles: DataFrame, start: datetime, end: datetime, category: str | None = None, without: list[str] | None = None, without_duplicates: bool = False) -> DataFrame:
    """Articles of a range, in no order: what aggregates need."""
    rows = articles.where(within(start, end))
    if category:
        rows = rows.where(F.col("category") == category)
    if without:
        rows = rows.where(~F.col("source_key").isin(*without))
    if without_duplicates:
        rows = rows.where(F.col("duplicate_of_id").isNull())
    return rows


def in_range(articles: DataFrame, start: datetime, end: datetime, category: str | None = None, without: list[str] | None = None, without_duplicates: bool = False) -> DataFrame:
    """Articles of a range, newest first."""
    return newest(ranged(articles, start, end, category, without, without_duplicates))


def pending(articles: DataFrame, at: datetime, limit: int = 50, retry_failed: bool = False) -> DataFrame:
    """Articles that a language model has yet to see, without duplicates."""
    states = ("pending", "failed") if retry_failed else ("pending",)
    return newest(articles.where(since(at) & F.col("ai_status").isin(*states) & F.col("duplicate_of_id").isNull()), limit)


def count_by(articles: DataFrame, column: str) -> DataFrame:
    return articles.groupBy(column).agg(F.count("*").alias("articles"))


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(1)


def run_totals(results: DataFrame, *by: str) -> DataFrame:
    """Totals of a run and its status: all well, in part, or failed."""
    ok, bad = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "failed")
    status = F.when(bad == 0, F.lit("success")).when(ok > 0, F.lit("partial")).otherwise(F.lit("failed"))
    return results.groupBy(*by).agg(F.count("*").alias("total_sources"), ok.alias("success_count"), bad.alias("failed_count"), F.coalesce(F.sum("new_count"), F.lit(0)).alias("new_count"), F.coalesce(F.sum("updated_count"), F.lit(0)).alias("updated_count"), status.alias("status"))


def orphans(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """Rows whose reference has no target."""
    return rows.join(others.select(F.col(other_key).alias(key)), key, "left_anti")


def by_category(articles: DataFrame) -> DataFrame:
    """category, sources, articles and total: each category, and a row for all of them, whose sources are the
    sum over categories. ``total`` tells that row from a category of its name. Without articles there is none."""
    groups = articles.groupBy("category", "source_key").agg(F.count("*").alias("n")).groupBy("category").agg(F.count("source_key").alias("sources"), F.sum("n").alias("articles"))
    both = groups.rollup("category").agg(F.sum("sources").alias("sources"), F.sum("articles").alias("articles"), (F.grouping("category") == 1).alias("total"))
    return both.withColumn("category", F.when(F.col("total"), F.lit("TOTAL")).otherwise(F.col("category")))


def numbered(hits: DataFrame, articles: DataFrame) -> DataFrame:
    """Hits of a search (id, rank, snippet) with n, their place from 1, and what is shown of their articles."""
    n = F.row_number().over(Window.orderBy("rank", "id"))  # as few as the search's limit
    return hits.withColumn("n", n).join(articles.select("id", "title", "url", "source_key"), "id")


def listed(sources: DataFrame) -> DataFrame:
    """Sources by key, with the address that is shown for each."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    return sources.select("key", "name", "category", "fetch_method", "enabled", F.coalesce(filled("feed_url"), filled("list_url"), "base_url").alias("address")).orderBy("key")
