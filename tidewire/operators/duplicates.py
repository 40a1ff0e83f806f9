"""Stories repeated across sources: equal titles, from two sources or more."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import normalize_title, sort_time
from tidewire.operators.select import within
from tidewire.plans.session import written

MIN_TITLE = 15


def matches(articles: DataFrame, min_title: int = MIN_TITLE, title: Column | None = None) -> DataFrame:
    """canonical_id, duplicate_id and score: the earliest article of a title, and each later one.

    Groups are aggregated before their shuffle and written: the join back is one of two tables, in which Spark
    splits a title that most articles share, or broadcasts the groups if they are few. No pair of rows is formed.
    """
    rows = articles.select("id", "source_key", sort_time().alias("at"), (normalize_title("title") if title is None else title).alias("t")).where(F.length("t") >= min_title)
    groups = rows.groupBy("t").agg(F.min(F.struct("at", F.coalesce("id", F.lit(0)).alias("k"), "id")).alias("first"), F.min("source_key").alias("s0"), F.max("source_key").alias("s1")).where("s0 <> s1").select("t", F.col("first.id").alias("canonical_id"))
    groups = written(groups, "titles")
    return rows.join(groups, "t").where(F.col("id") != F.col("canonical_id")).select("canonical_id", F.col("id").alias("duplicate_id"), F.lit(1.0).alias("score"))


def marked(articles: DataFrame, start: datetime, end: datetime, min_title: int = MIN_TITLE) -> DataFrame:
    """``articles`` with the marks of a range cleared and set anew."""
    inside = within(start, end)
    found = matches(articles.where(inside), min_title).select(F.col("duplicate_id").alias("id"), "canonical_id", "score")
    kept = lambda c: F.when(~F.coalesce(inside, F.lit(False)), F.col(c))
    joined = articles.withColumns({"duplicate_of_id": kept("duplicate_of_id"), "duplicate_score": kept("duplicate_score")}).join(found, "id", "left")
    return joined.withColumns({"duplicate_of_id": F.coalesce("canonical_id", "duplicate_of_id"), "duplicate_score": F.coalesce("score", "duplicate_score")}).drop("canonical_id", "score")
