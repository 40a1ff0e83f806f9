"""Marks of duplicates kept up by batch: only titles that a change touches are grouped anew.

The store has a narrow table of titles, in buckets of the normalised title: one row for each article whose title is
long enough. A change moves its articles' rows there; the groups of the titles that they left or came to are
formed anew, from the rows of these titles alone, and so are the marks. Marks equal those of ``duplicates.marked`` over all times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import normalize_title, sort_time
from tidewire.operators.duplicates import MIN_TITLE
from tidewire.plans.session import written
from tidewire.sources.buckets import BucketTable, Commit

TITLES = "t STRING, id BIGINT, source_key STRING, at TIMESTAMP_NTZ, normalized_url STRING"


def titled(articles: DataFrame, min_title: int = MIN_TITLE) -> DataFrame:
    """The rows of the table of titles of some articles."""
    rows = articles.select(normalize_title("title").alias("t"), "id", "source_key", sort_time().alias("at"), "normalized_url")
    return rows.where(F.length("t") >= min_title)


def marks(rows: DataFrame) -> DataFrame:
    """id, normalized_url, duplicate_of_id and duplicate_score of rows of titles, all that there are of each: null for the earliest
    of a title, and for titles of one source."""
    groups = rows.groupBy("t").agg(F.min(F.struct("at", F.coalesce("id", F.lit(0)).alias("k"), "id")).alias("first"), F.min("source_key").alias("s0"), F.max("source_key").alias("s1"))
    found = written(groups.where("s0 <> s1").select("t", F.col("first.id").alias("canonical_id")), "titles")
    other = F.col("canonical_id").isNotNull() & (F.col("canonical_id") != F.col("id"))
    return rows.join(found, "t", "left").select("id", "normalized_url", F.when(other, F.col("canonical_id")).alias("duplicate_of_id"), F.when(other, 1.0).alias("duplicate_score"))


def kept_up(articles: BucketTable, titles: BucketTable, changed: DataFrame, before: dict, min_title: int = MIN_TITLE) -> None:
    """Set the marks that a change of ``articles`` calls for. ``changed`` names its rows (normalized_url), ``before`` is the
    state of the articles before it. Read are the articles' buckets that the change met, the buckets of the titles that it
    touched, and the buckets of the articles whose marks change."""
    state = articles.state()
    urls = written(changed.select("normalized_url").distinct().withColumn("bucket", articles.bucket(state=state)), "urls")
    met = [r["bucket"] for r in urls.select("bucket").distinct().collect()]  # at most one row for each bucket
    rows = lambda of: titled(articles.read(met, of).join(urls.select("normalized_url"), "normalized_url", "left_semi"), min_title)
    own = titles.state()
    place = titles.bucket(state=own)
    old, new = written(rows(before).withColumn("bucket", place), "before"), written(rows(state).withColumn("bucket", place), "after")
    commit = Commit(titles, own)
    commit.add(new)
    commit.keep(written(old.select("bucket", "id").union(new.select("bucket", "id")).distinct(), "moved"), "id")
    commit.publish(own["at"])
    touched = written(old.select("bucket", "t").union(new.select("bucket", "t")).distinct(), "touched")
    some = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # at most one row for each bucket
    found = marks(titles.read(some).join(touched.select("t"), "t", "left_semi"))
    # an article whose title has become too short has no group any more
    short = urls.join(new.select("normalized_url"), "normalized_url", "left_anti").select(F.lit(None).cast("long").alias("id"), "normalized_url", F.lit(None).cast("long").alias("duplicate_of_id"), F.lit(None).cast("double").alias("duplicate_score"))
    found = written(found.unionByName(short).select("normalized_url", F.col("duplicate_of_id").alias("_of"), F.col("duplicate_score").alias("_score")).withColumn("bucket", articles.bucket(state=state)), "marks")
    where = [r["bucket"] for r in found.select("bucket").distinct().collect()]  # at most one row for each bucket
    stored = articles.read(where, state).drop("bucket").join(found.drop("bucket"), "normalized_url")
    other = stored.where(~F.col("duplicate_of_id").eqNullSafe(F.col("_of")))
    articles.replace(other.withColumns({"duplicate_of_id": F.col("_of"), "duplicate_score": F.col("_score")}).drop("_of", "_score"))
