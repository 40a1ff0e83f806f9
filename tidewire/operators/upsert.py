"""Upsert by canonical URL with change detection by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.plans.session import written
from tidewire.sources.buckets import BucketTable, Commit
from tidewire.sources.schema import ARTICLES, SOURCES, conformed

#: Changed URLs that are broadcast to stored rows.
FEW = 100_000

#: Columns that a changed text replaces.
CONTENT = ("title", "summary", "content", "category", "tags", "content_hash", "normalized_title", "fetched_at")
#: Columns that a changed text replaces where it has a value.
KNOWN = ("published_at", "published_offset", "author")
#: Columns that a changed text clears, and to what.
CLEARED = {"title_ja": "''", "summary_ja": "''", "ai_input_hash": "''", "ai_model": "''", "ai_status": "'pending'", "ai_processed_at": "CAST(NULL AS TIMESTAMP_NTZ)", "ai_error": "CAST(NULL AS STRING)", "duplicate_of_id": "CAST(NULL AS BIGINT)", "duplicate_score": "CAST(NULL AS DOUBLE)"}


NARROW = ("normalized_url", "content_hash", "id", "source_key", "url", "ai_prompt_version", *KNOWN, "_pos")


def arrived(incoming: DataFrame, position: str = "position") -> DataFrame:
    """Incoming rows with the columns of the table and _pos, the order of arrival."""
    return conformed(incoming.drop("id"), ARTICLES, F.col(position).cast("long").alias("_pos"))


def folded(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both tables that count, of the URLs that come in: without texts, in order of arrival by URL.

    Rows of one URL are folded in that order, the stored row first, whose _pos is -1: a row counts if its
    hash differs from that of the row before it. ``_new`` says that it makes its URL known. The rows are narrow, and
    written once for all that is made of them.
    """
    met = stored.join(new.select("normalized_url").distinct(), "normalized_url", "left_semi").withColumn("_pos", F.lit(-1).cast("long"))
    w = Window.partitionBy("normalized_url").orderBy("_pos")
    rows = met.select(*NARROW).unionByName(new.select(*NARROW))
    rows = rows.withColumn("_last", F.lag("content_hash").over(w)).where("_last is null or _last <> content_hash")
    return written(rows.withColumn("_new", F.col("_last").isNull() & (F.col("_pos") >= 0)).drop("_last"), "folded")


def counted(rows: DataFrame, by: str) -> DataFrame:
    """``by``, new_count and updated_count of folded rows: how many incoming ones of each make a URL known, or change its text."""
    return rows.where("_pos >= 0").groupBy(by).agg(F.count_if("_new").alias("new_count"), F.count_if(~F.col("_new")).alias("updated_count"))


def effects(stored: DataFrame, incoming: DataFrame, by: str, position: str = "position") -> DataFrame:
    """What ``counted`` gives for incoming rows on a table."""
    return counted(folded(conformed(stored), arrived(incoming, position)), by)


def held(rows: DataFrame) -> DataFrame:
    """One row for each URL that changes, of folded rows: the first row's id and names, the last values that are known,
    and the place of the row whose text holds."""
    first = F.min_by(F.struct("id", "source_key", "url", "ai_prompt_version"), "_pos")
    known = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("_pos"))).alias(c)
    urls = rows.groupBy("normalized_url").agg(first.alias("_first"), *(known(c) for c in KNOWN), F.max("_pos").alias("_pos"), F.min("_pos").alias("_at"), F.count("*").alias("_n")).where("_pos >= 0")
    return urls.select("normalized_url", "_pos", "_at", (F.col("_n") - 1).alias("updated_count"), (F.col("_at") < 0).alias("_old"), *(F.col(f"_first.{c}").alias(c) for c in ("id", "source_key", "url", "ai_prompt_version")), *KNOWN)


def made(urls: DataFrame, new: DataFrame, largest: DataFrame) -> DataFrame:
    """The rows of ``held`` URLs with their texts, as they are stored, with action and counts. Ids of new ones go on from
    ``largest``, a row with _max."""
    return _numbered(urls, largest).join(new.select("normalized_url", "_pos", *CONTENT), ["normalized_url", "_pos"]).select(
        "normalized_url",
        "id",
        "source_key",
        "url",
        "ai_prompt_version",
        *CONTENT,
        *KNOWN,
        *(F.expr(v).alias(c) for c, v in CLEARED.items()),
        F.when(F.col("_old"), F.lit("update")).otherwise(F.lit("insert")).alias("action"),
        F.when(F.col("_old"), 0).otherwise(1).cast("long").alias("new_count"),
        "updated_count",
    )


def upsert(stored: DataFrame, incoming: DataFrame, position: str = "position") -> DataFrame:
    """The new table with an ``action``, ``new_count`` and ``updated_count`` for each row.

    ``incoming`` has ``position``, the order of arrival. Which row of a URL holds is found without texts;
    stored rows that nothing changes are passed on as they are, and only the rows that hold bring theirs.
    Ids go on from the largest stored one, in order of arrival. The narrow rows that decide are written when this
    is called. Changed URLs are broadcast to the stored rows where they are few, else both are shuffled; ``upsert_into``
    moves no stored text.
    """
    old, new = conformed(stored), arrived(incoming, position)
    urls = written(held(folded(old, new)), "held")
    few = urls.select("normalized_url")
    gone = F.broadcast(few) if few.count() <= FEW else few
    kept = old.join(gone, "normalized_url", "left_anti").withColumns({"action": F.lit("unchanged"), "new_count": F.lit(0).cast("long"), "updated_count": F.lit(0).cast("long")})
    return kept.unionByName(made(urls, new, old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_max"))))


def upsert_into(table: BucketTable, incoming: DataFrame, position: str = "position", batch: tuple[str, int] | None = None) -> DataFrame:
    """Upsert into a stored table; the folded rows, of which ``counted`` makes the counts.

    Whatever makes the batch's rows makes them twice: once for the narrow columns, which are written and decide all, and once
    for the texts that hold. Only buckets that a batch meets are read, narrow columns first, and only those in which a URL changes are written
    again; where none does, the commit is a manifest alone. Their other rows are passed on without a shuffle. With ``batch``, a stream's name and the number of its batch, a
    batch that was taken in before changes nothing: the table's manifest, which makes the rows known, names it too.
    """
    state, new = table.state(), arrived(incoming, position)
    if batch and table.batch_done(*batch):
        return folded(table.read([], state), new.where("false"))
    narrow = written(new.select(*NARROW, table.bucket(state=state).alias("bucket")), "arrived")
    met = [r["bucket"] for r in narrow.select("bucket").distinct().collect()]  # at most one row for each bucket
    rows = folded(table.read(met, state), narrow)
    urls = written(held(rows).withColumn("bucket", table.bucket(state=state)), "held")
    commit = Commit(table, state)
    if not urls.isEmpty():
        largest = table.spark.range(0, 1, 1, 1).select(F.lit(state["max_id"]).cast("long").alias("_max"))
        commit.add(made(urls.drop("bucket"), new, largest), True)
        commit.keep(urls.select("bucket", "normalized_url"), "normalized_url")
    commit.publish(state["at"], batch=batch)
    return rows


def _numbered(urls: DataFrame, largest: DataFrame) -> DataFrame:
    """Ids for new URLs: parts of the arrival order get a base by prefix sum, so no task sees all of them."""
    part = F.floor(F.col("_at") / 100_000)
    fresh = urls.where("_at >= 0").withColumn("_part", part)
    sizes = fresh.groupBy("_part").agg(F.count("*").alias("_n"))
    bases = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))  # one row for each 100,000 new ones
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_at", "normalized_url"))
    named = fresh.withColumn("_rank", rank).join(bases, "_part").crossJoin(F.broadcast(largest)).withColumn("id", F.col("_max") + F.col("_base") + F.col("_rank"))  # one row
    return named.drop("_max", "_base", "_rank", "_part").unionByName(urls.where("_at < 0"))


def upsert_sources(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Sources by key: the incoming configuration, the stored time of the last crawl."""
    old, new = conformed(stored, SOURCES), conformed(incoming, SOURCES).dropDuplicates(["key"])
    times = old.select("key", F.col("last_crawled_at").alias("_at"))
    merged = new.drop("last_crawled_at").join(times, "key", "left").withColumnRenamed("_at", "last_crawled_at")
    return old.join(new.select("key"), "key", "left_anti").unionByName(merged)


def touch_sources(sources: DataFrame, results: DataFrame, at) -> DataFrame:
    """Sources with the time of the crawl where it succeeded."""
    good = results.where("status = 'success'").select(F.col("source_key").alias("key"), F.lit(True).alias("_good")).distinct()
    return sources.join(good, "key", "left").withColumn("last_crawled_at", F.when(F.col("_good"), F.lit(at).cast("timestamp_ntz")).otherwise(F.col("last_crawled_at"))).drop("_good")
