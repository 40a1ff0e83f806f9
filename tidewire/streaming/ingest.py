"""Differential ingestion as a stream: landed articles are upserted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewire.operators.upsert import upsert_into
from tidewire.sources.store import Store


def landed(spark: SparkSession, folder: str, schema: T.StructType, files: int = 100) -> DataFrame:
    """Article files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def redelivered(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Without repeats of one URL and text within ``delay``. Off for exact parity: it hides A, B, A."""
    return stream.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["normalized_url", "content_hash"])


def into_store(store: Store, position: str = "position", stream: str = "articles") -> Callable[[DataFrame, int], None]:
    """A batch function that upserts into the store's articles. The manifest that makes a batch's rows known names the batch
    too, so one that comes again, as after a crash between the two, changes nothing; not even where it holds A, B, A."""

    def one(batch: DataFrame, number: int) -> None:
        upsert_into(store.bucketed(), batch, position, (stream, number))

    return one


def start(stream: DataFrame, store: Store, checkpoint: str, position: str = "position", name: str = "articles") -> StreamingQuery:
    """Process what has landed, then end. ``name`` is the stream's name in the store: one for each checkpoint."""
    return stream.writeStream.foreachBatch(into_store(store, position, name)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timed(stream: DataFrame) -> DataFrame:
    """``stream`` with at, the time by which windows are formed."""
    return stream.withColumn("at", F.coalesce("published_at", "fetched_at").cast("timestamp"))


def daily_counts(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """Articles of each source in each day, once the watermark has passed it."""
    return timed(stream).withWatermark("at", delay).groupBy(F.window("at", "1 day"), "source_key").agg(F.count("*").alias("articles"))


def count_days(stream: DataFrame, folder: str, checkpoint: str, delay: str = "2 days") -> list[dict]:
    """Append each day's counts to ``folder`` once the watermark has passed its end, of what has landed; then end. A day's
    row is final: articles that come later for it are dropped, and counted. The progress of the run's batches: number,
    watermark, rows read, and rows dropped as late (after the aggregation within a batch)."""
    days = daily_counts(stream, delay).select(F.to_date("window.start").alias("day"), "source_key", "articles")
    run = days.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return [{"batch": p["batchId"], "watermark": p["eventTime"].get("watermark"), "read": p["numInputRows"], "late": sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])} for p in run.recentProgress]
