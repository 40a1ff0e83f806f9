"""Tables of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions import text as X


ARTICLES = """id BIGINT, source_key STRING, url STRING, normalized_url STRING, title STRING, summary STRING, content STRING,
published_at TIMESTAMP_NTZ, published_offset STRING, fetched_at TIMESTAMP_NTZ, content_hash STRING, category STRING, author STRING,
tags ARRAY<STRING>, title_ja STRING, summary_ja STRING, ai_status STRING, ai_input_hash STRING, ai_model STRING,
ai_prompt_version STRING, ai_processed_at TIMESTAMP_NTZ, ai_error STRING, normalized_title STRING, duplicate_of_id BIGINT,
duplicate_score DOUBLE"""
SOURCES = """key STRING, name STRING, category STRING, fetch_method STRING, enabled BOOLEAN, base_url STRING, feed_url STRING,
list_url STRING, article_list_selector STRING, title_selector STRING, content_selector STRING, summary_selector STRING,
date_selector STRING, author_selector STRING, wait_selector STRING, encoding STRING, headers MAP<STRING,STRING>,
last_crawled_at TIMESTAMP_NTZ"""
RUNS = "id BIGINT, started_at TIMESTAMP_NTZ, finished_at TIMESTAMP_NTZ, total_sources BIGINT, success_count BIGINT, failed_count BIGINT, new_count BIGINT, updated_count BIGINT, status STRING"
RESULTS = "run_id BIGINT, source_key STRING, status STRING, article_count BIGINT, new_count BIGINT, updated_count BIGINT, error_message STRING, duration_seconds DOUBLE"
#: What a column holds where a stored row has no value.
DEFAULTS = {"summary": "", "content": "", "title_ja": "", "summary_ja": "", "ai_input_hash": "", "ai_model": "", "ai_status": "pending", "ai_prompt_version": "1"}


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def conformed(rows: DataFrame, ddl: str = ARTICLES, *more: Column) -> DataFrame:
    """``rows`` with the columns of a table, and ``more``: missing ones null, defaults and titles for matching filled in."""
    have = set(rows.columns)
    out = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(ddl)), *more)
    if ddl == ARTICLES:
        out = out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items()} | {"tags": F.coalesce("tags", F.array().cast("array<string>")), "normalized_title": F.coalesce("normalized_title", X.normalize_title(F.when(F.col("normalized_title").isNull(), F.col("title"))))})
    return out


def articles_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's documents as articles: first line as title, text as content, an hour for each id. Some have a
    summary, a translation, a mark as a duplicate, no date, or one that lies after their fetch."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id as int), 0, 0)")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("source_key"),
        F.col("lang").alias("category"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(F.col("doc_id") % 4 == 1, F.left("text", F.lit(500))).otherwise(F.lit("")).alias("summary"),
        F.col("text").alias("content"),
        F.when(F.col("doc_id") % 50 == 7, at + F.expr("INTERVAL 3 DAYS")).when(F.col("doc_id") % 10 != 0, at).alias("published_at"),
        (at + F.expr("INTERVAL 1 DAY")).alias("fetched_at"),
        F.when(F.col("quality").isNull(), F.lit("pending")).when(F.col("quality") == 1, F.lit("completed")).otherwise(F.lit("failed")).alias("ai_status"),
        F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(F.col("doc_id") % 9 == 4, F.col("doc_id") - 1).alias("duplicate_of_id"),
        F.when(F.col("doc_id") % 9 == 4, F.lit(1.0)).alias("duplicate_score"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("新モデル "), "source")).otherwise(F.lit("")).alias("title_ja"),
        F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("発表された\nモデル v"), F.col("doc_id").cast("string"))).otherwise(F.lit("")).alias("summary_ja"),
        F.lit(None).cast("string").alias("author"),
        F.when(F.col("quality") == 1, F.lit("model-a")).otherwise(F.lit("")).alias("ai_model"),
    )


# The same rows in DuckDB.
ARTICLES_SQL = """articles AS (
  SELECT d.doc_id AS id, d.source AS source_key, d.lang AS category, split_part(d.text, chr(10), 1) AS title, CASE WHEN d.doc_id % 4 = 1 THEN left(d.text, 500) ELSE '' END AS summary, d.text AS content,
    CASE WHEN d.doc_id % 50 = 7 THEN TIMESTAMP '2024-01-04' + d.doc_id * INTERVAL 1 HOUR WHEN d.doc_id % 10 <> 0 THEN TIMESTAMP '2024-01-01' + d.doc_id * INTERVAL 1 HOUR END AS published_at,
    TIMESTAMP '2024-01-02' + d.doc_id * INTERVAL 1 HOUR AS fetched_at,
    CASE WHEN l.quality IS NULL THEN 'pending' WHEN l.quality = 1 THEN 'completed' ELSE 'failed' END AS ai_status,
    'https://example.com/' || d.doc_id AS url, CASE WHEN d.doc_id % 9 = 4 THEN d.doc_id - 1 END AS duplicate_of_id, CASE WHEN d.doc_id % 9 = 4 THEN 1.0::DOUBLE END AS duplicate_score,
    CASE WHEN d.doc_id % 3 = 0 THEN '新モデル ' || d.source ELSE '' END AS title_ja, CASE WHEN d.doc_id % 6 = 0 THEN '発表された' || chr(10) || 'モデル v' || d.doc_id ELSE '' END AS summary_ja, CASE WHEN l.quality = 1 THEN 'model-a' ELSE '' END AS ai_model
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"""
