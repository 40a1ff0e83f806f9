"""Queries of sources, runs, reports and settings by name, and DuckDB SQL of the same results.

Responses of sources are written from the driver's tables, then read as what was fetched.
"""

from __future__ import annotations

from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.operators import select, terms
from tidewire.operators.upsert import touch_sources, upsert_sources
from tidewire.plans import digest, report
from tidewire.plans.crawl import crawl
from tidewire.plans.period import label, resolve
from tidewire.plans.registry import AT, DAY, END, IN, ONE_LINE, SINCE, START, articles, query, stop_words, table, with_articles
from tidewire.plans.session import scratch
from tidewire.sources import config, landing
from tidewire.sources.schema import ARTICLES, SOURCES, conformed
from tidewire.sources.store import Store


def _at() -> F.Column:
    return F.lit(START).cast("timestamp_ntz")


@query(with_articles(f"SELECT id, {AT} AS sort_at FROM articles WHERE {SINCE} AND category = 'en' AND source_key = 'src3' ORDER BY sort_at DESC, id LIMIT 30"))
def recent_of_source(spark, sf_dir):
    """The newest of one category and source."""
    return select.recent(articles(spark, sf_dir), START, "en", "src3", 30).select("id", X.sort_time().alias("sort_at"))


@query(with_articles(f"SELECT id, source_key FROM articles WHERE {IN} AND source_key NOT IN ('src1', 'src2', 'src5')"))
def excluded_sources(spark, sf_dir):
    """A range without the sources that a command excludes and those that are off."""
    off = [{"key": "src5", "enabled": False}, {"key": "src2", "enabled": False}, {"key": "src6", "enabled": True}]
    return select.ranged(articles(spark, sf_dir), START, END, without=config.excluded(off, ["src2", "src1"])).select("id", "source_key")


# Feeds

#: Responses that the rows of a table are dealt to.
_PARTS = 16


def _items(docs: DataFrame) -> F.Column:
    """An RSS item for an even doc_id, an Atom entry for an odd one; one in seven has no link."""
    number = F.col("doc_id").cast("string")
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id as int), 0, 0)")
    link = F.when(F.col("doc_id") % 7 == 5, F.lit("")).otherwise(F.concat(F.lit("https://Example.com/a/"), number, F.lit("/?utm_source=x&amp;b=2&amp;a=1")))
    summary = F.concat(F.lit("&lt;p&gt;Big &lt;b&gt;"), "source", F.lit("&lt;/b&gt; news&lt;/p&gt;"))
    whole = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("&lt;p&gt;one&lt;/p&gt;&lt;p&gt;two "), number, F.lit("&lt;/p&gt;")))
    inside = lambda tag, c: F.coalesce(F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>")), F.lit(""))
    rss = F.concat(F.lit("<item>"), inside("title", F.concat(F.lit("Item "), number)), inside("link", link), inside("description", summary), inside("content:encoded", whole), inside("pubDate", F.concat(F.lit("Mon, "), F.date_format(at, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))), inside("author", "source"), inside("category", "lang"), inside("category", F.lit("AI")), F.lit("</item>"))
    atom = F.concat(F.lit("<entry>"), inside("title", F.concat(F.lit("Item "), number)), F.lit('<link rel="self" href="https://example.com/self"/><link rel="alternate" href="'), link, F.lit('"/>'), inside("summary", summary), inside("content", whole), inside("updated", F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))), F.lit("<author>"), inside("name", "source"), F.lit('</author><category term="'), "lang", F.lit('"/><category term="AI"/></entry>'))
    return F.when(F.col("doc_id") % 2 == 0, rss).otherwise(atom)


def _feeds(docs: DataFrame, folder: str) -> str:
    """Feeds of _PARTS parts of the documents: RSS of even ones, Atom of odd ones."""
    part = (F.col("doc_id") % _PARTS).alias("part")
    whole = docs.groupBy(part).agg(F.array_join(F.collect_list(_items(docs)), "").alias("x"))
    rss = F.concat(F.lit('<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>'), "x", F.lit("</channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), "x", F.lit("</feed>"))
    whole.select("part", F.when(F.col("part") % 2 == 0, rss).otherwise(atom).alias("value")).write.partitionBy("part").text(folder)
    return folder


_FEED = """e AS (SELECT doc_id, 'Item ' || doc_id AS title, 'https://example.com/a/' || doc_id || '?a=1&b=2' AS normalized_url, 'Big ' || source || ' news' AS summary,
  CASE WHEN doc_id % 3 = 0 THEN 'one' || chr(10) || 'two ' || doc_id ELSE 'Big ' || source || ' news' END AS content, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 HOUR AS published_at, source AS author, lang || ',AI' AS tags
  FROM documents WHERE doc_id % 7 <> 5)"""


@query(f"WITH {_FEED} SELECT title, normalized_url, summary, sha256(title || chr(10) || content) AS content_hash, published_at, author, tags FROM e")
def feed_articles(spark, sf_dir):
    """Entries of RSS and Atom feeds."""
    rows = landing.feed(spark, _feeds(table(spark, sf_dir, "documents"), scratch(spark, "feeds")), "feed", "tech", _at())
    return rows.select("title", "normalized_url", "summary", "content_hash", "published_at", "author", F.array_join("tags", ",").alias("tags"))


@query(
    """WITH n AS (SELECT unnest(['even', 'gone', 'odd']) AS source_key), c AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source_key, count(*) AS n FROM documents WHERE doc_id % 7 <> 5 GROUP BY 1)
SELECT run_id::BIGINT AS run_id, n.source_key, CASE WHEN n.source_key = 'gone' THEN 'failed' ELSE 'success' END AS status, coalesce(c.n, 0)::BIGINT AS article_count,
  CASE WHEN run_id = 1 THEN coalesce(c.n, 0) ELSE 0 END::BIGINT AS new_count, 0::BIGINT AS updated_count, 'partial' AS run_status FROM n LEFT JOIN c USING (source_key), (SELECT unnest([1, 2]) AS run_id)"""
)
def crawl_runs(spark, sf_dir):
    """Two runs over the same feeds, one source of which is gone; what the store says of them."""
    root = scratch(spark, "crawl")
    docs = table(spark, sf_dir, "documents")
    for key, rest in (("even", 0), ("odd", 1)):
        _feeds(docs.where(F.col("doc_id") % 2 == rest), f"{root}/landing/{key}")
    store = Store(spark, f"{root}/store")
    sources = [config.checked({"key": k, "category": "tech", "feed_url": "u"}) for k in ("even", "odd", "gone")]
    for _ in range(2):
        crawl(store, sources, f"{root}/landing")
    runs = store.read("crawl_runs").select(F.col("id").alias("run_id"), F.col("status").alias("run_status"))
    return store.read("crawl_results").join(F.broadcast(runs), "run_id").select("run_id", "source_key", "status", "article_count", "new_count", "updated_count", "run_status")  # one row for each run


# Lists of releases and models

def _responses(rows: DataFrame, folder: str) -> str:
    """JSON lists, one file for each of _PARTS parts of the events."""
    part = (F.col("event_id") % _PARTS).alias("part")
    rows.groupBy(part).agg(F.to_json(F.collect_list("x")).alias("value")).write.partitionBy("part").text(folder)
    return f"{folder}/*"


@query(
    """SELECT CASE WHEN event_id % 5 = 0 THEN 'v' || event_id ELSE 'Release ' || event_id END AS title, 'https://github.com/o/r/releases/' || event_id AS normalized_url,
  CASE WHEN event_id % 3 = 0 THEN repeat('x', 200) || '...' ELSE 'First ' || event_type END AS summary,
  sha256(CASE WHEN event_id % 5 = 0 THEN 'v' || event_id ELSE 'Release ' || event_id END || chr(10) || CASE WHEN event_id % 3 = 0 THEN repeat('x', 250) ELSE 'First ' || event_type || chr(10) || 'second' END) AS content_hash,
  date_trunc('second', ts) AS published_at, 'user' || user_id AS author, 'v' || event_id AS tags FROM events WHERE event_id % 11 <> 0"""
)
def release_articles(spark, sf_dir):
    """Releases without drafts."""
    n = F.col("event_id").cast("string")
    body = F.when(F.col("event_id") % 3 == 0, F.lit("x" * 250)).otherwise(F.concat(F.lit("First  "), "event_type", F.lit("\r\nsecond ")))
    made = F.struct(F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("Release "), n)).alias("name"), F.concat(F.lit("v"), n).alias("tag_name"), F.concat(F.lit("https://github.com/o/r/releases/"), n).alias("html_url"), body.alias("body"), (F.col("event_id") % 11 == 0).alias("draft"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"), F.struct(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("login")).alias("author"))
    path = _responses(table(spark, sf_dir, "events").withColumn("x", made), scratch(spark, "releases"))
    return landing.releases(spark, path, "oss", "oss", _at()).select("title", "normalized_url", "summary", "content_hash", "published_at", "author", F.array_join("tags", ",").alias("tags"))


_SAID = "concat_ws('{0}', {1}CASE WHEN event_id % 2 = 0 THEN '{2}: ' || event_type END, 'Library: lib', CASE WHEN user_id % 4 > 0 THEN 'Likes: ' || user_id % 4 END, CASE WHEN event_id > 0 THEN 'Downloads: ' || event_id END{3})"


@query(
    f"""SELECT 'org/m' || event_id AS title, 'https://huggingface.co/org/m' || event_id AS url, {_SAID.format(" | ", "", "Pipeline", "")} AS summary,
  sha256('org/m' || event_id || chr(10) || {_SAID.format("§", "'Model ID: org/m' || event_id, ", "Pipeline Tag", ", CASE WHEN event_id % 5 > 0 THEN 'Tags: ' || event_type || ', x' END").replace("'§'", "chr(10)")}) AS content_hash, date_trunc('second', ts) AS published_at, 'org' AS author
  FROM events WHERE event_id % 9 <> 0"""
)
def model_articles(spark, sf_dir):
    """Models that have an id."""
    n = F.col("event_id")
    made = F.struct(F.when(n % 9 > 0, F.concat(F.lit("org/m"), n.cast("string"))).alias("modelId"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.000Z'").alias("createdAt"), (F.col("user_id") % 4).alias("likes"), n.alias("downloads"), F.when(n % 5 > 0, F.array("event_type", F.lit("x"))).alias("tags"), F.when(n % 2 == 0, F.col("event_type")).alias("pipeline_tag"), F.lit("lib").alias("library_name"))
    path = _responses(table(spark, sf_dir, "events").withColumn("x", made), scratch(spark, "models"))
    return landing.models(spark, path, "hf", "oss", "org", fetched_at=_at()).select("title", "url", "summary", "content_hash", "published_at", "author")


# Sources


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source for each one of the documents."""
    number = F.substring("key", 4, 9).cast("int")
    keys = table(spark, sf_dir, "documents").select(F.col("source").alias("key")).distinct().withColumn("k", number)
    made = keys.withColumns({"name": F.concat(F.lit("Source "), F.col("k").cast("string")), "category": F.lit("tech"), "fetch_method": F.lit("rss"), "enabled": F.col("k") % 3 > 0, "base_url": F.concat(F.lit("https://e.com/"), "key"), "feed_url": F.when(F.col("k") % 2 == 0, F.lit("https://e.com/feed")).otherwise(F.lit("")), "list_url": F.when(F.col("k") % 4 == 1, F.lit("https://e.com/list")), "last_crawled_at": F.when(F.col("k") % 5 == 0, _at())})
    return conformed(made, SOURCES)


_SOURCES = """s AS (SELECT DISTINCT source AS key, substr(source, 4)::INTEGER AS k FROM documents)"""


@query(f"WITH {_SOURCES} SELECT key, 'Source ' || k AS name, k % 3 > 0 AS enabled, CASE WHEN k % 2 = 0 THEN 'https://e.com/feed' WHEN k % 4 = 1 THEN 'https://e.com/list' ELSE 'https://e.com/' || key END AS address FROM s")
def listed_sources(spark, sf_dir):
    """Sources with the address that is shown."""
    return select.listed(_sources(spark, sf_dir)).select("key", "name", "enabled", "address")


@query(f"WITH {_SOURCES} SELECT key, CASE WHEN k % 2 = 1 THEN 'New ' || k ELSE 'Source ' || k END AS name, CASE WHEN k % 5 = 0 THEN TIMESTAMP '2024-01-08' END AS last_crawled_at FROM s UNION ALL SELECT 'extra', 'Extra', NULL")
def upserted_sources(spark, sf_dir):
    """K2: the incoming configuration holds, the time of the last crawl stays."""
    stored = _sources(spark, sf_dir)
    number = F.substring("key", 4, 9).cast("int")
    incoming = stored.where(number % 2 == 1).withColumns({"name": F.concat(F.lit("New "), number.cast("string")), "last_crawled_at": F.lit(None).cast("timestamp_ntz")})
    extra = conformed(spark.createDataFrame([("extra", "Extra")], "key string, name string"), SOURCES)
    return upsert_sources(stored, incoming.unionByName(extra)).select("key", "name", "last_crawled_at")


@query(f"WITH {_SOURCES}, g AS (SELECT DISTINCT 'src' || user_id % 20 AS key FROM events WHERE value >= 40) SELECT s.key, CASE WHEN g.key IS NOT NULL THEN TIMESTAMP '2024-02-05' WHEN k % 5 = 0 THEN TIMESTAMP '2024-01-08' END AS last_crawled_at FROM s LEFT JOIN g ON s.key = g.key")
def touched_sources(spark, sf_dir):
    """Sources whose crawl succeeded have its time; events stand for results."""
    results = table(spark, sf_dir, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_key"), F.when(F.col("value") >= 40, F.lit("success")).otherwise(F.lit("failed")).alias("status"))
    return touch_sources(_sources(spark, sf_dir), results, END).select("key", "last_crawled_at")


@query("SELECT doc_id AS id, source AS source_key FROM documents WHERE substr(source, 4)::INTEGER % 3 = 0")
def orphaned_articles(spark, sf_dir):
    """Articles whose source isn't there."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_key"))
    return select.orphans(rows, "source_key", _sources(spark, sf_dir).where("enabled"), "key").select("id", "source_key")


@query("SELECT doc_id AS id, '' AS summary, 'pending' AS ai_status, '1' AS ai_prompt_version, '' AS ai_model, '' AS title_ja, 'Titel' || doc_id AS normalized_title, 0 AS n_tags, CAST(NULL AS VARCHAR) AS author FROM documents")
def migrated_articles(spark, sf_dir):
    """Rows of an older table get the columns that it lacks, with their defaults."""
    old = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit(" Ｔitel "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"))
    return conformed(old, ARTICLES).select("id", "summary", "ai_status", "ai_prompt_version", "ai_model", "title_ja", "normalized_title", F.size("tags").alias("n_tags"), "author")


# Reports and digests


@query(
    with_articles(
        "SELECT category, source_key, count(*) AS articles, string_agg('#### ' || n || '. [' || title || '](' || url || ')' || chr(10) || chr(10) || '- **公開日**: `' || day || '`' || CASE WHEN summary <> '' THEN chr(10) || '- **要約**: ' || summary ELSE '' END || chr(10), chr(10) ORDER BY n) AS body FROM e GROUP BY category, source_key",
        f"""e AS (SELECT category, source_key, row_number() OVER (PARTITION BY category, source_key ORDER BY {AT} DESC, id) AS n, url, CASE WHEN title_ja <> '' AND ai_status = 'completed' THEN title_ja ELSE title END AS title,
  left(replace(CASE WHEN summary_ja <> '' AND ai_status = 'completed' THEN summary_ja ELSE summary END, chr(10), ' '), 300) AS summary, coalesce(strftime(published_at, '%Y-%m-%d'), '日付不明') AS day FROM articles WHERE {IN})""",
    )
)
def report_sections(spark, sf_dir):
    """The text of each source in a report."""
    return report.sections(select.ranged(articles(spark, sf_dir), START, END)).select("category", "source_key", "articles", "body")


def _counted(text: str, rows: str, stop: str, keep: str = "TRUE") -> str:
    return f"SELECT term, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all({text}, '[\\p{{Han}}々]+|[\\p{{Katakana}}ー]+|[A-Za-z0-9][A-Za-z0-9.-]*')) AS term FROM {rows}) WHERE length(term) > 1 AND NOT regexp_matches(term, '^[0-9.]+$') AND lower(term) NOT IN ({stop}) AND {keep} GROUP BY term"


_KEEP = ("モデル", "the", "v6", "and", "gpt")


@query(
    with_articles(
        "SELECT 'ja' AS kind, term, sum(cnt)::BIGINT AS cnt FROM (SELECT * FROM j UNION ALL SELECT * FROM tc) GROUP BY term UNION ALL SELECT 'original', term, sum(cnt)::BIGINT FROM (SELECT * FROM o UNION ALL SELECT * FROM tc) GROUP BY term",
        "j AS (" + _counted("title_ja || ' ' || summary_ja", "articles WHERE ai_status = 'completed' AND (title_ja <> '' OR summary_ja <> '')", "'and', 'click'", f"term IN {_KEEP}") + ")",
        "o AS (" + _counted("title || ' ' || summary || ' ' || content", "articles", "'and', 'click'", f"term IN {_KEEP}") + ")",
        f"tg AS (SELECT lower(unnest(['AI', category, 'Click', 'The'])) AS term FROM articles), tc AS (SELECT term, count(*) AS cnt FROM tg WHERE length(term) > 1 AND term NOT IN ('and', 'click') AND term NOT IN ({stop_words()}) GROUP BY term)",
    )
)
def report_terms(spark, sf_dir):
    """The terms of a report's two pictures: of translated and of original texts, each with the tags."""
    rows = articles(spark, sf_dir).withColumn("tags", F.array(F.lit("AI"), "category", F.lit("Click"), F.lit("The")))
    japanese, original = report.frequencies(rows, {"stopwords_general": {"and", "click"}, "ai_keywords": set(_KEEP)})
    return japanese.withColumn("kind", F.lit("ja")).unionByName(original.withColumn("kind", F.lit("original"))).select("kind", "term", "cnt")


@query("WITH t AS (SELECT event_type AS term, count(*) AS cnt FROM events GROUP BY 1 ORDER BY cnt DESC, term LIMIT 3) SELECT term, cnt, cnt / (SELECT sum(cnt) FROM t) AS share FROM t")
def chart_shares(spark, sf_dir):
    """The shares of a chart's most frequent terms."""
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("term")).agg(F.count("*").alias("cnt"))
    return terms.shares(counts, 3)


_DAYS = (date(2024, 1, 5), date(2024, 1, 20))


_DIGESTS = (
    "SELECT d.day, n, done, '---' || chr(10) || 'title: AI News ' || d.day || chr(10) || 'date: ''' || d.day || '''' || chr(10) || 'total_articles: ' || done || chr(10) || 'ai_summarized: ' || done || chr(10) || 'tags:' || chr(10) || '- ai' || chr(10) || '- news' || chr(10) || '- daily' || chr(10) || "
    "CASE WHEN done = 0 THEN 'llm_models: []' ELSE 'llm_models:' || chr(10) || '- model-a' END || chr(10) || '---' || chr(10) || chr(10) || d.day || ' のニュース ' || done || ' 件（AI要約済み ' || done || ' 件）。' || coalesce(chr(10) || chr(10) || body, '') || chr(10) AS text FROM d LEFT JOIN b USING (day)"
)
_DIGEST_TABLES = (
    f"x AS (SELECT *, {DAY} AS day FROM articles WHERE {DAY} BETWEEN DATE '{_DAYS[0]}' AND DATE '{_DAYS[1]}')",
    "d AS (SELECT day, count(*) AS n, count(*) FILTER (WHERE ai_status = 'completed') AS done FROM x GROUP BY day)",
    f"""y AS (SELECT day, source_key, id, CASE WHEN published_at::DATE = day THEN strftime(published_at, '%H:%M') ELSE '--:--' END AS clock, '** [' || {ONE_LINE.format("CASE WHEN title_ja <> '' THEN title_ja ELSE title END")} || '](' || url || ')' ||
  CASE WHEN summary_ja <> '' THEN chr(10) || '  - ' || {ONE_LINE.format("summary_ja")} ELSE '' END AS line FROM x WHERE ai_status = 'completed')""",
    "g AS (SELECT day, source_key, count(*) AS n, string_agg('- **' || clock || line, chr(10) ORDER BY clock DESC, id DESC) AS txt FROM y GROUP BY day, source_key)",
    "b AS (SELECT day, string_agg('## ' || CASE WHEN substr(source_key, 4)::INTEGER % 3 > 0 THEN 'Source ' || substr(source_key, 4) ELSE source_key END || '（' || n || '）' || chr(10) || chr(10) || txt, chr(10) || chr(10) ORDER BY n DESC, source_key) AS body FROM g GROUP BY day)",
)


@query(with_articles(_DIGESTS, *_DIGEST_TABLES))
def digest_files(spark, sf_dir):
    """Files of the days of a range, of summarized articles, with the names of the sources that have one."""
    rows = articles(spark, sf_dir).where(X.article_date().between(*_DAYS))
    return digest.rendered(rows, _sources(spark, sf_dir).where("enabled").select("key", "name"), True)


@query(with_articles(f"SELECT day, text FROM ({_DIGESTS}) WHERE done > 0", *_DIGEST_TABLES))
def digest_written(spark, sf_dir):
    """The same files as executors write them, read back."""
    root = scratch(spark, "digests")
    digest.write(articles(spark, sf_dir), root, _sources(spark, sf_dir).where("enabled").select("key", "name"), True, _DAYS)
    texts = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    return texts.select(F.to_date(F.regexp_extract("value", "date: '(.{10})'", 1)).alias("day"), F.col("value").alias("text"))


_PERIOD = "event_id LONG, mode STRING, start_at TIMESTAMP_NTZ, end_at TIMESTAMP_NTZ, first_day STRING, last_day STRING, title STRING, tags STRING"


def _periods(batches):
    """The period of a report at the time of each event, by the choice that its number makes, its labels, title and tags."""
    names = [c.split()[0] for c in _PERIOD.split(", ")]
    for batch in batches:
        rows = []
        for event, now, kind in zip(*(batch.column(c).to_pylist() for c in ("event_id", "now", "event_type")), strict=True):
            chosen = ({}, {"period": "week"}, {"period": "quarter"}, {"start": f"{now.date() - timedelta(days=5)}", "end": f"{now.date()}"})[event % 4]
            a, b, mode = resolve(now=now, **chosen)
            title = report.title_of({"title": "Weekly", "title_template": "{title} {mode} ({date})"}, a, b, mode, now)
            rows.append((event, mode, a, b, *label(a, b), title, ",".join(config.tag_option([f"{kind}, b", "b", f"c,{kind}"]))))
        yield pa.RecordBatch.from_pydict({c: [r[k] for r in rows] for k, c in enumerate(names)}, pa.schema([(c, pa.int64() if c == "event_id" else pa.timestamp("us") if c.endswith("_at") else pa.string()) for c in names]))


@query(
    """WITH e AS (SELECT event_id, event_type, ts, CASE event_id % 4 WHEN 0 THEN 'days' WHEN 1 THEN 'week' WHEN 2 THEN 'quarter' ELSE 'date_range' END AS mode,
  CASE event_id % 4 WHEN 3 THEN date_trunc('day', ts)::TIMESTAMP - INTERVAL 5 DAY WHEN 2 THEN ts - INTERVAL 90 DAY ELSE ts - INTERVAL 7 DAY END AS start_at, CASE event_id % 4 WHEN 3 THEN date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY ELSE ts END AS end_at FROM events)
SELECT event_id, mode, start_at, end_at, strftime(start_at, '%Y-%m-%d') AS first_day, strftime(end_at - INTERVAL 1 SECOND, '%Y-%m-%d') AS last_day, 'Weekly ' || mode || ' (' || strftime(ts, '%Y-%m-%d') || ')' AS title, event_type || ',b,c' AS tags FROM e"""
)
def report_periods(spark, sf_dir):
    """the period that a report of each event's time looks back on, with its labels, title and tags."""
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("now"), "event_type").mapInArrow(_periods, _PERIOD)


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || '|é \"b\"' WHEN 1 THEN '' ELSE '' END AS tags FROM events")
def tags_of_json(spark, sf_dir):
    """tags as JSON text and back; malformed or missing text has none."""
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.to_json(F.array("event_type", F.lit('é "b"')))).when(F.col("event_id") % 3 == 1, F.lit('["broken'))
    return e.select("event_id", F.array_join(X.tags_of_json(text), "|").alias("tags"))
