"""Articles out of landed responses: feeds, pages, release and model lists.

``fetch`` fills the landing zone, or something else does, such as a browser for rendered pages; these readers
turn what was fetched into the one row shape. A response that can't be read gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions import text as X
from tidewire.plans.session import ship
from tidewire.sources.dom import Node, decoded, parse
from tidewire.sources.schema import conformed


@dataclass(frozen=True)
class Profile:
    """Selectors of a kind of page source, and how many links of a list page are followed."""

    links: str
    content: str
    dates: tuple[str, ...]
    most: int


STATIC = Profile("article a, main a, div.post a, div.article a", "article, main, div.entry-content, div.post-content", ('meta[property="article:published_time"]', 'meta[name="pubdate"]', "time"), 20)
RENDERED = Profile("article a, main a, h2 a, h3 a", "article, main, div[class*='content'], div[class*='post']", ('meta[property="article:published_time"]', "time"), 10)


@F.pandas_udf(T.StringType())
def _stripped_line(s):
    return s.map(lambda x: parse(x).text(" "), na_action="ignore")


@F.pandas_udf(T.StringType())
def _stripped_lines(s):
    return s.map(lambda x: parse(x).text("\n"), na_action="ignore")


def without_tags(c: Column, lines: bool = False) -> Column:
    """Text of HTML. Only what has a tag or a reference visits Python."""
    marked = c.rlike("[<&]")
    made = (_stripped_lines if lines else _stripped_line)(F.when(marked, c))
    return F.when(marked, made).otherwise(F.trim(c))


def finished(rows: DataFrame, fetched_at: Column | None = None) -> DataFrame:
    """Cleaned texts, canonical URL, hash, and rows without URL or title left out."""
    at = F.current_timestamp().cast("timestamp_ntz") if fetched_at is None else fetched_at
    made = rows.withColumns({c: X.clean_text(c) for c in ("title", "summary", "content")})
    made = made.withColumns({"normalized_url": X.normalize_url("url"), "content_hash": X.content_hash("title", "content"), "fetched_at": at})
    return conformed(made.where((F.col("url") != "") & (F.col("title") != "")))


# Feeds

_ITEM = "title STRING, link STRING, description STRING, `content:encoded` STRING, pubDate STRING, `dc:date` STRING, author STRING, `dc:creator` STRING, category ARRAY<STRING>"
_LINK = "STRUCT<_href: STRING, _rel: STRING>"
_ENTRY = f"title STRING, link ARRAY<{_LINK}>, summary STRING, content STRING, published STRING, updated STRING, created STRING, author STRUCT<name: STRING>, category ARRAY<STRUCT<_term: STRING>>"


def _first_date(*columns: str) -> Column:
    return F.coalesce(*(X.parse_datetime(c) for c in columns))


def feed(spark: SparkSession, path: str, source_key: str, category: str, fetched_at: Column | None = None) -> DataFrame:
    """Entries of RSS 2.0 and Atom files."""
    read = lambda tag, schema: ship(spark).read.format("xml").option("rowTag", tag).option("attributePrefix", "_").option("valueTag", "_value").schema(schema).load(path)
    rss = read("item", _ITEM).select("title", F.trim("link").alias("url"), F.col("description").alias("s"), F.col("`content:encoded`").alias("c"), _first_date("pubDate", "`dc:date`").alias("published_at"), F.coalesce("author", "`dc:creator`").alias("author"), F.coalesce("category", F.array().cast("array<string>")).alias("tags"))
    main = F.coalesce(F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), 0), F.get("link", 0))
    atom = read("entry", _ENTRY).select("title", main["_href"].alias("url"), F.col("summary").alias("s"), F.col("content").alias("c"), _first_date("published", "updated", "created").alias("published_at"), F.col("author.name").alias("author"), F.coalesce(F.col("category._term"), F.array().cast("array<string>")).alias("tags"))
    rows = rss.unionByName(atom)
    summary = F.coalesce(without_tags(F.col("s")), F.lit(""))
    made = rows.withColumn("summary", summary).withColumn("content", F.coalesce(F.nullif(without_tags(F.col("c"), True), F.lit("")), F.col("summary")))
    return finished(made.withColumns({"source_key": F.lit(source_key), "category": F.lit(category), "url": F.coalesce("url", F.lit("")), "title": F.coalesce("title", F.lit(""))}), fetched_at)


# Pages


def _chain(root: Node, *selectors: str | None) -> Node | None:
    return next((n for s in selectors if s and (n := root.first(s)) is not None), None)


def read_article(page: str, source: dict, profile: Profile) -> dict | None:
    """Fields of an article page, by the source's selectors, else by the profile's; None without a title."""
    root = parse(page)
    own = source.get("title_selector") and root.first(source["title_selector"])
    h1 = None if own else root.first("h1")
    head = own or h1 or root.first("title")  # an empty h1 keeps the title element from standing in
    title = head.text() if head else ""
    if not title:
        return None
    body = _chain(root, source.get("content_selector"), profile.content)
    content = body.text("\n") if body else ""
    short = source.get("summary_selector") and root.first(source["summary_selector"])
    meta = root.first('meta[name="description"], meta[property="og:description"]')
    summary = short.text() if short else (meta.attributes.get("content", "") if meta else "")
    if not summary and content:
        summary = content[:200] + "..." if len(content) > 200 else content
    stamp = source.get("date_selector") and root.first(source["date_selector"])
    date = (stamp.attributes.get("datetime") or stamp.text()) if stamp else ""
    for s in profile.dates:
        if not date and (n := root.first(s)):
            date = n.attributes.get("content") or n.attributes.get("datetime") or n.text()
    who = source.get("author_selector") and root.first(source["author_selector"])
    return {"title": title, "summary": summary, "content": content, "date": date or None, "author": (who.text() or None) if who else None}


def _texts(batch: pa.RecordBatch, encoding: str | None) -> Iterator[str]:
    for v in batch.column("body").to_pylist():
        yield decoded(v, encoding) if isinstance(v, bytes) else v or ""


def _links(selector: str, encoding: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, at, link = [], [], []
        for url, page in zip(batch.column("url").to_pylist(), _texts(batch, encoding), strict=True):
            for k, n in enumerate(parse(page).select(selector)):
                href = n.attributes.get("href", "").strip()
                if href and not href.startswith(("#", "javascript:")):
                    base.append(url)
                    at.append(k)
                    link.append(href)
        yield pa.RecordBatch.from_arrays([pa.array(base, pa.string()), pa.array(at, pa.int32()), pa.array(link, pa.string())], names=["page_url", "at", "href"])


def page_links(pages: DataFrame, source: dict | None = None, profile: Profile = STATIC) -> DataFrame:
    """page_url, rank, url and normalized_url: links of list pages (url, body), each once, in page order, the first ``profile.most``."""
    source = source or {}
    found = pages.select("url", "body").mapInArrow(partial(_links, source.get("article_list_selector") or profile.links, source.get("encoding")), "page_url string, at int, href string")
    whole = found.withColumn("url", X.join_url(F.col("page_url"), F.col("href"))).where(F.col("url").rlike("^http")).withColumn("normalized_url", X.normalize_url("url"))
    first = whole.groupBy("page_url", "normalized_url").agg(F.min(F.struct("at", "url")).alias("x")).select("page_url", "normalized_url", "x.at", "x.url")
    # two pages of one URL have links in the same places; these go by their text
    rank = F.row_number().over(Window.partitionBy("page_url").orderBy("at", "url", "normalized_url"))
    return first.withColumn("rank", rank).where(F.col("rank") <= profile.most).select("page_url", "rank", "url", "normalized_url")


def _articles(source: dict, profile: Profile, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("title", "summary", "content", "date", "author")
    for batch in batches:
        urls, made = [], []
        for url, page in zip(batch.column("url").to_pylist(), _texts(batch, source.get("encoding")), strict=True):
            if (fields := read_article(page, source, profile)) is not None:
                urls.append(url)
                made.append(fields)
        yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), *(pa.array([m[k] for m in made], pa.string()) for k in names)], names=["url", *names])


def page_articles(pages: DataFrame, source_key: str, category: str, source: dict | None = None, profile: Profile = STATIC, fetched_at: Column | None = None) -> DataFrame:
    """Articles of pages (url, body, and status if known; other than 200 gives no row)."""
    if "status" in pages.columns:
        pages = pages.where("status = 200")
    read = pages.select("url", "body").mapInArrow(partial(_articles, source or {}, profile), "url string, title string, summary string, content string, date string, author string")
    return finished(read.withColumns({"published_at": X.parse_datetime("date"), "source_key": F.lit(source_key), "category": F.lit(category)}), fetched_at)


# Lists of releases and models

_RELEASE = "name STRING, tag_name STRING, html_url STRING, body STRING, draft BOOLEAN, published_at STRING, author STRUCT<login: STRING>"
_MODEL = "modelId STRING, createdAt STRING, likes BIGINT, downloads BIGINT, tags ARRAY<STRING>, pipeline_tag STRING, library_name STRING"


def releases(spark: SparkSession, path: str, source_key: str, category: str, fetched_at: Column | None = None) -> DataFrame:
    """Releases of JSON lists; drafts are left out."""
    rows = ship(spark).read.schema(_RELEASE).json(path, multiLine=True).where(~F.coalesce("draft", F.lit(False)))
    body = X.clean_text("body")
    made = rows.select(F.coalesce(F.nullif("name", F.lit("")), "tag_name", F.lit("")).alias("title"), F.coalesce("html_url", F.lit("")).alias("url"), body.alias("content"), X.shortened(F.split_part(body, F.lit("\n"), F.lit(1))).alias("summary"), X.parse_datetime("published_at").alias("published_at"), F.col("author.login").alias("author"), F.when(F.coalesce("tag_name", F.lit("")) != "", F.array("tag_name")).otherwise(F.array().cast("array<string>")).alias("tags"))
    return finished(made.withColumns({"source_key": F.lit(source_key), "category": F.lit(category)}), fetched_at)


def models(spark: SparkSession, path: str, source_key: str, category: str, author: str | None = None, site: str = "https://huggingface.co", fetched_at: Column | None = None) -> DataFrame:
    """Models of JSON lists."""
    rows = ship(spark).read.schema(_MODEL).json(path, multiLine=True).where(F.coalesce("modelId", F.lit("")) != "")
    text = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c)))
    number = lambda label, c: F.when(F.col(c) > 0, F.concat(F.lit(f"{label}: "), F.col(c).cast("string")))
    tags = F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, F.concat(F.lit("Tags: "), F.array_join("tags", ", ")))
    made = rows.select(
        F.col("modelId").alias("title"),
        F.concat(F.lit(site + "/"), F.col("modelId")).alias("url"),
        F.concat_ws(" | ", text("Pipeline", "pipeline_tag"), text("Library", "library_name"), number("Likes", "likes"), number("Downloads", "downloads")).alias("summary"),
        F.concat_ws("\n", F.concat(F.lit("Model ID: "), F.col("modelId")), text("Pipeline Tag", "pipeline_tag"), text("Library", "library_name"), number("Likes", "likes"), number("Downloads", "downloads"), tags).alias("content"),
        X.parse_datetime("createdAt").alias("published_at"),
        F.lit(author).cast("string").alias("author"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )
    return finished(made.withColumns({"source_key": F.lit(source_key), "category": F.lit(category)}), fetched_at)


#: Readers by fetch method: (spark, path, source) -> articles.
READERS: dict[str, Callable[[SparkSession, str, dict], DataFrame]] = {
    "rss": lambda spark, path, s: feed(spark, path, s["key"], s.get("category", "")),
    "html": lambda spark, path, s: page_articles(ship(spark).read.parquet(path), s["key"], s.get("category", ""), s, STATIC),
    "playwright": lambda spark, path, s: page_articles(ship(spark).read.parquet(path), s["key"], s.get("category", ""), s, RENDERED),
    "github": lambda spark, path, s: releases(spark, path, s["key"], s.get("category", "")),
    "huggingface": lambda spark, path, s: models(spark, path, s["key"], s.get("category", ""), s.get("base_url", "").rstrip("/").split("huggingface.co/")[-1] or None),
}


def read_source(spark: SparkSession, path: str, source: dict) -> DataFrame:
    """Articles of what was landed for a source; feeds where it names no method."""
    return READERS.get(source.get("fetch_method") or "rss", READERS["rss"])(spark, path, source)
