"""Digests: one Markdown file for each day, in <root>/<YYYY>/<YYYY-MM-DD>.md."""

from __future__ import annotations

from datetime import date
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.sources import files

# Texts of a digest.
COUNTS = "{0} のニュース {1} 件（AI要約済み {2} 件）。"
PREFIX, TAGS = "AI News", ["ai", "news", "daily"]


def _done() -> Column:
    return F.col("ai_status") == "completed"


def days(articles: DataFrame, only_summarized: bool = False) -> DataFrame:
    """day, items, done, models and n: what a digest counts, and all articles of the day."""
    shown = _done() if only_summarized else F.lit(True)
    models = F.array_sort(F.collect_set(F.when(_done() & (F.coalesce("ai_model", F.lit("")) != ""), F.col("ai_model"))))
    return articles.groupBy(X.article_date().alias("day")).agg(F.count_if(shown).alias("items"), F.count_if(_done()).alias("done"), models.alias("models"), F.count("*").alias("n"))


def _entries(articles: DataFrame, only_summarized: bool) -> DataFrame:
    """day, source_key, clock, id and line of every article that is shown."""
    rows = articles.where(_done()) if only_summarized else articles
    title = X.one_line(F.when(F.coalesce("title_ja", F.lit("")) != "", F.col("title_ja")).otherwise(F.coalesce("title", F.lit(""))))
    more = F.when(_done() & (F.coalesce("summary_ja", F.lit("")) != ""), F.concat(F.lit("\n  - "), X.one_line("summary_ja"))).otherwise(F.lit(""))
    line = F.concat(F.lit("- **"), X.clock(), F.lit("** ["), title, F.lit("]("), F.coalesce("url", F.lit("")), F.lit(")"), more)
    return rows.select(X.article_date().alias("day"), "source_key", X.clock().alias("clock"), F.coalesce("id", F.lit(0)).alias("id"), line.alias("line"))


def _named(groups: DataFrame, names: DataFrame | None) -> DataFrame:
    """``groups`` of sources with the headings of their sections."""
    if names is not None:
        groups = groups.join(F.broadcast(names.select(F.col("key").alias("source_key"), "name")), "source_key", "left")  # the configured sources
    else:
        groups = groups.withColumn("name", F.lit(None).cast("string"))
    return groups.withColumn("heading", F.concat(F.lit("## "), F.coalesce("name", "source_key", F.lit("")), F.lit("（"), F.col("n").cast("string"), F.lit("）")))


def bodies(articles: DataFrame, names: DataFrame | None = None, only_summarized: bool = False) -> DataFrame:
    """(day, body): sources by articles, then key; articles newest first, those without a time last."""
    lines = _entries(articles, only_summarized).select("day", "source_key", F.struct("clock", "id", "line").alias("x"))
    groups = lines.groupBy("day", "source_key").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("x"), asc=False), lambda x: x["line"]), "\n").alias("text"))
    part = F.struct((-F.col("n")).alias("n"), "source_key", F.concat("heading", F.lit("\n\n"), "text").alias("text"))
    return _named(groups, names).groupBy("day").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["text"]), "\n\n").alias("body"))


def rendered(articles: DataFrame, names: DataFrame | None = None, only_summarized: bool = False, prefix: str = PREFIX, tags: list[str] | None = None) -> DataFrame:
    """(day, n, done, text): the whole file of every day, for days that fit a row; ``write`` needs none."""
    both = days(articles, only_summarized).join(bodies(articles, names, only_summarized), "day", "left")
    text = F.concat(_head(prefix, tags), F.when(F.col("body").isNull(), F.lit("")).otherwise(F.concat(F.lit("\n\n"), "body")), F.lit("\n"))
    return both.select("day", "n", "done", text.alias("text"))


def _head(prefix: str, tags: list[str] | None) -> Column:
    """What stands before the sections, from a row of ``days``."""
    tag_lines = F.lit(yaml.safe_dump({"tags": tags or TAGS}, allow_unicode=True).rstrip())
    models = F.when(F.size("models") == 0, F.lit("llm_models: []")).otherwise(F.concat(F.lit("llm_models:\n"), F.array_join(F.transform("models", lambda m: F.concat(F.lit("- "), m)), "\n")))
    day = F.date_format("day", "yyyy-MM-dd")
    front = F.concat_ws("\n", F.lit("---"), F.concat(F.lit(f"title: {prefix} "), day), F.concat(F.lit("date: '"), day, F.lit("'")), F.concat(F.lit("total_articles: "), F.col("items").cast("string")), F.concat(F.lit("ai_summarized: "), F.col("done").cast("string")), tag_lines, models, F.lit("---"), F.lit(""))
    before, between, beyond = COUNTS.split("{1}")[0].split("{0}")[1], COUNTS.split("{1}")[1].split("{2}")[0], COUNTS.split("{2}")[1]
    counts = F.concat(day, F.lit(before), F.col("items").cast("string"), F.lit(between), F.col("done").cast("string"), F.lit(beyond))
    return F.concat(front, F.lit("\n"), counts)


def lines(articles: DataFrame, names: DataFrame | None = None, only_summarized: bool = False, prefix: str = PREFIX, tags: list[str] | None = None) -> DataFrame:
    """(file, text): the files of ``rendered`` as a row for each head, section and article, in the order of the files. No day and no
    section is gathered: they are dealt by ranges of their order, so a large day is several tasks' work."""
    counted = days(articles, only_summarized)
    entries = _entries(articles, only_summarized)
    groups = entries.groupBy("day", "source_key").agg(F.count("*").alias("n"))
    columns = ["day", "section", "more", "source_key", "entry", "clock", "id"]

    def rows(of: DataFrame, text: Column, **order: Column) -> DataFrame:
        empty = {"section": F.lit(1), "more": F.lit(0).cast("long"), "source_key": F.lit(""), "entry": F.lit(0), "clock": F.lit(""), "id": F.lit(0).cast("long")}
        return of.select("day", *((order.get(c, v)).alias(c) for c, v in empty.items()), text.alias("text"))

    heads = counted.where("done > 0") if only_summarized else counted
    group = {"more": F.col("n"), "source_key": F.coalesce("source_key", F.lit(""))}
    sections = rows(_named(groups, names), F.concat(F.lit("\n"), "heading", F.lit("\n")), **group)
    sized = entries.join(groups.withColumnsRenamed({"day": "_day", "source_key": "_key"}), F.col("day").eqNullSafe(F.col("_day")) & F.col("source_key").eqNullSafe(F.col("_key")))
    shown = rows(sized, F.col("line"), **group, entry=F.lit(1), clock=F.col("clock"), id=F.col("id").cast("long"))
    order = [F.col(c).desc() if c in ("more", "clock", "id") else F.col(c).asc() for c in columns]
    made = rows(heads, _head(prefix, tags), section=F.lit(0)).unionByName(sections).unionByName(shown).where(F.col("day").isNotNull())
    file = F.concat(F.date_format("day", "yyyy"), F.lit("/"), F.date_format("day", "yyyy-MM-dd"), F.lit(".md"))
    return made.repartitionByRange(*order).sortWithinPartitions(*order).select(file.alias("file"), "text")


def write(articles: DataFrame, root: str | Path, names: DataFrame | None = None, only_summarized: bool = False, day_range: tuple[date, date] | None = None, prefix: str = PREFIX, tags: list[str] | None = None) -> tuple[list[tuple[Path, int]], list[date]]:
    """Write the files; ((path, articles of the day), days out of range, which are left alone). Idempotent.
    Executors write the files; each is put into place whole, when all are written."""
    written, skipped = [], []
    if day_range is not None:
        inside = X.article_date().between(*day_range)
        skipped = [r[0] for r in articles.where(~inside).select(X.article_date().alias("day")).distinct().orderBy("day").collect()]  # one row for each day
        articles = articles.where(inside)
    files.write(lines(articles, names, only_summarized, prefix, tags), root)
    counted = days(articles, only_summarized).where(F.col("day").isNotNull())
    for r in (counted.where("done > 0") if only_summarized else counted).orderBy("day").select("day", "n").collect():  # one row for each day
        written.append((files.local(str(root)) / f"{r['day'].year}" / f"{r['day'].isoformat()}.md", r["n"]))
    return written, skipped
