"""Markdown report of a period's articles."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.operators import terms
from tidewire.operators.select import by_category, ranged
from tidewire.plans.period import label, resolve

# Texts of the report.
INTRO = "期間: **{0}** 〜 **{1}** に収集された AI 関連ニュース・動向レポートです。"
SUMMARY = ("## 📊 収集サマリー", "", "| カテゴリ | ソース数 | 記事数 |", "| --- | --- | --- |")
TOTAL, CATEGORY, COUNT, UNDATED = "合計", "## 📁 カテゴリ: ", "件", "日付不明"
PUBLISHED, AUTHOR, ABSTRACT = "- **公開日**: ", "- **著者**: ", "- **要約**: "
NOTHING = "指定された期間内に収集された新着記事はありませんでした。"
FREQUENCIES = "## 📈 単語頻度分析"
#: Of translated and of original texts: file of the picture, its title, and what stands there without any term.
CLOUDS = (
    ("wordcloud_ja.png", "日本語ワードクラウド", ("### 日本語分析", "分析対象となる日本語コンテンツ（AI処理済み記事）がありませんでした。")),
    ("wordcloud_original.png", "原文ワードクラウド", ("### 原文分析", "分析対象となる原文コンテンツがありませんでした。")),
)
DEFAULTS = {"title": "AI Trend Report", "title_template": "{title} ({date})", "tags": ["ai", "report", "trends"], "visualize": True, "top_n": 20, "output_assets_name": "assets", "wordcloud_width": 800, "wordcloud_height": 400}


def shown(own: str, original: str) -> Column:
    """The translated text of a completed article, else its own."""
    return F.when((F.coalesce(own, F.lit("")) != "") & (F.col("ai_status") == "completed"), F.col(own)).otherwise(F.col(original))


def listing(articles: DataFrame) -> DataFrame:
    """The report's entries: number within category and source, newest first."""
    n = F.row_number().over(Window.partitionBy("category", "source_key").orderBy(X.sort_time().desc(), "id"))
    return articles.select(
        "category",
        "source_key",
        n.alias("n"),
        "id",
        "url",
        X.category_title(F.col("category")).alias("category_title"),
        shown("title_ja", "title").alias("title"),
        X.preview(shown("summary_ja", "summary")).alias("summary"),
        F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit(UNDATED)).alias("day"),
        "author",
    )


def sections(articles: DataFrame) -> DataFrame:
    """(category, source_key, articles, body): each source's entries as text, put together in Spark."""
    author = F.when(F.coalesce("author", F.lit("")) != "", F.concat(F.lit(f"\n{AUTHOR}"), "author")).otherwise(F.lit(""))
    abstract = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(f"\n{ABSTRACT}"), "summary")).otherwise(F.lit(""))
    entry = F.concat(F.lit("#### "), F.col("n").cast("string"), F.lit(". ["), "title", F.lit("]("), "url", F.lit(")\n\n"), F.lit(f"{PUBLISHED}`"), "day", F.lit("`"), author, abstract, F.lit("\n"))
    entries = listing(articles).withColumn("entry", entry)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda x: x["entry"]), "\n")
    return entries.groupBy("category", "source_key").agg(F.first("category_title").alias("category_title"), F.count("*").alias("articles"), body.alias("body"))


def frequencies(articles: DataFrame, dictionary: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Term counts for the two word clouds: translated and original texts, each with the tags."""
    d = dictionary or {}
    stop, keep = d.get("stopwords_general", ()), d.get("ai_keywords", ())
    tags = terms.tag_counts(articles, stop)
    segment = terms.segment_of(d)
    return terms.added(terms.japanese_counts(articles, segment, stop, keep), tags), terms.added(terms.original_counts(articles, segment, stop, keep), tags)


def clouds(articles: DataFrame, output: Path, settings: dict, dictionary: dict | None = None) -> list[str]:
    """The lines of the section on word frequencies; its pictures go beside the report, into a folder of its name."""
    assets = output.parent / f"{output.stem}_{settings['output_assets_name']}"
    assets.mkdir(parents=True, exist_ok=True)
    lines = [FREQUENCIES, ""]
    has = (not terms.translated(articles).isEmpty(), True)
    for (name, title, without), counts, there in zip(CLOUDS, frequencies(articles, dictionary), has, strict=True):
        if not there or (name == CLOUDS[1][0] and counts.isEmpty()):
            lines += [*without, ""]
        elif word_cloud(counts, assets / name, settings["wordcloud_width"], settings["wordcloud_height"]):
            lines += [f"### {title}", f"![{title}]({assets.name}/{name})", ""]
    return lines


def title_of(settings: dict, start: datetime, end: datetime, mode: str, now: datetime) -> str:
    first, last = label(start, end)
    title = settings.get("title", DEFAULTS["title"])
    try:
        return settings.get("title_template", DEFAULTS["title_template"]).format(title=title, date=now.strftime("%Y-%m-%d"), mode=mode, period_start=first, period_end=last)
    except (KeyError, ValueError):
        return f"{title} ({now:%Y-%m-%d})"


def report(articles: DataFrame, days: int | None = None, start: str | None = None, end: str | None = None, period: str | None = None, category: str | None = None, without: list[str] | None = None, without_duplicates: bool = False, output: str | Path | None = None, settings: dict | None = None, now: datetime | None = None, dictionary: dict | None = None) -> str:
    """The report as Markdown, written to ``output`` if given. What reaches the driver is the report itself."""
    settings, now = DEFAULTS | (settings or {}), now or datetime.now()
    a, b, mode = resolve(days, start, end, period, now)
    rows = ranged(articles, a, b, category, without, without_duplicates)
    first, last = label(a, b)
    counted = by_category(rows).collect()
    groups = {r["category"]: r for r in counted if not r["total"]}
    total = next((r for r in counted if r["total"]), {"sources": 0, "articles": 0})
    front = {"title": title_of(settings, a, b, mode, now), "created": now.strftime("%Y-%m-%d %H:%M:%S"), "period": f"{first} ~ {last}", "total_articles": total["articles"], "tags": settings["tags"], "visualization": settings["visualize"], "analysis_top_n": settings["top_n"], "analysis_category": category, "period_mode": mode, "period_start": first, "period_end": last}
    lines = ["---", yaml.dump(front, allow_unicode=True, sort_keys=False).strip(), "---", "", INTRO.format(first, last), ""]
    if settings["visualize"] and output and total["articles"]:
        lines += clouds(rows, Path(output), settings, dictionary)
    lines += SUMMARY
    lines += [f"| **{c}** | {r['sources']} | {r['articles']} |" for c, r in sorted(groups.items())]
    lines += [f"| **{TOTAL}** | **{total['sources']}** | **{total['articles']}** |", ""]
    known = None
    for s in sections(rows).orderBy("category", "source_key").toLocalIterator():
        if s["category"] != known:
            known = s["category"]
            lines += [f"{CATEGORY}{s['category_title']}", ""]
        lines += [f"### 🌐 {s['source_key'].upper()} ({s['articles']} {COUNT})", "", s["body"]]
    if not total["articles"]:
        lines += [NOTHING, ""]
    text = "\n".join(lines)
    if output:
        Path(output).parent.mkdir(parents=True, exist_ok=True)
        Path(output).write_text(text, encoding="utf-8")
    return text


def word_cloud(counts: DataFrame, output: str | Path, width: int = 800, height: int = 400) -> bool:
    """A PNG of the 100 most frequent terms, where the drawing library is there; False if not, or without terms."""
    words = {r["term"]: r["cnt"] for r in terms.top(counts, 100).collect()}
    try:
        from wordcloud import WordCloud
    except ImportError:
        return False
    if not words:
        return False
    WordCloud(width=width, height=height, background_color="white", max_words=100, random_state=42).generate_from_frequencies(words).to_file(str(output))
    return True


def pie_chart(counts: DataFrame, output: str | Path, top_n: int = 20, title: str = "Word frequencies") -> bool:
    """A PNG of the shares of the most frequent terms, on the same terms."""
    rows = terms.shares(counts, top_n).orderBy(F.col("cnt").desc(), "term").collect()
    try:
        from matplotlib.figure import Figure
    except ImportError:
        return False
    if not rows:
        return False
    figure = Figure()
    axes = figure.subplots()
    axes.pie([r["cnt"] for r in rows], labels=[r["term"] for r in rows], autopct="%1.1f%%")
    axes.set_title(title)
    figure.savefig(output)
    return True
