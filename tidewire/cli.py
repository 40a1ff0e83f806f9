"""Command line: crawl, report, enrich, search, dedupe, list-sources, stats, digest, extract-keywords."""

from __future__ import annotations

import argparse
from datetime import datetime, timedelta

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewire.operators import duplicates, enrich, select, terms
from tidewire.plans import crawl, digest, report
from tidewire.plans.period import resolve
from tidewire.sources import config
from tidewire.sources.store import Store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewire", description=__doc__)
    top.add_argument("--store", default="data/store", help="folder of the tables")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *, dates: bool = False) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        c.add_argument("-f", "--sources-file")
        c.add_argument("--config-dir", default="config")
        if dates:
            c.add_argument("-d", "--days", type=int)
            c.add_argument("--start-date")
            c.add_argument("--end-date")
            c.add_argument("-p", "--period", choices=["week", "month", "quarter"])
        return c

    c = command("crawl")
    c.add_argument("-s", "--source")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--landing", help="folder of what was fetched before, one folder a source; without it, sources are fetched")
    c = command("report", dates=True)
    c.add_argument("--title")
    c.add_argument("--tags", action="append", default=[])
    c.add_argument("-c", "--category")
    c.add_argument("--exclude-source", action="append", default=[])
    c.add_argument("--exclude-duplicates", action="store_true")
    c.add_argument("-o", "--output")
    c.add_argument("--visualize", action=argparse.BooleanOptionalAction, default=None)
    c.add_argument("--top-n", type=int, choices=range(10, 51), metavar="10..50")
    c = command("enrich")
    c.add_argument("-d", "--days", type=int, default=7)
    c.add_argument("-l", "--limit", type=int, default=50)
    c.add_argument("--retry-failed", action="store_true")
    c.add_argument("--reprocess-stale", action="store_true")
    c.add_argument("--llm")
    c = command("search")
    c.add_argument("query")
    c.add_argument("-c", "--category")
    c.add_argument("-l", "--limit", type=int, default=10)
    c = command("dedupe", dates=True)
    c.add_argument("--min-title-len", type=int, default=duplicates.MIN_TITLE)
    c.add_argument("--apply", action="store_true")
    c.add_argument("--dry-run", dest="apply", action="store_false")
    command("list-sources")
    command("stats")
    c = command("digest", dates=True)
    c.add_argument("--only-summarized", action="store_true")
    c.add_argument("--exclude-duplicates", action=argparse.BooleanOptionalAction, default=True)
    c.add_argument("-o", "--output", default="digests")
    c = command("extract-keywords", dates=True)
    c.add_argument("--min-count", type=int, default=2)
    c.add_argument("--top-n", type=int, default=50)
    c.add_argument("--keywords-path")
    c.add_argument("--append", action="store_true")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None, client: enrich.Client | None = None) -> int:
    o = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("tidewire").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store, settings = Store(spark, o.store), config.load(o.config_dir, o.sources_file)
    return {"crawl": _crawl, "report": _report, "enrich": _enrich, "search": _search, "dedupe": _dedupe, "list-sources": _list, "stats": _stats, "digest": _digest, "extract-keywords": _keywords}[o.command](o, store, settings, client) or 0


def _crawl(o, store, settings, _):
    c = settings.crawler
    crawl.crawl(store, settings.sources, o.landing, o.source, o.dry_run, delay=c.get("download_delay", 2.0), timeout=c.get("timeout_seconds", 30), useragent=c.get("user_agent", "tidewire")).show(1000, truncate=False)


def _report(o, store, settings, _):
    own = settings.report | {k: v for k, v in {"title": o.title, "tags": config.tag_option(o.tags) or None, "visualize": o.visualize, "top_n": o.top_n}.items() if v is not None}
    text = report.report(store.read("articles"), o.days, o.start_date, o.end_date, o.period, o.category, config.excluded(settings.sources, o.exclude_source), o.exclude_duplicates, o.output, own, dictionary=config.dictionary(own.get("ai_keywords_path") or f"{o.config_dir}/ai_keywords.yaml"))
    if o.output is None:
        print(text)


def _enrich(o, store, settings, client):
    articles = store.read("articles")
    at = datetime.now() - timedelta(days=o.days)
    rows = select.pending(articles, at, o.limit, o.retry_failed)
    model = settings.ai.get("model", "")
    if o.reprocess_stale:
        rows = select.newest(rows.unionByName(articles.where(select.since(at) & enrich.stale(model, str(settings.ai.get("prompt_version", "1"))))), o.limit)
    if rows.isEmpty():
        print("nothing is pending")
        return
    if client is None:
        endpoint, model = enrich.endpoint_of(settings.ai, enrich.probe, o.llm)
        client = enrich.chat_client(endpoint, model, settings.ai.get("system_prompt", ""), settings.ai.get("timeout_seconds", 60), settings.ai.get("max_retries", 3))
    answered = enrich.answers(rows, client, settings.ai.get("max_input_chars", 8000), settings.ai.get("request_interval", 2.0), 1)
    enrich.totals(answered).show()
    asked = articles.join(answered.select("id"), "id", "left_semi")
    store.bucketed().replace(enrich.saved(asked, answered, model, str(settings.ai.get("prompt_version", "1"))))
    store.indexed(asked.select("normalized_url"))


def _search(o, store, settings, _):
    select.numbered(store.search(o.query, o.category, o.limit), store.read("articles")).orderBy("n").show(o.limit, truncate=False)


def _dedupe(o, store, settings, _):
    a, b, _mode = resolve(o.days, o.start_date, o.end_date, o.period)
    articles = store.read("articles")
    duplicates.matches(articles.where(select.within(a, b)), o.min_title_len).show(1000)
    if o.apply:
        marks = duplicates.marked(articles.withColumn("_was", F.col("duplicate_of_id")), a, b, o.min_title_len)
        store.bucketed().replace(marks.where(~F.col("_was").eqNullSafe(F.col("duplicate_of_id"))))


def _list(o, store, settings, _):
    for s in sorted(settings.sources, key=lambda s: s["key"]):
        print(s["key"], s.get("name", ""), s["category"], s["fetch_method"], "on" if s["enabled"] else "off", s.get("feed_url") or s.get("list_url") or s.get("base_url"), sep="\t")


def _stats(o, store, settings, _):
    articles = store.read("articles")
    print("sources", store.read("sources").count(), "articles", articles.count())
    select.count_by(articles, "category").orderBy("category").show()
    select.count_by(articles, "ai_status").orderBy("ai_status").show()
    select.latest_run(store.read("crawl_runs")).show()


def _digest(o, store, settings, _):
    a, b, _mode = resolve(o.days, o.start_date, o.end_date, o.period)
    a = a.replace(hour=0, minute=0, second=0, microsecond=0)
    rows = select.in_range(store.read("articles"), a, b, without=config.excluded(settings.sources, []), without_duplicates=o.exclude_duplicates)
    written, skipped = digest.write(rows, o.output, store.read("sources").select("key", "name"), o.only_summarized, (a.date(), (b - timedelta(seconds=1)).date()))
    for path, n in written:
        print(path, n)
    for day in skipped:
        print("skipped", day)


def _keywords(o, store, settings, _):
    a, b, _mode = resolve(o.days, o.start_date, o.end_date, o.period)
    path = o.keywords_path or f"{o.config_dir}/ai_keywords.yaml"
    words = config.dictionary(path)
    rows = select.in_range(store.read("articles"), a, b, without=config.excluded(settings.sources, []), without_duplicates=True)
    best = terms.trending(rows, o.min_count, o.top_n, words["stopwords_general"], words["stopwords_extraction"], terms.segment_of(words)).collect()
    known = words["ai_keywords"]
    for title, some in (("new", [r for r in best if r["term"].lower() not in known]), ("existing", [r for r in best if r["term"].lower() in known])):
        for r in some:
            print(title, r["term"], r["cnt"], sep="\t")
    if o.append:
        config.append_words(path, [r["term"] for r in best if r["term"].lower() not in known])


if __name__ == "__main__":
    raise SystemExit(main())
