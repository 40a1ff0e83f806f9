"""Operators on small tables."""

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.operators import duplicates, enrich, search, select, terms
from tidewire.operators.upsert import upsert
from tidewire.plans import digest, report
from tidewire.plans.period import label, resolve
from tidewire.sources import config, landing
from tidewire.sources.schema import ARTICLES, conformed
from tidewire.sources.store import Store

NOW = datetime(2026, 9, 20, 12)


def articles(spark, *rows):
    made = [{"id": i + 1, "source_key": "a", "url": f"https://e.com/{i}", "title": f"Title {i}", "summary": "", "content": "", "category": "tech", "published_at": NOW, "fetched_at": NOW, **r} for i, r in enumerate(rows)]
    keys = {k for r in made for k in r}
    ddl = ", ".join(f.strip() for f in ARTICLES.split(",") if f.split()[0] in keys)
    names = [f.split()[0] for f in ddl.split(",")]
    return conformed(spark.createDataFrame([tuple(r.get(n) for n in names) for r in made], ddl))


def ids(df):
    return [r["id"] for r in df.collect()]


def test_range_is_half_open_and_falls_back_to_the_fetch(spark):
    rows = articles(spark, {"published_at": NOW - timedelta(days=5)}, {}, {"published_at": NOW + timedelta(days=5)}, {"published_at": None}, {"published_at": NOW + timedelta(days=1)})
    assert sorted(ids(select.in_range(rows, NOW, NOW + timedelta(days=1)))) == [2, 4]


def test_pending_leaves_out_duplicates(spark):
    rows = articles(spark, {"ai_status": "pending"}, {"ai_status": "failed"}, {"ai_status": "completed"}, {"ai_status": "pending", "duplicate_of_id": 1}, {"ai_status": None})
    assert ids(select.pending(rows, NOW)) == [1, 5]
    assert ids(select.pending(rows, NOW, retry_failed=True)) == [1, 2, 5]


def test_the_filter_reaches_the_scan(spark, tmp_path):
    articles(spark, {}).write.parquet(f"{tmp_path}/a")
    plan = select.recent(spark.read.parquet(f"{tmp_path}/a"), NOW).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(GreaterThanOrEqual(published_at" in plan and "content" not in plan


def test_duplicates(spark):
    title = "A story that is told by many"
    rows = articles(spark, {"title": title, "source_key": "b", "published_at": NOW + timedelta(hours=1)}, {"title": title.upper()}, {"title": " A story that is  told by many"}, {"title": "short one", "source_key": "b"}, {"title": "short one"}, {"title": "The same source twice over"}, {"title": "The same source twice over"})
    assert [tuple(r) for r in duplicates.matches(rows).collect()] == [(3, 1, 1.0)]
    marked = duplicates.marked(rows, NOW - timedelta(days=1), NOW + timedelta(days=1))
    again = duplicates.marked(marked, NOW - timedelta(days=1), NOW + timedelta(days=1))
    assert {r["id"]: r["duplicate_of_id"] for r in marked.collect()} == {1: 3, 2: None, 3: None, 4: None, 5: None, 6: None, 7: None}
    assert sorted(map(str, again.collect())) == sorted(map(str, marked.collect()))


def sequential(stored, incoming):
    """One row after the other."""
    table, new, updated = dict(stored), {}, {}
    for url, h, author in incoming:
        if url not in table:
            table[url], new[url] = [h, author], 1
        elif table[url][0] != h:
            table[url] = [h, author if author is not None else table[url][1]]
            updated[url] = updated.get(url, 0) + 1
    return {u: (h, a, new.get(u, 0), updated.get(u, 0)) for u, (h, a) in table.items()}


def test_upsert_equals_one_row_after_the_other(spark):
    r = random.Random(1)
    stored = {f"u{i}": [r.choice("ABC"), r.choice([None, "x"])] for i in range(30)}
    incoming = [(f"u{r.randrange(50)}", r.choice("ABC"), r.choice([None, "y", "z"])) for _ in range(300)]
    old = spark.createDataFrame([(i + 1, u, h, a, "completed", "T") for i, (u, (h, a)) in enumerate(stored.items())], "id long, normalized_url string, content_hash string, author string, ai_status string, title_ja string")
    new = spark.createDataFrame([(k, u, h, a) for k, (u, h, a) in enumerate(incoming)], "position long, normalized_url string, content_hash string, author string").repartition(5)
    found = {x["normalized_url"]: x for x in upsert(old, new).collect()}
    assert {u: (x["content_hash"], x["author"], x["new_count"], x["updated_count"]) for u, x in found.items()} == sequential(stored, incoming)
    first = list(dict.fromkeys(u for u, _, _ in incoming if u not in stored))
    assert [found[u]["id"] for u in first] == list(range(31, 31 + len(first)))
    for x in found.values():
        assert (x["ai_status"], x["title_ja"]) == (("pending", "") if x["updated_count"] or x["new_count"] else ("completed", "T"))


def test_terms(spark):
    rows = articles(spark, {"title": "GPT-4 models", "content": "gpt-4 is a model by OpenAI", "tags": ["AI", "Deep Learning"]}, {"title": "OpenAI 42", "tags": ["ai", "deep learning", "x"], "ai_status": "completed", "title_ja": "新モデル", "summary_ja": "発表"})
    counts = dict(terms.word_counts(rows).collect())
    assert counts["gpt-4"] == 2 and counts["openai"] == 2 and "is" not in counts and "42" not in counts
    assert dict(terms.tag_counts(rows).collect()) == {"ai": 2, "deep learning": 2}
    best = [tuple(x) for x in terms.trending(rows, 2, 3).collect()]
    assert best == [("OpenAI", 2), ("ai", 2), ("deep learning", 2)]
    assert dict(terms.japanese_counts(rows).collect()) == {"モデル": 1, "発表": 1}
    assert round(sum(x["share"] for x in terms.shares(terms.tag_counts(rows), 5).collect()), 6) == 1


def test_search(spark):
    rows = articles(spark, {"title": "Next-Gen models", "content": "naïve words of the next"}, {"title": "gen next", "content": "the the"}, {"title": "other", "ai_status": "completed", "title_ja": "新しいモデルの発表", "summary_ja": "AIモデル"}, {"title": "Next gen again next gen", "category": "news"})
    assert sorted(ids(search.search(rows, "Next-Gen"))) == [1, 4]
    assert ids(search.search(rows, "Next-Gen", "news")) == [4]
    assert ids(search.search(rows, "naive")) == [1]
    assert ids(search.search(rows, "モデルの")) == [3]
    for nothing in ("", "   ", "...", "発表"):
        assert ids(search.search(rows, nothing)) == []
    assert ids(search.search(rows, "発表", fall_back=True)) == [3]
    assert ids(search.search(rows, 'ne"xt')) == []
    ranks = [r["rank"] for r in search.search(rows, "next gen").collect()]
    assert ranks == sorted(ranks) and all(x <= 0 for x in ranks)


def test_index_is_kept_up(spark, tmp_path):
    rows = articles(spark, {"title": "old words"}, {"title": "other words words"}, {"title": "gone words"})
    store = Store(spark, f"{tmp_path}/store")
    store.write("articles", rows)
    store.index()
    at = lambda q: ids(search.search_index(store.read("postings"), store.read("lengths"), q))
    assert at("old") == [1] and at("old-words") == [1] and at("words") == [2, 1, 3] and at("...") == [] and at("words old-other") == []
    store.index(rows.where("id = 1").withColumn("title", F.lit("new words")), rows.where("id = 3").select("id"))
    assert at("old") == [] and at("new-words") == [1] and at("words") == [2, 1]
    plan = search.search_index(store.read("postings"), store.read("lengths"), "new")  # it reads its own terms only
    assert plan.count() == 1


def test_a_stored_index_ranks_like_a_scan(spark):
    r = random.Random(3)
    rows = articles(spark, *({"title": " ".join(r.choice("abc") for _ in range(r.randint(0, 6))), "content": " ".join(r.choice("abcdé") for _ in range(r.randint(0, 30)))} for _ in range(60)))
    index, sizes = search.postings(rows), search.lengths(rows)
    for q in ("a", "a-b", "e d", "b-a-b c", "zz a"):
        found = [(x["id"], round(x["rank"], 9)) for x in search.search_index(index, sizes, q, None, 1000).collect()]
        assert found == [(x["id"], round(x["rank"], 9)) for x in search.search_words(rows, q, None, 1000).collect()]


def test_fetch(spark, tmp_path):
    import http.server
    import threading

    from tidewire.sources import fetch

    (tmp_path / "a.xml").write_text(RSS)
    handler = lambda *a: http.server.SimpleHTTPRequestHandler(*a, directory=str(tmp_path))
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        at = f"http://127.0.0.1:{server.server_port}"
        sources = [{"key": "feed", "feed_url": f"{at}/a.xml"}, {"key": "none", "list_url": f"{at}/none"}, {"key": "off", "base_url": "http://127.0.0.1:9/"}]
        rows = {r["source_key"]: r for r in fetch.fetched(spark, sources, delay=0, timeout=5).collect()}
        server.shutdown()
    assert rows["feed"]["status"] == 200 and bytes(rows["feed"]["body"]).decode() == RSS
    assert rows["none"]["status"] == 404 and rows["off"]["status"] is None
    assert fetch.address({"fetch_method": "github", "base_url": "https://github.com/org/repo/"}).endswith("/repos/org/repo/releases")


def test_snippet(spark):
    text = "Start: " + " ".join(f"w{i}," for i in range(40)) + " Naïve-Target, end!"
    rows = articles(spark, {"title": "t", "summary": text}, {"title": "t w30", "summary": "  Short (w30)."}, {"title": "w30", "summary": ""}, {"title": "w30", "summary": "nothing here. "})
    found = {x["id"]: x["snippet"] for x in search.search_words(rows, "w30").collect()}
    assert found[1] == "..." + "".join(f"w{i}, " for i in range(21, 30)) + "<b>w30</b>, " + "".join(f"w{i}, " for i in range(31, 40)) + "Naïve..."
    assert found[2] == "  Short (<b>w30</b>)." and found[3] == "" and found[4] == "nothing here. "
    (x,) = search.search_words(rows, "naive-target w0").collect()
    assert x["snippet"] == "...<b>w0</b>, " + ", ".join(f"w{i}" for i in range(1, 20)) + "..."  # as SQLite has it: the sentence after "Start:"
    (x,) = search.search_words(rows, "Naive-TARGET").collect()
    assert x["snippet"] == "..." + "".join(f"w{i}, " for i in range(23, 40))[:-2] + ", <b>Naïve-Target</b>, end!"
    japanese = articles(spark, {"summary_ja": "あいう" * 5 + "新しいモデルの発表とモデルの説明について詳しく書いた文章です"})
    assert search.search_trigrams(japanese, "モデルの").first()["snippet"] == "...<b>モデルの</b>発表と<b>モデルの</b>説明について詳しく書い..."


def test_the_snippet_is_the_best_fragment(spark):
    """Against SQLite's own, on random texts; the best window isn't that of the first hit."""
    import random
    import sqlite3

    draw = random.Random(5)
    words = ["ant", "bee", "cat", "dog", *(f"w{i}" for i in range(12))]
    texts = ["ant. " + "w1 " * 40 + "so: the bee saw an ant bee there", "", "w1 w2.", "bee " * 60, "w1 " * 30 + "cat dog " * 3]
    for _ in range(300):
        texts.append("".join(draw.choice(words) + draw.choice([" "] * 8 + [". ", ": ", ".", "\n", ", "]) for _ in range(draw.randint(1, 90))))
    asked = [["ant"], ["bee", "cat", "ant"], ["bee"], ["cat", "dog"]]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(a)")
    db.executemany("INSERT INTO t(rowid, a) VALUES (?, ?)", list(enumerate(texts, 1)))
    asking = " OR ".join('"' + " ".join(p) + '"' for p in asked)
    want = dict(db.execute("SELECT rowid, snippet(t, 0, '<b>', '</b>', '...', 20) FROM t WHERE t MATCH ?", (asking,)))
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "id long, body string")
    found = {x["id"]: x["snippet"] for x in search.with_snippet(rows, "body", asked).collect()}
    assert len(want) > 250 and {i: found[i] for i in want} == want
    assert found[1].startswith("...so: the <b>bee</b> saw an <b>ant</b> <b>bee</b>") or "<b>ant</b> <b>bee</b> there" in found[1]
    assert found[2] == "" and found[3] == "w1 w2."


def test_report_and_digest(spark, tmp_path):
    rows = articles(spark, {"summary": "line\nbreak"}, {"source_key": "b", "ai_status": "completed", "title_ja": "題", "summary_ja": "要約", "ai_model": "m"}, {"category": "research", "published_at": None}, {"published_at": NOW + timedelta(days=700), "source_key": "b"})
    text = report.report(rows, days=7, now=NOW + timedelta(hours=1), output=tmp_path / "r.md")
    assert "| **tech** | 2 | 2 |" in text and "| **合計** | **3** | **3** |" in text
    assert "#### 1. [題](https://e.com/1)" in text and "## 📁 カテゴリ: Research" in text and "line break" in text
    assert (tmp_path / "r.md").read_text() == text
    day = date(2026, 9, 20)
    written, skipped = digest.write(rows, tmp_path, spark.createDataFrame([("a", "Source A")], "key string, name string"))
    assert [(p.name, n) for p, n in written] == [("2026-09-20.md", 4)] and skipped == []
    body = written[0][0].read_text()
    assert body.index("## Source A（2）") < body.index("## b（2）") and "- **--:--** [Title 3]" in body and "  - 要約" in body and "llm_models:\n- m" in body
    assert digest.write(rows, tmp_path, day_range=(day + timedelta(days=1), day + timedelta(days=2))) == ([], [day])
    assert written[0][0].read_text() == body
    assert report.report(rows.where("false"), days=7, now=NOW).rstrip().endswith(report.NOTHING)


def test_period():
    assert resolve(days=7, now=NOW) == (NOW - timedelta(days=7), NOW, "days")
    assert resolve(start="2026-09-01", end="2026-09-05", now=NOW)[:2] == (datetime(2026, 9, 1), datetime(2026, 9, 6))
    assert resolve(period="month", now=NOW)[0] == NOW - timedelta(days=30)
    assert label(datetime(2026, 9, 1), datetime(2026, 9, 6)) == ("2026-09-01", "2026-09-05")
    for bad in ({"days": 7, "period": "week"}, {"end": "2026-09-01"}, {"days": 7, "end": "2026-09-01"}, {"start": "2026-09-09", "end": "2026-09-01"}, {"start": "x"}, {"days": 0}, {"period": "year"}):
        with pytest.raises(ValueError):
            resolve(**bad, now=NOW)


def test_enrich(spark):
    rows = articles(spark, {"title": "one", "tags": ["RSS"]}, {"title": "two"}, {"title": "three", "ai_status": "completed"})

    def client(text):
        if "two" in text:
            raise RuntimeError("")
        return json.dumps({"title_ja": "一", "summary_ja": "要", "keywords": ["rss", "New"]})

    answered = enrich.answers(rows.where("ai_status = 'pending'"), client)
    assert enrich.totals(answered).first().asDict() == {"success": 1, "failed": 1, "skipped": 0, "total": 2}
    made = {r["id"]: r for r in enrich.saved(rows, answered, "m", "2", NOW).collect()}
    assert (made[1]["ai_status"], made[1]["title_ja"], made[1]["tags"], made[1]["ai_prompt_version"]) == ("completed", "一", ["RSS", "New"], "2")
    assert (made[2]["ai_status"], made[2]["ai_error"]) == ("failed", "Unknown error")
    assert made[3]["ai_model"] == ""


def test_retries(monkeypatch):
    import urllib.error

    waits, left = [], [urllib.error.HTTPError("u", 429, "", {"Retry-After": "3"}, None), TimeoutError(), None]

    def call():
        e = left.pop(0)
        if e:
            raise e
        return "ok"

    assert enrich.with_retries(call, 3, waits.append) == "ok" and waits == [3.0, 2.0]
    tried = []
    with pytest.raises(TimeoutError):
        enrich.with_retries(lambda: tried.append(1) or (_ for _ in ()).throw(TimeoutError()), 3, waits.append)
    assert len(tried) == 4 and waits[2:] == [1.0, 2.0, 4.0]
    with pytest.raises(urllib.error.HTTPError):
        enrich.with_retries(lambda: (_ for _ in ()).throw(urllib.error.HTTPError("u", 404, "", None, None)), 3, waits.append)
    assert enrich.select_endpoint([{"name": "a"}, {"name": "b"}], lambda e: "m" if e["name"] == "b" else None) == ({"name": "b"}, "m")
    with pytest.raises(ValueError):
        enrich.select_endpoint([{"name": "a"}], lambda e: None, "x")
    with pytest.raises(RuntimeError):
        enrich.select_endpoint([{"name": "a"}], lambda e: None)
    assert enrich.select_endpoint([{"name": "a"}, {"name": "b"}], lambda e: "m", order=["b", "a"])[0] == {"name": "b"}
    assert enrich.endpoint_of({"proxy_url": "http://p/v1", "model": "m"}, lambda e: None) == ({"name": "default", "proxy_url": "http://p/v1", "max_tokens": 500}, "m")
    assert enrich.endpoint_of({"endpoints": [{"name": "a", "max_tokens": 9}], "max_tokens": 7}, lambda e: "m")[0]["max_tokens"] == 9
    with pytest.raises(ValueError):
        enrich.endpoint_of({}, lambda e: "m")
    monkeypatch.delenv("A_KEY", raising=False)
    assert enrich.probe({"name": "a", "base_url": "http://127.0.0.1:9", "api_key_env": "A_KEY"}) is None


def test_chat_endpoint():
    import http.server
    import threading

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def answer(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self.answer({"data": [{"id": "models/m1"}, {"id": "m2"}]})

        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.answer({"choices": [{"message": {"content": "hi"}}]})

        def log_message(self, *_):
            pass

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        at = {"name": "a", "proxy_url": f"http://127.0.0.1:{server.server_port}/"}
        assert [enrich.probe(at | m) for m in ({}, {"model": "m2"}, {"model": "m3"})] == ["m1", "m2", None]
        assert enrich.chat_client(at, "m1", "be brief")("text") == "hi"
        server.shutdown()
    assert (seen[0]["max_tokens"], seen[0]["temperature"], seen[0]["messages"][1]["content"]) == (500, 0.3, "text")


RSS = """<rss version="2.0"><channel><title>c</title><item><title>Tide Gauge</title><link>https://harbour.example/notes/tide?utm_source=rss&amp;sp_source=x</link>
<description>&lt;p&gt;Big &lt;b&gt;news&lt;/b&gt;&lt;/p&gt;</description><pubDate>Mon, 14 Sep 2026 10:00:00 GMT</pubDate><author>ann</author><category>AI</category><category>LLM</category></item>
<item><title>No link</title><link></link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Entry</title><link href="https://e.com/a" rel="alternate"/><link href="https://e.com/self" rel="self"/>
<updated>2026-09-14T10:00:00+09:00</updated><summary>short</summary><content type="html">&lt;p&gt;one&lt;/p&gt;&lt;p&gt;two&lt;/p&gt;</content><author><name>bob</name></author><category term="x"/></entry></feed>"""


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text(ATOM)
    made = {r["title"]: r for r in landing.feed(spark, str(tmp_path), "s", "tech").collect()}
    assert set(made) == {"Tide Gauge", "Entry"}
    r = made["Tide Gauge"]
    assert (r["normalized_url"], r["summary"], r["author"], r["tags"], r["published_at"]) == ("https://harbour.example/notes/tide", "Big news", "ann", ["AI", "LLM"], datetime(2026, 9, 14, 10))
    r = made["Entry"]
    assert (r["url"], r["content"], r["author"], r["tags"], r["published_at"]) == ("https://e.com/a", "one\ntwo", "bob", ["x"], datetime(2026, 9, 14, 10))


LIST = '<main><section class="card"><h3><a href="/p/1">1</a></h3></section><section class="card"><h3><a href="/p/2?utm_source=x">2</a><a href="/p/2">again</a><a href="#x">x</a></h3></section></main>'
PAGE = '<html><head><title>doc</title><meta name="description" content="desc"><meta property="article:published_time" content="2026-09-14"></head><body><h1 class="headline">Head</h1><em class="byline">Ann</em><div class="prose"><p>one</p><p>two</p></div></body></html>'


def test_pages(spark):
    pages = spark.createDataFrame([("https://e.com/list", LIST)], "url string, body string")
    links = landing.page_links(pages, {"article_list_selector": "section.card h3 a"}).orderBy("rank").collect()
    assert [(x["rank"], x["normalized_url"]) for x in links] == [(1, "https://e.com/p/1"), (2, "https://e.com/p/2")]
    own = {"title_selector": "h1.headline", "author_selector": "em.byline", "content_selector": "div.prose", "date_selector": "time.stamp"}
    rows = [("https://e.com/1", 200, PAGE.encode()), ("https://e.com/2", 404, PAGE.encode()), ("https://e.com/3", 200, b"<h1></h1><title>x</title>"), ("https://e.com/4", 200, '<meta charset="shift_jis"><title>日本語</title><main>本文</main>'.encode("shift_jis"))]
    made = {x["url"]: x for x in landing.page_articles(spark.createDataFrame(rows, "url string, status int, body binary"), "s", "tech", own).collect()}
    assert set(made) == {"https://e.com/1", "https://e.com/4"}
    r = made["https://e.com/1"]
    assert (r["title"], r["summary"], r["content"], r["author"], r["published_at"]) == ("Head", "desc", "one\ntwo", "Ann", datetime(2026, 9, 14))
    assert (made["https://e.com/4"]["title"], made["https://e.com/4"]["content"]) == ("日本語", "本文")


def test_lists_of_releases_and_models(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"name": "", "tag_name": "v1", "html_url": "https://g.com/1", "body": "x" * 300 + "\r\nmore", "draft": False, "published_at": "2026-09-14T10:00:00Z", "author": {"login": "ann"}}, {"name": "d", "html_url": "u", "draft": True}]))
    (tmp_path / "m.json").write_text(json.dumps([{"modelId": "org/m", "createdAt": "2026-09-14T10:00:00.000Z", "likes": 3, "downloads": 0, "tags": ["a", "b"], "pipeline_tag": "text-generation"}, {"likes": 1}]))
    (r,) = landing.releases(spark, f"{tmp_path}/r.json", "g", "oss").collect()
    assert (r["title"], r["summary"], r["author"], r["tags"]) == ("v1", "x" * 200 + "...", "ann", ["v1"])
    (m,) = landing.models(spark, f"{tmp_path}/m.json", "h", "oss", "org").collect()
    assert (m["url"], m["summary"]) == ("https://huggingface.co/org/m", "Pipeline: text-generation | Likes: 3")
    assert m["content"] == "Model ID: org/m\nPipeline Tag: text-generation\nLikes: 3\nTags: a, b"


def test_config(tmp_path, monkeypatch):
    (tmp_path / "sources.yaml").write_text("title: T\nsources:\n  a: {name: A, feed_url: u}\n  b: {enabled: false, fetch_method: html}\n")
    (tmp_path / "crawler.yaml").write_text("ai: {model: m}\nreport: {title: old, top_n: 20}\n")
    monkeypatch.setenv("AIA_MODEL", "other")
    s = config.load(tmp_path)
    assert [x["key"] for x in s.sources] == ["a", "b"] and s.ai["model"] == "other" and s.report == {"title": "T", "top_n": 20}
    assert [x["key"] for x in config.chosen(s.sources)] == ["a"] and [x["key"] for x in config.chosen(s.sources, "b")] == ["b"]
    with pytest.raises(ValueError):
        config.chosen(s.sources, "c")
    assert config.excluded(s.sources, ["z"]) == ["b", "z"]
    words = tmp_path / "k.yaml"
    words.write_text("# head\nai_keywords:\n  - gpt  # kept\n  # note\nstopwords_general:\n  - the\n")
    assert config.append_words(words, ["GPT", "New One", "new one"]) == ["new one"]
    assert config.dictionary(words)["ai_keywords"] == {"gpt", "new one"} and "# kept" in words.read_text() and "# note" in words.read_text()
    assert config.tag_option(["a, b", "b", "c"]) == ["a", "b", "c"]


def test_store_crawl_and_cli(spark, tmp_path, capsys):
    from tidewire.cli import main

    land, conf = tmp_path / "land", tmp_path / "conf"
    (land / "feed").mkdir(parents=True)
    conf.mkdir()
    (land / "feed" / "a.xml").write_text(RSS)
    (conf / "sources.yaml").write_text("sources:\n  feed: {name: Feed, category: tech, feed_url: u}\n  gone: {name: Gone, category: tech, fetch_method: github}\n")
    (conf / "ai_keywords.yaml").write_text("ai_keywords:\n  - gpt\n")
    base = ["--store", f"{tmp_path}/store"]
    more = ["--config-dir", str(conf)]
    assert main([*base, "crawl", *more, "--landing", str(land), "--dry-run"], spark) == 0
    store = Store(spark, f"{tmp_path}/store")
    assert store.read("articles").count() == 0
    for _ in range(2):
        main([*base, "crawl", *more, "--landing", str(land)], spark)
    runs = [tuple(r) for r in store.read("crawl_runs").select("id", "success_count", "failed_count", "new_count", "updated_count", "status").orderBy("id").collect()]
    assert runs == [(1, 1, 1, 1, 0, "partial"), (2, 1, 1, 0, 0, "partial")]
    assert store.read("articles").count() == 1 and len(store.versions("articles")) == 2
    touched = {r["key"]: r["last_crawled_at"] for r in store.read("sources").collect()}
    assert touched["feed"] is not None and touched["gone"] is None
    dates = ["--start-date", "2026-09-01", "--end-date", "2026-09-30"]
    main([*base, "search", "gauge", *more], spark)
    main([*base, "stats", *more], spark)
    main([*base, "list-sources", *more], spark)
    main([*base, "report", *more, *dates, "-o", f"{tmp_path}/r.md"], spark)
    main([*base, "digest", *more, *dates, "-o", f"{tmp_path}/d"], spark)
    main([*base, "dedupe", *more, *dates, "--apply"], spark)
    main([*base, "extract-keywords", *more, *dates, "--min-count", "1", "--append"], spark)
    main([*base, "enrich", *more, "-d", "100000"], spark, lambda text: '{"title_ja": "題", "summary_ja": "要"}')
    assert "Tide Gauge" in (tmp_path / "r.md").read_text() and (tmp_path / "d/2026/2026-09-14.md").exists()
    assert store.read("articles").first()["ai_status"] == "completed"
    assert "new\tnews" in capsys.readouterr().out


def test_a_crawl_fetches_its_sources(spark, tmp_path):
    import http.server
    import threading

    from tidewire.plans.crawl import crawl

    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "list.html").write_text('<main><a href="/p1.html">1</a><a href="/p2.html">2</a><a href="/none.html">3</a></main>')
    for k in (1, 2):
        (tmp_path / f"p{k}.html").write_text(f"<h1>Page {k}</h1><main>Text {k}</main>")

    class Handler(http.server.SimpleHTTPRequestHandler):
        def __init__(self, *a):
            super().__init__(*a, directory=str(tmp_path))

        def log_message(self, *_):
            pass

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        at = f"http://127.0.0.1:{server.server_port}"
        sources = [config.checked(s) for s in ({"key": "feed", "feed_url": f"{at}/a.xml", "category": "tech"}, {"key": "pages", "fetch_method": "html", "list_url": f"{at}/list.html"}, {"key": "lost", "feed_url": f"{at}/lost.xml"})]
        store = Store(spark, f"{tmp_path}/store")
        found = {r["source_key"]: r for r in crawl(store, sources, delay=0, timeout=5).collect()}
        server.shutdown()
    assert {k: (r["status"], r["new_count"]) for k, r in found.items()} == {"feed": ("success", 1), "pages": ("success", 2), "lost": ("failed", 0)}
    assert {r["title"] for r in store.read("articles").collect()} == {"Tide Gauge", "Page 1", "Page 2"}


def test_rows_of_a_crawl_count_for_their_source(spark):
    from tidewire.operators.upsert import effects

    old = spark.createDataFrame([(1, "u1", "A"), (2, "u2", "A")], "id long, normalized_url string, content_hash string")
    new = spark.createDataFrame([(0, "u1", "B", "a"), (1, "u3", "A", "a"), (2, "u3", "A", "b"), (3, "u3", "C", "b"), (4, "u2", "A", "b"), (5, "u1", "A", "b")], "position long, normalized_url string, content_hash string, source_key string")
    assert {r[0]: (r[1], r[2]) for r in effects(old, new, "source_key").collect()} == {"a": (1, 1), "b": (0, 2)}


def test_a_report_has_its_frequencies(spark, tmp_path, monkeypatch):
    drawn = []
    monkeypatch.setattr(report, "word_cloud", lambda counts, output, *size: drawn.append((output.name, dict(counts.collect()), size)) or True)
    rows = articles(spark, {"title": "tide gauge", "tags": ["Sea"]}, {"title": "ebb", "ai_status": "completed", "title_ja": "潮位"})
    text = report.report(rows, days=7, now=NOW + timedelta(hours=1), output=tmp_path / "r.md", settings={"wordcloud_width": 10})
    assert [(n, c) for n, c, _ in drawn] == [("wordcloud_ja.png", {"潮位": 1, "sea": 1}), ("wordcloud_original.png", {"tide": 1, "gauge": 1, "ebb": 1, "sea": 1})]
    assert drawn[0][2] == (10, 400) and "![原文ワードクラウド](r_assets/wordcloud_original.png)" in text and text.index(report.FREQUENCIES) < text.index(report.SUMMARY[0])
    text = report.report(rows.where("id = 1"), days=7, now=NOW + timedelta(hours=1), output=tmp_path / "r.md")
    assert report.CLOUDS[0][2][1] in text and "原文ワードクラウド" in text
    assert report.FREQUENCIES not in report.report(rows, days=7, now=NOW + timedelta(hours=1), output=tmp_path / "r.md", settings={"visualize": False})


def test_a_category_may_be_called_total(spark):
    rows = articles(spark, {"category": "TOTAL"}, {"category": "x"}, {"category": "x", "source_key": "b"})
    assert sorted(tuple(r) for r in select.by_category(rows).collect()) == [("TOTAL", 1, 1, False), ("TOTAL", 3, 3, True), ("x", 2, 2, False)]
    assert "| **TOTAL** | 1 | 1 |" in report.report(rows, days=7, now=NOW + timedelta(hours=1))


def test_stream_upserts_what_lands(spark, tmp_path):
    from tidewire.streaming import ingest

    store, folder = Store(spark, f"{tmp_path}/store"), f"{tmp_path}/landing"
    made = lambda *rows: spark.createDataFrame(list(rows), "position long, normalized_url string, content_hash string, title string")
    made((1, "u1", "A", "t"), (2, "u2", "A", "t")).coalesce(1).write.parquet(folder)
    for k in range(3):
        if k:
            made((10 + k, "u1", f"B{k}", "t")).coalesce(1).write.mode("append").parquet(folder)
        q = ingest.start(ingest.landed(spark, folder, made((1, "", "", "")).schema), store, f"{tmp_path}/checkpoint")
        q.awaitTermination(120)
    assert {r["normalized_url"]: r["content_hash"] for r in store.read("articles").collect()} == {"u1": "B2", "u2": "A"}


def test_results_do_not_depend_on_the_partitions(spark):
    rows = articles(spark, *({"title": f"A story number {i % 7} in full", "source_key": "ab"[i % 2]} for i in range(60)))
    few, many = (sorted(map(str, duplicates.matches(rows.repartition(n, F.rand(1))).collect())) for n in (1, 7))
    assert few == many


def test_references_are_checked(spark):
    runs = spark.createDataFrame([(1,)], "id long")
    results = spark.createDataFrame([(1, "a"), (2, "b")], "run_id long, source_key string")
    assert [r["source_key"] for r in select.orphans(results, "run_id", runs, "id").collect()] == ["b"]
