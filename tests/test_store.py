"""The stored articles in buckets, their index in segments, their marks by batch: against tables made anew."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.operators import duplicates, search
from tidewire.operators.upsert import counted, upsert, upsert_into
from tidewire.plans import digest
from tidewire.plans.crawl import placed
from tidewire.sources import buckets as B
from tidewire.sources import files
from tidewire.sources import index as I
from tidewire.sources.schema import conformed
from tidewire.sources.store import Store
from tidewire.streaming import ingest

from .test_articles import NOW, articles, ids

INCOMING = "position long, normalized_url string, content_hash string, title string, source_key string"


def batch(spark, r, n, most=40):
    return spark.createDataFrame([(k, f"u{r.randrange(most)}", r.choice("ABC"), f"title {r.randrange(5)} of many letters", r.choice("xyz")) for k in range(n)], INCOMING)


def content(df):
    return sorted((r["normalized_url"], r["id"], r["content_hash"], r["title"]) for r in df.collect())


def test_batches_into_buckets_equal_upserts_of_whole_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "KEYS", 3)  # several groups of buckets
    r, store = random.Random(4), Store(spark, f"{tmp_path}/store", 8)
    whole = store.read("articles")
    for _ in range(3):
        new = batch(spark, r, 25)
        made = upsert(whole, new)
        want = made.agg(F.sum("new_count"), F.sum("updated_count")).first()
        rows = upsert_into(store.articles, new)
        counts = counted(rows, "source_key").agg(F.sum("new_count"), F.sum("updated_count")).first()
        assert tuple(counts) == tuple(want)
        whole = spark.createDataFrame(made.select(whole.columns).collect(), whole.schema)
        assert content(store.read("articles")) == content(whole)


def test_only_the_buckets_of_a_change_are_written(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store", 16)
    store.write("articles", spark.createDataFrame([(i, f"u{i}", "A") for i in range(200)], "id long, normalized_url string, content_hash string"))
    first = store.articles.state()
    assert set(first["at"].values()) == {1} and first["max_id"] == 199
    upsert_into(store.articles, spark.createDataFrame([(0, "u7", "B"), (1, "u8", "A"), (2, "new", "A")], "position long, normalized_url string, content_hash string"))
    state = store.articles.state()
    where = {u: spark.range(1).select(B.bucket_of(F.lit(u), 16)).first()[0] for u in ("u7", "u8", "new")}
    assert {b for b, v in state["at"].items() if v == 2} == {str(where["u7"]), str(where["new"])}
    assert store.read("articles").count() == 201 and state["max_id"] == 200
    assert {p.name for p in (tmp_path / "store/articles/data/version=2").iterdir() if p.name.startswith("bucket=")} == {f"bucket={where[u]}" for u in ("u7", "new")}
    upsert_into(store.articles, spark.createDataFrame([(0, "u8", "A")], "position long, normalized_url string, content_hash string"))
    assert store.articles.state() == state | {"version": 3} and not (tmp_path / "store/articles/data/version=3").exists()  # nothing changes, no rows are written


def test_stored_texts_are_not_shuffled(spark, tmp_path, monkeypatch):
    store = Store(spark, f"{tmp_path}/store", 4)
    store.write("articles", spark.createDataFrame([(i, f"u{i}", "A", "text") for i in range(50)], "id long, normalized_url string, content_hash string, content string"))
    plans, append = [], B.Commit._append
    monkeypatch.setattr(B.Commit, "_append", lambda self, rows: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), append(self, rows)))
    upsert_into(store.articles, spark.createDataFrame([(0, "u7", "B")], "position long, normalized_url string, content_hash string"))
    made, kept = plans
    assert "Exchange hashpartitioning" not in kept and "BroadcastHashJoin" in kept and "Exchange hashpartitioning" in made


def test_a_batch_is_made_twice_and_stored_texts_do_not_visit_python_again(spark, tmp_path, monkeypatch):
    store, rows = Store(spark, f"{tmp_path}/store", 4), 40
    store.write("articles", spark.createDataFrame([(i, f"u{i}", "A", "é") for i in range(0, rows, 2)], "id long, normalized_url string, content_hash string, title string"))
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        made.add(1)
        return x

    new = spark.createDataFrame([(i, f"u{i}", "AB"[i % 4 == 0], "é") for i in range(rows)], "position long, normalized_url string, content_hash string, title string").withColumn("normalized_url", seen("normalized_url"))
    plans, append = [], B.Commit._append
    monkeypatch.setattr(B.Commit, "_append", lambda self, df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), append(self, df)))
    for number in (0, 0):
        ingest.into_store(store)(new, number)
    assert made.value <= 3 * rows  # once for what decides, once for the texts, and once where these are filtered for nulls
    assert len(plans) == 2 and "EvalPython" not in plans[1]
    stored = store.read("articles")
    assert stored.count() == rows and {r[0] for r in stored.select("normalized_title").distinct().collect()} == {"é"}
    assert sorted(r["normalized_url"] for r in stored.where("ai_status = 'pending' and content_hash = 'B'").collect()) == sorted(f"u{i}" for i in range(0, rows, 4))


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store", 4)
    take = ingest.into_store(store)
    rows = lambda *hashes: spark.createDataFrame([(k, "u", h) for k, h in enumerate(hashes)], "position long, normalized_url string, content_hash string")
    take(rows("A", "B", "A"), 0)
    store.articles.replace(store.read("articles").withColumn("ai_status", F.lit("completed")))
    take(rows("A", "B", "A"), 0)
    assert store.read("articles").first()["ai_status"] == "completed"
    take(rows("A"), 1)
    assert store.read("articles").first()["ai_status"] == "completed" and store.articles.state()["batches"] == {"articles": 1}
    ingest.into_store(store, stream="other")(rows("B"), 0)
    assert store.read("articles").first()["ai_status"] == "pending"


def test_a_commit_that_fails_leaves_no_trace(spark, tmp_path, monkeypatch):
    store = Store(spark, f"{tmp_path}/store", 4)
    store.write("articles", spark.createDataFrame([(i, f"u{i}", "A") for i in range(9)], "id long, normalized_url string, content_hash string"))
    new = spark.createDataFrame([(0, "u3", "B"), (1, "u99", "B")], "position long, normalized_url string, content_hash string")
    keep = B.Commit.keep
    monkeypatch.setattr(B.Commit, "keep", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        upsert_into(store.articles, new)
    assert store.articles.state()["version"] == 1 and {r["content_hash"] for r in store.read("articles").collect()} == {"A"}
    monkeypatch.setattr(B.Commit, "keep", keep)
    upsert_into(store.articles, new)
    assert sorted(r["normalized_url"] for r in store.read("articles").where("content_hash = 'B'").collect()) == ["u3", "u99"] and store.read("articles").count() == 10
    with pytest.raises(OSError):
        store.articles.manifests.publish(2, {})


def test_two_kept_versions_can_be_read(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store", 4)
    rows = lambda h: spark.createDataFrame([(i, f"u{i}", h) for i in range(9)], "id long, normalized_url string, content_hash string")
    for h in "ABC":
        store.write("articles", rows(h))
    assert store.versions("articles") == [2, 3]
    assert {r["content_hash"] for r in store.articles.read(state=store.articles.manifests.read(2)).collect()} == {"B"}
    assert sorted(p.name for p in (tmp_path / "store/articles/data").iterdir()) == ["version=2", "version=3"]


def test_snapshots_of_an_older_release_are_taken_in(spark, tmp_path):
    articles(spark, {"title": "Old"}).write.parquet(f"{tmp_path}/store/articles/v3")
    store = Store(spark, f"{tmp_path}/store")
    assert [r["title"] for r in store.read("articles").collect()] == ["Old"]
    store.bucketed()
    assert store.versions("articles") == [1] and [r["title"] for r in store.read("articles").collect()] == ["Old"]


def test_positions_of_sources_do_not_overlap(spark):
    rows = [(k, (p << 33) + i, f"{k}:{p}:{i}") for k in (0, 1, 2) for p in (0, 1, 300) for i in range(3)]
    found = placed(spark.createDataFrame(rows, "_source int, _row long, name string").repartition(4)).orderBy("position").collect()
    assert [r["name"] for r in found] == [n for _, _, n in rows] and [r["position"] for r in found] == list(range(len(rows)))


# The index


def hits(df):
    return [(r["id"], round(r["rank"], 9)) for r in df.collect()]


def test_the_index_equals_a_scan_over_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "PIECE", 7)
    r, store = random.Random(6), Store(spark, f"{tmp_path}/store")
    make = lambda: {"title": " ".join(r.choice("abc") for _ in range(r.randint(0, 5))), "content": " ".join(r.choice("abcdé") for _ in range(r.randint(0, 20))), "title_ja": "".join(r.choice("新モデル発aB🙂") for _ in range(r.randint(0, 12))), "summary_ja": "".join(r.choice("モデル") for _ in range(r.randint(0, 9))), "category": r.choice(["x", "y"])}
    have = {i: make() for i in range(1, 41)}
    frame = lambda some: articles(spark, *({"id": i, **have[i]} for i in some))
    store.segments.rebuild(frame(have))
    queries = {"a-b": None, "é d": "x", "b-a-b c": None, "モデル": "x", "デルモデ ab": None, "モデルモデルモデ": None}
    for step in range(5):
        changed, gone = {r.randint(1, 60) for _ in range(3)}, set(r.sample(sorted(have), 2))
        changed -= gone
        have |= {i: make() for i in changed}
        for i in gone:
            del have[i]
        store.segments.change(frame(sorted(changed)), spark.createDataFrame([(i,) for i in gone], "id long"))
        if step % 2:
            continue
        rows = frame(sorted(have))
        for q, category in queries.items():
            assert hits(store.segments.search_words(q, category, 1000)) == hits(search.search_words(rows, q, category, 1000).select("id", "rank"))
            assert hits(store.segments.search_trigrams(q, category, 1000)) == hits(search.search_trigrams(rows, q, category, 1000).select("id", "rank"))
        both = [tuple(x) for x in store.segments.search(rows, "a モデル", None, 50, True).collect()]
        assert both == [tuple(x) for x in search.search(rows, "a モデル", None, 50, True).collect()]
    state = store.segments.state()
    assert state["totals"]["docs"] == len(have) == sum(state["segments"].values()) and len(state["segments"]) <= 2 * I.FAN


def test_segments_are_small_merged_and_read_by_term(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    rows = articles(spark, *({"title": f"word{i} common"} for i in range(30)))
    store.segments.rebuild(rows)
    for i in range(5):
        store.segments.change(rows.where(f"id = {i + 1}").withColumn("title", F.lit(f"other{i} common")))
    state = store.segments.state()
    assert state["totals"]["docs"] == 30 and len(state["segments"]) <= 3 and max(state["segments"].values()) == 25
    assert sorted(ids(store.segments.search_words("common", None, 99))) == list(range(1, 31)) and ids(store.segments.search_words("word1")) == [] and ids(store.segments.search_words("other3")) == [4]
    plan = store.segments.postings("words", ["common"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,common)" in plan or "PushedFilters: [In(term" in plan
    store.segments.change(rows.where("false"), rows.where("id = 30").select("id"))
    assert store.segments.state()["totals"]["docs"] == 29 and 30 not in ids(store.segments.search_words("common", None, 99))


def test_a_frequent_term_is_many_tasks_work(spark, monkeypatch):
    monkeypatch.setattr(search, "PIECE", 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = search.postings(articles(spark, *({"title": "the same"} for _ in range(200)))).where("term = 'the'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(r["count"] for r in parts) < 150


def test_bitmaps_hold_the_ids(spark):
    some = [1, 2, 32768, 32769, 65536, 65537, 10**12, 0, -1, -40000]
    rows = spark.createDataFrame([(1, i) for i in some], "segment int, id long")
    asked = spark.createDataFrame([(1, i + d) for i in some for d in (-1, 0, 1)], "segment int, id long").distinct()
    joined = asked.withColumn("bucket", F.bitmap_bucket_number("id")).join(I.bitmaps(rows), ["segment", "bucket"], "left")
    assert sorted(r["id"] for r in joined.where(I.marked()).collect()) == sorted(some)


# Duplicates by batch


def test_marks_kept_up_equal_marks_made_anew(spark, tmp_path):
    r, store = random.Random(9), Store(spark, f"{tmp_path}/store", 4)
    for step in range(3):
        new = [(k, f"u{r.randrange(25)}", r.choice("ABCDEFG"), r.choice([f"the title of some letters {r.randrange(4)}", "short", "Ｔhe title of some letters 1"]), r.choice("xyz"), NOW + timedelta(hours=r.randrange(6)), NOW) for k in range(18)]
        before = store.articles.state()
        rows = upsert_into(store.articles, spark.createDataFrame(new, INCOMING + ", published_at timestamp_ntz, fetched_at timestamp_ntz"))
        store.marked(rows.select("normalized_url"), before)
        stored = store.read("articles")
        want = duplicates.marked(stored, datetime(1990, 1, 1), datetime(2100, 1, 1)).select("id", "duplicate_of_id", "duplicate_score")
        assert sorted(map(tuple, stored.select("id", "duplicate_of_id", "duplicate_score").collect())) == sorted(map(tuple, want.collect()))
        assert step == 0 or stored.where("duplicate_of_id is not null").count()


# Daily windows


def test_days_are_appended_once_the_watermark_has_passed(spark, tmp_path):
    day = datetime(2024, 5, 1)
    schema = "source_key string, published_at timestamp_ntz, fetched_at timestamp_ntz"
    run = lambda: ingest.count_days(ingest.landed(spark, f"{tmp_path}/landing", spark.createDataFrame([], schema).schema), f"{tmp_path}/days", f"{tmp_path}/checkpoint", "6 hours")
    land = lambda *at: spark.createDataFrame([(s, t, day) for s, t in at], schema).write.mode("append").parquet(f"{tmp_path}/landing")
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/days").select("day", "source_key", "articles").collect())
    land(("a", day), ("a", day + timedelta(hours=5)), ("b", day + timedelta(hours=29)))
    run()
    assert read() == []  # 29 h less 6: the first day isn't over
    land(("a", day + timedelta(hours=31)), ("a", day + timedelta(hours=1)), ("b", None))
    run()
    assert read() == [(day.date(), "a", 3), (day.date(), "b", 1)]
    land(("a", day + timedelta(hours=2)), ("c", day + timedelta(hours=3)), ("b", day + timedelta(days=9)))
    progress = run()
    assert sum(p["late"] for p in progress) == 2
    assert read() == [(day.date(), "a", 3), (day.date(), "b", 1), ((day + timedelta(days=1)).date(), "a", 1), ((day + timedelta(days=1)).date(), "b", 1)]


# Crawls


def test_a_crawl_in_two_stages(spark, tmp_path):
    """Feeds in their own encoding, lists on two hosts, one without links; a host's pages in turn, with its delay."""
    import http.server
    import threading
    import time

    from tidewire.plans.crawl import crawl
    from tidewire.sources import config

    from .test_articles import RSS

    plain = RSS.split("?>", 1)[1] if RSS.lstrip().startswith("<?xml") else RSS
    (tmp_path / "sjis.xml").write_bytes(('<?xml version="1.0" encoding="Shift_JIS"?>' + plain.replace("Tide Gauge", "潮位計")).encode("shift_jis", "xmlcharrefreplace"))
    (tmp_path / "wide.xml").write_bytes(('<?xml version="1.0" encoding="UTF-16"?>' + plain.replace("Tide Gauge", "広い")).encode("utf-16"))
    (tmp_path / "list.html").write_text('<main><a href="/p1.html">1</a><a href="/p2.html">2</a><a href="/none.html">3</a></main>')
    (tmp_path / "bare.html").write_text("<main>nothing</main>")
    for k in (1, 2):
        (tmp_path / f"p{k}.html").write_text(f"<h1>Page {k}</h1><main>Text {k}</main>")
    seen = []

    class Handler(http.server.SimpleHTTPRequestHandler):
        def __init__(self, *a):
            super().__init__(*a, directory=str(tmp_path))

        def do_GET(self):
            seen.append((self.headers["Host"].split(":")[0], self.path, time.monotonic()))
            super().do_GET()

        def log_message(self, *_):
            pass

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        on = lambda host: f"http://{host}:{server.server_port}"
        made = [{"key": "s/jis", "feed_url": f"{on('127.0.0.1')}/sjis.xml", "category": "tech"}, {"key": "wide", "feed_url": f"{on('127.0.0.1')}/wide.xml", "category": "tech"}]
        made += [{"key": f"on {h}", "fetch_method": "html", "list_url": f"{on(h)}/list.html"} for h in ("127.0.0.1", "localhost")]
        made += [{"key": "bare", "fetch_method": "html", "list_url": f"{on('127.0.0.1')}/bare.html"}, {"key": "gone", "fetch_method": "html", "list_url": f"{on('127.0.0.1')}/gone.html"}]
        store = Store(spark, f"{tmp_path}/store", 4)
        found = {r["source_key"]: (r["status"], r["article_count"]) for r in crawl(store, [config.checked(s) for s in made], delay=0.5, timeout=5).collect()}
        server.shutdown()
    assert found == {"s/jis": ("success", 1), "wide": ("success", 1), "on 127.0.0.1": ("success", 2), "on localhost": ("success", 2), "bare": ("success", 0), "gone": ("failed", 0)}
    titles = [r["title"] for r in store.read("articles").orderBy("id").collect()]
    assert titles[0] in ("潮位計", "広い") and sorted(titles[1:]) == ["Page 1", "Page 1", "Page 2", "Page 2"]
    assert ids(store.search("Page")) == [2, 3, 4, 5] and store.segments.exists()
    for host in ("127.0.0.1", "localhost"):
        times = [t for h, path, t in seen if h == host and path in ("/p1.html", "/p2.html", "/none.html")]
        assert len(times) == 3 and all(b - a >= 0.45 for a, b in zip(times, times[1:], strict=False))


def test_digest_files_are_written_by_tasks_and_put_into_place_whole(spark, tmp_path, request):
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many tasks for these few rows as for many
    at = datetime(2026, 9, 20, 1)
    rows = [(i, f"s{i % 3 if i % 7 else 0}", f"Title {i}", f"https://e.com/{i}", at + timedelta(minutes=i) if i % 5 else None, at + timedelta(hours=i // 30), "completed" if i % 2 else "pending", f"要約{i}" if i % 4 == 1 else "", "") for i in range(1, 2001)]
    made = conformed(spark.createDataFrame(rows, "id long, source_key string, title string, url string, published_at timestamp_ntz, fetched_at timestamp_ntz, ai_status string, title_ja string, summary_ja string"))
    names = spark.createDataFrame([("s1", "Source 1")], "key string, name string")
    for only_summarized in (False, True):
        root = tmp_path / f"d{only_summarized}"
        written, skipped = digest.write(made, root, names, only_summarized)
        want = {r["day"].isoformat(): (r["text"], r["n"]) for r in digest.rendered(made, names, only_summarized).collect()}
        assert {p.stem: (p.read_text(), n) for p, n in written} == want and len(want) > 2 and skipped == []
        assert sorted(p.name for p in root.rglob("*") if p.is_file()) == sorted(f"{d}.md" for d in want) and [p.name for p in root.iterdir()] == ["2026"]
    laid = digest.lines(made, names).select("file", F.spark_partition_id().alias("p")).distinct().groupBy("file").count()
    assert laid.agg(F.max("count")).first()[0] > 1  # a day is written by several tasks


def test_files_stay_as_they_were_when_a_task_fails(spark, tmp_path):
    good = spark.createDataFrame([("2026/a.md", "one"), ("2026/a.md", "two"), ("2026/b.md", "")], "file string, text string").coalesce(1)
    files.write(good, tmp_path)
    assert (tmp_path / "2026" / "a.md").read_text() == "one\ntwo\n" and (tmp_path / "2026" / "b.md").read_text() == "\n"
    bad = spark.range(0, 400, 1, 4).select(F.lit("2026/a.md").alias("file"), F.when(F.col("id") == 399, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("text"))
    with pytest.raises(Exception, match="lost"):
        files.write(bad, tmp_path)
    assert (tmp_path / "2026" / "a.md").read_text() == "one\ntwo\n"
    assert [p.name for p in tmp_path.iterdir()] == ["2026"]
    files.write(good.where("false"), f"file://{tmp_path}/none")
    assert list((tmp_path / "none").iterdir()) == []
    with pytest.raises(ValueError):
        files.write(good, "hdfs://host/x")
