"""Literal cases of the column functions."""

from datetime import datetime
from urllib.parse import parse_qsl, quote_plus

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://harbour.example/log/7/?utm_campaign=x&gclid=9&sp_source=q", "https://harbour.example/log/7"),
        ("HTTP://Harbour.Example:80/a/b/?z=2&c=1&c=0#top", "http://harbour.example/a/b?c=1&c=0&z=2"),
        ("https://h.example:443?", "https://h.example/"),
        ("http://h.example:443/x", "http://h.example:443/x"),
        (" https://e.com//a///b/?x=&y=a+b%2Ac~ ", "https://e.com/a/b?y=a+b%2Ac~"),
        ("https://e.com/p;x?utm_Any=1&UTM_source=2&z=1", "https://e.com/p?z=1"),
        ("", ""),
        (None, ""),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, url, X.normalize_url) == want


def test_normalize_url_is_idempotent_and_keeps_its_pairs(spark):
    values = ["a b", "ü&=", "x*~", "+%", "1"]
    urls = [f"https://h.example/p?k{i}={quote_plus(v)}&a={i}" for i, v in enumerate(values)]
    made = spark.createDataFrame([(u,) for u in urls], "u string").select(X.normalize_url("u").alias("n")).withColumn("again", X.normalize_url("n")).collect()
    for u, r in zip(urls, made, strict=True):
        assert r["n"] == r["again"]
        assert sorted(parse_qsl(u.split("?")[1])) == sorted(parse_qsl(r["n"].split("?")[1]))


def test_clean_text(spark):
    assert one(spark, "\ttide \t at\rnoon \r\n \r\n\n\n ebb\u3000 ", X.clean_text) == "tide at\nnoon\n\nebb"
    assert one(spark, None, X.clean_text) == ""


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab \t\r\n　\x85", max_size=20), min_size=1, max_size=20))
def test_clean_text_is_idempotent(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(X.clean_text("v").alias("c")).withColumn("again", X.clean_text("c")).collect()
    assert all(r["c"] == r["again"] for r in rows)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2031年2月3日", datetime(2031, 2, 3)),
        ("2031/02/03 04:05 公開", datetime(2031, 2, 3, 4, 5)),
        ("2031-02-03T04:05:06-02:30", datetime(2031, 2, 3, 4, 5, 6)),
        ("2031-02-03 04:05:06Z", datetime(2031, 2, 3, 4, 5, 6)),
        ("Tue, 04 Feb 2031 05:06:07 GMT", datetime(2031, 2, 4, 5, 6, 7)),
        ("on the 5th of February 2031", datetime(2031, 2, 5)),
        ("12", None),
        ("no date at all", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_datetime(spark, text, want):
    assert one(spark, text, X.parse_datetime) == want


@pytest.mark.parametrize(("title", "want"), [(" 潮位 \t Ｔable ①", "潮位Table1"), ("ﾃﾞｰﾀ　集", "データ集"), ("low tide", "lowtide"), (None, "")])
def test_normalize_title(spark, title, want):
    assert one(spark, title, X.normalize_title) == want


def test_small_functions(spark):
    assert one(spark, " a \n b ", X.one_line) == "a b"
    assert one(spark, "x" * 201, X.shortened) == "x" * 200 + "..."
    assert [one(spark, c, X.category_title) for c in ("llm", "tech", "research", "aBC DEF")] == ["LLM", "TECH", "Research", "Abc def"]
    assert one(spark, "Models like GPT-4 by OpenAI is a 42", X.english_words) == ["models", "like", "gpt-4", "openai"]
    assert one(spark, "新しいモデルを発表 GPT-5", X.script_runs) == ["モデル", "発表", "GPT-5"]
    assert one(spark, [" AI ", "x", "42", "The", "Deep Learning"], X.clean_tags, "array<string>") == ["ai", "deep learning"]


def test_merge_tags(spark):
    df = spark.createDataFrame([(["RSS", "OpenAI"], ["openai", "MCP", "", None]), (None, None), ([], [" "])], "t array<string>, k array<string>")
    assert [r[0] for r in df.select(X.merge_tags(F.col("t"), F.col("k"))).collect()] == [["RSS", "OpenAI", "MCP"], None, None]


def test_parse_reply(spark):
    replies = ['{"title_ja": "a", "summary_ja": "b", "keywords": ["k"]}', 'x\n```json\n{"title_ja": "a", "summary_ja": "b"}\n```', "no", '{"title_ja": "a"}', None]
    found = [one(spark, r, X.parse_reply) for r in replies]
    assert [f and (f["title_ja"], f["summary_ja"], f["keywords"]) for f in found] == [("a", "b", ["k"]), ("a", "b", []), None, None, None]


def test_article_date(spark):
    rows = [(datetime(2026, 9, 19, 8), datetime(2026, 9, 20)), (None, datetime(2026, 9, 20)), (datetime(2028, 1, 1), datetime(2026, 9, 20, 5))]
    found = spark.createDataFrame(rows, "published_at timestamp_ntz, fetched_at timestamp_ntz").select(X.article_date().alias("d"), X.clock().alias("c")).collect()
    assert [(str(r["d"]), r["c"]) for r in found] == [("2026-09-19", "08:00"), ("2026-09-20", "--:--"), ("2026-09-20", "--:--")]


def test_join_url(spark):
    base = "https://e.com/a/b.html?q=1"
    for link, want in {"/x": "https://e.com/x", "y": "https://e.com/a/y", "../z": "https://e.com/z", "//h.com/p": "https://h.com/p", "https://o.com/": "https://o.com/", "?p=2": "https://e.com/a/b.html?p=2"}.items():
        assert one(spark, link, lambda c: X.join_url(F.lit(base), c)) == want


def test_long_titles_visit_python_a_hundred_at_a_time(spark, capsys):
    rows = spark.createDataFrame([("Ａ title　of a story",), (None,), ("plain",)], "title string")
    found = rows.select(X.normalize_title("title").alias("t"))
    found.explain()
    plan = capsys.readouterr().out
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan  # an Arrow batch holds 10,000 titles
    assert [r.t for r in found.collect()] == ["Atitleofastory", "", "plain"]
