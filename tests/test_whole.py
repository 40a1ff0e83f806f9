"""Queries over whole tables and whole texts, against brute force in Python."""

import json
import re
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.functions.words import ENGLISH, JAPANESE
from tidewire.operators import terms
from tidewire.plans.queries import QUERIES

TEXTS = ["it\u2019s a well-known na\u00efve caf\u00e9 -- co-op", "-dash dash- -x- a--b snake_case x\u00b2 gpt-4\u6f22\u5b57", "\u201cquoted words\u201d \u2014 wor\u0301ds", "caf\u00e9-bar 3.5-4 --", "\u00e9-ab-\u00e9 -ab", ""]


def words(text: str) -> list[str]:
    return [w for w in re.findall(r"\b[a-zA-Z0-9-]{2,}\b", text.lower()) if w not in ENGLISH and not re.match(r"^[0-9.-]+$", w)]


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, t, lang, f"src{i % 3}", len(t)) for i, (t, lang) in enumerate((t, lang) for t in TEXTS for lang in ("en", "de"))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "Click"), (2, "word"), (7, "would")], "user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path), [t.split("\n")[0] + " " + (t[:500] if i % 4 == 1 else "") + " " + t for i, t, *_ in rows]


def runs(text: str) -> list[str]:
    found = regex.findall(r"[\p{Han}々]+|[\p{Katakana}ー]+|[A-Za-z0-9][A-Za-z0-9.-]*", text)
    return [w for w in found if len(w) > 1 and w not in JAPANESE and not re.match(r"^[0-9.]+$", w)]


def test_words_of_all_articles(spark, folder):
    assert dict(QUERIES["word_freq"](spark, folder[0]).collect()) == dict(Counter(w for t in folder[1] for w in words(t)))


def test_trending_counts_all_articles_and_tags(spark, folder):
    want = Counter(w for t in folder[1] for w in runs(t) if w.lower() not in ("would", "thing"))
    want.update(runs("新モデル src0 発表された\nモデル v0"))  # of the one article that has a label
    want.update(["click", "type-click", "word", "type-word", "would", "type-would"])
    want.subtract(["would"])  # a stop word as a tag
    want = sorted(((w, n) for w, n in want.items() if n >= 2), key=lambda x: (-x[1], x[0]))[:50]
    assert [tuple(r) for r in QUERIES["trending_keywords"](spark, folder[0]).collect()] == want


def test_english_words_count_where_the_segmenter_finds_none(spark):
    rows = spark.createDataFrame([("tide and tide", "", "gauge 漢字")], "title string, summary string, content string")
    nothing = lambda c: F.array().cast("array<string>")
    assert dict(terms.original_counts(rows, nothing).collect()) == {"tide": 2, "gauge": 1}
    assert dict(terms.original_counts(rows).collect()) == {"tide": 2, "and": 1, "gauge": 1, "漢字": 1}
    assert dict(terms.original_counts(rows, stop=["tide", "and", "漢字"], keep=["gauge", "tide"]).collect()) == {"gauge": 1}


def test_top_terms_of_all_articles(spark, folder):
    want = sorted(Counter(w for t in folder[1] for w in words(t)).items(), key=lambda x: (-x[1], x[0]))[:50]
    assert sorted(tuple(r) for r in QUERIES["new_vs_existing"](spark, folder[0]).collect()) == sorted((w, n, "existing" if len(w) % 2 == 0 else "new") for w, n in want)


def test_english_words_are_those_of_python(spark):
    made = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert [r[0] for r in made.select(X.english_words(made.t)).collect()] == [words(t) for t in TEXTS]


def parsed(turn: int, t: str) -> tuple:
    body = {"title_ja": t, "summary_ja": t.lower()}
    reply = [json.dumps(body | {"keywords": ["a", "b"]}, ensure_ascii=False), f"Here:\n```json\n{json.dumps(body, ensure_ascii=False)}\n```\n", t, '{"title_ja": "x"}'][turn % 4]
    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", reply, re.DOTALL)
    try:
        made = json.loads(fenced[1] if fenced else reply.strip())
        return made["title_ja"], made["summary_ja"], ",".join(made.get("keywords", []))
    except (KeyError, TypeError, ValueError):
        return None, None, None


def test_replies_hold_whole_texts(spark, tmp_path):
    texts = ["short", "long " * 500, 'a "quoted" word', "back\\slash \\n \\u0041", "lines\nand\ttabs\r\x01", "\u65b0\u3057\u3044 \U0001f600 \u00e9", "code:\n```python\nprint({})\n``` and more", "braces } { ``` x", ""]
    rows = [(c, turn, "user", t) for c, t in enumerate(texts) for turn in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {(r["conv_id"], r["turn"]): (r["title_ja"], r["summary_ja"], r["keywords"]) for r in QUERIES["ai_parse"](spark, str(tmp_path)).collect()}
    assert found == {(c, turn): parsed(turn, t) for c, turn, _, t in rows}
