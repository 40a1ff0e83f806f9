"""The pipeline against a plain version of its stages: SQL for the rules, all pairs, full alignment, one path at a
time, and the library's tokens."""

import random

import duckdb
import pytest

import corpus_pipeline
from tidewire.llm import pii
from tidewire.llm.sql import SQL

from .test_operators import BPE, aligned, base, best_path, components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, at = random.Random(3), tmp_path_factory.mktemp("corpus")
    word = lambda: "".join(r.choice("abcdefghijklmn") for _ in range(r.randint(3, 7)))
    item = [word() for _ in range(30)]
    rows = []
    for i in range(160):
        w = [word() for _ in range(r.randint(60, 150))]
        if i % 10 == 1:
            w = list(rows[-1][1].split(" "))
            w[5] = word()
        if i % 10 == 3:
            w[20:20] = item
        if i % 20 == 13:  # paraphrased
            w[20:50] = [word() if k % 7 == 3 else x for k, x in enumerate(item)]
        if i % 10 == 5:
            w[10:10] = ["mail", "x.1@mail.example.com", "now,", "token", "=", '"04dbebab91ab85687d33eeaaf9ac699e1188f962"', "+1", "(425)", "555-9684"]
        if i % 10 == 7:
            w = w[:20]
        if i % 40 == 9:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w), "en", f"s{i % 2}", 0))
    rows += [(None, None, None, None, None), (500, None, "en", "s0", None), (501, "", None, "s0", 0), (502, " ".join(f"w{k}" for k in range(30000)), "en", None, 0), (None, rows[2][1] + " more", "en", "s0", 1), rows[0]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), item


def redacted(text, model):
    spans = base(text)
    tokens = [(m[0], m.start()) for m in pii._TOKEN.finditer(text)]
    for (token, start), label in zip(tokens, best_path(model, [t for t, _ in tokens]), strict=True):
        s, e = pii._core(token, start)
        if label == pii.LABELS.index("secret") and e > s and not any(a < e and s < b for a, _, b in spans):
            spans.append((s, 4, e))
    for s, k, e in sorted(spans, reverse=True):
        text = text[:s] + f"[{pii.KINDS[k].upper()}]" + text[e:]
    return text


def test_stages(spark, folder):
    import public_tokenizers
    import tiktoken

    at, item = folder
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
    rows = con.sql(f"SELECT r.kept, d.* FROM (SELECT row_number() OVER () AS k, * FROM documents) d JOIN (SELECT row_number() OVER () AS k, * FROM ({SQL['op5_quality_rules']})) r ON d.doc_id IS NOT DISTINCT FROM r.doc_id AND len(regexp_extract_all(coalesce(d.text, ''), '[^ ]+')) = r.n_words").fetchall()
    left = {(i, t) for kept, _, i, t, *_ in rows if kept}
    assert 90 < len(left) < 150 and len({i for i, _ in left if i is None}) == 1
    heads = components([x for x in left if x[0] is not None])
    left = {(i, t) for i, t in left if i is None or heads[i][2]}
    left = {(i, t) for i, t in left if aligned(item, t.split(" ")) < len(item)}
    model = pii.field()
    want = sorted(((i, redacted(t, model)) for i, t in left), key=str)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs.withColumns({"kept": docs.text, "_mark": docs.text}), at)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3]
    made = docs.collect()
    assert sorted({(r["doc_id"], r["text"]) for r in made}, key=str) == want and any("[SECRET]" in t and "[PHONE]" in t for _, t in want)
    assert all(r["n_chars"] == len(r["text"]) for r in made)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=corpus_pipeline.bpe._ranks(BPE).ranks, special_tokens={})
    out = corpus_pipeline.run(spark, at).collect()
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out)
    assert sorted({(r["doc_id"], tuple(r["ids"])) for r in out}, key=str) == sorted(((i, tuple(known.encode_ordinary(t))) for i, t in want), key=str)


def test_stages_of_an_empty_table(spark, folder, tmp_path):
    at, _ = folder
    spark.read.parquet(f"{at}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{at}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
