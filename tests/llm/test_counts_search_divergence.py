"""Token counts against the library, ranked search and divergence against brute force, and all on odd tables."""

import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from tidewire.llm import divergence, queries, ranked_search, token_counts

from .test_operators import docs, odd, texts  # noqa: F401

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# Token counts


def test_token_counts_equal_the_library(docs, odd, library):  # noqa: F811
    for df in (docs, odd):
        want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or ""))) for r in df.collect()), key=str)
        found = token_counts.over(df, MODEL, 100)
        assert rows_of(found, "doc_id", "n_bytes", "n_tokens") == want
        assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in found.collect())
        assert set(df.columns) - {"n_bytes", "n_tokens"} <= set(found.columns)
    assert token_counts.counted(odd.where("false"), MODEL).collect() == []


def test_token_counts_of_random_and_long_texts(library, monkeypatch):
    r, alphabet = random.Random(5), ["a", "b", "the", "ing", " ", "  ", "     ", "▁", "\n", "\t", "\0", "é", "é", "漢", "が", "🙂", "<s>", "</s>", "<0x0A>", "ﬁ", "　", ".", "!!", "1234"]
    some = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 120 if k % 7 == 0 else 20))) for k in range(4000)]
    some += ["a" * 20000, "ab" * 9000, "漢字" * 9000, " " * 9001, "▁a" * 500, "x" * 63 + "y", "x" * 64, "x" * 65]
    pieces = token_counts.pieces(MODEL)
    want = [len(library.encode(t)) for t in some]
    assert list(pieces(some)) == want
    monkeypatch.setattr(token_counts, "CACHE_BYTES", 5000)
    monkeypatch.setattr(token_counts, "SLICE", 300)
    monkeypatch.setattr(token_counts, "KEPT", 6)
    assert list(pieces(some)) == want and pieces.size < 200_000
    assert [pieces.merged(t.replace(" ", "▁")) for t in ("▁" * 9, "▁theing▁")] == [len(library.encode(" " * 8)), pieces.of_cuts(["▁theing▁"])[0]]


def naive_merges(text, scores):
    """One pass over all pairs for each merge."""
    s, merges = list(text), 0
    while True:
        best = max(((scores[s[i] + s[i + 1]], -i) for i in range(len(s) - 1) if s[i] + s[i + 1] in scores), default=None)
        if best is None:
            return len(text) - merges + sum(len(c.encode()) - 1 for c in s if len(c) == 1 and c not in scores)
        i = -best[1]
        s[i : i + 2] = [s[i] + s[i + 1]]
        merges += 1


def test_merging_by_heaps_equals_a_search_for_the_best_pair():
    r = random.Random(2)
    for _ in range(60):
        letters = "abcdé"[: r.randint(2, 5)]
        made = set(letters) - ({"c"} if r.random() < 0.3 else set())  # a letter that is in pieces only
        for _ in range(r.randint(3, 25)):
            made.add("".join(r.choice(letters) for _ in range(r.randint(2, 5))))
        scores = {p: -float(r.randint(0, 9)) for p in made}
        pieces = token_counts.Pieces(scores)
        some = ["".join(r.choice(letters + "z") for _ in range(r.randint(1, 100))) for _ in range(30)]
        assert pieces.of_cuts(some) == [naive_merges(t, scores) for t in some]
        assert [pieces.merged(t) for t in some] == [naive_merges(t, scores) for t in some]


# Ranked search


def best_documents(docs, items, k):  # noqa: F811
    words = [re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode().lower()) for _, t in docs]
    n, total = sum(1 for w in words if w), sum(map(len, words))
    tfs, df = [Counter(w) for w in words], Counter(t for w in words for t in set(w))
    found = []
    for item, text in items:
        terms = set(re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode().lower()))
        scored = []
        for (doc, _), tf, w in zip(docs, tfs, words, strict=True):
            m = 50 + (50 * len(w) * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in terms if tf[t])
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        found += [(item, i + 1, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scored)[:k])]
    return sorted(found, key=str)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_ranked_search_equals_brute_force(spark, monkeypatch, k):
    r = random.Random(k)
    word = lambda: "abcdefghijklmnopqrstuvwxyz"[min(int(r.expovariate(0.2)), 25)] * r.choice([1, 1, 2])
    some = [(i, " ".join(word() for _ in range(r.randint(0, 40)))) for i in range(300)]
    some += [(i + 1000, some[7][1]) for i in range(60)] + [(None, None), (None, "a bb c"), (5, "a bb c"), (5, "a bb c"), (2000, ""), (2001, "the " * 5000 + "zz")]
    items = [(i, " ".join(word() for _ in range(r.randint(1, 12)))) for i in range(12)] + [(90, some[7][1]), (91, None), (92, "nowhere é"), (92, "ZZ zz"), (None, "a")]
    for name, value in {"PIECE": 40, "PAIRS": 30, "ENTRIES": 50, "CELLS": 40}.items():
        monkeypatch.setattr(ranked_search, name, value)
    docs = spark.createDataFrame([(*x, "x", 1, 2) for x in some], "doc_id long, text string, score string, row long, t long").repartition(5, "text")  # noqa: F811
    found = ranked_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), k)
    assert rows_of(found, "item_id", "rank", "doc_id", "score") == best_documents(some, items, k)


def test_ranked_search_of_empty_tables(spark, odd):  # noqa: F811
    items = spark.createDataFrame([(1, "the same words"), (2, "")], "item_id long, text string")
    assert [r["doc_id"] for r in ranked_search.search(odd, items, 3).orderBy("rank").collect()][:1] == [-5]
    assert ranked_search.search(odd.where("false"), items).collect() == [] == ranked_search.search(odd, items.where("false")).collect()


# Divergence


def divergences(rows, top=200):
    groups, langs, seen = {}, {}, {}
    for lang, source, text in rows:
        words = Counter(re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode().lower()))
        groups.setdefault((lang or "", source or ""), Counter()).update(words)
        langs.setdefault(lang or "", Counter()).update(words)
        seen.setdefault(lang or "", Counter()).update(set(words))
    found = []
    for (lang, source), own in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= 3]
        p = lambda counts: {t: 1 + 1000000000 * (counts[t] + 1) // (sum(counts[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        here, whole = p(own), p(langs[lang])
        f = lambda a, b: (a - b) ** 2 // b
        pairs = [(-sum(f(here[t], q[t]) for t in kept), s.encode()) for (x, s), other in groups.items() if x == lang and s != source for q in [p(other)]]
        terms = [(-f(here[t], whole[t]), t) for t in kept if own[t] and here[t] > whole[t]]
        for part, some in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            found += [(lang, source, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(some)]
    return sorted(found, key=str)


def test_divergence_equals_brute_force(spark, monkeypatch):
    r = random.Random(8)
    word = lambda: r.choice(["a", "b", "the", "é", "漢字", "x1y", "Be", "be"]) + r.choice(["", "s", "ing"])
    some = [(r.choice(["en", "de", None]), r.choice(["s0", "s0", "s0", "s1", "s2", "ß", None, f"r{r.randint(0, 4)}"]), " ".join(word() for _ in range(r.randint(0, 30)))) for _ in range(250)]
    some += [("en", "quiet", None), ("xx", "a", "once only"), ("xx", "b", "other words"), ("yy", "alone", "the the"), ("en", "s0", "long " * 20000)]
    for name, value in {"BLOCK": 2, "SPAN": 5, "CHUNK": 2, "TERMS": 20}.items():
        monkeypatch.setattr(divergence, name, value)
    rows = spark.createDataFrame([(*x, "q", 1) for x in some], "lang string, source string, text string, term string, n int").repartition(4)
    found = divergence.audit(rows)
    want = divergences(some)
    assert rows_of(found, "lang", "source", "part", "item", "value", "rank") == want
    assert {(w[0], w[2]) for w in want} >= {("xx", "pair"), ("en", "term")}
    assert divergence.audit(rows.where("false")).collect() == []


def test_frequencies_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(10**12, 3 * 10**12, 10**9)], "n long, total long, v long").select(divergence.frequency(F.col("n"), F.col("total"), F.col("v")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (10**12 + 1) // (3 * 10**12 + 10**9)


def test_op11_query(spark, tmp_path, library):
    some = [(i, t, "en", "s") for i, t in enumerate(texts(20))] + [(None, None, None, None), (99, " ".join(f"w{i}" for i in range(9000)), "en", "s")]
    spark.createDataFrame(some, TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_token_counts(spark, str(tmp_path))
    want = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, *_ in some]
    assert rows_of(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(((*w, w[2] > 4096) for w in want), key=str)
