"""Japanese words by a lattice: against all paths of short texts, and by the sentences that a dictionary explains."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidewire.functions import lattice as L
from tidewire.operators import terms
from tidewire.sources import config

WORDS = [("走る", "verb5"), ("行う", "verb"), ("行く", "verb"), ("食べる", "verb"), ("書く", "verb"), ("新しい", "adjective"), ("すもも", "noun"), ("もも", "noun"), ("うち", "noun"), ("生成AI", "noun"), ("東京", "noun"), ("京都", "noun"), ("都", "noun")]
KNOWN = L.lexicon(WORDS)
LONGEST = max(map(len, KNOWN))


def found(text):
    return [(w.surface, w.lemma) for w in L.cheapest(text, KNOWN, LONGEST) if w.kind in ("noun", "verb", "adjective")]


def paths(text, at=0):
    """All ways to part a text into dictionary words and unknown words of one script."""
    if at == len(text):
        yield []
        return
    for end in range(at + 1, len(text) + 1):
        part = text[at:end]
        some = list(KNOWN.get(part, ()))
        scripts = {L.script(c) for c in part}
        whole = end == len(text) or L.script(text[end]) not in scripts
        if len(scripts) == 1 and (whole or (scripts <= {"kanji", "hiragana"} and len(part) <= L.UNKNOWN)):
            some.append(L.Word(part, part.strip(".-") or part, "noun"))
        for word in some:
            for rest in paths(text, end):
                yield [word, *rest]


def test_the_path_is_the_cheapest_of_all():
    draw = random.Random(3)
    pieces = ["走", "っ", "た", "る", "も", "す", "新", "し", "い", "く", "行", "京", "都", "東", "モ", "ー", "A", "I", "生", "成", "う", "ち", "の", "5"]
    for _ in range(300):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(1, 9)))
        path = L.cheapest(text, KNOWN, LONGEST)
        assert "".join(w.surface for w in path) == text
        assert L.price(path, KNOWN) == min(L.price(p, KNOWN) for p in paths(text)), text


def test_inflected_words_have_their_dictionary_form():
    for text in ("走る", "走った", "走れば", "走らない", "走ります", "走ろう"):
        assert found(text) == [(text[:2], "走る")], text
    assert found("行った")[0][1] in ("行く", "行う") and found("行わない") == [("行わ", "行う")]
    assert found("食べた") == [("食べ", "食べる")] and found("食べれば") == [("食べれ", "食べる")] and found("書いた") == [("書い", "書く")]
    assert [w for _, w in found("新しかった東京都のモデル")] == ["新しい", "東京", "都", "モデル"]
    assert [s for s, _ in found("すもももももももものうち")] == ["すもも", "もも", "もも", "うち"]
    assert [s for s, _ in found("生成AIとGPT-5モデル")] == ["生成AI", "GPT-5", "モデル"]
    for lemma, kind in (("走", "verb"), ("モデル", "adjective"), ("x", "particles")):
        with pytest.raises(ValueError):
            L.inflected(lemma, kind)


def test_long_runs_cost_as_much_as_their_letters():
    start = time.time()
    for text in ("漢" * 200_000, "モデル" * 50_000, "も" * 100_000, "走った" * 30_000):
        assert sum(len(w.surface) for w in L.cheapest(text, KNOWN, LONGEST)) == len(text)
    assert time.time() - start < 60


def test_terms_by_dictionary(spark, tmp_path):
    path = tmp_path / "ai_keywords.yaml"
    path.write_text("ai_keywords:\n  - 言語モデル\nwords:\n  - 走る: verb5\n  - 新しい: adjective\n  - 東京\n", encoding="utf-8")
    words = config.dictionary(path)
    assert words["words"] == [("走る", "verb5"), ("新しい", "adjective"), ("東京", "noun")]
    segment = terms.segment_of(words)
    rows = spark.createDataFrame([(1, "走る、走った、走れば。新しい言語モデル 12 GPT-5 a"), (2, None), (3, ""), (4, "東京で\n走らない。すること"), (5, "No Japanese at 3.5 all")], "id long, text string")
    got = {x["id"]: x["t"] for x in rows.select("id", segment(F.col("text")).alias("t")).collect()}
    assert got == {1: ["走る", "走る", "走る", "新しい", "言語モデル", "GPT-5"], 2: [], 3: [], 4: ["東京", "走る"], 5: ["No", "Japanese", "at", "all"]}
    (x,) = rows.where("id = 4").select(L.parsed(L.lexicon(words["words"]))(F.col("text")).alias("w")).collect()
    assert [tuple(w) for w in x["w"]][:3] == [("東京", "東京", "noun"), ("で", "で", "particle"), ("走ら", "走る", "verb")]
    path.write_text("ai_keywords:\n  - x\n", encoding="utf-8")
    assert terms.segment_of(config.dictionary(path)) is terms.X.script_runs
