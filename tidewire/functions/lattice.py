"""Japanese words as the cheapest path through a lattice: words of a dictionary, inflected by rule, and unknown runs of a script.

``parsed`` gives surface, dictionary form and kind of every word of a text, ``segmenter`` the dictionary forms of its nouns,
verbs and adjectives. Null and empty texts have none. Of ways of equal cost to a place and kind, that with the longest last word
is taken. A text costs as much as it has letters: unknown words are at most ``UNKNOWN`` letters, or the rest of their run, which is kept as
a length until the path is known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import pairwise
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.words import JAPANESE

#: Kana and kanji as ranges, which are matched faster than names of scripts, and a run of them and of Latin letters and digits.
JAPANESE_LETTERS = r"々〇ぁ-ゖゝ-ゟァ-ヺー-ヿㇰ-ㇿｦ-ﾟ㐀-䶿一-鿿豈-龎\x{20000}-\x{3134F}"
RUN = rf"[A-Za-z0-9{JAPANESE_LETTERS}][A-Za-z0-9.\-{JAPANESE_LETTERS}]*"
#: Words of a dictionary, all of which goes to every task; letters of an unknown word; texts that a worker remembers, and their letters.
MOST, UNKNOWN, REMEMBERED, SHORT = 100_000, 8, 50_000, 64

PARTICLES = "か から が くらい さえ しか ずつ だけ で と など に ね の のに は ば へ ほど まで も や よ より を".split()
AUXILIARIES = (
    "あっ あり ある い いた いる う し する せ せる そう た たい たかっ たく たら だ だっ だろ て でし でしょ です な ない なかっ なく なけれ なっ なり なる "
    "ぬ べき ます ませ まし よう られ られる らしい れ れる ん"
).split()
NOUNS = "あれ ここ こと これ そこ それ ため とき ところ どこ どれ はず もの わけ".split()
#: What a word costs by its kind, and what is added for two kinds one after the other, or for a kind at the start.
COST = {"noun": 20, "verb": 20, "adjective": 20, "particle": 8, "auxiliary": 10}
NEXT = {
    ("", "particle"): 20, ("", "auxiliary"): 20, ("noun", "noun"): 12, ("noun", "auxiliary"): 6, ("noun", "particle"): -4, ("noun", "verb"): 4,
    ("verb", "verb"): 14, ("verb", "auxiliary"): -6, ("verb", "noun"): 4, ("adjective", "auxiliary"): -4, ("adjective", "adjective"): 14,
    ("particle", "particle"): 15, ("particle", "auxiliary"): 8, ("auxiliary", "auxiliary"): -3, ("auxiliary", "particle"): 0,
}
#: The endings of verbs by the last letter of their dictionary form: before auxiliaries, and before た or て.
ENDINGS = {
    "う": "わいうえおっ", "く": "かきくけこい", "ぐ": "がぎぐげごい", "す": "さしすせそ", "つ": "たちつてとっ",
    "ぬ": "なにぬねのん", "ぶ": "ばびぶべぼん", "む": "まみむめもん", "る": "らりるれろっ",
}
#: Letters with e or i before る: such a verb keeps its stem, unless its kind is given as ``verb5``.
LEVEL = "いきぎしじちぢにひびみりえけげせぜてでねへべめれ"


class Word(NamedTuple):
    surface: str
    lemma: str
    kind: str


def inflected(lemma: str, kind: str = "noun") -> list[Word]:
    """The forms of a dictionary word; ``verb5`` and ``verb1`` are verbs with a changing and a level stem."""
    if kind in ("verb", "verb1", "verb5"):
        stem, end = lemma[:-1], lemma[-1:]
        if end not in ENDINGS:
            raise ValueError(f"no dictionary form of a verb: {lemma}")
        level = kind == "verb1" or (kind == "verb" and end == "る" and stem[-1:] in tuple(LEVEL))
        ends = ["", "る", "れ", "ろ"] if level else [*ENDINGS[end], *("っ" if stem.endswith("行") else "")]
        return [Word(stem + e, lemma, "verb") for e in dict.fromkeys(ends) if stem + e]
    if kind == "adjective":
        if not lemma.endswith("い"):
            raise ValueError(f"no dictionary form of an adjective: {lemma}")
        return [Word(lemma[:-1] + e, lemma, kind) for e in ("い", "く", "かっ", "けれ")]
    if kind not in COST:
        raise ValueError(f"no kind of word: {kind}")
    return [Word(lemma, lemma, kind)]


Lexicon = dict[str, list[Word]]


def lexicon(words: Iterable[tuple[str, str]]) -> Lexicon:
    """Words by surface, of pairs of a dictionary form and a kind; particles, auxiliaries and formal nouns are there anyway. A form that several
    words share has each of them, an earlier one first."""
    words = [(lemma, kind) for lemma, kind in words if lemma]
    if len(words) > MOST:
        raise ValueError(f"more than {MOST} words in a dictionary, all of which goes to every task")
    out: Lexicon = {}
    closed = [*((n, "noun") for n in NOUNS), *((p, "particle") for p in PARTICLES), *((a, "auxiliary") for a in AUXILIARIES)]
    for w in [w for lemma, kind in words for w in inflected(lemma, kind)] + [Word(s, s, kind) for s, kind in closed]:
        if w not in out.setdefault(w.surface, []):
            out[w.surface].append(w)
    return out


def script(letter: str) -> str:
    """The script of a letter."""
    if "ぁ" <= letter <= "ゟ":
        return "hiragana"
    if "゠" <= letter <= "ヿ" or "ㇰ" <= letter <= "ㇿ" or "ｦ" <= letter <= "ﾟ":
        return "katakana"
    return "latin" if letter.isascii() else "kanji"


def unknown(length: int, kind: str) -> int:
    """What an unknown noun costs."""
    return {"kanji": 34 + 8 * length, "katakana": 32, "latin": 32, "hiragana": 45 + 12 * length}[kind]


def edges(text: str, words: Lexicon, longest: int) -> list[list[tuple[int, int, Word | None]]]:
    """For each place the words that begin there: length, cost, and the word, or nothing for an unknown noun. Katakana, Latin letters and
    digits are parted only by words of the dictionary."""
    n, scripts = len(text), [script(c) for c in text]
    rest = [1] * n
    for i in range(n - 2, -1, -1):
        rest[i] = rest[i + 1] + 1 if scripts[i] == scripts[i + 1] else 1
    out = []
    for i in range(n):
        found: list[tuple[int, int, Word | None]] = [(k, COST[w.kind], w) for k in range(min(longest, n - i), 0, -1) for w in words.get(text[i : i + k], ())]
        some = range(min(UNKNOWN, rest[i]), 0, -1) if scripts[i] in ("kanji", "hiragana") else ()
        out.append(found + [(k, unknown(k, scripts[i]), None) for k in dict.fromkeys((rest[i], *some))])
    return out


def cheapest(text: str, words: Lexicon, longest: int) -> list[Word]:
    """The words of the cheapest path (Viterbi: the cheapest way to each place and kind)."""
    best: list[dict[str, tuple[int, int, str, Word | None]]] = [{} for _ in range(len(text) + 1)]
    best[0][""] = (0, 0, "", None)
    for i, begun in enumerate(edges(text, words, longest)):
        for before, (cost, *_) in best[i].items():
            for k, own, word in begun:
                kind = word.kind if word else "noun"
                total = cost + own + NEXT.get((before, kind), 0)
                if kind not in best[i + k] or total < best[i + k][kind][0]:  # what came first has the longer last word
                    best[i + k][kind] = (total, i, before, word)
    path, at = [], len(text)
    kind = min(best[at], key=lambda k: best[at][k][0])
    while at:
        _, start, before, word = best[at][kind]
        surface = text[start:at]
        path.append(word or Word(surface, surface.strip(".-") or surface, "noun"))
        at, kind = start, before
    return path[::-1]


def price(path: list[Word], words: Lexicon) -> int:
    """What a path costs."""
    own = [COST[w.kind] if w in words.get(w.surface, ()) else unknown(len(w.surface), script(w.surface[0])) for w in path]
    return sum(own) + sum(NEXT.get(pair, 0) for pair in pairwise(["", *(w.kind for w in path)]))


def _of_runs(words: Lexicon) -> Callable[[Column], Column]:
    """A function of an array of runs to ARRAY<STRUCT<surface, lemma, kind>>, in Arrow batches."""
    longest = max(map(len, words))

    @F.pandas_udf("array<array<string>>")
    def paths(runs: pd.Series) -> pd.Series:
        remembered = lru_cache(REMEMBERED)(lambda run: [list(w) for w in cheapest(run, words, longest)])
        find = lambda run: remembered(run) if len(run) <= SHORT else [list(w) for w in cheapest(run, words, longest)]
        return pd.Series([[w for run in of for w in find(run)] for of in runs], dtype=object)

    return lambda runs: F.transform(paths(runs), lambda w: F.struct(w[0].alias("surface"), w[1].alias("lemma"), w[2].alias("kind")))


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), F.lit(0))


def parsed(words: Lexicon) -> Callable[[Column], Column]:
    """A function of a text to ARRAY<STRUCT<surface, lemma, kind>>. Runs of letters are found in the JVM; what parts them is left out."""
    of_runs = _of_runs(words)
    return lambda text: of_runs(_runs(text))


def segmenter(words: Lexicon) -> Callable[[Column], Column]:
    """A function of a text to the dictionary forms of its nouns, verbs and adjectives of over one letter that are no number and no
    stop word. Runs without a Japanese letter are nouns as they stand, come last, and stay in the JVM."""
    of_runs = _of_runs(words)
    japanese = lambda run: F.octet_length(run) > F.length(run)  # noqa: E731  # all else in a run is ASCII

    def of_text(text: Column) -> Column:
        runs = _runs(text)
        found = F.filter(of_runs(F.filter(runs, japanese)), lambda w: w["kind"].isin("noun", "verb", "adjective"))
        terms = F.concat(F.transform(found, lambda w: w["lemma"]), F.filter(runs, lambda r: ~japanese(r)))
        return F.filter(terms, lambda w: (F.length(w) > 1) & ~w.isin(*sorted(JAPANESE)) & ~w.rlike(r"^[0-9.]+$"))

    return of_text
