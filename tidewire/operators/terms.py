"""Frequencies of words and tags; trending keywords."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import lattice
from tidewire.functions import text as X


def count_terms(rows: DataFrame, terms: Column) -> DataFrame:
    """(term, cnt) over arrays of terms; counts are added before the shuffle."""
    return rows.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("cnt"))


def only(counts: DataFrame, words: Iterable[str]) -> DataFrame:
    """Counts of a dictionary's words; all, if it is empty."""
    words = sorted(set(words))
    return counts.where(F.col("term").isin(*words)) if words else counts


def without(counts: DataFrame, words: Iterable[str]) -> DataFrame:
    words = sorted(set(words))
    return counts.where(~F.lower("term").isin(*words)) if words else counts


def added(*counts: DataFrame) -> DataFrame:
    all_of = counts[0]
    for more in counts[1:]:
        all_of = all_of.unionByName(more)
    return all_of.groupBy("term").agg(F.sum("cnt").alias("cnt"))


def original_text() -> Column:
    return F.concat_ws(" ", "title", "summary", "content")


def word_counts(articles: DataFrame, stop: Iterable[str] = (), keep: Iterable[str] = ()) -> DataFrame:
    return only(without(count_terms(articles, X.english_words(original_text())), stop), keep)


def segment_of(dictionary: dict) -> Callable[[Column], Column]:
    """The segmenter of Japanese that a key word file asks for: a lattice of its words, its key words as nouns, if it lists words;
    else runs of one script."""
    if not dictionary.get("words"):
        return X.script_runs
    return lattice.segmenter(lattice.lexicon([*dictionary["words"], *((w, "noun") for w in sorted(dictionary["ai_keywords"]))]))


def translated(articles: DataFrame) -> DataFrame:
    """Articles that have Japanese text of a language model."""
    return articles.where((F.col("ai_status") == "completed") & ((F.col("title_ja") != "") | (F.col("summary_ja") != "")))


def japanese_counts(articles: DataFrame, segment: Callable[[Column], Column] = X.script_runs, stop: Iterable[str] = (), keep: Iterable[str] = ()) -> DataFrame:
    return only(without(count_terms(translated(articles), segment(F.concat_ws(" ", "title_ja", "summary_ja"))), stop), keep)


def original_counts(articles: DataFrame, segment: Callable[[Column], Column] = X.script_runs, stop: Iterable[str] = (), keep: Iterable[str] = ()) -> DataFrame:
    """Counts of the original texts by the Japanese segmenter; English words, if that leaves none."""
    found = articles.select(F.explode(segment(original_text())).alias("term"))
    if only(without(found, stop), keep).isEmpty():
        return word_counts(articles, stop, keep)
    return only(without(count_terms(articles, segment(original_text())), stop), keep)


def tag_counts(articles: DataFrame, stop: Iterable[str] = ()) -> DataFrame:
    return without(count_terms(articles, X.clean_tags(F.col("tags"))), stop)


def top(counts: DataFrame, n: int) -> DataFrame:
    return counts.orderBy(F.col("cnt").desc(), "term").limit(n)


def trending(articles: DataFrame, min_count: int = 2, top_n: int = 50, stop: Iterable[str] = (), stop_text: Iterable[str] = (), segment: Callable[[Column], Column] = X.script_runs) -> DataFrame:
    """(term, cnt): tags, Japanese text and original text added. ``stop_text`` isn't applied to tags."""
    texts = [without(japanese_counts(articles, segment, stop), stop_text), without(original_counts(articles, segment, stop), stop_text)]
    return top(added(tag_counts(articles, stop), *texts).where(F.col("cnt") >= min_count), top_n)


def split_known(terms: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, existing) terms against a dictionary (term)."""
    return terms.join(known, "term", "left_anti"), terms.join(known, "term", "left_semi")


def shares(counts: DataFrame, n: int) -> DataFrame:
    """The top terms with their share of the top's sum, for a chart."""
    best = top(counts, n)
    return best.crossJoin(F.broadcast(best.agg(F.sum("cnt").alias("_all")))).select("term", "cnt", (F.col("cnt") / F.col("_all")).alias("share"))  # one row
