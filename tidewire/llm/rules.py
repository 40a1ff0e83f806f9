"""Quality rules with thresholds that adapt to each language and source; DataFrame functions only.

Counts of a text give four rates, whole numbers. A quantile sketch of a group (language, source) and a
rate is a histogram over buckets of fixed relative width: values under 16 have one each, and each
doubling beyond is cut in 8, so that a bucket is at most an eighth of its value wide. Sketches merge by
adding counts, which Spark does before and after its shuffle; a sketch has at most a few hundred buckets
whatever the rows. Quantiles of small groups are drawn towards those of their language, and these towards
the corpus's, as if SUPPORT more documents were of that kind: (n * own + SUPPORT * wider) / (n + SUPPORT).

A rate is out of bounds beyond ``median + SPREAD * (q90 - median) + slack``; mean word length also under
the like bound below. The slack of a rate is fixed and serves groups whose documents are all alike: where
median and q90 are both 0, it alone is the bound. Documents are joined with their group's bounds, and those
out of any bound are not kept. What fails the base rule (too few words, or mostly repeated ones) is
counted in no sketch and not kept.

Defined cases: a null text has no words and fails the base rule. A null language or source is a group of
its own. Repeated rows count each. A value equal to a bound is inside. An empty table gives no rows. Any
whole number of words has exact counts. Of columns other than COLUMNS none is read or passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.base import SPACE, joinable, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_WORDS = 50
REPEATED = (50, 100)
#: Documents that the wider group's quantiles count for.
SUPPORT = 100
SPREAD = 6
#: Rates and what a value may exceed the spread by: symbols per 10,000 characters, repeated lines per 100,000
#: words, repeated words per 10,000, word length in hundredths.
RATES = {"symbol_rate": 300, "line_rate": 1500, "repeat_rate": 1500, "word_length": 150}
#: Rates that have a bound below, too.
LOW = ("word_length",)


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Each step is a projection of its own, so that an array is built once and lambdas read it as a column.
    """
    found = docs.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    found = found.withColumn("_words", F.regexp_extract_all("_t", F.lit(f"[^{SPACE}]+"), F.lit(0)))
    found = found.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long"),
            "_lines": F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")),
        }
    )
    # every 3-word window as (hash, place), sorted, so that equal windows stand side by side
    windows = F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("p")))
    found = found.withColumn("_sorted", F.when(F.size("_words") >= 3, F.sort_array(windows)))
    twice = F.filter("_sorted", lambda x, i: (F.get("_sorted", i - 1)["h"] == x["h"]) | (F.get("_sorted", i + 1)["h"] == x["h"]))
    found = found.withColumn("_places", F.sort_array(F.transform(twice, lambda x: x["p"])))
    # each place covers three words, less what the next one covers too
    covered = F.aggregate(F.transform("_places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_places", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    found = found.withColumns(
        {
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    )
    return found.drop("_t", "_words", "_lines", "_sorted", "_places")


def _rates() -> dict[str, Column]:
    rates = {"symbol_rate": "n_symbols * 10000 div greatest(word_chars, 1)", "line_rate": "n_dup_lines * 100000 div greatest(n_words, 1)", "repeat_rate": "n_repeat_words * 10000 div greatest(n_words, 1)", "word_length": "word_chars * 100 div greatest(n_words, 1)"}
    return {k: F.expr(v) for k, v in rates.items()}


def bucket(x: Column) -> Column:
    """Number of the bucket of a whole number from 0."""
    e = F.length(F.conv(x.cast("string"), 10, 2)) - 1  # the highest set bit
    return F.when(x < 16, x.cast("int")).otherwise((16 + (e - 4) * 8 + F.call_function("shiftright", x, (e - 3).cast("int")) - 8).cast("int"))


def edge(b: Column) -> Column:
    """Least number of a bucket."""
    k = b - 16
    return F.when(b < 16, b.cast("long")).otherwise(F.call_function("shiftleft", (k % 8 + 8).cast("long"), (F.floor(k / 8) + 1).cast("int")))


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n) of rows with the rates."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("rate"), F.col(k).alias("x")) for k in RATES)))
    return rows.select("lang", "source", pairs.alias("r")).groupBy("lang", "source", F.col("r.rate").alias("rate"), bucket(F.col("r.x")).alias("bucket")).agg(F.count("*").alias("n"))


def bounds(sketch: DataFrame) -> DataFrame:
    """One row for each (lang, source): low_ and high_ of every rate.

    The sketches of a language and of the corpus are sums of those of its groups. Their buckets are few, so
    the windows below see a few hundred rows for a group, however many documents it has.
    """
    levels = [("lang", "source", "rate"), ("lang", "rate"), ("rate",)]
    made = []
    for keys in levels:
        merged = sketch.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys)
        ranked = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
        at = {name: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, edge(F.col("bucket")))).alias(name) for name, q in (("q10", 10), ("q50", 50), ("q90", 90))}
        made.append(ranked.groupBy(*keys).agg(F.max("total").alias("total"), *at.values()))
    own, lang, corpus = made
    drawn = lambda a, b, q: ((F.col(f"{a}.total") * F.col(f"{a}.{q}") + SUPPORT * F.col(f"{b}.{q}")) / (F.col(f"{a}.total") + SUPPORT)).alias(q)
    quantiles = ("q10", "q50", "q90")
    wide = lang.alias("l").join(F.broadcast(corpus.alias("c")), F.col("l.rate") == F.col("c.rate")).select("l.lang", "l.rate", *(drawn("l", "c", q) for q in quantiles))  # the corpus has one row for each rate
    join = own.alias("o").join(wide.alias("w"), (F.col("o.lang").eqNullSafe(F.col("w.lang"))) & (F.col("o.rate") == F.col("w.rate")))
    used = join.select("o.lang", "o.source", "o.rate", *(drawn("o", "w", q) for q in quantiles))
    slack = F.create_map(*(F.lit(x) for kv in RATES.items() for x in kv))
    limits = used.select("lang", "source", "rate", (F.col("q50") + SPREAD * (F.col("q90") - F.col("q50")) + slack[F.col("rate")]).alias("high"), (F.col("q50") - SPREAD * (F.col("q50") - F.col("q10")) - slack[F.col("rate")]).alias("low"))
    columns = [F.max(F.when(F.col("rate") == k, F.col("high"))).alias(f"high_{k}") for k in RATES] + [F.max(F.when(F.col("rate") == k, F.col("low"))).alias(f"low_{k}") for k in LOW]
    return limits.groupBy("lang", "source").agg(*columns)


def judged(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """COLUMNS of ``docs``, as far as it has them, with the counts, base_failed, the rates and kept; without
    the text if it isn't asked for. A language or source that it doesn't have is null.

    The counts are written once: both the sketches and the verdicts read them, and a filter on a count
    can't be pushed into the projections that make it.
    """
    there = [c.lower() for c in docs.columns]
    rows = docs.select(*(F.col(c) if c in there else F.lit(None).cast("string").alias(c) for c in COLUMNS if c in there or c in ("lang", "source")))
    counts = counted(rows)
    counts = materialize(counts if keep_text else counts.drop("text"), "counts")
    failed = (F.col("n_words") < MIN_WORDS) | (REPEATED[1] * F.col("n_repeat_words") > REPEATED[0] * F.col("n_words"))
    return _verdicts(counts.withColumn("base_failed", failed))


def _verdicts(counts: DataFrame) -> DataFrame:
    rated = counts.withColumns(_rates())
    limits = bounds(sketches(rated.where(~F.col("base_failed")).select("lang", "source", *RATES))).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *(f"high_{k}" for k in RATES), *(f"low_{k}" for k in LOW))
    limits = joinable(materialize(limits, "limits"))
    joined = rated.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for k in RATES:
        inside = inside & (F.col(k) <= F.col(f"high_{k}"))
    for k in LOW:
        inside = inside & (F.col(k) >= F.col(f"low_{k}"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop("_lang", "_source", *(f"high_{k}" for k in RATES), *(f"low_{k}" for k in LOW))
