"""How far the word frequencies of each source stand from those of the others of its language.

Terms are runs of letters. A language keeps those in at least MIN_DOCS of its documents. With p the smoothed
frequency of a term in a group (a source of a language) in parts of 10^9, and q that in another, the terms of
(p - q)^2 / q, rounded down, add up to the divergence of the group from the other; those against the language
itself name the terms that set a group apart.

Pairs of groups are formed by two-dimensional tiling. The groups of a language are dealt into blocks of about BLOCK, its terms
into spans of about SPAN. A group's frequencies in a span are one packed vector, of the terms that it
has; a vector is replicated to the tiles of its block with every block. A tile, two blocks and a span, goes over its
terms in chunks of CHUNK: it spreads the vectors of a chunk out and adds up the submatrix of its pairs, both
ways. Submatrices of the spans are summed. No task holds more than one tile: two blocks' vectors of one span.

Counts are aggregated in each task before they are shuffled, in at most TERMS entries at a time; a frequent term has one
row for each source and task by then, and a source with a third of all rows is spread over the terms. All sums and
quotients are of integers; products that may exceed 64 bits are decimals.

Defined cases: a null text, language or source is an empty one. A group without terms, or without kept ones, has
pairs like any other; where its language keeps none, their values are 0. A language of one source has no pairs. Equal
values are ranked by the item's bytes. Repeated rows, also of one doc_id, count as documents each. Texts are read whole.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.base import joinable, materialize
from tidewire.llm.bpe import parted

#: Documents of a language that a kept term is in; parts of a frequency.
MIN_DOCS, PARTS = 3, 1_000_000_000
#: Groups of a block, terms of a span, both about; terms of a chunk; entries that a task counts before it passes them on.
BLOCK, SPAN, CHUNK, TERMS = 32, 16_384, 2_048, 300_000
#: Terms listed of each group.
TOP = 200
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each term in each group, and its documents there, of some texts at a time."""
    n: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)
    size = 0

    def rows() -> pa.RecordBatch:
        groups = list(n)
        sizes = [len(n[g]) for g in groups]
        of = np.repeat(np.arange(len(groups)), sizes)
        lang, source = (pa.array([g[k] for g in groups], pa.string()).take(pa.array(of)) for k in (0, 1))
        term = pa.array([t for g in groups for t in n[g]], pa.binary()).cast(pa.string())
        columns = [pa.array([v for g in groups for v in n[g].values()], pa.int64()), pa.array([docs[g][t] for g in groups for t in n[g]], pa.int64())]
        return pa.RecordBatch.from_arrays([lang, source, term, *columns], names=["lang", "source", "term", "n", "docs"])

    for whole in batches:
        for batch in parted(whole, "text"):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                words = Counter(_TERM.findall(text.as_py().encode("utf-8", "replace").lower()))
                group = lang, source
                before = len(n[group])
                n[group].update(words)
                docs[group].update(words.keys())
                size += len(n[group]) - before
                if size >= TERMS:
                    yield rows()
                    n.clear()
                    docs.clear()
                    size = 0
    yield rows()


def kept_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """lang, source, term, n, n_lang and first of the kept terms: one row for each group that has the term, ``first`` for one of them."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in (("lang", "lang"), ("source", "source"), (text, "text"))))
    # dealt by language and term once: the groups' sums and the language's are both formed there
    partial = rows.mapInArrow(_counted, _COUNTS).repartition("lang", "term")
    grouped = partial.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    summed = grouped.withColumns({"in_docs": F.sum("docs").over(w), "n_lang": F.sum("n").over(w), "least": F.min("source").over(w)})
    return summed.where(F.col("in_docs") >= MIN_DOCS).select("lang", "source", "term", "n", "n_lang", (F.col("source") == F.col("least")).alias("first"))


def sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total and lang_total (occurrences of kept terms), vocabulary and groups (of the language) of every group."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("own"))
    filled = groups.join(totals, ["lang", "source"], "left").fillna(0, ["total", "own"])
    langs = filled.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("own").alias("vocabulary"), F.count("*").alias("groups"))
    return filled.drop("own").join(langs, "lang")


def frequency(n: Column, total: Column, vocabulary: Column) -> Column:
    """The smoothed frequency of a term that occurs n times."""
    whole = lambda c: c.cast("decimal(28,0)")
    return F.call_function("div", F.lit(PARTS).cast("decimal(10,0)") * whole(n + 1), whole(total + vocabulary)) + 1


def _ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    rows = rows.withColumn("rank", rank)
    return rows if most is None else rows.where(F.col("rank") <= most)


def terms_apart(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value and rank: the terms that are most frequent in a group against its language."""
    p, q = frequency(F.col("n"), F.col("total"), F.col("vocabulary")), frequency(F.col("n_lang"), F.col("lang_total"), F.col("vocabulary"))
    rows = kept.join(joinable(groups), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    return _ranked(rows.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value")), top)


def packed(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, span, source, block, blocks, terms, least, places and ps: the vector of each group in each span, of the
    terms that it has; ``least`` is the frequency of all others."""
    dealt = groups.withColumns({"blocks": F.ceil(F.col("groups") / BLOCK).cast("int"), "spans": F.greatest(F.ceil(F.col("vocabulary") / SPAN), F.lit(1)).cast("int")})
    dealt = joinable(materialize(dealt.withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int")), "dealt"))
    w = Window.partitionBy("lang", "span").orderBy("term")
    p = frequency(F.col("n"), F.col("total"), F.col("vocabulary"))
    rows = kept.join(dealt, ["lang", "source"]).select("lang", "source", F.pmod(F.xxhash64("term"), "spans").cast("int").alias("span"), "term", p.alias("p")).withColumn("place", F.dense_rank().over(w) - 1)
    vectors = rows.groupBy("lang", "span", "source").agg(F.sort_array(F.collect_list(F.struct("place", "p"))).alias("v"))
    vectors = materialize(vectors.select("lang", "span", "source", F.col("v.place").alias("places"), F.col("v.p").alias("ps")), "vectors")
    spans = vectors.groupBy("lang", "span").agg((F.max(F.element_at("places", -1)) + 1).alias("terms"))
    least = F.when(F.col("vocabulary") > 0, frequency(F.lit(0), F.col("total"), F.col("vocabulary"))).otherwise(1)
    grid = dealt.select("lang", "source", "block", "blocks", least.alias("least"), F.explode(F.sequence(F.lit(0), F.col("spans") - 1)).alias("span"))
    return grid.join(spans, ["lang", "span"], "left").join(vectors, ["lang", "span", "source"], "left").withColumn("terms", F.coalesce("terms", F.lit(0)))


def _tile(table: pa.Table) -> pa.Table:
    """lang, source, item and value: the submatrix of a tile, of its span."""
    names, blocks, least = (table[c].to_pylist() for c in ("source", "block", "least"))
    vectors = [tuple(np.asarray(x.values) if x.is_valid else np.zeros(0, np.int64) for x in (a, b)) for a, b in zip(table["places"], table["ps"], strict=True)]
    low, high = min(table["a"][0].as_py(), table["b"][0].as_py()), max(table["a"][0].as_py(), table["b"][0].as_py())
    rows, columns = (np.array([k for k, x in enumerate(blocks) if x == side], np.int64) for side in (low, high))
    there, back = np.zeros((len(rows), len(columns)), np.int64), np.zeros((len(columns), len(rows)), np.int64)
    for at in range(0, table["terms"][0].as_py(), CHUNK):
        p = np.repeat(np.array(least, np.int64)[:, None], min(CHUNK, table["terms"][0].as_py() - at), axis=1)
        for k, (places, ps) in enumerate(vectors):
            i, j = np.searchsorted(places, (at, at + CHUNK))
            p[k, places[i:j] - at] = ps[i:j]
        others = p[columns]
        for k, i in enumerate(rows.tolist()):
            square = (others - p[i]) ** 2
            there[k] += (square // others).sum(axis=1)
            if low != high:
                back[:, k] += (square // p[i]).sum(axis=1)
    i, j = (x.ravel() for x in np.meshgrid(rows, columns, indexing="ij"))
    pairs = [(i, j, there.ravel())] if low == high else [(i, j, there.ravel()), (j, i, back.T.ravel())]
    i, j, value = (np.concatenate(x) for x in zip(*pairs, strict=True))
    apart = i != j
    of = pa.array(names, pa.string())
    source, item = of.take(pa.array(i[apart])), of.take(pa.array(j[apart]))
    return pa.table({"lang": pa.array([table["lang"][0].as_py()] * int(apart.sum()), pa.string()), "source": source, "item": item, "value": pa.array(value[apart])})


def pairs_apart(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value and rank: the divergence of each group from every other source of its language."""
    vectors = packed(kept, groups).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = vectors.select("lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "span", "source", "block", "least", "terms", "places", "ps")
    parts = tiles.groupBy("lang", "a", "b", "span").applyInArrow(_tile, "lang string, source string, item string, value long")
    return _ranked(parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))


def audit(docs: DataFrame, text: str = "text", top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank of every group."""
    kept = materialize(kept_counts(docs, text), "kept")
    groups = materialize(sizes(docs, kept), "groups")
    parts = [pairs_apart(kept, groups).withColumn("part", F.lit("pair")), terms_apart(kept, groups, top).withColumn("part", F.lit("term"))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")
