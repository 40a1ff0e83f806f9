"""Ranked lexical search by TPUT over term-partitioned postings.

A score is a sum, over the terms of an item, of impacts that are known for each term and document. Postings of the
terms that any item has are dealt by term, those of a frequent one in pieces of at most about PIECE rows, and stored
by falling impact. Then, for all items at once:

1. The heads, the ``k`` highest impacts of each list, give lower bounds: the k-th highest partial sum of an item is
   one for its k-th score. Divided by the number of its lists it is the item's threshold.
2. Of every list the rows from the threshold on are fetched (from the last of the head on, where that is less), and
   summed by document. The k-th highest sum is a better bound; what a document may have in lists in which it wasn't seen
   is less than their thresholds. Documents that can't reach the bound drop out; each task has dropped those already that
   can't reach the best sums it has met itself.
3. What is left are candidates: their rows are looked up in all lists, and their exact scores ranked.

No document of an item's best ``k`` is lost on the way, ties included: one that reaches a bound has in some list an
impact of at least the bound divided by the number of lists.

Sums are formed in numpy by document, in slices of at most ENTRIES rows and CELLS sums. What a task must know of the
items, a threshold for each pair of an item and a term, is sent in blocks of at most PAIRS pairs (or one item); the texts
are read once, whatever the number of blocks.

Defined cases: a null text or item has no terms; such an item has no rows in the result. Every row of ``docs`` is a
document of its own, also if its doc_id or text is that of another; rows of equal score are ordered by doc_id, null first,
equal ones in the table's order. Every row of the benchmark is an item of its own. Very long texts are read whole; a term
that occurs in all documents has weight zero or more, and adds nothing if it is zero. An empty table on either side gives
no rows. Extra columns are ignored. Arithmetic is in 64-bit integers, but for the product that may exceed them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.base import discard, joinable, materialize, spread
from tidewire.llm.bpe import parted

#: Postings of one term in a piece, about; pairs of items and terms in a block.
PIECE, PAIRS = 16_384, 1_000_000
#: Postings in a slice, and sums that a slice may have.
ENTRIES, CELLS = 200_000, 2_000_000
#: A term: ASCII letters and digits, and every other character of more than one byte.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, A-Z in lower case, as UTF-8."""
    return _TERM.findall((text or "").encode("utf-8", "replace").lower())


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, term, tf and n of each term of each text; a row without term for each text, with its name."""
    for whole in batches:
        for batch in parted(whole, "text", 4_000_000):
            rows, names = batch.column("row").to_pylist(), batch.column("name").to_pylist()
            terms, tfs, sizes, lengths = [], [], [], []
            for text in batch.column("text"):
                words = terms_of(text.as_py())
                found = Counter(words)
                terms.append(None)
                tfs.append(0)
                terms.extend(found)
                tfs.extend(found.values())
                sizes.append(len(found) + 1)
                lengths.append(len(words))
            repeat = np.repeat(np.arange(len(rows)), sizes)
            first = np.zeros(len(repeat), bool)
            first[np.cumsum([0, *sizes[:-1]])] = True
            own = pa.array(names, pa.int64()).take(pa.array(np.where(first, repeat, 0), mask=~first))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()).take(pa.array(repeat)), own, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64()), pa.array(np.array(lengths)[repeat], pa.int64())], names=["row", "name", "term", "tf", "n"])


_POSTING = "row long, name long, term string, tf long, n long"


def tokenized(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(name).cast("long").alias("name"), F.col(text).cast("string").alias("text")).mapInArrow(_postings, _POSTING)


class Block:
    """Pairs of an item and a term by term, with the least impact that is fetched, and the items' bounds."""

    def __init__(self, pairs: pa.Table, bounds: dict[int, int]):
        order = np.argsort(pairs["t"].to_numpy(), kind="stable")
        self.t, self.b = (pairs[c].to_numpy()[order] for c in ("t", "b"))
        self.items, self.q = np.unique(pairs["q"].to_numpy()[order], return_inverse=True)
        self.unseen = _sums(self.q, self.b - 1, len(self.items))
        self.bounds = np.array([bounds.get(q, 0) for q in self.items.tolist()], np.int64)

    def expand(self, row: np.ndarray, t: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each posting and each item that has its term: the cell of the row and item, the impact, the threshold."""
        first, last = np.searchsorted(self.t, t, "left"), np.searchsorted(self.t, t, "right")
        n = last - first
        which = np.repeat(np.arange(len(t)), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]
        return row[which] * len(self.items) + self.q[at], v[which], self.b[at]


def _sums(cell: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of 64-bit integers by cell: high and low halves are summed apart, since the sums are formed in doubles."""
    high, low = (np.bincount(cell, x, n).astype(np.int64) for x in (v >> 20, v & 0xFFFFF))
    return (high << 20) + low


def _slices(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Distinct rows, and row number, t and v of their postings, some whole rows at a time; the batches are sorted by row."""
    kept: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

    def cut(r: np.ndarray, t: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        begins = np.flatnonzero(np.diff(r, prepend=-1))
        for k in range(0, len(begins), cells):
            a, b = begins[k], begins[k + cells] if k + cells < len(begins) else len(r)
            number = np.cumsum(np.diff(r[a:b], prepend=r[a]) != 0)
            yield r[begins[k : k + cells]], number, t[a:b], v[a:b]

    for batch in batches:
        kept = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(kept, ("row", "t", "v"), strict=True)]
        if len(kept[0]) >= ENTRIES:
            upto = np.searchsorted(kept[0], kept[0][-1])  # the last row may go on
            yield from cut(*(x[:upto] for x in kept))
            kept = [x[upto:] for x in kept]
    yield from cut(*kept)


class _Best:
    """The k highest sums of each item that a task has met."""

    def __init__(self, items: int, k: int):
        self.k, self.sums = k, np.zeros((k, items), np.int64)

    def least(self, found: np.ndarray) -> np.ndarray:
        """The k-th highest sum of each item, once those of another slice (rows by items) are met."""
        both = np.concatenate([self.sums, found])
        self.sums = np.partition(both, len(both) - self.k, axis=0)[len(both) - self.k :]
        return self.sums.min(axis=0)


def _summed(shared, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phase 2 of a task: q, row, lower and upper bound of what may be among an item's best."""
    block: Block = shared.value
    n, best = len(block.items), _Best(len(block.items), k)
    for rows, number, t, v in _slices(batches, max(1, CELLS // n)):
        cell, impact, least = block.expand(number, t, v)
        seen = impact >= least
        cell, size = cell[seen], len(rows) * n
        lower = _sums(cell, impact[seen], size).reshape(-1, n)
        upper = lower + block.unseen - _sums(cell, least[seen] - 1, size).reshape(-1, n)
        bound = np.maximum(best.least(lower), block.bounds)
        r, q = np.nonzero((lower > 0) & (upper >= bound))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block.items[q], rows[r], lower[r, q], upper[r, q])], names=["q", "row", "lower", "upper"])


def _exact(shared, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phase 3 of a task: q, row and score of candidates, which are postings of t = -1 and v = q."""
    block: Block = shared.value
    n, best = len(block.items), _Best(len(block.items), k)
    for rows, number, t, v in _slices(batches, max(1, CELLS // n)):
        asked = t < 0
        cell, impact, _ = block.expand(number[~asked], t[~asked], v[~asked])
        score = np.zeros(len(rows) * n, np.int64)
        wanted = number[asked] * n + np.searchsorted(block.items, v[asked])
        score[wanted] = _sums(cell, impact, len(score))[wanted]
        score = score.reshape(-1, n)
        r, q = np.nonzero((score > 0) & (score >= best.least(score)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block.items[q], rows[r], score[r, q])], names=["q", "row", "score"])


def _kth(rows: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """``by`` and bound: the k-th highest value of each group, where it has so many."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value)))
    return rows.select(by, value).withColumn("_k", place).where(F.col("_k") <= k).where(F.col("_k") == k).select(by, F.col(value).alias("bound"))


def _impacts(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """t, row and v of every posting, and t, weight and df of every term; the corpus gives one row to the driver."""
    docs = tokens.where("t is null").agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n, length = docs["docs"], max(1, docs["terms"])
    weights = tokens.where("t is not null").groupBy("t").agg(F.count("*").alias("df")).withColumn("w", F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * n + 2) / (2.0 * F.col("df") + 1))).cast("long"))
    weights = materialize(weights, "weights")
    m = F.expr(f"50 + (cast(50 as decimal(38,0)) * cast(n as decimal(19,0)) * {n}) div cast({length} as decimal(19,0))")
    rows = tokens.where("t is not null").join(joinable(weights.where("w > 0")), "t")
    v = F.col("w") * F.expr("(1000000000L * tf) div (1000L * tf + 20L * m)")
    return rows.withColumn("m", m.cast("long")).select("t", "row", "df", v.alias("v")), weights


def lists(tokens: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The stored lists, t, row, v and head, and the weights: each piece of a list by falling impact, its first k marked."""
    impacts, weights = _impacts(tokens)
    piece = F.pmod(F.xxhash64("row"), F.ceil(F.col("df") / PIECE)).cast("int")
    place = F.row_number().over(Window.partitionBy("t", "piece").orderBy(F.desc("v"), "row"))
    rows = impacts.where("v > 0").withColumn("piece", piece).withColumn("head", place <= k).select("t", "row", "v", "head")
    return materialize(rows, "lists"), weights


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc: str = "doc_id", item: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` highest scoring documents of each item, those above 0."""
    spark = docs.sparkSession
    asked = materialize(tokenized(items, item), "asked")
    names = materialize(asked.where("term is null").select(F.col("row").alias("q"), F.col("name").alias(item)), "items")
    terms = materialize(asked.where("term is not null").select("term").distinct().withColumn("t", F.monotonically_increasing_id()), "terms")
    wanted = materialize(asked.where("term is not null").select(F.col("row").alias("q"), "term").join(joinable(terms), "term").select("q", "t"), "wanted")
    found = tokenized(docs, doc).join(joinable(terms), "term", "left").where("term is null or t is not null")
    tokens = materialize(found.select("t", "row", "name", "tf", "n"), "tokens")
    stored, weights = lists(tokens, k)
    documents = materialize(tokens.where("t is null").select("row", F.col("name").alias(doc)), "documents")
    discard(tokens, asked, terms)

    # 1: heads, bounds, thresholds
    place = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("v")))
    heads = materialize(stored.where("head").select("t", "row", "v").withColumn("_k", place).where(F.col("_k") <= k).drop("_k"), "heads")
    partial = heads.join(joinable(wanted), "t").groupBy("q", "row").agg(F.sum("v").alias("lower"))
    bounds = materialize(_kth(partial, "q", "lower", k), "bounds")
    last = heads.groupBy("t").agg(F.when(F.count("*") >= k, F.min("v")).otherwise(0).alias("last"))
    pairs = wanted.join(last, "t")  # lists without rows add nothing
    counts = pairs.groupBy("q").agg(F.count("*").alias("m"))
    pairs = pairs.join(counts, "q").join(bounds, "q", "left")
    threshold = F.ceil(F.coalesce(F.col("bound"), F.lit(0)) / F.col("m")).cast("long") - 1  # one less: the quotient is a double
    pairs = materialize(pairs.select("q", "t", F.greatest(F.least(threshold, F.col("last")), F.lit(1)).cast("long").alias("b")), "pairs")

    blocks = max(1, -(-pairs.count() // PAIRS))
    out = []
    for number in range(blocks):
        some = pairs.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == number)
        table = some.toArrow()  # a block
        if not table.num_rows:
            continue
        mine = bounds.join(F.broadcast(some.select("q").distinct()), "q", "left_semi")
        block = spark.sparkContext.broadcast(Block(table, dict(mine.toArrow().to_pandas().itertuples(index=False))))
        out.append(_searched(stored, some, block, k))
    if not out:
        return spark.createDataFrame([], f"{item} long, rank int, {doc} long, score long")
    scored = reduce(DataFrame.union, out).join(documents, "row")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first(doc), "row"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= k)
    discard(heads, weights)
    return best.join(joinable(names), "q").select(item, "rank", doc, "score")


def _searched(stored: DataFrame, pairs: DataFrame, block, k: int) -> DataFrame:
    """q, row and score of the candidates of a block that may be among the best."""
    parts = spread(stored)
    least = joinable(materialize(pairs.groupBy("t").agg(F.min("b").alias("b")), "least"))
    mine = stored.join(least, "t")

    def by_row(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "row").sortWithinPartitions("row")

    # 2: rows from the thresholds on
    fetched = by_row(mine.where("v >= b").select("row", "t", "v"))
    near = materialize(fetched.mapInArrow(lambda batches: _summed(block, k, batches), "q long, row long, lower long, upper long"), "near")
    better = _kth(near, "q", "lower", k)
    candidates = materialize(near.join(F.broadcast(better), "q", "left").where("bound is null or upper >= bound").select("q", "row"), "candidates")
    discard(near)

    # 3: exact scores of the candidates
    rows = joinable(materialize(candidates.select("row").distinct(), "rows"))
    looked_up = mine.select("row", "t", "v").join(rows, "row", "left_semi")
    marks = candidates.select("row", F.lit(-1).cast("long").alias("t"), F.col("q").alias("v"))
    exact = by_row(looked_up.unionByName(marks)).mapInArrow(lambda batches: _exact(block, k, batches), "q long, row long, score long")
    return materialize(exact, "exact")
