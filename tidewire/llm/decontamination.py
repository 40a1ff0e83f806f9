"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are compared without case and without marks around them. The seeds of an item are its SEED-word
n-grams. Where any seed of an item occurs in a document, the words around it, as long as the item with
SLACK words to each side, are aligned to the item: a match scores MATCH, a mismatch or gap costs one. A
passage whose score is at least SHARE of the item's own is a leak, exact, edited or paraphrased.

Seeds aren't chosen by how rare they are in the corpus: where many documents hold an item, its rarest seeds
are those that an edited copy lacks. Instead a passage is only aligned if it has words enough in common
with the item; every match takes one of them, so a passage that has fewer can't reach the score. That
drops what a common seed brings, and no leak.

The index of the items is broadcast in blocks of at most BLOCK items and BLOCK_BYTES bytes of words; a
larger benchmark is read in several blocks against all documents. Documents are read where they lie:
nothing is shuffled.

Defined cases: a null text or item has no words. An item of fewer than SEED words marks nothing. A null
doc_id is passed on, a null item_id is an item of its own. Repeated documents are each reported, repeated
items once for each id. Of passages with the same score the first counts. Texts are read whole, whatever
their length. Extra columns are ignored by ``leaks`` and passed on by ``decontaminated``. Empty tables give
no leaks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.base import CACHE, caches, enter, materialize, mix, multipliers
from tidewire.llm.bpe import parted

SEED = 4
SLACK = 12
MATCH = 2
SHARE = 0.5
BLOCK, BLOCK_BYTES = 20_000, 32_000_000
#: Words of passages and items, padded to the longest, that are aligned at a time.
CELLS = 400_000

_M = multipliers(SEED, 4)
_MARKS = "\"'`.,;:!?()[]{}<>|#$%&*=-_~^/\\“”‘’«»…–—"


class _Words(dict):
    """Hash of the plain form of a byte word; 0 where nothing is left."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        plain = word.decode("utf-8", "replace").strip(_MARKS).casefold()
        self[word] = h = xxhash.xxh64_intdigest(plain) | 1 if plain else 0
        return h


_words = _Words()
caches("decontamination", _words.clear)


def plain_words(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, without those that are only marks."""
    words = text.encode().split() if text else []
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    return w[w != 0]


def seeds(w: np.ndarray) -> np.ndarray:
    """Hash of the SEED-gram at each place."""
    n = len(w) - SEED + 1
    if n < 1:
        return np.empty(0, np.uint64)
    x = w[:n] * _M[0]
    for k in range(1, SEED):
        x += w[k : n + k] * _M[k]
    return mix(x)


class Index:
    """Seeds of a block of items: sorted, with the item and the place of each. The items' names and words."""

    def __init__(self, names: list[int | None], items: list[np.ndarray]):
        self.names, self.items = names, items
        found = [seeds(w) for w in items]
        sizes = [len(f) for f in found]
        self.lengths = np.array([len(w) for w in items])
        key = np.concatenate([np.empty(0, np.uint64), *found])
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.item = np.repeat(np.arange(len(items)), sizes)[order]
        self.place = np.concatenate([np.empty(0, np.int64), *(np.arange(n) for n in sizes)])[order].astype(np.int64)
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[self.key >> np.uint64(42)] = True

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the document, rows of the index) of all seeds of a document."""
        key = seeds(w)
        at = np.flatnonzero(self.sieve[key >> np.uint64(42)])
        low, high = np.searchsorted(self.key, key[at], "left"), np.searchsorted(self.key, key[at], "right")
        n = high - low
        rows = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(at, n), rows


def enough(item: np.ndarray, passage: np.ndarray) -> bool:
    """Whether the words in common, each of which a match may take, could make a leak."""
    return min(np.isin(passage, item).sum(), np.isin(item, passage).sum()) >= SHARE * len(item)


def _passages(index: Index, w: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(item, start, end) of the words around the seeds of a document."""
    at, row = index.hits(w)
    if not len(at):
        return
    of, from_ = index.item[row], at - index.place[row]
    order = np.lexsort((from_, of))
    # seeds of one item whose beginnings lie within SLACK of one another are one passage
    o, f = of[order], from_[order]
    cuts = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (f[1:] - f[:-1] > SLACK)]))
    for a, b in zip(cuts, [*cuts[1:], len(o)], strict=True):
        low, high = max(0, int(f[a]) - SLACK), min(len(w), int(f[b - 1]) + int(index.lengths[o[a]]) + SLACK)
        if enough(index.items[o[a]], w[low:high]):
            yield int(o[a]), low, high


def leaking(index: Index, texts: list[str | None]) -> Iterator[tuple[int, int, float, int]]:
    """(text, item, score as a share of the item's own, first word of the passage): the best passage of each leak."""
    held: list[tuple[int, int, int, np.ndarray]] = []
    for k, text in enumerate(texts):
        w = plain_words(text)
        if len(w) >= SEED:
            held += ((k, item, low, w[low:high].copy()) for item, low, high in _passages(index, w))
    held.sort(key=lambda h: max(len(h[3]), index.lengths[h[1]]))
    best: dict[tuple[int, int], tuple[float, int]] = {}
    while held:
        some = held[-max(1, CELLS // max(len(held[-1][3]), int(index.lengths[held[-1][1]]))) :]
        del held[-len(some) :]
        for (k, item, low, _), score in zip(some, align([index.items[h[1]] for h in some], [h[3] for h in some]).tolist(), strict=True):
            share = score / (MATCH * int(index.lengths[item]))
            if share >= SHARE:
                best[k, item] = max(best.get((k, item), (0.0, 0)), (share, -low))
    for (k, item), (share, low) in sorted(best.items()):
        yield k, item, share, -low


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman score of each item and passage; all pairs step through their items together."""
    m, n = max(map(len, items)), max(map(len, passages))
    a, b = np.zeros((len(items), m), np.uint64), np.zeros((len(items), n), np.uint64)
    for k, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    row, best, ramp = np.zeros((len(items), n + 1), np.int32), np.zeros(len(items), np.int32), np.arange(n + 1, dtype=np.int32)
    for i in range(m):
        same = (a[:, i, None] == b) & (b != 0)
        then = np.zeros_like(row)
        np.maximum(row[:, :-1] + np.where(same, MATCH, -1), row[:, 1:] - 1, out=then[:, 1:])
        np.maximum(then, 0, out=then)
        row = np.maximum.accumulate(then + ramp, axis=1) - ramp  # gaps in the item
        best = np.maximum(best, row.max(axis=1))
    return best


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [plain_words(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array([w.tobytes() for w in words], pa.binary())], names=["item", "item_id", "item_words"])


def indexes(benchmark: DataFrame) -> list:
    """Broadcasts of the index of each block of items."""
    spark = benchmark.sparkSession
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().withColumn("item", F.xxhash64("item_id", "text"))
    items = materialize(bench.mapInArrow(_items, "item long, item_id long, item_words binary"), "items")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("item_words")), F.lit(0))).first()
    blocks, out = max(1, -(-n // BLOCK), -(-size // BLOCK_BYTES)), []
    for k in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).orderBy("item_id", "item").collect()  # a block
        out.append(spark.sparkContext.broadcast(Index([r["item_id"] for r in some], [np.frombuffer(r["item_words"], np.uint64) for r in some])))
    return out


def _found(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("decontamination")
    index = shared.value
    for whole in batches:
        for batch in parted(whole, "text"):
            made = list(leaking(index, batch.column("text").to_pylist()))
            ids = batch.column("doc_id").take(pa.array([m[0] for m in made], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([index.names[m[1]] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.float64()), pa.array([m[3] for m in made], pa.int64())], names=["doc_id", "item_id", "score", "start_word"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score and start_word: each document with each item that leaks into it, its best passage."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [rows.mapInArrow(partial(_found, shared), "doc_id long, item_id long, score double, start_word long") for shared in indexes(benchmark)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _clean(shared, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("decontamination")
    for whole in batches:
        for batch in parted(whole, whole.schema.names[at]):
            stays = np.ones(batch.num_rows, bool)
            stays[[k for k, *_ in leaking(shared.value, batch.column(at).to_pylist())]] = False
            yield batch.filter(pa.array(stays))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the documents into which an item leaks."""
    for shared in indexes(benchmark):
        docs = docs.mapInArrow(partial(_clean, shared, docs.columns.index(text)), docs.schema)
    return docs
