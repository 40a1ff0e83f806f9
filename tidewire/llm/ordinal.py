"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A labelled document's grade is its quality plus one if it is not toxic: 0, 1 or 2. The model is
P(grade <= k) = logistic(threshold_k - w.x) with one weight vector w for all grades and ordered
thresholds. x is hashed text: one of 2**BITS bins for each distinct word, without case and marks; for each
beginning of words, of STEMS bytes, that SHARED distinct words or more of the document have, so that words
never met are told by their kin; and for each of a few traits of the text (its length, the shares of
distinct words, of marks and of repeated lines). It gives the expected grade, and the tail probability of
the best grade, by which documents are selected.

Trained on at most TRAIN labelled documents, those of least hash of their doc_id, by Adam on the whole
sample; the bound keeps the driver's memory fixed. Every document is scored.

Defined cases: a null text has the traits of an empty one. Labels with a null doc_id, quality or toxic,
or of no document, are not used; a document labelled twice counts twice. Of several documents of one doc_id
the least text is trained on. Without labels every grade is as likely as in no data: thresholds are those of
equal shares. Null doc_ids are passed on. Repeated rows give repeated results, an empty table none. A tail
probability equal to TAIL is kept. Extra columns are ignored. Texts are scored whole, whatever their length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.base import CACHE, caches, enter
from tidewire.llm.bpe import parted

BITS = 18
GRADES = 3
TRAIN = 10_000
#: Documents with at least this probability of the best grade are kept. Toxic documents are few, so that one
#: without a known word still looks likely to be good.
TAIL = 0.7
STEMS = (5, 6, 7, 8)
#: Numbers of distinct words with one beginning that are a feature.
SHARED = (2, 4)
_MARKS = b"\"'`.,;:!?()[]{}<>|#$%&*=-_~^/\\"


class _Plain(dict):
    """A byte word without marks and case."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        self[word] = plain = word.strip(_MARKS).lower()
        return plain


class _Bins(dict):
    def __missing__(self, name: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[name] = h = xxhash.xxh64_intdigest(name) >> (64 - BITS)
        return h


_plain, _bins = _Plain(), _Bins()
caches("ordinal", _plain.clear, _bins.clear)
_SYMBOLS = b"#*$%&|<>"


def features(text: str | None) -> np.ndarray:
    """Bins of a text, each once."""
    raw = text.encode() if text else b""
    words = raw.split()
    distinct = set(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda a, b: min(9, 10 * a // max(1, b))
    marks = len(raw) - len(raw.translate(None, _SYMBOLS))
    traits = [f"length={len(words).bit_length()}", f"distinct={share(len(distinct), len(words))}", f"marks={min(20, 50 * marks // max(1, len(raw)))}", f"lines={share(len(lines) - len(set(lines)), len(lines))}"]
    names = set(map(_plain.__getitem__, distinct))
    stems = Counter(w[:k] for k in STEMS for w in names if len(w) > k)
    names.update(b"%d^%s" % (n, stem) for stem, found in stems.items() if found >= SHARED[0] for n in SHARED if found >= n)
    names.update(b" " + t.encode() for t in traits)
    bins = set(map(_bins.__getitem__, names))
    return np.fromiter(bins, np.int32, len(bins))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in parted(whole, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("grade"), batch.column("n"), pa.array([np.sort(features(t.as_py())).tobytes() for t in batch.column("text")], pa.binary())], names=["grade", "n", "bins"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(grades: np.ndarray, rows: list[np.ndarray], rounds: int = 300, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the least regularised negative log-likelihood."""
    weights = np.zeros(1 << BITS)
    shares = np.array([(grades <= k).mean() if len(grades) else (k + 1) / GRADES for k in range(GRADES - 1)]).clip(0.01, 0.99)
    start = np.log(shares / (1 - shares))
    free = np.array([start[0], *np.log(np.maximum(np.diff(start), 1e-2))])  # the first, and logarithms of the steps
    if not len(grades):
        return weights, start
    flat, ends = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
    owner = np.repeat(np.arange(len(rows)), np.diff(ends))
    used, flat = np.unique(flat, return_inverse=True)
    w = np.zeros(len(used))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(free), np.zeros_like(free)]
    for step in range(1, rounds + 1):
        cuts = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        z = np.bincount(owner, weights=w[flat], minlength=len(rows))
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        high, low = sigmoid(edges[grades + 1] - z), sigmoid(edges[grades] - z)
        p = np.maximum(high - low, 1e-9)
        dh, dl = high * (1 - high) / p, low * (1 - low) / p
        dh[grades == GRADES - 1], dl[grades == 0] = 0, 0
        slope = (dl - dh) / len(rows)  # of the log-likelihood by z
        of_cuts = np.array([dh[grades == k].sum() - dl[grades == k + 1].sum() for k in range(GRADES - 1)]) / len(rows)
        of_free = np.array([of_cuts.sum(), *(of_cuts[k:].sum() * np.exp(free[k]) for k in range(1, GRADES - 1))])
        for k, (x, g) in enumerate(((w, np.bincount(flat, weights=slope[owner], minlength=len(w)) - decay * w), (free, of_free))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights[used] = w
    return weights, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) from at most TRAIN labelled documents."""
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality").cast("int").cast("boolean").cast("int") + 1 - F.col("toxic").cast("int").cast("boolean").cast("int")).alias("grade")).where("doc_id is not null and grade is not null")
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(TRAIN)
    chosen = chosen.groupBy("doc_id", "grade").agg(F.count("*").alias("n"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade", "n").agg(F.min("text").alias("text"))  # TRAIN labels at most
    rows = [r for r in one.select("grade", "n", "text").mapInArrow(_coded, "grade int, n long, bins binary").collect() for _ in range(r["n"])]
    rows.sort(key=lambda r: (r["grade"], bytes(r["bins"])))
    return fit(np.array([r["grade"] for r in rows], int), [np.frombuffer(r["bins"], np.int32) for r in rows])


def _scored(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("ordinal")
    weights, cuts = shared.value
    for whole in batches:
        for batch in parted(whole, "text"):
            z = np.array([weights[features(t.as_py())].sum() for t in batch.column("text")])
            above = 1 - sigmoid(cuts[None, :] - z.reshape(-1, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(above[:, -1]), pa.array(above[:, -1] >= TAIL)], names=["doc_id", "expected_grade", "tail_probability", "kept"])


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade, tail_probability and kept of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_scored, shared), "doc_id long, expected_grade double, tail_probability double, kept boolean")
