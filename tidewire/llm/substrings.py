"""Substring dedup by relative Lempel-Ziv parsing of documents against indexed reference blocks.

The corpus is its own reference. It is cut into blocks by content: the least of the GRAM-word hashes
inside a window of WINDOW words is that window's anchor, and the passages of all documents that share an
anchor form one reference block. Equal windows have equal anchors, so whatever a passage can be copied
from stands in the one block that the passage is dealt to; against all other blocks its parse is literal.

A block is indexed by the sorted suffixes of its windows (``Index``). A passage is parsed against it
greedily: the factor that starts at a window is the longest match with any other place of the block, one
source for the whole of it, found beside it in the sorted suffixes. The words of factor and source are
compared, not only their hashes. The next factor starts at the first window beyond the factor's last
one: it still holds 34 words of it, so a copy that goes on from another source is found at the boundary.
A window that stands nowhere else is a literal. Factors of WINDOW words or more are duplicate spans;
shorter ones hold no window. Windows are judged on the input, never on what is left.

1. A task parses each slice of SLICE bytes of its documents against itself, as a first block. Every
   different window of the slice is sent on once, as PRINT bytes of hash, so a block gets at most one copy
   of a window from each slice, however many copies of a text the corpus has.
2. In the blocks, passages whose windows' hashes meet others are candidates; all else is literal.
3. Candidates fetch their words and are parsed in their blocks.

In step 2 a block is read in parts of PART windows. What a part leaves for the next are the first places of
its different windows, so a passage that every slice has doesn't pile up. Each part, with the first places
that it meets, is a block of its own in step 3: a window that stands twice meets another one in some part.
An anchor with HOT passages in a sample of one document in SAMPLED is hot: its windows are dealt by their
own hashes. The sample only decides how rows are dealt; it changes no result.

Defined cases: a null text, or one without words, has n_words 0 and keeps the empty text. Fewer than
WINDOW words hold no window. Repeated rows are copies of one another. A null doc_id is passed on. An empty
table gives no rows. Texts are read whole, whatever their length. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.base import WordHashes, caches, enter, mix, spread
from tidewire.llm.bpe import parted

WINDOW = 35
GRAM = 6
PRINT = 4
#: Bytes of text that a task parses against itself at a time, and bytes of blocks that are read at a time.
SLICE = 2_000_000
#: Windows of a block that are read at a time.
PART = 4096
#: One document in so many is sampled for hot anchors, and the passages there that make an anchor hot.
SAMPLED, HOT = 256, 1024

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_words = WordHashes()
caches("substrings", _words.clear)

_PIECES = "key int, id long, mark long, s int, e int, prints binary"
_SPANS = "key int, id long, mark long, s int, e int, settled boolean"
_CUTS = "key int, id long, mark long, s int, e int, words binary"


def _powers(base: np.uint64, n: int) -> np.ndarray:
    x = np.full(n, base)
    x[:1] = 1
    return np.multiply.accumulate(x)


def rolling(words: np.ndarray, widths: tuple[int, ...]) -> list[np.ndarray]:
    """Hash of the next ``width`` words at every place that has so many."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * _powers(_BASE, len(words)), dtype=np.uint64)])
    back = _powers(_INVERSE, len(words))
    return [mix((sums[w:] - sums[:-w]) * back[: len(words) - w + 1]) if len(words) >= w else np.empty(0, np.uint64) for w in widths]


def anchors(grams: np.ndarray, n: int) -> np.ndarray:
    """Place of the leftmost least gram of each of n windows."""
    span = WINDOW - GRAM + 1
    return np.lib.stride_tricks.sliding_window_view(grams, span)[:n].argmin(axis=1) + np.arange(n)


def _breaks(new: np.ndarray) -> np.ndarray:
    """Places where a run starts: the first one, and wherever ``new`` says so of the one after."""
    return np.flatnonzero(np.concatenate([[True], new]))


class Index:
    """The windows at the places ``at`` of ``words`` that stand there more than once in their block.

    ``follows``: whether a window comes right after the one before it in the same passage. Windows of one
    run, found one after the other, have one number after the other here.
    """

    def __init__(self, words: list[bytes], prints: np.ndarray, at: np.ndarray, follows: np.ndarray, block: np.ndarray | None = None, exact: bool = False):
        self.words = words
        if exact:  # hashes of different windows have met
            names: dict[tuple, int] = {}
            keys = np.array([names.setdefault((b"\0".join(words[a : a + WINDOW]), 0 if block is None else int(block[k])), len(names)) for k, a in enumerate(at.tolist())])
        else:
            keys = prints if block is None else mix(prints ^ (block.astype(np.uint64) * _BASE))
        _, self.first, of, seen = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        self.found = np.flatnonzero(seen[of] > 1)
        self.at = at[self.found]
        n = len(self.found)
        self.starts = _breaks((np.diff(self.found) != 1) | ~follows[self.found[1:]]) if n else np.empty(0, np.int64)
        self.ends = np.append(self.starts[1:], n) if n else self.starts
        self.left = np.repeat(self.ends, self.ends - self.starts) - np.arange(n)
        # ranks[k] orders the windows by the 2**k windows that follow; ends of runs come first
        self.ranks = [np.unique(of[self.found], return_inverse=True)[1].astype(np.int32)] if n else []
        width = 1
        while n and width < self.left.max():
            ahead, has = np.zeros(n, np.int64), np.flatnonzero(self.left > width)
            ahead[has] = self.ranks[-1][has + width] + 1
            self.ranks.append(np.unique(self.ranks[-1] * np.int64(n + 1) + ahead, return_inverse=True)[1].astype(np.int32))
            width *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many windows from i on equal those from j on."""
        most, n = np.minimum(self.left[i], self.left[j]), np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            more = np.flatnonzero(n < most)
            more = more[self.ranks[k][i[more] + n[more]] == self.ranks[k][j[more] + n[more]]]
            n[more] += 1 << k
        return np.minimum(n, most)

    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(first window, windows, source) of each factor; None if words differ where hashes agree."""
        n = len(self.found)
        if not n:
            return self.found, self.found, self.found
        order = np.argsort(self.ranks[-1], kind="stable")
        size, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
        beside = self.common(order[:-1], order[1:])
        size[order[1:]], source[order[1:]] = beside, order[:-1]
        longer = beside > size[order[:-1]]
        size[order[:-1][longer]], source[order[:-1][longer]] = beside[longer], order[1:][longer]
        at, stop, made = self.starts, self.ends, []
        while len(at):
            made.append(at)
            at = at + size[at]
            at, stop = at[at < stop], stop[at < stop]
        first = np.sort(np.concatenate(made))
        size, source, w = size[first], source[first], self.words
        for a, b, k in zip(self.at[first].tolist(), self.at[source].tolist(), (size + WINDOW - 1).tolist(), strict=True):
            if w[a : a + k] != w[b : b + k]:
                return None
        return first, size, source


def parse(words: list[bytes], prints: np.ndarray, at: np.ndarray, follows: np.ndarray, block: np.ndarray | None = None) -> tuple[Index, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The index of some blocks and the factors of their passages, each compared word by word."""
    index = Index(words, prints, at, follows, block)
    made = index.factors()
    if made is None:
        index = Index(words, prints, at, follows, block, exact=True)
        made = index.factors()
    return index, made


def _spans(index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) windows, as numbers in ``index.found``, of the runs that factors cover without a gap."""
    return index.starts, index.ends - 1


# Documents, slice by slice


def _pieces(hot: np.ndarray, ids: list[int], marks: list[int], texts: list[str | None]) -> Iterator[pa.RecordBatch]:
    """Passages of documents for their blocks, and the spans that this slice shows by itself."""
    lists = [t.encode().split() if t else [] for t in texts]
    sizes = np.array([len(x) for x in lists])
    flat = list(chain.from_iterable(lists))
    words = _words.array(flat)
    if len(words) < WINDOW:
        return
    windows, grams = rolling(words, (WINDOW, GRAM))
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(words)) - first[doc]
    real = np.flatnonzero((place + WINDOW <= sizes[doc])[: len(windows)])
    if not len(real):
        return
    anchor = anchors(grams, len(windows))[real]
    prints, doc, place = windows[real], doc[real], place[real]
    ids, marks = np.array(ids, np.int64), np.array(marks, np.int64)
    index, _ = parse(flat, prints, real, np.concatenate([[False], (np.diff(real) == 1) & (np.diff(doc) == 0)]))

    e = np.sort(index.first)
    key = (grams[anchor[e]] >> np.uint64(33)).astype(np.int32)
    lone = np.isin(key, hot)
    key[lone] = ((prints[e] >> np.uint64(16)) & np.uint64(0x7FFFFFFF)).astype(np.int32)[lone]
    starts = _breaks((np.diff(doc[e]) != 0) | (np.diff(place[e]) != 1) | (np.diff(anchor[e]) != 0) | lone[1:] | lone[:-1])
    ends = PRINT * np.append(starts, len(e)).astype(np.int32)
    low = np.ascontiguousarray(prints[e].view(np.uint8).reshape(-1, 8)[:, :PRINT])
    payload = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(low)])
    of = doc[e][starts]
    yield pa.RecordBatch.from_arrays([pa.array(key[starts]), pa.array(ids[of]), pa.array(marks[of]), pa.array(place[e][starts].astype(np.int32)), pa.nulls(len(starts), pa.int32()), payload], schema=_PIECES_ARROW)

    a, b = _spans(index)
    if len(a):
        a, b = index.found[a], index.found[b]
        mark = marks[doc[a]]
        yield pa.RecordBatch.from_arrays([pa.array((mark & 0x7FFFFFFF).astype(np.int32)), pa.array(ids[doc[a]]), pa.array(mark), pa.array(place[a].astype(np.int32)), pa.array((place[b] + WINDOW).astype(np.int32)), pa.nulls(len(a), pa.binary())], schema=_PIECES_ARROW)


_PIECES_ARROW = pa.schema([("key", pa.int32()), ("id", pa.int64()), ("mark", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("prints", pa.binary())])


def _sliced(hot, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``hot`` is a broadcast of the hot anchors, or None."""
    enter("substrings")
    hot = np.empty(0, np.int32) if hot is None else hot.value
    ids, marks, texts, size = [], [], [], 0
    for whole in batches:
        for batch in parted(whole, "text", SLICE):
            ids += batch.column("id").to_pylist()
            marks += batch.column("mark").to_pylist()
            texts += batch.column("text").to_pylist()
            size += batch.column("text").nbytes
            if size >= SLICE:
                yield from _pieces(hot, ids, marks, texts)
                ids, marks, texts, size = [], [], [], 0
    if texts:
        yield from _pieces(hot, ids, marks, texts)


# Blocks, by hashes


class _Windows:
    """Windows of passages: columns key, print, id, mark and place."""

    def __init__(self, *columns: np.ndarray):
        self.columns = columns

    @staticmethod
    def of(batch: pa.RecordBatch) -> _Windows:
        flat = batch.column("prints")
        n = pc.binary_length(flat).to_numpy(zero_copy_only=False) // PRINT
        prints = np.frombuffer(b"".join(flat.to_pylist()), f"<u{PRINT}")
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key, id_, mark, s = (np.repeat(batch.column(c).to_numpy(), n) for c in ("key", "id", "mark", "s"))
        return _Windows(key, prints, id_, mark, s + within)

    @staticmethod
    def joined(parts: list[_Windows]) -> _Windows:
        return _Windows(*(np.concatenate(c) for c in zip(*(p.columns for p in parts), strict=True)))

    def __len__(self) -> int:
        return len(self.columns[0])

    def take(self, at: np.ndarray) -> _Windows:
        return _Windows(*(c[at] for c in self.columns))

    def met(self, part: int) -> tuple[pa.RecordBatch, _Windows]:
        """Candidates, as runs of windows that meet another one in this part, and the first window of each kind."""
        key, prints, id_, mark, place = self.columns
        order = np.lexsort((prints, key))
        same = (prints[order][1:] == prints[order][:-1]) & (key[order][1:] == key[order][:-1])
        found = np.zeros(len(order), bool)
        found[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        hit = np.flatnonzero(found)
        starts = _breaks((np.diff(key[hit]) != 0) | (np.diff(mark[hit]) != 0) | (np.diff(id_[hit]) != 0) | (np.diff(place[hit]) != 1)) if len(hit) else hit
        last = np.append(starts[1:], len(hit))[: len(starts)] - 1
        to = key[hit][starts]
        if part:
            to = (mix(to.astype(np.uint64) + np.uint64(part << 32)) >> np.uint64(33)).astype(np.int32)
        batch = _settled(to, id_[hit][starts], mark[hit][starts], place[hit][starts], place[hit][last] + WINDOW, False)
        return batch, self.take(np.sort(order[_breaks(~same)]))


def _settled(key, id_, mark, s, e, settled: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(id_, pa.int64()), pa.array(mark, pa.int64()), pa.array(np.asarray(s).astype(np.int32)), pa.array(np.asarray(e).astype(np.int32)), pa.array(np.full(len(key), settled))], names=["key", "id", "mark", "s", "e", "settled"])


class _Parts:
    """Reads blocks, whose windows come sorted by key, in parts of PART windows."""

    def __init__(self) -> None:
        self.last, self.parts, self.first = None, 0, None  # the block that may go on, its parts so far, its first places

    def read(self, rows: _Windows) -> Iterator[pa.RecordBatch]:
        key = rows.columns[0]
        starts = _breaks(np.diff(key) != 0)
        part = (np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))) // PART
        if key[0] == self.last:
            part[: starts[1] if len(starts) > 1 else len(key)] += self.parts
        else:
            self.first = None
        first = self.first
        for k in range(int(part.min()), int(part.max()) + 1):
            more = rows.take(np.flatnonzero(part == k))
            if not len(more):
                continue
            waits = []
            if first is not None:
                goes = np.isin(first.columns[0], more.columns[0])
                waits, more = [first.take(np.flatnonzero(~goes))], _Windows.joined([first.take(np.flatnonzero(goes)), more])
            found, first = more.met(k)
            first = _Windows.joined([*waits, first])
            if found.num_rows:
                yield found
        self.last, self.parts = key[-1], int(part[-1]) + 1
        self.first = first.take(np.flatnonzero(first.columns[0] == self.last))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block. Spans known by slices pass; passages whose windows meet others become candidates."""
    enter("substrings")
    held: list[_Windows] = []
    blocks, size = _Parts(), 0
    for whole in batches:
        own = whole.filter(pc.is_null(whole.column("prints")))
        if own.num_rows:
            yield _settled(*(own.column(c).to_numpy() for c in ("key", "id", "mark", "s", "e")), True)
        for batch in parted(whole.filter(pc.is_valid(whole.column("prints"))), "prints", SLICE // 4):
            if batch.num_rows:
                held.append(_Windows.of(batch))
                size += len(held[-1])
            if size >= SLICE // PRINT // 2:
                yield from blocks.read(_Windows.joined(held))
                held, size = [], 0
    if held:
        yield from blocks.read(_Windows.joined(held))


# Blocks, by words


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each candidate; spans known by slices pass without."""
    for whole in batches:
        for batch in parted(whole, "text", SLICE):
            rows: list[list] = [[], [], [], [], [], []]
            for id_, mark, text, spans in zip(*(batch.column(c) for c in ("id", "mark", "text", "spans")), strict=True):
                words = None
                for x in spans.as_py():
                    if not x["settled"] and words is None:
                        words = (text.as_py() or "").encode().split()
                    for to, v in zip(rows, (x["key"], id_.as_py(), mark.as_py(), x["s"], x["e"], None if x["settled"] else b" ".join(words[x["s"] : x["e"]])), strict=True):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, _CUTS_ARROW.types, strict=True)], schema=_CUTS_ARROW)


_CUTS_ARROW = pa.schema([("key", pa.int32()), ("id", pa.int64()), ("mark", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("words", pa.binary())])


def _parsed(rows: list[tuple]) -> pa.RecordBatch:
    """Spans of the factors of (key, id, mark, s, words)."""
    lists = [r[4].split(b" ") for r in rows]
    sizes = np.array([len(x) for x in lists])
    flat = list(chain.from_iterable(lists))
    first = np.cumsum(sizes) - sizes
    n = sizes - WINDOW + 1
    piece = np.repeat(np.arange(len(rows)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = first[piece] + offset
    (prints,) = rolling(_words.array(flat), (WINDOW,))
    block = np.array([r[0] for r in rows], np.int64)[piece]
    index, _ = parse(flat, prints[at], at, offset > 0, block)
    a, b = _spans(index)
    of = piece[index.found[a]].tolist()
    s, e = offset[index.found[a]].tolist(), (offset[index.found[b]] + WINDOW).tolist()
    return _ends([rows[k][1] for k in of], [rows[k][2] for k in of], [rows[k][3] + x for k, x in zip(of, s, strict=True)], [rows[k][3] + x for k, x in zip(of, e, strict=True)])


def _ends(ids: list, marks: list, s: list, e: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["id", "mark", "s", "e"])


def _factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block. Spans known by slices pass; candidates are parsed in their blocks."""
    enter("substrings")
    held: list[tuple] = []
    size = 0
    for whole in batches:
        for batch in parted(whole, "words", SLICE // 4):
            own = batch.filter(pc.is_null(batch.column("words")))
            if own.num_rows:
                yield _ends(*(own.column(c).to_pylist() for c in ("id", "mark", "s", "e")))
            given = batch.filter(pc.is_valid(batch.column("words")))
            held += zip(*(given.column(c).to_pylist() for c in ("key", "id", "mark", "s", "words")), strict=True)
            size += given.column("words").nbytes
            if size >= SLICE and held[0][0] != held[-1][0]:
                last = held[-1][0]
                yield _parsed([r for r in held if r[0] != last])
                held = [r for r in held if r[0] == last]  # of a block, at most 2 * PART windows
                size = sum(len(r[4]) for r in held)
    if held:
        yield _parsed(held)


# Texts


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in parted(whole, "text"):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                if spans.is_valid and len(spans):
                    edge = np.zeros(len(words) + 1, np.int64)
                    flat = spans.values.flatten()
                    np.add.at(edge, flat[0].to_numpy(), 1)
                    np.add.at(edge, flat[1].to_numpy(), -1)
                    stays = (np.cumsum(edge)[:-1] == 0).tolist()
                    words = [w for w, s in zip(words, stays, strict=True) if s]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def hot_anchors(rows: DataFrame) -> list[int]:
    """Blocks with HOT passages or more in the sample: at most one for each HOT passages of it."""
    some = rows.where(F.pmod(F.xxhash64("mark"), F.lit(SAMPLED)) == 0).mapInArrow(partial(_sliced, None), _PIECES)
    return [r[0] for r in some.where("prints is not null").groupBy("key").count().where(F.col("count") >= HOT).select("key").collect()]


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a document is known by its id and a hash of both columns
    rows = rows.withColumns({"id": F.coalesce("doc_id", F.lit(0).cast("long")), "mark": F.xxhash64("doc_id", "text")})
    given, parts = rows.select("id", "mark", "text"), spread(rows)
    hot = docs.sparkSession.sparkContext.broadcast(np.array(sorted(hot_anchors(given)), np.int32))
    in_blocks = lambda table: table.repartition(parts, "key").sortWithinPartitions("key")
    found = in_blocks(given.mapInArrow(partial(_sliced, hot), _PIECES)).mapInArrow(_candidates, _SPANS)
    listed = found.groupBy("id", "mark").agg(F.collect_set(F.struct("key", "s", "e", "settled")).alias("spans"))
    # doc_id comes along so that both joins read one shuffle of the texts
    cuts = rows.join(listed, ["id", "mark"]).select("doc_id", "id", "mark", "text", "spans").mapInArrow(_cut, _CUTS)
    spans = in_blocks(cuts).mapInArrow(_factored, "id long, mark long, s int, e int").groupBy("id", "mark").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    return rows.join(spans, ["id", "mark"], "left").select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")
