"""Token counts of a sentencepiece BPE model, without ids.

A text is a row of symbols, at first its characters. A heap holds every adjacent pair that is a piece, by the
rank of that piece, then by place; a linked list holds the neighbours. The least pair is popped and merged, and the
pairs that its symbol now forms with its neighbours are pushed; an entry whose pair is gone is passed over when it
comes up. The count is the number of symbols less that of merges; a character that is no piece counts for
its UTF-8 bytes, which the model falls back to. Ids of texts are never made. Short parts are merged many at a time,
each with a heap and a list in its row of a matrix; long ones alone.

No pair is merged over a place where no piece has its two characters side by side, so a text is cut there, first
before each run of blanks, and equal cuts are counted once by each worker, in up to CACHE_BYTES of memory; one of
over KEPT characters is counted each time.

Defined cases: a null text counts as an empty one, to no bytes and no tokens. A null doc_id is passed on. Repeated
rows give repeated results, an empty table none. Pieces of equal score are merged from the left, as the library
does. Texts are read whole, whatever their length and however few blanks they hold: a run of one letter takes time in
proportion to its length times the logarithm of it. Strings of control pieces in a text are ordinary text. Columns of
the names that are added are replaced, others passed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.base import caches, enter
from tidewire.llm.bpe import parted

CACHE_BYTES = 96_000_000
#: Characters of the longest cut that is kept; bytes that one is taken to need, and for each character.
KEPT, ENTRY, LETTER = 48, 110, 2
#: Characters of text whose cuts are looked up at a time.
SLICE = 2_000_000
#: Characters up to which a part is merged beside others, as a row of a matrix of at most CELLS places.
LONG, CELLS = 64, 1 << 16
NONE = np.int64(1) << np.int64(62)
#: The character that stands for a blank in pieces.
BLANK = "▁"
#: Control characters at which texts are cut, where no piece has them.
CONTROLS = "\t\n\r"


class Pieces:
    """The pieces of a model by rank, and the number of tokens of texts."""

    def __init__(self, scores: dict[str, float]):
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {piece: order[score] for piece, score in scores.items()}
        letters = sorted({c for p in scores for c in p})
        symbols = [*scores, *(c for c in letters if c not in scores)]  # a character that is in pieces only is a symbol, too
        number = {s: k for k, s in enumerate(symbols)}
        self.count = len(symbols)
        self.rank = np.array([self.ranks.get(s, -1) for s in symbols])
        self.bytes_more = np.array([0 if s in scores else len(s.encode()) - 1 for s in symbols])
        formed = {number[p[:k]] * self.count + number[p[k:]]: number[p] for p in scores for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        formed[int(NONE)] = -1  # so that there is one
        self.keys = np.array(sorted(formed), np.int64)
        self.values = np.array([formed[k] for k in self.keys.tolist()], np.int64)
        self.letter = np.full(0x110000, -1, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters))
        self.symbol = np.array([number[c] for c in letters], np.int64)
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)  # its last row and column: characters of no piece
        places = {c: k for k, c in enumerate(letters)}
        for p in scores:
            for x, y in pairwise(p):
                self.beside[places[x], places[y]] = True
        blanks = f" {BLANK}"
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in scores):
            self.cuts = re.compile(r"(?s).+")
        else:
            controls = "".join(c for c in CONTROLS if c not in places)
            self.cuts = re.compile(f"[{blanks}]*[^{blanks}{controls}]+|[{blanks}]+" + (f"|[{controls}]" if controls else ""))
        self.known: dict[str, int] = {}
        self.size = 0

    def __call__(self, texts: Iterable[str]) -> Iterator[int]:
        """Tokens of each text."""
        some, size = [], 0
        for text in texts:
            some.append(self.cuts.findall(f" {text}") if text else [])
            size += len(text)
            if size >= SLICE:
                yield from self._look_up(some)
                some, size = [], 0
        yield from self._look_up(some)

    def _look_up(self, texts: list[list[str]]) -> Iterator[int]:
        if self.size > CACHE_BYTES:  # the first to come are the common ones
            self.known = dict(islice(self.known.items(), len(self.known) // 2))
            self.size = sum(ENTRY + LETTER * len(c) for c in self.known)
        known = self.known
        new = list(set(chain.from_iterable(texts)).difference(known))
        known.update(zip(new, self.of_cuts(new), strict=True))
        for cuts in texts:
            yield sum(map(known.__getitem__, cuts))
        for cut in new:
            if len(cut) > KEPT:
                del known[cut]
            else:
                self.size += ENTRY + LETTER * len(cut)

    def of_cuts(self, cuts: list[str]) -> list[int]:
        """Tokens of each of some parts of texts, which are cut further where no piece has two characters side by side."""
        if not cuts:
            return []
        text = "".join(cuts).replace(" ", BLANK)
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        firsts = np.cumsum([0, *map(len, cuts)])[:-1]
        letters = self.letter[codes]
        begins = np.ones(len(codes), bool)
        begins[1:] = ~self.beside[letters[:-1], letters[1:]]
        begins[firsts] = True
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, len(codes)))
        tokens = sizes.copy()
        at = starts[letters[starts] < 0]  # each is a part of its own
        tokens[letters[starts] < 0] = 1 + (codes[at] > 0x7F) + (codes[at] > 0x7FF) + (codes[at] > 0xFFFF)
        lone = (sizes == 1) & (letters[starts] >= 0)
        tokens[lone] += self.bytes_more[self.symbol[letters[starts[lone]]]]
        width = 2
        while width <= LONG:
            which = np.flatnonzero((sizes > width // 2) & (sizes <= width) & (sizes > 1))
            rows = max(1, CELLS // width)
            for k in range(0, len(which), rows):
                some = which[k : k + rows]
                place = np.arange(width)
                inside = place < sizes[some, None]
                found = np.where(inside, self.symbol[letters[np.minimum(starts[some, None] + place, len(codes) - 1)]], -1)
                tokens[some] = self.merged_rows(found, sizes[some])
            width *= 2
        for k in np.flatnonzero(sizes > LONG).tolist():
            tokens[k] = self.merged(text[starts[k] : starts[k] + sizes[k]])
        return np.add.reduceat(tokens, np.searchsorted(starts, firsts)).tolist()

    def formed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two symbols form, -1 for none."""
        key = a * self.count + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.values[at], -1)

    def merged_rows(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Symbols less merges of many short parts at a time: a heap and a linked list in each row of a matrix."""
        n, width = at.shape
        heaps = Heaps(n, 4 * width)
        place = np.arange(width + 1)
        at = np.concatenate([at, np.full((n, 1), -1)], axis=1)  # the last column stands for no symbol
        after = np.where(place + 1 < sizes[:, None], place + 1, width)
        before = np.broadcast_to(np.where(place > 0, place - 1, width), (n, width + 1)).copy()
        piece = np.concatenate([self.formed(at[:, :-1], at[:, 1:]), np.full((n, 1), -1)], axis=1)
        held = np.where(piece >= 0, self.rank[piece] * width + place, -1)
        heaps.fill(np.where(held >= 0, held, NONE))
        left = sizes.copy()
        rows = np.flatnonzero(heaps.size)
        while len(rows):
            top = heaps.pop(rows)
            i = top % width
            valid = held[rows, i] == top
            r, i = rows[valid], i[valid]
            j, new = after[r, i], piece[r, i]
            k, p = after[r, j], before[r, i]
            at[r, i], at[r, j], held[r, j] = new, -1, -1
            after[r, i], before[r, k] = k, i
            left[r] -= 1
            for x, made in ((i, self.formed(new, at[r, k])), (p, self.formed(at[r, p], new))):
                key = np.where(made >= 0, self.rank[made] * width + x, -1)
                held[r, x], piece[r, x] = key, made
                heaps.push(r[key >= 0], key[key >= 0])
            rows = rows[heaps.size[rows] > 0]
        return left + np.where(at >= 0, self.bytes_more[at], 0).sum(axis=1)

    def merged(self, symbols: str) -> int:
        """Symbols less merges of one part of any length."""
        n, rank = len(symbols), self.ranks.get
        at = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [rank(symbols[i : i + 2]) for i in range(n - 1)] + [None]
        heap = [r * n + i for i, r in enumerate(pair) if r is not None]
        heapify(heap)
        left = n
        while heap:
            r, i = divmod(heappop(heap), n)
            if pair[i] != r:
                continue
            j = after[i]
            k = after[j]
            at[i] = joined = at[i] + at[j]
            at[j], pair[j], after[i], pair[i] = "", None, k, None
            left -= 1
            if k < n:
                before[k] = i
                pair[i] = r = rank(joined + at[k])
                if r is not None:
                    heappush(heap, r * n + i)
            p = before[i]
            if p >= 0:
                pair[p] = r = rank(at[p] + joined)
                if r is not None:
                    heappush(heap, r * n + p)
        return left + sum(len(c.encode()) - 1 for c in at if len(c) == 1 and c not in self.ranks)


class Heaps:
    """Binary heaps of integers, one in each row, on which one step is taken in many rows at a time."""

    def __init__(self, rows: int, most: int):
        self.width, self.size = most, np.zeros(rows, np.int64)
        self.flat = np.full(rows * most, NONE)

    def fill(self, keys: np.ndarray) -> None:
        """Start with these keys in each row; those of NONE don't count. A sorted row is a heap."""
        self.flat.reshape(-1, self.width)[:, : keys.shape[1]] = np.sort(keys, axis=1)
        self.size[:] = (keys < NONE).sum(axis=1)

    def pop(self, rows: np.ndarray) -> np.ndarray:
        """The least key of each of some rows, none of which is empty; it is taken out."""
        flat, base = self.flat, rows * self.width
        top = flat[base]
        self.size[rows] -= 1
        last = base + self.size[rows]
        key = flat[last]
        flat[last] = NONE
        x = np.zeros(len(rows), np.int64)
        moving = self.size[rows] > 0
        while moving.any():
            base, key, x = base[moving], key[moving], x[moving]
            child = np.minimum(2 * x + 1, self.width - 2)
            a, b = flat[base + child], flat[base + child + 1]
            child += b < a
            least = np.minimum(a, b)
            moving = least < key
            flat[base + x] = np.where(moving, least, key)
            x = child  # where a smaller key has moved up
        return top

    def push(self, rows: np.ndarray, keys: np.ndarray) -> None:
        """Put one key into each of some rows, each of which is named once."""
        flat, base = self.flat, rows * self.width
        x = self.size[rows]
        self.size[rows] += 1
        while len(x):
            above = np.maximum(x - 1, 0) >> 1
            parent = flat[base + above]
            moving = (x > 0) & (parent > keys)
            flat[base + x] = np.where(moving, parent, keys)
            base, keys, x = base[moving], keys[moving], above[moving]


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    """The pieces of a model file that texts can hold, read with the library; its merging isn't used."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
    return Pieces({model.id_to_piece(i): model.get_score(i) for i in plain})


caches("token_counts", pieces.cache_clear)

N_TOKENS = "n_tokens"


def counted(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, the UTF-8 bytes of the whole text, and n_tokens."""
    rest = [c for c in docs.columns if c.lower() not in (N_TOKENS, "n_bytes")]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("n_bytes", T.LongType(), False), T.StructField(N_TOKENS, T.LongType(), False)])

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("token_counts")
        count = pieces(path)
        for whole in batches:
            for batch in parted(whole, "_text"):
                texts = batch.column("_text")
                found = pa.array(list(count(t.as_py() or "" for t in texts)), pa.int64())
                sizes = pa.compute.binary_length(texts).cast(pa.int64()).fill_null(0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), sizes, found], names=schema.names)

    return docs.select(*rest, F.col(text).cast("string").alias("_text")).mapInArrow(mapped, schema)


def over(docs: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens, and over_limit: whether the text has more than ``limit`` tokens."""
    return counted(docs, path, text).withColumn("over_limit", F.col(N_TOKENS) > limit)
