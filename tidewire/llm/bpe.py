"""Byte-level BPE: encode texts to token ids, decode ids to bytes.

Each match of the split pattern is encoded by itself. A segment tree stands over its byte positions;
a leaf holds the rank of the pair that starts there (none: infinity) and each inner node the least
(rank, position) below it, so that the root is the leftmost pair of least rank. A merge writes the new
token at its position and updates three leaves, the pair's, its dead right half's and its left
neighbour's, each on a path of logarithmic length. Short matches are merged many at a time, one tree
row each; long ones alone. Results equal tiktoken's ``encode_ordinary`` of the same ranks and pattern.

A worker keeps the ids of the white-space separated chunks it has met, up to CACHE_BYTES of them in
memory; a chunk of over KEPT characters is encoded each time.

Defined cases: a null text is encoded as an empty one, to no ids. A null doc_id is passed on. Repeated rows
give repeated results, and an empty table none. Equal ranks of pairs, as in a run of one letter, merge from
the left. Texts are read whole, whatever their length and however few blanks they hold. Extra columns are
passed on, but for ``ids`` and ``decoded`` of other meaning, which are replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Collection, Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewire.llm.base import caches, enter

CACHE_BYTES = 96_000_000
#: Characters of the longest chunk that is kept; bytes that one is taken to need, and for each character, with its ids.
KEPT, ENTRY, LETTER = 64, 150, 12
#: Characters of text whose chunks are looked up at a time.
SLICE = 500_000
#: Unicode's White_Space, which the split patterns mean by \s.
_WS = r"\t-\r \x85\xa0  -     　"
#: Chunks whose ends are ends of matches of the split pattern too: it has no match over white space but for one leading blank.
CHUNK = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Bytes of a match from which it is merged alone.
LONG = 256
_NONE = np.int64(1) << np.int64(62)


class Ranks:
    """Tokens of a rank file, and the rank of every pair of tokens whose bytes joined are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]

    @staticmethod
    def read(path: str) -> Ranks:
        with open(path, "rb") as lines:
            return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where it has none or where b is under 0."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0) & (a >= 0), self.values[at], _NONE)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, joined."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ids):
            return b""
        return self.flat[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + n, n)].tobytes()

    def merge_many(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words of under LONG bytes; rows of one matrix for each power of two of their length."""
        out: dict[bytes, bytes] = {}
        by: dict[int, list[bytes]] = {}
        for w in words:
            by.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(w)
        for width, rows in by.items():
            for at in range(0, len(rows), 4096):
                some = rows[at : at + 4096]
                ids = self._merge_rows(some, width)
                live = ids >= 0
                flat, ends = ids[live].astype("<i4").tobytes(), (4 * np.cumsum(live.sum(axis=1))).tolist()
                out.update(zip(some, (flat[i:j] for i, j in zip([0, *ends], ends, strict=False)), strict=True))
        return out

    def _merge_rows(self, words: list[bytes], width: int) -> np.ndarray:
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        size = np.array([len(w) for w in words])
        place = np.arange(width)
        ids = np.full((n, width + 1), -1, np.int64)  # the last column stands for "no token"
        ids[:, :width] = np.where(place < size[:, None], self.of_byte[raw], -1)
        nxt = np.minimum(np.broadcast_to(place + 1, (n, width)), size[:, None]).copy()
        nxt[nxt >= size[:, None]] = width
        prv = np.broadcast_to(place - 1, (n, width)).copy()
        prv[prv < 0] = width
        prv = np.concatenate([prv, np.full((n, 1), width)], axis=1)
        nxt = np.concatenate([nxt, np.full((n, 1), width)], axis=1)
        tree = np.full((n, 2 * width), _NONE)
        pair = self.rank(ids[:, :width], np.concatenate([ids[:, 1:width], np.full((n, 1), -1)], axis=1))
        tree[:, width:] = np.where(pair < _NONE, pair * width + place, _NONE)
        at = width // 2
        while at:
            tree[:, at : 2 * at] = np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2])
            at //= 2
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            best = tree[rows, 1]
            pos, new = best % width, best // width
            dead = nxt[rows, pos]
            after, before = nxt[rows, dead], prv[rows, pos]
            ids[rows, pos], ids[rows, dead] = new, -1
            nxt[rows, pos], prv[rows, after] = after, pos
            prv[:, width] = width
            here = self.rank(new, ids[rows, after])
            left = self.rank(ids[rows, before], new)
            tree[rows, width + dead] = _NONE
            tree[rows, width + pos] = np.where(here < _NONE, here * width + pos, _NONE)
            has = before < width
            tree[rows[has], width + before[has]] = np.where(left < _NONE, left * width + before, _NONE)[has]
            nodes = [width + dead, width + pos, width + np.where(has, before, pos)]
            while nodes[0][0] > 1:
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree[rows, x] = np.minimum(tree[rows, 2 * x], tree[rows, 2 * x + 1])
            rows = rows[tree[rows, 1] < _NONE]
        return ids[:, :width]

    def merge_one(self, word: bytes) -> bytes:
        """Ids of one word of any length."""
        n, none, pairs, size = len(word), int(_NONE), self.pairs, self.size
        width = max(2, 1 << (n - 1).bit_length())
        ids = [*self.of_byte[np.frombuffer(word, np.uint8)].tolist(), *[-1] * (width + 1 - n)]
        nxt = [min(i + 1, n) for i in range(n + 1)]
        prv = [i - 1 for i in range(n + 1)]
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (r := pairs.get(ids[i] * size + ids[i + 1])) is not None:
                tree[width + i] = r * width + i
        for x in range(width - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])

        def put(leaf: int, rank: int | None) -> None:
            x = width + leaf
            tree[x] = none if rank is None else rank * width + leaf
            while x > 1:
                x >>= 1
                tree[x] = min(tree[2 * x], tree[2 * x + 1])

        while (best := tree[1]) < none:
            new, pos = divmod(best, width)
            dead = nxt[pos]
            after, before = nxt[dead], prv[pos]
            ids[pos], ids[dead], nxt[pos], prv[after] = new, -1, after, pos
            put(dead, None)
            put(pos, pairs.get(new * size + ids[after]) if after < n else None)
            if before >= 0:
                put(before, pairs.get(ids[before] * size + new))
        return np.array([i for i in ids[:n] if i >= 0], "<i4").tobytes()

    def words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Little-endian 32-bit ids of each word."""
        out, short = {}, []
        for w in words:
            if (r := self.ranks.get(w)) is not None:
                out[w] = r.to_bytes(4, "little")
            elif len(w) >= LONG:
                out[w] = self.merge_one(w)
            else:
                short.append(w)
        out.update(self.merge_many(short))
        return out


class Encoder:
    """Ids of texts; ``learn`` gives new chunks with their ids as bytes, of which about ``most`` bytes are kept."""

    def __init__(self, learn: Callable[[list[str]], Iterable[tuple[str, bytes]]], most: int = CACHE_BYTES):
        self.learn, self.most, self.known, self.size = learn, most, {}, 0

    def __call__(self, texts: Iterable[str]) -> Iterator[bytes]:
        some, size = [], 0
        for text in texts:
            some.append(CHUNK.findall(text))
            size += len(text)
            if size >= SLICE:
                yield from self._look_up(some)
                some, size = [], 0
        yield from self._look_up(some)

    def _look_up(self, texts: list[list[str]]) -> Iterator[bytes]:
        if self.size > self.most:  # the first to come are the common ones
            self.known = dict(islice(self.known.items(), len(self.known) // 2))
            self.size = memory(self.known)
        known, of = self.known, self.known.__getitem__
        new = list(set(chain.from_iterable(texts)).difference(known))
        if max(map(len, new), default=0) > KEPT:
            passing = dict(self.learn([c for c in new if len(c) > KEPT]))
            new, of = [c for c in new if len(c) <= KEPT], lambda c: known[c] if len(c) <= KEPT else passing[c]
        self.size += memory(new)
        for at in range(0, len(new), 50_000):
            known.update(self.learn(new[at : at + 50_000]))
        for chunks in texts:
            yield b"".join(map(of, chunks))


def memory(chunks: Collection[str]) -> int:
    return ENTRY * len(chunks) + LETTER * sum(map(len, chunks))


@lru_cache(maxsize=1)
def _ranks(path: str) -> Ranks:
    return Ranks.read(path)


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file that this process keeps."""
    ranks, split = _ranks(path), regex.compile(pattern)

    def learn(chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        parts = [[m.encode("utf-8", "replace") for m in split.findall(c)] for c in chunks]
        ids = ranks.words(list({w for p in parts for w in p}))
        return zip(chunks, [ids[p[0]] if len(p) == 1 else b"".join([ids[w] for w in p]) for p in parts], strict=True)

    return Encoder(learn)


caches("bpe", encoder.cache_clear, _ranks.cache_clear)


def id_lists(found: Iterable[bytes]) -> pa.Array:
    """list<int32> of little-endian ids."""
    found = list(found)
    ends = np.cumsum([0, *(len(x) // 4 for x in found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))


def _with(df: DataFrame, read: str, more: dict[str, T.DataType], of: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """``df`` with columns made of one of its columns; they replace those of their names."""
    rest = [c for c in df.columns if c.lower() not in more]
    schema = T.StructType([*(df.schema[c] for c in rest), *(T.StructField(c, kind) for c, kind in more.items())])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bpe")
        for whole in batches:
            for batch in parted(whole, read):
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *of(batch.column(read))], names=[*rest, *more])

    return df.select(*dict.fromkeys([*rest, read])).mapInArrow(mapped, schema)


def parted(batch: pa.RecordBatch, by: str, most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of a column, so that long texts don't meet in one list."""
    rows = max(1, batch.num_rows * most // max(1, batch.column(by).nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


IDS, DECODED = {"ids": T.ArrayType(T.IntegerType(), False)}, {"decoded": T.BinaryType()}


def _encoded(path: str, pattern: str, texts: pa.Array) -> pa.Array:
    return id_lists(encoder(path, pattern)(t.as_py() or "" for t in texts))


def _decoded(path: str, ids: pa.Array) -> pa.Array:
    flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(len(i) if i.is_valid else 0 for i in ids)])
    return pa.array([_ranks(path).decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ids, the token ids of the whole text."""
    return _with(docs, text, IDS, lambda x: [_encoded(path, pattern, x)])


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` with decoded, the bytes that the ids stand for."""
    return _with(tokens, "ids", DECODED, lambda x: [_decoded(path, x)])


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ids and decoded, in one Python worker for each task."""

    def both(texts: pa.Array) -> list[pa.Array]:
        ids = _encoded(path, pattern, texts)
        return [ids, _decoded(path, ids)]

    return _with(docs, text, IDS | DECODED, both)
