"""Sharding by best-fit-decreasing bin packing; the law is ``bytes``: shards of nearly equal size.

A document's size is the UTF-8 bytes of its text plus 8. Documents of equal text are one group and share
a shard. Groups, largest first, enter the shard of least remaining capacity that still holds them, found
in a balanced tree; the capacity is the least for which the given number of shards suffices.

Groups of one size class are interchangeable, so the packing sees classes, not groups: sizes are rounded
up to 1/1024 of their value, which leaves at most 1024 classes for each doubling, whatever the rows. The
driver packs (class, groups) pairs and gives back runs: which ranks of a class go to which shard. Ranks
and slots are counted in salted parts with prefix sums over the parts' totals, so a class, a shard or a
text that holds most rows is not one task's work.

A group larger than an even share can't be parted; the shard that takes it is as large as it is. Where a shard
must be over an even share, for this or because large groups don't divide evenly, it is closed, and the rest is
packed anew into the other shards, with the least capacity that does for them.

Defined cases: a null text counts as an empty one. Rows without doc_id are placed like others. Repeated
rows are members of one group. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.base import materialize

SHARDS = 24
PARTS = 256
#: Bits of a size that its class keeps.
BITS = 10


class Tree:
    """Balanced tree (a treap) of distinct keys."""

    def __init__(self) -> None:
        self.root, self.random = None, random.Random(0)

    def _split(self, node, key):
        """(keys under ``key``, the rest)."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, key) -> None:
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, self.random.random(), None, None]), right)

    def take(self, least):
        """Remove and return the first key that is not under ``least``; None if there is none."""
        left, right = self._split(self.root, least)
        node = right
        while node is not None and node[2] is not None:
            node = node[2]
        if node is not None:
            _, right = self._split(right, (node[0][0], node[0][1] + 1))
        self.root = self._merge(left, right)
        return None if node is None else node[0]


def pack(classes: list[tuple[int, int]], capacity: int, bins: int) -> list[tuple[int, int, int, int]] | None:
    """Runs (size, first, beyond, bin) of ``classes`` (size, items); None if ``bins`` don't suffice."""
    free, opened, runs = Tree(), 0, []
    for size, items in sorted(classes, reverse=True):
        at = 0
        while at < items:
            room, which = free.take((size, -1)) or (None, None)
            if room is None:
                if opened == bins or size > capacity:
                    return None
                room, which, opened = capacity, opened, opened + 1
            n = min(items - at, room // size)
            runs.append((size, at, at + n, which))
            free.add((room - n * size, which))
            at += n
    return runs


def tightest(classes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """Runs of the least capacity found for which ``bins`` suffice: doubling steps up from an even share, then halving."""
    low = max([0, *(s for s, _ in classes), -(-sum(s * n for s, n in classes) // bins)])
    best, step = pack(classes, low, bins), 1
    if best is not None:
        return best
    while (best := pack(classes, low + step, bins)) is None:
        low, step = low + step, step * 2
    high = low + step
    while high - low > 1:
        mid = (low + high) // 2
        if (made := pack(classes, mid, bins)) is None:
            low = mid
        else:
            best, high = made, mid
    return best


def _load(box: Counter) -> int:
    return sum(s * n for s, n in box.items())


def balanced(classes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """Runs as of ``tightest``, where a bin that is over an even share is closed before the rest is packed anew."""
    left, boxes, kept = Counter(dict(classes)), [], None
    for free in range(bins, 0, -1):
        made = [Counter() for _ in range(free)]
        for size, first, beyond, which in tightest(list(left.items()), free):
            made[which][size] += beyond - first
        made.sort(key=lambda box: (_load(box), max(box, default=0)))
        if kept and _load(kept[-1]) < _load(made[-1]):
            made = kept
        if free == 1 or _load(made[-1]) * free <= _load(left) * (1 + 2**-BITS):
            boxes += made
            break
        boxes.append(made.pop())
        left, kept = left - boxes[-1], made
    runs, taken = [], Counter()
    for which, box in enumerate(boxes):
        for size, n in box.items():
            runs.append((size, taken[size], taken[size] + n, which))
            taken[size] += n
    return runs


def size_class(x: Column) -> Column:
    """Size rounded up to BITS bits."""
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.conv(x.cast("string"), 10, 2)) - BITS, F.lit(0)).cast("int"))
    return (F.ceil(x / unit) * unit).cast("long")


def _ranked(rows: DataFrame, group: str, name: str, *order: str) -> DataFrame:
    """``rows`` with a gapless rank from 0 within ``group``, counted in PARTS salted parts."""
    salted = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(PARTS)))
    totals = salted.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    bases = totals.select(group, "_part", (F.sum("_n").over(Window.partitionBy(group).orderBy("_part")) - F.col("_n")).alias("_base"))
    w = Window.partitionBy(group, "_part").orderBy(*(F.asc_nulls_first(c) for c in order))
    return salted.withColumn("_rank", F.row_number().over(w) - 1).join(bases, [group, "_part"]).withColumn(name, F.col("_base") + F.col("_rank")).drop("_part", "_base", "_rank")


def shards(docs: DataFrame, bins: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.md5(text).alias("key"))
    rows = materialize(rows, "sizes")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes")).withColumn("class", size_class(F.col("bytes")))
    groups = materialize(_ranked(groups.select("key", "class"), "class", "rank", "key"), "groups")
    classes = [(r[0], r[1]) for r in groups.groupBy("class").count().collect()]  # at most 1024 for each doubling
    runs = rows.sparkSession.createDataFrame(balanced(classes, bins), "class long, first long, beyond long, shard int")
    placed = groups.join(F.broadcast(runs), "class").where("rank >= first and rank < beyond").select("key", "shard")  # as few as the classes and shards
    dealt = materialize(rows.join(placed, "key").drop("key"), "shards")
    slots = _ranked(dealt, "shard", "slot", "doc_id", "text_crc32", "size")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
