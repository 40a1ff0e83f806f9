"""MinHash near-dedup over an LSH forest.

A document's set is its distinct 5-word shingles (fewer words: the whole sequence). One signature of
TREES * STEP min-hash values is read in TREES sorted orders: order t starts at value t * STEP and goes
round. In each order the documents that share their first DEPTHS[0] values form a region; its members
are one another's longest-common-prefix neighbours. Where a search has a region of more than REGION
members, it reads on to the next depth, so depth adapts to how crowded the order is there.

1. Documents with equal sets become one node.
2. Every node takes one leader: the first member it meets most often as the head of its regions. The
   pair is confirmed on the full sets.
3. In crowded regions that still hold several components, parted by depth, every node takes one more
   partner: the member of another component whose signature agrees best. These pairs are confirmed too.
4. Regions of the first depth that hold several components even now are searched for all pairs from
   different components whose sizes allow a link and whose signatures agree well enough. Members that have such
   a pair get their texts, and the pairs are confirmed on the full sets, best first; a confirmed pair joins its
   components, so n members send on fewer than n links. A region of more than REGION members or SHINGLES
   shingles is read in blocks: blocks of its largest component meet blocks of the others, and these meet one
   another, each two of them once.

Signatures and texts are kept of the members of regions alone, and a member has its signature joined to it
before it is copied to blocks.
5. Components of the confirmed links, by alternating large and small stars.

A pair of similarity 0.75 shares a region of the first depth with probability 0.42 in each of 24
orders, so it is missed with probability 2e-6. Nothing is capped.

Numbers of regions and components are written before they are joined to the members, so a region that holds
most members is a skewed join of two written tables, which Spark splits, or a broadcast of a counted one.

Defined cases: a text that is null, empty or without words has no shingles and no links. Rows of one
doc_id are one document. A row without doc_id is linked with nothing: component_id is null, kept true.
Ties go to the smaller doc_id. An empty table gives no rows. Texts are read whole, whatever their length.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.base import WordHashes, caches, discard, enter, joinable, materialize, mix, multipliers, spread
from tidewire.llm.bpe import parted

WIDTH = 5
TREES, STEP = 24, 4
VALUES = TREES * STEP
DEPTHS = (3, 6, 10, 16)
#: Members up to which a region is searched as a whole.
REGION = 512
#: Shingles up to which a region's sets are compared in one piece.
SHINGLES = 4_000_000
#: Signature values that must agree before a pair of the last search is confirmed: 4 standard deviations under 0.75.
AGREE = round(VALUES * 0.75 - 4 * (VALUES * 0.75 * 0.25) ** 0.5)
SIMILAR = (75, 100)

_A, _B = multipliers(VALUES, 1)[None, :], multipliers(VALUES, 2)[None, :]
_M = multipliers(WIDTH, 3)
_words = WordHashes()
caches("minhash", _words.clear)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the set of a text."""
    words = text.encode().lower().split() if text else []  # bytes: only ASCII is lowered or split at
    if not words:
        return np.empty(0, np.uint64)
    w = _words.array(words)
    if len(w) < width:
        return np.array([xxhash.xxh64_intdigest(w.tobytes(), seed=len(w))], np.uint64)
    n = len(w) - width + 1
    x = w[:n] * _M[0]
    for k in range(1, width):
        x += w[k : n + k] * _M[k]
    return np.unique(mix(x))


def signature(x: np.ndarray) -> np.ndarray:
    """High 32 bits of the least value of each of VALUES hash functions."""
    low = np.full(VALUES, ~np.uint64(0))
    for at in range(0, len(x), 8192):
        np.minimum(low, ((x[at : at + 8192, None] ^ _B) * _A).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """The link rule on two full sets."""
    if 100 * min(len(x), len(y)) < 75 * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return 0 < both and SIMILAR[1] * both >= SIMILAR[0] * (len(x) + len(y) - both)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("minhash")
    for batch in (part for whole in batches for part in parted(whole, "text")):
        sizes, marks, rows = [], [], []
        for text in batch.column("text"):
            x = shingles(text.as_py())
            sizes.append(len(x))
            marks.append(xxhash.xxh3_128_digest(x.tobytes()))
            rows.append(signature(x) if len(x) else np.zeros(VALUES, np.int32))
        marks = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
        values = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * VALUES, pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), values], names=["doc_id", "n_shingles", "fp1", "fp2", "sig"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough; rows come sorted by a, whose set is kept until it changes."""
    enter("minhash")
    last, x = None, None
    for batch in (part for whole in batches for part in parted(whole, "tb")):
        a, b, ta, tb = (batch.column(k) for k in ("a", "b", "ta", "tb"))
        keep = []
        for i in range(batch.num_rows):
            if (key := ta[i].as_py()) != last:
                last, x = key, shingles(key)
            keep.append(similar(x, shingles(tb[i].as_py())))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    return pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(_confirmed, "a long, b long").distinct()


def _agreeing(x: np.ndarray, sizes: np.ndarray, comps: np.ndarray, roles: np.ndarray, at: int, first: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of 64 rows from ``at`` on with all later rows, from different components, not both of a block or
    both queries, of sizes that allow a link, that agree in AGREE values: (i, j, agreement). ``first``: only pairs
    whose first shared order, at the first depth, it is."""
    some = x[at : at + 64]
    count = np.zeros((len(some), len(x) - at), np.int16)
    earlier = np.zeros(count.shape, bool)
    for tree in range(TREES):
        shared = np.ones(count.shape, bool)
        for k in range(tree * STEP, (tree + 1) * STEP):
            same = some[:, k, None] == x[None, at:, k]
            count += same
            if k < tree * STEP + DEPTHS[0]:
                shared &= same
        if first is not None and tree < first:
            earlier |= shared
    i, j = np.nonzero((count >= AGREE) & ~earlier)
    n = count[i, j]
    i, j = i + at, j + at
    ok = (i < j) & (comps[i] != comps[j]) & ((roles[i] == 0) | (roles[i] != roles[j]))
    ok &= 100 * np.minimum(sizes[i], sizes[j]) >= 75 * np.maximum(sizes[i], sizes[j])
    return i[ok], j[ok], n[ok]


class Region:
    """Rows that are searched together: signatures, nodes, components, roles, sizes and, in the last search, sets."""

    def __init__(self, name: int, rows: list[tuple]):
        self.name = name
        self.x = np.frombuffer(b"".join(r[0] for r in rows), np.int32).reshape(-1, VALUES)
        self.nodes, self.comps, self.roles, self.sizes = (np.array([r[k] for r in rows]) for k in (1, 2, 3, 4))
        self.sets, self.tree = [r[5] for r in rows], rows[0][6]

    def pairs(self, first: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, len(self.nodes) - 1, 64):
            yield _agreeing(self.x, self.sizes, self.comps, self.roles, at, first)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[Region]:
    """Each region; rows come sorted by region."""
    enter("minhash")
    region, rows = None, []
    for batch in batches:
        texts = batch.column("text") if "text" in batch.schema.names else None
        flat = batch.column("sig").flatten().to_numpy().reshape(-1, VALUES)
        for i, (r, tree, node, comp, role, size) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("region", "tree", "node", "comp", "role", "size")), strict=True)):
            if r != region:
                if len(rows) > 1:
                    yield Region(region, rows)
                region, rows = r, []
            rows.append((flat[i].tobytes(), node, comp, role, size, shingles(texts[i].as_py()) if texts else None, tree))
    if len(rows) > 1:
        yield Region(region, rows)


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node of a region, the node of another component that agrees best with it."""
    for r in _regions(batches):
        best, whom = np.zeros(len(r.nodes), np.int64), np.full(len(r.nodes), -1)
        for i, j, n in r.pairs(None):
            for a, b in ((i, j), (j, i)):
                order = np.argsort(n, kind="stable")
                a, b, m = a[order], b[order], n[order]
                np.maximum.at(best, a, m)
                hit = best[a] == m
                whom[a[hit]] = b[hit]
        has = np.flatnonzero(whom >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(r.nodes[has]), pa.array(r.nodes[whom[has]]), pa.array(best[has])], names=["node", "other", "agree"])


def _active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each region that have a pair whose signatures agree well enough."""
    for r in _regions(batches):
        has = np.zeros(len(r.nodes), bool)
        for i, j, _ in r.pairs(r.tree):
            has[i] = has[j] = True
        if has.any():
            n = int(has.sum())
            sig = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * VALUES, pa.array(r.x[has].ravel()))
            columns = [np.full(n, r.name), np.full(n, r.tree, np.int32), r.nodes[has], r.comps[has], r.roles[has].astype(np.int32), r.sizes[has]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), sig], names=["region", "tree", "node", "comp", "role", "size", "sig"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links, confirmed on the full sets, that join the components of a region."""
    for r in _regions(batches):
        above: dict[int, int] = {}
        a, b = [], []

        def head(c: int, above: dict[int, int] = above) -> int:
            while c in above:
                c = above[c]
            return c

        for i, j, n in r.pairs(r.tree):
            for k in np.argsort(-n, kind="stable").tolist():
                p, q = head(r.comps[i[k]]), head(r.comps[j[k]])
                if p != q and similar(r.sets[i[k]], r.sets[j[k]]):
                    above[max(p, q)] = min(p, q)
                    a.append(min(r.nodes[i[k]], r.nodes[j[k]]))
                    b.append(max(r.nodes[i[k]], r.nodes[j[k]]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node that each node of an edge reaches; alternating large and small stars."""
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        then = materialize(small, "edges")
        seen = then.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        discard(now)
        now = then
        if seen == mark:
            break
        mark = seen
    comps = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    heads = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return comps.unionByName(heads)


def _orders(sigs: DataFrame) -> DataFrame:
    """(node, size, tree, region): the region of the first depth of each node in every sorted order."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.slice(F.concat("sig", "sig"), t * STEP + 1, DEPTHS[0])))
    return sigs.select("node", "size", F.posexplode(keys).alias("tree", "region"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    signed = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_signed, "doc_id long, n_shingles long, fp1 long, fp2 long, sig array<int>"), "signatures")
    whole = signed.where("n_shingles > 0 and doc_id is not null")
    heads = materialize(whole.groupBy("n_shingles", "fp1", "fp2").agg(F.min("doc_id").alias("node")), "nodes")
    sigs = whole.select("doc_id", "sig", F.col("n_shingles").alias("size")).join(heads.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sigs = materialize(sigs.withColumnRenamed("doc_id", "node"), "forest")

    orders = materialize(_orders(sigs), "orders")
    regions = materialize(orders.groupBy("region").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1"), "regions")
    members = materialize(orders.join(regions, "region"), "members")
    used = [regions, members]
    discard(orders)
    needed = joinable(materialize(members.select("node").distinct(), "needed"))
    texts = materialize(docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).join(needed, "node", "left_semi"), "texts")
    shared = materialize(sigs.select("node", "sig").join(needed, "node", "left_semi"), "shared")
    discard(sigs)
    sigs = shared

    votes = members.where("node <> head").groupBy("node", "head").count().groupBy("node").agg(F.max(F.struct("count", -F.col("head"))).alias("best"))
    led = votes.select(F.col("node").alias("b"), (-F.col("best.col2")).alias("a"))
    links = materialize(_confirm(led, texts), "links")

    comps = materialize(components(links), "components")
    members = members.select("region", "tree", "node", "size")

    # What the leaders left apart: first one more partner each in crowded regions, then everything else.
    level = _several(_with_comps(members, comps))
    best = _dealt(_parted(level, sigs), sigs).mapInArrow(_partners, "node long, other long, agree long").groupBy("node").agg(F.max(F.struct("agree", -F.col("other"))).alias("x")).select("node", (-F.col("x.col2")).alias("other"))
    pairs = materialize(best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "pairs")
    if not pairs.isEmpty():
        links = links.union(materialize(_confirm(pairs, texts), "links"))
        comps = materialize(components(links), "components")
        level = _several(_with_comps(members, comps))
    active = _dealt(_blocked(level, sigs), sigs).mapInArrow(_active, "region long, tree int, node long, comp long, role int, size long, sig array<int>")
    active = materialize(active, "active")
    rest = materialize(_dealt(active.join(texts, "node"), sigs).mapInArrow(_joined, "a long, b long"), "rest")
    if not rest.isEmpty():
        comps = materialize(components(links.union(rest)), "components")
    discard(texts, sigs, active, *used)

    named = heads.join(comps, "node", "left").select("n_shingles", "fp1", "fp2", F.coalesce("comp", "node").alias("c"))
    linked = whole.select("doc_id", "n_shingles", "fp1", "fp2").join(named, ["n_shingles", "fp1", "fp2"]).select("doc_id", "n_shingles", "c")
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("c"))
    return linked.unionByName(alone).select("doc_id", "n_shingles", F.col("c").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("c"), F.lit(True)).alias("kept"))


def _several(level: DataFrame) -> DataFrame:
    """Rows (region, tree, node, size, comp) of the regions that hold several components, with the members and shingles of each."""
    found = level.groupBy("region").agg(F.count("*").alias("n"), F.sum("size").alias("weight"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("region", "n", "weight")
    return materialize(level.join(joinable(materialize(found, "found")), "region"), "several")


def _with_comps(members: DataFrame, comps: DataFrame) -> DataFrame:
    return members.join(comps, "node", "left").select("region", "tree", "node", "size", F.coalesce("comp", "node").alias("comp"))


def _parted(level: DataFrame, sigs: DataFrame) -> DataFrame:
    """Members of the regions of more than REGION of them, in the regions of the first depth that parts these."""
    own = ("region", "tree", "node", "size", "comp")
    leaves = level.where("false").select(*own)
    for depth in DEPTHS[1:]:
        crowded = level.where(F.col("n") > REGION).select("tree", "node", "size", "comp")
        if crowded.isEmpty():  # what is crowded at the last depth, too, is left to the last search
            break
        region = F.xxhash64("tree", F.slice(F.concat("sig", "sig"), F.col("tree") * STEP + 1, F.lit(depth)))
        level = _several(materialize(crowded.join(sigs, "node").select(region.alias("region"), "tree", "node", "size", "comp"), "level"))
        leaves = leaves.union(level.where(F.col("n") <= REGION).select(*own))
    return leaves.withColumn("role", F.lit(0)).join(sigs, "node")


def _blocked(level: DataFrame, sigs: DataFrame) -> DataFrame:
    """Regions of several components, at the first depth, with signatures. A region of more than REGION members or
    SHINGLES shingles is cut into blocks: those of its largest component (role 1) meet those of its other members
    (role 2), and these meet one another, each two once (roles 1 and 2) and each itself (role 0). Every pair of
    different components meets once."""
    whole = (F.col("n") <= REGION) & (F.col("weight") <= SHINGLES)
    sizes = level.where(~whole).groupBy("region", "comp", "n", "weight").agg(F.count("*").alias("k"), F.sum("size").alias("w")).groupBy("region").agg(F.max(F.struct("k", "comp", "w")).alias("x"), F.max("n").alias("n"), F.max("weight").alias("weight"))
    pieces = lambda n, weight: F.ceil(F.greatest(n * 2 / REGION, weight * 2 / SHINGLES)).cast("long")
    sizes = sizes.select("region", F.col("x.comp").alias("major"), pieces(F.col("x.k"), F.col("x.w")).alias("blocks"), pieces(F.col("n") - F.col("x.k"), F.col("weight") - F.col("x.w")).alias("queries"))
    rows = level.select("region", "tree", "node", "size", "comp").join(joinable(materialize(sizes, "sizes")), "region", "left").join(sigs, "node")
    spot = lambda pieces: F.pmod(F.xxhash64("node"), F.col(pieces))
    every = lambda pieces, f: F.transform(F.sequence(F.lit(0).cast("long"), F.col(pieces) - 1), f)
    copy = lambda role, kind, b, q: F.struct(role.alias("role"), F.xxhash64("region", F.lit(kind), b, q).alias("region"))
    own = spot("queries")
    base = every("queries", lambda q: copy(F.lit(1), 0, spot("blocks"), q))
    across = every("blocks", lambda b: copy(F.lit(2), 0, b, own))
    among = every("queries", lambda x: copy(F.when(own == x, 0).when(own < x, 1).otherwise(2), 1, F.least(own, x), F.greatest(own, x)))
    one = F.array(F.struct(F.lit(0).alias("role"), F.col("region").alias("region")))
    copies = F.when(F.col("major").isNull(), one).when(F.col("comp") == F.col("major"), base).otherwise(F.concat(across, among))
    return rows.select("tree", "node", "size", "comp", "sig", F.explode(copies).alias("c")).select("c.region", "tree", "node", "size", "comp", "c.role", "sig")


def _dealt(rows: DataFrame, sigs: DataFrame) -> DataFrame:
    """``rows`` with signatures, sorted by region."""
    return rows.repartition(spread(sigs), "region").sortWithinPartitions("region", "node")
