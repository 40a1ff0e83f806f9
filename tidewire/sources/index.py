"""The stored search index: segments of postings that are never changed, and bitmaps of what is deleted in them.

A segment holds the postings of some articles' words (``words``) and of the trigrams of their translations (``grams``),
and their lengths. A posting is a row: term, id, column and the places where the term stands. A new segment's rows lie as its articles
do, in runs sorted by term, so that nothing is shuffled for it, and a search reads the pages of its terms in each file; a merged
one's are dealt by term and by runs of ids. So a frequent word is many tasks' work. A change writes one segment with the rows of the changed articles, and marks their ids in the
segments that held them. Segments of like size are merged once there are FAN of them, by their rows; no text is
read for that. The manifest names the live segments and counts what is live, so statistics need no scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import search
from tidewire.plans.session import written
from tidewire.sources.manifest import Manifests

#: Segments of like size that are merged.
FAN = 4
LENGTHS = "id LONG, category STRING, words LONG, letters LONG"
DELETES = "segment INT, bucket LONG, bits BINARY"


def bitmaps(rows: DataFrame) -> DataFrame:
    """Ids of segments (segment, id) as bitmaps of 32,768 ids each."""
    return rows.groupBy("segment", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def marked(bits: str = "bits", number: str = "id") -> Column:
    """Whether the bit of an id is set in a bitmap."""
    return F.expr(f"cast(conv(hex(substring({bits}, cast(bitmap_bit_position({number}) div 8 as int) + 1, 1)), 16, 10) as int) >> cast(bitmap_bit_position({number}) % 8 as int) & 1 = 1")


class Index:
    """The index of a store's articles under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.manifests = spark, root.rstrip("/"), Manifests(spark, root)

    def state(self) -> dict:
        """version, next (segment), segments (number to live articles), deletes (their version) and totals."""
        return self.manifests.read() or {"version": 0, "next": 1, "segments": {}, "deletes": None, "totals": {"docs": 0, "words": 0, "letters": 0}}

    def exists(self) -> bool:
        return bool(self.manifests.numbers())

    def _deletes(self, state: dict) -> DataFrame:
        if state["deletes"] is None:
            return self.spark.createDataFrame([], DELETES)
        return self.spark.read.schema(DELETES).parquet(f"{self.root}/deletes/v{state['deletes']}")

    def _live(self, kind: str, ddl: str, state: dict, segments: list[int] | None = None, where: Column | None = None) -> DataFrame:
        """Rows of a kind in some segments, with segment, without those of deleted articles. The filter goes to the files."""
        numbers = [int(n) for n in state["segments"]] if segments is None else segments
        if not numbers:
            return self.spark.createDataFrame([], f"{ddl}, segment INT")
        rows = self.spark.read.schema(f"{ddl}, segment INT").option("basePath", f"{self.root}/{kind}").parquet(*(f"{self.root}/{kind}/segment={n}" for n in numbers))
        if where is not None:
            rows = rows.where(where)
        if state["deletes"] is None:
            return rows
        dead = self._deletes(state).where(F.col("segment").isin(numbers))
        joined = rows.withColumn("bucket", F.bitmap_bucket_number("id")).join(dead, ["segment", "bucket"], "left")
        return joined.where(F.col("bits").isNull() | ~marked()).select(*rows.columns)

    def postings(self, kind: str, terms: list[str], state: dict | None = None) -> DataFrame:
        """Live postings of some terms; ``kind`` is words or grams."""
        return self._live(kind, search.POSTINGS, state or self.state(), where=F.col("term").isin(*terms))

    def words(self, state: dict | None = None) -> DataFrame:
        """Live postings of all words."""
        return self._live("words", search.POSTINGS, state or self.state()).drop("segment")

    def lengths(self, state: dict | None = None) -> DataFrame:
        """id, category, words and letters of every live article."""
        return self._live("lengths", LENGTHS, state or self.state())

    def rebuild(self, articles: DataFrame) -> None:
        """One segment of all articles."""
        state = self.state() | {"segments": {}, "deletes": None, "totals": {"docs": 0, "words": 0, "letters": 0}}
        self._publish(*self._added(articles, state))

    def change(self, changed: DataFrame, removed: DataFrame | None = None) -> None:
        """One new segment of changed or new articles; what the index has of them, and of removed ones (id), is deleted."""
        state = self.state()
        ids = changed.select("id") if removed is None else changed.select("id").union(removed.select("id"))
        ids = written(ids.distinct(), "ids")
        gone = written(self.lengths(state).join(ids, "id", "left_semi").select("segment", "id", "words", "letters"), "gone")
        lost = {r["segment"]: r for r in gone.groupBy("segment").agg(F.count("*").alias("docs"), F.sum("words").alias("words"), F.sum("letters").alias("letters")).collect()}  # one row for each segment
        state = state | {"segments": dict(state["segments"]), "totals": dict(state["totals"])}
        for number, row in lost.items():
            state["segments"][str(number)] -= row["docs"]
            for c in ("docs", "words", "letters"):
                state["totals"][c] -= row[c]
        old = self._deletes(state)
        state, version = self._added(changed, state)
        if lost:
            both = old.where(F.col("segment").isin([int(n) for n in state["segments"]])).unionByName(bitmaps(gone)).groupBy("segment", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
            both.write.mode("overwrite").parquet(f"{self.root}/deletes/v{version}")
            state["deletes"] = version
        for number in [n for n, docs in state["segments"].items() if docs == 0 and len(state["segments"]) > 1]:
            del state["segments"][number]
        self._publish(state, version)
        self._merge()

    def _added(self, articles: DataFrame, state: dict) -> tuple[dict, int]:
        """The state with a segment of these articles, which is written, and the version it will be."""
        number = state["next"]
        for kind, rows in (("words", search.postings(articles)), ("grams", search.gram_postings(articles)), ("lengths", search.lengths(articles))):
            self._write(kind, number, rows)
        total = self.spark.read.schema(LENGTHS).parquet(f"{self.root}/lengths/segment={number}").agg(F.count("*").alias("docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("letters"), F.lit(0)).alias("letters")).first().asDict()
        totals = {c: state["totals"][c] + total[c] for c in total}
        return state | {"next": number + 1, "segments": state["segments"] | {str(number): total["docs"]}, "totals": totals}, state["version"] + 1

    def _write(self, kind: str, number: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{kind}/segment={number}")

    def _merge(self) -> None:
        """Merge segments of like size while there are FAN of them: sizes within one power of FAN."""
        while True:
            state = self.state()
            tiers: dict[int, list[int]] = {}
            for number, docs in state["segments"].items():
                tier = 0
                while docs >= FAN ** (tier + 1):
                    tier += 1
                tiers.setdefault(tier, []).append(int(number))
            full = [t for t in sorted(tiers) if len(tiers[t]) >= FAN]
            if not full:
                return
            self.merge(tiers[full[0]])

    def merge(self, segments: list[int]) -> None:
        """Some segments as one, without what is deleted in them."""
        state = self.state()
        number = state["next"]
        for kind, ddl in (("words", search.POSTINGS), ("grams", search.POSTINGS), ("lengths", LENGTHS)):
            rows = self._live(kind, ddl, state, segments).drop("segment")
            self._write(kind, number, rows if kind == "lengths" else rows.repartition("term", F.floor(F.col("id") / search.PIECE)).sortWithinPartitions("term", "id", "col"))
        left = {n: d for n, d in state["segments"].items() if int(n) not in segments}
        docs = sum(d for n, d in state["segments"].items() if int(n) in segments)
        version, deletes = state["version"] + 1, state["deletes"]
        if deletes is not None:
            rest = self._deletes(state).where(~F.col("segment").isin(segments))
            rest.write.mode("overwrite").parquet(f"{self.root}/deletes/v{version}")
            deletes = version
        self._publish(state | {"next": number + 1, "segments": left | {str(number): docs}, "deletes": deletes}, version)

    def _publish(self, state: dict, version: int, keep: int = 2) -> None:
        manifests = self.manifests
        manifests.publish(version, state | {"version": version})
        manifests.forget(keep)
        kept = [manifests.read(n) for n in manifests.numbers()]
        segments, deletes = {int(n) for m in kept for n in m["segments"]}, {m["deletes"] for m in kept}
        for kind in ("words", "grams", "lengths"):
            for name in manifests.names(kind):
                if int(name.removeprefix("segment=")) not in segments:
                    manifests.remove(f"{kind}/{name}")
        for name in manifests.names("deletes"):
            if int(name.removeprefix("v")) not in deletes:
                manifests.remove(f"deletes/{name}")

    def search(self, articles: DataFrame, query: str, category: str | None = None, limit: int = 20, fall_back: bool = False) -> DataFrame:
        """What ``search.search`` finds, from the index; of the articles only those that are shown are read."""
        if not query.strip():
            return search.nothing(articles)
        state = self.state()
        lists = [search.shown(self.search_words(query, category, limit, state), articles, search.phrases(query)), search.shown_letters(self.search_trigrams(query, category, limit, state), articles, search.parts(query))]
        if fall_back:
            lists.append(search.search_like(articles, query, category, limit))
        return search.first_of(lists, limit)

    def search_words(self, query: str, category: str | None = None, limit: int = 20, state: dict | None = None) -> DataFrame:
        """id and rank of the best articles that hold every part of the query as a phrase."""
        return self._best("words", search.phrases(query), "words", category, limit, state or self.state())

    def search_trigrams(self, query: str, category: str | None = None, limit: int = 20, state: dict | None = None) -> DataFrame:
        """id and rank of the best articles whose translations hold every part of three letters or more: the articles that
        have all trigrams of a part, in places that follow each other."""
        return self._best("grams", [search.grams_of(p) for p in search.parts(query)], "letters", category, limit, state or self.state())

    def _best(self, kind: str, phrases: list[list[str]], length: str, category: str | None, limit: int, state: dict) -> DataFrame:
        rows = self.postings(kind, sorted({w for p in phrases for w in p}), state) if phrases else self.spark.createDataFrame([], search.POSTINGS)
        totals = state["totals"]
        return search.search_postings(rows, self.lengths(state), phrases, category, limit, length, (totals["docs"], totals[length] / max(totals["docs"], 1)))

