"""Tables as versioned snapshots in a folder: a new version is written whole, then the pointer moves.

Articles lie in buckets of their URLs (``buckets.py``), and their search index in segments beside them (``index.py``):
a change of either writes what it changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.operators.search import search
from tidewire.operators.titles import TITLES, kept_up
from tidewire.plans.session import ship, written
from tidewire.sources.buckets import BUCKETS, BucketTable
from tidewire.sources.index import Index
from tidewire.sources.schema import ARTICLES, RESULTS, RUNS, SOURCES, conformed, empty

TABLES = {"articles": ARTICLES, "sources": SOURCES, "crawl_runs": RUNS, "crawl_results": RESULTS}


class Store:
    """The library's tables under ``root``, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = ship(spark), root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.articles = BucketTable(spark, f"{self.root}/articles", ARTICLES, "normalized_url", buckets)
        self.titles = BucketTable(spark, f"{self.root}/titles", TITLES, "t", buckets)
        self.segments = Index(spark, f"{self.root}/index")

    def _snapshots(self, table: str) -> list[int]:
        at = self._path(f"{self.root}/{table}")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def versions(self, table: str) -> list[int]:
        return self.articles.versions() if table == "articles" else self._snapshots(table)

    def read(self, table: str) -> DataFrame:
        """The newest version, with defaults for columns that it lacks; empty before the first. Articles that an
        older release of this library stored as a snapshot are read from there until they are first written.
        ``postings`` and ``lengths`` are those of the words in the index."""
        if table in ("postings", "lengths"):
            return self.segments.words() if table == "postings" else self.segments.lengths()
        if table == "articles" and self.articles.versions():
            return self.articles.read().drop("bucket")
        found = self._snapshots(table)
        if not found:
            return empty(self.spark, TABLES[table])
        return conformed(self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{table}/v{found[-1]}"), TABLES[table])

    def write(self, table: str, rows: DataFrame, keep: int = 2) -> None:
        """A new version; it is seen once it is whole, since its folder then gets its name. Older ones go."""
        if table == "articles":
            return self.articles.write(rows, keep)
        found = self._snapshots(table)
        new = (found[-1] if found else 0) + 1
        at = f"{self.root}/{table}"
        conformed(rows, TABLES[table]).write.mode("overwrite").parquet(f"{at}/.next")
        if not self._fs.rename(self._path(f"{at}/.next"), self._path(f"{at}/v{new}")):
            raise OSError(f"version {new} of {table} can't be named")
        for old in found[: 1 - keep or None] if keep > 1 else found:
            self._fs.delete(self._path(f"{at}/v{old}"), True)

    def bucketed(self) -> BucketTable:
        """The articles in buckets; a snapshot of an older release is dealt into them first."""
        if not self.articles.versions() and self._snapshots("articles"):
            self.articles.write(self.read("articles"))
        return self.articles

    def index(self, changed: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Build the index of the stored articles, or keep it up for changed articles and removed ones (id)."""
        if changed is None or not self.segments.exists():
            self.segments.rebuild(self.read("articles"))
        else:
            self.segments.change(changed, removed)

    def indexed(self, urls: DataFrame) -> None:
        """Keep the index up for the articles of some URLs (normalized_url), new and changed ones; build it where there is none."""
        table = self.bucketed()
        if not self.segments.exists():
            return self.index()
        state, urls = table.state(), written(urls, "changed")
        met = [r["bucket"] for r in urls.select(table.bucket("normalized_url", state).alias("bucket")).distinct().collect()]  # at most one row for each bucket
        if met:
            self.segments.change(table.read(met, state).join(urls, "normalized_url", "left_semi"))

    def marked(self, urls: DataFrame, before: dict) -> None:
        """Keep the marks of duplicates up for the articles of some URLs, which a change has met; ``before`` is the state
        of the articles before it."""
        kept_up(self.bucketed(), self.titles, urls, before)

    def search(self, query: str, category: str | None = None, limit: int = 20, fall_back: bool = False) -> DataFrame:
        """Search the articles, by the index where there is one."""
        articles = self.read("articles")
        return self.segments.search(articles, query, category, limit, fall_back) if self.segments.exists() else search(articles, query, category, limit, fall_back)

    def append(self, table: str, rows: DataFrame) -> None:
        self.write(table, self.read(table).unionByName(conformed(rows, TABLES[table])))
