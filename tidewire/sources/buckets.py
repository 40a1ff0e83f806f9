"""A table in buckets of its key: a change reads and writes the buckets that it meets, and no other.

A bucket is a folder of Parquet files, ``data/version=N/bucket=B``; version N is the commit that wrote it. The
manifest of a commit names the version of every bucket, the largest id, and the last batch of every stream that was
taken in. Files are never changed: a commit writes new folders for its buckets, then publishes its manifest; one that fails,
or whose executors are lost, leaves folders that no manifest names, and the next commit of its number starts afresh.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.plans.session import written
from tidewire.sources.manifest import Manifests
from tidewire.sources.schema import ARTICLES, conformed, empty

#: Buckets of a new table: as many paths as Spark lists without a job. A table of many gigabytes is given more, so that a bucket
#: stays a few of them.
BUCKETS = 32
#: Changed keys that are broadcast at a time to the buckets that hold them.
KEYS = 500_000


def bucket_of(key: str | Column, buckets: int) -> Column:
    """The bucket of a key: the first 32 bits of its MD5 sum, divided with a rest. A null key is an empty one."""
    key = F.col(key) if isinstance(key, str) else key
    return (F.conv(F.left(F.md5(F.coalesce(key, F.lit(""))), F.lit(8)), 16, 10).cast("long") % buckets).cast("int")


class BucketTable:
    """Rows of ``ddl`` under ``root`` by the hash of ``key``; ``id`` names a row."""

    def __init__(self, spark: SparkSession, root: str, ddl: str = ARTICLES, key: str = "normalized_url", buckets: int = BUCKETS):
        self.spark, self.root, self.ddl, self.key = spark, root.rstrip("/"), ddl, key
        self.manifests = Manifests(spark, root)
        self.none = {"version": 0, "buckets": buckets, "at": {}, "max_id": 0, "batches": {}}

    def state(self) -> dict:
        """The newest manifest: version, buckets, at (bucket to version), max_id and batches."""
        return self.manifests.read() or self.none

    def bucket(self, key: str | Column | None = None, state: dict | None = None) -> Column:
        return bucket_of(key or self.key, (state or self.state())["buckets"])

    def versions(self) -> list[int]:
        return self.manifests.numbers()

    def read(self, buckets: list[int] | None = None, state: dict | None = None) -> DataFrame:
        """Rows of some buckets, or of all, with ``bucket``; values that a row has not are the table's defaults."""
        return conformed(self.stored(buckets, state), self.ddl, F.col("bucket"))

    def stored(self, buckets: list[int] | None = None, state: dict | None = None) -> DataFrame:
        """The same rows as their files have them."""
        state = state or self.state()
        named = {int(b): v for b, v in state["at"].items() if buckets is None or int(b) in set(buckets)}
        if not named:
            return empty(self.spark, self.ddl).withColumn("bucket", F.lit(None).cast("int"))
        paths = [f"{self.root}/data/version={v}/bucket={b}" for b, v in sorted(named.items())]
        return self.spark.read.schema(f"{self.ddl}, version INT, bucket INT").option("basePath", f"{self.root}/data").parquet(*paths).drop("version")

    def batch_done(self, stream: str, number: int) -> bool:
        """Whether a batch of a stream was taken in; batches are numbered upwards, and only the last may come again."""
        return self.state()["batches"].get(stream, -1) >= number

    def write(self, rows: DataFrame, keep: int = 2) -> None:
        """All rows anew."""
        state = self.state()
        commit = Commit(self, state)
        commit.add(rows)
        commit.publish({}, keep)

    def replace(self, rows: DataFrame, keep: int = 2) -> None:
        """Rows in place of those of the same id and key; a row of an id that isn't stored is added."""
        state = self.state()
        new = written(conformed(rows, self.ddl).withColumn("bucket", self.bucket(state=state)), "changed")
        if new.isEmpty():
            return
        commit = Commit(self, state)
        commit.add(new, True)
        commit.keep(new.select("bucket", "id"), "id")
        commit.publish(state["at"], keep)


class Commit:
    """A version in the making: rows that are added, rows that stay beside them, then the manifest."""

    def __init__(self, table: BucketTable, state: dict):
        self.table, self.state, self.version = table, state, state["version"] + 1
        self.folder = f"data/version={self.version}"
        table.manifests.remove(self.folder)  # of a commit that failed
        self.max_id = state["max_id"]

    def _append(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("bucket").parquet(f"{self.table.root}/{self.folder}")

    def add(self, rows: DataFrame, whole: bool = False) -> None:
        """New rows, dealt by bucket; a bucket of many bytes is written by several tasks. ``whole`` ones have all values
        already, so nothing is filled in."""
        seen = Observation()
        rows = rows.select(*T.StructType.fromDDL(self.table.ddl).names) if whole else conformed(rows, self.table.ddl)
        rows = rows.withColumn("bucket", self.table.bucket(state=self.state)).observe(seen, F.max("id").alias("max_id"))
        self._append(rows.hint("rebalance", F.col("bucket")))
        self.max_id = max(self.max_id, seen.get["max_id"] or 0)

    def keep(self, gone: DataFrame, by: str) -> None:
        """Stored rows of the buckets of ``gone`` (bucket and ``by``, written) that it doesn't name.

        They aren't shuffled, however many change: a group of buckets is read at a time, of at most KEYS changed rows, which
        are broadcast to its files. Only a bucket that has more by itself is joined by shuffling.
        """
        counts = {r["bucket"]: r["count"] for r in gone.groupBy("bucket").count().collect()}  # at most one row for each bucket
        groups: list[list[int]] = []
        size = KEYS
        for bucket, n in sorted(counts.items()):
            if str(bucket) not in self.state["at"]:
                continue
            if size + n > KEYS:
                groups.append([])
                size = 0
            groups[-1].append(bucket)
            size += n
        for group in groups:
            keys = gone.where(F.col("bucket").isin(group)).select(by)
            few = F.broadcast(keys) if sum(counts[b] for b in group) <= KEYS else keys
            self._append(self.table.stored(group, self.state).join(few, by, "left_anti"))

    def publish(self, at: dict, keep: int = 2, batch: tuple[str, int] | None = None) -> None:
        """Make the version known: its buckets, and the others as ``at`` has them. What no kept manifest names goes."""
        manifests = self.table.manifests
        own = {n.split("=")[1]: self.version for n in manifests.names(self.folder) if n.startswith("bucket=")}
        batches = self.state["batches"] | ({batch[0]: batch[1]} if batch else {})
        manifests.publish(self.version, {"version": self.version, "buckets": self.state["buckets"], "at": at | own, "max_id": self.max_id, "batches": batches})
        manifests.forget(keep)
        named = {(str(v), b) for n in manifests.numbers() for b, v in manifests.read(n)["at"].items()}
        for folder in manifests.names("data"):
            v = folder.removeprefix("version=")
            for inner in manifests.names(f"data/{folder}"):
                if inner.startswith("bucket=") and (v, inner.removeprefix("bucket=")) not in named:
                    manifests.remove(f"data/{folder}/{inner}")
            if not any(x == v for x, _ in named):
                manifests.remove(f"data/{folder}")
