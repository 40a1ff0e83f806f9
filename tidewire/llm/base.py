"""What the operators share: the shared folder, written tables, word hashes."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.plans.session import ship

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``, as a Java and as an RE2 class body.
SPACE = r"\x20\x09-\x0D"
#: Words whose hash a Python worker keeps before it starts afresh.
CACHE = 100_000
#: Folders written by this session that atexit removes.
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset a local session, as in tests, gets a new
    temporary one; on a cluster no folder of one machine would do."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewire-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tidewire/{uuid.uuid4().hex}/{label}"
    _written[path] = spark
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut and it outlives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidewire_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again."""
    for table in tables:
        remove(table.sparkSession, table._tidewire_path)


def remove(spark: SparkSession, path: str) -> None:
    _written.pop(path, None)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where.getParent(), True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            remove(spark, path)
        except Exception:  # the session has ended; the folder's owner cleans it
            return


#: Rows up to which a narrow table, once written and counted, is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 100_000


def joinable(table: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it is small enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


#: Bytes of a table's files for each partition that it is dealt to.
PARTITION_BYTES = 32_000_000


def spread(table: DataFrame, per_core: int = 2) -> int:
    """Partitions to deal a table to: as the session has them, more where its files are large."""
    leaves = table._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = 0
    if leaves.size() == 1 and leaves.head().getClass().getSimpleName() == "LogicalRelation":
        size = int(str(leaves.head().stats().sizeInBytes()))
    spark = table.sparkSession
    return max(spark.sparkContext.defaultParallelism * per_core, int(spark.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_BYTES)


#: What empties an operator's caches in this process, and the operator that ran here last.
_caches: dict[str, tuple[Callable[[], None], ...]] = {}
_last = ""


def caches(operator: str, *clear: Callable[[], None]) -> None:
    """Name an operator's caches. A Python worker serves many stages; it keeps only those of the present one."""
    _caches[operator] = clear


def enter(operator: str) -> None:
    """Called when a task of an operator starts: what other operators left in this process goes."""
    global _last
    if _last != operator:
        for name, clear in _caches.items():
            if name != operator:
                for c in clear:
                    c()
        _last = operator
        gc.collect()


class WordHashes(dict):
    """64-bit hash of each byte word; starts afresh once it holds CACHE words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")
