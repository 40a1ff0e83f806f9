"""Session helpers: the package on executors, tables in the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Folders of this session that atexit removes.
_made: dict[str, SparkSession] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewire_shipped", None) != sc.applicationId:
        root = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(prefix="tidewire-")) / "tidewire.zip"
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as out:
            for f in sorted(root.rglob("*.py")):
                out.write(f, os.path.join("tidewire", f.relative_to(root)))
        sc.addPyFile(str(to))
        sc._tidewire_shipped = sc.applicationId
    return spark


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset a local session gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidewire-")
    path = f"{root.rstrip('/')}/tidewire/{uuid.uuid4().hex}/{label}"
    _made[path] = spark
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: made once, read by all that follows, and kept when executors are lost."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for path, spark in _made.items():
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where.getParent(), True)
        except Exception:  # the session has ended; the folder's owner cleans it
            return
