"""A sink of text files that executors write: rows (file, text), in order, become the lines of files of any size.

A task writes the runs of one file that it holds as pieces of its own in a hidden folder beside the files; the commit, which runs
only when all tasks are done, puts pieces in the order of their tasks and moves each file into place whole. A task that is lost or
tried again leaves pieces that no message names, and a job that fails leaves the files as they were. The folder is one that
driver and executors share.
"""

from __future__ import annotations

import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tidewire.plans.session import ship


def local(root: str) -> Path:
    """The folder of a path or a file address."""
    parts = urlparse(root)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"files are written to a mounted folder, not to {parts.scheme}")
    return Path(unquote(parts.path) if parts.scheme else root)


@dataclass
class Pieces(WriterCommitMessage):
    """Of one task: (file, piece) in order."""

    partition: int
    pieces: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root
        self.folder = str(local(root) / f".pieces-{uuid.uuid4().hex}")
        Path(self.folder).mkdir(parents=True)

    def write(self, iterator: Iterator[Row]) -> Pieces:
        own = Path(self.folder) / uuid.uuid4().hex
        own.mkdir()  # fails where the job has been given up
        pieces = []
        for k, (file, rows) in enumerate(groupby(iterator, key=lambda r: r["file"])):
            with (own / str(k)).open("w", encoding="utf-8", newline="") as out:
                for row in rows:
                    out.write(row["text"] + "\n")
            pieces.append((file, str(own / str(k))))
        return Pieces(TaskContext.get().partitionId(), pieces)

    def commit(self, messages: list[Pieces | None]) -> None:
        parts: dict[str, list[str]] = {}
        for message in sorted(filter(None, messages), key=lambda m: m.partition):
            for file, piece in message.pieces:
                parts.setdefault(file, []).append(piece)
        for first, *more in parts.values():
            with Path(first).open("ab") as out:
                for piece in more:
                    with Path(piece).open("rb") as of:
                        shutil.copyfileobj(of, out)
        for file, (first, *_) in parts.items():
            to = local(self.root) / file
            to.parent.mkdir(parents=True, exist_ok=True)
            Path(first).replace(to)
        self._clear()

    def abort(self, messages: list[Pieces | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        for _ in range(10):  # a task that still runs may make a piece meanwhile
            shutil.rmtree(self.folder, ignore_errors=True)
            if not Path(self.folder).exists():
                return
            time.sleep(0.2)


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidewire_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if schema.names != ["file", "text"]:
            raise ValueError(f"rows of (file, text) are written, not of {schema.names}")
        return _Writer(self.options["path"])


def write(lines: DataFrame, root: str | Path) -> None:
    """Write ``lines`` (file, text), which lie in order: those of a file in successive partitions. Files that are there are replaced."""
    spark = ship(lines.sparkSession)
    spark.dataSource.register(TextFiles)
    local(str(root)).mkdir(parents=True, exist_ok=True)
    lines.select("file", "text").write.format(TextFiles.name()).mode("append").option("path", str(root)).save()
