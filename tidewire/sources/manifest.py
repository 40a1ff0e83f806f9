"""Numbered manifests: small JSON files on any file system that Spark reaches. The newest one says what a table is."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifests:
    """Manifests of one table under ``root``. One is published by a rename, so readers see it whole or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def numbers(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.names("manifests") if n.startswith("m") and n.endswith(".json"))

    def read(self, number: int | None = None) -> dict | None:
        """A manifest, the newest by default; None before the first."""
        if number is None:
            found = self.numbers()
            if not found:
                return None
            number = found[-1]
        stream = self._fs.open(self._path(f"{self.root}/manifests/m{number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, number: int, content: dict) -> None:
        """The manifest of this number. A writer that another one was faster than gets an error, and has changed nothing."""
        own, at = (self._path(f"{self.root}/manifests/{n}") for n in (f".{uuid.uuid4().hex}", f"m{number}.json"))
        stream = self._fs.create(own)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        if self._fs.exists(at) or not self._fs.rename(own, at):
            self._fs.delete(own, False)
            raise OSError(f"manifest {number} of {self.root} is there already")

    def forget(self, keep: int) -> None:
        """Older manifests than the newest ``keep`` go."""
        for number in self.numbers()[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/m{number}.json"), False)

    def remove(self, folder: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{folder}"), True)
