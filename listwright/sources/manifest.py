"""What is current of a folder of tables: numbered JSON files, of which the highest counts. A version is there as a whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer has made the next version meanwhile."""


class Manifest:
    """Versions of a small dictionary in a folder that every node can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._path("")):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path("")))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def load(self, number: int) -> dict:
        name = self._path(f"{number:08d}.json")
        stream = self._fs.open(name)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode())
        finally:
            stream.close()

    def current(self) -> tuple[int, dict | None]:
        """The highest number and what it says; (-1, None) for a new folder."""
        n = self.numbers()
        return (n[-1], self.load(n[-1])) if n else (-1, None)

    def switch(self, number: int, state: dict) -> None:
        """Make a version, complete before it has its name; Conflict if there is one of this number."""
        target, temporary = self._path(f"{number:08d}.json"), self._path(f".{uuid.uuid4().hex}.tmp")
        out = self._fs.create(temporary, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        if self._fs.exists(target) or not self._fs.rename(temporary, target):
            self._fs.delete(temporary, False)
            raise Conflict(f"{self.path}: version {number}")

    def folders(self, path: str) -> Iterator[str]:
        """Names of the folders in a folder."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if self._fs.exists(p):
            yield from (s.getPath().getName() for s in self._fs.listStatus(p) if s.isDirectory())

    def delete(self, path: str) -> None:
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def size(self, path: str) -> int:
        """Bytes of the files below a folder."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return self._fs.getContentSummary(p).getLength() if self._fs.exists(p) else 0
