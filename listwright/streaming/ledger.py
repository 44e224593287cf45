"""Sinks of foreachBatch that survive a retry: a ledger of the batches that were written.

A batch is written to a folder of its own, and counts from the moment that the ledger names the folder. A batch that is delivered again is
known by its number; what a broken-off try has left is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from listwright.sources.manifest import Conflict, Manifest


class Ledger:
    """A sink in a folder. Use one folder for each stream (checkpoint): batches are told apart by their numbers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.done, self.begun = Manifest(spark, f"{path}/ledger"), Manifest(spark, f"{path}/begun")

    def write(self, df: DataFrame, batch: int) -> bool:
        """Write a batch once, however often it comes: whether it was written now."""
        if batch in self.done.numbers():
            return False
        folder = f"batch={batch}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/data/{folder}")
        return self._commit(batch, folder)

    def _commit(self, batch: int, folder: str) -> bool:
        try:
            self.done.switch(batch, {"folder": folder})
        except Conflict:  # another try of the same batch was faster
            self.done.delete(f"{self.path}/data/{folder}")
            return False
        return True

    def at_most_once(self, each: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """each for batches that were not begun before: what fails is lost, and never done twice. For effects that no ledger can take back."""

        def guarded(df: DataFrame, batch: int) -> None:
            try:
                self.begun.switch(batch, {})
            except Conflict:
                return
            each(df, batch)

        return guarded

    def batches(self) -> dict[int, str]:
        """Folder of each batch that counts."""
        return {n: self.done.load(n)["folder"] for n in self.done.numbers()}

    def read(self, schema: StructType | str) -> DataFrame:
        """Rows of all batches that count."""
        folders = [f"{self.path}/data/{f}" for f in self.batches().values()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def vacuum(self) -> list[str]:
        """Delete folders that no batch counts, and return their names. Not while the stream runs."""
        live = set(self.batches().values())
        dead = [f for f in self.done.folders(f"{self.path}/data") if f not in live]
        for f in dead:
            self.done.delete(f"{self.path}/data/{f}")
        return dead
