"""Stores of rows by key that are written in place: rows lie in hash buckets of their key, and a write touches the buckets of its keys alone.

A bucket is one or several folders of Parquet files; which ones count is said by a manifest that is switched when all files of a write are there. A
write that breaks off leaves the store as it was; its files are found by vacuum(). Two writers of different buckets both go through, of
one bucket the later one has to begin anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from listwright.sources.manifest import Conflict, Manifest

#: Columns of a store's files beside its own: the bucket, and what the write that made the file did to the row (null: nothing).
BUCKET, CHANGE = "bucket_", "change_"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def last_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the last by `order`, of equal ones the greatest by the other columns, so that it does not depend on how rows lie."""
    rest = [c for c in rows.columns if c not in keys]
    first = [c for c in order if c in rest]
    picked = rows.groupBy(*keys).agg(F.max(F.struct(*first, *(c for c in rest if c not in first))).alias("x_"))
    return picked.select(*(c if c in keys else F.col(f"x_.{c}").alias(c) for c in rows.columns))


class KeyedStore:
    """A table with unique keys in a folder. Columns must have an order (no maps)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.manifest = spark, path, Manifest(spark, f"{path}/manifest")
        _, state = self.manifest.current()
        if state is None:
            raise FileNotFoundError(f"no store in {path}")
        self.keys, self.buckets, self.schema = state["keys"], state["buckets"], StructType.fromJson(json.loads(state["schema"]))

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str], buckets: int = 64, order: Iterable[str] = ()) -> KeyedStore:
        """A new store; of several rows with one key the last by `order` stays, rows with a null key are left out. Buckets should hold some hundred megabytes."""
        spark = rows.sparkSession
        known = rows.where(_whole(keys))
        good = last_of_each(known, keys, list(order)) if len(rows.columns) > len(keys) else known.distinct()
        version = _write(good.withColumn(CHANGE, F.lit("inserted")), path, keys, buckets)
        parts = {b: [version] for b in _buckets_in(spark, path, version)}
        Manifest(spark, f"{path}/manifest").switch(0, {"keys": keys, "buckets": buckets, "schema": _nullable(rows.schema), "parts": parts})
        return cls(spark, path)

    def read(self, buckets: Iterable[int] | None = None, number: int | None = None, change: bool = False) -> DataFrame:
        """The rows, or those of some buckets, as of now or of a version. change: with BUCKET and CHANGE, and rows that the last write took away."""
        state = self.manifest.current()[1] if number is None else self.manifest.load(number)
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.path}/data/version={v}/{BUCKET}={b}" for b, versions in state["parts"].items() if wanted is None or int(b) in wanted for v in versions]
        return self._rows(paths, change)

    def _rows(self, paths: list[str], change: bool = False) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField(CHANGE, StringType()), StructField(BUCKET, IntegerType())])
        if not paths:
            rows = self.spark.createDataFrame([], schema)
        else:
            rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths).select(*schema.names)
        return rows if change else rows.where(f"{CHANGE} is null or {CHANGE} not in ('deleted', 'absent')").select(*self.schema.names)

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of some keys: numbers, at most as many as the store has buckets."""
        return [r[0] for r in keys.where(_whole(self.keys)).select(bucket_of(self.keys, self.buckets)).distinct().collect()]

    def merge(self, new: DataFrame, keep: str = "last", order: Iterable[str] = (), combine: dict[str, Callable[[Column, Column], Column]] | None = None, delete: str | None = None) -> DataFrame:
        """Write rows by key and return what became of each key: the keys and `result`, one of inserted, updated, unchanged, deleted, absent.

        New rows may lack columns of the store, which then stay (or are null in added rows); of several with one key the last by `order` counts. Rows
        with a null in the key are refused: see refused(). keep: "last", known keys take the new columns; "first", they stay. combine: for
        a column, its value from (stored, new). delete: a boolean column of the new rows that takes keys away, or does nothing (absent).
        """
        columns = [c for c in self.schema.names if c not in self.keys]
        given = [c for c in columns if c in new.columns]
        extra = [delete] if delete else []
        good = new.where(_whole(self.keys)).select(*self.keys, *given, *extra, *(c for c in order if c not in (*self.keys, *given, *extra)))
        good = last_of_each(good, self.keys, list(order)) if len(good.columns) > len(self.keys) else good.distinct()
        good = good.select(*self.keys, *(F.col(c).alias(f"new_{c}") for c in given), *(F.coalesce(delete, F.lit(False)).alias("gone_") for _ in extra), F.lit(True).alias("new_"))
        touched = self.touched(new)
        if not touched:
            return self.spark.createDataFrame([], StructType([*(self.schema[k] for k in self.keys), StructField("result", StringType())]))
        base, state = self.manifest.current()
        stored = self._rows([f"{self.path}/data/version={v}/{BUCKET}={b}" for b in touched for v in state["parts"].get(str(b), ())]).withColumn("old_", F.lit(True))
        both = stored.join(good, self.keys, "full_outer")
        known, came = F.col("old_").isNotNull(), F.col("new_").isNotNull()
        gone = F.coalesce(F.col("gone_"), F.lit(False)) if delete else F.lit(False)
        value = {}
        for c in given:
            taken = (combine or {}).get(c, lambda old, now: now if keep == "last" else old)(F.col(c), F.col(f"new_{c}"))
            value[c] = F.when(known & came & ~gone, taken).when(came & ~known, F.col(f"new_{c}")).otherwise(F.col(c))
        same = F.lit(True)
        for c in given:
            same = same & F.col(c).eqNullSafe(value[c])
        result = F.when(~came, F.lit(None)).when(gone, F.when(known, "deleted").otherwise("absent")).when(~known, "inserted").when(same, "unchanged").otherwise("updated")
        rows = both.select(*self.keys, *(value.get(c, F.col(c)).cast(self.schema[c].dataType).alias(c) for c in columns), result.alias(CHANGE))
        version = _write(rows, self.path, self.keys, self.buckets)
        self._switch(base, state, version, touched)
        made = self._rows([f"{self.path}/data/version={version}/{BUCKET}={b}" for b in _buckets_in(self.spark, self.path, version)], True)
        return made.where(f"{CHANGE} is not null").select(*self.keys, F.col(CHANGE).alias("result"))

    def refused(self, new: DataFrame) -> DataFrame:
        """Rows that merge() does not write: those with a null in the key."""
        return new.where(~_whole(self.keys))

    def append(self, new: DataFrame) -> None:
        """Add files of rows whose keys the store does not have; nothing that is there is read or written anew."""
        base, state = self.manifest.current()
        version = _write(new.select(*self.schema.names).withColumn(CHANGE, F.lit("inserted")), self.path, self.keys, self.buckets)
        self._switch(base, state, version, [int(b) for b in _buckets_in(self.spark, self.path, version)], add=True)

    def _switch(self, base: int, state: dict, version: str, touched: list[int], add: bool = False) -> None:
        """Make a version current; if others have written meanwhile, on top of theirs, unless they touched the same buckets."""
        own = set(_buckets_in(self.spark, self.path, version))
        while True:
            parts = dict(state["parts"])
            for b in map(str, touched):
                before = parts.get(b, []) if add else []
                parts[b] = [*before, version] if b in own else before
            try:
                return self.manifest.switch(base + 1, state | {"parts": parts})
            except Conflict:
                now, other = self.manifest.current()
                if not add and any(other["parts"].get(str(b)) != state["parts"].get(str(b)) for b in touched):
                    raise
                base, state = now, other

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete versions that none of the last `keep` manifests names, what broke off included, and return their names. Not while others write."""
        numbers = self.manifest.numbers()
        live = {v for n in numbers[-keep:] for versions in self.manifest.load(n)["parts"].values() for v in versions}
        dead = [name for name in self.manifest.folders(f"{self.path}/data") if name.removeprefix("version=") not in live]
        for name in dead:
            self.manifest.delete(f"{self.path}/data/{name}")
        for n in numbers[:-keep]:
            self.manifest.delete(f"{self.path}/manifest/{n:08d}.json")
        return dead


def _nullable(schema: StructType) -> str:
    """The schema as files have it: everything may be null."""
    return schema.json().replace('"nullable":false', '"nullable":true').replace('"containsNull":false', '"containsNull":true')


def _whole(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def _write(rows: DataFrame, path: str, keys: list[str], buckets: int) -> str:
    """Rows as a version's folder, a folder for each bucket; large buckets are written by several tasks."""
    version = uuid.uuid4().hex
    rows.withColumn(BUCKET, bucket_of(keys, buckets)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/data/version={version}")
    return version


def _buckets_in(spark: SparkSession, path: str, version: str) -> list[str]:
    return [n.removeprefix(f"{BUCKET}=") for n in Manifest(spark, f"{path}/manifest").folders(f"{path}/data/version={version}") if n.startswith(BUCKET)]
