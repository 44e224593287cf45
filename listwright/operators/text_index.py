"""An inverted index of texts by whole words, kept in segments, and boolean queries on its postings.

A posting is a word, a block of BLOCK consecutive ids, and the sorted ids of the block that have the word; so a frequent word is many rows, and a query
is answered block by block by set operations on arrays, on all executors. Words are dealt to buckets, and files are sorted by word: a query
opens the buckets of its words only. Rows are added as a segment beside the others; merge() makes one of all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.operators.filters import FullText
from listwright.sources.manifest import Manifest

BLOCK, BUCKETS = 1 << 16, 64
POSTINGS = "word string, block long, ids array<long>"
#: The word under which the ids are kept that a NOT is taken from.
ALL = ""


class Postings(FullText):
    """A boolean query as set operations on arrays of ids by word."""

    def either(self, a: Column, b: Column) -> Column:
        return F.array_union(a, b)

    def both(self, a: Column, b: Column) -> Column:
        return F.array_intersect(a, b)

    def negated(self, a: Column, ids: Column) -> Column:
        return F.array_except(ids[ALL], a)

    def word(self, word: str, ids: Column) -> Column:
        return F.coalesce(ids[word], F.array().cast("array<bigint>"))


def _bucket(word: Column | str) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """An index in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.manifest = spark, path, Manifest(spark, f"{path}/manifest")

    def add(self, rows: DataFrame, columns: tuple[str, ...] = ("title", "description"), id_col: str = "id", in_not: Column | None = None) -> None:
        """Index rows, each id once over all calls, as a segment. in_not: rows that a NOT may find (those with pictures, say); all by default."""
        number, state = self.manifest.current()
        words = F.array_distinct(F.split(F.lower(F.concat_ws(" ", *columns)), r"[^\p{L}\p{N}_]+"))
        mark = F.array(F.lit(ALL)) if in_not is None else F.when(F.coalesce(in_not, F.lit(False)), F.array(F.lit(ALL))).otherwise(F.array().cast("array<string>"))
        each = rows.select(F.col(id_col).cast("long").alias("id"), F.explode(F.concat(mark, F.filter(words, lambda w: w != ALL))).alias("word")).where("id is not null")
        postings = each.groupBy("word", F.floor(F.col("id") / BLOCK).alias("block")).agg(F.array_sort(F.collect_set("id")).alias("ids"))
        self.manifest.switch(number + 1, {"segments": [*(state or {"segments": []})["segments"], self._write(postings)]})

    def _write(self, postings: DataFrame) -> str:
        name = uuid.uuid4().hex
        postings.withColumn("bucket", _bucket("word")).hint("rebalance", "bucket").sortWithinPartitions("bucket", "word").write.partitionBy("bucket").parquet(f"{self.path}/segment={name}")
        return name

    def postings(self, words: list[str] | None = None) -> DataFrame:
        """Postings of all segments: all, or those of some words, for which only their buckets are opened."""
        _, state = self.manifest.current()
        names = state["segments"] if state else []
        paths = [f"{self.path}/segment={n}" for n in names]
        if words is not None:
            wanted = {r[0] for r in self.spark.createDataFrame([(w,) for w in words], "w string").select(_bucket("w")).distinct().collect()}
            paths = [f"{p}/{f}" for p in paths for f in self.manifest.folders(p) if f.startswith("bucket=") and int(f[7:]) in wanted]
        if not paths:
            return self.spark.createDataFrame([], POSTINGS)
        found = self.spark.read.schema(POSTINGS).option("recursiveFileLookup", "true").parquet(*paths)
        return found if words is None else found.where(F.col("word").isin(words))

    def search(self, query: str) -> DataFrame:
        """id of the rows that match a boolean query (OR, AND, NOT, parentheses), each once; an index and a scan by full_text() find the same."""
        words = sorted({t.lower() for t in FullText(query).tokens if t.upper() not in ("OR", "AND", "NOT", "(", ")")} | {ALL})
        each = {w: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("word") == w, F.col("ids"))))) for w in words}
        blocks = self.postings(words).groupBy("block").agg(*(c.alias(f"w{k}") for k, c in enumerate(each.values())))
        return blocks.select(F.explode(Postings(query).column({w: F.col(f"w{k}") for k, w in enumerate(words)})).alias("id"))

    def merge(self) -> None:
        """One segment of all; those before stay until vacuum()."""
        number, state = self.manifest.current()
        one = self.postings().groupBy("word", "block").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
        self.manifest.switch(number + 1, {"segments": [self._write(one)]} | {k: v for k, v in state.items() if k != "segments"})

    def vacuum(self) -> None:
        """Delete segments that the index no longer has. Not while others read or write."""
        live = set(self.manifest.current()[1]["segments"])
        for name in self.manifest.folders(self.path):
            if name.startswith("segment=") and name[8:] not in live:
                self.manifest.delete(f"{self.path}/{name}")
