"""Sets of keys that were seen, too many to read for each batch: Bloom filters by bucket say which keys are surely new, and the others are looked up in the
buckets of the store where they may be.

A filter is cut into segments of WORDS longs; all bits of a key are in one segment, so that a test is a join by segment and
bit operations on it, all native. Filters and keys become current by one manifest each, the filters first: a run that breaks off between them leaves bits without keys, which costs a look-up
and changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.operators.keyed_store import KeyedStore, bucket_of
from listwright.session import drop_shared, shared_table

#: Longs of a segment, and bits that a key sets in it: about one key of a hundred is looked up in vain at ten bits a key.
WORDS, BITS = 1024, 7


def _segment(key: str, segments: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("segment")), F.lit(segments)).cast("int")


def _places(key: str) -> Column:
    """The bits of a key in its segment: two hashes, added up again and again."""
    one, two = F.xxhash64(key, F.lit("one")), F.xxhash64(key, F.lit("two"))
    return F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.pmod(F.pmod(one, F.lit(WORDS * 64)) + i * F.pmod(two, F.lit(WORDS * 64)) + i * i, F.lit(WORDS * 64)).cast("int"))


class SeenSet:
    """Keys of one column in a folder; buckets * segments * 6500 keys at most for good filters, more only make them less selective."""

    def __init__(self, spark: SparkSession, path: str, segments: int = 16):
        self.spark, self.segments = spark, segments
        self.keys, self.filters = KeyedStore(spark, f"{path}/keys"), KeyedStore(spark, f"{path}/filters")
        self.key = self.keys.keys[0]

    @classmethod
    def create(cls, keys: DataFrame, path: str, buckets: int = 64, segments: int = 16) -> SeenSet:
        """A set of the distinct values of a frame's only column; nulls are left out."""
        (key,) = keys.columns
        KeyedStore.create(keys, f"{path}/keys", [key], buckets)
        KeyedStore.create(_filters(keys.where(F.col(key).isNotNull()), key, buckets, segments), f"{path}/filters", ["bucket"], buckets)
        return cls(keys.sparkSession, path, segments)

    def may_be_in(self, rows: DataFrame) -> DataFrame:
        """rows with `maybe`: false for keys that are surely not in the set, and for null."""
        at = rows.withColumns({"b_": bucket_of([self.key], self.keys.buckets), "s_": _segment(self.key, self.segments)})
        words = self.filters.read().select(F.col("bucket").alias("b_"), F.posexplode("segments").alias("s_", "words_")).where(F.size("words_") > 0)
        set_ = F.forall(_places(self.key), lambda p: F.getbit(F.get("words_", F.shiftright(p, 6)), p.bitwiseAND(F.lit(63))) == 1)
        maybe = F.col(self.key).isNotNull() & F.col("words_").isNotNull() & set_
        return at.join(words, ["b_", "s_"], "left").withColumn("maybe", F.coalesce(maybe, F.lit(False))).drop("b_", "s_", "words_")

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The rows whose key is not in the set, rows with a null key among them. Of the store only buckets are read in which a key may be."""
        tested = self.may_be_in(rows)
        near = tested.where("maybe")
        buckets = self.keys.touched(near)
        return tested.where("not maybe").select(*rows.columns).unionByName(near.join(self.keys.read(buckets), self.key, "left_anti").select(*rows.columns))

    def share_read(self, rows: DataFrame) -> float:
        """Share of the store's bytes that unseen() reads for these rows."""
        parts, wanted = self.keys.manifest.current()[1]["parts"], set(map(str, self.keys.touched(self.may_be_in(rows).where("maybe"))))
        size = {b: sum(self.keys.manifest.size(f"{self.keys.path}/data/version={v}/bucket_={b}") for v in versions) for b, versions in parts.items()}
        return sum(n for b, n in size.items() if b in wanted) / max(1, sum(size.values()))

    def add(self, keys: DataFrame) -> None:
        """Add keys; what is in the set already is left out. Key files are added; of the filters the touched buckets are written anew."""
        new = self.unseen(keys.select(self.key).where(F.col(self.key).isNotNull()).distinct())
        both = lambda old, now: F.zip_with(old, now, lambda a, b: F.when(F.size(a) == 0, b).when(F.size(b) == 0, a).otherwise(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))))
        new = shared_table(new, "new-keys")  # the filters change while they are read
        self.filters.merge(_filters(new, self.key, self.keys.buckets, self.segments), combine={"segments": both})
        self.keys.append(new)
        drop_shared(new)


def _filters(keys: DataFrame, key: str, buckets: int, segments: int) -> DataFrame:
    """bucket, segments: for each segment its words, none where no key is. Bits are summed up by word before the words of a segment meet."""
    bits = keys.select(bucket_of([key], buckets).alias("bucket"), _segment(key, segments).alias("s"), F.explode(_places(key)).alias("p"))
    words = bits.groupBy("bucket", "s", F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)))).alias("x"))
    zero = words.select("bucket", "s").distinct().select("bucket", "s", F.explode(F.sequence(F.lit(0), F.lit(WORDS - 1))).alias("w"), F.lit(0).cast("long").alias("x"))
    whole = words.unionByName(zero).groupBy("bucket", "s", "w").agg(F.bit_or("x").alias("x")).groupBy("bucket", "s").agg(F.array_sort(F.collect_list(F.struct("w", "x")))["x"].alias("words"))
    none = whole.select("bucket").distinct().select("bucket", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("s"), F.array().cast("array<bigint>").alias("words"))
    each = whole.unionByName(none).groupBy("bucket", "s").agg(F.flatten(F.collect_list("words")).alias("words"))
    return each.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("s", "words")))["words"].alias("segments"))
