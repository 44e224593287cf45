"""Sharding by a hierarchical weighted hash tree.

Method: the tree has regions, racks and shards, each shard with a weight; an inner node weighs what its shards weigh. A
row descends from the root: at each node every child draws -ln(u) / weight, where u is a hash of the row's key and the
child's name, and the least draw wins. A draw depends on its child's weight alone, so a changed weight moves rows only
into or out of that child's subtree, level by level. A new shard joins as a region of its own: rows then move only into it.

Slots are gapless in each shard without gathering a shard in one task: rows are dealt into many buckets by hash, rows
with equal values are counted before the shuffle, each bucket is numbered by itself, and the buckets' sizes are summed
up. Only keys, sizes and checksums are shuffled, never texts.

Edge cases: a null text has size 1 and the checksum of no bytes; a null key is drawn like any other key ("null"). Equal
rows get different slots. Very long texts are only measured. Other columns are not read; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.session import shared_table

#: Rows that a bucket of a shard has on average at most; the number of buckets grows with the table.
BUCKET_ROWS = 20_000
#: Equal rows that one row stands for until its slots are written out.
STEP = 10_000


@dataclass(frozen=True)
class Node:
    """A node of the tree: its name, and its weight (a shard) or its children."""

    name: str
    weight: float = 0.0
    shard: int = -1
    children: tuple[Node, ...] = ()

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight


def tree(weights: list[float], per_rack: int = 4, racks: int = 2) -> Node:
    """A tree over shards 0 to n-1: racks of per_rack shards, regions of so many racks."""
    shards = [Node(f"shard-{i}", w, i) for i, w in enumerate(weights)]
    rack = [Node(f"rack-{i // per_rack}", children=tuple(shards[i : i + per_rack])) for i in range(0, len(shards), per_rack)]
    return Node("root", children=tuple(Node(f"region-{i // racks}", children=tuple(rack[i : i + racks])) for i in range(0, len(rack), racks)))


def grown(root: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own."""
    n = 1 + max(_shards(root))
    return Node("root", children=(*root.children, Node(f"region-of-{n}", children=(Node(f"rack-of-{n}", children=(Node(f"shard-{n}", weight, n),)),))))


def _shards(node: Node) -> list[int]:
    return [s for c in node.children for s in _shards(c)] if node.children else [node.shard]


def descend(node: Node, key: Column, level: int = 0) -> Column:
    """The shard that a key comes to, as one expression: a branch is evaluated only for the rows that reach it."""
    if not node.children:
        return F.lit(node.shard)
    live = [c for c in node.children if c.total > 0]
    if len(live) == 1:
        return descend(live[0], key, level + 1)
    u = lambda c: (F.shiftrightunsigned(F.xxhash64(key, F.lit(c.name)), 11) + 0.5) / float(1 << 53)
    drawn = F.array_min(F.array(*(F.struct((-F.log(u(c)) / c.total).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(live))))["child"]
    if all(not c.children for c in live):
        return F.element_at(F.array(*(F.lit(c.shard) for c in live)), drawn + 1)
    out = F.when(drawn == 0, descend(live[0], key, level + 1))
    for i, c in enumerate(live[1:], 1):
        out = out.when(drawn == i, descend(c, key, level + 1))
    return out


def slots(rows: DataFrame, part: str) -> DataFrame:
    """Add slot: 0, 1, ... in each value of part, for rows without order; rows should hold only narrow columns."""
    names = rows.columns
    counted = rows.groupBy(*names).agg(F.count("*").alias("_n"))
    counted = shared_table(counted, "counted")
    total = counted.agg(F.sum("_n")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_ROWS))
    counted = counted.withColumn("_b", F.pmod(F.xxhash64(*names), F.lit(buckets)))
    sums = counted.groupBy(part, "_b").agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy(part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(part, "_b", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(part, "_b").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_at", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(starts, [part, "_b"])
    placed = placed.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(STEP))))
    placed = placed.withColumn("_k", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + STEP, F.col("_n")) - 1)))
    return placed.select(*names, (F.col("_start") + F.col("_at") + F.col("_k")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, root: Node, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row. Law `key`: the id and the tree decide."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), descend(root, key).alias("shard"), descend(grown(root), key).alias("grown_shard"))
    out = slots(rows, "shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.col("grown_shard").cast("int").alias("grown_shard"))
