"""Connected components of an edge table by alternating large-star and small-star steps.

Nothing is collected but two numbers for each round. Neighbour lists are never built: a step takes the least neighbour
of each node with a partial aggregate and joins it back, so that a node with very many neighbours is a
skewed sort-merge join, which adaptive execution splits. The edges after each step are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.session import drop_shared, shared_table


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): each node of an edge and the least node that it reaches. Self-loops and nulls are ignored; edges may repeat."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = shared_table(e, "edges")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = shared_table(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        new = shared_table(small.where("u <> v").distinct(), "edges")
        for x in (e, large):
            drop_shared(x)
        e, old, state = new, state, _state(new)
        if state == old or _stars(e):
            break
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("id"), F.col("v").alias("component")))


def _stars(e: DataFrame) -> bool:
    """Whether each node hangs from one node, which hangs from none: another round would change nothing."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("n")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("n")).distinct())
    return ends.groupBy("x").agg(F.count("*").alias("n"), F.sum("n").alias("up")).where("up > 1 or (up = 1 and n > 1)").isEmpty()


def _state(e: DataFrame) -> tuple:
    """Equal for equal sets of edges: their number and a sum of hashes."""
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
