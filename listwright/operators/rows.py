"""Row numbers over a whole table without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.session import shared_table


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds 1, 2, ... in the order of a unique key: rows are dealt by ranges of the key, ranges are counted, counts are summed up."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shared_table(df.repartitionByRange(parts, key).withColumn("_p", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))  # a row for each range
    n = F.row_number().over(Window.partitionBy("_p").orderBy(key))
    return dealt.join(F.broadcast(starts), "_p").withColumn(name, (n + F.col("_s")).cast("long")).drop("_p", "_s")


def numbered_within(df: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds 1, 2, ... within each group in an order without ties, as numbered() does: no task sees a whole group. Null is a group."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumns({f"_g{k}": F.col(g) for k, g in enumerate(groups)})
    own = [f"_g{k}" for k in range(len(groups))]
    dealt = shared_table(keyed.repartitionByRange(parts, *own, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*own, "_p").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*own).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(g).alias(f"{g}s") for g in own), F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    on = F.col("_p") == F.col("_q")
    for g in own:
        on = on & F.col(g).eqNullSafe(F.col(f"{g}s"))
    n = F.row_number().over(Window.partitionBy("_p", *own).orderBy(*order))
    return dealt.withColumn(name, n).join(starts, on).withColumn(name, (F.col(name) + F.col("_s")).cast("long")).select(*df.columns, name)


def sums_before(df: DataFrame, groups: list[str], order: list[Column], values: dict[str, str]) -> DataFrame:
    """Adds, by name, the sum of a column over the rows of the group that come before in an order without ties (0 for the first): as numbered_within(), no task sees a whole group."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [f"_g{k}" for k in range(len(groups))]
    dealt = df.withColumns({o: F.col(g) for o, g in zip(own, groups, strict=True)}).repartitionByRange(parts, *own, *order).withColumn("_p", F.spark_partition_id())
    dealt = shared_table(dealt, "ranges")
    sums = dealt.groupBy(*own, "_p").agg(*(F.sum(c).alias(f"_v_{n}") for n, c in values.items()))
    before = Window.partitionBy(*own).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each group and range
    starts = sums.select(*(F.col(g).alias(f"{g}s") for g in own), F.col("_p").alias("_q"), *(F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in values))
    on = F.col("_p") == F.col("_q")
    for g in own:
        on = on & F.col(g).eqNullSafe(F.col(f"{g}s"))
    within = Window.partitionBy("_p", *own).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    there = dealt.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in values.items()})
    return there.join(starts, on).withColumns({n: F.col(n) + F.col(f"_s_{n}") for n in values}).select(*df.columns, *values)
