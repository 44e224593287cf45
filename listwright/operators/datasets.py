"""Training sets: extension over organisations, weights, balancing, splits, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.operators.rows import numbered_within
from listwright.session import shared_table


def draw(key: Column, seed: int = 200) -> Column:
    """A repeatable pseudorandom order of rows by an integer key, which SQL can express as well."""
    return F.pmod(key * 1103515245 + seed * 12345, F.lit(2147483647))


def frequent(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of groups with at least so many rows; counts are aggregated and joined back, so that hot groups are not gathered."""
    many = df.groupBy(*keys).count().where(F.col("count") >= least).select(*keys)
    return df.join(many, keys, "left_semi")


def extend(df: DataFrame, least: int = 10) -> DataFrame:
    """Each organisation with its own rows and all positive rows of others, which are irrelevant to it.

    df: id, organisation, domain, label (string), positive (boolean). The distinct organisations are written, so that Spark
    knows their size and broadcasts them if they are few.
    """
    base = frequent(frequent(df, ["organisation", "domain"], least), ["organisation"], least)
    orgs = shared_table(base.select(F.col("organisation").alias("target")).distinct(), "organisations")
    own = base.withColumn("target", F.col("organisation"))
    other = base.where("positive").join(orgs, F.col("target") != F.col("organisation"))
    return own.unionByName(other.withColumn("label", F.lit("Irrelevant"))).drop("organisation").withColumnRenamed("target", "organisation")


def weights(train: DataFrame, test: DataFrame) -> DataFrame:
    """organisation, label, weight: so that organisations weigh alike and labels as in the test set."""
    t = train.groupBy("organisation", "label").agg(F.count("*").alias("train_label"))
    per = t.groupBy("organisation").agg(F.sum("train_label").alias("train_n"))
    total = per.agg(F.sum("train_n").alias("all_n"), F.count("*").alias("orgs"))
    s = test.groupBy("organisation", "label").agg(F.count("*").alias("test_label"))
    s_per = s.groupBy("organisation").agg(F.sum("test_label").alias("test_n"))
    # the totals are one row
    j = t.join(per, "organisation").join(s, ["organisation", "label"]).join(s_per, "organisation").crossJoin(F.broadcast(total))
    w = (F.col("all_n") / F.col("orgs") / F.col("train_n")) * (F.col("test_label") / F.col("test_n") * F.col("train_n")) / F.col("train_label")
    return j.select("organisation", "label", w.alias("weight"))


def balance(df: DataFrame, label: str, key: Column, seed: int = 200) -> DataFrame:
    """As many rows of each label as the rarest has, the first in the drawn order; rows without a label are left out.

    Rows are numbered within labels as by numbered(): dealt by ranges, ranges are counted by label, counts are summed up.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = df.where(F.col(label).isNotNull()).withColumn("_u", draw(key, seed)).withColumn("_k", key)
    dealt = shared_table(drawn.repartitionByRange(parts, label, "_u", "_k").withColumn("_p", F.spark_partition_id()), "drawn")
    sums = shared_table(dealt.groupBy(label, "_p").agg(F.count("*").alias("_n")), "sums")
    n = sums.groupBy(label).agg(F.sum("_n").alias("n")).agg(F.min("n")).first()[0] or 0
    before = Window.partitionBy(label).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(label, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s")).where(F.col("_s") < n)
    place = F.row_number().over(Window.partitionBy("_p", label).orderBy("_u", "_k")) + F.col("_s")
    return dealt.join(starts, [label, "_p"]).withColumn("_r", place).where(F.col("_r") <= n).select(*df.columns)


def split(df: DataFrame, key: Column, share: float = 0.8, stratum: str | None = None, seed: int = 200) -> DataFrame:
    """Adds `train`: exact shares within each stratum, in the drawn order. Rows are numbered without a task that sees a whole stratum."""
    by = [stratum] if stratum else []
    r = numbered_within(df, by, [draw(key, seed), key], "_r")
    sizes = df.groupBy(*(F.col(b).alias("_stratum") for b in by)).agg(F.count("*").alias("_size"))
    r = r.join(sizes, F.col(stratum).eqNullSafe(F.col("_stratum"))) if stratum else r.crossJoin(F.broadcast(sizes))  # one row
    return r.select(*df.columns, (F.col("_r") <= F.floor(share * F.col("_size"))).alias("train"))


def hash_split(df: DataFrame, key: Column, shares: list[float], seed: int = 200) -> DataFrame:
    """Adds `part`: by cumulative shares of the drawn number; no shuffle."""
    u = draw(key, seed) / 2147483647.0
    total, part = 0.0, F
    for i, s in enumerate(shares[:-1]):
        total += s
        part = part.when(u < total, F.lit(i))
    return df.withColumn("part", part.otherwise(F.lit(len(shares) - 1)))


def top_and_rest(df: DataFrame, score: str, key: Column, top: float = 0.8, rest_percent: int = 20) -> DataFrame:
    """The rows with the best scores, and a sample of the others. Rows are numbered by ranges of the score, so that no task sees the whole share."""
    r = numbered_within(df.withColumn("_key", key), [], [F.desc(score), F.col("_key")], "_r")
    best = F.col("_r") <= int(df.count() * top)
    return r.where(best | (F.pmod("_key", F.lit(100)) < rest_percent)).select(*df.columns)


def subsample(df: DataFrame, key: str, fraction: float | None = None, ids: list | DataFrame | None = None, seed: int = 200) -> DataFrame:
    """A share of the rows by a repeatable draw, or the rows with given ids (a list, or a table whose first column has them, such as a file that was read), in the order of the key."""
    if (fraction is None) == (ids is None):
        raise ValueError("either a fraction or ids")
    if fraction is not None:
        return df.where(draw(F.col(key), seed) < int(fraction * 2147483647)).orderBy(key)
    if not isinstance(ids, DataFrame):
        return df.where(F.col(key).isin(ids)).orderBy(key)
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi").orderBy(key)


def early_stop(found: DataFrame, max_results: int, max_discovered: int | None = None, retries: int = 10, in_a_row: int = 2) -> DataFrame:
    """The rows of a browsing job up to where it stops: found has batch (1, 2, ...), place (in the batch), fresh (whether the row is a new result).

    It stops at max_results fresh rows or max_discovered rows (three times as many unless given), in the middle of a batch if need be, and behind the
    batch that is the in_a_row-th without a fresh row in a row, or the retries-th in all. Batches are summed up first; windows see a row for each.
    """
    limit = max_discovered or 3 * max_results
    b = found.groupBy("batch").agg(F.count("*").alias("_n"), F.count_if("fresh").alias("_f"))
    line = Window.orderBy("batch")
    so_far = line.rowsBetween(Window.unboundedPreceding, -1)
    idle = (F.col("_f") == 0).cast("int")
    b = b.withColumns({"_n0": F.coalesce(F.sum("_n").over(so_far), F.lit(0)), "_f0": F.coalesce(F.sum("_f").over(so_far), F.lit(0)), "_idle": idle, "_run": F.sum(idle).over(line.rowsBetween(-(in_a_row - 1), 0)), "_idles": F.sum(idle).over(line)})
    b = b.withColumn("_stop", (F.col("_run") >= in_a_row) | (F.col("_idles") >= retries))
    b = b.withColumn("_stopped", F.coalesce(F.max(F.col("_stop").cast("int")).over(so_far), F.lit(0))).where("_stopped = 0")
    b = b.where((F.col("_n0") < limit) & (F.col("_f0") < max_results)).select("batch", "_n0", "_f0")
    within = Window.partitionBy("batch").orderBy("place")
    rows = found.join(b, "batch").withColumns({"_k": F.col("_n0") + F.row_number().over(within), "_r": F.col("_f0") + F.sum(F.col("fresh").cast("int")).over(within)})
    return rows.where((F.col("_k") <= limit) & ((F.col("_r") - F.col("fresh").cast("int")) < max_results)).select(*found.columns)
