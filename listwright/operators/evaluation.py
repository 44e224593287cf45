"""Evaluation: precision and recall curves, operating points, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.operators.rows import sums_before


def curve(df: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """by, threshold, precision, recall, rejected, gain (precision times what the threshold adds to recall): one row for each distinct score.

    Rows are aggregated by score first; what lies above a score is summed up over ranges of scores, so that no task sees all scores of a group.
    """
    g = df.groupBy(*by, F.col(score).alias("threshold")).agg(F.count("*").alias("n_"), F.sum(label).alias("p_"))
    g = sums_before(g, by, [F.desc("threshold")], {"bn_": "n_", "bp_": "p_"})
    whole = df.groupBy(*(F.col(c).alias(f"by_{k}") for k, c in enumerate(by))).agg(F.count("*").alias("all_"), F.sum(label).alias("pos_"))
    on = F.lit(True)
    for k, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"by_{k}"))
    g = g.join(whole if by else F.broadcast(whole), on).withColumns({"cn_": F.col("bn_") + F.col("n_"), "cp_": F.col("bp_") + F.col("p_")})  # one row without groups
    precision, share = F.col("cp_") / F.col("cn_"), lambda n: F.when(F.col("pos_") > 0, F.col(n) / F.col("pos_")).otherwise(F.lit(0.0))
    return g.select(*by, "threshold", precision.alias("precision"), share("cp_").alias("recall"), ((F.col("all_") - F.col("cn_")) / F.col("all_")).alias("rejected"), ((share("cp_") - share("bp_")) * precision).alias("gain"))


def at_recall(df: DataFrame, by: str, recall: float = 0.98) -> DataFrame:
    """The threshold of each group whose recall is nearest, the lowest on ties, and a row of means."""
    c = curve(df, [by]).withColumn("_d", F.round(F.abs(F.col("recall") - recall), 12))
    p = c.groupBy(by).agg(F.min_by(F.struct("threshold", "precision", "recall", "rejected"), F.struct("_d", "threshold")).alias("x")).select(by, "x.*")
    return _with_mean(p, by, ["threshold", "precision", "recall", "rejected"])


def at_threshold(df: DataFrame, by: str, threshold: float = 0.2) -> DataFrame:
    c = curve(df, [by]).withColumn("_d", F.round(F.abs(F.col("threshold") - threshold), 12))
    p = c.groupBy(by).agg(F.min_by(F.struct("precision", "recall"), F.struct("_d", "threshold")).alias("x")).select(by, "x.*")
    low = df.groupBy(by).agg((F.count_if(F.col("score") < threshold) / F.count("*")).alias("rejected"))
    return _with_mean(p.join(low, by), by, ["precision", "recall", "rejected"])


def _with_mean(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    mean = df.agg(F.lit("Average for all brands").alias(by), *[F.avg(c).alias(c) for c in columns])
    return df.select(by, *columns).unionByName(mean)


def confusion(df: DataFrame) -> DataFrame:
    """label, predicted 0, predicted 1: halves are rounded to even."""
    return df.groupBy("label").agg(F.count_if(F.bround("score") == 0).alias("p0"), F.count_if(F.bround("score") == 1).alias("p1"))


def average_precision(df: DataFrame, *by: str) -> DataFrame:
    """by, ap: over all rows without groups."""
    return curve(df, list(by)).groupBy(*by).agg(F.sum("gain").alias("ap"))


def node_evaluation(df: DataFrame, by: str, threshold: float = 0.5) -> DataFrame:
    """One row: acc (share of pages whose first labelled node has the best score), macro_ap, micro_ap, node_prec, node_rec.

    df: by (page), node (its place in the page), label (0 or 1), score. A page without a labelled node counts 0 for acc and macro_ap.
    """
    first = lambda score: F.max(F.struct(score, -F.col("node")))
    best = df.groupBy(by).agg(first(F.col("label")).alias("l"), first(F.col("score")).alias("s"), F.max("label").alias("any"))
    best = best.select(by, ((F.col("any") > 0) & (F.col("l.col2") == F.col("s.col2"))).cast("double").alias("good"), "any")
    ap = average_precision(df, by).withColumnRenamed(by, "_by")
    per = best.join(ap, best[by].eqNullSafe(ap["_by"])).agg(F.avg("good").alias("acc"), F.avg(F.when(F.col("any") > 0, F.col("ap")).otherwise(0.0)).alias("macro_ap"))
    micro = average_precision(df).select(F.col("ap").alias("micro_ap"))
    hit = (F.col("score") > threshold).cast("int")
    nodes = df.agg(F.sum(F.col("label") * hit).alias("tp"), F.sum(hit).alias("p"), F.sum("label").alias("l"))
    rate = lambda n: F.when(F.col(n) > 0, F.col("tp") / F.col(n)).otherwise(0.0)
    nodes = nodes.select(rate("p").alias("node_prec"), rate("l").alias("node_rec"))
    return per.crossJoin(F.broadcast(micro)).crossJoin(F.broadcast(nodes))  # one row each


def quota_alerts(counts: DataFrame, quotas: DataFrame, key: str, shares: tuple[float, ...] = (0.5, 0.75, 0.9)) -> DataFrame:
    """key, n, quota, share: organisations whose number of rows is just a share of their quota (whole part). counts: key, n; quotas: key, quota."""
    s = F.filter(F.array(*map(F.lit, shares)), lambda x: F.floor(x * F.col("quota")) == F.col("n"))
    return counts.join(quotas, key).withColumn("share", F.explode(s)).select(key, "n", "quota", "share")
