"""The domain's tables as views over the given ones, in Spark and as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title (first line), description (the rest; null if none), domain, lang."""
    t = F.coalesce("text", F.lit(""))
    at = F.instr(t, "\n")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.split_part(t, F.lit("\n"), F.lit(1)).alias("title"), F.when(at > 0, F.substr(t, at + 1)).alias("description"), F.col("source").alias("domain"), "lang")


POSTS = """posts AS (SELECT doc_id AS id, split_part(coalesce(text, ''), chr(10), 1) AS title, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) END AS description, source AS domain, lang FROM documents)"""

# organisations: one for each nation; keywords are frequent words of the corpus
KEYWORDS = [("idiot", "Org_A"), ("trash", "Org_B"), ("einer", "Org_C"), ("elle", "Org_D"), ("license", "Org_E"), ("worthless", "Org_A"), ("einer", "Org_F")]


def keyword_table(spark: SparkSession) -> DataFrame:
    """keyword, organisation, pos: a few rows."""
    return spark.createDataFrame([(k, o, i) for i, (k, o) in enumerate(KEYWORDS)], "keyword string, organisation string, pos int")


KEYWORD_SQL = "kw AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{o}', {i})" for i, (k, o) in enumerate(KEYWORDS)) + ") t(keyword, organisation, pos))"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, domain, label (0 or 1), score: a score that depends on the id, for evaluation."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id").select(F.col("doc_id").alias("id"), F.col("source").alias("domain"), F.col("toxic").alias("label"), (F.pmod(F.col("doc_id") * 7919 + F.col("toxic") * 37, F.lit(101)) / 100.0).alias("score"))


LABELLED = "lab AS (SELECT doc_id AS id, source AS domain, toxic AS label, ((doc_id * 7919 + toxic * 37) % 101) / 100.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraping tasks made of customers: id, organisation (nation; null for some), website, interval, last run (null for some), active."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_nationkey")).alias("organisation_id"), F.concat(F.lit("site"), (F.col("c_custkey") % 17).cast("string")).alias("domain"), F.when(F.col("c_custkey") % 13 != 0, (F.col("c_custkey") % 9) * 3600).alias("interval"), F.when(F.col("c_custkey") % 7 != 0, F.timestamp_micros(F.lit(1704067200000000) + F.col("c_custkey") * 1234567)).alias("last_run"), (F.col("c_custkey") % 5 != 0).alias("is_active"), (F.col("c_nationkey") % 4 != 0).alias("org_active"), (F.col("c_custkey") % 17 != 3).alias("site_active"))


TASKS = """tasks AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 <> 0 THEN c_nationkey END AS organisation_id, 'site' || (c_custkey % 17) AS domain, CASE WHEN c_custkey % 13 <> 0 THEN (c_custkey % 9) * 3600 END AS interval_s,
CASE WHEN c_custkey % 7 <> 0 THEN 1704067200000000 + c_custkey * 1234567 END AS last_us, c_custkey % 5 <> 0 AS is_active, c_nationkey % 4 <> 0 AS org_active, c_custkey % 17 <> 3 AS site_active FROM customer),
act AS (SELECT * FROM tasks WHERE interval_s > 0 AND (organisation_id IS NULL OR org_active) AND site_active AND is_active)"""
