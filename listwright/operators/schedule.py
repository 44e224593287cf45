"""Scheduling of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active(tasks: DataFrame) -> DataFrame:
    """Tasks with an interval, of no or an active organisation, on an active website, active themselves."""
    return tasks.where((F.col("interval") > 0) & (F.col("organisation_id").isNull() | F.col("org_active")) & F.col("site_active") & F.col("is_active"))


def due(tasks: DataFrame, now_us: int) -> DataFrame:
    """Tasks that never ran, or last ran longer ago than their interval and up to 5 % more, by the microseconds of the last run."""
    last = F.unix_micros("last_run")
    noise = (100 + last % 1000000 % 6) / 100
    return tasks.where(F.col("last_run").isNull() | ((F.lit(now_us) - last) / 1e6 > F.col("interval") * noise))


def expected_load(tasks: DataFrame, seconds: float = 900.0) -> DataFrame:
    """Tasks that start in so many seconds if all are spread evenly, and the most that a run may start."""
    load = F.sum(F.lit(seconds) / F.col("interval"))
    return tasks.agg(F.round(load, 9).alias("load"), F.ceil(load * 1.2).cast("long").alias("most"))


def query_urls(queries: DataFrame, templates: list[str], most: int) -> DataFrame:
    """query, url: each query in each template (a few)."""
    made = []
    for t in templates:
        t = t.replace("MAX_POSTS_TO_BROWSE", str(most))
        head, _, tail = t.partition("{SEARCH_QUERY}" if "{SEARCH_QUERY}" in t else "{}")
        made.append(F.concat(F.lit(head), F.col("query"), F.lit(tail)))
    return queries.select("query", F.explode(F.array(*made)).alias("url"))
