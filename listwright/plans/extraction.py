"""Queries of field extraction over pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.functions import extraction as X
from listwright.plans.registry import query
from listwright.plans.views import table

LIST = r"list_distinct(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1))".replace('\\"', '"')
ALL = LIST.removeprefix('list_distinct(').removesuffix(')')
TIDY = "trim(regexp_replace(regexp_replace({}, '<[^\\n]*?>', '', 'g'), '\\s+', ' ', 'g'))".replace("\\\\", "\\")


@query("e4_joined_texts", rf"SELECT page_id AS id, md5(array_to_string(list_filter(list_transform(regexp_extract_all(html, '<li>(.*?)</li>', 1), lambda t: trim(regexp_replace(regexp_replace(t, '<[^\n]*?>', '', 'g'), '\s+', ' ', 'g'))), lambda t: t <> ''), chr(10))) AS text FROM pages")
def e4(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.md5(X.joined_text(F.col("html"), {"css_selector": "li"}).cast("binary")).alias("text"))


@query("e23_api_values", "SELECT event_id AS id, props->>'$.k' AS k, (props->>'$.k') || ' ' || (props->>'$.k') AS both FROM events")
def e23(spark, sf):
    p = F.col("props")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), X.json_paths(p, ["$.k", "$.none"]).alias("k"), X.json_paths(p, ["$.k", "$.k"]).alias("both"))


@query("e24_page_head", f"SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len({LIST}) AS INT) AS n_links FROM pages")
def e24(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), X.page_title(h).alias("title"), F.size(X.links(h)).alias("n_links"))
