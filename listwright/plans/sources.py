"""Queries of sources: stored tables, pages of a scan, saved answers of services, sheets, caches, configurations."""

from __future__ import annotations

import json
import pandas as pd
from pyspark.sql import functions as F

from listwright.operators import pages as G
from listwright.plans.dom import COUNT
from listwright.plans.registry import query
from listwright.plans.views import table
from listwright.session import shared_folder
from listwright.sources import files
from listwright.streaming import jobs


def place(spark, name: str) -> str:
    return shared_folder(spark, name)


@query("s6_stored_table", "SELECT o_orderkey AS id, o_custkey AS organisation_id, o_orderstatus AS scraping_status FROM orders")
def s6(spark, sf):
    """A stored table under the entity's names; only its columns are read."""
    return files.read_table(spark, "orders", sf, columns={"o_orderkey": "id", "o_custkey": "organisation_id", "o_orderstatus": "scraping_status"})


@query("s7_paged_scan", "SELECT page, count(*) AS n, min(id) AS first, max(id) AS last FROM (SELECT o_orderkey AS id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 2500 AS page FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) <= 12000) GROUP BY page")
def s7(spark, sf):
    p = files.paged(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), "id", 2500, 12_000)
    return p.groupBy("page").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("s9_consumed_keys", "SELECT 'task:' || user_id % 50 AS key, count(*) AS n FROM events WHERE user_id % 50 < 25 GROUP BY 1")
def s9(spark, sf):
    """Entries whose keys match a pattern, read once: their files are deleted behind the reader."""
    path = place(spark, "keys")
    e = table(spark, sf, "events").withColumn("key", F.concat(F.when(F.col("user_id") % 50 < 25, "task:").otherwise("log:"), (F.col("user_id") % 50).cast("string")))
    e.select("key", "event_id").write.parquet(path)
    return jobs.consumed(spark, path, "key string, event_id long", "^task:").groupBy("key").agg(F.count("*").alias("n"))


@query("s11_api_pages", "SELECT doc_id AS id, coalesce(lang, '') AS title FROM documents")
def s11(spark, sf):
    """Saved pages of a service's answers, ten items a page, taken apart."""
    path = place(spark, "api")
    d = table(spark, sf, "documents").select((F.col("doc_id") / 10).cast("long").alias("page"), F.struct(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("title")).alias("item"))
    d.groupBy("page").agg(F.collect_list("item").alias("items")).withColumn("next", F.col("page") + 1).write.json(path)
    return spark.read.schema("page long, next long, items array<struct<id: long, title: string>>").json(path).select(F.explode("items").alias("i")).select("i.*")


@query("s12_cursor_pages", "SELECT source AS chain, count(*) AS n, count(*) FILTER (WHERE complete) AS complete FROM (SELECT source, doc_id, source NOT IN (SELECT source FROM documents WHERE doc_id % 50 = 7) AS complete FROM documents WHERE doc_id % 50 <> 7) GROUP BY source")
def s12(spark, sf):
    """Items of pages that lead on by cursors; a chain with a page that was not saved is not complete."""
    from pyspark.sql import Window

    w = Window.partitionBy("chain").orderBy("doc_id")
    d = table(spark, sf, "documents").select(F.col("source").alias("chain"), "doc_id")
    p = d.select("chain", "doc_id", F.lag("doc_id").over(w).isNull().alias("first"), F.lead("doc_id").over(w).cast("string").alias("end_cursor"))
    p = p.select("chain", F.when(~F.col("first"), F.col("doc_id").cast("string")).alias("cursor"), "end_cursor", F.col("end_cursor").isNotNull().alias("has_next"), F.array("doc_id").alias("items"), "doc_id")
    c = files.cursor_pages(p.where("doc_id % 50 <> 7").drop("doc_id"))
    return c.groupBy("chain").agg(F.count("*").alias("n"), F.count_if("complete").alias("complete"))


@query("s13_resumed_scan", "SELECT event_id AS id FROM events WHERE ts < (SELECT min(ts) FROM events WHERE event_id % 1000 = 3)")
def s13(spark, sf):
    """A scan from the newest to the oldest goes on below the oldest time that was read well."""
    e = table(spark, sf, "events")
    return files.resumed(e, "ts", e.where("event_id % 1000 = 3").select("ts")).select(F.col("event_id").alias("id"))


@query("s14_web_search", "WITH r AS (SELECT 'q' || page_id % 7 AS query, CAST(page_id // 70 % 12 + 1 AS INT) AS page, CAST(page_id // 7 % 11 + 1 AS INT) AS place, url FROM pages), i AS (SELECT query, (page - 1) * 10 + place AS rank, url, string_split(regexp_replace(url, '[?#].*$|/$', ''), '/')[-1] AS id FROM r WHERE page <= 10 AND place <= 10) SELECT query, id, arg_min(url, (rank, url)) AS url, min(rank) AS rank FROM i WHERE id <> '' GROUP BY query, id")
def s14(spark, sf):
    """Web search results: ten pages of ten, the listing's id from its address, each id once."""
    n = F.col("page_id")
    r = table(spark, sf, "pages").select(F.concat(F.lit("q"), (n % 7).cast("string")).alias("query"), (F.floor(n / 70) % 12 + 1).alias("page"), (F.floor(n / 7) % 11 + 1).alias("place"), "url")
    return files.search_results(r).select("query", "id", "url", F.col("rank").cast("int").alias("rank"))


@query("s15_async_tasks", "SELECT user_id AS task, count(*) AS items FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING max_by(event_type, (ts, event_id)) IN ('view', 'click')) GROUP BY 1")
def s15(spark, sf):
    """Results of asynchronous tasks whose last status is finished."""
    e = table(spark, sf, "events")
    tasks = e.select(F.col("user_id").alias("task"), F.when(F.col("event_type").isin("view", "click"), "finished").otherwise("running").alias("status"), F.struct("ts", "event_id").alias("at"))
    return files.finished_results(tasks, e.select(F.col("user_id").alias("task"), F.col("event_id").alias("item"))).groupBy("task").agg(F.count("*").alias("items"))


@query("s18_annotation_sheet", "SELECT doc_id AS post_id, toxic AS annotation FROM labels WHERE quality = 1 AND toxic IS NOT NULL AND doc_id IN (SELECT page_id FROM pages)")
def s18(spark, sf):
    """A sheet of annotations, read from a delimited file: checked rows under new names, whose page's file exists."""
    path = place(spark, "sheet")
    files.write_delimited(table(spark, sf, "labels").select("doc_id", "quality", "toxic", F.lit("x").alias("Unnamed: 3")), path)
    sheet = files.read_delimited(spark, path, "doc_id long, quality int, toxic int, `Unnamed: 3` string")
    return files.annotation_sheet(sheet, {"doc_id": "post_id", "toxic": "annotation"}, F.col("quality") == 1, table(spark, sf, "pages").select("page_id"), "post_id")


@query("s19_tree_package", f"SELECT page_id, url, {COUNT('li')} AS items, CAST(length(html) AS INT) AS n FROM pages WHERE page_id % 3 <> 0 AND {COUNT('li')} > 0")
def s19(spark, sf):
    """The parts of a package of trees (addresses, trees, features) that were saved apart, in one table."""
    p, path = table(spark, sf, "pages"), place(spark, "package")
    p.select("page_id", "url").where("page_id % 3 <> 0").write.parquet(f"{path}/meta")
    p.select("page_id", "html").write.parquet(f"{path}/trees")
    G.selected(p.select("page_id", "html"), {"li": {"css_selector": "li"}}).where(F.size("li") > 0).select("page_id", F.size("li").alias("items")).write.parquet(f"{path}/features")
    parts = [spark.read.parquet(f"{path}/{x}") for x in ("meta", "trees", "features")]
    return files.tree_package(*parts, "page_id").select("page_id", "url", "items", F.length("html").alias("n"))


@query("s22_cached_lookup", "WITH now AS (SELECT max(ts) AS now FROM events), c AS (SELECT user_id, arg_max(event_type, (ts, event_type)) AS value, max(ts) AS ts FROM events, now WHERE ts >= now - INTERVAL 7 DAY AND user_id % 3 > 0 GROUP BY user_id), k AS (SELECT DISTINCT user_id FROM events) SELECT k.user_id, coalesce(c.value, 'looked up ' || k.user_id) AS value, c.value IS NOT NULL AS cached FROM k LEFT JOIN c USING (user_id)")
def s22(spark, sf):
    """Lookups through a cache whose entries live for seven days; what it lacks is looked up and written to it."""
    e = table(spark, sf, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    cache = e.where("user_id % 3 > 0").select("user_id", F.col("event_type").alias("value"), F.col("ts").alias("at"))
    answers, after = files.read_through(e.select("user_id"), cache, "user_id", now, 7, lambda keys: keys.withColumn("value", F.concat(F.lit("looked up "), F.col("user_id").cast("string"))))
    return answers.join(after.select("user_id"), "user_id", "left_semi").select("user_id", "value", "cached")


@query("f18_f21_validated_configs", "SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 3 THEN 'keys without defaults: other.x' WHEN p_partkey % 10 = 4 THEN 'post.size: ''big'' is no int' WHEN p_size > 40 THEN 'post.size: ' || p_size || ' is refused' WHEN p_partkey % 10 = 5 THEN 'mode: ''fast'' is not among [''slow'', ''usual'']' END AS error, CASE WHEN p_partkey % 10 NOT IN (3, 4, 5) AND p_size <= 40 THEN CASE WHEN p_partkey % 10 = 6 THEN 'slow' ELSE 'usual' END END AS mode, CASE WHEN p_partkey % 10 NOT IN (3, 4, 5) AND p_size <= 40 THEN CAST(p_size AS BIGINT) END AS size FROM part")
def f18(spark, sf):
    """Nested configurations, flattened, with defaults, checked by allowed keys, values, kinds and a test."""
    k = F.col("p_partkey") % 10
    size = F.when(k == 4, F.lit('"big"')).otherwise(F.col("p_size").cast("string"))
    text = F.concat(F.lit('{"post": {"size": '), size, F.lit(', "tag": "!ignore"}'), F.when(k == 3, ', "other": {"x": 1}').when(k == 5, ', "mode": "fast"').when(k == 6, ', "mode": "slow"').otherwise(""), F.lit(', "free": {"a": [1]}}'))
    spec = {"post.size": {"kind": "int", "check": lambda v: v <= 40}, "mode": {"default": "usual", "values": ["slow", "usual"]}}
    r = files.validated_rows(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.alias("text")), "text", spec, ("free",))
    return r.select("id", "error", F.get_json_object("config", "$.mode").alias("mode"), F.get_json_object("config", "$['post.size']").cast("long").alias("size"))


@query("s20_s21_config_merge", "SELECT p_partkey AS id, 'https://b.example.com/p/{}' AS template, '/p/' || p_brand AS regex, '[\"title\"]' AS fields, CASE WHEN p_partkey % 2 = 0 THEN 'false' ELSE 'true' END AS proxy FROM part")
def s20(spark, sf):
    """A configuration for each part that includes a common one: merged level by level, lists replaced, the search template from the post's; flattened and nested again."""
    base = {"post": {"regex": "none", "fields": ["title", "price"]}, "proxy": True}

    @F.pandas_udf("string")
    def merged(texts: pd.Series) -> pd.Series:
        def one(text):
            child = json.loads(text)
            config = files.with_defaults(files.load_config("child", {"base": base, "child": child}.__getitem__), "https://b.example.com/p/{}")
            return json.dumps(files.unflat(dict(files.flat(config))))

        return texts.map(one)

    child = F.concat(F.lit('{"include": "base", "post": {"regex": "/p/'), "p_brand", F.lit('", "fields": ["title"]}'), F.when(F.col("p_partkey") % 2 == 0, ', "proxy": false').otherwise(""), F.lit("}"))
    c = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), merged(child).alias("c"))
    return c.select("id", *(F.get_json_object("c", f"$.{p}").alias(a) for p, a in (("search.template", "template"), ("post.regex", "regex"), ("post.fields", "fields"), ("proxy", "proxy"))))
