"""Queries of sinks: bulk writes, logs, payloads, responses, image keys, column descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.functions import extraction as X
from listwright.operators import pages as G
from listwright.operators import payloads as M
from listwright.operators import store as K
from listwright.plans.registry import query
from listwright.plans.store import STORE, _stores
from listwright.plans.views import POSTS, posts, table
from listwright.session import shared_folder, shared_table

NOW = "2024-05-06 07:08:09"


@query("k5_k6_bulk_writes", f"WITH {STORE}, g AS (SELECT * FROM nw WHERE id % 11 <> 0) SELECT 'inserted' AS result, k, status FROM g WHERE k NOT IN (SELECT k FROM st) UNION ALL SELECT 'updated', k, status FROM g WHERE k IN (SELECT k FROM st) UNION ALL SELECT 'kept', k, status FROM st WHERE k NOT IN (SELECT k FROM g) UNION ALL SELECT 'refused', NULL, status FROM nw WHERE id % 11 = 0")
def k5(spark, sf):
    """A bulk write into a store: known keys are updated, unknown ones added, others stay; rows without a key are put aside instead of failing the batch."""
    s, n = _stores(spark, sf)
    n = n.withColumn("k", F.when(F.col("id") % 11 != 0, F.col("k")))
    store, refused = K.bulk_write(s, n, ["k"], ["status", "title"], F.col("k").isNotNull())
    return store.select("result", "k", "status").unionByName(refused.select(F.lit("refused").alias("result"), "k", "status"))


@query("k7_event_log", "SELECT event_type, count(*) AS n, max(event_id) AS latest FROM events GROUP BY event_type")
def k7(spark, sf):
    """An append-only log that three batches are appended to."""
    path = shared_folder(spark, "event-log")
    for k in range(3):
        table(spark, sf, "events").where(F.col("event_id") % 3 == k).write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("latest"))


_POST = "regexp_extract(text, '^[^\\n]*')".replace("\\\\n", "\\n")


def listings(spark, sf):
    """Documents as listings with most of a listing's fields, some of them null."""
    n = F.col("id")
    stamp = F.timestamp_seconds(F.lit(1704067200) + n * 61)
    return posts(spark, sf).withColumns({
        "organisation_name": F.when(n % 3 == 0, "FRANCE").otherwise("GERMANY"), "url": F.concat(F.lit("https://s.example.com/p/"), n.cast("string")), "platform_id": n.cast("string"), "scraping_time": stamp, "posting_time": F.when(n % 4 == 0, F.lit("2024-01-01-00:00:00")),
        "vendor": F.when(n % 2 == 0, F.concat(F.lit("v"), (n % 7).cast("string"))).otherwise(""), "poster": F.concat(F.lit("p"), (n % 5).cast("string")), "price": F.when(n % 6 != 0, F.concat((n % 90).cast("string"), F.lit(" EUR"))), "pictures": F.transform(F.sequence(F.lit(0), (n % 3).cast("int")), lambda k: F.concat(F.lit("i"), k.cast("string"))),
        "post_tags": F.array(F.lit("upload")), "tags": F.when(n % 2 == 0, F.array(F.col("domain"))), "upload_id": F.when(n % 5 == 0, n), "risk_scores": F.create_map(F.lit("FRANCE"), (n % 10) / 10.0, F.lit("FRANCE_Grey_Market"), (n % 20) / 20.0),
    })


@query("k8_insertion_payload", f"""WITH {POSTS} SELECT id, 'test' AS environment_name, CASE WHEN id % 3 = 0 THEN 'FRANCE' ELSE 'GERMANY' END AS organisation_name, 6 AS actions, strftime(make_timestamp((1704067200 + id * 61) * 1000000), '%Y-%m-%d-%H:%M:%S') AS scraping_time, CASE WHEN id % 2 = 0 THEN 'v' || id % 7 ELSE 'p' || id % 5 END AS poster, CASE WHEN id % 6 <> 0 THEN (id % 90) || ' EUR' END AS price, 'https://s.example.com/p/' || id AS url, title, description,
CAST(id % 3 + 1 AS INT) AS pictures, 'SPECIFIC_SCRAPER' AS source, CASE WHEN id % 2 = 0 THEN 'upload,' || domain ELSE 'upload' END AS tags, CAST(id AS VARCHAR) AS platform_id, CASE WHEN id % 4 = 0 THEN '2024-01-01-00:00:00' END AS posting_time, CASE WHEN id % 5 = 0 THEN id END AS upload_id, 26 AS fields FROM posts""")
def k8(spark, sf):
    """The message that inserts each listing, written as JSON and read back."""
    p = M.insertion_payload(listings(spark, sf), "test")
    g = lambda path: F.get_json_object("body", f"$.{path}")
    lists = lambda path: F.from_json(g(path), "array<string>")
    return p.select(
        "id", g("environment_name").alias("environment_name"), g("organisation_name").alias("organisation_name"), sum(((g(a) == "true").cast("int") for a in M.ACTIONS), F.lit(0)).alias("actions"), *(g(f"post.{f}").alias(f) for f in ("scraping_time", "poster", "price", "url", "title", "description")),
        F.size(lists("post.pictures")).alias("pictures"), g("post.source").alias("source"), F.array_join(lists("post.post_tags"), ",").alias("tags"), g("post.payload.platform_id").alias("platform_id"), g("post.payload.posting_time").alias("posting_time"), g("post.upload_id").cast("long").alias("upload_id"),
        (F.size(F.json_object_keys(g("post"))) + F.size(F.json_object_keys(g("post.payload"))) - 1).alias("fields"),
    )


@query("k9_profile_payload", f"SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'https://u.example.com/' || c_custkey ELSE 'https://s.example.com/u/' || c_custkey END AS url, CAST(c_custkey % 100 AS BIGINT) AS posts_count, '{NOW.replace(' ', '-')}' AS scraping_time, 'UPLOAD' AS source, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS tags, CASE WHEN c_custkey % 5 = 0 THEN n_name END AS geo, CAST(CASE WHEN c_custkey % 5 = 0 THEN 16 ELSE 15 END AS INT) AS fields FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def k9(spark, sf):
    """The message that inserts each profile."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    c = c.select(k.alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("https://s.example.com/u/"), k.cast("string")).alias("url"), F.when(k % 3 == 0, F.concat(F.lit("https://u.example.com/"), k.cast("string"))).alias("upload_url"), (k % 100).alias("posts_count"), F.when(k % 2 == 0, F.array("c_mktsegment")).alias("account_tags"), F.when(k % 5 == 0, F.col("n_name")).alias("geo"))
    p = M.profile_payload(c, "test", F.lit(NOW).cast("timestamp"), "UPLOAD")
    g = lambda path: F.get_json_object("body", f"$.profile.{path}")
    return p.select("id", g("name").alias("name"), g("url").alias("url"), g("posts_count").cast("long").alias("posts_count"), g("scraping_time").alias("scraping_time"), g("source").alias("source"), F.array_join(F.from_json(g("account_tags"), "array<string>"), ",").alias("tags"), g("geo").alias("geo"), F.size(F.json_object_keys(F.get_json_object("body", "$.profile"))).alias("fields"))


@query("k10_fan_out", "SELECT doc_id AS id, o AS organisation_name, CASE o WHEN 'FRANCE' THEN (doc_id % 10) / 10.0::DOUBLE WHEN 'FRANCE_Grey_Market' THEN (doc_id % 20) / 20.0::DOUBLE END AS risk_score FROM documents, (VALUES ('FRANCE', true), ('FRANCE_Grey_Market', true), ('GERMANY', false)) t(o, f) WHERE f = (doc_id % 3 = 0)")
def k10(spark, sf):
    """Listings of an organisation with partners go to these too, each with its own risk score."""
    return M.fan_out(listings(spark, sf), {"FRANCE": ["FRANCE_Grey_Market"]}).select("id", "organisation_name", "risk_score")


@query("k11_response", rf"""WITH l AS (SELECT page_id, url, html, list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda u: replace(replace(replace(replace(u, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS links FROM pages) SELECT page_id AS id, url, '{NOW}' AS created, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS language, CAST(len(links) AS INT) AS links, links[1] AS first_link, CASE WHEN page_id % 2 = 0 THEN 'v' || page_id END AS poster_name, CASE WHEN page_id % 2 = 1 THEN 'n' || page_id END AS name, CASE WHEN page_id % 2 = 0 THEN 's3://b/' || page_id END AS image, page_id % 10 <> 0 AS successful FROM l""")
def k11(spark, sf):
    """The answer for each page: the page, its links, a listing or a poster, errors."""
    n, none = F.col("page_id"), F.lit(None).cast("string")
    p = G.selected(table(spark, sf, "pages").select("page_id", "url", "html", F.nullif(X.page_title(F.col("html")), F.lit("")).alias("title")), {"l": {"css_selector": "a[href]", "attribute_name": "href"}, "lang": {"css_selector": "html[lang]", "attribute_name": "lang"}})
    image = F.struct(F.lit("i.jpg").alias("picture_url"), F.concat(F.lit("s3://b/"), n.cast("string")).alias("s3_url"))
    data = F.struct(F.when(n % 2 == 0, "POST").otherwise("POSTER").alias("type"), "title", none.alias("description"), none.alias("price"), F.concat(F.lit("v"), n.cast("string")).alias("vendor"), none.alias("poster_link"), F.array(image).alias("pictures"), F.concat(F.lit("n"), n.cast("string")).alias("name"), none.alias("translated_description"), none.alias("profile_pic_url"))
    p = p.withColumns({"source_language": F.try_element_at("lang", F.lit(1)), "outgoing_links": F.transform("l", lambda u: F.struct(u.alias("url"), F.array().cast(M.IMAGES).alias("pictures"))), "data": data, "successful": F.when(n % 10 == 0, F.lit(False))})
    r = M.response(p, F.lit(NOW).cast("timestamp")).select(n.alias("id"), F.col("response.pages")[0].alias("p"), F.col("response.successful").alias("successful"))
    first = lambda a: F.try_element_at(a, F.lit(1))
    return r.select("id", "p.url", F.col("p.creation_date_timestamp").alias("created"), "p.title", F.col("p.source_language").alias("language"), F.size("p.outgoing_links").alias("links"), first(F.col("p.outgoing_links"))["to_url"].alias("first_link"), "p.post.poster_name", "p.poster.name", first(F.col("p.post.images"))["s3_url"].alias("image"), "successful")


@query("k12_url_log", 'WITH e AS (SELECT \'u\' || user_id AS url, ts, event_type AS payload FROM events), n AS (SELECT url, max(ts) AS ts FROM e GROUP BY url) SELECT url, ts AS "at", max(payload) AS payload FROM e JOIN n USING (url, ts) WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY url, ts')
def k12(spark, sf):
    """A log of answers that is appended to, and the pointer to the newest entry of each address, which lives for two hours."""
    path = shared_folder(spark, "url-log")
    e = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("ts").alias("at"), F.col("event_type").alias("payload"), "event_id")
    for k in range(2):
        e.where(F.col("event_id") % 2 == k).drop("event_id").write.mode("append").parquet(path)
    now = e.agg(F.max("at")).first()[0]
    return M.latest_logs(spark.read.parquet(path), F.lit(now), 7200)


_IMG = "CASE vec_id % 8 WHEN 0 THEN 'FFD8FFE0' WHEN 1 THEN '89504E470D0A1A0A' WHEN 2 THEN '474946383961' WHEN 3 THEN '524946460000000057454250' WHEN 4 THEN '000000206674797061766966' WHEN 5 THEN '424D0000' WHEN 6 THEN '3C68746D6C3E' ELSE '' END"
_KIND = "CASE vec_id % 8 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' WHEN 4 THEN 'image/avif' WHEN 5 THEN 'image/bmp' END"


def images(spark, sf):
    heads = ["FFD8FFE0", "89504E470D0A1A0A", "474946383961", "524946460000000057454250", "000000206674797061766966", "424D0000", "3C68746D6C3E", ""]
    v = F.col("vec_id")
    data = F.concat(F.unhex(F.element_at(F.array(*map(F.lit, heads)), (v % 8 + 1).cast("int"))), v.cast("string").cast("binary"))
    return table(spark, sf, "embeddings").select(v.alias("id"), data.alias("data"), F.when(v % 50 == 0, 404).otherwise(200).alias("status"), F.lower(F.hex(v % 100)).alias("hash"))


@query("k13_image_keys", f"SELECT vec_id AS id, 'pics/' || sha256(unhex({_IMG} || hex(CAST(vec_id AS VARCHAR)) || hex('salt'))) || '.' || replace({_KIND}, 'image/', '') AS key, 1 AS scale FROM embeddings")
def k13(spark, sf):
    """Where an image is kept: by the hash of its salted content and its kind; nowhere if it is no image."""
    return images(spark, sf).select("id", M.image_key(F.col("data"), "/pics/", "salt").alias("key"), M.image_scale(F.col("data")).alias("scale"))


@query("p17_p18_valid_images", f"SELECT vec_id AS id, {_KIND} AS kind FROM embeddings WHERE vec_id % 50 <> 0 AND {_KIND} IS NOT NULL AND vec_id % 100 NOT IN (11, 12)")
def p17(spark, sf):
    """Images that came without an error, are images by their first bytes, and are not blacklisted by their perceptual hash."""
    i = images(spark, sf)
    return i.where(M.valid_image(F.col("status"), F.col("data"), F.col("hash"), ["b", "c"])).select("id", M.image_kind(F.col("data")).alias("kind"))


@query("f20_image_scale", "SELECT l_orderkey AS id, l_linenumber AS k, CAST(CASE WHEN floor(l_extendedprice / 1000) > 10 THEN floor(sqrt(floor(floor(l_extendedprice / 1000) / 10))) + 1 ELSE 1 END AS INT) AS scale FROM lineitem")
def f20(spark, sf):
    """By what an image's sides are divided, by its size: here prices in thousands as megabytes."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), M.scale_of_size(F.floor(F.col("l_extendedprice") / 1000) * 1024 * 1024).alias("scale"))


@query("m6_logo_lookup", "SELECT vec_id AS id, 'logo ' || (vec_id % 4) AS value FROM embeddings WHERE vec_id % 4 < 3")
def m6(spark, sf):
    """Detections of images, asked for again until a round finds nothing new: each round some more are ready, a quarter never."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    ready = lambda missing, k: missing.where(F.col("id") % 4 == k).where(F.col("id") % 4 < 3).withColumn("value", F.concat(F.lit("logo "), (F.col("id") % 4).cast("string")))
    return K.until_no_progress(e, "id", ready)


@query("x27_translations", f"WITH {POSTS}, l AS (SELECT title AS t, min('t:' || md5(title)) AS tr FROM posts WHERE id % 3 > 0 GROUP BY title) SELECT id, CASE WHEN lang = 'en' THEN title ELSE coalesce(tr, '') END AS translated_title FROM posts LEFT JOIN l ON t = title")
def x27(spark, sf):
    """Titles in English: those that are, those whose translation is known, and empty texts."""
    p = posts(spark, sf)
    lookup = p.where("id % 3 > 0").select(F.col("title").alias("text"), F.concat(F.lit("t:"), F.md5(F.col("title").cast("binary"))).alias("translation"))
    return K.translated(p.select("id", "title", "lang"), lookup, ["title"], F.col("lang")).select("id", "translated_title")


@query("g20_resumable_map", "SELECT page_id AS id, CAST(length(html) AS INT) AS n FROM pages")
def g20(spark, sf):
    """A step over pages that breaks off after some parts and goes on with the others."""
    path = shared_folder(spark, "resumable")
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"), "html")
    step = lambda x: x.select("id", F.length("html").alias("n"))
    if K.resumable(p, "id", step, path, 4, at_most=2) is not None:
        raise RuntimeError("two of four parts are not all")
    return K.resumable(p, "id", step, path, 4)
