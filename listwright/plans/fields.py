"""Queries of small operators over fields of given records: pictures, kinds of posts, tags, colours, routes, hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.functions import hashes as H
from listwright.functions import text as T
from listwright.functions.extraction import any_flag, picture_urls, post_type
from listwright.operators import feature_set as FS
from listwright.operators.routing import result_routes
from listwright.plans.registry import query
from listwright.plans.views import table

_J = "c AS (SELECT click_id, CASE WHEN json_valid(props) THEN props END AS p, kind FROM clicks)"


@query("f12_f8_images", f"""WITH {_J.replace('SELECT', 'SELECT DISTINCT', 1)}, i AS (SELECT click_id, p, unnest(CAST(p->'$.items' AS JSON[])) AS i, generate_subscripts(CAST(p->'$.items' AS JSON[]), 1) AS k FROM c) SELECT click_id AS id, array_to_string(list(coalesce(i->>'$.sku', i->>'$.qty') ORDER BY k), ',') AS pictures, CASE WHEN count(CASE WHEN CAST(i->>'$.qty' AS BIGINT) > 5 THEN 1 END) > 0 THEN true WHEN count(CASE WHEN i->>'$.qty' IS NULL THEN 1 END) > 0 THEN NULL ELSE false END AS logo FROM i GROUP BY click_id, p""")
def f12(spark, sf):
    """Pictures of a record in one form, whatever names their fields have, and whether one of them is flagged: the items of clicks stand for them."""
    c = table(spark, sf, "clicks").select("click_id", "props").distinct()
    pictures = F.get_json_object("props", "$.items")
    flags = F.from_json(pictures, "array<struct<qty: long>>")
    x = c.select(F.col("click_id").alias("id"), picture_urls(pictures, ["sku", "qty"]).alias("p"), any_flag(F.transform(flags, lambda i: i["qty"] > 5)).alias("logo")).where("size(p) > 0")
    return x.select("id", F.array_join("p", ",").alias("pictures"), "logo")


@query("x36_post_type", f"WITH {_J} SELECT click_id AS id, CASE WHEN json_array_length(p->'$.items') > 1 THEN 'carousel' WHEN p->>'$.device.os' = 'ios' THEN 'clip' WHEN p->>'$.device.ver' IS NOT NULL THEN 'video' ELSE 'image' END AS kind FROM c")
def x36(spark, sf):
    """The kind of a post by its children, its product and whether it has a video."""
    g = lambda path: F.get_json_object("props", path)
    return table(spark, sf, "clicks").select(F.col("click_id").alias("id"), post_type(F.json_array_length(g("$.items")), g("$.device.os"), g("$.device.ver"), "ios").alias("kind"))


@query("p21_z6_tag_algebra", f"WITH {_J}, t AS (SELECT click_id, CAST(p->'$.tags' AS VARCHAR[]) AS t FROM c) SELECT click_id AS id, coalesce(len(list_intersect(t, ['a', 'b'])) > 0 AND len(list_intersect(t, ['c'])) = 0, false) AS chosen FROM t")
def p21(spark, sf):
    """Records that have one of some tags and none of others."""
    tags = F.from_json(F.get_json_object("props", "$.tags"), "array<string>")
    return table(spark, sf, "clicks").select(F.col("click_id").alias("id"), FS.tags_selected(tags, {"a", "b"}, {"c"}).alias("chosen"))


@query("x25_rgba", "SELECT item_id AS id, CASE WHEN item_id % 3 < 2 THEN round((item_id % 256) / 255.0::DOUBLE, 9) END AS r, CASE WHEN item_id % 3 < 2 THEN round((size * 4 % 256) / 255.0::DOUBLE, 9) END AS b, CASE item_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN round((item_id % 10) / 10.0::DOUBLE, 9) END AS a FROM items WHERE size IS NOT NULL")
def x25(spark, sf):
    """Colours of styles; here made of items, a third of them by name."""
    n = F.col("item_id")
    rgb = F.concat_ws(", ", (n % 256).cast("string"), F.lit("17"), (F.col("size") * 4 % 256).cast("string"))
    css = F.when(n % 3 == 0, F.concat(F.lit("rgb("), rgb, F.lit(")"))).when(n % 3 == 1, F.concat(F.lit("rgba("), rgb, F.lit(", "), ((n % 10) / 10).cast("string"), F.lit(")"))).otherwise(F.col("brand"))
    x = table(spark, sf, "items").where("size is not null").select(n.alias("id"), T.rgba(css).alias("v"))
    return x.select("id", *(F.round(F.col("v")[k], 9).alias(c) for k, c in ((0, "r"), (2, "b"), (3, "a"))))


@query("g21_result_routing", r"WITH p AS (SELECT page_id, url, html LIKE '%<img%' AS pics, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS d FROM pages), t AS (SELECT d, count(*) AS n FROM p GROUP BY d) SELECT page_id AS id, CASE WHEN NOT pics THEN 'no_pictures' WHEN regexp_matches(url, '/5|\?page=') THEN 'blacklisted' WHEN n > 1 THEN 'recrawl' ELSE 'insertion' END AS route FROM p JOIN t USING (d)")
def g21(spark, sf):
    """Routes of scraped pages: without pictures, at a blacklisted address, of a tracked domain (here one with several pages), or to be inserted."""
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url", F.contains("html", F.lit("<img")).alias("pics"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("domain"))
    tracked = p.groupBy("domain").agg(F.count("*").alias("n")).where("n > 1").select("domain")
    return result_routes(p, F.col("pics"), F.col("url"), [r"/5", r"\?page="], tracked, "domain").select("id", "route")


_C = "[" + ", ".join("[" + ", ".join(f"cos(pi() * {u} * {2 * x + 1} / 16)" for x in range(8)) + "]" for u in range(8)) + "]"


@query("f14_perceptual_hash", f"WITH e AS (SELECT vec_id, embedding AS e, {_C} AS c FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0), k AS (SELECT vec_id, list_transform(range(0, 64), lambda f: round(list_sum(list_transform(range(0, 64), lambda i: e[i + 1]::DOUBLE * c[f // 8 + 1][i // 8 + 1] * c[f % 8 + 1][i % 8 + 1])) / 64, 6)) AS k FROM e), m AS (SELECT vec_id, k, (list_sort(k)[32] + list_sort(k)[33]) / 2 AS m FROM k) SELECT vec_id AS id, array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN k[64 - i] > m THEN '1' ELSE '0' END), '') AS bits FROM m")
def f14(spark, sf):
    """Perceptual hashes of grey pictures by the low frequencies of their cosine transform; here vectors as pictures of 8 by 8 pixels."""
    e = table(spark, sf, "embeddings").where((F.size("embedding") == 64) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    return e.select(F.col("vec_id").alias("id"), F.lpad(F.bin(H.perceptual_hash(F.col("embedding"), 8, 8)), 64, "0").alias("bits"))
