"""Queries of extraction and records over whole pages and documents; what pages lack is put around their own values."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.functions import extraction as X
from listwright.functions import text as T
from listwright.functions import urls as U
from listwright.operators import pages as G
from listwright.operators import records as R
from listwright.plans.dom import H1, CLEAN_H1, COUNT, LI, UNESCAPE
from listwright.plans.registry import query
from listwright.plans.views import table

NOW = "2024-05-06-07:08:09"
_HREFS = f"list_transform(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), lambda u: {UNESCAPE('u')})"
_ITEMS = f"regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', {{}})"
TIDY = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def pages(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")


#: A page of a shop around a page's number and heading; @N@ and @T@ are their places.
SHOP = """<html><head><title>Bag @N@</title><meta name="description" content="A bag of @N@"><link rel="canonical" href="https://s.example.com/p/@N@"><link rel="alternate" hreflang="fr" href="https://s.example.com/fr/p/@N@">
<script type="application/ld+json">{"name": "Bag @N@", "offers": {"price": "@N@.50", "currency": "EUR"}, "image": ["//i.example.com/@N@.jpg", "https://i.example.com/b.jpg"]}</script></head>
<body><h1 class="title big"> The  bag @N@ </h1><span class="price">EUR @N@.50 incl.</span><span id="date">03/02/2024</span><a class="seller" href="https://s.example.com/u/@N@?ref=x#a">Shop @N@</a>
<img class="pic" src="https://i.example.com/s_100/@N@.jpg?w=1"><img class="pic" src="https://i.example.com/s_100/@N@.jpg?w=1"><img class="pic" data-src="https://i.example.com/s_200/b.jpg" src="https://i.example.com/s_100/c.png">
<dl><dt>Size</dt><dd>M</dd><dt>Colour</dt><dd>Red @N@</dd><dt>Size</dt><dd>L@N@</dd><dt></dt><dd>none</dd></dl><p class="d">One @N@.</p><p class="d"></p><p class="d">Two.</p><div class="note">Own <b>inner</b></div></body></html>"""


def shop(spark, sf):
    n = F.col("page_id").cast("string")
    return pages(spark, sf).select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 10 == 9, "<html></html>").otherwise(F.replace(F.lit(SHOP), F.lit("@N@"), n)).alias("html"))


def over(columns: str, empty: str = "NULL") -> str:
    """SQL: expressions in n (the page's number as text) for pages with a shop, and what the others have."""
    parts = [c.rsplit(" AS ", 1) for c in columns.split(" ;; ")]
    gone = [e.strip() for e in empty.split(" ;; ")] if " ;; " in empty else [empty] * len(parts)
    cols = ", ".join(f"CASE WHEN page_id % 10 = 9 THEN {g} ELSE {x} END AS {a}" for (x, a), g in zip(parts, gone, strict=True))
    return f"SELECT page_id AS id, {cols} FROM (SELECT page_id, CAST(page_id AS VARCHAR) AS n FROM pages)"


@query("e1_attribute_values", f"SELECT page_id AS id, {CLEAN_H1} AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, nullif(regexp_extract(html, '<div class=\"(ad)\"', 1), '') AS ad FROM pages")
def e1(spark, sf):
    """The first element of plain selectors."""
    wanted = {"title": {"css_selector": "h1", "unescape": True}, "lang": {"css_selector": "html", "attribute_name": "lang"}, "ad": {"css_selector": "div.ad", "attribute_name": "class"}}
    return pages(spark, sf).select(F.col("page_id").alias("id"), *(X.field(F.col("html"), c).alias(n) for n, c in wanted.items()))


@query(
    "e1_selectors",
    rf"""SELECT page_id AS id, {UNESCAPE(_ITEMS.format(2) + '[1]')} AS first, {UNESCAPE(_ITEMS.format(1) + '[-1]')} AS last_href, {UNESCAPE(_ITEMS.format(2) + '[2]')} AS second, CAST(len({_ITEMS.format(1)}) AS INT) AS n_items, {TIDY.format(UNESCAPE("regexp_extract(html, '<div class=.ad.>([^<]*)</div>', 1)"))} AS ad, {CLEAN_H1} AS title, '' AS own, CAST({COUNT('meta')} AS INT) AS n_meta FROM pages WHERE len({_ITEMS.format(1)}) >= 2""",
)
def e1b(spark, sf):
    """Selectors with descendants, children, neighbours, places, commas and negation, over parsed pages; a text without its children's."""
    s = G.selected(pages(spark, sf).select(F.col("page_id").alias("id"), "html"), {
        "first": {"css_selector": "nav > ul li:first-child a"}, "last_href": {"css_selector": "body nav li:last-child > a[href]", "attribute_name": "href"}, "second": {"css_selector": "li:nth-child(2) a, li.none"}, "items": {"css_selector": "ul > li:not(.none)"},
        "ad": {"css_selector": "aside.none", "css_selector_2": "nav ~ div[class=ad]"}, "title": {"css_selector": "div.ad + article > h1"}, "own": {"css_selector": "li", "exclude_children": True}, "meta": {"css_selector": 'head meta[charset^="utf"]', "attribute_name": "charset"},
    })
    one = lambda c: F.try_element_at(c, F.lit(1)).alias(c)
    return s.where(F.size("items") >= 2).select("id", one("first"), one("last_href"), one("second"), F.size("items").alias("n_items"), one("ad"), one("title"), one("own"), F.size("meta").alias("n_meta"))


@query("e1_e2_configured_fields", over("'The bag ' || n AS title ;; n || '.50' AS price ;; '2024-02-03' AS day ;; 'https://s.example.com/u/' || n AS seller ;; 'Shop ' || n || '!' AS shop ;; 'Own' AS note"))
def e2(spark, sf):
    """Fields with a second selector, a pattern, a date format, an address in one form, an appended text, and without children."""
    p = shop(spark, sf)
    f = G.fields(p, {
        "title": {"css_selector": "h2.none", "css_selector_2": "h1.title"}, "price": {"css_selector": "span.price", "regex": r"[\d.]+"}, "day": {"css_selector": "body > span#date", "input_format": "dd/MM/yyyy", "output_format": "yyyy-MM-dd"},
        "seller": {"css_selector": "a.seller", "attribute_name": "href"}, "shop": {"css_selector": "a.seller", "append_text": "!"}, "note": {"css_selector": ".note", "exclude_children": True},
    })
    return f.withColumn("seller", U.clean_url(F.col("seller")))


@query("e3_e5_json_templates", over("'Bag ' || n || ': ' || n || '.50 EUR' AS offer ;; 'Bag ' || n AS name", "':  ' ;; NULL"))
def e3(spark, sf):
    h = F.col("html")
    return shop(spark, sf).select("id", X.json_template(h, '{jsons[0]["name"]}: {jsons[0]["offers"]["price"]} {jsons[0]["offers"]["currency"]}').alias("offer"), F.get_json_object(F.try_element_at(X.json_scripts(h), F.lit(1)), "$.name").alias("name"))


_A, _C, _B = "'https://i.example.com/s_100/' || n || '.jpg'", "'https://i.example.com/s_100/c.png'", "'https://i.example.com/s_200/b.jpg'"


@query(
    "e6_e20_pictures",
    over(f"{_A} || '?w=1 ' || {_C} AS plain ;; {_A} || ' ' || {_C} AS tail ;; replace({_A} || '?w=1 ' || {_C}, '100/', '900/') AS replaced ;; n || ' c' AS named ;; {_B} AS first_attr ;; {_A} || '?w=1' AS removed ;; {_A} || '?w=1 ' || {_A} || '?w=1 ' || {_C} AS repeated", "''"),
)
def e6(spark, sf):
    """Picture addresses with every option of the plain retrievers."""
    h = F.col("html")
    p = lambda **c: F.array_join(X.pictures(h, {"css_selector": "img.pic", **c}), " ")
    return shop(spark, sf).select(
        "id", p().alias("plain"), p(replace_tail="?").alias("tail"), p(replace_old_regex="s_100/", replace_new="s_900/").alias("replaced"), p(regex=r"/([a-z0-9]+)\.(?:jpg|png)").alias("named"),
        p(attribute_names=["data-src", "src"], first_attribute_wins=True).alias("first_attr"), p(remove_if_match_regex=r"\.png$", http_only=True).alias("removed"), p(distinct=False).alias("repeated"),
    )


def _states(spark, sf):
    """Links of a page as the pictures of the states that clicks lead to."""
    l = F.col("l")
    p = G.selected(pages(spark, sf).select(F.col("page_id").alias("id"), "html"), {"l": {"css_selector": "li a", "attribute_name": "href"}})
    return p.withColumn("states", F.array(F.slice(l, 1, 2), F.slice(l, 2, 2), F.slice(l, 2, 1), F.slice(l, 4, 2)))


_HIT = "list_filter(list_transform({}, lambda x: regexp_extract(x, '^/([a-z].*)$', 1)), lambda x: x <> '')"
_L = f"l AS (SELECT page_id AS id, list_transform({_ITEMS.format(1)}, lambda u: {UNESCAPE('u')}) AS l FROM pages)"


@query("e7_carousel", f"WITH {_L} SELECT id, array_to_string(list_sort(list_distinct(list_filter(l[1:4], lambda x: x <> ''))), ' ') AS pictures FROM l")
def e7(spark, sf):
    return _states(spark, sf).select("id", F.array_join(F.array_sort(R.carousel(F.slice("l", 1, 4))), " ").alias("pictures"))


@query("e14_popup", f"WITH {_L} SELECT id, array_to_string({_HIT.format('list_concat(l[1:2], l[1:2])')}, ' ') AS pictures FROM l")
def e14(spark, sf):
    """Pictures of a popup by a pattern, in order, repeated ones too."""
    return _states(spark, sf).select("id", F.array_join(R.matches(F.concat(F.slice("l", 1, 2), F.slice("l", 1, 2)), "^/([a-z].*)$"), " ").alias("pictures"))


@query("e15_popup_clicked_through", f"WITH {_L}, h AS (SELECT id, {_HIT.format('l[1:2]')} AS a, {_HIT.format('l[2:3]')} AS b, {_HIT.format('l[2:2]')} AS c, {_HIT.format('l[4:5]')} AS d FROM l), s AS (SELECT id, list_distinct(a) AS u1, list_distinct(list_concat(a, b)) AS u2, list_distinct(list_concat(a, b, c)) AS u3, list_distinct(list_concat(a, b, c, d)) AS u4 FROM h) SELECT id, array_to_string(list_sort(list_transform(CASE WHEN len(u1) = 0 OR len(u2) = len(u1) THEN u1 WHEN len(u3) = len(u2) THEN u2 ELSE u4 END, lambda x: replace(x, 'th', 'TH'))), ' ') AS pictures FROM s")
def e15(spark, sf):
    """Pictures over the states of a popup, until a state adds none; then a replacement over bytes."""
    p = R.clicked_through(F.col("states"), "^/([a-z].*)$", lambda x: T.replace_bytes(x, "th", "TH"))
    return _states(spark, sf).select("id", F.array_join(F.array_sort(p), " ").alias("pictures"))


@query("e17_thumbnails", f"WITH {_L} SELECT id, array_to_string(list_sort(list_distinct({_HIT.format('CASE WHEN id % 3 = 0 THEN l ELSE list_concat(l[1:2], l[2:3], l[2:2], l[4:5]) END')})), ' ') AS pictures FROM l")
def e17(spark, sf):
    """Pictures that clicks on thumbnails show; those of the page itself where there are no thumbnails."""
    s = F.when(F.col("id") % 3 == 0, F.array().cast("array<array<string>>")).otherwise(F.col("states"))
    return _states(spark, sf).select("id", F.array_join(F.array_sort(R.by_thumbnails(F.col("l"), s, "^/([a-z].*)$")), " ").alias("pictures"))


@query("e19_variants", f"WITH {_L} SELECT id, array_to_string(list_sort(list_distinct(l[1:5])), ' ') AS pictures FROM l")
def e19(spark, sf):
    return _states(spark, sf).select("id", F.array_join(F.array_sort(R.of_variants(F.col("states"))), " ").alias("pictures"))


@query("e11_e18_json_pictures", over("'https://i.example.com/' || n || '.jpg https://i.example.com/b.jpg' AS pictures"))
def e11(spark, sf):
    doc = F.try_element_at(X.json_scripts(F.col("html")), F.lit(1))
    return shop(spark, sf).select("id", F.nullif(F.array_join(X.json_pictures(doc, "$.image"), " "), F.lit("")).alias("pictures"))


@query("e21_e22_key_values", over("'L' || n AS size ;; 'Red ' || n AS colour ;; CAST(2 AS INT) AS n", "NULL ;; NULL ;; CAST(0 AS INT)"))
def e21(spark, sf):
    m = X.key_values(F.col("html"), {"key_selector": "dt", "value_selector": "dd"})
    return shop(spark, sf).select("id", F.try_element_at(m, F.lit("Size")).alias("size"), F.try_element_at(m, F.lit("Colour")).alias("colour"), F.size(F.map_keys(m)).alias("n"))


@query("e24_alternates_and_meta", over("'A bag of ' || n AS description ;; 'https://s.example.com/p/' || n || ' https://s.example.com/fr/p/' || n AS urls", "NULL ;; ''"))
def e24(spark, sf):
    h = F.col("html")
    return shop(spark, sf).select("id", X.meta(h, "description").alias("description"), F.array_join(X.alternates(h), " ").alias("urls"))


_LIST = f"""l AS (SELECT page_id, url, unnest({LI.format(1)}) AS h, unnest({LI.format(2)}) AS t, unnest(range(1, len({LI.format(1)}) + 1)) AS i FROM pages), i AS (SELECT page_id, url, i, {UNESCAPE('t')} AS t, regexp_extract({UNESCAPE('h')}, '^/([A-Za-z].*)$', 1) AS id FROM l),
f AS (SELECT page_id, any_value(url) AS url, id, min(i) AS i, arg_min(t, i) AS t FROM i WHERE id <> '' AND id NOT IN ('the', 'and') GROUP BY page_id, id), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM f)"""


@query("e25_listing_records", f"WITH {_LIST} SELECT page_id, id, CASE WHEN page_id % 4 > 0 THEN 'FRANCE' END AS organisation, '{NOW}' AS scraping_time, 'https://s.example.com/p/' || id || '/x' AS url, t AS title, left(t, 3) AS price, '/' || id AS poster_link, NULL AS location, NULL AS description, CAST(1 AS INT) AS pictures, url AS search_url, CAST(page_id % 5 AS INT) AS loaded_page, CAST(k AS INT) AS index_on_page, 'search_query:q' || page_id AS tag, 21 AS fields FROM r WHERE k <= 5")
def e25(spark, sf):
    """Records of the listings on each page with all their fields: known ones, repeated ones and those without identifier left out, five a page."""
    n = F.col("page_id")
    p = pages(spark, sf).select("page_id", "html", F.col("url").alias("search_url"), F.concat(F.lit("q"), n.cast("string")).alias("search_query"), F.when(n % 4 > 0, "FRANCE").alias("organisation_name"), (n % 5).cast("int").alias("loaded_page"))
    config = {
        "container": "ul > li", "identifier": {"css_selector": "a", "attribute_name": "href", "regex": "^/([A-Za-z].*)$"}, "url_template": "https://s.example.com/p/{}/x",
        "fields": {"title": {"css_selector": "a"}, "price": {"css_selector": "a", "regex": "^.{0,3}"}, "poster_link": {"css_selector": "a[href]", "attribute_name": "href"}, "location": {"css_selector": "i.place"}}, "lists": {"pictures": {"css_selector": "a", "attribute_name": "href"}},
    }
    r = R.listing_records(p, config, spark.createDataFrame([("the",), ("and",)], "id string"), F.lit(NOW), 5)
    names = len(r.columns) - 1
    return r.select("page_id", "id", F.try_element_at("organisation_names", F.lit(1)).alias("organisation"), "scraping_time", "url", "title", "price", "poster_link", "location", "description", F.size("pictures").alias("pictures"), "search_url", "loaded_page", "index_on_page", F.element_at("tags", 1).alias("tag"), F.lit(names).alias("fields"))


@query("e26_detail_records", f"SELECT page_id AS id, url, '{NOW}' AS scraping_time, {CLEAN_H1} AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS location, {UNESCAPE(_ITEMS.format(2) + '[1]')} AS vendor, NULL AS price, CAST(1 AS INT) AS pictures, 18 AS fields FROM pages WHERE {CLEAN_H1} <> '' AND page_id % 3 > 0")
def e26(spark, sf):
    """Records of listings from their own pages, with all fields; pages without title or without a kept picture give none."""
    n = F.col("page_id")
    image = F.array(F.struct(F.lit("i.jpg").alias("picture_url"), F.when(n % 3 > 0, F.lit("s3://b/i")).alias("s3_url")))
    none = F.array().cast("array<string>")
    p = pages(spark, sf).select(n.alias("id"), "url", "html", F.lit("FRANCE").alias("organisation_name"), none.alias("alternate_links"), none.alias("videos"), F.lit(None).cast("string").alias("archive_link"), image.alias("images"))
    r = R.detail_records(p, {"title": {"css_selector": "article > h1"}, "description": {"css_selector": "p.none"}, "location": {"css_selector": "html", "attribute_name": "lang"}, "vendor": {"css_selector": "nav li:first-child"}}, "images", F.lit(NOW))
    return r.select("id", "url", "scraping_time", "title", "location", "vendor", "price", F.size("pictures").alias("pictures"), F.lit(len(r.columns)).alias("fields"))


@query("e27_poster_records", f"SELECT page_id AS id, url, {CLEAN_H1} AS name, CAST(page_id AS VARCHAR) AS followers_count, CASE WHEN page_id % 2 = 0 THEN 'pic' ELSE '' END AS profile_pic_url, NULL AS payload, 9 AS fields FROM pages")
def e27(spark, sf):
    n = F.col("page_id")
    h = F.replace("html", F.lit("<article>"), F.concat(F.lit('<article><i class="followers">'), n.cast("string"), F.lit(" followers</i>")))
    p = pages(spark, sf).select(n.alias("id"), "url", h.alias("html"), F.lit(None).cast("string").alias("archive_link"), F.when(n % 2 == 0, F.array(F.lit("pic"))).otherwise(F.array().cast("array<string>")).alias("pictures"))
    r = R.poster_records(p, {"name": {"css_selector": "article h1"}, "followers_count": {"css_selector": "i.followers", "regex": r"\d+"}}, "pictures", F.lit(NOW))
    return r.select("id", "url", "name", "followers_count", "profile_pic_url", "payload", F.lit(len(r.columns)).alias("fields"))


@query("e28_image_uploads", f"WITH {_L}, e AS (SELECT id, unnest(list_distinct(l)) AS u FROM l) SELECT id, count(*) AS pictures, count(CASE WHEN u LIKE '/t%' THEN 1 END) AS kept, min(CASE WHEN u LIKE '/t%' THEN 's3:' || u END) AS first FROM e GROUP BY id")
def e28(spark, sf):
    """Distinct pictures of each record, looked up once in what has been kept."""
    p = G.selected(pages(spark, sf).select(F.col("page_id").alias("id"), "html"), {"l": {"css_selector": "li a", "attribute_name": "href"}})
    known = p.select(F.explode("l").alias("picture_url")).where(F.col("picture_url").startswith("/t")).withColumn("s3_url", F.concat(F.lit("s3:"), "picture_url"))
    r = R.with_uploads(p, "l", known).where("uploads is not null")
    kept = F.filter(F.transform("uploads", lambda u: u["s3_url"]), lambda s: s.isNotNull())
    return r.select("id", F.size("uploads").cast("long").alias("pictures"), F.size(kept).cast("long").alias("kept"), F.array_min(kept).alias("first"))


@query("x37_shortcodes", "SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN 'c' || page_id END AS code, CASE WHEN page_id % 2 = 0 THEN 'p' ELSE 'user' || page_id END AS username FROM pages")
def x37(spark, sf):
    """Short codes and user names in addresses of posts and profiles."""
    n = F.col("page_id").cast("string")
    u = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://www.instagram.com/p/c"), n, F.lit("/?x=1"))).otherwise(F.concat(F.lit("https://www.instagram.com/user"), n, F.lit("/")))
    return pages(spark, sf).select(F.col("page_id").alias("id"), U.shortcode(u).alias("code"), U.username(u).alias("username"))


@query(
    "x38_two_json_shapes",
    """SELECT doc_id AS id, 's' || doc_id AS shortcode, doc_id % 3 = 0 AS is_video, doc_id % 5 = 0 AS is_clip, CASE WHEN doc_id % 4 = 0 THEN 'a' || doc_id || ' b' ELSE 'a' || doc_id END AS pictures, CAST(doc_id % 50 AS VARCHAR) AS owner_id, 'u' || doc_id % 50 AS owner, CAST(doc_id % 1000 AS BIGINT) AS followers, CASE WHEN doc_id % 3 = 0 THEN 'v' || doc_id ELSE '' END AS video_url,
1700000000 + doc_id AS published, md5(coalesce(text, '')) AS caption, CAST(doc_id % 77 AS BIGINT) AS likes, 'w' || doc_id % 9 || ':' || coalesce(lang, '') AS comment FROM documents""",
)
def x38(spark, sf):
    """Documents as posts, every other one in another shape of the API's answer, brought into one form."""
    n, s = F.col("doc_id"), F.col("doc_id").cast("string")
    st, lit = F.struct, F.lit
    name = lambda x: F.concat(lit("u"), (x % 50).cast("string"))
    pics = [F.concat(lit("a"), s), lit("b")]
    video, note, who = F.when(n % 3 == 0, F.concat(lit("v"), s)), F.coalesce("lang", lit("")), F.concat(lit("w"), (n % 9).cast("string"))
    kind = F.when(n % 5 == 0, "clips").otherwise("feed")
    edge = lambda x, a: st(F.array(st(st(x.alias(a)).alias("node"))).alias("edges"))
    v1 = st(
        F.concat(lit("s"), s).alias("shortcode"), (n % 3 == 0).alias("is_video"), kind.alias("product_type"), pics[0].alias("display_url"), F.when(n % 4 == 0, st(F.array(*(st(st(p.alias("display_url")).alias("node")) for p in pics)).alias("edges"))).alias("edge_sidecar_to_children"),
        st((n % 50).cast("string").alias("id"), name(n).alias("username"), st((n % 1000).alias("count")).alias("edge_followed_by")).alias("owner"), video.alias("video_url"), (n + 1700000000).alias("taken_at_timestamp"), F.when(F.col("text") != "", edge(F.col("text"), "text")).otherwise(st(F.array().cast("array<struct<node: struct<text: string>>>").alias("edges"))).alias("edge_media_to_caption"),
        st((n % 77).alias("count")).alias("edge_media_preview_like"), st(F.array(st(st(st(who.alias("username")).alias("owner"), note.alias("text")).alias("node"))).alias("edges")).alias("edge_media_to_parent_comment"),
    )
    image = lambda p: st(st(F.array(st(p.alias("url"))).alias("candidates")).alias("image_versions2"))
    v2 = st(
        F.concat(lit("s"), s).alias("code"), F.when(n % 3 == 0, 2).otherwise(1).alias("media_type"), kind.alias("product_type"), st(F.array(st(pics[0].alias("url"))).alias("candidates")).alias("image_versions2"), F.when(n % 4 == 0, F.array(*(image(p) for p in pics))).alias("carousel_media"),
        st((n % 50).cast("string").alias("pk"), name(n).alias("username"), (n % 1000).alias("follower_count")).alias("user"), F.when(n % 3 == 0, F.array(st(video.alias("url")))).alias("video_versions"), (n + 1700000000).alias("taken_at"), F.when(F.col("text") != "", st(F.col("text").alias("text"))).alias("caption"), (n % 77).alias("like_count"),
        F.array(st(note.alias("text"), st(who.alias("username")).alias("user"))).alias("comments"),
    )
    p = R.social_posts(table(spark, sf, "documents").select(n.alias("id"), F.when(n % 2 == 0, F.to_json(v1)).otherwise(F.to_json(v2)).alias("doc"))).select("id", "post.*")
    first = F.try_element_at("comments", F.lit(1))
    return p.select("id", "shortcode", "is_video", "is_clip", F.array_join("pictures", " ").alias("pictures"), "owner_id", "owner", "followers", "video_url", F.unix_timestamp("published").alias("published"), F.md5(F.col("caption").cast("binary")).alias("caption"), "likes", F.concat(first["username"], F.lit(":"), first["text"]).alias("comment"))
