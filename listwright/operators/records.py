"""Records of listings, posters and posts, assembled from saved pages and API answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.functions import tree as T
from listwright.functions.extraction import _finish
from listwright.operators.pages import fields, over_pages

#: Fields of a listing on a search page that selectors give; pictures and videos are lists.
LISTING_FIELDS = ("location", "title", "price", "vendor", "poster_link", "item_sold")
LISTING_LISTS = ("pictures", "videos")
DETAIL_FIELDS = ("title", "description", "price", "stock_count", "vendor", "poster_link", "posting_time", "location", "ships_from", "ships_to")
POSTER_FIELDS = ("name", "followers_count", "description", "payload")


# --- pictures that show up step by step: each step is a saved state of the page -------------------------------------------


def matches(values: Column, pattern: str) -> Column:
    """Group 1 of the pattern in each value that it matches, in order, repeated ones too."""
    return F.transform(F.filter(values, lambda v: v.rlike(pattern)), lambda v: F.regexp_extract(v, pattern, 1))


def carousel(values: Column) -> Column:
    """What a carousel shows: each value that is not empty once."""
    return F.array_distinct(F.filter(values, lambda v: v != ""))


def clicked_through(states: Column, pattern: str, replace: Callable[[Column], Column] | None = None) -> Column:
    """Pictures of a popup that is clicked through: the union over its states (an array of arrays of values) up to the first that adds none.

    replace is applied at the end, and may make pictures equal. Null for a page without states.
    """
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("on"))

    def step(acc: Column, values: Column) -> Column:
        more = F.array_union(acc["p"], matches(values, pattern))
        return F.when(acc["on"], F.struct(more.alias("p"), (F.size(more) > F.size(acc["p"])).alias("on"))).otherwise(acc)

    found = F.aggregate(states, start, step)["p"]
    return F.when(states.isNotNull(), F.transform(found, replace) if replace else found)


def by_thumbnails(page: Column, states: Column, pattern: str) -> Column:
    """The pictures that clicks on thumbnails show, each once; those of the page itself if there are no thumbnails."""
    return F.array_distinct(matches(F.when(F.size(states) > 0, F.flatten(states)).otherwise(page), pattern))


def of_variants(variants: Column) -> Column:
    """The pictures of all variants of a listing, each once."""
    return F.array_distinct(F.flatten(variants))


# --- search pages ---------------------------------------------------------------------------------------------------------


def listing_records(pages: DataFrame, config: dict, known: DataFrame, scraping_time: Column, max_results: int | None = None) -> DataFrame:
    """Records of the listings on search pages, with all fields of a listing.

    pages: page_id, html, search_url, search_query, organisation_name, loaded_page. config: container (selector of a listing), identifier (selector,
    attribute and regex), url_template, fields and lists (selector and options by field). Listings without identifier, known ones (id) and
    repeated ones of a page are left out; places on the page count what is left; at most max_results of a page.
    """
    wanted = {f: c for f, c in config.get("fields", {}).items() if f in LISTING_FIELDS}
    lists = {f: c for f, c in config.get("lists", {}).items() if f in LISTING_LISTS}
    ident = config["identifier"]
    for c in (config["container"], ident["css_selector"], *(x["css_selector"] for x in (*wanted.values(), *lists.values()))):
        T.parse_selector(c)

    def rows(tree, **page):
        for place, k in enumerate(tree.select(config["container"])):
            row = page | {"place": place}

            def of(c, k=k):
                at = [k] if k in set(tree.select(c["css_selector"])) else tree.select(c["css_selector"], k)
                return [v for x in at if (v := tree.value(x, c.get("attribute_name", "text"), c.get("exclude_children", False))) is not None]

            row["id"] = next(iter(of(ident)), None)
            row |= {f: next(iter(of(c)), None) for f, c in wanted.items()} | {f: of(c) for f, c in lists.items()}
            yield row

    page = pages.select("page_id", "html", "search_url", "search_query", "organisation_name", "loaded_page")
    schema = "page_id long, search_url string, search_query string, organisation_name string, loaded_page int, place int, id string, " + ", ".join([*(f"{f} string" for f in wanted), *(f"{f} array<string>" for f in lists)])
    found = over_pages(page, schema.rstrip(", "), rows)
    found = found.withColumn("id", F.nullif(_finish(F.col("id"), {k: v for k, v in ident.items() if k in ("regex", "replace_old", "replace_new")}), F.lit(""))).where("id is not null")
    found = found.withColumns({f: _finish(F.col(f), c) for f, c in wanted.items()}).join(known.select("id"), "id", "left_anti")
    first = found.groupBy("page_id", "id").agg(F.min(F.struct("place", *(c for c in found.columns if c not in ("page_id", "id", "place")))).alias("x")).select("page_id", "id", "x.*")
    # a page is one document, so its listings are a bounded group
    first = first.withColumn("index_on_page", F.row_number().over(Window.partitionBy("page_id").orderBy("place")))
    if max_results:
        first = first.where(F.col("index_on_page") <= max_results)
    text = lambda f: (F.col(f) if f in first.columns else F.lit(None).cast("string")).alias(f)
    before, _, after = config["url_template"].partition("{}")
    none = lambda f: F.lit(None).cast("string").alias(f)
    return first.select(
        "page_id", F.when(F.coalesce("organisation_name", F.lit("")) != "", F.array("organisation_name")).otherwise(F.array().cast("array<string>")).alias("organisation_names"), "id", scraping_time.alias("scraping_time"), F.concat(F.lit(before), "id", F.lit(after)).alias("url"),
        *(none(f) for f in ("archive_link", "description", "posting_time", "ships_from", "ships_to")), *(text(f) for f in LISTING_FIELDS),
        *((F.col(f) if f in first.columns else F.array().cast("array<string>")).alias(f) for f in LISTING_LISTS), "search_url", "loaded_page", "index_on_page", F.array(F.concat(F.lit("search_query:"), F.coalesce("search_query", F.lit("")))).alias("tags"),
    )


# --- pages of listings and posters ----------------------------------------------------------------------------------------


def _assembled(pages: DataFrame, config: dict[str, dict], names: tuple[str, ...]) -> DataFrame:
    found = fields(pages, {f: c for f, c in config.items() if f in names})
    return found.withColumns({f: F.lit(None).cast("string") for f in names if f not in config})


def detail_records(pages: DataFrame, config: dict[str, dict], pictures: str, scraping_time: Column) -> DataFrame:
    """Records of listings from their own pages: all fields; a page with neither title nor description, or without pictures, gives none.

    pages: id, url, html, organisation_name, alternate_links, videos, archive_link, and an array of pictures (struct<picture_url, s3_url>), of which one at least must have been kept.
    """
    r = _assembled(pages, config, DETAIL_FIELDS)
    some = (F.coalesce("title", F.lit("")) != "") | (F.coalesce("description", F.lit("")) != "")
    r = r.where(some & F.coalesce(F.exists(pictures, lambda p: p["s3_url"].isNotNull()), F.lit(False)))
    org = F.when(F.coalesce("organisation_name", F.lit("")) != "", F.array("organisation_name")).otherwise(F.array().cast("array<string>"))
    return r.select(org.alias("organisation_names"), "id", scraping_time.alias("scraping_time"), "url", *DETAIL_FIELDS, F.col(pictures).alias("pictures"), "videos", "archive_link", "alternate_links")


def poster_records(pages: DataFrame, config: dict[str, dict], pictures: str, scraping_time: Column) -> DataFrame:
    """Records of posters: all fields; the profile picture is the first of the pictures, or empty. pages: id, url, html, archive_link, and an array of pictures."""
    r = _assembled(pages, config, POSTER_FIELDS)
    return r.select("id", "url", scraping_time.alias("scraping_time"), "archive_link", "name", "followers_count", "description", F.coalesce(F.try_element_at(pictures, F.lit(1)), F.lit("")).alias("profile_pic_url"), "payload")


def with_uploads(records: DataFrame, pictures: str, uploaded: DataFrame, key: str = "id") -> DataFrame:
    """records with `uploads`: its distinct pictures in order, each with where it was kept (null if it was not).

    uploaded: picture_url, s3_url. Each address is looked up once however many records have it.
    """
    each = records.select(key, F.posexplode(F.array_distinct(pictures)).alias("place", "picture_url"))
    kept = each.select("picture_url").distinct().join(uploaded.groupBy("picture_url").agg(F.min("s3_url").alias("s3_url")), "picture_url", "left")
    lists = each.join(kept, "picture_url").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "picture_url", "s3_url"))).alias("u"))
    lists = lists.select(F.col(key).alias("_key"), F.transform("u", lambda x: F.struct(x["picture_url"], x["s3_url"])).alias("uploads"))
    return records.join(lists, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


# --- posts in two shapes of an API's answers ------------------------------------------------------------------------------


def social_posts(answers: DataFrame, doc: str = "doc") -> DataFrame:
    """answers with `post`: one form of a post's JSON in the shape with edges or the flat one.

    Missing parts are null; a missing caption is empty. Of a series of pictures all are taken, else the single one.
    """
    v = F.try_parse_json(doc)
    get = lambda kind, *paths: F.coalesce(*(F.try_variant_get(v, p, kind) for p in paths))
    edges = "array<struct<node: struct<display_url: string, text: string, owner: struct<username: string>>>>"
    media = "array<struct<image_versions2: struct<candidates: array<struct<url: string>>>>>"
    side, series = get(edges, "$.edge_sidecar_to_children.edges"), get(media, "$.carousel_media")
    one = F.array_compact(F.array(get("string", "$.display_url", "$.image_versions2.candidates[0].url")))
    pictures = F.when(F.size(side) > 0, F.transform(side, lambda e: e["node"]["display_url"])).when(F.size(series) > 0, F.transform(series, lambda m: m["image_versions2"]["candidates"][0]["url"])).otherwise(one)
    flat = "array<struct<text: string, user: struct<username: string>>>"
    comments = F.coalesce(F.transform(get(edges, "$.edge_media_to_parent_comment.edges"), lambda e: F.struct(e["node"]["owner"]["username"].alias("username"), e["node"]["text"].alias("text"))), F.transform(get(flat, "$.comments"), lambda c: F.struct(c["user"]["username"].alias("username"), c["text"].alias("text"))))
    post = F.struct(
        get("string", "$.shortcode", "$.code").alias("shortcode"), F.coalesce(get("boolean", "$.is_video"), get("int", "$.media_type") == 2).alias("is_video"), F.coalesce(get("string", "$.product_type") == "clips", F.lit(False)).alias("is_clip"), pictures.alias("pictures"),
        get("string", "$.owner.id", "$.user.pk").alias("owner_id"), get("string", "$.owner.username", "$.user.username").alias("owner"), get("long", "$.owner.edge_followed_by.count", "$.user.follower_count").alias("followers"), F.coalesce(get("string", "$.video_url", "$.video_versions[0].url"), F.lit("")).alias("video_url"),
        F.timestamp_seconds(get("long", "$.taken_at_timestamp", "$.taken_at")).alias("published"), F.coalesce(get("string", "$.edge_media_to_caption.edges[0].node.text", "$.caption.text"), F.lit("")).alias("caption"), get("long", "$.edge_media_preview_like.count", "$.like_count").alias("likes"), comments.alias("comments"),
    )
    return answers.withColumn("post", post)
