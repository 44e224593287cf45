"""Routing of addresses and worker messages, validation of required fields, steps that fail open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.session import shared_table

SEARCH, POST, POSTER = "SEARCH", "POST", "POSTER"


def keyword_list(c: Column) -> Column:
    """Keywords of a comma-separated text, blanks kept; no keywords for null."""
    return F.coalesce(F.split(c, ","), F.array().cast("array<string>"))


def prefix(template: Column) -> Column:
    """What a template has before its first place; the whole template without one."""
    return F.when(F.contains(template, F.lit("{}")), F.substring_index(template, "{", 1)).otherwise(template)


def page_type(pages: DataFrame, config: DataFrame) -> DataFrame:
    """pages (url, domain) with `page_type` by the domain's templates: a search page, else a listing, else a poster; null if none fits.

    config: domain, search_templates (array), post_template, poster_template; a template of a place alone fits no poster. On
    instagram.com the address itself tells.
    """
    c = config.select("domain", F.filter(F.transform("search_templates", prefix), lambda p: p != "").alias("_s"), prefix(F.col("post_template")).alias("_p"), F.when(F.col("poster_template") != "{}", prefix(F.col("poster_template"))).alias("_u"))
    url = F.col("url")
    fits = F.when(F.coalesce(F.exists("_s", lambda p: F.contains(url, p)), F.lit(False)), SEARCH).when(F.contains(url, F.col("_p")), POST).when(F.contains(url, F.col("_u")), POSTER)
    own = F.when(F.contains(url, F.lit("/p/")), POST).when(F.contains(url, F.lit("_search")), SEARCH).otherwise(POSTER)
    return pages.join(c, "domain", "left").withColumn("page_type", F.when(F.col("domain") == "instagram.com", own).otherwise(fits)).drop("_s", "_p", "_u")


#: Routes of tasks: (what decides: config_file, domain or framework; its value; the scraping type it asks for, if any; module; source). The first that fits counts.
ROUTES = [
    ("config_file", "market.api", None, "APIScraper", "MARKET_API"), ("domain", "instagram.com", None, "InstagramScraper", "INSTAGRAM_API"), ("domain", "facebook.com", "POST_SEARCH_COMPLETE", "FacebookScraper", "API_SCRAPER"),
    ("framework", "API", None, "APIScraper", "API_SCRAPER"), ("framework", "API_SELENIUM", None, "APIMarketplaceScraper", "API_SCRAPER"),
]
OTHERS = ("MarketplaceScraper", "SPECIFIC_SCRAPER")


def scraper(domain: Column, scraping_type: Column, config_file: Column, framework: Column, routes: list[tuple] | None = None) -> Column:
    """The module and the source name for a task: struct<module, source>, by a table of routes."""
    pick = lambda m, s: F.struct(F.lit(m).alias("module"), F.lit(s).alias("source"))
    by = {"config_file": config_file, "domain": domain, "framework": framework}
    out = F
    for what, value, kind, module, source in routes or ROUTES:
        fits = by[what] == value
        out = out.when(fits if kind is None else fits & (scraping_type == kind), pick(module, source))
    return out.otherwise(pick(*OTHERS))


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def worker_params(messages: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """messages with `error` (null if the message can be worked on) and the parameters that are worked out.

    messages: url, domain_name, page_type, post_identifier, username, upload_id, and the columns of defaults, all of which may be null; and
    the domain's post_url_template and post_regex (joined before). Added: domain, scraping_type, post_url, identifier, and the
    defaults where a column is null.
    """
    host = F.regexp_extract("url", r"^https?://(?:www\.)?([^/?#:]+)", 1)
    domain = F.coalesce(_some(F.col("domain_name")), _some(host))
    insta = domain == "instagram.com"
    url = F.coalesce(_some(F.col("url")), F.replace("post_url_template", F.lit("{}"), F.col("post_identifier")))
    code = F.coalesce(_some(F.col("post_identifier")), F.when(insta, _some(F.regexp_extract(url, r"/p/([^/]*)", 1))).otherwise(F.when(F.col("post_regex").isNotNull(), _some(F.call_function("regexp_extract", url, F.col("post_regex"), F.lit(1))))))
    user = F.coalesce(_some(F.col("username")), F.when(insta, _some(F.regexp_extract("url", r"instagram\.com/([^/]*)", 1))))
    kind = F.col("page_type")
    error = (
        F.when(domain.isNull(), "no domain")
        .when(kind.isNull(), "no page_type")
        .when(~kind.isin(POST, POSTER), F.concat(F.lit("page_type "), kind))
        .when((kind == POST) & url.isNull(), "no address")
        .when((kind == POST) & code.isNull(), "no identifier")
        .when((kind == POSTER) & insta & user.isNull(), "no username")
        .when((kind == POSTER) & ~insta & _some(F.col("url")).isNull(), "no address")
    )
    out = messages.withColumns({"domain": domain, "error": error, "scraping_type": F.when(kind == POST, "POST_SCRAPE_FROM_LIST").when(kind == POSTER, "POSTER_SEARCH"), "post_url": F.when(kind == POST, url).otherwise(F.col("url")), "identifier": F.when(kind == POST, code).when((kind == POSTER) & insta, user).when(kind == POSTER, _some(F.col("url")))})
    return out.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in defaults.items()})


def filled(c: Column, kind: str) -> Column:
    """Neither null nor empty, zero or false."""
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if kind == "string":
        return F.coalesce(c != "", F.lit(False))
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    return F.coalesce(c != 0, F.lit(False)) if kind in ("int", "bigint", "double", "float") else c.isNotNull()


def complete_posts(posts: DataFrame, flags: dict[str, str], minimal: bool = False) -> DataFrame:
    """Listings with an address, a time, and the fields that their website requires (flags: field by the column that requires it).

    minimal: only pictures are required besides (for listings that were asked for).
    """
    kinds = dict(posts.dtypes)
    keep = filled(F.col("url"), kinds["url"]) & filled(F.col("scraping_time"), kinds["scraping_time"])
    if minimal:
        return posts.where(keep & filled(F.col("pictures"), kinds["pictures"]))
    for field, flag in flags.items():
        keep = keep & (~F.coalesce(F.col(flag), F.lit(False)) | filled(F.col(field), kinds[field]))
    return posts.where(keep)


def complete_posters(posters: DataFrame) -> DataFrame:
    """Posters with an address and at least one of description, picture, payload, name and number of followers."""
    kinds = dict(posters.dtypes)
    some = [filled(F.col(f), kinds[f]) for f in ("description", "profile_pic_url", "payload", "name", "followers_count")]
    any_ = some[0]
    for s in some[1:]:
        any_ = any_ | s
    return posters.where(filled(F.col("url"), kinds["url"]) & any_)


def fail_open(df: DataFrame, step: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, str | None]:
    """(what a filter step gives, null), or (the unfiltered input, the error's name) if it fails, while it is planned or while it runs.

    The step's result is written to the shared folder, as a later failure could not be caught.
    """
    try:
        return shared_table(step(df), "step"), None
    except Exception as e:  # whatever a step may raise
        return df, getattr(e, "getCondition", lambda: None)() or type(e).__name__


def result_routes(rows: DataFrame, has_pictures: Column, url: Column, blacklist: list[str], tracked: DataFrame, domain: str) -> DataFrame:
    """rows with `route`: no_pictures, blacklisted (the address has one of some patterns), recrawl (of a tracked domain), insertion. tracked: a column of domains."""
    known = tracked.select(F.col(domain).alias("_domain")).distinct().withColumn("_tracked", F.lit(True))
    bad = F.coalesce(url.rlike("|".join(f"(?:{p})" for p in blacklist)), F.lit(False)) if blacklist else F.lit(False)
    route = F.when(~F.coalesce(has_pictures, F.lit(False)), "no_pictures").when(bad, "blacklisted").when(F.col("_tracked"), "recrawl").otherwise("insertion")
    return rows.join(known, F.col(domain) == F.col("_domain"), "left").withColumn("route", route).drop("_domain", "_tracked")
