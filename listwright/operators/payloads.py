"""Messages for other services: insertion and profile payloads, fan-out to partner organisations, responses, logs, image keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAMP = "yyyy-MM-dd-HH:mm:ss"
#: What a service is asked to do with a new listing; the names are the receiving service's, so they are a parameter.
ACTIONS = ("add_image_to_index", "search_in_index", "launch_archiving", "launch_classifying", "launch_logo_detection", "launch_metadata")
JSON = {"ignoreNullFields": "false"}
# Fields of a listing that go as they are.
POST_FIELDS = ("poster_url", "price", "stock_count", "url", "archive_link", "title", "pictures", "videos", "description")


def column(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column, or null where the table has none of that name."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def stamp(df: DataFrame, name: str) -> Column:
    """A time as text: texts stay, timestamps are written."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    return F.col(name) if dict(df.dtypes)[name] == "string" else F.date_format(name, STAMP)


def insertion_payload(posts: DataFrame, environment: str, source: str = "SPECIFIC_SCRAPER", actions: tuple[str, ...] = ACTIONS) -> DataFrame:
    """posts with `body`: the message that inserts a listing, as JSON with all fields, null or not.

    Columns that posts lacks are null. The poster is the vendor, or else the poster column; post tags come before the listing's own;
    post_source, if there is one, goes before source.
    """
    c = lambda n, kind="string": column(posts, n, kind).alias(n)
    none = F.array().cast("array<string>")
    post = F.struct(
        stamp(posts, "scraping_time").alias("scraping_time"), F.coalesce(F.nullif(column(posts, "vendor"), F.lit("")), column(posts, "poster")).alias("poster"), *(c(f, "array<string>" if f in ("pictures", "videos") else "string") for f in POST_FIELDS),
        F.coalesce(F.nullif(column(posts, "post_source"), F.lit("")), F.lit(source)).alias("source"), F.concat(F.coalesce(column(posts, "post_tags", "array<string>"), none), F.coalesce(column(posts, "tags", "array<string>"), none)).alias("post_tags"),
        c("post_label"), F.lit(None).cast("string").alias("category"),
        F.struct(c("platform_id"), stamp(posts, "posting_time").alias("posting_time"), c("poster_link"), c("location"), c("ships_from"), c("ships_to")).alias("payload"),
        c("upload_id", "long"), c("upload_request_id"), c("poster_website_identifier"), c("risk_score", "double"), c("alternate_links", "array<string>"),
    )
    body = F.struct(F.lit(environment).alias("environment_name"), c("organisation_name"), *(F.lit(True).alias(a) for a in actions), post.alias("post"))
    return posts.withColumn("body", F.to_json(body, JSON))


def profile_payload(profiles: DataFrame, environment: str, now: Column, source: str = "SPECIFIC_SCRAPER") -> DataFrame:
    """profiles with `body`: the message that inserts a profile. The address of an upload request goes before the profile's own; geo is only there if known."""
    c = lambda n, kind="string": column(profiles, n, kind).alias(n)
    none = F.array().cast("array<string>")
    fields = [
        c("name"), c("description"), F.coalesce(F.nullif(column(profiles, "upload_url"), F.lit("")), column(profiles, "url")).alias("url"), c("profile_pic_url"), c("payload"), c("archive_link"), c("posts_count", "long"), c("followers_count", "long"),
        F.date_format(now, STAMP).alias("scraping_time"), F.lit(source).alias("source"), F.coalesce(column(profiles, "account_tags", "array<string>"), none).alias("account_tags"), c("account_label"), c("upload_id", "long"), c("upload_request_id"), c("poster_website_identifier"),
    ]
    whole = lambda *more: F.to_json(F.struct(F.lit(environment).alias("environment_name"), c("organisation_name"), F.struct(*fields, *more).alias("profile")), JSON)
    geo = column(profiles, "geo")
    return profiles.withColumn("body", F.when(F.coalesce(geo, F.lit("")) != "", whole(geo.alias("geo"))).otherwise(whole()))


def fan_out(posts: DataFrame, partners: dict[str, list[str]], scores: str = "risk_scores") -> DataFrame:
    """A row for each listing and organisation: its own, then its partners; risk_score is the organisation's of the map of scores."""
    out = F.array("organisation_name")
    for org, others in partners.items():
        out = F.when(F.col("organisation_name") == org, F.array(F.lit(org), *map(F.lit, others))).otherwise(out)
    rows = posts.withColumn("organisation_name", F.explode(out))
    return rows.withColumn("risk_score", F.try_element_at(scores, F.col("organisation_name")))


def _some(c: Column) -> Column:
    """Empty texts are left out like nulls."""
    return F.nullif(c, F.lit(""))


IMAGES = "array<struct<picture_url: string, s3_url: string>>"


def response(pages: DataFrame, now: Column) -> DataFrame:
    """pages with `response`: what the service answers for a page, as a struct.

    Columns, those that are missing being null: url, s3_content_url, s3_archive_url, title, translated_title, description, translated_description, source_language,
    outgoing_links (url, pictures), data (type, fields of a listing or poster), who_is, web_stack (maps), errors, successful.
    """
    c = lambda n, kind="string": column(pages, n, kind)
    links = c("outgoing_links", f"array<struct<url: string, pictures: {IMAGES}>>")
    images = lambda a: F.transform(F.coalesce(a, F.array().cast(IMAGES)), lambda p: F.struct(p["picture_url"].alias("image_url"), _some(p["s3_url"]).alias("s3_url")))
    data = c("data", f"struct<type: string, title: string, description: string, price: string, vendor: string, poster_link: string, pictures: {IMAGES}, name: string, translated_description: string, profile_pic_url: string>")
    post = F.struct(*(_some(data[f]).alias(f) for f in ("title", "description", "price")), _some(data["vendor"]).alias("poster_name"), _some(data["poster_link"]).alias("poster_link"), F.to_json(data).alias("payload"), images(data["pictures"]).alias("images"))
    poster = F.struct(*(data[f].alias(f) for f in ("name", "description", "translated_description", "profile_pic_url")), F.to_json(data).alias("payload"))
    texts = ("s3_content_url", "s3_archive_url", "title", "translated_title", "description", "translated_description", "source_language")
    page = F.struct(
        c("url").alias("url"), F.date_format(now, "yyyy-MM-dd HH:mm:ss").alias("creation_date_timestamp"), *(_some(c(t)).alias(t) for t in texts),
        F.transform(F.coalesce(links, F.array().cast(f"array<struct<url: string, pictures: {IMAGES}>>")), lambda x: F.struct(x["url"].alias("to_url"), images(x["pictures"]).alias("images"))).alias("outgoing_links"),
        F.when(data["type"] == "POST", post).alias("post"), F.when(data["type"] == "POSTER", poster).alias("poster"),
    )
    host = F.struct(c("who_is", "map<string, string>").alias("who_is"), c("web_stack", "map<string, string>").alias("web_stack"))
    return pages.withColumn("response", F.struct(F.array(page).alias("pages"), F.array(host).alias("hosts"), F.coalesce(c("errors", "array<string>"), F.array().cast("array<string>")).alias("errors"), F.coalesce(c("successful", "boolean"), F.lit(True)).alias("successful")))


def latest_logs(log: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """The newest entry of each address in an append-only log (url, at, payload), for those that are not older than the time to live."""
    newest = log.groupBy("url").agg(F.max(F.struct("at", "payload")).alias("x")).select("url", "x.*")
    return newest.where(F.col("at") >= now - F.make_dt_interval(secs=F.lit(ttl_seconds)))


#: First bytes of image files, in hexadecimal, and their kind.
MAGIC = {"ffd8ff": "image/jpeg", "89504e470d0a1a0a": "image/png", "474946383761": "image/gif", "474946383961": "image/gif", "424d": "image/bmp", "49492a00": "image/tiff", "4d4d002a": "image/tiff"}


def image_kind(data: Column) -> Column:
    """The kind of an image by its first bytes; null for other data."""
    head = F.lower(F.hex(F.substring(data, 1, 12)))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp").when(F.substring(head, 9, 16) == "6674797061766966", "image/avif")
    for magic, kind in MAGIC.items():
        out = out.when(head.startswith(magic), kind)
    return out


def image_scale(data: Column) -> Column:
    """By what an image's sides are divided before it is kept."""
    return scale_of_size(F.octet_length(data))


def scale_of_size(size: Column) -> Column:
    """The same by an image's bytes: 1 up to 10 MB, then with the root of its size."""
    mb = F.floor(size / (1024 * 1024))
    return F.when(mb > 10, F.floor(F.sqrt(F.floor(mb / 10))) + 1).otherwise(1).cast("int")


def image_key(data: Column, folder: str, salt: str) -> Column:
    """The place of an image in a store, by its content: folder, SHA-256 of data and salt, kind. Null for data that is no image."""
    return F.concat(F.lit(folder.strip("/") + "/"), F.sha2(F.concat(data, F.lit(salt.encode())), 256), F.lit("."), F.replace(image_kind(data), F.lit("image/"), F.lit("")))


def valid_image(status: Column, data: Column, image_hash: Column, blacklist: list[str]) -> Column:
    """An answer without an error, of an image that is not blacklisted by its perceptual hash."""
    return (status < 400) & image_kind(data).isNotNull() & ~F.coalesce(image_hash.isin(blacklist), F.lit(False))
