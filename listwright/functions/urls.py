"""URL functions: Column -> Column, native expressions only. Malformed URLs give null where a part is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public suffixes of two labels by rule: a name of these, under a country code.
SECOND_LEVEL = "com co org net edu gov mil ac or ne go gob gouv nom gen firm ltd plc sch web id in".split()
# Further suffixes of two labels.
SUFFIXES = ["sa.com", "com.be"]
# Hosts that count as domains of their own.
OWN_HOSTS = [f"{c}.carousell.com" for c in ("au", "nz", "tw", "id", "ca")]


def host(u: Column) -> Column:
    """Host and port without user names."""
    full = F.when(F.contains(u, F.lit("http")), u).otherwise(F.concat(F.lit("https://"), u))
    return F.regexp_extract(full, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def suffix_pattern(more: list[str] | None = None) -> str:
    """A pattern of suffixes of two or more labels: those of the rule, the fixed ones and others, such as a list of public suffixes that a user has read."""
    named = [s.replace(".", r"\.") for s in sorted({*SUFFIXES, *(more or [])}, key=lambda s: (-s.count("."), s)) if "." in s]
    return "|".join([*named, rf"(?:{'|'.join(SECOND_LEVEL)})\.[a-z][a-z]"])


def registered_domain(u: Column, more: list[str] | None = None) -> Column:
    """The domain under a public suffix, lower case; a few hosts and one path are domains of their own. more: further suffixes of several labels."""
    h = F.regexp_replace(F.regexp_replace(host(u), "^.*@", ""), r":\d*$", "")
    h_ = F.lower(h)
    long, short = F.regexp_extract(h_, rf"([^.]+\.(?:{suffix_pattern(more)}))$", 1), F.regexp_extract(h_, r"([^.]+\.[^.]+)$", 1)
    out = F.when(F.endswith(h, F.lit("facebook.com")) & F.contains(u, F.lit("facebook.com/marketplace")), "facebook.com/marketplace")
    for own in OWN_HOSTS:
        out = out.when(F.endswith(h, F.lit(own)), own)
    return out.when(long != "", long).when(short != "", short).otherwise(h_)


def query_value(u: Column, key: str) -> Column:
    """The first non-empty value of a query parameter, decoded; null if there is none."""
    raw = F.regexp_extract(F.regexp_extract(u, r"\?([^#]*)", 1), rf"(?:^|&){key}=([^&]+)", 1)
    return F.when(raw != "", F.try_url_decode(raw))


def remove_localization(u: Column, countries: list[str]) -> Column:
    """Without path parts that are country codes."""
    return F.regexp_replace(u, rf"(?i)/(?:{'|'.join(countries)})(?=/|$)", "")


def embedded_url(u: Column, key: str, if_match: str) -> Column:
    """The URL in a query parameter of URLs that match."""
    return F.when(u.rlike(if_match), F.coalesce(query_value(u, key), u)).otherwise(u)


def clean_url(u: Column, keep: tuple[str, ...] = (), countries: list[str] | None = None, skip: bool = False, embedded: tuple[str, str] | None = None) -> Column:
    """One form of a listing's URL: no fragment, of the query only the parameters to keep, no country codes, no slash at the end."""
    if embedded:
        u = embedded_url(u, *embedded)
    if skip:
        return u
    base = F.split_part(F.split_part(u, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    if keep:
        kept = F.concat_ws("&", *(F.concat(F.lit(f"{k}="), F.url_encode(query_value(u, k))) for k in keep))
        base = F.when(kept != "", F.concat(base, F.lit("?"), kept)).otherwise(base)
    if countries:
        base = remove_localization(base, countries)
    return F.regexp_replace(base, "/$", "")


def post_identifier(u: Column, pattern: str, **clean) -> Column:
    """Group 1 of the pattern in the cleaned URL, or the cleaned URL."""
    c = clean_url(u, **clean)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(c)


def post_identifier_or_null(u: Column, pattern: str, substitute: str | None = None) -> Column:
    found = F.when(u.rlike(pattern), F.regexp_extract(u, pattern, 1))
    return F.regexp_replace(found, substitute, "") if substitute else found


def canonical_post(u: Column, pattern: str, template: str, **clean) -> Column:
    """struct(id, url): the identifier, and the URL that the template makes of it."""
    i = post_identifier(u, pattern, **clean)
    return F.struct(F.nullif(i, F.lit("")).alias("id"), F.when(i != "", F.concat(F.lit(template.split("{}")[0]), i, F.lit(template.split("{}")[1]))).otherwise(u).alias("url"))


def is_url(u: Column) -> Column:
    """Whether it has a scheme, a host and a path, and is no script."""
    return F.coalesce(u.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/[^?#]*") & (u != "javascript:void(0)"), F.lit(False))


def absolute_url(u: Column, page: Column) -> Column:
    """A link of a page as an absolute URL, decoded."""
    root = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    folder = F.regexp_replace(F.split_part(F.split_part(page, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)), r"[^/]*$", "")
    whole = F.when(u.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), u).when(F.startswith(u, F.lit("//")), F.concat(scheme, u)).when(F.startswith(u, F.lit("/")), F.concat(root, u)).otherwise(F.concat(folder, u))
    return F.coalesce(F.try_url_decode(F.replace(whole, F.lit("+"), F.lit("%2B"))), whole)


def is_image(u: Column) -> Column:
    return F.split_part(u, F.lit("?"), F.lit(1)).rlike(r"(?i)\.(?:jpg|png|gif|jpeg|webp)$")


def prune_domain(u: Column) -> Column:
    """Without scheme, www. and path."""
    return F.regexp_replace(F.regexp_replace(u, "^[a-zA-Z]+://", ""), r"^www\.|[/?#].*$", "")


def strip_www(u: Column) -> Column:
    return F.replace(u, F.lit("www."), F.lit(""))


def poster_url(name: Column, template: str, append: Column | None = None) -> Column:
    made = F.concat(F.lit(template.split("{}")[0]), name, F.lit(template.split("{}")[1]))
    return made if append is None else F.concat(made, append)


def shortcode(u: Column) -> Column:
    return F.nullif(F.regexp_extract(u, "/p/([^/?]*)", 1), F.lit(""))


def username(u: Column) -> Column:
    """The user's name in an address of a profile on instagram.com; null for other addresses."""
    return F.nullif(F.regexp_extract(u, r"instagram\.com/([^/?#]*)", 1), F.lit(""))


def clean_by_table(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls with `clean`: each address in one form by the rule of its registered domain; an address without a rule, or of a search page, stays.

    rules: domain, post_path (null: any address), search_paths, keep (query parameters that stay, in their order), countries (path parts that go),
    skip (true: nothing is changed). The rules are joined by domain, so they may be as many as need be.
    """
    r = rules.select(F.col("domain").alias("_domain"), "post_path", "search_paths", F.coalesce("keep", F.array().cast("array<string>")).alias("_keep"), F.coalesce("countries", F.array().cast("array<string>")).alias("_countries"), F.coalesce("skip", F.lit(False)).alias("_skip"))
    j = urls.withColumn("_d", registered_domain(F.col(url))).join(r, F.col("_d") == F.col("_domain"), "left")
    u = F.col(url)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    value = lambda k: F.try_url_decode(F.call_function("regexp_extract", query, F.concat(F.lit("(?:^|&)"), k, F.lit("=([^&]+)")), F.lit(1)))
    kept = F.filter(F.transform("_keep", lambda k: F.struct(k.alias("k"), value(k).alias("v"))), lambda p: F.coalesce(p["v"] != "", F.lit(False)))
    base = F.split_part(u, F.lit("?"), F.lit(1))
    base = F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), F.url_encode(p["v"]))), "&"))).otherwise(base)
    parts = F.split(base, "/")
    local = F.array_join(F.filter(parts, lambda p: ~F.array_contains("_countries", F.lower(p))), "/")
    cut = F.when(F.col("post_path").isNull() | F.startswith(u, F.col("post_path")), F.when(F.size("_countries") > 0, local).otherwise(base)).otherwise(u)
    plain = F.col("_domain").isNull() | F.col("_skip") | F.coalesce(F.exists("search_paths", lambda p: F.startswith(u, p)), F.lit(False))
    return j.withColumn("clean", F.when(plain, u).otherwise(F.regexp_replace(cut, "/$", ""))).select(*urls.columns, "clean")
