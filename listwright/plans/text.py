"""Queries of text, URL and scalar functions over documents, pages and events."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from listwright.functions import text as T
from listwright.functions import urls as U
from listwright.functions.constants import INFRINGING_KEYWORDS, ORGANISATIONS
from listwright.operators import store as K
from listwright.plans.registry import query
from listwright.plans.views import POSTS, posts, table

A, B = T.fold_tables()
WORDS = ["celine", "the", "einer", "elle", "gucci", "hermes", "idiot", "que", "und"]  # brand words and frequent words, so that there are hits


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_fold(c: str) -> str:
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("Æ", "AE"), ("Œ", "OE")):
        c = f"replace({c}, '{a}', '{b}')"
    return f"translate({c}, '{A}', '{B}')"


LOW = f"lower({sql_fold('coalesce(text, chr(32))')})"
SQL_TOKENS = {
    "x3": rf"list_filter(regexp_split_to_array({LOW}, '\s+'), lambda x: x <> '')",
    "x4": rf"list_filter(regexp_split_to_array(regexp_replace({LOW}, '[^a-zA-Z0-9\s]', '', 'g'), '\s+'), lambda x: x <> '')",
    "x5": f"list_filter(regexp_split_to_array({LOW}, '[^a-zA-Z0-9]'), lambda x: x <> '')",
    "x6": rf"regexp_extract_all(regexp_replace({LOW}, '[^a-zA-Z0-9]+', ' ', 'g'), '(\d+|[^\d ]+)', 1)",
}
rebuilt = f"',' || array_to_string({SQL_TOKENS['x6']}, ',') || ','"
for w in WORDS:
    rebuilt = f"regexp_replace({rebuilt}, ',{',?'.join(w)},', ',{w},', 'g')"
SQL_TOKENS["x7"] = f"list_filter(string_split({rebuilt}, ','), lambda x: x <> '')"


def _tokens(kind):
    t = T.fold(F.coalesce("text", F.lit(" ")))
    f = {"x3": T.tokens_ws, "x4": T.tokens_drop_marks, "x5": T.tokens_split_marks, "x6": T.tokens_borders, "x7": lambda c: T.tokens_rebuilt(c, WORDS)}[kind]
    return f(F.lower(t))


@query("x2_fold", f"SELECT doc_id AS id, md5({sql_fold('text')}) AS folded FROM documents")
def x2(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5(T.fold(F.col("text")).cast("binary")).alias("folded"))


for _kind, _name in (("x3", "x3_tokens_ws"), ("x4", "x4_tokens_drop_marks"), ("x5", "x5_tokens_split_marks"), ("x6", "x6_tokens_borders")):

    @query(_name, f"SELECT doc_id AS id, CAST(len(t) AS INT) AS n, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {SQL_TOKENS[_kind]} AS t FROM documents)")
    def tokens(spark, sf, kind=_kind):
        return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), _tokens(kind).alias("t")).select("id", F.size("t").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens"))


@query(
    "x7_reconstruct_tokens",
    f"SELECT source, count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS tokens, CAST(sum(len(list_filter(t, lambda x: x IN ('celine', 'gucci', 'hermes')))) AS BIGINT) AS brand_tokens, CAST(sum(len(list_filter(t, lambda x: x = 'the'))) AS BIGINT) AS the_tokens FROM (SELECT source, {SQL_TOKENS['x7']} AS t FROM documents) GROUP BY source",
)
def x7(spark, sf):
    t = table(spark, sf, "documents").select("source", _tokens("x7").alias("t"))
    count = lambda *w: F.sum(F.size(F.filter("t", lambda x: x.isin(*w)))).cast("long")
    return t.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.size("t")).alias("tokens"), count("celine", "gucci", "hermes").alias("brand_tokens"), count("the").alias("the_tokens"))


HT = r"#[\p{L}\p{N}_]*"


@query(
    "x1_text_features",
    rf"WITH {POSTS}, t AS (SELECT id, coalesce(title, '') || chr(10) || coalesce(description, '') AS t FROM posts) SELECT id, md5(replace(regexp_replace(t, '{HT}', '', 'g'), chr(9), ' ')) AS original_text, array_to_string(regexp_extract_all(t, '({HT})', 1), ' ') AS hashtags, CAST(len(regexp_extract_all(t, '#')) AS INT) AS n_hashtags FROM t",
)
def x1(spark, sf):
    t = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit("")))
    return posts(spark, sf).select("id", F.md5(T.without_hashtags(t).cast("binary")).alias("original_text"), F.array_join(T.hashtags(t), " ").alias("hashtags"), F.regexp_count(t, F.lit("#")).alias("n_hashtags"))


@query("x9_infringing_keywords", f"SELECT source, CAST(sum(len(regexp_extract_all(text, {q('|'.join(INFRINGING_KEYWORDS))}))) AS BIGINT) AS hits FROM documents GROUP BY source")
def x9(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(T.infringing_count(F.col("text"))).alias("hits"))


@query("x10_brand_names", f"SELECT source, CAST(sum(len(regexp_extract_all(lower(text), {q(T.brand_pattern())}))) AS BIGINT) AS hits FROM documents GROUP BY source")
def x10(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(T.brand_count(F.col("text"))).alias("hits"))


_orgs = [*ORGANISATIONS, "The_And", "Der_Die"]
_hits = " + ".join(f"CASE WHEN list_has_all(t, {[*o.lower().split('_')]}) THEN 1 ELSE 0 END" for o in _orgs)


@query("x11_brands_in_tokens", f"SELECT doc_id AS id, {_hits} AS n, list_has_all(t, ['the', 'and']) AS own FROM (SELECT doc_id, {SQL_TOKENS['x3']} AS t FROM documents)")
def x11(spark, sf):
    t = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), _tokens("x3").alias("t"))
    return t.select("id", T.brands_in_tokens(F.col("t"), _orgs).alias("n"), T.own_brand_in_tokens(F.lit("The_And"), F.col("t")).alias("own"))


@query("x12_x13_contacts", f"SELECT doc_id AS id, regexp_matches(text, '^(?:{T.EMAIL})') AS email_start, regexp_matches(text, '{T.EMAIL}') AS email, regexp_matches(text, '^(?:{T.PHONE})') AS phone_start, regexp_matches(text, '{T.PHONE}') AS phone FROM documents")
def x12(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.has_email(t).alias("email_start"), T.has_email(t, True).alias("email"), T.has_phone(t).alias("phone_start"), T.has_phone(t, True).alias("phone"))


@query("x14_x15_hashtags", rf"SELECT doc_id AS id, CAST(len(regexp_extract_all(text, '#')) AS INT) AS n, array_to_string(regexp_extract_all(text, '({HT})', 1), ' ') AS tags, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '({HT})', 1), lambda x: trim(lower(x))))), ' ') AS normal FROM documents")
def x14(spark, sf):
    h = T.hashtags(F.col("text"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.regexp_count("text", F.lit("#")).alias("n"), F.array_join(h, " ").alias("tags"), F.array_join(T.normal_hashtags(h), " ").alias("normal"))


@query("x16_strip_tags", "SELECT page_id AS id, md5(regexp_replace(html, '<[^\n]*?>', '', 'g')) AS text FROM pages")
def x16(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.md5(T.strip_tags(F.col("html")).cast("binary")).alias("text"))


@query(
    "x17_x24_cleaning",
    r"SELECT doc_id AS id, md5(trim(translate(text, chr(160), ' '))) AS output, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed, md5(regexp_replace(text, '[\x00-\x1f\x7f-\x9f]', '', 'g')) AS plain, lower(trim(regexp_replace(split_part(text, chr(10), 1), ' +', ' ', 'g'))) AS query FROM documents",
)
def x17(spark, sf):
    t = F.col("text")
    md5 = lambda c: F.md5(c.cast("binary"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), md5(T.clean_output(t)).alias("output"), md5(T.collapse(t)).alias("collapsed"), md5(T.drop_controls(t)).alias("plain"), T.normal_query(F.split_part(t, F.lit("\n"), F.lit(1))).alias("query"))


@query(
    "x19_x22_price_and_ratios",
    r"""SELECT doc_id AS id, nullif(regexp_extract(text, '[A-Za-z]{3}'), '') AS currency, nullif(regexp_extract(text, '[\d,\.]+'), '') AS price, regexp_matches(text, '\p{Sc}|@CURRENCY@') AS currency_visible,
round(CASE WHEN length(regexp_replace(text, '\s', '', 'g')) > 0 THEN len(regexp_extract_all(text, '\d')) / length(regexp_replace(text, '\s', '', 'g')) ELSE 0 END, 9) AS digits, round(CASE WHEN len(regexp_extract_all(text, '\p{L}')) > 0 THEN len(regexp_extract_all(text, '\p{Lu}')) / len(regexp_extract_all(text, '\p{L}')) ELSE 0 END, 9) AS capitals FROM documents""".replace("@CURRENCY@", "|".join(rf"\Q{x}\E" for x in T.CURRENCY_SYMBOLS)),
)
def x19(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.currency(t).alias("currency"), T.price(t).alias("price"), T.currency_visible(t).alias("currency_visible"), F.round(T.digit_ratio(t), 9).alias("digits"), F.round(T.capital_share(t), 9).alias("capitals"))


@query(
    "x32_big_count",
    """SELECT o_orderkey AS id, CASE WHEN n < 10000 THEN format('{:,}', n) WHEN n < 100000 THEN x(n / 1e3, 4) || 'k' WHEN n < 1000000 THEN x(n / 1e3, 3) || 'k' ELSE x(n / 1e6, 4) || 'm' END AS shown
FROM (SELECT o_orderkey, CAST(o_orderkey * 173 % 9000000 AS BIGINT) AS n FROM orders)""".replace("x(n / 1e3, 4)", "CASE WHEN strpos(substr(CAST(n / 1e3 AS VARCHAR), 1, 4), '.') > 0 THEN regexp_replace(regexp_replace(substr(CAST(n / 1e3 AS VARCHAR), 1, 4), '^0+|0+$', '', 'g'), '^\\.+|\\.+$', '', 'g') ELSE substr(CAST(n / 1e3 AS VARCHAR), 1, 4) END").replace("x(n / 1e3, 3)", "CASE WHEN strpos(substr(CAST(n / 1e3 AS VARCHAR), 1, 3), '.') > 0 THEN regexp_replace(regexp_replace(substr(CAST(n / 1e3 AS VARCHAR), 1, 3), '^0+|0+$', '', 'g'), '^\\.+|\\.+$', '', 'g') ELSE substr(CAST(n / 1e3 AS VARCHAR), 1, 3) END").replace("x(n / 1e6, 4)", "CASE WHEN strpos(substr(CAST(n / 1e6 AS VARCHAR), 1, 4), '.') > 0 THEN regexp_replace(regexp_replace(substr(CAST(n / 1e6 AS VARCHAR), 1, 4), '^0+|0+$', '', 'g'), '^\\.+|\\.+$', '', 'g') ELSE substr(CAST(n / 1e6 AS VARCHAR), 1, 4) END"),
)
def x32(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), T.big_count((F.col("o_orderkey") * 173 % 9000000).cast("long")).alias("shown"))


@query(
    "x33_x34_times",
    "WITH e AS (SELECT event_id, ts, CAST(epoch(TIMESTAMP '2025-06-01 00:00:00') - epoch(date_trunc('second', ts)) AS BIGINT) AS s FROM events) SELECT event_id AS id, strftime(ts, '%B %d, %Y') AS day, CASE WHEN s < 0 THEN '' WHEN s % 86400 < 60 THEN (s % 86400) || 's' WHEN s % 86400 < 3600 THEN (s % 86400 // 60) || 'm' WHEN s < 86400 THEN (s % 86400 // 3600) || 'h' WHEN s < 604800 THEN (s // 86400) || 'd' ELSE (s // 604800) || 'w' END AS ago FROM e",
)
def x33(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.date_format(ts, "MMMM dd, yyyy").alias("day"), T.time_ago(ts, F.lit("2025-06-01 00:00:00").cast("timestamp")).alias("ago"))


@query("x35_caption_html", r"SELECT doc_id AS id, md5(regexp_replace(replace(text, chr(10), '<br>'), '([#@][\p{L}\p{N}_]+)', '<a>\1</a>', 'g')) AS html FROM documents")
def x35(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5(T.caption_html(F.col("text")).cast("binary")).alias("html"))


@query("x39_biography", "SELECT c_custkey AS id, concat_ws(chr(10), c_name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, 'x') AS bio FROM customer")
def x39(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), T.biography(F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")), F.lit("x")).alias("bio"))


# --- URLs -------------------------------------------------------------------------------------------------------------
HOST = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
TWO = U.suffix_pattern()


@query(
    "u1_clean_url",
    r"""SELECT page_id AS id, regexp_replace(regexp_replace(CASE WHEN v <> '' THEN b || '?page=' || v ELSE b END, '(?i)(/)(?:fr|de|es)(/|$)', '\2', 'g'), '/$', '') AS kept, regexp_replace(b, '/$', '') AS bare
FROM (SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS b, regexp_extract(regexp_extract(url, '\?([^#]*)', 1), '(?:^|&)page=([^&]+)', 1) AS v FROM pages)""",
)
def u1(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), U.clean_url(u, keep=("page",), countries=["fr", "de", "es"]).alias("kept"), U.clean_url(u).alias("bare"))


@query("u2_remove_localization", r"SELECT page_id AS id, regexp_replace(url, '(?i)/(?:fr|en)(/|$)', '\1', 'g') AS url FROM pages")
def u2(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), U.remove_localization(F.col("url"), ["fr", "en"]).alias("url"))


@query("u3_embedded_url", "SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://out.example.com/r?x=1' END AS url FROM pages")
def u3(spark, sf):
    wrapped = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://out.example.com/go?to="), F.url_encode("url"), F.lit("&x=1"))).otherwise("https://out.example.com/r?x=1")
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), U.embedded_url(wrapped, "to", "/go").alias("url"))


@query(
    "u4_u6_identifiers",
    r"""SELECT page_id AS id, CASE WHEN regexp_matches(c, '/(\d+)$') THEN regexp_extract(c, '/(\d+)$', 1) ELSE c END AS post_id, CASE WHEN regexp_matches(url, '/(\d+)') THEN regexp_extract(url, '/(\d+)', 1) END AS strict_id,
'https://shop.example.com/p/' || CASE WHEN regexp_matches(c, '/(\d+)$') THEN regexp_extract(c, '/(\d+)$', 1) ELSE c END AS canonical FROM (SELECT *, regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/$', '') AS c FROM pages)""",
)
def u4(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), U.post_identifier(u, r"/(\d+)$").alias("post_id"), U.post_identifier_or_null(u, r"/(\d+)").alias("strict_id"), U.canonical_post(u, r"/(\d+)$", "https://shop.example.com/p/{}")["url"].alias("canonical"))


@query("u7_registered_domain", rf"SELECT page_id AS id, coalesce(nullif(regexp_extract(h, '([^.]+\.(?:{TWO}))$', 1), ''), nullif(regexp_extract(h, '([^.]+\.[^.]+)$', 1), ''), h) AS domain FROM (SELECT page_id, lower({HOST}) AS h FROM pages)")
def u7(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), U.registered_domain(F.col("url")).alias("domain"))


@query(
    "u8_u15_url_forms",
    rf"""SELECT page_id AS id, regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/[^?#]*') AS valid, regexp_matches(split_part(url, '?', 1), '(?i)\.(?:jpg|png|gif|jpeg|webp)$') AS image, regexp_replace(regexp_replace(url, '^[a-zA-Z]+://', ''), '^www\.|[/?#].*$', '', 'g') AS pruned, replace(url, 'www.', '') AS no_www,
split_part(url, '/', 1) || '//' || {HOST} || '/p/1' AS absolute, 'https://poster.example.com/' || {HOST} || '/about' AS poster, CAST(NULL AS VARCHAR) AS shortcode FROM pages""",
)
def u8(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), U.is_url(u).alias("valid"), U.is_image(u).alias("image"), U.prune_domain(u).alias("pruned"), U.strip_www(u).alias("no_www"), U.absolute_url(F.lit("/p/1"), u).alias("absolute"), U.poster_url(U.host(u), "https://poster.example.com/{}", F.lit("/about")).alias("poster"), U.shortcode(u).alias("shortcode"))


_REST = "regexp_replace({}, '/$', '')"
_DOMAIN = rf"coalesce(nullif(regexp_extract(h, '([^.]+\.(?:{TWO}))$', 1), ''), nullif(regexp_extract(h, '([^.]+\.[^.]+)$', 1), ''), h)"


@query(
    "u12_clean_by_table",
    rf"""WITH p AS (SELECT page_id, url, {_DOMAIN} AS d FROM (SELECT page_id, url, lower({HOST}) AS h FROM pages)), r AS (SELECT DISTINCT d, CASE WHEN starts_with(d, 't') THEN 'keep' WHEN d LIKE '%.net' THEN 'local' WHEN d LIKE '%.org' THEN 'skip' ELSE 'search' END AS kind FROM p WHERE d NOT LIKE 'a%'),
c AS (SELECT page_id, url, kind, split_part(url, '?', 1) AS b, nullif(regexp_extract(url, '[?&]page=([^&#]+)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]+)', 1), '') AS ref FROM p LEFT JOIN r USING (d))
SELECT page_id AS id, CASE WHEN kind IS NULL OR kind = 'skip' OR (kind = 'search' AND starts_with(url, 'https://m.')) THEN url WHEN kind = 'keep' THEN {_REST.format("b || CASE WHEN ref IS NOT NULL OR page IS NOT NULL THEN '?' || concat_ws('&', 'ref=' || ref, 'page=' || page) ELSE '' END")} WHEN kind = 'local' THEN {_REST.format("regexp_replace(b, '/(?:en|fr)(/|$)', '\\1')")} ELSE {_REST.format("CASE WHEN starts_with(url, 'http://') THEN b ELSE url END")} END AS url FROM c""".replace("\\\\1", "\\1"),
)
def u12(spark, sf):
    """A table with a rule for each registered domain (some have none), joined to the addresses: parameters to keep, country codes to drop, search pages that stay, listings by their path."""
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url")
    d = F.col("domain")
    none = F.array().cast("array<string>")
    kind = F.when(d.startswith("t"), "keep").when(d.endswith(".net"), "local").when(d.endswith(".org"), "skip").otherwise("search")
    rules = p.select(U.registered_domain(F.col("url")).alias("domain")).distinct().where(~d.startswith("a")).withColumn("kind", kind)
    search = F.col("kind") == "search"
    rules = rules.select("domain", F.when(search, "http://").alias("post_path"), F.when(search, F.array(F.lit("https://m."))).otherwise(none).alias("search_paths"), F.when(F.col("kind") == "keep", F.array(F.lit("ref"), F.lit("page"))).otherwise(none).alias("keep"), F.when(F.col("kind") == "local", F.array(F.lit("en"), F.lit("fr"))).otherwise(none).alias("countries"), (F.col("kind") == "skip").alias("skip"))
    return U.clean_by_table(p, rules).select("id", F.col("clean").alias("url"))


@query("u14_domains_of_urls", rf"SELECT domain, count(DISTINCT url) AS urls FROM (SELECT url, coalesce(nullif(regexp_extract(h, '([^.]+\.(?:{TWO}))$', 1), ''), nullif(regexp_extract(h, '([^.]+\.[^.]+)$', 1), ''), h) AS domain FROM (SELECT url, lower({HOST}) AS h FROM pages)) GROUP BY domain")
def u14(spark, sf):
    return table(spark, sf, "pages").groupBy(U.registered_domain(F.col("url")).alias("domain")).agg(F.countDistinct("url").alias("urls"))


# --- scalars ------------------------------------------------------------------------------------------------------------
@query("f1_reformat_dates", "SELECT event_id AS id, strftime(ts, '%Y-%m-%d-%H:%M:%S') AS written, date_trunc('second', ts) AS back FROM events")
def f1(spark, sf):
    w = F.date_format("ts", "yyyy-MM-dd-HH:mm:ss")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), w.alias("written"), F.try_to_timestamp(w, F.lit("yyyy-MM-dd-HH:mm:ss")).cast("timestamp_ntz").alias("back"))


@query("f2_month_bounds", "SELECT event_id AS id, CAST(date_trunc('month', ts) AS DATE) AS first_day, last_day(ts) AS last_day FROM events")
def f2(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.trunc(F.to_date("ts"), "month").alias("first_day"), F.last_day("ts").alias("last_day"))


@query("f3_f5_epochs", "SELECT event_id AS id, epoch_us(ts) % 1000000 % 6 AS noise, CAST(date_diff('day', TIMESTAMP '2020-01-01', ts) AS BIGINT) >= 1 AS over_a_day, strftime(to_timestamp(CAST(floor(epoch(ts)) AS BIGINT)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS read_back FROM events")
def f3(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.unix_micros(ts) % 1000000 % 6).alias("noise"), (F.datediff("ts", F.lit("2020-01-01")) >= 1).alias("over_a_day"), F.from_unixtime(F.unix_timestamp(ts)).alias("read_back"))


@query("f7_safe_ratio", "SELECT c_custkey AS id, CASE WHEN n > 0 THEN round(f / n, 9) ELSE -1 END AS ratio FROM (SELECT c_custkey, count(o_orderkey) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")
def f7(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("id"), F.when(F.col("n") > 0, F.round(F.col("f") / F.col("n"), 9)).otherwise(F.lit(-1.0)).alias("ratio"))


@query("f9_json_paths", "SELECT event_id AS id, 'k=' || (props->>'$.k') AS k, coalesce(props->>'$.missing', '') AS missing FROM events")
def f9(spark, sf):
    v = F.try_parse_json("props")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("k="), F.try_variant_get(v, "$.k", "string")).alias("k"), F.coalesce(F.try_variant_get(v, "$.missing", "string"), F.lit("")).alias("missing"))


@query("f11_key_value_maps", "SELECT o_orderkey AS id, count(*) AS n, max(CASE WHEN l_returnflag = 'N' THEN q END) AS n_last FROM (SELECT l_orderkey AS o_orderkey, l_returnflag, max_by(CAST(l_quantity AS BIGINT), (l_linenumber, CAST(l_quantity AS BIGINT))) AS q FROM lineitem GROUP BY ALL) GROUP BY 1")
def f11(spark, sf):
    """Key/value pairs of an entity as a map; of repeated keys the last one stays."""
    last = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.max_by(F.col("l_quantity").cast("long"), F.struct("l_linenumber", F.col("l_quantity").cast("long"))).alias("q"))
    m = last.groupBy(F.col("l_orderkey").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "q"))).alias("m"))
    return m.select("id", F.size("m").cast("long").alias("n"), F.try_element_at("m", F.lit("N")).alias("n_last"))


@query("f13_lock_ids", "SELECT p_partkey AS id, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS lock FROM (SELECT p_partkey, CAST(CAST('0x' || substr(sha256(p_name), 1, 16) AS UBIGINT) AS HUGEINT) AS h FROM part)")
def f13(spark, sf):
    h = F.conv(F.substring(F.sha2("p_name", 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(h >= F.lit(Decimal(1 << 63)), h - F.lit(Decimal(1 << 64))).otherwise(h).cast("long").alias("lock"))


@query("f14_j18_hash_distance", "WITH h AS (SELECT vec_id, label, CAST(list_sum(list_transform(range(1, 13), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS BIGINT) << CAST(i - 1 AS INT) ELSE 0 END)) AS BIGINT) AS h FROM embeddings WHERE label IS NOT NULL), c AS (SELECT label, h, min(vec_id) AS id, count(*) AS n FROM h GROUP BY ALL) SELECT a.id AS a, b.id AS b, a.n AS n_a, b.n AS n_b FROM c a JOIN c b ON a.label = b.label AND a.id < b.id AND bit_count(xor(a.h, b.h)) < 3")
def f14(spark, sf):
    """Near matches of sign-bit hashes of a label: pairs of different hashes at most two bits apart."""
    bit = [F.when(F.col("embedding")[i] > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(12)]
    h = table(spark, sf, "embeddings").select("vec_id", "label", sum(bit[1:], bit[0]).alias("h"))
    return K.near_hashes(h, "label", "h", "vec_id", 12)


@query("f15_box_overlap", "SELECT l_orderkey AS id, l_linenumber AS k, round(iw * ih / (w * h + 100 - iw * ih), 9) AS iou FROM (SELECT *, greatest(0, least(x + w, 15) - greatest(x, 5)) AS iw, greatest(0, least(y + h, 15) - greatest(y, 5)) AS ih FROM (SELECT l_orderkey, l_linenumber, l_partkey % 20 AS x, l_suppkey % 20 AS y, 1 + l_orderkey % 9 AS w, 1 + l_linenumber AS h FROM lineitem))")
def f15(spark, sf):
    from listwright.functions.geometry import box_iou

    li = table(spark, sf, "lineitem")
    box = [F.col("l_partkey") % 20, F.col("l_suppkey") % 20, 1 + F.col("l_orderkey") % 9, 1 + F.col("l_linenumber")]
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), F.round(box_iou(box, [F.lit(5), F.lit(5), F.lit(10), F.lit(10)]), 9).alias("iou"))


@query("f16_f17_distances", "SELECT l_orderkey AS id, l_linenumber AS k, round(CASE WHEN x > 15 THEN 150::DOUBLE ELSE sqrt(power(greatest(0, 5 - x, x - 15), 2) + power(greatest(0, 5 - y, y - 15), 2)) END, 9) AS dist, round(CASE WHEN l_linenumber <= 6 THEN 1 - (l_linenumber - 1) * 0.17::DOUBLE ELSE 0 END, 9) AS heading FROM (SELECT *, l_partkey % 20 AS x, l_suppkey % 20 AS y FROM lineitem)")
def f16(spark, sf):
    from listwright.functions.geometry import heading_weight, point_to_box

    x, y = F.col("l_partkey") % 20, F.col("l_suppkey") % 20
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), F.round(F.when(x > 15, F.lit(150.0)).otherwise(point_to_box(x, y, 5, 5, 15, 15)), 9).alias("dist"), F.round(heading_weight(F.col("l_linenumber")), 9).alias("heading"))


@query("f19_nested_json", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def f19(spark, sf):
    j = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_mktsegment").alias("segment")).alias("deep")).alias("poster")))
    back = F.from_json(j, "id long, poster struct<name: string, deep: struct<segment: string>>")
    return table(spark, sf, "customer").select(back.alias("b")).select("b.id", "b.poster.name", "b.poster.deep.segment")


#: Ways to write a word so that it is missed: cut in two or into letters by each separator, with digits, run on, in capitals, with an accent.
DISGUISES = [
    *(lambda w, s=s: s.join((w[: len(w) // 2], w[len(w) // 2 :])) for s in " .-_*"), *(lambda w, s=s: s.join(w) for s in " .-*"), *(lambda w, d=d: w + d for d in ("8", " 8", "80x")),
    lambda w: f"my{w}", lambda w: f"{w}shop", str.upper, str.title, lambda w: w.replace("e", "é").replace("u", "ü"), lambda w: f"#{w}!",
]
ADVERSARIAL = [f"one {f(w)} two" for w in ("celine", "gucci", "hermes") for f in DISGUISES]


@query("x8_adversarial_strings", f"SELECT doc_id AS id, CAST(len(t) AS INT) AS n, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {SQL_TOKENS['x7']} AS t FROM (SELECT doc_id, split_part(coalesce(text, ''), ' ', 1) || ' ' || [{', '.join(q(x) for x in ADVERSARIAL)}][CAST(doc_id % {len(ADVERSARIAL)} AS INT) + 1] AS text FROM documents))")
def x8(spark, sf):
    """Tokens put together again from each document's first word and one of the strings."""
    s = F.element_at(F.array(*map(F.lit, ADVERSARIAL)), (F.col("doc_id") % len(ADVERSARIAL) + 1).cast("int"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.split_part(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(1)), F.lit(" "), s).alias("text"))
    return d.select("id", _tokens("x7").alias("t")).select("id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


@query("x18_replaced_bytes", "SELECT doc_id AS id, md5(replace(replace(text, 'ä', 'ae'), 'é', '')) AS text, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents")
def x18(spark, sf):
    """Patterns over the bytes of a text; a dot is one byte."""
    t = F.col("text")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5(T.replace_bytes(T.replace_bytes(t, "ä", "ae"), "é", "").cast("binary")).alias("text"), F.length(T.replace_bytes(t, "(?s).", "x")).cast("long").alias("bytes"))


@query("x26_broken_texts", "SELECT doc_id AS id, true AS whole, true AS short, CAST(least(1000, length(text)) > 0 AS BOOLEAN) AS some FROM documents WHERE text IS NOT NULL")
def x26(spark, sf):
    """Long texts cut into parts of 1000 characters at most, at marks or blanks: nothing is lost."""
    p = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text", T.broken_texts("text").alias("p"))
    return p.select("id", (F.array_join("p", "") == F.col("text")).alias("whole"), F.forall("p", lambda x: F.length(x) <= 1000).alias("short"), F.exists("p", lambda x: F.length(x) > 0).alias("some"))


_stop = {k: f"len(list_filter(w, lambda x: list_contains({v}, x)))" for k, v in T.STOP_WORDS.items()}


@query("x28_foreign_language", rf"WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '(\p{{L}}+)', 1) AS w FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _stop.items())} FROM d) SELECT doc_id AS id, CASE WHEN en + fr + de + es > 0 AND greatest(fr, de, es) >= 0.5 * (en + fr + de + es) THEN CASE greatest(fr, de, es) WHEN de THEN 'de' WHEN es THEN 'es' ELSE 'fr' END END AS lang FROM n".replace("\\\\p", "\\p"))
def x28(spark, sf):
    """The language of texts that are not English, by their frequent words."""
    return table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("id"), T.foreign_language(F.col("text")).alias("lang"))
