"""Queries of joins, windows, sorts, samples and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from listwright.operators import datasets as S
from listwright.operators import filters as P
from listwright.operators import schedule
from listwright.operators import store as K
from listwright.operators.rows import numbered, numbered_within
from listwright.plans.registry import query
from listwright.plans.views import POSTS, TASKS, posts, table, tasks
from listwright.session import shared_folder

DRAW = "(({k} * 1103515245 + 2469000) % 2147483647)"


@query("j1_star_join", "SELECT r_name AS website, n_name AS organisation, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('EUROPE', 'ASIA') GROUP BY ALL")
def j1(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region").where(F.col("r_name").isin("EUROPE", "ASIA")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("r_name").alias("website"), F.col("n_name").alias("organisation")).agg(F.count("*").alias("n"))


@query("j2_j3_active_tasks", f"WITH {TASKS} SELECT act.id, n_name AS organisation FROM act LEFT JOIN nation ON n_nationkey = organisation_id")
def j2(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("organisation_id"), F.col("n_name").alias("organisation"))
    return schedule.active(tasks(spark, sf)).join(n, "organisation_id", "left").select("id", "organisation")


@query("j4_t3_random_order", f"WITH j AS (SELECT c_custkey AS id, n_name AS website FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT id, website, row_number() OVER (ORDER BY {DRAW.format(k='id')}, id) AS pos FROM j")
def j4(spark, sf):
    """Profiles joined to their websites, in a drawn order; places are given without a task that sees all rows."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    j = c.join(table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("website")), "c_nationkey").select("id", "website")
    return numbered_within(j, [], [S.draw(F.col("id")), F.col("id")], "pos")


@query("j5_tag_bridge", "SELECT DISTINCT l_orderkey AS id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 7")
def j5(spark, sf):
    t = table(spark, sf, "part").where("p_size = 7").select("p_partkey")
    return table(spark, sf, "lineitem").join(t, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(F.col("l_orderkey").alias("id")).distinct()


@query("j6_label_semi", "SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic IN (1))")
def j6(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").where(F.col("toxic").isin(1)), "doc_id", "left_semi").select(F.col("doc_id").alias("id"))


@query("j7_a2_latest_per_key", "SELECT o_custkey AS k, max(o_orderkey) AS id, max_by(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
def j7(spark, sf):
    return K.latest(table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), ["k"], "id")


@query("j8_fallback_lookup", "SELECT user_id AS id, 'log' AS origin FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT c_custkey, 'store' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def j8(spark, sf):
    logs = table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    rest = table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(logs, "id", "left_anti")
    return logs.withColumn("origin", F.lit("log")).unionByName(rest.withColumn("origin", F.lit("store")))


@query("j9_derived_key", r"SELECT d.doc_id AS id, p.page_id AS page FROM documents d JOIN pages p ON CAST(regexp_extract(p.url, '/(\d+)(?:[?#]|$)', 1) AS VARCHAR) = CAST(d.doc_id AS VARCHAR)")
def j9(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"/(\d+)(?:[?#]|$)", 1).alias("k"))
    return table(spark, sf, "documents").join(p, F.col("doc_id").cast("string") == F.col("k")).select(F.col("doc_id").alias("id"), F.col("page_id").alias("page"))


EXT = "b AS (SELECT o_orderkey AS id, 'o' || (o_custkey % 5) AS organisation, 's' || (o_orderkey % 40) AS domain, o_orderstatus AS label, o_orderstatus = 'P' AS positive FROM orders), b1 AS (SELECT * FROM b QUALIFY count(*) OVER (PARTITION BY organisation, domain) >= 60), b2 AS (SELECT * FROM b1 QUALIFY count(*) OVER (PARTITION BY organisation) >= 60)"


def training(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("o"), (F.col("o_custkey") % 5).cast("string")).alias("organisation"), F.concat(F.lit("s"), (F.col("o_orderkey") % 40).cast("string")).alias("domain"), F.col("o_orderstatus").alias("label"), (F.col("o_orderstatus") == "P").alias("positive"))


@query("j10_a7_cross_labelling", f"WITH {EXT}, orgs AS (SELECT DISTINCT organisation AS org FROM b2) SELECT org AS organisation, CASE WHEN org = organisation THEN label ELSE 'Irrelevant' END AS label, count(*) AS n FROM b2 JOIN orgs ON org = organisation OR positive GROUP BY ALL")
def j10(spark, sf):
    return S.extend(training(spark, sf), 60).groupBy("organisation", "label").agg(F.count("*").alias("n"))


@query("j11_z2_membership", "SELECT 'known' AS kind, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'new', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j11(spark, sf):
    d, l = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    return d.join(l, "doc_id", "left_semi").agg(F.lit("known").alias("kind"), F.count("*").alias("n")).unionByName(d.join(l, "doc_id", "left_anti").agg(F.lit("new").alias("kind"), F.count("*").alias("n")))


@query("j12_t9_w1_random_rows", "WITH n AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer), r AS (SELECT DISTINCT (i * 7919) % (SELECT count(*) FROM customer) + 1 AS rn FROM range(1100) t(i) ORDER BY rn LIMIT 1000) SELECT id FROM n JOIN r USING (rn)")
def j12(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    n = c.count()
    r = spark.range(1100).select((F.col("id") * 7919 % max(n, 1) + 1).alias("rn")).distinct().orderBy("rn").limit(1000)
    return numbered(c, "id", "rn").join(F.broadcast(r), "rn").select("id")


@query("j14_logo_lookup", "SELECT l_orderkey AS id, array_to_string(list_sort(list(DISTINCT s_name)), ',') AS logos FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey")
def j14(spark, sf):
    images = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("images"))
    logos = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    e = images.select(F.col("l_orderkey").alias("id"), F.explode("images").alias("s_suppkey")).join(logos, "s_suppkey")
    return e.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("s_name")), ",").alias("logos"))


@query("j15_upload_requests", "SELECT p.page_id AS id, l.toxic AS request FROM pages p LEFT JOIN labels l ON l.doc_id = p.page_id")
def j15(spark, sf):
    return table(spark, sf, "pages").join(table(spark, sf, "labels"), F.col("page_id") == F.col("doc_id"), "left").select(F.col("page_id").alias("id"), F.col("toxic").alias("request"))


_LOCALES = "l AS (SELECT n_name AS country, unnest(CASE n_regionkey WHEN 3 THEN ['fr', 'de', 'en'] WHEN 1 THEN ['es', 'en'] ELSE ['en'] END) AS locale FROM nation)"


@query("j16_localized_keywords", f"WITH {_LOCALES}, k AS (SELECT DISTINCT source AS organisation, lang AS locale, split_part(text, ' ', 1) AS keyword FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL) SELECT country, organisation, count(DISTINCT keyword) AS n, min(keyword) AS first FROM k JOIN l USING (locale) GROUP BY country, organisation")
def j16(spark, sf):
    """Keywords of each organisation for each country: those of the country's locales, each once. Organisations have them as maps of lists by locale."""
    d = table(spark, sf, "documents").where("text is not null and lang is not null").select(F.col("source").alias("organisation"), F.col("lang").alias("locale"), F.split_part("text", F.lit(" "), F.lit(1)).alias("keyword"))
    org = d.groupBy("organisation", "locale").agg(F.collect_set("keyword").alias("w")).groupBy("organisation").agg(F.map_from_entries(F.collect_list(F.struct("locale", "w"))).alias("keywords"))
    r = F.col("n_regionkey")
    locales = table(spark, sf, "nation").select(F.col("n_name").alias("country"), F.when(r == 3, F.array(*map(F.lit, ["fr", "de", "en"]))).when(r == 1, F.array(F.lit("es"), F.lit("en"))).otherwise(F.array(F.lit("en"))).alias("locales"))
    return K.localized_keywords(org, locales).groupBy("country", "organisation").agg(F.count("*").alias("n"), F.min("keyword").alias("first"))


@query("j17_index_joins", "SELECT p.page_id AS id, d.lang, l.quality FROM pages p JOIN documents d ON d.doc_id = p.page_id LEFT JOIN labels l ON l.doc_id = p.page_id")
def j17(spark, sf):
    p, d, l = (table(spark, sf, t) for t in ("pages", "documents", "labels"))
    return p.join(d, F.col("page_id") == d["doc_id"]).join(l, F.col("page_id") == l["doc_id"], "left").select(F.col("page_id").alias("id"), "lang", "quality")


LINKS = "WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_orderkey % 1500 AS b FROM orders WHERE o_orderkey % 97 = 0), r(id, depth) AS (SELECT a, 0 FROM e WHERE a % 50 = 0 UNION SELECT e.b, depth + 1 FROM r JOIN e ON e.a = r.id WHERE depth < 3)"


@query("j19_link_graph", f"{LINKS} SELECT id, CAST(min(depth) AS INT) AS depth FROM r GROUP BY id")
def j19(spark, sf):
    """Pages within three links of the first ones; each step is a join, and what was reached before is left out."""
    e = table(spark, sf, "orders").where("o_orderkey % 97 = 0").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 1500).alias("b")).distinct()
    step = e.where("a % 50 = 0").select(F.col("a").alias("id")).distinct()
    out = step.withColumn("depth", F.lit(0))
    for k in (1, 2, 3):
        step = e.join(step, F.col("a") == F.col("id"), "left_semi").select(F.col("b").alias("id")).distinct().join(out.select("id"), "id", "left_anti")
        out = out.unionByName(step.withColumn("depth", F.lit(k)))
    return out


@query("j20_one_to_one", "SELECT c_custkey AS id, n_name AS host, o.n AS orders FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def j20(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(F.col("c_custkey").alias("id"), F.col("n_name").alias("host"), "orders")


# --- windows ------------------------------------------------------------------------------------------------------------
@query("w1_row_numbers", "SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders")
def w1(spark, sf):
    return numbered(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), "id", "rn")


@query("w2_first_wins", "SELECT o_custkey AS k, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders GROUP BY o_custkey")
def w2(spark, sf):
    return K.keep_first(table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), "o_orderdate"), ["k"], "o_orderdate", "id").select("k", "id")


@query("w4_per_domain_limit", f"WITH {TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY last_us NULLS FIRST, id) AS n FROM act) SELECT id, domain FROM r WHERE n <= 7 ORDER BY last_us NULLS FIRST, id LIMIT 50")
def w4(spark, sf):
    return P.per_domain_limit(schedule.active(tasks(spark, sf)), F.lit(7), 50, F.asc_nulls_first("last_run"), "id").select("id", "domain")


@query("w5_index_on_page", "SELECT l_orderkey AS page, l_linenumber AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos FROM lineitem")
def w5(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("k"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")).cast("long").alias("pos"))


@query("w6_a22_page_relative", "SELECT l_orderkey AS page, l_linenumber AS k, round(l_quantity / max(l_quantity) OVER (PARTITION BY l_orderkey), 9) AS x FROM lineitem")
def w6(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("k"), F.round(F.col("l_quantity") / F.max("l_quantity").over(Window.partitionBy("l_orderkey")), 9).alias("x"))


@query("w7_label_shares", "SELECT lang, round(count(*) / (SELECT count(*) FROM documents), 9) AS share FROM documents GROUP BY lang")
def w7(spark, sf):
    g = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return g.select("lang", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 9).alias("share"))


@query("w8_top_classes", "SELECT l_orderkey AS id, list(l_returnflag ORDER BY l_quantity DESC, l_linenumber, l_returnflag)[1] AS top1, coalesce(list(l_returnflag ORDER BY l_quantity DESC, l_linenumber, l_returnflag)[3], '') AS top3, coalesce(list(l_quantity ORDER BY l_quantity DESC, l_linenumber, l_returnflag)[2], -1) AS p2 FROM lineitem GROUP BY l_orderkey")
def w8(spark, sf):
    """The n-th best (class, probability) over all images of a post; '' or -1 if there are fewer."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct((-F.col("l_quantity")).alias("q"), "l_linenumber", "l_returnflag"))).alias("p"))
    at = lambda k: F.try_element_at("p", F.lit(k))
    return g.select(F.col("l_orderkey").alias("id"), at(1)["l_returnflag"].alias("top1"), F.coalesce(at(3)["l_returnflag"], F.lit("")).alias("top3"), F.coalesce(-at(2)["q"], F.lit(-1.0)).alias("p2"))


# --- sorts, limits, samples -----------------------------------------------------------------------------------------------
@query("t1_latest_ids", "SELECT event_id AS id FROM events ORDER BY ts DESC, event_id LIMIT 1000")
def t1(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("ts"), "event_id").limit(1000).select(F.col("event_id").alias("id"))


@query("t2_nulls_first", f"WITH {TASKS} SELECT id FROM act ORDER BY last_us NULLS FIRST, id LIMIT 20")
def t2(spark, sf):
    return schedule.active(tasks(spark, sf)).orderBy(F.asc_nulls_first("last_run"), "id").limit(20).select("id")


@query("t4_balanced_sample", f"SELECT toxic AS label, doc_id AS id FROM labels WHERE toxic IS NOT NULL QUALIFY row_number() OVER (PARTITION BY toxic ORDER BY {DRAW.format(k='doc_id')}, doc_id) <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY toxic))")
def t4(spark, sf):
    l = table(spark, sf, "labels").where("toxic is not null").select(F.col("toxic").alias("label"), F.col("doc_id").alias("id"))
    return S.balance(l, "label", F.col("id"))


@query("t5_shuffle_head", f"SELECT doc_id AS id FROM documents ORDER BY {DRAW.format(k='doc_id')}, doc_id LIMIT 50")
def t5(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id")).orderBy(S.draw(F.col("id")), "id").limit(50)


@query("t6_stratified_split", f"SELECT source AS domain, count(CASE WHEN r <= floor(0.8 * n) THEN 1 END) AS train, count(CASE WHEN r > floor(0.8 * n) THEN 1 END) AS test, CAST(sum(CASE WHEN r <= floor(0.8 * n) THEN doc_id END) AS BIGINT) AS ids FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {DRAW.format(k='doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) GROUP BY source")
def t6(spark, sf):
    s = S.split(table(spark, sf, "documents").select("doc_id", F.col("source").alias("domain")), F.col("doc_id"), 0.8, "domain")
    return s.groupBy("domain").agg(F.count_if("train").alias("train"), F.count_if(~F.col("train")).alias("test"), F.sum(F.when(F.col("train"), F.col("doc_id"))).alias("ids"))


@query("t7_z1_merge", "SELECT lang, count(*) AS n FROM (SELECT lang FROM documents UNION ALL SELECT lang FROM documents WHERE doc_id % 2 = 0) GROUP BY lang")
def t7(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return d.unionByName(d.where("doc_id % 2 = 0")).groupBy("lang").agg(F.count("*").alias("n"))


@query("t8_top_and_rest", "WITH r AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) SELECT id FROM r WHERE n <= CAST(floor((SELECT count(*) FROM orders) * 0.8) AS BIGINT) OR id % 100 < 20")
def t8(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return S.top_and_rest(o, "o_totalprice", F.col("id")).select("id")


@query("t10_early_stop", f"""WITH e AS (SELECT dense_rank() OVER (ORDER BY l_shipdate) AS batch, l_orderkey * 10 + l_linenumber AS place, l_returnflag = 'R' AS fresh FROM lineitem WHERE l_shipdate >= DATE '1992-01-01'), b AS (SELECT batch, count(*) AS n, count(CASE WHEN fresh THEN 1 END) AS f FROM e GROUP BY batch),
s AS (SELECT *, sum(CASE WHEN f = 0 THEN 1 ELSE 0 END) OVER (ORDER BY batch ROWS 1 PRECEDING) AS run, sum(CASE WHEN f = 0 THEN 1 ELSE 0 END) OVER (ORDER BY batch) AS idles FROM b), k AS (SELECT coalesce(min(batch), 1000000000) AS stop FROM s WHERE run >= 2 OR idles >= 10),
r AS (SELECT *, row_number() OVER (ORDER BY batch, place) AS i, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (ORDER BY batch, place ROWS UNBOUNDED PRECEDING) - CASE WHEN fresh THEN 1 ELSE 0 END AS got FROM e, k WHERE batch <= stop) SELECT batch, place, fresh FROM r WHERE i <= 3000 AND got < 1000""")
def t10(spark, sf):
    """What a browsing job finds, shipped lines by day, up to 1000 new results, 3000 in all, or days without new ones."""
    e = table(spark, sf, "lineitem").where("l_shipdate >= date'1992-01-01'")
    days = numbered_within(e.select("l_shipdate").distinct(), [], [F.col("l_shipdate")], "batch")
    e = e.join(days, "l_shipdate").select("batch", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), (F.col("l_returnflag") == "R").alias("fresh"))
    return S.early_stop(e, 1000)


@query("t11_share_split", f"SELECT part, count(*) AS n FROM (SELECT CASE WHEN u < 0.7 THEN 0 WHEN u < 0.9 THEN 1 ELSE 2 END AS part FROM (SELECT {DRAW.format(k='o_orderkey')} / 2147483647.0::DOUBLE AS u FROM orders)) GROUP BY part")
def t11(spark, sf):
    return S.hash_split(table(spark, sf, "orders").select("o_orderkey"), F.col("o_orderkey"), [0.7, 0.2, 0.1]).groupBy("part").agg(F.count("*").alias("n"))


@query("t12_subsample", f"SELECT 'fraction' AS kind, doc_id AS id FROM documents WHERE {DRAW.format(k='doc_id')} < CAST(0.25 * 2147483647 AS BIGINT) UNION ALL SELECT 'ids', doc_id FROM documents WHERE doc_id IN (3, 5, 8) UNION ALL SELECT 'file', doc_id FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def t12(spark, sf):
    """A share of the documents, those of a list of ids, and those of a file of ids."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    path = shared_folder(spark, "ids")
    table(spark, sf, "benchmark").select(F.col("item_id").cast("string")).write.text(path)
    ids = spark.read.text(path).select(F.col("value").cast("long").alias("id"))
    parts = {"fraction": S.subsample(d, "id", fraction=0.25), "ids": S.subsample(d, "id", ids=[3, 5, 8]), "file": S.subsample(d, "id", ids=ids)}
    out = [x.select(F.lit(k).alias("kind"), "id") for k, x in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("t13_argmax", "SELECT l_orderkey AS page, max_by(l_linenumber, (l_extendedprice, -l_linenumber)) AS node FROM lineitem GROUP BY l_orderkey")
def t13(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.max_by("l_linenumber", F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("node"))


@query("t14_batches", "SELECT (row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS batch, c_custkey AS id FROM customer")
def t14(spark, sf):
    return numbered(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "id", "rn").select(F.floor((F.col("rn") - 1) / 100).alias("batch"), "id")


@query("t15_top5", "SELECT l_orderkey AS id, array_to_string(list(l_linenumber ORDER BY l_tax DESC, l_linenumber)[1:5], ',') AS top FROM lineitem GROUP BY l_orderkey")
def t15(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("l_tax")).alias("t"), "l_linenumber"))), 1, 5).alias("p"))
    return g.select(F.col("l_orderkey").alias("id"), F.array_join(F.transform("p", lambda x: x["l_linenumber"].cast("string")), ",").alias("top"))


# --- sets ---------------------------------------------------------------------------------------------------------------
@query("z3_z7_sets", "SELECT doc_id AS id, CAST(len(list_distinct(w)) AS INT) AS kinds, array_to_string(list_distinct(w[1:1]), '') AS first, CAST(len(list_intersect(list_distinct(w), ['the', 'and', 'der', 'les'])) AS INT) AS common FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z]+') AS w FROM documents)")
def z3(spark, sf):
    w = F.split(F.lower("text"), "[^a-z]+")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), w.alias("w"))
    return d.select("id", F.size(F.array_distinct("w")).alias("kinds"), F.array_join(F.array_distinct(F.slice("w", 1, 1)), "").alias("first"), F.size(F.array_intersect("w", F.array(*map(F.lit, ["the", "and", "der", "les"])))).alias("common"))


@query("z4_ordered_distinct", "SELECT conv_id AS id, array_to_string(list_transform(list_sort(list(DISTINCT f)), lambda x: substr(x, 5)), ',') AS roles FROM (SELECT conv_id, lpad(CAST(min(turn) AS VARCHAR), 4, '0') || role AS f FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def z4(spark, sf):
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return g.select(F.col("conv_id").alias("id"), F.array_join(F.array_distinct(F.col("r.role")), ",").alias("roles"))


@query("z7_known_keys", "SELECT event_id AS id, CASE WHEN (props->>'$.k') IS NOT NULL THEN 'k' ELSE '' END AS keys FROM events")
def z7(spark, sf):
    m = F.map_filter(F.from_json("props", "map<string, string>"), lambda k, v: k.isin("k", "other"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.array_join(F.map_keys(m), ",").alias("keys"))
