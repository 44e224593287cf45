"""Queries of sources, sinks, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.operators import filters as P
from listwright.operators import store as K
from listwright.plans.registry import query
from listwright.plans.views import KEYWORD_SQL, POSTS, TASKS, keyword_table, labelled, LABELLED, posts, table, tasks
from listwright.session import shared_folder, shared_table
from listwright.sources import files

D = "coalesce(title, '') AS t, coalesce(description, '') AS d"


@query("s1_snapshot_roundtrip", "SELECT c_custkey AS id, c_name AS name FROM customer")
def s1(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    path = shared_folder(spark, "snapshots")
    files.write_snapshot(c, path, "2024-01-02", {"organisation": "A"})
    return files.read_snapshot(spark, path, "2024-01-02", {"organisation": "A"})


@query("s2_s3_latest_snapshot", "SELECT 'A:' || c_custkey AS id, c_name AS name, 'A' AS organisation, DATE '2024-03-05' AS date FROM customer")
def s2(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    path = shared_folder(spark, "snapshots")
    files.write_snapshot(c.withColumn("name", F.lit("old")), path, "2024-01-02", {"organisation": "A"})
    files.write_snapshot(c, path, "2024-03-05", {"organisation": "A"})
    return files.latest_snapshot(spark, path, organisation="A").select(F.concat_ws(":", "organisation", F.col("id").cast("string")).alias("id"), "name", "organisation", "date")


@query("s4_incremental_append", "SELECT CAST(count(*) AS BIGINT) AS n, max(ts) AS latest FROM events")
def s4(spark, sf):
    e = table(spark, sf, "events")
    mark = e.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5).alias("m")).first()["m"] or 0
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return files.append_since(e.where(us <= mark), e, us, mark).agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


@query("s5_delimited_files", "SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part")
def s5(spark, sf):
    path = shared_folder(spark, "part")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.lit(1).alias("Unnamed: 0"))
    files.write_delimited(p, path)
    return files.read_delimited(spark, path, "id long, name string, size int, `Unnamed: 0` int")


@query("s8_sql_scan", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_quantity < 10 GROUP BY l_returnflag")
def s8(spark, sf):
    return spark.sql("SELECT l_returnflag AS flag, count(*) AS n FROM {li} WHERE l_quantity < 10 GROUP BY l_returnflag", li=table(spark, sf, "lineitem"))


@query("s16_saved_pages", "SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS n FROM pages")
def s16(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length("html").cast("long").alias("n"))


# --- sinks --------------------------------------------------------------------------------------------------------------
STORE = "st AS (SELECT o_custkey AS k, CAST(max(o_orderkey) AS BIGINT) AS id, max_by(o_orderstatus, o_orderkey) AS status, max_by(o_orderpriority, o_orderkey) AS title FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), nw AS (SELECT o_custkey AS k, CAST(max(o_orderkey) AS BIGINT) AS id, max_by(o_orderstatus, o_orderkey) AS status, max_by(o_orderpriority, o_orderkey) AS title FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)"


def _stores(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("title"))
    return K.latest(o.where("id % 2 = 0"), ["k"], "id"), K.latest(o.where("id % 2 = 1"), ["k"], "id")


@query("k1_insert_if_absent", f"WITH {STORE} SELECT * FROM nw WHERE k NOT IN (SELECT k FROM st)")
def k1(spark, sf):
    s, n = _stores(spark, sf)
    return K.insert_if_absent(s, n, ["k"], "id").select("k", "id", "status", "title")


@query("k2_guarded_status", "SELECT w AS wanted, c AS current, CASE WHEN c IS NULL THEN w WHEN w IN ('FILTERED_IN', 'FILTERED_OUT') AND c <> 'SEARCHED' THEN c WHEN w = 'SCRAPED' AND c = 'SENT' THEN c ELSE w END AS status, count(*) AS n FROM (SELECT ['SEARCHED', 'FILTERED_IN', 'FILTERED_OUT', 'SCRAPED', 'SENT'][CAST(l_orderkey % 5 AS INT) + 1] AS w, CASE WHEN l_linenumber < 7 THEN ['SEARCHED', 'FILTERED_IN', 'FILTERED_OUT', 'SCRAPED', 'SENT'][CAST(l_partkey % 5 AS INT) + 1] END AS c FROM lineitem) GROUP BY ALL")
def k2(spark, sf):
    s = F.array(*map(F.lit, K.STATUSES))
    li = table(spark, sf, "lineitem").select(F.element_at(s, (F.col("l_orderkey") % 5 + 1).cast("int")).alias("wanted"), F.when(F.col("l_linenumber") < 7, F.element_at(s, (F.col("l_partkey") % 5 + 1).cast("int"))).alias("current"))
    return li.groupBy("wanted", "current", K.next_status(F.col("current"), F.col("wanted")).alias("status")).agg(F.count("*").alias("n"))


@query("k3_upsert", f"WITH {STORE} SELECT coalesce(s.k, n.k) AS k, coalesce(n.status, s.status) AS status, coalesce(n.title, s.title) AS title FROM st s FULL JOIN nw n ON s.k = n.k")
def k3(spark, sf):
    s, n = _stores(spark, sf)
    return K.upsert(s, n, ["k"], ["status", "title"])


@query("k3_upsert_keep_first", f"WITH {STORE} SELECT coalesce(s.k, n.k) AS k, coalesce(s.status, n.status) AS status FROM st s FULL JOIN nw n ON s.k = n.k")
def k3f(spark, sf):
    s, n = _stores(spark, sf)
    return K.upsert(s, n, ["k"], ["status"], keep="first")


@query("k4_write_if_changed", f"WITH {STORE} SELECT n.k, n.status FROM nw n LEFT JOIN st s ON s.k = n.k WHERE s.k IS NULL OR s.status IS DISTINCT FROM n.status OR s.title IS DISTINCT FROM n.title")
def k4(spark, sf):
    s, n = _stores(spark, sf)
    return K.changed(s, n, ["k"], ["status", "title"]).select("k", "status")


FEATURE_NAMES = ["f_num_post__none", "f_cat_organisation__name", "f_num_post__hashtags_number", "f_text_post__original_text"]


@query("k15_columns_description", "SELECT * FROM (VALUES ('0\tLabel\tf_label'), ('1\tNum\tf_num_post__none'), ('2\tCateg\tf_cat_organisation__name'), ('3\tNum\tf_num_post__hashtags_number'), ('4\tText\tf_text_post__original_text')) t(line)")
def k15(spark, sf):
    """The description of a training table's columns, written as a text file and read back."""
    from listwright.operators.feature_set import columns_description

    path = shared_folder(spark, "columns")
    text = columns_description(FEATURE_NAMES)
    spark.createDataFrame([(line,) for line in text.splitlines()], "value string").coalesce(1).write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "line")


# --- filters ------------------------------------------------------------------------------------------------------------
EXCLUDE, MUST = ["Idiot", "trash ", "license"], ["ein", "the and", "elle"]
HAS = lambda words, t: " OR ".join(f"contains({t}, '{w.lower()}')" for w in words)
LOWTEXT = "lower(coalesce(title, '') || ' ' || coalesce(description, ''))"


@query("p1_exclude_keywords", f"WITH {POSTS} SELECT id FROM posts WHERE NOT ({HAS(EXCLUDE, LOWTEXT)})")
def p1(spark, sf):
    return P.without_keywords(posts(spark, sf), EXCLUDE).select("id")


SCORED = "sc AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE (c_custkey % 10) / 10.0::DOUBLE END AS score, ['Zagtoon', 'Fred', 'Gucci', 'Dior'][CAST(c_custkey % 4 AS INT) + 1] AS org, c_custkey % 4 <> 3 AS active, CASE WHEN c_custkey % 10 <> 0 THEN c_name END AS title, CASE WHEN c_custkey % 20 <> 0 THEN 'd' END AS description FROM customer), th AS (SELECT *, CASE WHEN org = 'Zagtoon' THEN 0.7 WHEN org IN ('Brunello_Cucinelli', 'Fred') THEN 0.0 WHEN active THEN 0.2 END AS thr FROM sc)"


def scored(spark, sf):
    c = F.col("c_custkey")
    s = table(spark, sf, "customer").select(c.alias("id"), F.when(c % 9 != 0, (c % 10) / 10.0).alias("score"), F.element_at(F.array(*map(F.lit, ["Zagtoon", "Fred", "Gucci", "Dior"])), (c % 4 + 1).cast("int")).alias("org"), (c % 4 != 3).alias("active"), F.when(c % 10 != 0, F.col("c_name")).alias("title"), F.when(c % 20 != 0, F.lit("d")).alias("description"))
    return s.withColumn("thr", P.threshold_of(F.col("org"), F.col("active")))


PASS = "(coalesce(thr, 0) = 0 OR coalesce(score, 0) = 0 OR score > thr)"


@query("p4_p5_risk_threshold", f"WITH {SCORED} SELECT org, count(*) AS n, count(CASE WHEN {PASS} THEN 1 END) AS kept FROM th GROUP BY org")
def p4(spark, sf):
    return scored(spark, sf).groupBy("org").agg(F.count("*").alias("n"), F.count_if(P.passes(F.col("score"), F.col("thr"))).alias("kept"))


@query("p6_p9_score_filter", f"WITH {SCORED} SELECT id, (id * 2654435761 % 100 < 1) AND NOT (title IS NULL AND description IS NULL) AS unfiltered FROM th WHERE (title IS NULL AND description IS NULL) OR {PASS} OR id * 2654435761 % 100 < 1")
def p6(spark, sf):
    return P.filter_by_score(scored(spark, sf), F.col("thr"), P.one_percent(F.col("id"))).select("id", "unfiltered")


@query("p7_best_score", f"WITH {SCORED} SELECT id FROM th WHERE score IS NOT NULL AND greatest(score, score / 2) > 0.5")
def p7(spark, sf):
    s = scored(spark, sf).withColumn("scores", F.map_filter(F.create_map(F.lit("a"), F.col("score"), F.lit("b"), F.col("score") / 2), lambda k, v: v.isNotNull()))
    return s.where(P.best_score_passes(F.col("scores"), F.lit(0.5))).select("id")


@query("p10_p27_not_processed", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def p10(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id")).join(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti")


@query("p11_first_of_batch", "SELECT min(doc_id) AS id FROM documents WHERE text NOT IN (SELECT text FROM benchmark) GROUP BY text")
def p11(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("key"))
    seen = table(spark, sf, "benchmark").select(F.sha2("text", 256).alias("key"))
    return K.keep_first(d.join(seen, "key", "left_anti").select("id", "key"), ["key"], "id").select("id")


@query("p12_listing_skip", "SELECT doc_id AS id FROM documents WHERE doc_id % 10 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT page_id FROM pages)")
def p12(spark, sf):
    d = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 10 != 0, F.col("doc_id")).alias("id")).where("id is not null")
    return d.join(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti").join(table(spark, sf, "pages").select(F.col("page_id").alias("id")), "id", "left_anti")


@query("p15_w3_quota", "SELECT o_custkey AS organisation, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r <= 5 + o_custkey % 3 GROUP BY 1")
def p15(spark, sf):
    return K.running_quota(table(spark, sf, "orders"), "o_custkey", F.lit(5) + F.col("o_custkey") % 3, "o_orderdate", "o_orderkey").groupBy(F.col("o_custkey").alias("organisation")).agg(F.count("*").alias("n"))


@query("p16_p22_complete_posts", f"WITH {POSTS} SELECT id FROM posts WHERE (title <> '' OR description IS NOT NULL) AND id % 4 > 0 AND id % 4 < 3")
def p16(spark, sf):
    p = posts(spark, sf).withColumn("pictures", F.when(F.col("id") % 4 > 0, F.array(F.struct(F.lit("p").alias("picture_url"), F.when(F.col("id") % 4 < 3, F.lit("s")).alias("s3_url")))).otherwise(F.array().cast("array<struct<picture_url: string, s3_url: string>>")))
    return p.where(((F.col("title") != "") | F.col("description").isNotNull()) & (F.size("pictures") > 0) & F.exists("pictures", lambda x: x["s3_url"].isNotNull())).select("id")


NOW = 1704067200000000 + 3 * 3600 * 1000000


@query("p19_p20_due_tasks", f"WITH {TASKS} SELECT id, domain FROM act WHERE last_us IS NULL OR ({NOW} - last_us) / 1e6 > interval_s * (100 + last_us % 1000000 % 6) / 100")
def p19(spark, sf):
    from listwright.operators.schedule import active, due

    return due(active(tasks(spark, sf)), NOW).select("id", "domain")


_w = "string_split(trim(regexp_replace(lower(concat_ws(' ', title, description)), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' ')".replace("\\\\", "\\")


@query("p25_full_text", f"WITH {POSTS}, w AS (SELECT id, {_w} AS w FROM posts) SELECT id FROM w WHERE list_has_any(w, ['the', 'einer']) AND NOT list_has_any(w, ['idiot', 'trash'])")
def p25(spark, sf):
    return P.full_text(posts(spark, sf), "(the OR einer) AND NOT (idiot OR trash)").select("id")


@query("p26_label_values", "SELECT l_shipmode AS label, CASE WHEN l_shipmode = 'Tester' THEN 1 ELSE 0 END AS y, count(*) AS n FROM (SELECT ['Tester', 'Other', 'Fan Content'][CAST(l_orderkey % 3 AS INT) + 1] AS l_shipmode FROM lineitem) GROUP BY ALL")
def p26(spark, sf):
    from listwright.operators.feature_set import label_value

    li = table(spark, sf, "lineitem").select(F.element_at(F.array(*map(F.lit, ["Tester", "Other", "Fan Content"])), (F.col("l_orderkey") % 3 + 1).cast("int")).alias("label"))
    return li.groupBy("label", label_value(F.col("label")).alias("y")).agg(F.count("*").alias("n"))


@query("p28_query_urls", "SELECT r_name AS query, 'https://' || s || '.example.com/search?q=' || r_name || '&n=100' AS url FROM region CROSS JOIN (VALUES ('a'), ('b')) t(s)")
def p28(spark, sf):
    from listwright.operators.schedule import query_urls

    return query_urls(table(spark, sf, "region").select(F.col("r_name").alias("query")), ["https://a.example.com/search?q={SEARCH_QUERY}&n=MAX_POSTS_TO_BROWSE", "https://b.example.com/search?q={}&n=100"], 100)


_first = lambda org: " OR ".join(f"contains(lower(t), '{k}') OR contains(lower(d), '{k}')" for k in org)


@query("j13_keyword_dispatch", f"WITH {POSTS}, {KEYWORD_SQL}, k2 AS (SELECT keyword, max_by(organisation, pos) AS organisation FROM kw GROUP BY keyword) SELECT id, array_to_string(list_sort(list(DISTINCT organisation)), ',') AS organisations FROM posts JOIN k2 ON contains(lower(coalesce(title, '')), keyword) OR contains(lower(coalesce(description, '')), keyword) GROUP BY id")
def j13(spark, sf):
    return P.dispatch(posts(spark, sf), keyword_table(spark)).select("id", F.array_join("organisations", ",").alias("organisations"))


@query("j13_keyword_dispatch_by_join", f"WITH {POSTS}, {KEYWORD_SQL}, k2 AS (SELECT keyword, max_by(organisation, pos) AS organisation FROM kw GROUP BY keyword) SELECT id, array_to_string(list_sort(list(DISTINCT organisation)), ',') AS organisations FROM posts JOIN k2 ON contains(lower(coalesce(title, '')), keyword) OR contains(lower(coalesce(description, '')), keyword) GROUP BY id")
def j13b(spark, sf):
    return P.dispatch_by_join(posts(spark, sf), keyword_table(spark)).select("id", F.array_join("organisations", ",").alias("organisations"))


@query("a12_by_organisation", f"WITH {POSTS}, {KEYWORD_SQL}, k2 AS (SELECT keyword, max_by(organisation, pos) AS organisation FROM kw GROUP BY keyword), h AS (SELECT DISTINCT id, organisation FROM posts LEFT JOIN k2 ON contains(lower(coalesce(title, '')), keyword) OR contains(lower(coalesce(description, '')), keyword)) SELECT coalesce(organisation, 'no_organisation') AS organisation, count(*) AS n FROM h GROUP BY 1")
def a12(spark, sf):
    p = posts(spark, sf)
    d = p.join(P.dispatch(p, keyword_table(spark)), "id", "left")
    return P.by_organisation(d).groupBy("organisation").agg(F.count("*").alias("n"))
