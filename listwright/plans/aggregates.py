"""Queries of aggregations and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from listwright.operators import datasets as S
from listwright.operators import evaluation as E
from listwright.operators import pages as G
from listwright.operators import schedule
from listwright.operators import store as K
from listwright.plans.registry import query
from listwright.plans.views import LABELLED, POSTS, TASKS, labelled, posts, table, tasks


@query("a1_month_count", "SELECT count(*) AS sent FROM events WHERE ts > date_trunc('month', (SELECT max(ts) FROM events)) AND ts < date_trunc('month', (SELECT max(ts) FROM events)) + INTERVAL 1 MONTH - INTERVAL 1 SECOND")
def a1(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    e = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    return K.month_count(e, F.col("ts"), F.col("now"))


@query("a3_f6_expected_load", f"WITH {TASKS} SELECT round(sum(900.0::DOUBLE / interval_s), 9) AS load, CAST(ceil(sum(900.0::DOUBLE / interval_s) * 1.2) AS BIGINT) AS most FROM act")
def a3(spark, sf):
    return schedule.expected_load(schedule.active(tasks(spark, sf)))


@query("a4_response_times", "SELECT event_type AS kind, count(*) AS n, CAST(round_even(coalesce(avg(CAST(value AS DOUBLE)), 0), 0) AS BIGINT) AS mean FROM events WHERE ts >= TIMESTAMP '2020-01-01' GROUP BY event_type")
def a4(spark, sf):
    return table(spark, sf, "events").where("ts >= timestamp_ntz'2020-01-01'").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.bround(F.coalesce(F.avg("value"), F.lit(0.0)), 0).cast("long").alias("mean"))


@query("a5_last_post", "SELECT c_custkey AS id, coalesce(max(o_orderdate), TIMESTAMP '1900-01-01') AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def a5(spark, sf):
    last = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    return table(spark, sf, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("id"), F.coalesce("last", F.lit("1900-01-01").cast("timestamp_ntz")).alias("last"))


@query("a6_distinct_names", "SELECT DISTINCT source AS domain FROM documents")
def a6(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("domain")).distinct()


@query("a7_frequent_groups", "SELECT source AS domain, lang, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) >= 10")
def a7(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("source").alias("domain"), "lang").agg(F.count("*").alias("n")).where("n >= 10")


@query("a8_label_histogram", f"WITH {LABELLED} SELECT domain, label, count(*) AS n FROM lab GROUP BY ALL")
def a8(spark, sf):
    return labelled(spark, sf).groupBy("domain", "label").agg(F.count("*").alias("n"))


@query("a9_balance_weights", f"WITH {LABELLED}, tr AS (SELECT * FROM lab WHERE id // 20 % 4 <> 0), te AS (SELECT * FROM lab WHERE id // 20 % 4 = 0), t AS (SELECT domain, label, count(*) AS tl FROM tr GROUP BY ALL), tp AS (SELECT domain, sum(tl) AS tn FROM t GROUP BY 1), a AS (SELECT sum(tn) AS an, count(*) AS o FROM tp), s AS (SELECT domain, label, count(*) AS sl FROM te GROUP BY ALL), sp AS (SELECT domain, sum(sl) AS sn FROM s GROUP BY 1) SELECT t.domain AS organisation, t.label, round(an / o / tn * (sl / sn * tn) / tl, 9) AS weight FROM t JOIN tp USING (domain) JOIN s USING (domain, label) JOIN sp USING (domain) CROSS JOIN a")
def a9(spark, sf):
    l = labelled(spark, sf).withColumnRenamed("domain", "organisation")
    return S.weights(l.where("id div 20 % 4 <> 0"), l.where("id div 20 % 4 = 0")).withColumn("weight", F.round("weight", 9))


@query("a10_fill_rates", f"WITH {POSTS} SELECT 'title' AS field, count(CASE WHEN length(title) > 1 THEN 1 END) AS found FROM posts UNION ALL SELECT 'description', count(CASE WHEN length(description) > 1 THEN 1 END) FROM posts UNION ALL SELECT 'domain', count(CASE WHEN length(domain) > 1 THEN 1 END) FROM posts")
def a10(spark, sf):
    return K.fill_rates(posts(spark, sf), ["title", "description", "domain"])


@query("a11_sum_of_maps", "SELECT l_returnflag AS key, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def a11(spark, sf):
    m = table(spark, sf, "lineitem").select(F.explode(F.create_map("l_returnflag", F.col("l_linenumber").cast("long"))).alias("key", "v"))
    return m.groupBy("key").agg(F.sum("v").alias("total"))


@query("a13_messages_by_domain", "SELECT source AS domain, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source")
def a13(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("source").alias("domain")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("a14_brand_counts", "SELECT p_brand AS brand, count(*) AS n, count(DISTINCT l_partkey) AS posts FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand")
def a14(spark, sf):
    return table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("posts"))


@query("a15_confusion", f"WITH {LABELLED} SELECT label, count(CASE WHEN round_even(score, 0) = 0 THEN 1 END) AS p0, count(CASE WHEN round_even(score, 0) = 1 THEN 1 END) AS p1 FROM lab GROUP BY label")
def a15(spark, sf):
    return E.confusion(labelled(spark, sf))


@query("a16_accuracy", f"WITH {LABELLED} SELECT domain, round(avg(CASE WHEN label = round_even(score, 0) THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM lab GROUP BY domain")
def a16(spark, sf):
    return labelled(spark, sf).groupBy("domain").agg(F.round(F.avg((F.col("label") == F.bround("score")).cast("int")), 9).alias("accuracy"))


CURVE = f"WITH {LABELLED}, g AS (SELECT domain, score AS threshold, count(*) AS n, sum(label) AS p FROM lab GROUP BY ALL), c AS (SELECT domain, threshold, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(n) OVER (PARTITION BY domain) AS an, sum(p) OVER (PARTITION BY domain) AS ap FROM g WINDOW w AS (PARTITION BY domain ORDER BY threshold DESC)), k AS (SELECT domain, threshold, cp / cn AS precision, CASE WHEN ap > 0 THEN cp / ap ELSE 0 END AS recall, (an - cn) / an AS rejected FROM c)"


@query("a17_pr_curve", f"{CURVE} SELECT domain, threshold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(rejected, 9) AS rejected FROM k")
def a17(spark, sf):
    return E.curve(labelled(spark, sf), ["domain"]).select("domain", "threshold", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "rejected")])


@query("a18_at_recall", f"{CURVE}, x AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY round(abs(recall - 0.98), 12), threshold) AS r FROM k), y AS (SELECT domain, threshold, precision, recall, rejected FROM x WHERE r = 1), z AS (SELECT * FROM y UNION ALL SELECT 'Average for all brands', avg(threshold), avg(precision), avg(recall), avg(rejected) FROM y) SELECT domain, round(threshold, 8) AS threshold, round(precision, 8) AS precision, round(recall, 8) AS recall, round(rejected, 8) AS rejected FROM z")
def a18(spark, sf):
    return E.at_recall(labelled(spark, sf), "domain").select("domain", *[F.round(c, 8).alias(c) for c in ("threshold", "precision", "recall", "rejected")])


@query("a19_at_threshold", f"{CURVE}, x AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY round(abs(threshold - 0.2), 12), threshold) AS r FROM k), l AS (SELECT domain, count(CASE WHEN score < 0.2 THEN 1 END) / count(*) AS rejected FROM lab GROUP BY domain), y AS (SELECT x.domain, precision, recall, l.rejected FROM x JOIN l USING (domain) WHERE r = 1), z AS (SELECT * FROM y UNION ALL SELECT 'Average for all brands', avg(precision), avg(recall), avg(rejected) FROM y) SELECT domain, round(precision, 8) AS precision, round(recall, 8) AS recall, round(rejected, 8) AS rejected FROM z")
def a19(spark, sf):
    return E.at_threshold(labelled(spark, sf), "domain").select("domain", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "rejected")])


@query("a20_average_precision", f"{CURVE} SELECT domain, round(sum(d * precision), 8) AS ap FROM (SELECT domain, precision, recall - coalesce(lag(recall) OVER (PARTITION BY domain ORDER BY threshold DESC), 0) AS d FROM k) GROUP BY domain")
def a20(spark, sf):
    return E.average_precision(labelled(spark, sf), "domain").select("domain", F.round("ap", 8).alias("ap"))


_NODES = "nd AS (SELECT doc_id % 60 AS page, doc_id AS node, toxic AS label, ((doc_id * 7919 + toxic * 37) % 101) / 100.0::DOUBLE AS score FROM labels WHERE toxic IS NOT NULL)"
_AP = """SELECT {g} AS g, sum((recall - coalesce(pr, 0)) * precision) AS ap FROM (SELECT {g}, precision, recall, lag(recall) OVER (PARTITION BY {g} ORDER BY t DESC) AS pr FROM (SELECT {g}, t, sum(p) OVER w / sum(n) OVER w AS precision, CASE WHEN sum(p) OVER (PARTITION BY {g}) > 0 THEN sum(p) OVER w / sum(p) OVER (PARTITION BY {g}) ELSE 0 END AS recall FROM (SELECT {g}, score AS t, count(*) AS n, sum(label) AS p FROM {t} GROUP BY ALL) WINDOW w AS (PARTITION BY {g} ORDER BY t DESC))) GROUP BY 1"""


@query(
    "a20_node_evaluation",
    f"""WITH {_NODES}, one AS (SELECT *, 0 AS z FROM nd), ap AS ({_AP.format(g='page', t='nd')}), mi AS ({_AP.format(g='z', t='one')}), b AS (SELECT page, max(label) AS has, arg_min(node, (-label, node)) AS l, arg_min(node, (-score, node)) AS s FROM nd GROUP BY page)
SELECT round(avg(CASE WHEN has > 0 AND l = s THEN 1.0::DOUBLE ELSE 0 END), 8) AS acc, round(avg(CASE WHEN has > 0 THEN ap ELSE 0 END), 8) AS macro_ap, (SELECT round(ap, 8) FROM mi) AS micro_ap, (SELECT round(sum(label * (score > 0.5)::INT) / sum((score > 0.5)::INT), 8) FROM nd) AS node_prec, (SELECT round(sum(label * (score > 0.5)::INT) / sum(label), 8) FROM nd) AS node_rec FROM b JOIN ap ON ap.g = b.page""",
)
def a20n(spark, sf):
    """How well scores name the nodes: best node by page, average precision by page and over all nodes, precision and recall of nodes."""
    l = table(spark, sf, "labels").where("toxic is not null").select((F.col("doc_id") % 60).alias("page"), F.col("doc_id").alias("node"), F.col("toxic").alias("label"), (F.pmod(F.col("doc_id") * 7919 + F.col("toxic") * 37, F.lit(101)) / 100.0).alias("score"))
    return E.node_evaluation(l, "page").select(*(F.round(c, 8).alias(c) for c in ("acc", "macro_ap", "micro_ap", "node_prec", "node_rec")))


@query("a21_medians", "SELECT l_returnflag AS flag, median(l_quantity) AS q, round(median(l_discount), 9) AS d FROM lineitem GROUP BY 1")
def a21(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.median("l_quantity").alias("q"), F.round(F.median("l_discount"), 9).alias("d"))


@query("a23_mode", "SELECT l_suppkey AS id, max_by(l_returnflag, (n, last)) AS mode FROM (SELECT l_suppkey, l_returnflag, count(*) AS n, max(l_orderkey) AS last FROM lineitem GROUP BY ALL) GROUP BY 1")
def a23(spark, sf):
    """The most frequent value; of equally frequent ones that which came last."""
    g = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"), F.max("l_orderkey").alias("last"))
    return g.groupBy(F.col("l_suppkey").alias("id")).agg(F.max_by("l_returnflag", F.struct("n", "last")).alias("mode"))


@query("a24_box_union", "SELECT l_orderkey AS id, min(l_quantity) AS x0, max(l_quantity + l_tax) AS x1, bool_or(l_returnflag = 'R') AS any_r, round(avg(l_discount), 9) AS mean FROM lineitem GROUP BY 1")
def a24(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_quantity").alias("x0"), F.max(F.col("l_quantity") + F.col("l_tax")).alias("x1"), F.bool_or(F.col("l_returnflag") == "R").alias("any_r"), F.round(F.avg("l_discount"), 9).alias("mean"))


@query("a25_weighted_mean", "SELECT l_suppkey AS id, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS mean FROM lineitem GROUP BY 1")
def a25(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 9).alias("mean"))


@query("a26_active_tasks", f"WITH {TASKS} SELECT domain, count(*) AS n FROM act GROUP BY domain")
def a26(spark, sf):
    return schedule.active(tasks(spark, sf)).groupBy("domain").agg(F.count("*").alias("n"))


@query("a27_column_ranges", "SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi, CAST(min(l_linenumber) AS BIGINT) AS klo, CAST(max(l_linenumber) AS BIGINT) AS khi FROM lineitem")
def a27(spark, sf):
    return table(spark, sf, "lineitem").agg(F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"), F.min("l_linenumber").cast("long").alias("klo"), F.max("l_linenumber").cast("long").alias("khi"))


@query("a28_sibling_similarity", "SELECT page_id, '/html[1]/body[1]/nav[1]/ul[1]/li[1]' AS path, 1.0::DOUBLE AS mean FROM pages WHERE len(regexp_extract_all(html, '<li><a ')) >= 3")
def a28(spark, sf):
    """The first items of lists, whose mean similarity to their siblings, five at most, is over 0.2."""
    s = G.sibling_similarity(table(spark, sf, "pages").select("page_id", "html")).where("siblings >= 2 and mean > 0.2")
    return s.where("path like '%/ul[1]/li[1]'").select("page_id", "path", F.round("mean", 9).alias("mean"))


@query("a29_funnel", "SELECT user_id % 20 AS task, count(*) AS searched, count(CASE WHEN event_type = 'view' THEN 1 END) AS filtered, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS sent FROM events GROUP BY 1")
def a29(spark, sf):
    t = F.col("event_type")
    return table(spark, sf, "events").groupBy((F.col("user_id") % 20).alias("task")).agg(F.count("*").alias("searched"), F.count_if(t == "view").alias("filtered"), F.count_if(t == "purchase").alias("sent"))


@query("a30_quota_alerts", "SELECT o_custkey AS organisation, n, quota, s AS share FROM (SELECT o_custkey, count(*) AS n, o_custkey % 30 + 4 AS quota FROM orders GROUP BY ALL), (VALUES (0.5::DOUBLE), (0.75::DOUBLE), (0.9::DOUBLE)) t(s) WHERE n = CAST(floor(s * quota) AS BIGINT)")
def a30(spark, sf):
    """Organisations that have just reached a half, three quarters or nine tenths of their own quota."""
    g = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("organisation")).agg(F.count("*").alias("n"))
    quotas = table(spark, sf, "customer").select(F.col("c_custkey").alias("organisation"), (F.col("c_custkey") % 30 + 4).alias("quota"))
    return E.quota_alerts(g, quotas, "organisation")
