"""Queries of streams; those that run to the end of their input have the batch form as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.plans.registry import query
from listwright.plans.views import table
from listwright.session import shared_folder
from listwright.streaming import jobs
from listwright.streaming.ledger import Ledger


@query("r4_tumbling_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def r4(spark, sf):
    return jobs.run_counts(jobs.window_counts(jobs.events(spark, sf), "1 hour"), ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("r4_sliding_counts", "SELECT s AS start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b, event_type FROM events), LATERAL (SELECT unnest([b, b - INTERVAL 30 MINUTE]) AS s) GROUP BY ALL")
def r4s(spark, sf):
    return jobs.run_counts(jobs.window_counts(jobs.events(spark, sf), "1 hour", "30 minutes"), ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("r10_monthly_usage", "SELECT date_trunc('month', ts) AS month, user_id % 20 AS organisation, count(*) AS n FROM events GROUP BY ALL")
def r10(spark, sf):
    s = jobs.events(spark, sf).groupBy(F.date_trunc("month", "ts").alias("month"), (F.col("user_id") % 20).alias("organisation")).agg(F.count("*").alias("n"))
    return jobs.run(s, "complete").withColumn("month", F.col("month").cast("timestamp_ntz"))


@query("r5_seen_set", "SELECT DISTINCT user_id FROM events")
def r5(spark, sf):
    """Each user once: later events within the horizon are dropped from the stream."""
    return jobs.run(jobs.deduplicated(jobs.events(spark, sf), ["user_id"], "365 days").select("user_id"))


@query("r1_s10_micro_batches", "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY event_type")
def r1(spark, sf):
    """Messages handled in micro-batches; a failed one is consumed as well, and logged apart."""
    out = shared_folder(spark, "handled")

    done, failed = Ledger(spark, f"{out}/done"), Ledger(spark, f"{out}/failed")

    def each(df, batch):
        done.write(df.where("event_type <> 'error'"), batch)
        failed.write(df.where("event_type = 'error'"), batch)

    s = jobs.events(spark, sf)
    s.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}/checkpoint").foreachBatch(each).start().awaitTermination()
    return done.read(s.schema).groupBy("event_type").agg(F.count("*").alias("n"))


@query("r2_status_machine", "SELECT user_id, max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'error' THEN 1 ELSE 0 END) AS rank FROM events GROUP BY user_id")
def r2(spark, sf):
    t = F.col("event_type")
    s = jobs.events(spark, sf).select("user_id", F.when(t == "purchase", "sent_to_insertion").when(t == "click", "ended").when(t == "error", "failed").otherwise("started").alias("status"))
    return jobs.run(jobs.furthest_status(s), "complete")


_RANK = "CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'error' THEN 1 ELSE 0 END"


@query("r2_statuses_with_ttl", f"WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, {_RANK} AS rank FROM events WHERE user_id IS NOT NULL), g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) > 6 * 3600000 THEN 1 ELSE 0 END AS fresh FROM e), k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS life FROM g), l AS (SELECT user_id, max(life) AS life FROM k GROUP BY user_id) SELECT user_id, CAST(max(rank) AS INT) AS rank, CAST(max(ms) AS BIGINT) AS ms FROM k JOIN l USING (user_id, life) GROUP BY user_id")
def r2t(spark, sf):
    """The status machine with statuses that are forgotten after six hours without news."""
    t = F.col("event_type")
    s = jobs.events(spark, sf).where("user_id is not null").select("ts", "user_id", F.when(t == "purchase", "sent_to_insertion").when(t == "click", "ended").when(t == "error", "failed").otherwise("started").alias("status"))
    return jobs.latest_statuses(s, 6)


@query("r2_sessions", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, k")
def sessions(spark, sf):
    """Sessions of users; the end of the stream closes those that are open."""
    s = jobs.ended(jobs.events(spark, sf), ["ts", "user_id"])
    return jobs.run(jobs.sessions(s, "30 minutes")).where(F.col("user_id") != jobs.LAST).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("r5_last_ids", "WITH s AS (SELECT user_id % 10 AS organisation, event_id AS id, ts, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_id % 2 = 0) SELECT user_id % 10 AS organisation, event_id AS id FROM events WHERE event_id % 3 = 0 AND (user_id % 10, event_id) NOT IN (SELECT organisation, id FROM s WHERE k <= 100)")
def r5l(spark, sf):
    """Arrivals without those among the last hundred ids that each organisation has stored."""
    from listwright.operators import store as K

    e = table(spark, sf, "events").select((F.col("user_id") % 10).alias("organisation"), F.col("event_id").alias("id"), "ts")
    return K.unseen(e.where("id % 3 = 0"), e.where("id % 2 = 0"), "organisation", "id", "ts", 100).select("organisation", "id")


@query("r3_request_fan_out", "SELECT doc_id AS id, kind, u AS url FROM (SELECT doc_id, 'POST' AS kind, unnest(['p' || doc_id, 'q' || doc_id]) AS u FROM documents UNION ALL SELECT doc_id, 'POSTER', 'u' || doc_id FROM documents WHERE doc_id % 2 = 0)")
def r3(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("s"))
    posts = d.select("id", F.lit("POST").alias("kind"), F.explode(F.array(F.concat(F.lit("p"), "s"), F.concat(F.lit("q"), "s"))).alias("url"))
    return posts.unionByName(d.where("id % 2 = 0").select("id", F.lit("POSTER").alias("kind"), F.concat(F.lit("u"), "s").alias("url")))


@query("r6_ttl_cache", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY user_id")
def r6(spark, sf):
    e = table(spark, sf, "events")
    e = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).where(F.col("ts") >= F.col("now") - F.expr("INTERVAL 30 DAY"))
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("r7_f4_overdue_tasks", "SELECT event_id AS id, date_diff('day', CAST(ts AS DATE), DATE '2025-06-01') AS days FROM events WHERE date_diff('day', CAST(ts AS DATE), DATE '2025-06-01') >= 1 AND event_type = 'view'")
def r7(spark, sf):
    d = F.datediff(F.lit("2025-06-01"), F.to_date("ts"))
    return table(spark, sf, "events").where((d >= 1) & (F.col("event_type") == "view")).select(F.col("event_id").alias("id"), d.cast("long").alias("days"))


@query("r9_queue_levels", "SELECT user_id % 10 AS queue, count(*) AS n, CASE WHEN count(*) > 500 THEN 'up' WHEN count(*) < 200 THEN 'down' ELSE 'stay' END AS scale FROM events GROUP BY 1")
def r9(spark, sf):
    g = table(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("queue")).agg(F.count("*").alias("n"))
    return g.withColumn("scale", F.when(F.col("n") > 500, "up").when(F.col("n") < 200, "down").otherwise("stay"))


_VERB = "CASE event_type WHEN 'purchase' THEN 'del' WHEN 'error' THEN 'hdel' WHEN 'view' THEN 'set' ELSE 'hset' END"


@query("r11_key_values", f"WITH l AS (SELECT event_id AS seq, {_VERB} AS verb, 'task:' || user_id AS key, CASE WHEN event_type IN ('view', 'purchase') THEN NULL ELSE 'f' || event_id % 3 END AS field, event_type || event_id AS value FROM events), g AS (SELECT key, max(seq) AS gone FROM l WHERE verb = 'del' GROUP BY key), x AS (SELECT key, field, max(seq) AS seq, arg_max(verb, seq) AS verb, arg_max(value, seq) AS value FROM l WHERE verb <> 'del' GROUP BY key, field) SELECT key, field, value FROM x LEFT JOIN g USING (key) WHERE verb <> 'hdel' AND (gone IS NULL OR seq > gone) AND key LIKE 'task:1%'")
def r11(spark, sf):
    """What a log of verbs leaves in a key-value store, for the keys that a scan asks for."""
    from listwright.operators import store as K

    t = F.col("event_type")
    verb = F.when(t == "purchase", "del").when(t == "error", "hdel").when(t == "view", "set").otherwise("hset")
    field = F.when(~t.isin("view", "purchase"), F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")))
    log = table(spark, sf, "events").select(F.col("event_id").alias("seq"), verb.alias("verb"), F.concat(F.lit("task:"), F.col("user_id").cast("string")).alias("key"), field.alias("field"), F.concat(t, F.col("event_id").cast("string")).alias("value"))
    return K.key_values(log, "^task:1")


@query("r7_overdue_timers", "WITH e AS (SELECT user_id, ts, event_type FROM events WHERE event_type IN ('view', 'purchase')), p AS (SELECT user_id, max(ts) AS last FROM e WHERE event_type = 'purchase' GROUP BY user_id) SELECT user_id, CAST(epoch_us(min(ts)) // 1000 AS BIGINT) AS started_ms FROM e LEFT JOIN p USING (user_id) WHERE event_type = 'view' AND (last IS NULL OR ts > last) GROUP BY user_id")
def r7t(spark, sf):
    """Tasks that were started and never ended, when the day that they may take is over; the end of the stream lets all timers run out."""
    t = F.col("event_type")
    s = jobs.events(spark, sf).where(t.isin("view", "purchase")).select("ts", "user_id", F.when(t == "purchase", "ended").otherwise("started").alias("status"))
    return jobs.run(jobs.overdue(jobs.ended(s, ["ts", "user_id", "status"])), conf=jobs.ROCKS).where(F.col("user_id") != jobs.LAST)
