"""Queries of the data sources and sinks that are written in Python: chains of answers, batches of log records."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.operators.rows import numbered_within
from listwright.plans.registry import query
from listwright.plans.views import table
from listwright.session import shared_folder
from listwright.sources import chains
from listwright.streaming import logs
from listwright.streaming.ledger import Ledger

PAGE = 20
_PAGES = f"SELECT coalesce(source, 'none') AS chain, doc_id, CAST((row_number() OVER (PARTITION BY coalesce(source, 'none') ORDER BY doc_id) - 1) // {PAGE} AS INT) AS page FROM documents"


def _saved(spark, sf) -> str:
    """Documents as saved answers: a chain for each source, whose pages lead on by the first id of the next."""
    d = table(spark, sf, "documents").select(F.coalesce("source", F.lit("none")).alias("chain"), "doc_id")
    n = numbered_within(d, ["chain"], [F.col("doc_id")], "n").withColumn("page", F.floor((F.col("n") - 1) / PAGE))
    pages = n.groupBy("chain", "page").agg(F.array_sort(F.collect_list("doc_id")).alias("items"))
    after = pages.select(F.col("chain").alias("c"), (F.col("page") - 1).alias("p"), F.col("items")[0].cast("string").alias("end_cursor"))
    pages = pages.join(after, (F.col("chain") == F.col("c")) & (F.col("page") == F.col("p")), "left")
    answer = F.to_json(F.struct("items", "end_cursor", F.col("end_cursor").isNotNull().alias("has_next")))
    path = shared_folder(spark, "answers")
    chains.save_answers(pages.select("chain", F.when(F.col("page") > 0, F.col("items")[0].cast("string")).alias("cursor"), answer.alias("answer")), path)
    spark.dataSource.register(chains.CursorPages)
    return path


@query("s12_cursor_source", _PAGES)
def s12(spark, sf):
    """All items of chains of answers, chains in parallel."""
    rows = spark.read.format("cursor_pages").load(_saved(spark, sf))
    return rows.select("chain", F.col("item").cast("long").alias("doc_id"), "page")


@query("s13_cursor_stream", _PAGES)
def s13(spark, sf):
    """The same by a stream that is stopped after each round of some pages, and goes on where it stopped."""
    path, place = _saved(spark, sf), shared_folder(spark, "rounds")
    most = table(spark, sf, "documents").groupBy("source").count().agg(F.max("count")).first()[0] or 0
    sink = Ledger(spark, f"{place}/sink")
    for _ in range(3):
        s = spark.readStream.format("cursor_pages").option("progress", f"{place}/progress").option("pages", most // PAGE // 2 + 1).load(path)
        s.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{place}/checkpoint").foreachBatch(sink.write).start().awaitTermination()
    return sink.read(chains.SCHEMA).select("chain", F.col("item").cast("long").alias("doc_id"), "page")


@query("k14_log_batches", "SELECT event_id, event_type, epoch_us(ts) // 1000 AS ms FROM events")
def k14(spark, sf):
    """Events as structured log records, written in batches and read back."""
    path = shared_folder(spark, "logs")
    spark.dataSource.register(logs.LogSink)
    e = table(spark, sf, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.to_json(F.struct("event_id", "event_type")).alias("message"))
    e.write.format("log_batches").mode("append").option("max_age", 10**9).save(path)
    r = logs.read_logs(spark, path).select("ms", F.from_json("message", "event_id long, event_type string").alias("m"))
    return r.select("m.event_id", "m.event_type", "ms")
