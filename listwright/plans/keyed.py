"""Queries of stores that are written in place, sets of seen keys, sinks with a ledger and the text index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from listwright.operators import store as K
from listwright.operators.keyed_store import KeyedStore
from listwright.operators.seen import SeenSet
from listwright.operators.text_index import TextIndex
from listwright.plans.registry import query
from listwright.plans.views import POSTS, posts, table
from listwright.session import shared_folder
from listwright.streaming import jobs
from listwright.streaming.ledger import Ledger

COLUMNS = ["source", "segment", "city", "balance"]
#: Which of a client's changes is the last one.
ORDER = ["seq", *COLUMNS, "op"]
WEB = "'web'"
_last = lambda t, by: f"SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in by)}) = 1"
_st = f"st AS ({_last('(SELECT client_id, updated_at, ' + ', '.join(COLUMNS) + ' FROM clients WHERE source IS DISTINCT FROM ' + WEB + ')', ['updated_at', *COLUMNS])})"
_ch = f"ch AS ({_last('(SELECT client_id, seq, op, ' + ', '.join(COLUMNS) + ' FROM client_changes WHERE client_id IS NOT NULL)', ['seq', *COLUMNS, 'op'])})"
_both = f"WITH {_st}, {_ch}, b AS (SELECT coalesce(s.client_id, c.client_id) AS client_id, s.client_id IS NOT NULL AS known, c.client_id IS NOT NULL AS came, c.op = 'D' AS gone, {', '.join(f's.{x} AS s_{x}, c.{x} AS c_{x}' for x in COLUMNS)} FROM st s FULL JOIN ch c ON s.client_id = c.client_id)"
_same = " AND ".join(f"s_{x} IS NOT DISTINCT FROM c_{x}" for x in COLUMNS)


def _clients(spark, sf):
    """A store of clients, without those that come from the web, into which the log of changes is merged."""
    c = table(spark, sf, "clients").where("source is distinct from 'web'").select("client_id", "updated_at", *COLUMNS)
    return KeyedStore.create(c, shared_folder(spark, "clients"), ["client_id"], 16, ["updated_at"])


def _changes(spark, sf):
    return table(spark, sf, "client_changes").select("client_id", "seq", "op", *COLUMNS).withColumn("gone", F.col("op") == "D")


@query("k3_keyed_merge", f"{_both} SELECT client_id, {', '.join(f'CASE WHEN came THEN c_{x} ELSE s_{x} END AS {x}' for x in COLUMNS)} FROM b WHERE NOT came OR NOT gone")
def k3(spark, sf):
    """The store after its last changes by client were merged into the buckets that they touch."""
    store = _clients(spark, sf)
    store.merge(_changes(spark, sf), order=ORDER, delete="gone")
    return store.read().select("client_id", *COLUMNS)


@query("k5_keyed_results", f"{_both} SELECT client_id, CASE WHEN gone THEN CASE WHEN known THEN 'deleted' ELSE 'absent' END WHEN NOT known THEN 'inserted' WHEN {_same} THEN 'unchanged' ELSE 'updated' END AS result FROM b WHERE came UNION ALL SELECT client_id, 'refused' FROM client_changes WHERE client_id IS NULL")
def k5(spark, sf):
    """What became of each key of a bulk write; rows without a key are put aside."""
    store, changes = _clients(spark, sf), _changes(spark, sf)
    return store.merge(changes, order=ORDER, delete="gone").unionByName(store.refused(changes).select("client_id", F.lit("refused").alias("result")))


_S = "['SEARCHED', 'FILTERED_IN', 'FILTERED_OUT', 'SCRAPED', 'SENT']"


@query("k2_keyed_status", f"WITH o AS (SELECT o_orderkey AS id, {_S}[CAST(o_custkey % 5 AS INT) + 1] AS c FROM orders), n AS (SELECT l_orderkey AS id, arg_max({_S}[CAST(l_partkey % 5 AS INT) + 1], (l_linenumber, {_S}[CAST(l_partkey % 5 AS INT) + 1])) AS w FROM lineitem GROUP BY l_orderkey) SELECT coalesce(o.id, n.id) AS id, CASE WHEN w IS NULL THEN c WHEN c IS NULL THEN w WHEN w IN ('FILTERED_IN', 'FILTERED_OUT') AND c <> 'SEARCHED' THEN c WHEN w = 'SCRAPED' AND c = 'SENT' THEN c ELSE w END AS status FROM o FULL JOIN n ON o.id = n.id")
def k2(spark, sf):
    """Statuses of orders, moved on in place by what their last line wants, as far as the status machine allows."""
    s = lambda c: F.element_at(F.array(*map(F.lit, K.STATUSES)), (F.col(c) % 5 + 1).cast("int"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), s("o_custkey").alias("status"))
    store = KeyedStore.create(orders, shared_folder(spark, "statuses"), ["id"], 16)
    wanted = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", s("l_partkey").alias("status"))
    store.merge(wanted, order=["l_linenumber"], combine={"status": K.next_status})
    return store.read()


@query("p10_seen_store", "SELECT click_id FROM clicks WHERE client_id IS NULL OR client_id NOT IN (SELECT client_id FROM sales WHERE client_id IS NOT NULL)")
def p10(spark, sf):
    """Clicks of clients who have bought nothing: clients of sales are a set of seen keys, filled in two steps, and only its buckets that may have a client are read."""
    sales = table(spark, sf, "sales").select("client_id", "status")
    seen = SeenSet.create(sales.where("status = 'done'").select("client_id"), shared_folder(spark, "seen"), 16, 4)
    seen.add(sales.where("status is distinct from 'done'").select("client_id"))
    return seen.unseen(table(spark, sf, "clicks").select("click_id", "client_id")).select("click_id")


@query("r1_replayed_batches", "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error'")
def r1(spark, sf):
    """Messages in micro-batches of which each is delivered twice: all are there once."""
    place = shared_folder(spark, "replayed")
    ledger = Ledger(spark, f"{place}/sink")
    table(spark, sf, "events").withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(4))).write.partitionBy("part").parquet(f"{place}/in")
    s = spark.readStream.schema(jobs.EVENTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 2).parquet(f"{place}/in")

    def each(df, batch):
        for _ in range(2):
            ledger.write(df.where("event_type <> 'error'"), batch)

    s.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{place}/checkpoint").foreachBatch(each).start().awaitTermination()
    return ledger.read(jobs.EVENTS).select("event_id", "user_id", "event_type")


@query("p25_indexed_search", f"WITH {POSTS}, w AS (SELECT id, regexp_split_to_array(lower(concat_ws(' ', title, description)), '[^\\p{{L}}\\p{{N}}_]+') AS w FROM posts) SELECT id FROM w WHERE (list_has_any(w, ['the', 'einer']) AND NOT list_has_any(w, ['idiot', 'trash'])) OR list_has_all(w, ['license', 'under'])")
def p25(spark, sf):
    """A boolean query on an index of all posts that was made in two segments, of which only the query's words are read."""
    p = posts(spark, sf)
    index = TextIndex(spark, shared_folder(spark, "index"))
    index.add(p.where("lang = 'en'"))
    index.add(p.where("lang is distinct from 'en'"))
    return index.search("((the OR einer) AND NOT (idiot OR trash)) OR license under")
