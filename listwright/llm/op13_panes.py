"""Panes of clicks by kind and hour, published when due, with revisions for rows that come after.

Method: clicks are cut into BATCHES, which arrive one after another in one folder. For each, the same streaming query is started
anew on one checkpoint: a native groupBy of kind and event hour keeps counts and sums as state and hands on, in update mode, the
panes that this batch has changed; a watermark of four days lets the state of closed panes go. foreachBatch joins the changed panes
to the persisted table of open panes and writes the table's next version, in which each pane has the records that the batch makes of
it. Rows of closed panes never reach the aggregation. A batch that is run again overwrites what it wrote, so that nothing is there twice.

What goes to the driver is one time for each batch. The folders go when the result is written, as a table of its own.

Edge cases: rows without ts are left out; of rows with one click_id the least by ts, arrival, kind and value stays; rows without a
click_id are rows of their own, without a delay; a null arrived_at is the ts; a null kind is `none`, so it shares the panes of that name; a
null, infinite or NaN value is 0 cents. Batches without rows are run as well, an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwright.session import shared_dir, shared_table

BATCHES = 8
DAY, HOUR = 86_400_000_000, 3_600_000_000
#: Microseconds after the end of a pane's hour at which it is due, and closed.
DUE, CLOSED = 6 * HOUR, 96 * HOUR
#: Event times are moved on by so much as the stream's time, as a watermark begins at 1970.
SHIFT = 800_000 * DAY
ROWS = "click_id long, event long, hour long, kind string, cents long"
PANES = "kind string, hour long, n_rows long, cents long, emitted boolean, open boolean, batch long, records array<struct<record: string, n_rows: long, cents: long>>"
RECORDS = "batch long, hour long, click_id long, n_rows long, cents long, record string, kind string"


def _micros(c: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def _floor(x: Column, by: int) -> Column:
    return F.round((x - F.pmod(x, F.lit(by))) / by).cast("long")


def batches_of(clicks: DataFrame) -> DataFrame:
    """batch int, and ROWS: each click once, with its event time in microseconds and its event hour."""
    c = clicks.where("ts is not null").select(F.col("click_id").cast("long").alias("click_id"), F.struct("ts", "arrived_at", "kind", F.col("value").cast("double").alias("value")).alias("x"))
    # rows without an id are not put into one group
    c = c.where("click_id is not null").groupBy("click_id").agg(F.min("x").alias("x")).unionByName(c.where("click_id is null"))
    ts, day = _micros(F.col("x.ts")), _floor(_micros(F.coalesce("x.arrived_at", "x.ts")), DAY)
    cents = F.when(F.col("x.value").isNull() | F.isnan("x.value") | (F.abs("x.value") == float("inf")), F.lit(0)).otherwise(F.floor(100 * F.col("x.value") + 0.5))
    c = c.select("click_id", ts.alias("ts"), day.alias("day"), F.pmod(day, F.lit(BATCHES)).alias("q"), F.coalesce("x.kind", F.lit("none")).alias("kind"), cents.cast("long").alias("cents"))
    delay = F.greatest(F.lit(0), F.crc32(F.col("click_id").cast("string").cast("binary")) % 30 - 23)
    c = c.withColumn("batch", F.least(F.lit(BATCHES - 1), F.col("q") + delay).cast("int")).withColumn("event", F.col("ts") - (F.col("day") - F.col("q")) * DAY)
    return c.select("click_id", "event", _floor(F.col("event"), HOUR).alias("hour"), "kind", "cents", "batch")


def _passed(hour: Column, after: int, watermark: int | None) -> Column:
    """Whether the watermark has come to so long after the hour's end."""
    return F.lit(False) if watermark is None else hour <= (watermark - after) // HOUR - 1


def totals(rows: DataFrame, watermark: int | None) -> DataFrame:
    """kind, hour, n_rows, cents of panes that are not closed: kept as state over a stream."""
    timed = rows.withColumn("time", F.timestamp_micros(F.col("event") + F.lit(SHIFT))).withWatermark("time", "4 days")
    w = timed.where(~_passed(F.col("hour"), CLOSED, watermark)).groupBy(F.window("time", "1 hour"), "kind", "hour").agg(F.count("*").alias("n_rows"), F.sum("cents").alias("cents"))
    return w.select("kind", "hour", "n_rows", "cents")


def publish(changes: DataFrame, panes: DataFrame, batch: int, watermark: int | None, last: bool) -> DataFrame:
    """PANES after a batch: totals, whether the pane has been emitted and is still open, and the batch's records of it."""
    old = panes.where("open").select("kind", "hour", F.col("n_rows").alias("old_n"), F.col("cents").alias("old_cents"), "emitted")
    x = changes.withColumn("changed", F.lit(True)).join(old, ["kind", "hour"], "full_outer")
    x = x.select("kind", "hour", F.coalesce("n_rows", "old_n").alias("n"), F.coalesce("cents", "old_cents").alias("c"), "old_n", "old_cents", F.coalesce("emitted", F.lit(False)).alias("emitted"), F.coalesce("changed", F.lit(False)).alias("changed"))
    due = _passed(F.col("hour"), DUE, watermark)
    record = lambda name, n, c: F.struct(F.lit(name).alias("record"), F.col(n).alias("n_rows"), F.col(c).alias("cents"))
    made = F.when(F.col("emitted") & F.col("changed"), F.array(record("retract", "old_n", "old_cents"), record("replace", "n", "c")))
    made = made.when(~F.col("emitted") & due, F.array(record("emit", "n", "c")))
    if last:
        made = made.when(~F.col("emitted"), F.array(record("final", "n", "c")))
    return x.select("kind", "hour", F.col("n").alias("n_rows"), F.col("c").alias("cents"), (F.col("emitted") | due).alias("emitted"), (~_passed(F.col("hour"), CLOSED, watermark)).alias("open"), F.lit(batch).cast("long").alias("batch"), made.alias("records"))


def late(rows: DataFrame, batch: int, watermark: int | None) -> DataFrame:
    """Records of rows whose panes are closed."""
    return rows.where(_passed(F.col("hour"), CLOSED, watermark)).select(F.lit(batch).cast("long").alias("batch"), "hour", "click_id", F.lit(1).cast("long").alias("n_rows"), "cents", F.lit("late").alias("record"), "kind")


def _quiet(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams run no batch without data; the caller's settings stay as they are."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return own


def pane_records(clicks: DataFrame) -> DataFrame:
    """batch, hour, click_id, n_rows, cents, record, kind of all batches."""
    spark = clicks.sparkSession
    own, place = _quiet(spark), f"{shared_dir(spark)}/panes-{uuid.uuid4().hex}"
    cut = batches_of(clicks)
    cut.write.partitionBy("batch").parquet(f"{place}/cut")
    schema = T._parse_datatype_string(ROWS)
    whole = own.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{place}/cut")
    newest = {r.batch: r.event for r in whole.groupBy("batch").agg(F.max("event").alias("event")).collect()}
    own.createDataFrame([], PANES).write.parquet(f"{place}/panes-0")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(place).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{place}/in"))
    # panes are much fewer than rows: some of a batch's small partitions are written as one file
    watermark, files = None, -(-int(own.conf.get("spark.sql.shuffle.partitions")) // 8)
    for b in range(BATCHES):
        if b in newest:
            fs.rename(path(f"{place}/cut/batch={b}"), path(f"{place}/in/{b}"))
        else:
            own.createDataFrame([], schema).write.parquet(f"{place}/in/{b}")
        stream = totals(own.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{place}/in"), watermark)

        def each(changes: DataFrame, _: int, b=b, watermark=watermark) -> None:
            panes = own.read.schema(PANES).parquet(f"{place}/panes-{b}")
            publish(changes, panes, b, watermark, b == BATCHES - 1).coalesce(files).write.mode("overwrite").parquet(f"{place}/panes-{b + 1}")
            late(own.read.schema(schema).parquet(f"{place}/in/{b}"), b, watermark).write.mode("overwrite").parquet(f"{place}/late/{b}")

        stream.writeStream.outputMode("update").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
        if b in newest:
            watermark = max(watermark, newest[b]) if watermark is not None else newest[b]
    panes = spark.read.schema(PANES).parquet(*(f"{place}/panes-{b + 1}" for b in range(BATCHES)))
    found = panes.select("batch", "hour", F.lit(-1).cast("long").alias("click_id"), F.explode("records").alias("r"), "kind").select("batch", "hour", "click_id", "r.n_rows", "r.cents", "r.record", "kind")
    lates = spark.read.schema(RECORDS).option("recursiveFileLookup", "true").parquet(f"{place}/late")
    found = shared_table(found.unionByName(lates), "pane-records")
    fs.delete(path(place), True)
    return found
