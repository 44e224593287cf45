"""Streaming jobs over file sources. Each runs until its input is read (availableNow) and returns what its sink holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from listwright.session import settings, shared_folder
from listwright.streaming.ledger import Ledger

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream, with an event time that watermarks accept."""
    path = f"{sf_dir}/events.parquet"
    single = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = single.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(EVENTS)
    # a file source reads folders; a table that is one file is the only match of its own name in its folder
    s = reader.parquet(path) if fs.getFileStatus(single).isDirectory() else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


#: State in RocksDB, for jobs with state of their own.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run(stream: DataFrame, mode: str = "append", each: Callable | None = None, conf: dict[str, str] | None = None) -> DataFrame:
    """Start, wait for the end of the input, and read the sink back. Checkpoint and sink are in the shared folder. conf: settings that the stream takes when it starts."""
    spark = stream.sparkSession
    place = shared_folder(spark, "stream")
    if each is None and mode == "complete":
        each = lambda df, _: df.write.mode("overwrite").parquet(f"{place}/out")  # noqa: E731  the last batch holds everything
    w = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{place}/checkpoint").outputMode(mode)
    with settings(spark, conf or {}):
        q = (w.foreachBatch(each) if each else w.format("parquet").option("path", f"{place}/out")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def window_counts(s: DataFrame, length: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """start, event_type, n of each window. Windows that ended so long before the newest event are forgotten by the state; later rows of them are dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return s.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def run_counts(counts: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Run a stream of growing counts in update mode, with state only for what can still change, and read each key's last count back."""
    spark = counts.sparkSession
    place = shared_folder(spark, "counts")
    sink = Ledger(spark, f"{place}/out")
    counts.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{place}/checkpoint").outputMode("update").foreachBatch(sink.write).start().awaitTermination()
    return sink.read(counts.schema).groupBy(*keys).agg(F.max(count).alias(count))


def sessions(s: DataFrame, gap: str) -> DataFrame:
    return s.withWatermark("ts", gap).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


#: The user of the event that ends a stream.
LAST = -1


def ended(s: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a stream (ts and user_id among them) with an event of user LAST in the far future, which closes what would stay open until a later event came."""
    spark = s.sparkSession
    path = shared_folder(spark, "end")
    schema = s.select(*columns).schema
    kinds = {"ts": F.lit("2200-01-01").cast("timestamp"), "user_id": F.lit(LAST).cast("long")}
    spark.range(1).select(*(kinds.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)).write.parquet(path)
    return s.select(*columns).unionByName(spark.readStream.schema(schema).parquet(path))


def consumed(spark: SparkSession, path: str, schema: str, pattern: str) -> DataFrame:
    """Rows of a folder's files whose key matches a pattern, read once: files that were read are deleted."""
    s = spark.readStream.schema(schema).option("cleanSource", "delete").parquet(path).where(F.col("key").rlike(pattern))
    place = shared_folder(spark, "consumed")
    sink = Ledger(spark, f"{place}/out")
    for _ in range(2):  # files go once a later batch has been committed
        s.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{place}/checkpoint").foreachBatch(sink.write).start().awaitTermination()
    return sink.read(schema)


def deduplicated(s: DataFrame, keys: list[str], horizon: str) -> DataFrame:
    """The first row of each key within a horizon."""
    return s.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(keys)


class Status(StatefulProcessor):
    """The upload status of a key: it only moves forward, and is forgotten after a time to live without news, by the stream's own time."""

    ORDER = {"started": 0, "failed": 1, "ended": 2, "sent_to_insertion": 3}

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("status", "rank int, ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rank, last = self.state.get() if self.state.exists() else (None, None)
        if last is not None:
            self.handle.deleteTimer(last + self.ttl_ms)
        for ms, status in sorted((int(t.value // 1_000_000), s) for f in rows for t, s in zip(f["ts"], f["status"], strict=True)):
            new = self.ORDER[status]
            rank = new if rank is None or ms - last > self.ttl_ms else max(rank, new)
            last = ms if last is None else max(last, ms)
        self.state.update((rank, last))
        self.handle.registerTimer(last + self.ttl_ms)
        yield pd.DataFrame({"user_id": [key[0]], "rank": [rank], "ms": [last]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def furthest_status(s: DataFrame) -> DataFrame:
    """user_id, rank of the furthest status, by (user_id, status) rows, as a native streaming aggregate; state is kept as long as the job's."""
    rank = F.lit(None).cast("int")
    for name, r in Status.ORDER.items():
        rank = F.when(F.col("status") == name, F.lit(r)).otherwise(rank)
    return s.groupBy("user_id").agg(F.max(rank).alias("rank"))


def statuses(s: DataFrame, ttl_hours: int = 48) -> DataFrame:
    """user_id, rank of the furthest status, ms of the last news, by rows (user_id, ts, status); state is kept for ttl_hours of the stream's time; start it with ROCKS.

    A call to Python's state server for each key: much slower than furthest_status, for jobs that need the time to live.
    """
    return s.withWatermark("ts", "1 hour").groupBy("user_id").transformWithStateInPandas(statefulProcessor=Status(ttl_hours * 3_600_000), outputStructType="user_id long, rank int, ms long", outputMode="Update", timeMode="EventTime")


def latest_statuses(s: DataFrame, ttl_hours: int = 48) -> DataFrame:
    """user_id, rank, ms: the last answer of statuses() for each key, read back from its updates."""
    spark = s.sparkSession
    place = shared_folder(spark, "statuses")
    out = statuses(s, ttl_hours)
    sink = Ledger(spark, f"{place}/out")
    with settings(spark, ROCKS):
        q = out.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{place}/checkpoint").outputMode("update").foreachBatch(sink.write).start()
    q.awaitTermination()
    return sink.read(out.schema).groupBy("user_id").agg(F.max(F.struct("ms", "rank")).alias("x")).select("user_id", "x.rank", "x.ms")


class Overdue(StatefulProcessor):
    """Tasks that were started and not ended within an age: a timer for each open task, taken back when it ends."""

    def __init__(self, age_ms: int):
        self.age_ms = age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("started", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # state is read and written once for all rows: each call goes to the state server
        before = self.state.get()[0] if self.state.exists() else None
        open_ = before
        for ms, status in sorted((int(t.value // 1_000_000), s) for f in rows for t, s in zip(f["ts"], f["status"], strict=True)):
            if status == "ended":
                open_ = None
            elif status == "started" and open_ is None:
                open_ = ms
        if open_ != before:
            if before is not None:
                self.handle.deleteTimer(before + self.age_ms)
            if open_ is None:
                self.state.clear()
            else:
                self.state.update((open_,))
                self.handle.registerTimer(open_ + self.age_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        started = self.state.get()[0]
        self.state.clear()
        yield pd.DataFrame({"user_id": [key[0]], "started_ms": [started]})

    def close(self) -> None:
        pass


def overdue(s: DataFrame, age_hours: int = 24) -> DataFrame:
    """user_id, started_ms of tasks that are open for longer than an age, by rows (user_id, ts, status); by the stream's own time. Start it with ROCKS."""
    return s.withWatermark("ts", "1 hour").groupBy("user_id").transformWithStateInPandas(statefulProcessor=Overdue(age_hours * 3_600_000), outputStructType="user_id long, started_ms long", outputMode="Append", timeMode="EventTime")
