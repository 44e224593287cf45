"""Structured logs as a sink: records are put together to batches bounded by number, bytes and age, and count when their epoch is committed.

    spark.dataSource.register(LogSink)
    stream.writeStream.format("log_batches").option("path", place).option("checkpointLocation", c).start()
    spark.streams.addListener(ProgressLog(place))    # progress of streams as records

Rows have `ms` (time in milliseconds) and `message`. A batch is a file of JSON lines; a task that fails leaves files that no epoch names. Folders are
reached by pyarrow's file systems.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "ms long, message string"
# Limits of a batch as log services have them (records, bytes, seconds), what a record costs besides its text, and the longest record.
MAX_COUNT, MAX_BYTES, MAX_AGE_S, OVERHEAD, MAX_RECORD = 10_000, 1 << 20, 60, 26, (1 << 18) - 26


@dataclass(frozen=True)
class Limits:
    count: int = MAX_COUNT
    bytes: int = MAX_BYTES
    age_ms: int = MAX_AGE_S * 1000

    @classmethod
    def of(cls, options: dict) -> Limits:
        return cls(int(options.get("max_count", MAX_COUNT)), int(options.get("max_bytes", MAX_BYTES)), int(float(options.get("max_age", MAX_AGE_S)) * 1000))


def batches(records: Iterable[tuple[int | None, str | None]], limits: Limits) -> Iterator[list[dict]]:
    """Records (ms, message) in their order as batches; one that is too long is cut into several records, a null message is empty."""
    held, size, first = [], 0, None
    for ms, message in records:
        for part in parts_of(message or ""):
            cost = len(part.encode()) + OVERHEAD
            if held and (len(held) >= limits.count or size + cost > limits.bytes or (ms is not None and first is not None and abs(ms - first) >= limits.age_ms)):
                yield held
                held, size, first = [], 0, None
            first = ms if first is None else first
            held.append({"ms": ms, "message": part})
            size += cost
    if held:
        yield held


def parts_of(message: str) -> Iterator[str]:
    """The message, or parts of at most MAX_RECORD bytes that make it up."""
    while len(message) * 4 > MAX_RECORD and len(raw := message.encode()) > MAX_RECORD:
        part = raw[:MAX_RECORD].decode("utf-8", "ignore")
        yield part
        message = message[len(part) :]
    yield message


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Sink:
    def __init__(self, options: dict):
        self.path, self.limits = options["path"], Limits.of(options)

    def _fs(self) -> tuple[fs.FileSystem, str]:
        system, inner = fs.FileSystem.from_uri(self.path)
        return system, inner.rstrip("/")

    def put(self, held: list[dict]) -> str:
        system, inner = self._fs()
        system.create_dir(f"{inner}/batches", recursive=True)
        name = f"{uuid.uuid4().hex}.jsonl"
        with system.open_output_stream(f"{inner}/batches/{name}") as f:
            f.write("".join(json.dumps(r) + "\n" for r in held).encode())
        return name

    def write(self, rows: Iterator) -> Written:
        return Written([self.put(b) for b in batches(((r["ms"], r["message"]) for r in rows), self.limits)])

    def name_epoch(self, epoch: str, files: list[str]) -> bool:
        """Make files count, unless the epoch is there already: then they go."""
        system, inner = self._fs()
        system.create_dir(f"{inner}/epochs", recursive=True)
        target = f"{inner}/epochs/{epoch}.json"
        if system.get_file_info(target).type == fs.FileType.File:
            self.drop(files)
            return False
        with system.open_output_stream(f"{target}.tmp") as f:
            f.write(json.dumps(files).encode())
        system.move(f"{target}.tmp", target)
        return True

    def drop(self, files: list[str]) -> None:
        system, inner = self._fs()
        for n in files:
            system.delete_file(f"{inner}/batches/{n}")


def _all(messages: list[Written | None]) -> list[str]:
    return [f for m in messages if m is not None for f in m.files]


class StreamWriter(_Sink, DataSourceStreamWriter):
    def commit(self, messages, batchId: int) -> None:
        self.name_epoch(f"stream-{batchId}", _all(messages))

    def abort(self, messages, batchId: int) -> None:
        self.drop(_all(messages))


class BatchWriter(_Sink, DataSourceWriter):
    def commit(self, messages) -> None:
        self.name_epoch(f"once-{uuid.uuid4().hex}", _all(messages))

    def abort(self, messages) -> None:
        self.drop(_all(messages))


class LogSink(DataSource):
    """format("log_batches"); options: path, max_count, max_bytes, max_age (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "log_batches"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """ms, message, batch (its file) of what has been committed."""
    from pyspark.sql import functions as F

    sink = _Sink({"path": path})
    system, inner = sink._fs()
    files = []
    if system.get_file_info(f"{inner}/epochs").type == fs.FileType.Directory:
        for info in system.get_file_info(fs.FileSelector(f"{inner}/epochs")):
            if info.base_name.endswith(".json"):
                with system.open_input_stream(info.path) as f:
                    files += json.loads(f.read())
    if not files:
        return spark.createDataFrame([], f"{SCHEMA}, batch string")
    return spark.read.schema(SCHEMA).json([f"{path}/batches/{n}" for n in files]).withColumn("batch", F.substring_index(F.input_file_name(), "/", -1))


class ProgressLog(StreamingQueryListener):
    """Progress of streams (id, run, batch, rows, milliseconds) as records of a log; they are handed on when a batch is full, too old, or a query ends."""

    def __init__(self, path: str, **limits):
        self._sink, self._held, self._lock = _Sink({"path": path} | limits), [], threading.Lock()

    def onQueryStarted(self, event) -> None:
        self._say({"event": "started", "id": str(event.id), "run": str(event.runId)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._say({"event": "progress", "id": str(p.id), "run": str(p.runId), "batch": p.batchId, "rows": p.numInputRows, "ms": p.batchDuration})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._say({"event": "failed" if event.exception else "ended", "id": str(event.id), "run": str(event.runId)})
        self.flush()

    def _say(self, record: dict) -> None:
        now = int(time.time() * 1000)
        with self._lock:
            self._held.append((now, json.dumps(record)))
            full = len(list(batches(self._held, self._sink.limits))) > 1 or len(self._held) >= self._sink.limits.count or now - self._held[0][0] >= self._sink.limits.age_ms
        if full:
            self.flush()

    def flush(self) -> None:
        with self._lock:
            held, self._held = self._held, []
        files = [self._sink.put(b) for b in batches(held, self._sink.limits)]
        if files:
            self._sink.name_epoch(f"progress-{uuid.uuid4().hex}", files)
