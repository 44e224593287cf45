"""Arrow-batched Python stages: one pass over a few columns, batches bounded by rows and bytes, caches of one operator at a time."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes of an Arrow batch that a function gets at once; a single longer row is a batch of its own.
BATCH, BATCH_BYTES = 2000, 8 << 20
#: What the JVM sends at once is bounded too, unless the session says otherwise.
SENT = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", str(BATCH)), "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(2 * BATCH_BYTES))}

_caches: dict[str, dict] = {}


def cache(owner: str) -> dict:
    """A worker's own store for one module. Workers are used again by later jobs, so the stores of other modules are emptied first."""
    if owner not in _caches:
        for x in _caches.values():
            x.clear()
        _caches.clear()
        _caches[owner] = {}
        give_back()
    return _caches[owner]


def give_back() -> None:
    """Return freed memory to the system; a worker that waits for its next task should not hold it."""
    gc.collect()
    with contextlib.suppress(Exception):
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(df: DataFrame) -> None:
    """Bound what the JVM sends to Python at once, where the session has Spark's defaults. Functions bound their own batches by slices() anyway."""
    conf = df.sparkSession.conf
    for key, (default, ours) in SENT.items():
        now = conf.get(key, None)
        if now == default or (default is None and (now is None or int(now) <= 0 or int(now) > 2 * BATCH_BYTES)):
            conf.set(key, ours)


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most so many rows and, unless it is one row, bytes."""
    for b in batches:
        todo = [b]
        while todo:
            x = todo.pop()
            if x.num_rows > 1 and (x.num_rows > rows or x.nbytes > size):
                half = min(rows, x.num_rows // 2)
                todo += [x.slice(half), x.slice(0, half)]
            elif x.num_rows:
                yield x


def map_columns(df: DataFrame, schema: str, fn: Callable[..., dict], **kw) -> DataFrame:
    """mapInArrow where fn gets the columns as Python lists by name and returns the output columns as lists or arrays.

    An empty partition yields nothing; fn never sees more than BATCH rows, nor more than BATCH_BYTES of them but for a longer single row.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df)
    out = to_arrow_schema(StructType.fromDDL(schema))

    owner = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache(owner)
        for b in slices(batches):
            cols = fn(**{n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}, **kw)
            yield pa.RecordBatch.from_arrays([_array(cols[f.name], f.type) for f in out], schema=out)
        give_back()

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, inputs: list[str], schema: str, fn: Callable[..., dict]) -> DataFrame:
    """df with the columns that fn makes of the inputs, in one pass; other columns go through as they are."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df)
    new = StructType.fromDDL(schema)
    whole = StructType([*df.schema.fields, *new.fields])
    out, kept = to_arrow_schema(new), len(df.columns)

    owner = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache(owner)
        for b in slices(batches):
            cols = fn(**{n: b.column(n).to_pylist() for n in inputs})
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(kept)), *(_array(cols[f.name], f.type) for f in out)], [*b.schema.names, *out.names])
        give_back()

    return df.mapInArrow(run, whole)


def _array(x, kind) -> pa.Array:
    return x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, type=kind)
