"""Session set-up and the shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Session, folder and thread of each table that was written.
_tables: list[tuple[object, str, int]] = []
_own_dir: list[str] = []


def get_session(app: str = "listwright", master: str | None = None, **conf) -> SparkSession:
    """A UTC session with adaptive execution on. Values already set on the cluster stay."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a folder of our own only for local masters that name none."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(f"file://{tempfile.mkdtemp(prefix='listwright-')}")
    return _own_dir[0]


def shared_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet (with a writer's options) in the shared folder and read it back: cuts lineage, survives lost executors, has known size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _tables.append((spark, path, threading.get_ident()))
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes with the process (or with scratch())."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.append((spark, path, threading.get_ident()))
    return path


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session within it; after it they are as they were."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _name(path: str) -> str:
    """The table's own folder, which is unique; what stands before it may be written in several ways."""
    return path.rsplit("/", 1)[1]


def drop_shared(df: DataFrame) -> None:
    """Delete the files of a shared_table that no later plan reads."""
    for t in list(_tables):
        if any(_name(t[1]) in f for f in df.inputFiles()[:1]):
            _delete(*t[:2])
            _tables.remove(t)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within it, tables that this thread writes are scratch: at its end all go but those of frames that were given to the function it yields (which returns them)."""
    before, kept = set(map(id, _tables)), []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    yield keep
    files = [f for df in kept for f in df.inputFiles()]
    for t in list(_tables):
        if id(t) not in before and t[2] == threading.get_ident() and not any(_name(t[1]) in f for f in files):
            _delete(*t[:2])
            _tables.remove(t)


def _delete(spark, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop_tables() -> None:
    for spark, path, _ in _tables:
        with contextlib.suppress(Exception):
            _delete(spark, path)
