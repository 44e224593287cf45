"""Stores written in place, seen keys, sinks with a ledger, the text index."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from listwright.operators import filters as P
from listwright.operators.keyed_store import KeyedStore
from listwright.operators.seen import SeenSet
from listwright.operators.text_index import TextIndex
from listwright.session import shared_folder
from listwright.sources.manifest import Conflict
from listwright.streaming.ledger import Ledger


def folder(spark):
    return shared_folder(spark, "test")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def store(spark):
    return KeyedStore.create(spark.range(200).select("id", (F.col("id") % 7).alias("a"), F.lit("x").alias("b")), folder(spark), ["id"], 16)


def test_merge_by_brute_force(spark, store):
    rng = random.Random(3)
    want = {i: (i % 7, "x") for i in range(200)}
    for _ in range(3):
        new = [(rng.choice([None, *range(260)]), rng.randrange(9), rng.randrange(5), rng.random() < 0.2) for _ in range(80)]
        best = {}
        for k, a, seq, gone in new:
            if k is not None:
                best[k] = max(best.get(k, (-1,)), (seq, a, gone))
        result = {}
        for k, (_, a, gone) in best.items():
            result[k] = ("deleted" if k in want else "absent") if gone else "inserted" if k not in want else "unchanged" if want[k][0] == a else "updated"
            if gone:
                want.pop(k, None)
            else:
                want[k] = (a, want[k][1] if k in want else None)
        df = spark.createDataFrame(new, "id long, a long, seq int, gone boolean")
        assert rows_of(store.merge(df, order=["seq"], delete="gone")) == sorted(result.items())
        assert store.refused(df).count() == sum(k is None for k, *_ in new)
        assert rows_of(store.read()) == sorted((k, *v) for k, v in want.items())


def test_untouched_buckets_stay_and_a_broken_write_changes_nothing(spark, store, monkeypatch):
    before = store.manifest.current()[1]["parts"]
    new = spark.createDataFrame([(5, 70)], "id long, a long")
    touched = set(map(str, store.touched(new)))
    rows = rows_of(store.read())
    with monkeypatch.context() as m:
        m.setattr(store.manifest, "switch", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.merge(new)
    assert rows_of(store.read()) == rows and rows_of(KeyedStore(spark, store.path).read()) == rows
    store.merge(new)
    after = store.manifest.current()[1]["parts"]
    assert {b for b in before if before[b] != after[b]} == touched and len(touched) == 1
    assert rows_of(store.read(number=0)) == rows
    assert len(store.vacuum()) == 1  # what broke off; the first version still has the other buckets
    assert rows_of(store.read().where("id = 5")) == [(5, 70, "x")] and store.read().count() == 200


def test_conflicting_rows_do_not_depend_on_partitions(spark):
    new = spark.createDataFrame([(1, x % 5, x) for x in range(40)] + [(2, None, 3), (2, 4, None)], "id long, a long, s long")
    got = [rows_of(KeyedStore.create(new.repartition(n), folder(spark), ["id"], 4, ["a"]).read()) for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2] == [(1, 4, 39), (2, 4, None)]


def test_two_writers(spark, store):
    base, state = store.manifest.current()
    other = KeyedStore(spark, store.path)
    other.merge(spark.createDataFrame([(5, 1)], "id long, a long"))
    with pytest.raises(Conflict):
        store._switch(base, state, "none", store.touched(spark.createDataFrame([(5,)], "id long")))
    free = next(b for b in range(16) if b not in store.touched(spark.createDataFrame([(5,)], "id long")))
    store._switch(base, state, "none", [free])  # of another bucket
    assert rows_of(store.read().where("id = 5")) == [(5, 1, "x")]


def test_seen_keys(spark):
    seen = SeenSet.create(spark.range(0, 20000, 2).toDF("k"), folder(spark), 32, 2)
    new = spark.createDataFrame([(k,) for k in (1, 3, 5, 10, 10, None)], "k long")
    assert sorted(x.k or -1 for x in seen.unseen(new).collect()) == [-1, 1, 3, 5]
    assert seen.share_read(new) < 0.2  # the bucket of 10, and seldom one that a filter did not rule out
    all_ = spark.range(20000).toDF("k")
    wrong = seen.may_be_in(all_.where("k % 2 = 1")).where("maybe").count()
    assert wrong < 500 and seen.may_be_in(all_.where("k % 2 = 0")).where("not maybe").count() == 0
    files = {b: v for b, v in seen.keys.manifest.current()[1]["parts"].items()}
    seen.add(spark.createDataFrame([(k,) for k in (1, 1, 2, 7, None)], "k long"))
    assert rows_of(seen.unseen(spark.createDataFrame([(k,) for k in (1, 2, 3, 7)], "k long"))) == [(3,)] and seen.keys.read().count() == 10002
    assert all(now[: len(files[b])] == files[b] for b, now in seen.keys.manifest.current()[1]["parts"].items() if b in files)
    assert SeenSet(spark, seen.keys.path.removesuffix("/keys"), 2).unseen(all_).count() == 20000 - 10002


def test_empty_stores(spark):
    none = spark.createDataFrame([], "id long, a long")
    store = KeyedStore.create(none, folder(spark), ["id"], 4)
    assert store.read().count() == 0 and store.merge(none).count() == 0
    assert rows_of(store.merge(spark.createDataFrame([(1, 2)], "id long, a long"))) == [(1, "inserted")] and rows_of(store.read()) == [(1, 2)]
    seen = SeenSet.create(none.select("id"), folder(spark), 4, 1)
    assert seen.unseen(spark.range(3)).count() == 3 and seen.unseen(none.select("id")).count() == 0


def test_ledger_replays_and_broken_writes(spark, monkeypatch):
    ledger = Ledger(spark, folder(spark))
    a, b = spark.range(3), spark.range(10, 12)
    assert ledger.read("id long").count() == 0
    assert ledger.write(a, 0) and not ledger.write(a, 0)
    with monkeypatch.context() as m:
        m.setattr(ledger, "_commit", lambda *x: (_ for _ in ()).throw(RuntimeError("killed between write and commit")))
        with pytest.raises(RuntimeError):
            ledger.write(b, 1)
    assert rows_of(ledger.read("id long")) == [(0,), (1,), (2,)]
    assert ledger.write(b, 1) and rows_of(ledger.read("id long")) == [(0,), (1,), (2,), (10,), (11,)]
    assert len(ledger.vacuum()) == 1 and ledger.read("id long").count() == 5


def test_at_most_once(spark):
    ledger, calls = Ledger(spark, folder(spark)), []

    def fails_first(df, batch):
        calls.append(batch)
        if batch == 0:
            raise RuntimeError("half done")

    each = ledger.at_most_once(fails_first)
    with pytest.raises(RuntimeError):
        each(spark.range(1), 0)
    for batch in (0, 1, 1):
        each(spark.range(1), batch)
    assert calls == [0, 1]


def test_stream_with_a_failing_batch(spark):
    """A batch that fails after its write was staged is run again by the restarted stream, and is there once."""
    place = folder(spark)
    spark.range(100).repartition(4).write.parquet(f"{place}/in")
    ledger, broken = Ledger(spark, f"{place}/sink"), []

    def each(df, batch):
        if batch == 1 and not broken:
            broken.append(df.write.parquet(f"{place}/sink/data/batch=1-{uuid.uuid4().hex}"))
            raise RuntimeError("lost")
        ledger.write(df, batch)

    start = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{place}/in").writeStream.trigger(availableNow=True).option("checkpointLocation", f"{place}/checkpoint").foreachBatch(each).start()
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    start().awaitTermination()
    assert rows_of(ledger.read("id long")) == [(i,) for i in range(100)] and len(ledger.vacuum()) == 1


WORDS = ["bag", "red", "blue", "shoe", "new", "old"]


def test_index_finds_what_a_scan_finds(spark):
    rng = random.Random(1)
    rows = [(i * 9000, " ".join(rng.sample(WORDS, rng.randrange(5))) or None, rng.choice([None, "Red, Hat!"])) for i in range(60)] + [(7, None, None)]
    df = spark.createDataFrame(rows, "id long, title string, description string")
    index = TextIndex(spark, folder(spark))
    assert index.search("bag").count() == 0
    index.add(df.where("id < 200000"))
    index.add(df.where("id >= 200000"))
    queries = ["bag", "RED new", "red OR blue", "bag NOT red", "NOT (bag OR hat)", "(red OR blue) AND (bag) AND NOT old", "nothing", "NOT nothing"]
    want = {q: sorted(r.id for r in P.full_text(df, q).collect()) for q in queries}
    assert {q: sorted(r.id for r in index.search(q).collect()) for q in queries} == want
    index.merge()
    index.vacuum()
    assert {q: sorted(r.id for r in index.search(q).collect()) for q in queries} == want
    opened = {f.split("bucket=")[1].split("/")[0] for f in index.postings(["bag"]).inputFiles()}
    assert len(opened) == 1 < len({f.split("bucket=")[1].split("/")[0] for f in index.postings().inputFiles()})
    with pytest.raises(ValueError):
        index.search("(red")


def test_not_is_taken_from_rows_with_pictures(spark):
    df = spark.createDataFrame([(1, "red", True), (2, "blue", True), (3, "blue", None)], "id long, title string, pictures boolean")
    index = TextIndex(spark, folder(spark))
    index.add(df, ("title",), in_not=F.col("pictures"))
    assert rows_of(index.search("NOT red")) == [(2,)] and rows_of(index.search("blue")) == [(2,), (3,)]
