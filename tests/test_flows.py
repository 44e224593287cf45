"""Python data sources and sinks, perceptual hashes, trained languages, ordered targets, statistics, prefix sums, curves, dispatch."""

import json
import random
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from listwright.functions import hashes as H
from listwright.functions import language as L
from listwright.operators import evaluation as E
from listwright.operators import filters as P
from listwright.operators import models as M
from listwright.operators import recipes, store
from listwright.operators.routing import result_routes
from listwright.operators.rows import sums_before
from listwright.plans.learned import fitted
from listwright.session import settings, shared_folder
from listwright.sources import chains
from listwright.streaming import logs
from listwright.streaming.ledger import Ledger

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def answers(spark, sizes: dict[str, int], path: str | None = None, first: int = 0) -> str:
    """Chains with so many pages of two items, of which pages from `first` on are saved."""
    path = path or shared_folder(spark, "test")
    rows = [(c, None if k == 0 else f"c/{k}?", json.dumps({"items": [{"n": 10 * k}, k], "end_cursor": f"c/{k + 1}?", "has_next": k < n - 1})) for c, n in sizes.items() for k in range(first, n)]
    chains.save_answers(spark.createDataFrame(rows, "chain string, cursor string, answer string").repartition(3), path)
    spark.dataSource.register(chains.CursorPages)
    return path


def test_chains_are_read_whole_and_in_parallel(spark):
    path = answers(spark, {"a": 5, "b": 1, "c": 3})
    df = spark.read.format("cursor_pages").load(path)
    assert rows_of(df.select("chain", "page", "place", "item")) == sorted((c, k, p, x) for c, n in (("a", 5), ("b", 1), ("c", 3)) for k in range(n) for p, x in enumerate((json.dumps({"n": 10 * k}), str(k))))
    assert df.rdd.getNumPartitions() == 3
    assert spark.read.format("cursor_pages").option("pages", 2).load(path).count() == 2 * (2 + 1 + 2)


def test_stream_of_chains_goes_on(spark):
    """Rounds of two pages; a batch that fails is read again; a chain and a page that come later are found."""
    path, place, failing = answers(spark, {"a": 5, "b": 1}), shared_folder(spark, "test"), [1]
    sink = Ledger(spark, f"{place}/sink")

    def each(df, batch):
        if batch in failing:
            failing.remove(batch)
            raise RuntimeError("lost")
        sink.write(df, batch)

    def go():
        s = spark.readStream.format("cursor_pages").option("progress", f"{place}/progress").option("pages", 2).load(path)
        s.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{place}/checkpoint").foreachBatch(each).start().awaitTermination()

    pages = lambda: rows_of(sink.read(chains.SCHEMA).select("chain", "page").distinct())
    go()
    assert pages() == [("a", 0), ("a", 1), ("b", 0)]
    with pytest.raises(Exception, match="lost"):
        go()
    for _ in range(3):
        go()
    assert pages() == [*(("a", k) for k in range(5)), ("b", 0)] and sink.read(chains.SCHEMA).count() == 12
    answers(spark, {"d": 1}, path)
    go()
    assert pages()[-1] == ("d", 0) and sink.read(chains.SCHEMA).count() == 14


def test_log_batches_by_count_bytes_and_age():
    lim = logs.Limits(3, 200, 1000)
    cut = lambda r: [[x["message"] for x in b] for b in logs.batches(r, lim)]
    assert cut([(0, str(k)) for k in range(7)]) == [["0", "1", "2"], ["3", "4", "5"], ["6"]]
    assert cut([(0, "x" * 100), (0, "y" * 40), (0, "z" * 100)]) == [["x" * 100, "y" * 40], ["z" * 100]]  # 26 bytes more each
    assert cut([(0, "a"), (999, "b"), (1000, "c"), (1500, None)]) == [["a", "b"], ["c", ""]]
    assert cut([]) == []
    long = "é" * logs.MAX_RECORD
    parts = list(logs.parts_of(long))
    assert "".join(parts) == long and max(len(p.encode()) for p in parts) <= logs.MAX_RECORD


def test_log_sink_commits_by_epoch(spark):
    path, place = shared_folder(spark, "test"), shared_folder(spark, "test")
    spark.dataSource.register(logs.LogSink)
    spark.range(10).select((F.col("id") * 10).alias("ms"), F.concat(F.lit("m"), "id").alias("message")).coalesce(1).write.parquet(f"{place}/in")
    assert logs.read_logs(spark, path).count() == 0
    listener = logs.ProgressLog(path)
    spark.streams.addListener(listener)
    for _ in range(2):
        s = spark.readStream.schema(logs.SCHEMA).parquet(f"{place}/in")
        s.writeStream.trigger(availableNow=True).format("log_batches").option("path", path).option("max_count", 4).option("checkpointLocation", f"{place}/checkpoint").start().awaitTermination()
    got = logs.read_logs(spark, path).where("message like 'm%'")
    assert rows_of(got.select("message")) == [(f"m{k}",) for k in range(10)]
    assert sorted(r["count"] for r in got.groupBy("batch").count().collect()) == [2, 4, 4]
    until = time.time() + 20
    said = []
    while len(said) < 4 and time.time() < until:
        time.sleep(0.2)
        said = [json.loads(r.message)["event"] for r in logs.read_logs(spark, path).where("message like '{%'").collect()]
    spark.streams.removeListener(listener)
    assert said.count("started") == said.count("ended") == 2 and "progress" in said
    sink = logs.StreamWriter({"path": path})
    files = [sink.put([{"ms": 1, "message": "again"}])]
    sink.commit([logs.Written(files), None], 0)  # an epoch that is there: its files go
    assert logs.read_logs(spark, path).where("message = 'again'").count() == 0
    files = [sink.put([{"ms": 1, "message": "gone"}])]
    sink.abort([logs.Written(files)], 7)
    assert logs.read_logs(spark, path).where("message = 'gone'").count() == 0


def by_hand(pixels, h, w):
    x = np.array(pixels, float).reshape(h, w)
    c = lambda n: np.cos(np.pi * np.arange(8)[:, None] * (2 * np.arange(n) + 1) / (2 * n))
    k = np.round(c(h) @ x @ c(w).T / (h * w), 6).ravel()
    return "".join("1" if v > np.median(k) else "0" for v in k)[::-1]


def bmp(path: str, grey: np.ndarray) -> None:
    """A picture of 24 bits whose colours are all the grey value."""
    h, w = grey.shape
    line = lambda r: np.repeat(r.astype(np.uint8), 3).tobytes() + b"\0" * (-3 * w % 4)
    data = b"".join(line(r) for r in grey[::-1])
    with open(path, "wb") as f:
        f.write(struct.pack("<2sIHHI", b"BM", 54 + len(data), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(data), 0, 0, 0, 0) + data)


def test_perceptual_hash(spark, tmp_path):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(k, rng.integers(0, 256, 16 * 12).astype(float).tolist()) for k in range(5)], "id int, p array<double>")
    bits = lambda d, h, w, c="p": {r.id: r.b for r in d.select("id", F.lpad(F.bin(H.perceptual_hash(F.col(c), h, w)), 64, "0").alias("b")).collect()}
    assert bits(df, 16, 12) == {r.id: by_hand(r.p, 16, 12) for r in df.collect()}
    y, x = np.mgrid[0:32, 0:32]
    grey = np.clip(128 + 90 * np.sin(x / 7.0 + y / 11.0) + 30 * np.cos(y / 3.0), 0, 255)
    for k, g in enumerate((grey[::2, ::2], np.repeat(np.repeat(grey[::2, ::2], 2, 0), 2, 1))):
        bmp(f"{tmp_path}/{k}.bmp", g)
    got = {}
    for k, n in ((0, 16), (1, 32)):
        p = H.grey_pixels(spark.read.format("image").load(f"{tmp_path}/{k}.bmp"))
        row = p.select("height", "width", "pixels").first()
        assert (row.height, row.width) == (n, n)
        got[k] = bits(p.withColumn("id", F.lit(k)), n, n, "pixels")[k]
    assert sum(a != b for a, b in zip(got[0], got[1], strict=True)) <= 2  # the same picture at twice the size
    near = spark.createDataFrame([(k, 0, int(b, 2) - (1 << 64 if b[0] == "1" else 0)) for k, b in got.items()], "id long, g int, h long")
    assert store.near_hashes(near, "g", "h", "id", 64).count() == (got[0] != got[1])


def test_languages_on_held_out_texts(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and text rlike '\\\\p{L}{3}'")
    out = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = L.weights(d.where(~out))
    got = L.foreign(d.where(out), model, "doc_id").withColumnRenamed("lang", "said")
    both = d.where(out).join(got, "doc_id", "left").select("lang", F.coalesce("said", F.lit("en")).alias("said")).collect()
    assert len(both) > 250 and sum(r.lang == r.said for r in both) >= 0.98 * len(both)
    none = L.foreign(spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, "漢字")], "doc_id long, text string"), model, "doc_id")
    assert none.count() == 0


def test_ordered_targets_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["hot"] * 5 + ["a", "b", None]), float(rng.random() < 0.4)) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, c string, y double")
    order = {r.id: r.d for r in df.select("id", M.drawn("id").alias("d")).collect()}
    mean, seen, want = sum(y for *_, y in rows) / len(rows), {}, {}
    for k, c, y in sorted(rows, key=lambda r: (order[r[0]], r[0])):
        s, n = seen.get(c, (0.0, 0))
        want[k] = (s + mean) / (n + 1)
        seen[c] = (s + y, n + 1)
    got = {r.id: r.m for r in M.ordered_targets(df, "c", "y", "id", "m").collect()}
    assert got == pytest.approx(want)
    flipped = df.withColumn("y", F.when(F.col("id") == 7, 1 - F.col("y")).otherwise(F.col("y")))  # a row's own label is not in its value, but for the mean of all
    other = {r.id: r.m for r in M.ordered_targets(flipped, "c", "y", "id", "m", prior=1e-9).collect()}
    first = {r.id: r.m for r in M.ordered_targets(df, "c", "y", "id", "m", prior=1e-9).collect()}
    assert other[7] == pytest.approx(first[7], abs=1e-3) and sum(abs(other[k] - first[k]) > 1e-6 for k in first) > 3


def test_wide_categories_help_a_model(spark):
    rng = random.Random(1)
    rows = [(k, f"c{k % 150}", float(k % 150 < 60) if rng.random() < 0.95 else 0.5, rng.random(), 1.0, k % 5 == 0) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, c string, y double, n double, weight double, valid boolean")
    model = M.train(df, ["n"], ["c"], "y", "weight", "valid")
    assert set(model.targets) == {"c"}
    got = M.predict(model, df).select("y", "prediction").collect()
    assert sum(abs(r.y - r.prediction) for r in got) / len(got) < 0.1
    new = M.predict(model, df.limit(3).withColumn("c", F.lit("never seen"))).count()
    assert new == 3


def test_random_search_and_statistics(spark):
    drawn = M.draws(M.RANGES, 40, 1)
    assert drawn == M.draws(M.RANGES, 40, 1) != M.draws(M.RANGES, 40, 2)
    assert all(lo <= d[k] <= hi for d in drawn for k, (lo, hi) in M.RANGES.items()) and len({d["maxDepth"] for d in drawn}) > 2
    df = spark.createDataFrame([(float(k % 20), float(k % 20 > 9), 0.5) for k in range(200)] + [(None, 1.0, 0.5)], "x double, y double, p double")
    best, tried = M.searched(df.na.drop(), ["x"], "y", {"maxDepth": (1, 3), "maxIter": (2, 4)}, 3)
    assert len(tried) == 3 and best is not None
    s = {r.bin: r for r in M.feature_statistics(df, ["x"], "y", "p", 4).collect()}
    assert {b: r.n for b, r in s.items()} == {-1: 1, 0: 50, 1: 50, 2: 50, 3: 50} and [s[b].mean_label for b in range(4)] == [0, 0, 1, 1] and s[3].least == 15.0


def test_recipe_with_trained_trees(spark):
    rng = random.Random(2)
    rows = [(k, f"o{k % 2}", f"s{k % 7}", "Counterfeit" if (bad := rng.random() < 0.3) else "Legitimate", bad, float(rng.randrange(100)), float(bad) + rng.random()) for k in range(600)]
    posts = spark.createDataFrame(rows, "id long, organisation string, domain string, label string, positive boolean, n double, hits double")
    out = recipes.run(posts, recipes.RECIPES["v6"], fitted(spark), lambda c: c == "Counterfeit")
    scored = [(r.label, r.score) for r in out["scored"].collect()]
    mean = lambda y: sum(s for l, s in scored if l == y) / sum(l == y for l, _ in scored)
    assert mean(1) > mean(0) + 0.3 and out["at_recall"].count() == out["scored"].select("organisation").distinct().count() + 1


def test_sums_before(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["x", "y", None]), k, rng.randrange(9)) for k in range(200)]
    want, total = [], {}
    for g, k, v in sorted(rows, key=lambda r: -r[1]):
        want.append((k, total.get(g, 0)))
        total[g] = total.get(g, 0) + v
    df = spark.createDataFrame(rows, "g string, k long, v long")
    assert rows_of(sums_before(df, ["g"], [F.desc("k")], {"s": "v"}).select("k", "s")) == sorted(want)
    assert sums_before(df.where("false"), [], [F.col("k")], {"s": "v"}).count() == 0


def test_curves_have_no_window_over_a_group(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", None]), rng.random(), int(rng.random() < 0.3)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    got = {(r.g, r.threshold): (r.precision, r.recall, r.rejected) for r in E.curve(df, ["g"]).collect()}
    for g in ("a", None):
        own = [(s, y) for x, s, y in rows if x == g]
        for s, _ in own:
            over = [y for t, y in own if t >= s]
            assert got[g, s] == pytest.approx((sum(over) / len(over), sum(over) / sum(y for _, y in own), 1 - len(over) / len(own)))
    ap = {r.g: r.ap for r in E.average_precision(df, "g").collect()}
    for g in ("a", None):
        own = sorted(((s, y) for x, s, y in rows if x == g), reverse=True)
        hits = [sum(y for _, y in own[: k + 1]) / (k + 1) for k in range(len(own)) if own[k][1]]
        assert ap[g] == pytest.approx(sum(hits) / len(hits))
    plan = E.curve(df, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert all("_p" in line for line in plan.splitlines() if "Window " in line)


def test_dispatch_of_many_keywords(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    posts = [(k, word(30) if k % 5 else None, word(60) if k % 7 else None) for k in range(60)]
    keys = [(word(rng.choice([1, 2, 3, 4, 5, 8])), f"o{k % 9}", k) for k in range(300)] + [("", "all", 999)]
    last = {w.lower(): o for w, o, _ in keys}
    df, kw = spark.createDataFrame(posts, "id long, title string, description string"), spark.createDataFrame(keys, "keyword string, organisation string, pos int")
    want = {i: sorted({o for w, o in last.items() if w in (t or "") or w in (d or "")}) for i, t, d in posts}
    assert {r.id: r.organisations for r in P.dispatch(df, kw).collect()} == {i: o for i, o in want.items() if o}
    assert P.dispatch(df, kw.where("keyword = 'no such'")).count() == 0


def test_conflicting_bulk_rows(spark):
    s = spark.createDataFrame([(1, "x")], "k int, v string")
    n = spark.createDataFrame([(1, "b"), (1, "c"), (2, "a"), (None, "z")], "k int, v string")
    got = {tuple(sorted(rows_of(store.bulk_write(s, n.repartition(p), ["k"], ["v"], F.col("k").isNotNull())[0]))) for p in (1, 4)}
    assert got == {(("inserted", 2, "a"), ("updated", 1, "c"))}


def test_routes(spark):
    rows = spark.createDataFrame([(1, None, "u", "d"), (2, True, "u/bad/x", "d"), (3, True, "u", "d"), (4, True, None, "e"), (5, False, "u", None)], "id int, pics boolean, url string, domain string")
    got = result_routes(rows, F.col("pics"), F.col("url"), ["/bad/"], spark.createDataFrame([("d",), ("d",)], "domain string"), "domain")
    assert rows_of(got.select("id", "route")) == [(1, "no_pictures"), (2, "blacklisted"), (3, "recrawl"), (4, "insertion"), (5, "no_pictures")]


def test_settings_come_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with settings(spark, {key: "other"}):
        assert spark.conf.get(key) == "other"
    assert spark.conf.get(key, None) == before
