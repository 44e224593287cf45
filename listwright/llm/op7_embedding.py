"""Near-duplicate vectors by sorted projection passes.

Method: each pass hashes a vector to the concatenated signs of CODE random projections. The vectors of a label are put in
lexicographic order of these hashes by a range partition and sort, numbered over all partitions, and cut into blocks of
WINDOW neighbours; each block is compared to itself and to the next one, across partition borders. Vectors whose hashes begin alike
(a run: the first `bits` bits) are all compared: the blocks of a run that are further apart meet in tiles of two blocks, so that no
long run is cut. Run length and number of passes follow from the number of vectors: a pair at the threshold is in no
common run of any pass with probability MISS at most; neighbours over run borders come on top.

Pairs are verified by the cosine in double precision; where rounding could decide, sums are made exactly. A pair counts in
the first pass that compares it, which its blocks and runs in the earlier passes tell, so that links are counted once without a shuffle of
pairs. For the union across passes a window hands on star edges of its components. Vectors are sent once for each pass, in their own
precision; the order itself is made of numbers alone.

Equal vectors (same label, same numbers) are one vector with a multiplicity until the end.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors with a null label,
link with nothing and are their own component. Vectors of different lengths are not compared. Rows with the same vec_id are vectors
of their own, linked by their numbers alone. A null vec_id names a component only if all its vectors have none: then the copies of
its vector with the least hash are kept. Other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from listwright.llm.arrow import give_back, slices, small_batches
from listwright.llm.components import connected_components
from listwright.session import scratch, shared_table

#: Vectors of a block, blocks that a task gets in a row, bits of a hash.
WINDOW, SPAN, CODE = 1024, 16, 60
MISS, SEED = 1e-6, 20240601
#: Cosines so near to the threshold are summed up exactly.
NEAR = 1e-9


def plan(rows: int, threshold: float) -> tuple[int, int]:
    """Bits of a run's prefix and number of passes for so many vectors of a label; runs have half a block's vectors or fewer, on average."""
    if rows <= WINDOW:
        return 0, 1
    same = 1 - math.acos(threshold) / math.pi
    bits = min(CODE, math.ceil(math.log2(2 * rows / WINDOW)))
    return bits, max(1, math.ceil(math.log(MISS) / math.log1p(-(same**bits))))


def codes(x: np.ndarray, passes: int) -> np.ndarray:
    """rows x passes hashes; projections are drawn anew from the seed for each pass."""
    out = np.empty((len(x), passes), np.int64)
    for p in range(passes):
        planes = np.random.default_rng((SEED, p, x.shape[1])).standard_normal((x.shape[1], CODE))
        out[:, p] = (x @ planes > 0) @ (np.int64(1) << np.arange(CODE, dtype=np.int64)[::-1])
    return out


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    """Of correctly rounded sums."""
    return math.fsum(x * y) / (math.sqrt(math.fsum(x * x)) * math.sqrt(math.fsum(y * y)))


class Block:
    """Vectors of a window: rows, multiplicities, raw and unit vectors, blocks and runs by pass."""

    def __init__(self, rows: list[tuple], kind: str):
        self.row = np.array([r[0] for r in rows], np.int64)
        self.mult = np.array([r[1] for r in rows], np.int64)
        self.raw = np.stack([np.frombuffer(r[2], kind) for r in rows]).astype(np.float64)
        self.unit = self.raw / np.linalg.norm(self.raw, axis=1, keepdims=True)
        self.blocks, self.runs = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])


def compare(x: Block, y: Block | None, p: int, threshold: float) -> list[tuple[int, int | None, int]]:
    """Links in pass p within x, or between x and y: (row, null, links) of each vector that has some, and (row, row, 0) for edges that join what they join."""
    sim = x.unit @ (y or x).unit.T
    near = sim >= threshold - NEAR
    if y is None:
        near = np.triu(near, 1)
    a, b = np.nonzero(near)
    y = y or x
    sure = sim[a, b] >= threshold + NEAR
    for k in np.flatnonzero(~sure):
        sure[k] = exact_cosine(x.raw[a[k]], y.raw[b[k]]) >= threshold
    a, b = a[sure], b[sure]
    for q in range(p):  # not compared by an earlier pass
        fresh = (x.runs[a, q] != y.runs[b, q]) & (np.abs(x.blocks[a, q] - y.blocks[b, q]) > 1)
        a, b = a[fresh], b[fresh]
    if not len(a):
        return []
    rows = x.row if x is y else np.concatenate([x.row, y.row])
    mult = x.mult if x is y else np.concatenate([x.mult, y.mult])
    b = b if x is y else b + len(x.row)
    links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
    np.add.at(links, a, mult[b])
    np.add.at(links, b, mult[a])
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(links)
    return [(int(rows[i]), None, int(links[i])) for i in at] + [(int(rows[i]), int(rows[root[i]]), 0) for i in at if root[i] != i]


FOUND = ["a", "b", "n"]


def _batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], FOUND)


def _groups(batches, keys: int, block_at: int):
    """(key, block, rows) of sorted batches, whose rows are the key's columns, the block, and the rest."""
    held, last = [], None
    for b in slices(batches):
        for r in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
            if (now := (r[:keys], r[block_at])) != last:
                if held:
                    yield *last, held
                held, last = [], now
            held.append(r[block_at + 1 :])
    if held:
        yield *last, held


def _named(vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows with the key of their vector, vectors by key: n, root, name, least)."""
    kind = "<f4" if vectors.schema["embedding"].dataType.jsonValue().get("elementType") == "float" else "<f8"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label"))
    fine = F.col("label").isNotNull() & F.col("x").isNotNull() & F.exists("x", lambda c: c != 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = v.withColumn("ok", F.coalesce(fine, F.lit(False)))
    v = v.withColumn("key", F.when(F.col("ok"), F.sha2(F.to_json(F.struct("label", "x")), 256)))
    one = v.where("ok").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("mult"), F.any_value("label").alias("label"), F.any_value("x").alias("x"))
    one = shared_table(one.withColumns({"dim": F.size("x"), "row": F.monotonically_increasing_id()}), "distinct")
    most = one.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits, passes = plan(most, threshold)
    label = one.schema["label"]

    def hashed(batches):
        for b in slices(batches):
            xs = [np.asarray(x, np.float64) for x in b.column("x").to_pylist()]
            dims = np.array(list(map(len, xs)))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                m = np.stack([xs[i] for i in at])
                m = np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])  # exact; else squares of very large or small numbers are lost
                c = codes(m / np.linalg.norm(m, axis=1, keepdims=True), passes)
                took = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(b.column(n).take(took) for n in ("row", "mult", "label", "dim")), pa.array([r.tobytes() for r in m.astype(kind)], pa.binary()), pa.array(list(c), pa.list_(pa.int64()))], ["row", "mult", "label", "dim", "packed", "codes"])
        give_back()

    small_batches(one)
    fields = [StructField("row", LongType()), StructField("mult", LongType()), label, StructField("dim", IntegerType()), StructField("packed", BinaryType()), StructField("codes", ArrayType(LongType()))]
    unit = shared_table(one.select("row", "mult", "label", "dim", "x").mapInArrow(hashed, StructType(fields)), "units")

    # the order of each pass, numbered over all partitions
    line = ["label", "dim", "pass", "code", "row"]
    order = unit.select("row", "label", "dim", F.posexplode("codes").alias("pass", "code")).repartitionByRange(*line).sortWithinPartitions(*line)
    order = order.withColumn("at", F.monotonically_increasing_id())  # partition and place in it
    order = shared_table(order.select("row", "label", "dim", "pass", F.shiftrightunsigned("code", CODE - bits).alias("run"), F.shiftrightunsigned("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at")), "order")
    parts = order.groupBy("label", "dim", "pass", "part").agg(F.min("at").alias("lo"), F.count("*").alias("count"))
    before = Window.partitionBy("label", "dim", "pass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0)) - F.col("lo")).drop("lo", "count")
    order = order.join(parts, ["label", "dim", "pass", "part"]).withColumn("block", F.floor((F.col("start") + F.col("at")) / WINDOW))
    order = shared_table(order.select("row", "label", "dim", "pass", "run", "block"), "blocks")
    seen = order.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pass", "block", "run"))).alias("s"))
    seen = unit.drop("codes").join(seen.select("row", F.col("s.block").alias("blocks"), F.col("s.run").alias("runs")), "row")
    seen = shared_table(seen, "seen")

    each = seen.select("label", "dim", F.posexplode("blocks").alias("pass", "block"), "row", "mult", "packed", "blocks", "runs")
    carried = ["row", "mult", "packed", "blocks", "runs"]

    # a block goes with its neighbours; the first block of a span also ends the span before
    span = F.floor(F.col("block") / SPAN)
    spans = each.withColumn("span", F.explode(F.when((F.col("block") % SPAN == 0) & (F.col("block") > 0), F.array(span - 1, span)).otherwise(F.array(span))))
    keys = ["label", "dim", "pass", "span"]
    spans = spans.repartition(*keys).sortWithinPartitions(*keys, "block").select(*keys, "block", *carried)

    def neighbours(batches):
        last, before = None, None
        for key, block, rows in _groups(batches, 4, 4):
            x = Block(rows, kind)
            out = compare(x, None, key[2], threshold) if block // SPAN == key[3] else []
            if last == (key, block - 1):
                out += compare(before, x, key[2], threshold)
            last, before = (key, block), x
            if out:
                yield _batch(out)
        give_back()

    # blocks of a run that are not neighbours, two at a time
    long = order.groupBy("label", "dim", "pass", "run").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("hi - lo >= 2")
    long = shared_table(long, "long-runs")
    tiles = each.withColumn("run", F.element_at("runs", F.col("pass") + 1)).join(long, ["label", "dim", "pass", "run"])
    tiles = tiles.withColumn("other", F.explode(F.filter(F.sequence("lo", "hi"), lambda k: F.abs(k - F.col("block")) >= 2)))
    tiles = tiles.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
    tile = ["label", "dim", "pass", "run", "left", "right"]
    tiles = tiles.repartition(*tile).sortWithinPartitions(*tile, "block").select(*tile, "block", *carried)

    def far(batches):
        last, before = None, None
        for key, _, rows in _groups(batches, 6, 6):
            x = Block(rows, kind)
            if last == key and (out := compare(before, x, key[2], threshold)):
                yield _batch(out)
            last, before = key, x
        give_back()

    found = spans.mapInArrow(neighbours, "a long, b long, n long")
    if not long.isEmpty():
        found = found.unionByName(tiles.mapInArrow(far, "a long, b long, n long"))
    found = shared_table(found, "found")
    joined = shared_table(connected_components(found.where("b is not null")), "parts").withColumnRenamed("id", "row")
    links = found.where("b is null").groupBy(F.col("a").alias("row")).agg(F.sum("n").alias("n"))
    named = one.select("key", "row", "id", "mult").join(links, "row", "left").join(joined, "row", "left").withColumn("root", F.coalesce("component", "row"))
    named = shared_table(named.select("key", "id", "root", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n")), "named")
    # written, so that the join deals both sides out anew and adaptive execution may split a root with very many vectors
    names = shared_table(named.groupBy("root").agg(F.min("id").alias("name"), F.min("key").alias("least")), "names")
    return v, shared_table(named.drop("id").join(names, "root"), "named")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of (vec_id, embedding, label)."""
    with scratch() as keep:
        v, named = _named(vectors, threshold)
        keep(named)
    out = v.select("vec_id", "key").join(named, "key", "left")
    name = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("name"))
    kept = F.when(F.col("root").isNotNull() & F.col("name").isNull(), F.col("key") == F.col("least")).otherwise(F.col("vec_id").eqNullSafe(name))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), name.alias("component_id"), kept.alias("kept"))


def oracle_sql(threshold: float = 0.98) -> str:
    """DuckDB SQL for the same rows: all pairs of a label."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= {threshold}),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(m, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(m, v.vec_id)) AS kept
FROM v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""
