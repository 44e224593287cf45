"""Near-duplicates by bottom-k sketches.

Method: a document's set of word shingles is hashed with one function; its k least hashes are its sketch. Sketches are
the same for equal sets, which are collapsed into classes first. Inverted lists of retained values generate candidates:
two sets with a Jaccard similarity of 0.85 or more share at least MIN_SHARED of k = 32 retained values (chance of
fewer: under 1e-7), so with values ordered from rare to frequent they share one of their first k - MIN_SHARED + 1
values; only these are listed, and values of one class alone are dropped. Candidates are filtered by the sizes of the
sets and by the similarity estimated on the sketch of the union, and each is confirmed by the exact similarity of the
full sets, computed anew from the whole texts of the candidates.

Long lists (one passage in very many texts, one text in very many variants) are not expanded into all pairs: first each
list is compared to its hub (its least id), and components are formed; then only lists with several components are
compared, in windows of WINDOW rows by matrix products over sketches (filter) and full sets, and only the edges of a spanning forest leave a
window. Pairs within one component cannot change the result. No list is capped: longer ones are covered by windows of pairs of parts.

Sets are collapsed by their size and a 128-bit fingerprint. Full sets of a class are made once: what the hubs needed is used
again by the windows. Windows are bounded by rows and by the bytes of their sets.

Edge cases: a null or empty text, or one without words, has an empty set, is linked with nothing and is its own
component; a text with fewer words than a shingle is one shingle of all its words. Rows with the same doc_id are documents of
their own, linked by their texts alone. Rows with a null doc_id are linked like others; a component is named by its least doc_id that
is not null, and has a null name only if it has none: then the rows of its text with the least hash are kept. Other columns are
not read; an empty table gives an empty table. Very long texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.arrow import cache, give_back, map_columns, slices, small_batches
from listwright.llm.components import connected_components
from listwright.session import scratch, shared_table

K, MIN_SHARED = 32, 14
#: Rows of a list that are compared at once, and columns of the 0/1 matrices.
WINDOW, COLUMNS = 512, 2048
#: Bytes of the full sets of a window, about.
WINDOW_BYTES = 32 << 20
#: Of the candidates' ids so many hash buckets at most are broadcast to skip other rows before Python: 8 bytes each.
BUCKETS = 1 << 20
#: Words whose hashes a worker remembers, and the longest of them.
WORDS, WORD_BYTES = 50_000, 40


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = cache(__name__)
    if len(known) > WORDS:
        known.clear()
    found = list(map(known.get, words))
    if None in found:
        for k, h in enumerate(found):
            if h is None:
                found[k] = h = xxhash.xxh3_64_intdigest(words[k])
                if len(words[k]) <= WORD_BYTES and len(known) <= WORDS:
                    known[words[k]] = h
    return np.array(found, np.uint64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text's words; A-Z are lower-cased."""
    words = (text or "").encode().lower().split()  # on bytes both touch ASCII only
    if not words:
        return np.zeros(0, np.int64)
    h = word_hashes(words)
    n = min(size, len(words))
    x = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        x = (x ^ h[k : k + len(x)]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
    return np.unique(x.view(np.int64))


def fingerprint(s: np.ndarray) -> bytes | None:
    """128 bits of a set; None for an empty one."""
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, mark (hash of the text), n (size of the set), fp (fingerprint of the set; null for an empty one), sketch (K least values)."""

    def run(doc_id, mark, text):
        sets = [shingle_set(t, shingle) for t in text]
        return {"doc_id": doc_id, "mark": mark, "n": [len(s) for s in sets], "fp": list(map(fingerprint, sets)), "sketch": [s[:K] for s in sets]}

    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text"), "doc_id long, mark long, n long, fp binary, sketch array<long>", run)


def full_sets(docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """cid, hashes: full sets of classes (cid, id, fp), from the documents that name them. Rows are skipped by hash bucket first; their buckets are at most BUCKETS."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    buckets = classes.select(bucket("id").alias("bucket")).distinct()
    near = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("bucket", bucket("doc_id")).join(F.broadcast(buckets), "bucket", "left_semi")

    def run(doc_id, text):
        sets = [shingle_set(t, shingle) for t in text]
        return {"doc": doc_id, "print": list(map(fingerprint, sets)), "hashes": [s.tobytes() for s in sets]}

    sets = map_columns(near.select("doc_id", "text"), "doc long, print binary, hashes binary", run)
    sets = sets.join(classes, F.col("doc").eqNullSafe(F.col("id")) & (F.col("print") == F.col("fp")))
    return sets.groupBy("cid").agg(F.any_value("hashes").alias("hashes"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("cid").alias("b"), F.col("hashes").alias("hb")), "b").join(sets.select(F.col("cid").alias("a"), F.col("hashes").alias("ha")), "a")

    def run(a, b, ha, hb):
        keep = []
        for k, (x, y) in enumerate(zip(ha, hb, strict=True)):
            x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                keep.append(k)
        return {"a": [a[k] for k in keep], "b": [b[k] for k in keep]}

    return map_columns(both.select("a", "b", "ha", "hb"), "a long, b long", run)


def _alike(percent: int) -> F.Column:
    """Sizes allow the similarity, and its estimate on the union's sketch is not far below it (14 of 32 for 0.85)."""
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.size(F.array_intersect(union, F.array_intersect("sa", "sb"))) >= _low(percent) * F.size(union))


def _low(percent: int) -> float:
    """The least share of common values in a union's sketch."""
    return percent / 100 * MIN_SHARED / (0.85 * K)


def _listed(classes: DataFrame) -> DataFrame:
    """tok, cid, id, n, sketch: each class under the values that a similar one must share one of. Of lists with the same members one stays."""
    one = classes.select("cid", F.explode("sketch").alias("tok"))
    often = one.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    m = F.col("m")
    keep = (m - F.least(F.lit(MIN_SHARED), F.ceil(m * 0.7)) + 1).cast("int")
    # the values that no other class has come first in the order; they list nothing
    toks = one.join(often, "tok").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("toks"))
    toks = toks.join(classes.select("cid", F.size("sketch").alias("m")), "cid").withColumn("room", keep - (m - F.size("toks")))
    rows = shared_table(toks.where("room > 0").select(F.explode(F.slice("toks", 1, F.col("room"))["tok"]).alias("tok"), "cid"), "lists")
    member = F.xxhash64("cid").cast("decimal(38,0)")
    lists = rows.groupBy("tok").agg(F.sum(member).alias("members"), F.count("*").alias("size")).where("size > 1")
    lists = shared_table(lists.groupBy("members", "size").agg(F.min("tok").alias("tok")).select("tok"), "lists-kept")
    return rows.join(lists, "tok").join(classes.select("cid", "id", "n", "sketch"), "cid").select("tok", "cid", "id", "n", "sketch")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections of sets of values, from 0/1 matrices over the values that two sets have at least."""
    at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = times > 1
    number = np.cumsum(some) - 1
    keep = some[col]
    at, col = at[keep], number[col[keep]]
    order = np.argsort(col, kind="stable")
    at, col = at[order], col[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(some.sum()), COLUMNS):
        lo, hi = np.searchsorted(col, [start, start + COLUMNS])
        ones = np.zeros((len(sets), COLUMNS), np.float32)
        ones[at[lo:hi], col[lo:hi] - start] = 1
        out += ones @ ones.T
    return out


def _tile(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between different components in a window of a list, of which a spanning forest: rows (id, n, component, side, sketch, hashes)."""
    ids, n, c = [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    ok = (c[:, None] != c[None, :]) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))
    if rows[0][3] is not None:
        side = np.array([r[3] for r in rows])
        ok &= side[:, None] != side[None, :]
    ok = np.triu(ok, 1)
    if ok.any():  # of the union's sketch at least as many values as the longer sketch has are looked at
        m = np.minimum(n, K)
        ok &= shared_counts([np.array(r[4], np.int64) for r in rows]) >= _low(percent) * np.maximum(m[:, None], m[None, :])
    at = np.flatnonzero(ok.any(axis=0) | ok.any(axis=1))
    if not len(at):
        return []
    common = shared_counts([np.frombuffer(rows[k][5], np.int64) for k in at])
    total = n[at][:, None] + n[at][None, :] - common
    a, b = np.nonzero(ok[np.ix_(at, at)] & (100 * common >= percent * total))
    root: dict[int, int] = {}

    def find(i):
        while (j := root.get(i, i)) != i:
            root[i] = i = root.get(j, j)
        return i

    edges = []
    for i, j in zip(at[a].tolist(), at[b].tolist(), strict=True):
        if (x := find(int(c[i]))) != (y := find(int(c[j]))):
            root[y] = x
            edges.append((ids[i], ids[j]))
    return edges


def across_components(listed: DataFrame, parts: DataFrame, sets_of, percent: int) -> DataFrame:
    """Links (a, b) between members of a list that lie in different components; exact, on full sets, in windows of WINDOW rows and WINDOW_BYTES at most, about.

    sets_of: gives the full sets of classes (cid).
    """
    placed = listed.drop("id").join(parts.withColumnRenamed("id", "cid").withColumnRenamed("component", "c"), "cid", "left").withColumn("c", F.coalesce("c", "cid"))
    placed = shared_table(placed, "placed")
    mixed = placed.groupBy("tok").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size"), F.sum("n").alias("total")).where("lo < hi")
    # a list longer than a window is dealt over parts of half a window; each pair of parts is a window
    parts_ = F.greatest(F.ceil(F.col("size") * 2 / WINDOW), F.ceil(F.col("total") * 16 / WINDOW_BYTES)).cast("int")
    mixed = mixed.select("tok", F.when(parts_ <= 2, 1).otherwise(parts_).alias("parts"))
    placed = shared_table(placed.join(shared_table(mixed, "mixed"), "tok"), "mixed-lists")
    rows = placed.join(sets_of(placed.select("cid").distinct()), "cid")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})
    key = ["tok", "lo", "hi"]
    rows = rows.repartition(*key).sortWithinPartitions(*key).select(*key, "cid", "n", "c", "part", "sketch", "hashes")
    small_batches(rows)

    def windows(batches):
        held, last = [], None  # the rows of a window, which may go on in the next batch
        for b in slices(batches, WINDOW):
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for *k, i, n, c, part, sketch, hashes in zip(*cols, strict=True):
                if k != last:
                    yield from done(held)
                    held, last = [], k
                held.append((i, n, c, part if k[1] != k[2] else None, sketch, hashes))
        yield from done(held)
        held.clear()
        give_back()

    def done(held):
        if len(held) > 1 and (edges := _tile(held, percent)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], ["a", "b"])

    return rows.mapInArrow(windows, "a long, b long")


def grouped(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, mark, n, component (null for an empty set), name (least doc_id of the component) of each row."""
    rows = shared_table(sketches(docs, shingle), "sketches")
    classes = rows.where("fp is not null").groupBy("fp", "n").agg(F.min("doc_id").alias("id"), F.any_value("sketch").alias("sketch"))
    classes = shared_table(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    with scratch() as keep:
        listed = keep(shared_table(_listed(classes), "listed"))
    named = classes.select("cid", "id", "fp")

    left = lambda d: d.select("tok", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = lambda d: d.select("tok", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    hubs = shared_table(listed.groupBy("tok").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "cid", "n", "sketch")).alias("h")).select("tok", "h.*"), "hubs")
    pairs = shared_table(left(hubs).join(right(listed), "tok").where((F.col("a") != F.col("b")) & _alike(percent)).select("a", "b").distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    sets = shared_table(full_sets(docs, shared_table(named.join(ids, "cid"), "ids"), shingle), "sets")
    links = shared_table(confirmed(pairs, sets, percent), "links")
    parts = shared_table(connected_components(links), "parts")

    def sets_of(cids: DataFrame) -> DataFrame:
        new = shared_table(named.join(cids, "cid").join(sets.select("cid"), "cid", "left_anti"), "ids")
        return sets if new.isEmpty() else sets.unionByName(shared_table(full_sets(docs, new, shingle), "sets"))

    with scratch() as keep:
        more = keep(shared_table(across_components(listed, parts, sets_of, percent), "links"))
    if not more.isEmpty():
        parts = shared_table(connected_components(links.unionByName(more)), "parts")
    placed = classes.select("cid", "id", "fp", "n").join(parts.select(F.col("id").alias("cid"), "component"), "cid", "left").select("fp", "n", "id", F.coalesce("component", "cid").alias("component"))
    placed = shared_table(placed, "placed")
    # written, so that the join deals both sides out anew and adaptive execution may split a component with very many classes
    names = shared_table(placed.groupBy("component").agg(F.min("id").alias("name")), "names")
    placed = shared_table(placed.drop("id").join(names, "component"), "named")
    return rows.drop("sketch").join(placed, ["fp", "n"], "left").select("doc_id", "mark", "n", "component", "name")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row, by sets of `shingle` words and a similarity of `percent` or more."""
    with scratch() as keep:
        rows = keep(shared_table(grouped(docs, shingle, percent), "grouped"))
    nameless = shared_table(rows.where("component is not null and name is null").groupBy("component").agg(F.min("mark").alias("least")), "nameless")
    rows = rows.join(nameless, "component", "left")
    name = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("name"))
    kept = F.when(F.col("least").isNotNull(), F.col("mark") == F.col("least")).otherwise(F.col("doc_id").eqNullSafe(name))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"), kept.alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without near-duplicates: of each component one row stays, the one with the least doc_id (nulls last), then the least text hash, then the least other columns. Rows without words all stay.

    Columns must have an order. Rows to be dropped leave by an anti join on (doc_id, hash of the text).
    """
    with scratch() as keep:
        rows = keep(shared_table(grouped(docs, shingle, percent).where("component is not null"), "grouped"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("first")).select(F.col("component").alias("c"), "first.doc_id", F.col("first.mark").alias("mark_"), F.lit(True).alias("stays"))
    rows = rows.groupBy("component", F.col("doc_id").alias("id"), F.col("mark").alias("m")).agg(F.count("*").alias("copies"))
    # by the whole key, as one component may hold a third of all rows
    rows = rows.join(first, (F.col("component") == F.col("c")) & F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("mark_")), "left")
    rows = shared_table(rows.select("id", "m", "copies", F.coalesce("stays", F.lit(False)).alias("stays")), "decided")
    marked = docs.withColumn("_mark", F.xxhash64("text"))
    is_in = marked["doc_id"].cast("long").eqNullSafe(F.col("id")) & (marked["_mark"] == F.col("m"))
    out = marked.join(rows.where("not stays"), is_in, "left_anti")
    again = rows.where("stays and copies > 1")
    if not again.isEmpty():
        several = out.join(again, is_in, "left_semi").groupBy(F.col("doc_id").alias("_id"), "_mark").agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
        return out.join(again, is_in, "left_anti").select(*docs.columns).unionByName(several)
    return out.select(*docs.columns)


def oracle_sql(shingle: int = 3, percent: int = 85) -> str:
    """DuckDB SQL for the same rows: all pairs that share a shingle, and a recursive reachability."""
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, {words} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < {shingle} THEN array_to_string(ws, ' ') ELSE array_to_string(list_slice(ws, i, i + {shingle - 1}), ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {shingle - 2}, 2))) AS i FROM t WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= {percent} * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(t.doc_id, coalesce(m, t.doc_id)) AS component_id, t.doc_id = least(t.doc_id, coalesce(m, t.doc_id)) AS kept
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""
