"""Ranked lexical search over an index of postings.

Method: terms and their places are gathered by blocks of documents, so that a posting is a term with all its documents of a block; postings are
dealt to buckets by their term (the blocks of a very frequent term to several tasks) and written, sorted by term. A search reads the buckets of its
terms, joins the items' terms, scores each match in integers, groups by item and document and keeps the top by window row_number. Matches are
summed up where all postings of a document lie, after one shuffle of the postings of the searched terms; of matches nothing is
shuffled but the best of each task. Terms that weigh nothing (nearly every document has them) change no score and are left out.

Edge cases: a document that is null, empty or without terms is not counted and never found; an item without terms finds nothing. Rows with
one doc_id are documents of their own; a null doc_id comes last among equal scores. Rows with one item_id are one item with all their terms; a
null item_id is an item. Texts are read whole; other columns are not read; without documents or items there are no rows.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listwright.llm.arrow import give_back, map_columns, slices, small_batches
from listwright.session import scratch, shared_table

#: Bytes of text of a block, about; a longer text is a block of its own. A block has less than 2^31 documents.
BLOCK_BYTES = 4 << 20
BUCKETS = 64
#: Blocks that a task takes of one bucket at most.
SPREAD = 512
#: Tables of the items' terms are broadcast up to so many rows (some 50 bytes each); larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: ASCII letters in lower case, digits and all bytes above ASCII stay; the rest are borders.
TERMS = bytes(b if b >= 128 or chr(b).isdecimal() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
POSTINGS = "term binary, block long, at array<int>, tf array<int>, doc_ids array<long>"
#: The term under which a block's documents are kept with their numbers of terms; no text has it.
ALL = b""


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERMS).split()


def index(docs: DataFrame) -> DataFrame:
    """A written index: for each term and block the places of its documents in the block, and how often they have it; under ALL the block's documents and numbers of terms."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(POSTINGS))

    def lists(offsets: np.ndarray, values: np.ndarray, kind) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, task, held, size = 0, TaskContext.get().partitionId(), [], 0

        def block() -> Iterator[pa.RecordBatch]:
            numbers = collections.defaultdict()
            numbers.default_factory = numbers.__len__
            each = [np.unique(np.array(list(map(numbers.__getitem__, terms_of(t))), np.int64), return_counts=True) for _, t in held]
            total = np.array([c.sum() for _, c in each])
            term, tf = (np.concatenate(x) for x in zip(*each, strict=True))
            at = np.repeat(np.arange(len(held)), [len(t) for t, _ in each])
            order = np.argsort(term, kind="stable")
            words, ends = list(numbers), np.cumsum(np.bincount(term, minlength=len(numbers)))
            key, starts = task << 33 | number, np.concatenate([[0], ends])
            none = pa.nulls(len(words), schema.field("doc_ids").type)
            yield pa.RecordBatch.from_arrays([pa.array([ALL], pa.binary()), pa.array([key]), lists([0, len(held)], np.arange(len(held)), pa.int32()), lists([0, len(held)], total, pa.int32()), pa.array([[d for d, _ in held]], schema.field("doc_ids").type)], schema=schema)
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(np.full(len(words), key)), lists(starts, at[order], pa.int32()), lists(starts, tf[order], pa.int32()), none], schema=schema)

        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and size + len(text or b"") > BLOCK_BYTES:
                    yield from block()
                    number, held, size = number + 1, [], 0
                held.append((doc_id, text))
                size += len(text or b"")
        if held:
            yield from block()
        held = []
        give_back()

    small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, POSTINGS)
    rows = rows.withColumn("bucket", _bucket("term"))
    dealt = rows.repartition("bucket", F.floor(F.col("block") % (1 << 33) / SPREAD), F.shiftright("block", 33) % SPREAD)
    return shared_table(dealt.sortWithinPartitions("bucket", "term"), "postings", compression="zstd")


def _bucket(term) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: each term once."""

    def run(item_id, text):
        found = [(i, t) for i, x in zip(item_id, text, strict=True) for t in set(terms_of(x))]
        return {"item_id": [i for i, _ in found], "term": [t for _, t in found]}

    return map_columns(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")), "item_id long, term binary", run).distinct()


def ranked(postings: DataFrame, items: DataFrame, top: int) -> DataFrame:
    """item_id, rank, doc_id, score of each item's highest-scoring documents in an index."""
    spark = postings.sparkSession
    terms = shared_table(_item_terms(items).withColumn("bucket", _bucket("term")), "item-terms")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    buckets = [r.bucket for r in terms.select("bucket").distinct().collect()]  # BUCKETS at most
    found = postings.where(F.col("bucket").isin(buckets)).join(small(shared_table(terms.select("bucket", "term").distinct(), "searched")), ["bucket", "term"], "left_semi")
    found = shared_table(found.select("term", "block", "at", "tf"), "found")
    of_all = postings.where((F.col("bucket") == spark.range(1).select(_bucket(F.lit(ALL))).first()[0]) & (F.col("term") == ALL))
    docs = of_all.select("block", F.explode(F.arrays_zip("at", F.col("tf").alias("n"), "doc_ids")).alias("d")).select("block", "d.at", "d.n", F.col("d.doc_ids").alias("doc_id")).where("n > 0")
    docs = shared_table(docs, "docs")
    number, length = docs.agg(F.count("*"), F.sum(F.col("n").cast("long"))).first()
    if not number:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    df = found.groupBy("term").agg(F.sum(F.size("at")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * number + 2) / (2 * F.col("df") + 1)))
    weights = shared_table(terms.join(df, "term").select("term", "item_id", weight.alias("w")).where("w > 0"), "weights")
    each = found.select("term", "block", F.explode(F.arrays_zip("at", "tf")).alias("p")).select("term", "block", "p.at", F.col("p.tf").cast("long").alias("tf"))
    # by the same key as the sums below, so that each document's postings meet once; a broadcast of few documents would leave them where their terms are
    each = each.join(docs.hint("merge"), ["block", "at"])
    score = F.expr(f"(1000000000 * tf) div (1000 * tf + 8 * (10 + (90 * cast(n AS bigint) * {number}) div {length}))")
    each = each.select("term", "block", "at", "doc_id", score.alias("s")).join(small(weights), "term")
    sums = each.groupBy("block", "at", "item_id").agg(F.sum(F.col("w") * F.col("s")).alias("score"), F.any_value("doc_id").alias("doc_id")).where("score > 0")
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """The index of docs, searched for each item."""
    with scratch() as keep:
        return keep(shared_table(ranked(index(docs), items, top), "ranked"))


def oracle_sql(top: int = 10) -> str:
    """DuckDB SQL for the same rows."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH t AS (SELECT doc_id, unnest({words}) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
g AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM d),
q AS (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(nn) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // l))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), g GROUP BY item_id, doc_id),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0)
SELECT item_id, k::INTEGER AS rank, doc_id, score FROM r WHERE k <= {top}"""
