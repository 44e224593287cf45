"""Mixing sources to target weights.

Method: the words of each source's documents, in a hashed order, are packed into blocks of a fixed length. The mix is a
number of output shards of SHARD_SLOTS slots; the source counts of each shard are a multinomial draw: every slot draws its
source by itself, by weight, from a hash of its number. Draws miss a source's target by about the root of its slots, so what all
shards together drew too many of a source is left out at its end, and what they drew too few of comes in additional shards. The
slots of a source, numbered over all shards, are mapped to its blocks by a pseudorandom permutation of block indexes, a new one for each
pass over the source, and joined to the blocks by index. The permutation is a keyed Feistel network over two digits of a block's
number, walked on until it comes to a block that exists. No document is used more often than the passes, two at most.

Order within a source needs no task that sees a whole source: documents are dealt into buckets by hash, each bucket is
summed up by itself, and the buckets' sums are added up in two levels, as are the shards' counts.

Edge cases: a null text, or one without words, has size 0 and is taken 0 times; a null source is a source of its own, the
last; sources without words have target 0. Ties and repeated rows are separate documents; a row that is there very often is dealt
out in steps. Very long texts span many blocks. Other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.session import shared_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, PASSES, BLOCK, SHARD_SLOTS, SEED = (3.0, 1.0, 2.0), 1.5, 2, 128, 4096, "mix-1"
BUCKET_ROWS = 20_000
#: Steps of a walk in a permutation: it ends within them if a source has up to WALK^2 blocks, else but for a chance under WALK^(1 - WALK).
WALK, ROUNDS = 64, 3
#: Slots that a task makes at least, and rows that a level of running sums takes at once.
TASK_SLOTS, STEP = 100_000, 4096


def unit(*cols: Column | str) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *cols), 11) + 0.5) / float(1 << 53)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, rank, weight, target of (source, source_size): one row for each source.

    Shares by weight, where what exceeds PASSES times a size is dealt anew by weight: a source is full if its limit is
    under what its weight gets of all that the fuller ones leave. Sources sorted by limit/weight fill up in that order.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    s = sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", w).withColumn("cap", PASSES * F.col("source_size").cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    s = s.withColumn("level", (SHARE * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    s = s.withColumn("open_level", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(every)["level"])
    return s.select("source", "source_size", "rank", "weight", F.when(F.col("full"), F.col("cap")).otherwise(F.col("open_level") * F.col("weight")).alias("target"))


def running(df: DataFrame, part: str, order: str, value: str, name: str) -> DataFrame:
    """Add the sum of value over the rows of a part with a smaller order (whole numbers, each once in a part), in two levels: no task sees a whole part."""
    d = df.withColumn("_g", F.floor(F.col(order) / STEP))
    upper = d.groupBy(part, "_g").agg(F.sum(value).alias("_s"))
    over = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.select(part, "_g", F.coalesce(F.sum("_s").over(over(part, "_g")), F.lit(0)).alias("_up"))
    d = d.withColumn("_in", F.coalesce(F.sum(value).over(over(part, "_g", order)), F.lit(0))).join(upper, [part, "_g"])
    return d.withColumn(name, (F.col("_up") + F.col("_in")).cast("long")).drop("_g", "_up", "_in")


def each_of(df: DataFrame, n: str, name: str) -> DataFrame:
    """Every row n times, numbered from 0, without an array of n numbers."""
    d = df.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(STEP).cast("long"))))
    return d.withColumn(name, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + STEP, F.col(n)) - 1))).drop("_from")


def slot_counts(sources: DataFrame) -> DataFrame:
    """rank, blocks, shard, first, n: the slots that each source gets in each output shard, numbered over the shards of a source.

    sources: rank, target, blocks, source_size. A source is due as many slots as bring its target at its mean words a block.
    """
    spark = sources.sparkSession
    due = F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")
    s = sources.where("target > 0 and blocks > 0").select("rank", "blocks", F.least(due, F.col("blocks") * PASSES).alias("due")).where("due > 0")
    total, number = s.agg(F.sum("due"), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], "rank int, blocks long, shard long, first long, n long")
    # a source owns a stretch of (0, 1); a draw finds it by the cell that it falls in
    cells, line = max(4096, 4 * number), Window.orderBy("rank")
    s = s.withColumn("hi", F.sum("due").over(line) / total).withColumn("lo", F.lag("hi", 1, 0.0).over(line)).withColumn("hi", F.when(F.lead("rank").over(line).isNull(), 2.0).otherwise(F.col("hi")))
    s = shared_table(s, "shares")
    guide = s.select("rank", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.lit(cells - 1).cast("long"), F.floor(F.col("hi") * cells)))).alias("cell"))
    guide = shared_table(guide, "guide")
    draws = spark.range(0, total, 1, total // TASK_SLOTS + 1).select(F.floor(F.col("id") / SHARD_SLOTS).alias("shard"), unit(F.lit("draw"), "id").alias("u"))
    draws = draws.withColumn("cell", F.floor(F.col("u") * cells)).join(guide, "cell").where("u >= lo and u < hi")
    counts = shared_table(draws.groupBy("rank", "shard").agg(F.count("*").alias("n")), "draws")

    placed = running(counts, "rank", "shard", "n", "first").join(s.select("rank", "blocks", "due"), "rank")
    drawn = placed.where("first < due").select("rank", "blocks", "shard", "first", F.least("n", F.col("due") - F.col("first")).alias("n"))
    got = counts.groupBy("rank").agg(F.sum("n").alias("got"))
    short = s.join(got, "rank", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < due")
    # shards of SHARD_SLOTS slots after the drawn ones
    short = each_of(short.withColumn("n", F.ceil((F.col("due") - F.col("got")) / SHARD_SLOTS)), "n", "k")
    short = short.select("rank", "blocks", ((total - 1) // SHARD_SLOTS + 1 + F.col("k")).alias("shard"), (F.col("got") + F.col("k") * SHARD_SLOTS).alias("first"), F.least(F.lit(SHARD_SLOTS), F.col("due") - F.col("got") - F.col("k") * SHARD_SLOTS).alias("n"))
    return drawn.unionByName(short)


def permuted(df: DataFrame, i: str, blocks: str, name: str) -> DataFrame:
    """Add a pseudorandom permutation of i in 0 .. blocks - 1, keyed by rank and pass.

    A number is two digits, l below a and r below b, where a * b is blocks or up to a - 1 more. A round adds a hash of r to l and of the
    new l to r. Numbers that are no block are permuted again.
    """
    n, a, b = F.col(blocks), F.col("_a"), F.col("_b")
    key = lambda k, c: F.xxhash64(F.lit(SEED), F.lit(k), "rank", "pass", c)
    left = lambda k, l, r: (l + F.pmod(key(2 * k, r), a)) % a
    right = lambda k, l, r: (r + F.pmod(key(2 * k + 1, l), b)) % b

    def again(x: Column) -> Column:
        l, r = F.floor(x / b), x % b
        for k in range(ROUNDS):
            l = left(k, l, r)
            r = right(k, l, r)
        return l * b + r

    d = df.withColumn("_a", F.floor(F.sqrt(n)).cast("long") + 1).withColumn("_b", F.floor((n + a - 1) / a)).withColumns({"_l": F.floor(F.col(i) / b), "_r": F.col(i) % b})
    for k in range(ROUNDS):
        d = d.withColumn("_l", left(k, F.col("_l"), F.col("_r"))).withColumn("_r", right(k, F.col("_l"), F.col("_r")))
    d = d.withColumn("_x", F.col("_l") * b + F.col("_r"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.col("_x"), lambda x, _: F.when(x < n, x).otherwise(again(x)))
    return d.withColumn(name, F.when(F.col("_x") < n, F.col("_x")).otherwise(walked)).drop("_a", "_b", "_l", "_r", "_x")


def slots(counts: DataFrame, tasks: int = 8) -> DataFrame:
    """shard, rank, slot, pass, block: one row for each slot of the mix, made in so many tasks."""
    s = counts.repartition(tasks, "rank", "shard").withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
    s = s.withColumn("pass", F.floor(F.col("slot") / F.col("blocks"))).withColumn("i", F.col("slot") % F.col("blocks"))
    return permuted(s, "i", "blocks", "block").select("shard", "rank", "slot", "pass", "block")


def packed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, mark, size of each row, and first: the place of its first word in its source's stream."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.lit(SEED), id_col, text_col).alias("mark"), size.alias("size"))
    return shared_table(rows, "sized")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their place, pieces that the mix takes of them, slots of the mix).

    Documents: doc_id, source, mark, size, source_size, target, rank, copy, first. Pieces: doc_id, mark, copy, rank, pass, at (word in the document), words.
    """
    rows = packed(docs, id_col, text_col, source_col)
    n = rows.count()
    buckets = max(1, -(-n // BUCKET_ROWS)) * 8
    same = ["source", "mark", "doc_id", "size"]
    counted = rows.groupBy(*same).agg(F.count("*").alias("copies")).withColumn("_b", F.pmod("mark", F.lit(buckets)))
    counted = shared_table(counted, "counted")
    sums = shared_table(counted.groupBy("source", "_b").agg(F.sum(F.col("size") * F.col("copies")).alias("_m")), "sums")
    sources = targets(sums.groupBy("source").agg(F.sum("_m").alias("source_size")))
    sources = shared_table(sources.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK)), "sources")
    starts = sums.withColumnRenamed("source", "s").join(sources, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    starts = shared_table(running(starts, "rank", "_b", "_m", "_start").withColumnRenamed("_b", "b"), "starts")
    within = Window.partitionBy("source", "_b").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_at", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(within), F.lit(0)))
    placed = each_of(placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("_b") == F.col("b"))), "copies", "copy")
    placed = placed.select("doc_id", "source", "mark", "size", "source_size", "target", "rank", "copy", (F.col("_start") + F.col("_at") + F.col("copy") * F.col("size")).alias("first"))
    placed = shared_table(placed, "placed")

    counts = shared_table(slot_counts(sources), "counts")
    number = counts.agg(F.sum("n")).first()[0] or 0
    taken = slots(counts, number // TASK_SLOTS + 8)
    of = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("size") - 1) / BLOCK))))
    lo, hi = F.greatest("first", F.col("block") * BLOCK), F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * BLOCK)
    of = of.select("doc_id", "mark", "copy", "rank", "block", (lo - F.col("first")).alias("at"), (hi - lo).alias("words"))
    pieces = of.join(taken.select("rank", "block", "pass", "shard", "slot").hint("merge"), ["rank", "block"])  # both sides grow with the table
    return placed, pieces, taken


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row."""
    placed, pieces, _ = mix(docs)
    # the same row of a table may occur more than once; the place of its first word tells copies apart
    keys = ["doc_id", "mark", "rank", "copy"]
    taken = pieces.groupBy(*keys).agg(F.sum("words").alias("taken"))
    p, t = placed.alias("p"), taken.alias("t")
    on = F.col("p.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("p.mark") == F.col("t.mark")) & (F.col("p.rank") == F.col("t.rank")) & (F.col("p.copy") == F.col("t.copy"))
    return p.join(t, on, "left").select("p.doc_id", "p.size", "p.source_size", "p.target", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each pass, each document that it takes words of, with these words.

    Columns doc_id, text, lang, source, n_chars. A document taken whole keeps its text; else the words taken are joined by spaces.
    """
    placed, pieces, _ = mix(docs)
    runs = pieces.groupBy("doc_id", "mark", "pass", "copy", "rank").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("runs"), F.sum("words").alias("taken"))
    runs = shared_table(runs.select("doc_id", "mark", "runs", "taken", "copy", "rank"), "runs").withColumnsRenamed({"doc_id": "d", "mark": "m"})
    source = placed.select("rank", F.col("source").alias("s")).distinct()
    runs = runs.join(source, "rank")
    rows = docs.select("doc_id", "text", "lang", "source").withColumn("mark", F.xxhash64(F.lit(SEED), "doc_id", "text"))
    one = rows.dropDuplicates(["mark", "doc_id", "source"]) if not placed.where("copy > 0").isEmpty() else rows
    out = one.join(runs, F.col("mark").eqNullSafe(F.col("m")) & F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    part = F.concat_ws(" ", F.flatten(F.transform("runs", lambda r: F.slice(words, (r["at"] + 1).cast("int"), r["words"].cast("int")))))
    text = F.when(F.col("taken") == F.regexp_count("text", F.lit(WORD)), F.col("text")).otherwise(part)
    return out.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long"))
