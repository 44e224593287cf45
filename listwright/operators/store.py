"""Store operators: deduplication, inserts, upserts, merges and latest rows as plans over tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.session import shared_table


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order. A partial aggregate keeps one row for each key and task, so hot keys are no burden."""
    cols = df.columns
    picked = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(o).alias(f"_o{i}") if isinstance(o, str) else o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*[F.col(c) for c in cols]).alias("_row"))).alias("_x"))
    return picked.select(*[F.col(f"_x._row.{c}").alias(c) for c in cols])


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row with the largest `by` of each key, without a self-join."""
    cols = [c for c in df.columns if c not in keys]
    x = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(by)).alias("_x"))
    return x.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in cols])


def insert_if_absent(store: DataFrame, new: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """New rows whose key the store lacks, one for each key."""
    return keep_first(new.join(store.select(*keys).distinct(), keys, "left_anti"), keys, *order)


def upsert(store: DataFrame, new: DataFrame, keys: list[str], columns: list[str], keep: str = "last") -> DataFrame:
    """The store after an upsert: known keys take the new columns (keep="last") or stay (keep="first"), unknown keys are added."""
    s, n = store.alias("s"), new.alias("n")
    on = [F.col(f"s.{k}") == F.col(f"n.{k}") for k in keys]
    first, second = ("n", "s") if keep == "last" else ("s", "n")
    both = F.col(f"s.{keys[0]}").isNotNull() & F.col(f"n.{keys[0]}").isNotNull()
    pick = lambda c: F.when(both, F.col(f"{first}.{c}")).otherwise(F.coalesce(F.col(f"{first}.{c}"), F.col(f"{second}.{c}"))).alias(c)
    return s.join(n, on, "full").select(*[F.coalesce(F.col(f"s.{k}"), F.col(f"n.{k}")).alias(k) for k in keys], *map(pick, columns))


def changed(store: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """New rows that differ from the store's row of their key, or have none; nulls are equal to nulls."""
    s, n = store.alias("s"), new.alias("n")
    differs = F.col(f"s.{keys[0]}").isNull()
    for c in columns:
        differs = differs | ~F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}"))
    return n.join(s, [F.col(f"s.{k}") == F.col(f"n.{k}") for k in keys], "left").where(differs).select("n.*")


def bulk_write(store: DataFrame, new: DataFrame, keys: list[str], columns: list[str], fine: Column) -> tuple[DataFrame, DataFrame]:
    """(the store after the write with `result`: kept, updated or inserted; rows that are not fine, put aside).

    One row of each key is written: of several the greatest by its columns. A bad row does not hold up the others.
    """
    good = new.where(F.coalesce(fine, F.lit(False))).groupBy(*keys).agg(F.max(F.struct(*columns)).alias("_x")).select(*keys, "_x.*")
    s, n = store.select(*keys, *columns).withColumn("_s", F.lit(True)), good.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns)).withColumn("_n", F.lit(True))
    both = s.join(n, keys, "full")
    result = F.when(F.col("_n").isNull(), "kept").when(F.col("_s").isNull(), "inserted").otherwise("updated")
    written = both.select(result.alias("result"), *keys, *(F.when(F.col("_n"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns))
    return written, new.where(~F.coalesce(fine, F.lit(False)))


STATUSES = ["SEARCHED", "FILTERED_IN", "FILTERED_OUT", "SCRAPED", "SENT"]


def next_status(current: Column, wanted: Column) -> Column:
    """The status machine: a filter status is taken only from SEARCHED; SCRAPED never replaces SENT."""
    filtering = wanted.isin("FILTERED_IN", "FILTERED_OUT")
    return F.when(current.isNull(), wanted).when(filtering & (current != "SEARCHED"), current).when((wanted == "SCRAPED") & (current == "SENT"), current).otherwise(wanted)


def processed(status: Column) -> Column:
    return status.isin("FILTERED_OUT", "SENT")


def month_count(df: DataFrame, at: Column, now: Column, half_open: bool = False) -> DataFrame:
    """Rows within the month of `now`; by default the first instant and the last second of the month are left out."""
    first = F.date_trunc("month", now)
    end = F.add_months(first, 1).cast("timestamp") - F.expr("INTERVAL 1 SECOND")
    inside = (F.date_trunc("month", at) == first) if half_open else (at > first) & (at < end)
    return df.where(inside).agg(F.count("*").alias("sent"))


def running_quota(df: DataFrame, org: str, limit: Column, *order: str) -> DataFrame:
    """Rows whose running number within the organisation is at most its limit; a null limit is none. No task sees a whole organisation."""
    from listwright.operators.rows import numbered_within

    n = numbered_within(df, [org], [F.col(o) for o in order], "_n")
    return n.where(limit.isNull() | (F.col("_n") <= limit)).drop("_n")


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, found: values that are not null, longer than a character and no empty list; one aggregate over all columns."""
    kinds = dict(df.dtypes)

    def good(c):
        x = F.col(c)
        return x.isNotNull() & (F.size(x) > 0 if kinds[c].startswith("array") else F.length(x.cast("string")) > 1)

    row = df.agg(*[F.count_if(good(c)).alias(c) for c in columns])
    return row.unpivot([], columns, "field", "found")


def fill_fields(rows: DataFrame, found: DataFrame, key: str, columns: dict[str, str], moved_to: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that are split off because they belong to another address): what is null is filled from found.

    columns: of rows, by the column of found that fills each. moved_to: the address of found, null where the row stays.
    """
    both = rows.join(found, key, "left").withColumn("_to", moved_to)
    both = both.withColumns({c: F.coalesce(c, f) for c, f in columns.items()})
    return both.where("_to is null").select(*rows.columns), both.where("_to is not null").select(*rows.columns, F.col("_to").alias("address"))


def reattach(images: DataFrame, posts: DataFrame, image: str, post: str, link: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(image and the post it goes to, links of posts that are created, posts that are left without images).

    An image goes to the post with its link, or to a new one named "new:" and the link. A link has one post, or the least of several.
    """
    known = posts.groupBy(*link).agg(F.min(post).alias("_post"))
    both = images.join(known, link, "left")
    name = F.concat(F.lit("new:"), F.concat_ws(":", *link))
    moved = both.select(image, F.coalesce(F.col("_post").cast("string"), name).alias("post"))
    created = both.where("_post is null").select(*link).distinct()
    return moved, created, posts.select(post).join(both.select(F.col("_post").alias(post)), post, "left_anti")


def localized_keywords(organisations: DataFrame, countries: DataFrame) -> DataFrame:
    """country, organisation, keyword: each keyword once that an organisation has (keywords: a map of lists by locale) for one of a country's locales (an array)."""
    k = organisations.select("organisation", F.explode("keywords").alias("locale", "words")).select("organisation", "locale", F.explode("words").alias("keyword"))
    return k.join(countries.select("country", F.explode("locales").alias("locale")), "locale").select("country", "organisation", "keyword").distinct()


def unseen(new: DataFrame, store: DataFrame, by: str, key: str, at: str, last: int = 10_000) -> DataFrame:
    """New rows whose key is not among the last so many keys that their group has in the store. A group's rows are numbered without a task that sees all."""
    from listwright.operators.rows import numbered_within

    seen = numbered_within(store.select(by, key, at), [by], [F.desc(at), F.desc(key)], "_n").where(F.col("_n") <= last).select(by, key)
    return new.join(seen, [by, key], "left_anti")


def until_no_progress(keys: DataFrame, key: str, look_up: Callable[[DataFrame, int], DataFrame], rounds: int = 10) -> DataFrame:
    """key, value of what repeated lookups find: each round asks for the keys that are still missing, until none is or a round finds nothing new.

    look_up(missing, round) gives key, value for some of them; the first answer for a key stays. Rounds are written, so a round asks only once.
    """
    missing, found = shared_table(keys.select(key).distinct(), "missing"), None
    for k in range(rounds):
        new = shared_table(look_up(missing, k).join(missing, key, "left_semi").groupBy(key).agg(F.min("value").alias("value")), "found")
        if new.isEmpty():
            break
        found = new if found is None else found.unionByName(new)
        missing = shared_table(missing.join(new.select(key), key, "left_anti"), "missing")
        if missing.isEmpty():
            break
    return keys.select(key).distinct().limit(0).withColumn("value", F.lit(None).cast("string")) if found is None else found


def translated(rows: DataFrame, lookup: DataFrame, columns: list[str], language: Column, own: str = "en") -> DataFrame:
    """rows with translated_<column> for each column: the text itself in the own language, what the lookup (text, translation) has for others, and else an empty text."""
    out = rows.withColumn("_own", F.coalesce(language == own, F.lit(False)))
    for c in columns:
        table = lookup.groupBy(F.col("text").alias(f"_{c}")).agg(F.min("translation").alias(f"_to_{c}"))
        out = out.join(table, F.col(c) == F.col(f"_{c}"), "left").withColumn(f"translated_{c}", F.when(F.col("_own"), F.col(c)).otherwise(F.coalesce(f"_to_{c}", F.lit("")))).drop(f"_{c}", f"_to_{c}")
    return out.drop("_own")


def resumable(rows: DataFrame, key: str, step: Callable[[DataFrame], DataFrame], path: str, parts: int = 16, at_most: int | None = None) -> DataFrame | None:
    """step over rows, part by part (by the key's hash), each result kept under path: a run that broke off goes on with the parts that are not there.

    at_most bounds the parts of one run; None is returned while parts are missing, else the whole result.
    """
    spark = rows.sparkSession
    place = lambda k: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={k}/_SUCCESS")
    done = lambda k: place(k).getFileSystem(spark._jsc.hadoopConfiguration()).exists(place(k))
    todo = [k for k in range(parts) if not done(k)]
    for k in todo if at_most is None else todo[:at_most]:
        step(rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k)).write.mode("overwrite").parquet(f"{path}/part={k}")
    return spark.read.parquet(path).drop("part") if all(map(done, range(parts))) else None


def key_values(log: DataFrame, pattern: str | None = None) -> DataFrame:
    """key, field, value that a log of verbs leaves in a key-value store: set and del of keys, hset and hdel of a key's fields (field is null for set).

    log: seq (each once), verb, key, field, value. pattern: only keys that match (scan); a missing key has no row (get).
    """
    own = log if pattern is None else log.where(F.col("key").rlike(pattern))
    gone = own.where("verb = 'del'").groupBy(F.col("key").alias("_key")).agg(F.max("seq").alias("_gone"))
    last = own.where("verb in ('set', 'hset', 'hdel')").groupBy("key", "field").agg(F.max(F.struct("seq", "verb", "value")).alias("x"))
    left = last.join(gone, F.col("key") == F.col("_key"), "left").where("x.verb <> 'hdel' and (_gone is null or x.seq > _gone)")
    return left.select("key", "field", "x.value")


def near_hashes(rows: DataFrame, group: str, hash_: str, key: str, bits: int = 32, distance: int = 2) -> DataFrame:
    """a, b, n_a, n_b: pairs of different hashes of a group at most so many bits apart, each named by its least key and with its number of rows.

    Equal hashes are one class, whose rows need no pairs. Of distance + 2 bands of bits two at least are equal, so classes meet on pairs of
    bands: with four bands on half of all bits.
    """
    bands = distance + 2
    width = -(-bits // bands)
    c = shared_table(rows.groupBy(F.col(group).alias("g"), F.col(hash_).alias("h")).agg(F.min(key).alias("id"), F.count("*").alias("n")).where("g is not null"), "hashes")
    part = lambda k: F.shiftrightunsigned("h", k * width).bitwiseAND((1 << width) - 1)
    both = [F.struct(F.lit(i * bands + j).alias("which"), part(i).alias("x"), part(j).alias("y")) for i in range(bands) for j in range(i + 1, bands)]
    e = c.select("*", F.explode(F.array(*both)).alias("m")).select("g", "h", "id", "n", "m.*")
    a, b = e.alias("a"), e.alias("b")
    on = F.lit(True)
    for k in ("g", "which", "x", "y"):
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    near = a.join(b, on & (F.col("a.id") < F.col("b.id")) & (F.bit_count(F.col("a.h").bitwiseXOR(F.col("b.h"))) <= distance))
    return near.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b")).distinct()
