"""Files as sources and sinks: named snapshots, increments, delimited text, configurations with inheritance."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _place(date: str, tags: dict[str, str]) -> str:
    return "/".join([f"date={date}", *(f"{k}={v}" for k, v in sorted(tags.items()))])


def write_snapshot(df: DataFrame, path: str, date: str, tags: dict[str, str]) -> None:
    """One snapshot; its date and tags are folders, so that reads by them are pruned."""
    df.write.mode("overwrite").parquet(f"{path}/{_place(date, tags)}")


def read_snapshot(spark: SparkSession, path: str, date: str, tags: dict[str, str]) -> DataFrame:
    return spark.read.parquet(f"{path}/{_place(date, tags)}")


def latest_snapshot(spark: SparkSession, path: str, **tags: str) -> DataFrame:
    """The snapshot with the latest date among those with the tags. Dates come from folder names; only one folder is read."""
    df = spark.read.option("basePath", path).parquet(path)
    for k, v in tags.items():
        df = df.where(F.col(k) == v)
    date = df.select("date").distinct().agg(F.max("date")).first()[0]
    return df.where(F.col("date") == F.lit(date))


def append_since(store: DataFrame, source: DataFrame, at: Column, mark) -> DataFrame:
    """The store and the source's rows after the high-water mark."""
    return store.unionByName(source.where(at > F.lit(mark)))


def write_delimited(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True)


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """A delimited file without columns that a spreadsheet left unnamed."""
    df = spark.read.csv(path, sep=sep, header=True, schema=schema)
    return df.select(*[f"`{c}`" for c in df.columns if not c.startswith("Unnamed")])


def json_pages(spark: SparkSession, path: str, schema: str, items: str) -> DataFrame:
    """Items of saved API responses: each file is a page with an array of items."""
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode(items).alias("item")).select("item.*")


def merge(base: dict, child: dict) -> dict:
    """The child's values over the base's, dictionaries level by level; lists are replaced."""
    out = dict(base)
    for k, v in child.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(name: str, read: Callable[[str], dict], seen: tuple[str, ...] = ()) -> dict:
    """A configuration merged over those that it includes."""
    if name in seen:
        raise ValueError(f"{name} includes itself")
    own = dict(read(name))
    include = own.pop("include", None) or []
    out: dict = {}
    for parent in [include] if isinstance(include, str) else include:
        out = merge(out, load_config(parent, read, (*seen, name)))
    return merge(out, own)


def with_defaults(config: dict, template: str) -> dict:
    """A search template where none is given, from the post template."""
    return merge({"search": {"template": template}}, config)


def flat(config: dict, prefix: str = "") -> list[tuple[str, str]]:
    """(dotted key, value) of each leaf."""
    out = []
    for k, v in config.items():
        if isinstance(v, dict):
            out += flat(v, f"{prefix}{k}.")
        else:
            out.append((prefix + k, v if isinstance(v, str) else json.dumps(v)))
    return out


def read_table(spark: SparkSession, name: str, place: str, partition: tuple[str, int, int, int] | None = None, columns: dict[str, str] | None = None, **options) -> DataFrame:
    """A stored table: of a database (place: a JDBC address), in parallel by ranges if partition (column, lower, upper, number) is given, or of a folder of Parquet tables.

    columns: names to give, by the table's own; others are left out, and neither are they read.
    """
    if place.startswith("jdbc:"):
        reader = spark.read.format("jdbc").option("url", place).option("dbtable", name).option("fetchsize", 25_000).options(**options)
        if partition:
            reader = reader.options(partitionColumn=partition[0], lowerBound=partition[1], upperBound=partition[2], numPartitions=partition[3])
        df = reader.load()
    else:
        df = spark.read.options(**options).parquet(f"{place}/{name}.parquet")
    return df.select(*(F.col(own).alias(given) for own, given in columns.items())) if columns else df


def paged(df: DataFrame, key: str, size: int = 25_000, limit: int | None = None) -> DataFrame:
    """df with `page` (0, 1, ...) in the order of a unique key, so many rows a page, limit rows in all. Rows are numbered without a task that sees all."""
    from listwright.operators.rows import numbered_within

    n = numbered_within(df, [], [F.col(key)], "_n")
    if limit is not None:
        n = n.where(F.col("_n") <= limit)
    return n.withColumn("page", F.floor((F.col("_n") - 1) / size)).drop("_n")


def cursor_pages(pages: DataFrame) -> DataFrame:
    """The items of saved pages that lead on by cursors, with `complete`: whether each page that leads on was saved.

    pages: chain, cursor (null for the first page), end_cursor, has_next, items (an array). Added: place of the item in its page.
    """
    saved = pages.select(F.col("chain").alias("_c"), F.col("cursor").alias("_k")).where("_k is not null").distinct()
    gaps = pages.where("has_next").join(saved, (F.col("chain") == F.col("_c")) & (F.col("end_cursor") == F.col("_k")), "left_anti").select("chain").distinct().withColumn("_gap", F.lit(True))
    first = pages.where("cursor is null").select("chain").distinct().withColumn("_first", F.lit(True))
    items = pages.select("chain", "cursor", F.posexplode("items").alias("place", "item")).join(gaps, "chain", "left").join(first, "chain", "left")
    return items.select("chain", "cursor", "place", "item", (F.col("_gap").isNull() & F.col("_first").isNotNull()).alias("complete"))


def resumed(source: DataFrame, at: str, done: DataFrame, newest_first: bool = True) -> DataFrame:
    """What a scan in order of time still has to read after an error: the rows beyond the last time that was read well (done: at), and all if none was."""
    mark = done.agg((F.min if newest_first else F.max)(at).alias("_mark"))
    beyond = F.col(at) < F.col("_mark") if newest_first else F.col(at) > F.col("_mark")
    return source.crossJoin(F.broadcast(mark)).where(F.col("_mark").isNull() | beyond).drop("_mark")  # one row


def search_results(results: DataFrame, max_pages: int = 10, per_page: int = 10, marker: str = "/") -> DataFrame:
    """id, url, rank of saved web search results (query, page from 1, place from 1, url): the pages and places that a search gives, the id behind the
    last marker of the address, each id once with its best rank."""
    r = results.where((F.col("page") <= max_pages) & (F.col("place") <= per_page)).withColumns({"rank": (F.col("page") - 1) * per_page + F.col("place"), "id": F.substring_index(F.regexp_replace("url", "[?#].*$|/$", ""), marker, -1)})
    return r.where("id <> ''").groupBy("query", "id").agg(F.min(F.struct("rank", "url")).alias("x")).select("query", "id", "x.url", "x.rank")


def finished_results(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """The results (task, page, item) of saved asynchronous tasks (task, status, at) whose last status is `finished`, all pages of them."""
    last = tasks.groupBy("task").agg(F.max_by("status", "at").alias("status"))
    return results.join(last.where("status = 'finished'").select("task"), "task", "left_semi")


def annotation_sheet(sheet: DataFrame, columns: dict[str, str], checked: Column, files: DataFrame, file: str) -> DataFrame:
    """Rows of a sheet that were checked, under new names, without rows that lack a value, of pages whose file exists (files: one column, like `file`)."""
    s = sheet.where(F.coalesce(checked, F.lit(False))).select(*(F.col(own).alias(given) for own, given in columns.items()))
    return s.dropna().join(files.select(F.col(files.columns[0]).alias(file)).distinct(), file, "left_semi")


def tree_package(meta: DataFrame, trees: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """The parts of a saved package of trees in one table: rows that all parts have."""
    return meta.join(trees, key).join(features, key)


def read_through(requests: DataFrame, cache: DataFrame, key: str, now: Column, days: int, look_up: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(an answer for each distinct request with `cached`, the cache afterwards).

    cache: key, value, at. Entries older than the time to live count as absent; absent keys are looked up (keys -> key, value) and
    written to the cache, where the newest entry of a key stays.
    """
    fresh = cache.where(F.col("at") >= now - F.make_dt_interval(days=F.lit(days)))
    fresh = fresh.groupBy(key).agg(F.max(F.struct("at", "value")).alias("x")).select(key, "x.value", "x.at")
    keys = requests.select(key).distinct()
    hits = keys.join(fresh, key)
    found = look_up(keys.join(fresh, key, "left_anti")).select(key, "value", now.alias("at"))
    answers = hits.withColumn("cached", F.lit(True)).unionByName(found.withColumn("cached", F.lit(False)))
    after = cache.select(key, "value", "at").unionByName(found).groupBy(key).agg(F.max(F.struct("at", "value")).alias("x")).select(key, "x.value", "x.at")
    return answers, after


def unflat(pairs: dict[str, object]) -> dict:
    """The nested configuration of dotted keys."""
    out: dict = {}
    for k, v in pairs.items():
        *way, last = k.split(".")
        here = out
        for w in way:
            here = here.setdefault(w, {})
            if not isinstance(here, dict):
                raise ValueError(f"{k}: {w} has a value already")
        here[last] = v
    return out


#: Kinds that a configuration's values may be asked to have.
KINDS = {"int": int, "float": (int, float), "str": str, "bool": bool, "list": list, "dict": dict}


def validated(config: dict, spec: dict[str, dict], free: tuple[str, ...] = ()) -> dict:
    """A flat configuration with defaults, checked by a specification of its keys.

    spec: for each key default, and optionally values (those allowed), kind (a name of KINDS) and check (a function of the value). Values "!ignore" are
    left out before. Keys that the specification lacks are only allowed if they begin with one of free. A value that is not allowed raises ValueError.
    """
    given = {k: v for k, v in config.items() if v != "!ignore"}
    unknown = [k for k in given if k not in spec and not k.startswith(tuple(free) or ("\0",))]
    if unknown:
        raise ValueError(f"keys without defaults: {', '.join(unknown)}")
    out = given | {k: s.get("default") for k, s in spec.items() if k not in given}
    for k, s in spec.items():
        v = out[k]
        if s.get("values") is not None and v not in s["values"]:
            raise ValueError(f"{k}: {v!r} is not among {s['values']}")
        if s.get("kind") and (not isinstance(v, KINDS[s["kind"]]) or (isinstance(v, bool) and s["kind"] in ("int", "float"))):
            raise ValueError(f"{k}: {v!r} is no {s['kind']}")
        if s.get("check") and s["check"](v) is not True:
            raise ValueError(f"{k}: {v!r} is refused")
    return out


def validated_rows(rows: DataFrame, column: str, spec: dict[str, dict], free: tuple[str, ...] = ()) -> DataFrame:
    """rows with `config` (the validated configuration as JSON) and `error` of a column of JSON configurations; one of them is null."""
    @F.pandas_udf("config string, error string")
    def check(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                c = json.loads(t or "{}")
                plain = {k: json.loads(v) if not isinstance(_leaf(c, k), str) else v for k, v in flat(c)}
                out.append((json.dumps(validated(plain, spec, free), sort_keys=True), None))
            except ValueError as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["config", "error"])

    return rows.withColumn("_c", check(column)).select(*rows.columns, "_c.config", "_c.error")


def _leaf(config: dict, key: str):
    for k in key.split("."):
        config = config[k]
    return config
