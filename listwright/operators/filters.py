"""Filters and dispatch of listings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions.constants import DEFAULT_THRESHOLD, ORG_THRESHOLDS, SAMPLE_PERCENT
from listwright.functions.text import contains_any
from listwright.operators.rows import numbered_within
from listwright.session import shared_table


def text_of(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in columns)))


def without_keywords(df: DataFrame, words: list[str], columns: tuple[str, ...] = ("title", "description")) -> DataFrame:
    return df.where(~contains_any(text_of(*columns), F.array(*map(F.lit, words)).cast("array<string>")))


def has_keyword(words: list[str], columns: tuple[str, ...] = ("title", "description")) -> Column:
    return contains_any(text_of(*columns), F.array(*map(F.lit, words)).cast("array<string>"))


def with_keywords(df: DataFrame, words: list[str], columns: tuple[str, ...] = ("title", "description"), translated: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows with a keyword in one of the columns. translated: for columns of translations, the keywords that are looked for in them alone."""
    found = has_keyword(words, columns)
    for column, own in (translated or {}).items():
        found = found | has_keyword(own, (column,))
    return df.where(found)


def threshold_of(org: Column, active: Column) -> Column:
    """The risk threshold of an organisation; null without filtering."""
    out = None
    for name, t in ORG_THRESHOLDS.items():
        out = (F if out is None else out).when(org == name, F.lit(t))
    return out.when(active, F.lit(DEFAULT_THRESHOLD))


def passes(score: Column, threshold: Column) -> Column:
    """No threshold, or 0, keeps; no score, or 0, keeps; else the score must be over the threshold."""
    none = lambda c: F.coalesce(c, F.lit(0.0)) == 0
    return none(threshold) | none(score) | F.coalesce(score > threshold, F.lit(False))


def filter_by_score(df: DataFrame, threshold: Column, sampled: Column | None = None) -> DataFrame:
    """Rows that pass, rows without title and description, and sampled rows, which are tagged `unfiltered`."""
    blank = F.col("title").isNull() & F.col("description").isNull()
    lucky = F.lit(False) if sampled is None else sampled & ~blank
    out = df.withColumn("unfiltered", lucky).where(blank | passes(F.col("score"), threshold) | lucky)
    return out


def one_percent(key: Column) -> Column:
    """A repeatable share of SAMPLE_PERCENT by the key."""
    return F.pmod(key * 2654435761, F.lit(100)) < SAMPLE_PERCENT


def best_score_passes(scores: Column, threshold: Column) -> Column:
    """For scores by organisation: rows without any are dropped."""
    return F.size(scores).isNotNull() & (F.size(scores) > 0) & (threshold.isNull() | (F.array_max(F.map_values(scores)) > threshold))


#: Bytes of a keyword's gram; places of the filter that tells which grams some keyword has chosen; one row of so many is looked at to choose rare ones.
GRAM, FILTER, SAMPLED = 4, 1 << 16, 16


def _grams(b: Column, width: int) -> Column:
    """All grams of so many bytes of a binary."""
    return F.transform(F.sequence(F.lit(1), F.length(b) - (width - 1)), lambda i: F.substring(b, i, F.lit(width)))


def _place(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FILTER)).cast("int")


def _hits(texts: Column, widths: list[int], places: list[int]) -> Column:
    """Distinct grams of an array of binaries whose places are in a filter."""
    one = lambda w: lambda b: F.when(F.length(b) >= w, F.filter(_grams(b, w), lambda g: _place(g).isin(places))).otherwise(F.array().cast("array<binary>"))
    return F.array_distinct(F.flatten(F.concat(*(F.transform(texts, one(w)) for w in widths))))


def _filter_of(grams: DataFrame) -> tuple[list[int], list[int]]:
    """(widths, places) of a table of grams; at most GRAM + FILTER numbers come to the driver, however many grams there are."""
    rows = grams.select(F.explode(F.array(-F.length("gram"), _place(F.col("gram")))).alias("x")).distinct().collect()
    return sorted(-r.x for r in rows if r.x < 0), sorted(r.x for r in rows if r.x >= 0)


def dispatch(df: DataFrame, keywords: DataFrame, id_col: str = "id") -> DataFrame:
    """id, organisations: each listing's organisations by keyword containment, the last row of a repeated keyword naming it.

    keywords (keyword, organisation, pos) may be many: each has one gram of its bytes, the rarest of its grams in a sample of the listings (which only
    makes it fast). A listing's grams pass a filter of the chosen ones before they are joined, and containment is checked on what meets.
    A keyword shorter than a gram is its own gram; the empty one meets all.
    """
    kw = keywords.groupBy(F.lower("keyword").alias("keyword")).agg(F.max_by("organisation", "pos").alias("organisation"))
    kw = shared_table(kw.withColumn("b", F.col("keyword").cast("binary")), "keywords")
    text = df.select(id_col, F.lower(F.coalesce("title", F.lit(""))).alias("t"), F.lower(F.coalesce("description", F.lit(""))).alias("d"))
    texts = F.array(F.col("t").cast("binary"), F.col("d").cast("binary"))
    own = kw.where("length(b) > 0").select("keyword", F.explode(F.array_distinct(F.when(F.length("b") < GRAM, F.array("b")).otherwise(_grams(F.col("b"), GRAM)))).alias("gram"))
    widths, words = _filter_of(own.select("gram").distinct())
    key = kw.where("length(b) = 0").select("keyword", F.lit(b"").alias("gram"))
    if widths:
        seen = text.where(F.pmod(F.xxhash64(id_col), F.lit(SAMPLED)) == 0).select(F.explode(_hits(texts, widths, words)).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
        rare = own.join(seen, "gram", "left").groupBy("keyword").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("x")).select("keyword", "x.gram")
        key = shared_table(rare.unionByName(key), "keyword-grams")
        widths, words = _filter_of(key.where("length(gram) > 0"))
    grams = F.concat(F.array(F.lit(b"")), _hits(texts, widths, words)) if widths else F.array(F.lit(b""))
    met = text.select(id_col, "t", "d", F.explode(grams).alias("gram")).join(key.join(kw.drop("b"), "keyword"), "gram")
    found = met.where(F.contains("t", F.col("keyword")) | F.contains("d", F.col("keyword"))).select(id_col, "organisation")
    return found.groupBy(id_col).agg(F.array_sort(F.collect_set("organisation")).alias("organisations"))


#: The same for tables of keywords of any size; kept for those who call it by this name.
dispatch_by_join = dispatch


def by_organisation(df: DataFrame, column: str = "organisations") -> DataFrame:
    """One row for each organisation of a listing; those without any go to `no_organisation`."""
    some = F.when(F.size(column) > 0, F.col(column)).otherwise(F.array(F.lit("no_organisation")))
    return df.withColumn("organisation", F.explode(some))


def per_domain_limit(df: DataFrame, limit: Column, total: int, *order) -> DataFrame:
    """Rows in scheduler order (without ties) with at most `limit` for a domain, and `total` over all; aliases of a domain count together. No task sees a whole domain."""
    domain = F.when(F.contains("domain", F.lit("shopee")), "shopee").otherwise(F.col("domain"))
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    kept = numbered_within(df.withColumn("_domain", domain), ["_domain"], by, "_n").where(F.col("_n") <= limit)
    return kept.select(*df.columns).orderBy(*order).limit(total)


class FullText:
    """A boolean query (OR, AND, NOT, parentheses; words next to each other are AND) as a predicate over an array of tokens. The four methods below say what it is made of."""

    def __init__(self, text: str):
        self.tokens = re.findall(r"\(|\)|[^\s()]+", text)
        self.at = 0

    def either(self, a: Column, b: Column) -> Column:
        return a | b

    def both(self, a: Column, b: Column) -> Column:
        return a & b

    def negated(self, a: Column, tokens: Column) -> Column:
        return ~a

    def word(self, word: str, tokens: Column) -> Column:
        return F.array_contains(tokens, word)

    def column(self, tokens: Column) -> Column:
        out = self._or(tokens)
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at]!r}")
        return out

    def _next(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def _or(self, tokens: Column) -> Column:
        out = self._and(tokens)
        while (self._next() or "").upper() == "OR":
            self.at += 1
            out = self.either(out, self._and(tokens))
        return out

    def _and(self, tokens: Column) -> Column:
        out = self._not(tokens)
        while (t := self._next()) and t != ")" and t.upper() != "OR":
            if t.upper() == "AND":
                self.at += 1
            out = self.both(out, self._not(tokens))
        return out

    def _not(self, tokens: Column) -> Column:
        t = self._next()
        if t is None or t == ")":
            raise ValueError("a word is missing")
        self.at += 1
        if t.upper() == "NOT":
            return self.negated(self._not(tokens), tokens)
        if t == "(":
            out = self._or(tokens)
            if self._next() != ")":
                raise ValueError("a parenthesis is not closed")
            self.at += 1
            return out
        return self.word(t.lower(), tokens)


def full_text(df: DataFrame, query: str, columns: tuple[str, ...] = ("title", "description")) -> DataFrame:
    """Rows whose words match a boolean query."""
    words = F.split(F.lower(F.concat_ws(" ", *columns)), r"[^\p{L}\p{N}_]+")
    return df.where(FullText(query).column(words))
