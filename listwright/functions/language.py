"""Languages of texts by character trigrams of their words: a table of weights that is counted from labelled texts, and native sums over it.

A word with a border on each side is its trigrams. A trigram's weight for a language is 1000 ln((c + 1) / (n + v)), rounded down: c, how often it is in the
language's labelled texts, n all trigrams of them, v the number of different ones in all languages. Each distinct word is scored once, whatever number of texts has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.session import shared_table


def words_of(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, word, n: lower-cased words of letters and how often each row has them."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))
    return df.select(*keys, F.explode(words).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))


def trigrams(word: Column) -> Column:
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(padded, i, F.lit(3)))


def weights(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """gram, lang, w: for each trigram of labelled texts its weight in every language, whether it occurs in it or not."""
    words = words_of(labelled.where(F.col(lang).isNotNull()), [lang], text)
    counts = shared_table(words.select(F.col(lang).alias("lang"), "n", F.explode(trigrams(F.col("word"))).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("c")), "trigrams")
    totals = F.broadcast(counts.groupBy("lang").agg(F.sum("c").alias("all")))  # a row for each language
    grams = counts.select("gram").distinct()
    kinds = F.broadcast(grams.agg(F.count("*").alias("v")))  # one row
    every = grams.join(totals, F.lit(True)).join(kinds, F.lit(True)).join(counts, ["gram", "lang"], "left")
    return every.select("gram", "lang", F.floor(1000 * F.log((F.coalesce("c", F.lit(0)) + 1) / (F.col("all") + F.col("v")))).alias("w"))


def scores(texts: DataFrame, model: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, lang, p: probability of each language for texts (keys are unique) with a trigram that the model knows."""
    words = shared_table(words_of(texts, [key], text), "words")
    model = shared_table(model, "model")
    langs = sorted(r.lang for r in model.select("lang").distinct().collect())  # a row for each language
    if not langs:
        return words.select(key, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("p")).where("false")
    # a column for each language: a text's words meet one row each, and no row goes through a shuffle once for each language
    of = [f"w_{k}" for k in range(len(langs))]
    wide = model.groupBy("gram").agg(*(F.sum(F.when(F.col("lang") == l, F.col("w"))).alias(c) for l, c in zip(langs, of, strict=True)))
    grams = words.select("word").distinct().select("word", F.explode(trigrams(F.col("word"))).alias("gram"))
    each = shared_table(grams.join(wide, "gram").groupBy("word").agg(*(F.sum(c).alias(c) for c in of)), "word-weights")
    total = words.join(each, "word").groupBy(key).agg(*(F.sum(F.col("n") * F.col(c)).alias(c) for c in of))
    w = total.select(key, F.array(*of).alias("w"))
    w = w.select(key, F.transform("w", lambda x: F.exp((x - F.array_max("w")) / 1000.0)).alias("e"))
    w = w.select(key, "e", F.aggregate("e", F.lit(0.0), lambda s, x: s + x).alias("sum"))
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, langs)).alias("lang"), F.transform("e", lambda x: x / F.col("sum")).alias("p")))
    return w.select(key, each.alias("x")).select(key, "x.lang", "x.p")


def foreign(texts: DataFrame, model: DataFrame, key: str, text: str = "text", own: str = "en", least: float = 0.5) -> DataFrame:
    """key, lang of texts that are in a language other than one's own with a probability of `least` or more: the most probable one, the first by name of equal ones."""
    s = scores(texts, model, key, text).where((F.col("lang") != own) & (F.col("p") >= least))
    return s.groupBy(key).agg(F.min(F.struct((-F.col("p")).alias("p"), "lang")).alias("x")).select(key, "x.lang")
