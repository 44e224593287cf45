"""Language identification.

Method: character n-grams of 1 to 3 letters (lower case; all else is one blank) are hashed into DIMS buckets, weighted by
TF-IDF and scaled to length one; a sparse multinomial logistic regression is trained on them by follow-the-regularised-
leader (FTRL-proximal) with an elastic-net penalty; a temperature fitted on a held-back part of the sample calibrates it.

The document frequencies are counted over all rows that may be learned from. The regression is fitted on a bounded sample of them: at most
PER_LANG rows of a language and SAMPLE rows in all, shared alike by the languages (one row of each at least, so no language is left
out), those with the least hash of doc_id and text. Equal rows (doc_id, lang and text) count once in the sample. A row
without doc_id is not learned from.

Edge cases: a text that is null or has no letters is `und` with score 0. Without any rows to learn from, every text is
`und`. Texts are read whole; memory for a text is a few numbers for each character. Ties between languages go to the
first by name. Repeated rows are predicted alike; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.llm.arrow import give_back, map_columns, slices, small_batches

DIMS, PER_LANG, SAMPLE, EPOCHS = 1 << 15, 1000, 20_000, 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-3, 1e-4

_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER[97]:
        _LETTER[:] = [c.isalpha() for c in map(chr, range(0x110000))]
    return _LETTER


def counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams by bucket; None for a text without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    c = np.where(letter, codes, np.uint32(32)).astype(np.uint32)
    keep = letter.copy()  # of blanks in a row one stays
    keep[1:] |= letter[:-1]
    c = c[keep]
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + c[1:] * np.uint32(0xC2B2AE35)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1)
    out = np.zeros(DIMS, np.int64)
    for x in (one, two, three):
        out += np.bincount((x * np.uint32(0x9E3779B1)) >> np.uint32(17), minlength=DIMS)
    return out


def vector(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = tf * idf
    return x / (np.sqrt(x @ x) or 1.0)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # DIMS x languages
    idf: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        tf = counts(text) if self.langs else None
        if tf is None:
            return "und", 0.0
        at = np.flatnonzero(tf)
        p = softmax(vector(tf[at], self.idf[at]) @ self.weights[at] / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int) -> np.ndarray:
    """Weights after EPOCHS passes over rows (buckets, values, class)."""
    z, n = np.zeros((DIMS, k)), np.zeros((DIMS, k))
    for _ in range(EPOCHS):
        for at, x, y in rows:
            za, na = z[at], n[at]
            w = np.where(np.abs(za) <= L1, 0.0, -(za - np.sign(za) * L1) / ((BETA + np.sqrt(na)) / ALPHA + L2))
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            g2 = g * g
            z[at] = za + g - (np.sqrt(na + g2) - np.sqrt(na)) / ALPHA * w
            n[at] = na + g2
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def drawn(rows: DataFrame, sizes: list, quota: int) -> DataFrame:
    """At most quota rows (doc_id, lang, text) of each language: those with the least hash of doc_id and text. sizes: lang and count of each.

    A share of each language is cut out by the hash first, somewhat over the quota, so that what is made distinct and sorted is bounded too.
    """
    share = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, (1.5 * quota + 50) / r["count"])) for r in sizes], "lang string, share double")
    u = F.xxhash64("doc_id", "text", F.lit("langid"))
    some = rows.join(F.broadcast(share), "lang").withColumn("u", u).where(F.shiftrightunsigned("u", 11) / float(1 << 53) < F.col("share"))
    some = some.groupBy("lang", "doc_id", "u").agg(F.any_value("text").alias("text"))
    least = Window.partitionBy("lang").orderBy("u", "doc_id")
    return some.withColumn("k", F.row_number().over(least)).where(F.col("k") <= quota).select("doc_id", "lang", "text")


def slim(model: Model) -> Model:
    """The model in single precision, as it is sent to the executors: DIMS x languages numbers."""
    return Model(model.langs, model.weights.astype(np.float32), model.idf.astype(np.float32), model.temperature)


def train(docs: DataFrame) -> Model:
    """A model from the text and non-null lang of the rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null and text is not null").where(~held_out())
    sizes = rows.groupBy("lang").count().collect()  # a row for each language
    if not sizes:
        return Model([], np.zeros((DIMS, 0)), np.zeros(DIMS), 1.0)
    small_batches(docs)

    def frequencies(batches):
        import pyarrow as pa

        df, n = np.zeros(DIMS, np.int64), 0
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                if (tf := counts(t)) is not None:
                    df += tf > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *df[at].tolist()], pa.int64())], ["bucket", "n"])
        give_back()

    # a row for each bucket at most comes to the driver
    df = np.zeros(DIMS + 1)
    for r in rows.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[r["bucket"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    def features(lang, text):
        found = []  # DIMS numbers for one text at a time
        for t in text:
            tf = counts(t)
            at = np.flatnonzero(tf) if tf is not None else np.zeros(0, np.int64)
            found.append((at.astype(np.int32).tobytes(), tf[at].astype(np.float32).tobytes() if len(at) else b""))
        return {"lang": lang, "at": [a for a, _ in found], "tf": [x for _, x in found]}

    quota = max(1, min(PER_LANG, SAMPLE // len(sizes)))
    sample = map_columns(drawn(rows, sizes, quota).select("lang", "text"), "lang string, at binary, tf binary", features)
    found = sorted((r["lang"], bytes(r["at"]), bytes(r["tf"])) for r in sample.collect() if r["at"])  # quota rows a language, two numbers for each bucket that a text has
    langs = sorted({r[0] for r in found})
    data = []
    for lang, at, tf in found:
        at, x = np.frombuffer(at, np.int32), np.frombuffer(tf, np.float32).astype(float)
        data.append((at, vector(x, idf[at]), langs.index(lang)))
    order = np.random.default_rng(7).permutation(len(data))
    back = [data[i] for i in order[: len(data) // 5]]
    w = ftrl([data[i] for i in order[len(data) // 5 :]], len(langs)) if langs else np.zeros((DIMS, 0))
    return Model(langs, w, idf, temperature([x @ w[at] for at, x, _ in back], [y for *_, y in back]))


def temperature(scores: list[np.ndarray], classes: list[int]) -> float:
    """The temperature of the least log loss, of a grid of ratios."""
    if not scores:
        return 1.0
    z, y = np.array(scores), np.array(classes)
    loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-300)).mean()
    return min((math.exp(k / 10) for k in range(-30, 31)), key=loss)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each whole text; the model is trained on docs if none is given."""
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(slim(model))

    def run(doc_id, held, text):
        lang, score = zip(*map(shared.value.predict, text), strict=True)
        return {"doc_id": doc_id, "held_out": held, "lang_pred": lang, "score": score}

    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held"), "text"), "doc_id long, held_out boolean, lang_pred string, score double", run)
