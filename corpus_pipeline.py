"""Corpus pipeline over documents: language, toxicity, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm import op4_toxicity, op6_langid, op8_mixing, op9_minhash, op10_bpe
from listwright.llm.arrow import add_columns
from listwright.session import shared_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if its language is unknown or the prediction is less sure than this.
MIN_LANG_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; lang is set to the predicted one where it is null.

    Null and empty texts, and texts without letters, go; long texts are read whole; repeated rows are decided alike. An empty
    table stays empty; columns beside those of documents are left out.
    """
    shared = spark.sparkContext.broadcast(op6_langid.slim(op6_langid.train(docs)))

    def predict(text):
        lang, score = zip(*map(shared.value.predict, text), strict=True)
        return {"_lang": lang, "_score": score}

    found = add_columns(docs.select(*COLUMNS), ["text"], "_lang string, _score double", predict)
    return found.where((F.col("_lang") != "und") & (F.col("_score") >= MIN_LANG_SCORE)).withColumn("lang", F.coalesce("lang", "_lang")).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic.

    Null and empty texts have the score of a text without words and stay; long texts are read whole; repeated rows are decided
    alike. An empty table stays empty; columns beside those of documents are left out.
    """
    shared = spark.sparkContext.broadcast(op4_toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    found = add_columns(docs.select(*COLUMNS), ["text"], "_score double", lambda text: {"_score": list(map(shared.value.score, text))})
    return found.where(F.col("_score") < op4_toxicity.THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the least doc_id, nulls last; of several with one doc_id the one with the least text hash.

    Decisions are made for rows, not for ids: a row whose text is in no group stays whatever other rows share its doc_id. Null
    texts and texts without words are in no group and all stay; equal rows are one group; long texts are read whole. An empty
    table stays empty; columns beside those of documents are left out.
    """
    return op9_minhash.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: each document once for each pass that takes words of it, with these words.

    Null texts and texts without words hold no words, so the mix takes none of them; a null source is a source; repeated rows are
    documents of their own; a long text spans many blocks. An empty table stays empty; columns beside those of documents are left out.
    """
    return op8_mixing.mixed_documents(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and hashes of the ids and of what they decode to, for each text.

    A null text has no tokens; repeated rows are encoded one by one, texts whole. An empty table stays empty.
    """
    return op10_bpe.digest_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("tokens", tokens)]

#: The learned stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
