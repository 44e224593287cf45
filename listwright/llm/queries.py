"""The queries opN_<name> and their SQL. Each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm import op1_quality, op2_license, op3_sharding, op4_toxicity, op5_html, op6_langid, op7_embedding, op8_mixing, op9_minhash, op10_bpe, op11_lm, op12_search, op13_panes

SHARDS = 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_quality.quality(_table(spark, sf_dir, "documents"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the source is the top directory; ids of a kind share the directories below it."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 4096).cast("string"), F.floor(F.col("doc_id") / 64).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return op2_license.scan(docs.select("doc_id", path.alias("path"), "text"), "doc_id", "path", "text").withColumnRenamed("key", "doc_id")


def op3_sharding_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_sharding.shard_documents(_table(spark, sf_dir, "documents"), op3_sharding.tree([1.0] * SHARDS))


def op4_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return op4_toxicity.score(docs, op4_toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_html.extract(_table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_langid.identify(_table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_embedding.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), 0.98)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_mixing.mixed_sizes(_table(spark, sf_dir, "documents"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_bpe.digest_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_lm.score_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)


def op13_window_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_panes.pane_records(_table(spark, sf_dir, "clicks"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_rules, op2_license_scans, op3_sharding_tree, op4_toxicity_scores, op5_html_extraction, op6_language_id, op7_embedding_dedup, op8_source_mixing, op9_minhash_dedup, op10_byte_bpe, op11_lm_scores, op12_ranked_search, op13_window_panes)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": op1_quality.oracle_sql(), "op7_embedding_dedup": op7_embedding.oracle_sql(), "op9_minhash_dedup": op9_minhash.oracle_sql(), "op12_ranked_search": op12_search.oracle_sql()}
