"""The queries of this subpackage, each over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_permutation, bpe, langid, line_dedup, mixing, ngram_jaccard, pii, topk_blocks, toxicity, url_filter
from .sql import ORACLE_SQL  # noqa: F401

#: host, path, verdict
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_permutation.search_nearest(_table(spark, sf_dir, "embeddings"))


def op4_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_blocks.search_products(_table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), word_bpe_path())


def op7_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("reps")).alias("taken"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), rules)


def op9_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document with a text: its lines, how many stay, and the numbers of those that go."""
    gone = line_dedup.dropped_lines(_table(spark, sf_dir, "documents"))
    kept = F.col("n_lines") - F.size("dropped")
    return gone.select("doc_id", "n_lines", kept.alias("n_kept"), F.array_join(F.transform("dropped", lambda x: x.cast("string")), ",").alias("dropped"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_jaccard, op2_toxicity_nnpu, op3_permutation_index, op4_block_topk, op5_language_id, op6_trie_bpe, op7_water_filling, op8_url_filter, op9_contextual_pii, op10_line_dedup)
}
