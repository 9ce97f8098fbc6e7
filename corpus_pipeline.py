"""A corpus pipeline of five stages over `documents`: language identification, line deduplication, near-duplicate removal,
mixing to target weights, tokenization. Each stage is a function (spark, docs, sf_dir) -> DataFrame of the documents it
keeps, with the columns it was given; the last returns what the tokenizer gives.

The stages' results can't be written in SQL (the first is a trained classifier), so ORACLE_SQL is None and tests hold each
stage against a plain Python version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneloom.llm import bpe, langid, line_dedup, mixing, ngram_jaccard
from cloneloom.llm.common import cut, fold, ship, small
from cloneloom.llm.queries import word_bpe_path

#: A document whose likeliest language has a lower calibrated probability is rejected, as is one without a letter.
MIN_LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a letter whose language is told with enough confidence."""
    ship(spark)
    model = langid.fit(docs.select("doc_id", "text", "lang").where(fold() != 0).where("lang is not null and text is not null"))
    judged = langid.predict(docs, model)
    return judged.where((F.col("lang_pred") != langid.UNDECIDED) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out repeated lines; a document goes if nothing but blank lines is left of it."""
    out = line_dedup.dedup_lines(docs)
    lost = (F.size("dropped") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    n_chars = F.when(F.size("dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.where(~lost).select(*[n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id. Rows that share an id are judged by
    their texts: of equal or linked ones one stays, others don't count as copies."""
    found = ngram_jaccard.labelled(docs).where("doc_id is not null")
    one = cut(found.groupBy("doc_id", "th").agg(F.min("component_id").alias("component_id"), F.min("label").alias("label"), F.count("*").alias("rows")))
    kept = one.where("component_id = doc_id")
    linked = kept.where("label is not null").groupBy("doc_id", "label").agg(F.min("th").alias("th"), F.max("th").alias("last")).where("th <> last")
    other = kept.join(linked.select("doc_id", "label", F.col("th").alias("best")), ["doc_id", "label"]).where("th <> best")
    goes = small(one.where("component_id <> doc_id").select("doc_id", "th").unionByName(other.select("doc_id", "th")).select(F.col("doc_id").alias("gone"), F.col("th").alias("gone_th")))
    same = lambda i, t: (F.col("doc_id") == F.col(i)) & (F.xxhash64("text") == F.col(t))
    left = docs.join(goes, same("gone", "gone_th"), "left_anti")
    again = small(kept.where("rows > 1").select(F.col("doc_id").alias("again"), F.col("th").alias("again_th")))
    repeated = left.join(again, same("again", "again_th"), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, same("again", "again_th"), "left_anti").unionByName(repeated)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix holds them."""
    sized = cut(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    mixed = mixing.repetitions(docs, mixing.plan_mix(sized)).where("reps > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("reps")))).select(docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document: their number and digests of the ids and of the decoded text."""
    return bpe.encode_documents(docs.select("doc_id", "source", "text"), word_bpe_path())


STAGES = [
    ("language identification", language_stage),
    ("line deduplication", line_stage),
    ("n-gram jaccard join", copies_stage),
    ("mixing to target weights", mixing_stage),
    ("bpe encoding", token_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
