"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

A source's target is min(cap, level * weight), cap being `max_epochs` times its size; the level is raised, as sources
reach their caps, until the targets sum to the wanted total (or all are capped). target / size gives whole repetitions of
each document and a fraction; for the fraction, documents are laid end to end in the order of md5(seed:id) and those whose
middle lies before the wanted length are repeated once more, so a source misses its target by one document at most.

The order is never sorted as a whole: sizes are summed by leading hex digits of the hash, and only the one bucket of each
source that holds the end of the wanted length is looked at row by row. The plan then has one row per source, with the
last (hash, id) taken, and documents are matched to it in one pass.

Defined results: null texts have size 0, null sources form one source ranked last, null ids hash as "null", documents
with the same id share one draw, extra columns pass through, and empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, small

#: Documents of a source that share one hash prefix: about this many at most.
BUCKET_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def global_rank(df: DataFrame, col: str, name: str) -> DataFrame:
    """Rows numbered from 0 in the order of distinct values of col, nulls last, without one task that holds them all."""
    parts = max(1, min(1000, math.ceil(df.count() / 50_000)))
    placed = df.repartitionByRange(parts, F.col(col).asc_nulls_last()).withColumn("_pid", F.spark_partition_id())
    placed = cut(placed)
    counts = placed.groupBy("_pid").count()
    before = {r["_pid"]: r["count"] for r in counts.collect()}  # at most 1000 rows
    offset, total = F.lit(0).cast("long"), 0
    for pid in sorted(before):
        offset = F.when(F.col("_pid") == pid, F.lit(total)).otherwise(offset)
        total += before[pid]
    w = Window.partitionBy("_pid").orderBy(F.col(col).asc_nulls_last())
    return placed.withColumn(name, F.row_number().over(w) - 1 + offset).drop("_pid")


def water_fill(sources: DataFrame, total: float, weight: str = "weight", cap: str = "cap", name: str = "target") -> DataFrame:
    """Add min(cap, level * weight), the level such that the targets sum to total, or to the sum of caps if that is less."""
    capped, level = -1, 0.0
    while True:
        full = F.col(cap) <= F.lit(level) * F.col(weight) if capped >= 0 else F.lit(False)
        s = sources.agg(F.sum(F.when(full, F.col(cap)).otherwise(0)).alias("c"), F.sum(F.when(full, 0).otherwise(F.col(weight))).alias("w"), F.sum(F.when(full, 1).otherwise(0)).alias("n")).first()
        if s.n is None or not s.w or s.n == capped:
            break
        capped, level = s.n, (total - s.c) / s.w
    return sources.withColumn(name, F.least(F.col(cap).cast("double"), F.lit(level) * F.col(weight)))


def plan_mix(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """One row per source: source, source_size, target, whole, last_hash, last_id. sized: doc_id, source, size.

    The rank of a source by code point, null last, gives its weight, the weights repeating.
    """
    h = sized.select("doc_id", "source", "size", draw(F.col("doc_id"), seed).alias("hash"))
    sums = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    ranked = global_rank(sums, "source", "rank")
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("weight", cycle).withColumn("cap", F.col("source_size") * max_epochs))
    top = ranked.agg(F.sum("source_size").alias("t"), F.max("n").alias("n")).first()
    plan = water_fill(ranked, (top.t or 0) * share).select("source", "source_size", "target")
    plan = plan.withColumn("whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
    plan = small(plan.withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size")))
    digits = max(0, math.ceil(math.log(max(1, (top.n or 1) / BUCKET_ROWS), 16)))
    bucketed = h.withColumn("bucket", F.substring("hash", 1, digits) if digits else F.lit(""))
    buckets = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    end = F.sum("s").over(Window.partitionBy("source").orderBy("bucket"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    ends = buckets.withColumn("end", end)
    crossing = ends.join(plan, same(ends, plan)).where("end - s < wanted and end >= wanted and wanted > 0").select(ends["source"], "bucket", (F.col("end") - F.col("s")).alias("start"), "wanted")
    crossing = cut(crossing.withColumnsRenamed({"source": "c_source", "bucket": "c_bucket"}))
    near = bucketed.join(small(crossing), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bucket") == F.col("c_bucket")))
    near = near.groupBy("source", "hash", "doc_id").agg(F.sum("size").alias("size"), F.first("start").alias("start"), F.first("wanted").alias("wanted"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("hash", "doc_id"))
    taken = near.withColumn("upto", upto).where("start + upto - size / 2.0 < wanted")
    last = taken.groupBy("source").agg(F.max(F.struct("hash", "doc_id")).alias("last"))
    last = last.withColumnRenamed("source", "l_source")
    # a source whose crossing bucket gives nothing ends just before that bucket
    out = plan.join(small(crossing.select("c_source", "c_bucket")), F.col("source").eqNullSafe(F.col("c_source")), "left").join(small(last), F.col("source").eqNullSafe(F.col("l_source")), "left")
    return cut(out.select("source", "source_size", "target", "whole", F.coalesce("last.hash", "c_bucket").alias("last_hash"), F.col("last.doc_id").alias("last_id")))


def repetitions(docs: DataFrame, plan: DataFrame, seed: int = 7, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """docs with source_size, target and reps, how often the mix holds the document."""
    p = plan.select(F.col("source").alias("_p_source"), F.col("source_size").alias("_p_size"), F.col("target").alias("_p_target"), "whole", "last_hash", "last_id")
    h = draw(F.col(doc_id), seed)
    more = (h < F.col("last_hash")) | ((h == F.col("last_hash")) & (F.col(doc_id).eqNullSafe(F.col("last_id")) | (F.col(doc_id) < F.col("last_id"))))
    joined = docs.join(small(p), docs[source].eqNullSafe(F.col("_p_source")))
    reps = (F.col("whole") + F.coalesce(more, F.lit(False)).cast("int")).cast("int")
    return joined.select(*[docs[c] for c in docs.columns], F.col("_p_size").alias("source_size"), F.col("_p_target").alias("target"), reps.alias("reps"))


def mix_sources(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """(doc_id, source, size, source_size, target, reps) of all docs (doc_id, text, source)."""
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return repetitions(sized, plan_mix(sized, seed=seed, **how), seed)
