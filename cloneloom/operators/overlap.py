"""Overlap of samples by key.

All samples are grouped by key in one shuffle. A key's row lists its samples; pairs are made inside that row, so the
number of rows grows with the pairs of samples that really share a key, never with pairs of records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .abundance import fractions


def keyed(df: DataFrame, keys: Sequence[str], sample: str = "sample", weight: str = "weight") -> DataFrame:
    """(keys, sample, weight, fraction): weights of one key in one sample are summed."""
    return fractions(df.groupBy(sample, *keys).agg(F.sum(weight).alias("weight")), (sample,))


def overlap(df: DataFrame, keys: Sequence[str], sample: str = "sample", weight: str = "weight") -> DataFrame:
    """For each pair of samples sample_1 < sample_2: shared, d1, d2, relative_diversity, f1, f2, jaccard, pearson and
    pearson_all.

    f1 = sqrt(sum f1 * sum f2) and f2 = sum sqrt(f1 * f2) over shared keys; pearson is the correlation over shared keys and
    pearson_all over the union, a missing key having frequency 0; undefined correlations are 0. Pairs that share no key
    have zeros."""
    k = keyed(df, keys, sample, weight)
    sizes = k.groupBy(sample).agg(F.count(F.lit(1)).alias("d"), F.sum("fraction").alias("s"), F.sum(F.col("fraction") * F.col("fraction")).alias("ss"))
    rows = k.groupBy(*keys).agg(F.collect_list(F.struct(F.col(sample).alias("s"), F.col("fraction").alias("f"))).alias("l")).where(F.size("l") > 1)
    pairs = rows.select(F.explode("l").alias("x"), "l").select("x", F.explode(F.filter("l", lambda y: y["s"] > F.col("x.s"))).alias("y"))
    fx, fy = F.col("x.f"), F.col("y.f")
    sums = pairs.groupBy(F.col("x.s").alias("sample_1"), F.col("y.s").alias("sample_2")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(fx).alias("sx"), F.sum(fy).alias("sy"), F.sum(fx * fx).alias("xx"), F.sum(fy * fy).alias("yy"), F.sum(fx * fy).alias("xy"), F.sum(F.sqrt(fx * fy)).alias("f2")
    )
    one, two = (sizes.select(F.col(sample).alias(f"sample_{i}"), F.col("d").alias(f"d{i}"), F.col("s").alias(f"t{i}"), F.col("ss").alias(f"q{i}")) for i in (1, 2))
    # samples are few next to records: their pairs are the result's rows
    every = one.join(two, F.col("sample_1") < F.col("sample_2"))
    out = every.join(sums, ["sample_1", "sample_2"], "left").na.fill(0).na.fill(0.0)

    def corr(n, sx, sy, xx, yy, xy):
        cov, vx, vy = xy - sx * sy / n, xx - sx * sx / n, yy - sy * sy / n
        tiny = 1e-18
        return F.when((vx > tiny) & (vy > tiny), F.try_divide(cov, F.sqrt(vx * vy))).otherwise(F.lit(0.0))

    n = F.when(F.col("n") > 0, F.col("n"))
    union = F.col("d1") + F.col("d2") - F.col("n")
    return out.select(
        "sample_1", "sample_2", F.col("n").alias("shared"), "d1", "d2",
        (F.col("n") / (F.col("d1") * F.col("d2"))).alias("relative_diversity"),
        F.sqrt(F.col("sx") * F.col("sy")).alias("f1"), "f2", F.try_divide(F.col("n"), union).alias("jaccard"),
        F.coalesce(corr(n, F.col("sx"), F.col("sy"), F.col("xx"), F.col("yy"), F.col("xy")), F.lit(0.0)).alias("pearson"),
        F.coalesce(corr(union, F.col("t1"), F.col("t2"), F.col("q1"), F.col("q2"), F.col("xy")), F.lit(0.0)).alias("pearson_all"),
    )


def overlap_table(df: DataFrame, keys: Sequence[str], samples: Sequence, sample: str = "sample", weight: str = "weight") -> DataFrame:
    """One row a key: n_samples, and for each sample its weight and fraction, 0 where it lacks the key."""
    k = keyed(df, keys, sample, weight)
    aggs = [F.countDistinct(sample).alias("n_samples")]
    for s in samples:
        aggs += [F.sum(F.when(F.col(sample) == s, F.col(c)).otherwise(0.0)).alias(f"{c}_{s}") for c in ("weight", "fraction")]
    return k.groupBy(*keys).agg(*aggs)


def scatter(df: DataFrame, keys: Sequence[str], first, second, sample: str = "sample", weight: str = "weight", log10: bool = True) -> DataFrame:
    """Keys shared by two samples with both fractions, ready to be plotted."""
    k = keyed(df.where(F.col(sample).isin(first, second)), keys, sample, weight)
    t = k.groupBy(*keys).agg(*[F.max(F.when(F.col(sample) == s, F.col("fraction"))).alias(n) for s, n in ((first, "x"), (second, "y"))]).where("x is not null and y is not null")
    return t.select(*keys, *[(F.log10(n) if log10 else F.col(n)).alias(n) for n in ("x", "y")])


def pooled(df: DataFrame, metadata: DataFrame, factors: Sequence[str], sample: str = "sample") -> DataFrame:
    """Samples that share values of the metadata factors become one, named by the values."""
    name = F.concat_ws("_", *[F.coalesce(F.col(f).cast("string"), F.lit("NA")) for f in factors])
    return df.join(metadata.select(sample, name.alias("_pool")), sample).withColumn(sample, F.col("_pool")).drop("_pool")


def clone_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str = "weight") -> DataFrame:
    """Full outer comparison of two sets by key: both weights, and on which side the key is. A key that occurs twice on one
    side makes the row's side "duplicate"."""
    sides = [t.groupBy(*keys).agg(F.sum(weight).alias(n), F.count(F.lit(1)).alias(f"n_{n}")) for t, n in ((left, "w1"), (right, "w2"))]
    both = sides[0].join(sides[1], list(keys), "full_outer")
    side = F.when((F.coalesce("n_w1", F.lit(0)) > 1) | (F.coalesce("n_w2", F.lit(0)) > 1), "duplicate").when(F.col("w1").isNull(), "only_2").when(F.col("w2").isNull(), "only_1").otherwise("both")
    return both.select(*keys, F.coalesce("w1", F.lit(0.0)).alias("w1"), F.coalesce("w2", F.lit(0.0)).alias("w2"), side.alias("side"))


def record_diff(left: DataFrame, right: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """Records by id: only_1, only_2, different (with the names of the columns that differ) or same."""
    a, b = (t.select(F.col(key), F.lit(True).alias(f"in_{i}"), *[F.col(c).alias(f"{c}_{i}") for c in compared]) for i, t in ((1, left), (2, right)))
    names = F.array_compact(F.array(*[F.when(~F.col(f"{c}_1").eqNullSafe(F.col(f"{c}_2")), F.lit(c)) for c in compared]))
    status = F.when(F.col("in_2").isNull(), "only_1").when(F.col("in_1").isNull(), "only_2").when(F.size(names) > 0, "different").otherwise("same")
    return a.join(b, key, "full_outer").select(key, status.alias("status"), F.when(status == "different", F.array_join(names, ",")).otherwise("").alias("columns"))
