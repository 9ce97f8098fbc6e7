"""Diversity of weighted sets, one row per sample.

Sources: Shannon 1948; Simpson 1949; Chao 1984 (bias-corrected form); Efron and Thisted 1976. All indices but D50 come from
one aggregation of (sum w, sum w ln w, sum w**2, frequencies of small weights); D50 needs the order by weight.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EFRON_THISTED_DEPTH = 20


def _efron_thisted() -> Column:
    """Observed plus the alternating series at the first depth at which its standard error is 0.05 of it or more, or at the
    last depth. At a depth, keys of weight k count (-1)**(k + 1) * C(depth, k) times."""
    steps = []
    for depth in range(1, EFRON_THISTED_DEPTH + 1):
        h = {k: float((-1) ** (k + 1) * comb(depth, k)) for k in range(1, depth + 1)}
        est = F.col("observed") + sum((F.col(f"f{k}") * h[k] for k in h), F.lit(0.0))
        var = sum((F.col(f"f{k}") * (h[k] * h[k]) for k in h), F.lit(0.0))
        steps.append(F.struct(est.alias("est"), F.sqrt(var).alias("sd")))
    stop = lambda s: ((s["est"] > 0) & (s["sd"] >= 0.05 * s["est"])) | ((s["est"] == 0) & (s["sd"] > 0))
    first = F.get(F.filter(F.array(*steps), stop), F.lit(0))
    return F.coalesce(first["est"], steps[-1]["est"])


def diversity(df: DataFrame, by: Sequence[str] = ("sample",), weight: str = "weight") -> DataFrame:
    """observed, shannon_wiener (the exponential), normalized_shannon, inverse_simpson, gini_simpson, chao1, efron_thisted.

    Rows of no weight don't count. normalized_shannon of a single key is null. Weights are rounded for the estimators that
    need frequencies of frequencies. gini_simpson is 1 minus the sum of squared shares."""
    w = F.col(weight)
    freq = [F.sum(F.when(F.round(w) == k, 1).otherwise(0)).alias(f"f{k}") for k in range(1, EFRON_THISTED_DEPTH + 1)]
    s = df.where(w > 0).groupBy(*by).agg(F.count(F.lit(1)).alias("observed"), F.sum(w).alias("s1"), F.sum(w * F.ln(w)).alias("sl"), F.sum(w * w).alias("s2"), *freq)
    entropy = F.ln("s1") - F.col("sl") / F.col("s1")
    return s.select(
        *by,
        "observed",
        F.exp(entropy).alias("shannon_wiener"),
        F.try_divide(entropy, F.when(F.col("observed") > 1, F.ln("observed"))).alias("normalized_shannon"),
        (F.col("s1") * F.col("s1") / F.col("s2")).alias("inverse_simpson"),
        (1 - F.col("s2") / (F.col("s1") * F.col("s1"))).alias("gini_simpson"),
        (F.col("observed") + F.col("f1") * (F.col("f1") - 1) / (2.0 * (F.col("f2") + 1))).alias("chao1"),
        _efron_thisted().alias("efron_thisted"),
    )


def d50(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ("sample",), weight: str = "weight", share: float = 0.5) -> DataFrame:
    """The rank of the first key, heaviest first and ties in key order, at which the running share reaches `share`."""
    order = Window.partitionBy(*by).orderBy(F.col(weight).desc(), *keys)
    run = df.withColumn("rank", F.row_number().over(order)).withColumn("_upto", F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    total = df.groupBy(*by).agg(F.sum(weight).alias("_total"))
    return run.join(total, list(by)).where(F.col("_upto") >= F.lit(share) * F.col("_total")).groupBy(*by).agg(F.min("rank").alias("d50"))
