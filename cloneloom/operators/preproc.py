"""Preprocessors of weighted sets: downsampling without replacement, heaviest keys, dropping of small samples, summaries.

A unit is one count of a key. Units are drawn by the order of md5(sample, key, number), which any engine reproduces. Hashes
are uniform, so the last unit drawn is known beforehand but for a narrow margin: units before it are counted by key in the
task that makes them, those within it are ranked, and no others are shuffled or written.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cloneloom.scratch import swept

from .graph import settle

#: Units made of one row at a time, and units a task.
PIECE, TASK_UNITS = 4096, 4_000_000
#: The margin on either side of the last unit's expected place, in standard deviations.
SIGMAS = 8.0


def _border(share: Column) -> Column:
    """A text that this share of all hashes is smaller than."""
    digits = F.lower(F.lpad(F.hex(F.floor(share * 2.0**52).cast("long")), 13, "0"))
    return F.when(share <= 0, "").when(share >= 1, "g").otherwise(digits)


def _with(df: DataFrame, totals: DataFrame, sample: str) -> DataFrame:
    """df with the columns of its sample's row in totals, samples that are null among them."""
    t = totals.withColumnRenamed(sample, "_sample")
    return df.join(t, F.col(sample).eqNullSafe(F.col("_sample"))).drop("_sample")


def _drawn(w: DataFrame, totals: DataFrame, keys: Sequence[str], sample: str, sigmas: float, tasks: int) -> DataFrame:
    """(sample, keys, _h, _c): the units within the margin by their hash _h, and how many are below it, _h being empty."""
    share = F.col("_n") / F.col("_size")
    off = (sigmas * F.sqrt(F.col("_n") * (1 - share)) + sigmas * sigmas) / F.col("_size")
    t = totals.select(sample, _border(share - off).alias("_lo"), _border(share + off).alias("_hi"))
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (sample, *keys)], F.lit(""))
    last = F.floor((F.col("_w") - 1) / PIECE)
    pieces = _with(w, t, sample).withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    dealt = pieces.repartition(tasks, sample, *keys, "_p").withColumn("_name", name)
    number = F.explode(F.sequence(F.col("_p") * PIECE + 1, F.least((F.col("_p") + 1) * PIECE, "_w")))
    u = dealt.withColumn("_u", number).withColumn("_md5", F.md5(F.concat("_name", F.col("_u").cast("string")).cast("binary")))
    h = F.when(F.col("_md5") < F.col("_lo"), "").when(F.col("_md5") < F.col("_hi"), F.col("_md5"))
    return u.select(sample, *keys, h.alias("_h")).groupBy(sample, *keys, "_h").agg(F.count(F.lit(1)).alias("_c")).where("_h is not null")


def downsample(df: DataFrame, keys: Sequence[str], n: int | str | Column, sample: str = "sample", weight: str = "weight", sigmas: float = SIGMAS) -> DataFrame:
    """Sets of at most n units in each sample, n being a number, a rule of automatic_size or a column made from `sample` (null:
    the whole set). Weights are summed by key and rounded; df is run once. `sigmas` sets the margin that is tried first, and
    doesn't change the result."""
    with swept(df.sparkSession):
        every = settle(df.groupBy(sample, *keys).agg(F.round(F.sum(weight)).cast("long").alias("_w")))
        if isinstance(n, str):
            n = automatic_size(sizes(every, sample, "_w"), n).first()["n"]
        w = every.where("_w > 0")
        size = (n if isinstance(n, Column) else F.lit(n)).cast("long")
        size = F.when(size < 0, 0).otherwise(size)
        totals = settle(w.groupBy(sample).agg(F.sum("_w").alias("_size")).withColumn("_n", F.coalesce(F.least(size, "_size"), F.col("_size"))))
        found = [_with(w, totals.where("_n = _size"), sample).select(sample, *keys, F.col("_w").alias("_c"))]
        left = totals.where("_n < _size")
        while units := left.agg(F.sum("_size")).first()[0]:
            tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), units // TASK_UNITS)
            drawn = settle(_drawn(w, left, keys, sample, sigmas, tasks))
            below = F.sum(F.when(F.col("_h") == "", F.col("_c")).otherwise(0))
            seen = drawn.groupBy(sample).agg(below.alias("_below"), F.sum("_c").alias("_to")).withColumnRenamed(sample, "_of")
            state = settle(left.join(seen, F.col(sample).eqNullSafe(F.col("_of")), "left").drop("_of").withColumn("_ok", F.expr("coalesce(_below, 0) <= _n and _n <= coalesce(_to, 0)")))
            rows = _with(drawn, state.where("_ok").select(sample, "_n", "_below"), sample)
            run = F.sum("_c").over(Window.partitionBy(sample).orderBy("_h", *keys).rowsBetween(Window.unboundedPreceding, -1))
            ranked = rows.where("_h <> ''").withColumn("_c", F.least("_c", F.col("_n") - F.col("_below") - F.coalesce(run, F.lit(0))))
            found += [rows.where("_h = ''").select(sample, *keys, "_c"), ranked.where("_c > 0").select(sample, *keys, "_c")]
            left, sigmas = state.where("not _ok").select(sample, "_size", "_n"), 8 * sigmas + 1
    return reduce(DataFrame.unionByName, found).groupBy(sample, *keys).agg(F.sum("_c").cast("double").alias("weight"))


def sizes(df: DataFrame, sample: str = "sample", weight: str = "weight") -> DataFrame:
    return df.groupBy(sample).agg(F.sum(F.round(F.col(weight))).cast("double").alias("size"))


def automatic_size(sizes_: DataFrame, how: str = "auto", size: str = "size") -> DataFrame:
    """One row: the common size. auto: the smallest size of at least half the 20th percentile, so that a few tiny samples
    don't set it; min: the smallest size; fixed-N: N. The rule for auto is this library's own."""
    if how.startswith("fixed-"):
        return sizes_.agg(F.lit(float(how.removeprefix("fixed-"))).alias("n"))
    if how == "min":
        return sizes_.agg(F.min(size).alias("n"))
    low = sizes_.agg((F.percentile(size, 0.2) / 2).alias("low"))
    return sizes_.join(low, F.col(size) >= F.col("low")).agg(F.min(size).alias("n"))


def drop_outliers(df: DataFrame, least: float, sample: str = "sample", weight: str = "weight") -> DataFrame:
    """Without the samples that hold fewer than `least` units."""
    return df.join(sizes(df, sample, weight).where(F.col("size") >= least).select(sample), sample, "left_semi")


def top(df: DataFrame, keys: Sequence[str], n: int, sample: str = "sample", weight: str = "weight") -> DataFrame:
    """The n heaviest keys of each sample, ties in key order."""
    order = Window.partitionBy(sample).orderBy(F.col(weight).desc(), *keys)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def cumulative_top(df: DataFrame, keys: Sequence[str], share: float, sample: str = "sample", weight: str = "weight") -> DataFrame:
    """The heaviest keys of each sample until their share of its weight reaches `share`."""
    order = Window.partitionBy(sample).orderBy(F.col(weight).desc(), *keys).rowsBetween(Window.unboundedPreceding, -1)
    total = df.groupBy(sample).agg(F.sum(weight).alias("_t"))
    run = df.withColumn("_before", F.coalesce(F.sum(weight).over(order), F.lit(0.0)))
    return run.join(total, sample).where(F.col("_before") < F.lit(share) * F.col("_t")).drop("_before", "_t")


def parse(name: str):
    """A preprocessor by its name: count-W-auto|min|fixed-N, top-W-N, cumtop-W-P, none; W names the weight column.
    Returns a function of (df, keys)."""
    kind, _, rest = name.partition("-")
    weight, _, arg = rest.partition("-")
    if kind == "none":
        return lambda df, keys: df
    if kind == "top":
        return lambda df, keys: top(df, keys, int(arg), weight=weight)
    if kind == "cumtop":
        return lambda df, keys: cumulative_top(df, keys, float(arg), weight=weight)
    if kind == "count":
        return lambda df, keys: downsample(df, keys, arg, weight=weight)
    raise ValueError(f"unknown preprocessor {name!r}")


def chain(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Preprocessors one after the other."""
    return reduce(lambda d, n: parse(n)(d, keys), names, df)


def summary(before: DataFrame, after: DataFrame, sample: str = "sample", weight: str = "weight") -> DataFrame:
    """Per sample: keys and weight before and after, and whether it was dropped."""
    a, b = (t.groupBy(sample).agg(F.count(F.lit(1)).alias(f"n_{x}"), F.sum(weight).alias(f"weight_{x}")) for t, x in ((before, "before"), (after, "after")))
    out = a.join(b, sample, "left")
    return out.select(sample, F.col("n_after").isNull().alias("dropped"), "n_before", "weight_before", F.coalesce("n_after", F.lit(0)).alias("n_after"), F.coalesce("weight_after", F.lit(0.0)).alias("weight_after"))
