"""Weighted sets per sample: aggregation of records into keys, fractions, ranks, totals, sorting and merging.

Throughout the library a repertoire is a DataFrame with a sample column, key columns and a weight column; the names are
parameters. Aggregations combine on the map side, so a frequent key or sample costs one row a task in the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def aggregate(df: DataFrame, by: Sequence[str], weight: Column | None = None, name: str = "weight", **more: Column) -> DataFrame:
    """One row for each combination of `by`: the summed weight (rows, if none is given) and any further aggregates."""
    w = F.count(F.lit(1)).cast("double") if weight is None else F.sum(weight).cast("double")
    return df.groupBy(*by).agg(w.alias(name), *[c.alias(n) for n, c in more.items()])


def fractions(df: DataFrame, by: Sequence[str] = ("sample",), weight: str = "weight", name: str = "fraction") -> DataFrame:
    """Add each row's share of its group's weight. Totals are aggregated first and joined, so a large sample is split
    among tasks; a window would gather it in one."""
    totals = df.groupBy(*by).agg(F.sum(weight).alias("_total"))
    return df.join(totals, list(by)).withColumn(name, F.try_divide(F.col(weight), F.col("_total"))).drop("_total")


def ranks(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ("sample",), weight: str = "weight", name: str = "rank") -> DataFrame:
    """Add the rank by weight, largest first, ties in key order."""
    w = Window.partitionBy(*by).orderBy(F.col(weight).desc(), *keys)
    return df.withColumn(name, F.row_number().over(w))


def totals(df: DataFrame, by: Sequence[str] = ("sample",), weight: str = "weight") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("weight"))


def merge(*parts: DataFrame) -> DataFrame:
    """All rows of several tables with the same columns; no table at all is an error."""
    if not parts:
        raise ValueError("nothing to merge")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def renumber(df: DataFrame, order: Sequence[str], name: str = "new_id", by: Sequence[str] = ()) -> DataFrame:
    """Number rows from 0 in the given order, inside groups if any are named."""
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return df.withColumn(name, F.row_number().over(w) - 1)


def cumulative_cutoff(df: DataFrame, keys: Sequence[str], share: float = 0.95, by: Sequence[str] = ("sample",), weight: str = "weight") -> DataFrame:
    """For each group how many of its heaviest rows it takes to reach the share of its weight."""
    w = Window.partitionBy(*by).orderBy(F.col(weight).desc(), *keys).rowsBetween(Window.unboundedPreceding, -1)
    before = df.withColumn("_before", F.coalesce(F.sum(weight).over(w), F.lit(0.0)))
    total = df.groupBy(*by).agg(F.sum(weight).alias("_total"))
    return before.join(total, list(by)).where(F.col("_before") < F.lit(share) * F.col("_total")).groupBy(*by).agg(F.count(F.lit(1)).alias("n_kept"))
