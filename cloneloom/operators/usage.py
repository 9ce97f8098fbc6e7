"""Usage of genes, families and pairs, length distributions, additive characteristics and residue properties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .abundance import fractions


def usage(df: DataFrame, of: Sequence[str], by: Sequence[str] = ("sample",), weight: str = "weight") -> DataFrame:
    """Share of each group's weight by the values of one column, or of several together. Values are aggregated before
    the shares are taken, so only their sums are shuffled."""
    sums = df.groupBy(*by, *of).agg(F.sum(weight).alias("weight"))
    return fractions(sums, by).select(*by, *of, "weight", "fraction")


def usage_matrix(df: DataFrame, of: str, values: Sequence, by: Sequence[str] = ("sample",), weight: str = "weight") -> DataFrame:
    """The same with one column a value, 0 where a sample has none."""
    u = usage(df, [of], by, weight)
    return u.groupBy(*by).pivot(of, list(values)).agg(F.first("fraction")).na.fill(0.0)


def family(gene: Column) -> Column:
    """The family in a gene's name: what stands before the first "-", "*" or "#"."""
    return F.regexp_extract(gene, r"^([^-*#]+)", 1)


def additive(df: DataFrame, value: Column, by: Sequence[str] = ("sample",), weight: str = "weight") -> DataFrame:
    """Weighted sum, mean and population standard deviation of a value; rows without a value don't count."""
    v, w = value.cast("double"), F.when(value.isNotNull(), F.col(weight))
    s = df.groupBy(*by).agg(F.sum(v * w).alias("sum"), F.sum(w).alias("_w"), F.sum(v * v * w).alias("_vv"))
    mean = F.try_divide(F.col("sum"), F.col("_w"))
    var = F.try_divide(F.col("_vv"), F.col("_w")) - mean * mean
    return s.select(*by, "sum", mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"))


def spectratype(df: DataFrame, length: Column, key: str, top: int = 10, by: Sequence[str] = ("sample",), weight: str = "weight") -> DataFrame:
    """For each length the shares of its `top` heaviest keys and of all others, called "other"."""
    rows = fractions(df, by, weight).withColumn("length", length)
    keyed = rows.groupBy(*by, "length", key).agg(F.sum("fraction").alias("fraction"))
    order = Window.partitionBy(*by, "length").orderBy(F.col("fraction").desc(), key)
    name = F.when(F.row_number().over(order) <= top, F.col(key).cast("string")).otherwise(F.lit("other"))
    return keyed.withColumn("label", name).groupBy(*by, "length", "label").agg(F.sum("fraction").alias("fraction"))


def gene_spectratype(df: DataFrame, gene: str, length: Column, by: Sequence[str] = ("sample",), weight: str = "weight") -> DataFrame:
    """Weight by gene and length."""
    return df.withColumn("length", length).groupBy(*by, gene, "length").agg(F.sum(weight).alias("weight"))


def mean_length_by_gene(df: DataFrame, gene: str, length: Column, by: Sequence[str] = ("sample",), weight: str = "weight") -> DataFrame:
    return df.groupBy(*by, gene).agg(F.try_divide(F.sum(length * F.col(weight)), F.sum(weight)).alias("mean_length"))
