"""Postanalysis: metrics over samples, in isolation groups and chains, as one long table.

Groups and chains are columns, so all samples are computed together; a metric is a function from (clones, by) to a table
with one value column a metric, and may have its own preprocessor.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diversity, preproc, usage

BY = ("chain", "group", "sample")


@dataclass(frozen=True)
class Metric:
    """name, the family it is exported with, how it is made, and the preprocessor (see preproc.parse) before it."""

    name: str
    family: str
    make: Callable[[DataFrame, Sequence[str]], DataFrame]
    downsampling: str = "none"


def _additive(column: str):
    return lambda df, by: usage.additive(df, F.col(column), by).select(*by, F.lit("").alias("key"), F.col("mean").alias("value"))


def _diversity(column: str):
    return lambda df, by: diversity.diversity(df, by).select(*by, F.lit("").alias("key"), F.col(column).cast("double").alias("value"))


def _usage(*columns: str):
    return lambda df, by: usage.usage(df, list(columns), by).select(*by, F.concat_ws("|", *columns).alias("key"), F.col("fraction").alias("value"))


METRICS: dict[str, Metric] = {
    m.name: m
    for m in (
        *(Metric(n, "diversity", _diversity(n)) for n in ("observed", "shannon_wiener", "normalized_shannon", "inverse_simpson", "gini_simpson", "chao1", "efron_thisted")),
        Metric("v_usage", "usage", _usage("v_gene")),
        Metric("j_usage", "usage", _usage("j_gene")),
        Metric("vj_usage", "usage", _usage("v_gene", "j_gene")),
        Metric("mean_length", "additive", _additive("len")),
    )
}


def list_metrics(families: Sequence[str] = ()) -> list[str]:
    return [m.name for m in METRICS.values() if not families or m.family in families]


def isolation(df: DataFrame, metadata: DataFrame | None = None, factors: Sequence[str] = (), chain: str | None = None) -> DataFrame:
    """df with columns group (the metadata factors' values) and chain ("ALL" if none is given)."""
    out = df.withColumn("chain", F.col(chain) if chain else F.lit("ALL"))
    if metadata is None or not factors:
        return out.withColumn("group", F.lit("ALL"))
    name = F.concat_ws(",", *[F.coalesce(F.col(f).cast("string"), F.lit("NA")) for f in factors])
    return out.join(metadata.select("sample", name.alias("group")), "sample")


def individual(clones: DataFrame, metrics: Sequence[str], keys: Sequence[str], metadata: DataFrame | None = None, factors: Sequence[str] = (), chain: str | None = None) -> DataFrame:
    """(chain, group, sample, metric, key, value) of each metric on isolated samples."""
    base = isolation(clones, metadata, factors, chain)
    out = None
    for name in metrics:
        m = METRICS[name]
        df = base if m.downsampling == "none" else preproc.parse(m.downsampling)(base, keys)
        one = m.make(df, BY).select(*BY, F.lit(name).alias("metric"), "key", "value")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no metrics")
    return out


def export_table(result: DataFrame, metric: str, values: Sequence[str] | None = None) -> DataFrame:
    """One metric as a table: a row a sample, a column a key (or `value`, for metrics without keys)."""
    rows = result.where(F.col("metric") == metric)
    if values is None:
        return rows.select(*BY, "value")
    return rows.groupBy(*BY).pivot("key", list(values)).agg(F.first("value"))
