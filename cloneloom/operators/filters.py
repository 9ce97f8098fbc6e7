"""Filters, slices and limits. Each is a predicate or a semi join, so that Spark pushes it towards the scan."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sequence as S


def in_chains(hits: Sequence[str], chains: Sequence[str]) -> Column:
    """Whether a best hit's chain is among the chains; "ALL" passes everything."""
    if "ALL" in chains:
        return F.lit(True)
    got = F.array_compact(F.array(*[S.chain(F.col(h)) for h in hits]))
    return F.coalesce(F.arrays_overlap(got, F.array(*[F.lit(c) for c in chains])), F.lit(False))


def productive(df: DataFrame, features: Sequence[str], out_of_frames: bool = True, stops: bool = True) -> DataFrame:
    """Without rows that are out of frame or have a stop in any of the features; an absent feature fails."""
    keep = F.lit(True)
    for f in features:
        if out_of_frames:
            keep = keep & F.coalesce(~S.is_out_of_frame(F.col(f)), F.lit(False))
        if stops:
            keep = keep & F.coalesce(~S.has_stop(S.translate(F.col(f))), F.lit(False))
    return df.where(keep)


def group_types(df: DataFrame, drop: Sequence[str], group: str = "cell_group") -> DataFrame:
    """Without groups of the kinds found, undefined or contamination; the last two are marked by name."""
    kind = F.when(F.col(group).isin("undefined", "contamination"), F.col(group)).otherwise("found")
    return df.where(~kind.isin(list(drop)))


def larger_groups(df: DataFrame, group: str, least: int = 2) -> DataFrame:
    """Rows of groups of at least so many rows."""
    big = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(group)
    return df.join(big, group, "left_semi")


_SAFE = re.compile(r"\b(reflect|java_method|try_reflect|select|from|input_file_name|assert_true|raise_error|exists\s*\()\b", re.I)


def scripted(df: DataFrame, predicate: str) -> DataFrame:
    """Rows that satisfy a predicate in SQL over the table's columns. Subqueries and calls into the JVM are refused."""
    if _SAFE.search(predicate) or ";" in predicate:
        raise ValueError("only scalar expressions on the table's columns are allowed")
    return df.where(F.expr(predicate))


def metadata_filter(df: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """Rows that satisfy conditions like "age>=30" or "group=A" on metadata columns."""
    for c in conditions:
        m = re.fullmatch(r"\s*(\w+)\s*(>=|<=|>|<|=)\s*(.+?)\s*", c)
        if not m:
            raise ValueError(f"not a condition: {c!r}")
        col, value = F.col(m[1]), m[3]
        numeric = re.fullmatch(r"-?\d+(\.\d+)?", value)
        left, right = (col.cast("double"), F.lit(float(value))) if numeric else (col.cast("string"), F.lit(value))
        df = df.where({">=": left >= right, "<=": left <= right, ">": left > right, "<": left < right, "=": left == right}[m[2]])
    return df


def slice_ids(df: DataFrame, ids: DataFrame, key: str, renumber: bool = False) -> DataFrame:
    """Rows whose key is among ids (a table with one column of the same name); optionally renumbered from 0 in key order."""
    out = df.join(ids.select(key).distinct(), key, "left_semi")
    return out.withColumn("new_id", F.row_number().over(Window.orderBy(key)) - 1) if renumber else out


def limited(df: DataFrame, order: Sequence[str], first: int | None = None, skip: int = 0) -> DataFrame:
    """Rows skip.. of a stated order, `first` of them at most."""
    out = df.orderBy(*order)
    if skip:
        out = out.offset(skip)
    return out.limit(first) if first is not None else out


def feature_matches(feature: Column, pattern: str, errors: int = 0) -> Column:
    """Whether a feature contains a sequence with at most so many substitutions."""
    n = len(pattern)
    windows = F.when(F.length(feature) >= n, S.kmers(feature, n)).otherwise(F.array().cast("array<string>"))
    return F.exists(windows, lambda w: S.hamming(w, F.lit(pattern)) <= errors)
