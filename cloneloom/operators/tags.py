"""Barcodes: parsing, whitelists, aliases, correction and group filters."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import near_pairs

# The IUPAC codes of sets of bases.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "[AG]", "Y": "[CT]", "S": "[CG]", "W": "[AT]", "K": "[GT]", "M": "[AC]", "B": "[CGT]", "D": "[AGT]", "H": "[ACT]", "V": "[ACG]", "N": "[ACGT]"}


def compile_pattern(pattern: str) -> tuple[str, list[str]]:
    """A read pattern as a regular expression and its groups' names. In a pattern, (NAME:...) is a group, letters are IUPAC
    codes, N{3}, N{3:5} and N{*} repeat, * is any sequence and ^ the read's start."""
    out, names, i = ["^"] if pattern.startswith("^") else [], [], pattern.startswith("^")
    while i < len(pattern):
        c = pattern[i]
        if m := re.match(r"\((\w+):", pattern[i:]):
            names.append(m[1])
            out.append("(")
            i += m.end()
        elif m := re.match(r"\{(\*|\d+(?::\d+)?)\}", pattern[i:]):
            out.append("*" if m[1] == "*" else "{" + m[1].replace(":", ",") + "}")
            i += m.end()
        elif c == "*":
            out.append("[ACGTN]*")
            i += 1
        elif c == ")":
            out.append(")")
            i += 1
        elif c.upper() in IUPAC:
            out.append("[ACGTN]" if c.upper() == "N" else IUPAC[c.upper()])
            i += 1
        elif c.isspace():
            i += 1
        else:
            raise ValueError(f"unexpected {c!r} in the pattern")
    return "".join(out), names


def parse_tags(df: DataFrame, read: str, pattern: str) -> DataFrame:
    """One column for each named group, and status: Good or NotParsed."""
    rx, names = compile_pattern(pattern)
    ok = F.col(read).rlike(rx)
    groups = {n: F.when(ok, F.regexp_extract(read, rx, i + 1)) for i, n in enumerate(names)}
    return df.withColumns(groups | {"status": F.when(F.coalesce(ok, F.lit(False)), "Good").otherwise("NotParsed")})


def header_tag(df: DataFrame, descr: str, pattern: str, name: str, default: str | None = None) -> DataFrame:
    """A tag (or weight) captured from the read's description."""
    got = F.regexp_extract(descr, pattern, 1)
    return df.withColumn(name, F.when(got != "", got).otherwise(F.lit(default)))


def require_tags(df: DataFrame, must: Sequence[str] = (), must_not: Sequence[str] = ()) -> DataFrame:
    """df, if it has all of the one and none of the other columns; else an error."""
    have = set(df.columns)
    if missing := [t for t in must if t not in have]:
        raise ValueError(f"missing tags: {missing}")
    if present := [t for t in must_not if t in have]:
        raise ValueError(f"tags that must not be there: {present}")
    return df


def whitelist(df: DataFrame, tag: str, allowed: DataFrame, mismatches: int = 0) -> DataFrame:
    """Rows whose tag is listed; with one mismatch allowed, a tag with exactly one listed neighbour becomes that. allowed has
    one column of the tag's name."""
    listed = allowed.select(F.col(tag).alias("_ok")).distinct()
    exact = df.join(listed, F.col(tag) == F.col("_ok"), "left")
    if not mismatches:
        return exact.where("_ok is not null").drop("_ok")
    bases = F.array(*[F.lit(b) for b in "ACGTN"])
    n = F.length("t")
    near = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(bases, lambda b: F.concat(F.substr("t", F.lit(1), i - 1), b, F.substr("t", i + 1, n)))))
    odd = exact.where("_ok is null").select(F.col(tag).alias("t")).where("t <> ''").distinct()
    found = odd.select("t", F.explode(near).alias("_ok")).join(listed, "_ok").groupBy("t").agg(F.min("_ok").alias("_near"), F.countDistinct("_ok").alias("_n")).where("_n = 1").drop("_n")
    out = exact.join(found, F.col(tag) == F.col("t"), "left")
    fixed = F.coalesce("_ok", "_near")
    return out.where(fixed.isNotNull()).withColumn(tag, fixed).drop("_ok", "t", "_near")


def aliases(df: DataFrame, tag: str, table: DataFrame) -> DataFrame:
    """Tags replaced by what stands for them: table (alias, name), compared without regard to case."""
    t = table.select(F.upper("alias").alias("_a"), F.col("name").alias("_name"))
    return df.join(t, F.upper(tag) == F.col("_a"), "left").withColumn(tag, F.coalesce("_name", tag)).drop("_a", "_name")


def correct_level(df: DataFrame, tag: str, above: Sequence[str] = (), ratio: float = 4.0, weight: str = "weight", edits: int = 1, indels: bool = False) -> DataFrame:
    """One step of correction of a tag inside its parents: a tag within `edits` mismatches, with `indels` insertions and
    deletions as well, of another `ratio` times as heavy becomes that."""
    above = list(above)
    sums = df.groupBy(*above, tag).agg(F.sum(weight).alias("_w"))
    pairs = near_pairs(sums, tag, above, "_w", ratio, edits, indels)
    best = pairs.groupBy(*above, "child").agg(F.max_by("parent", F.struct("parent_weight", "parent")).alias("parent"))
    return df.join(best.withColumnRenamed("child", tag), [*above, tag], "left").withColumn(tag, F.coalesce("parent", tag)).drop("parent")


def correct(df: DataFrame, tags: Sequence[str], weight: str = "weight", ratio: float = 4.0, rounds: int = 3, edits: int = 1, indels: bool = False) -> DataFrame:
    """Barcodes corrected level by level, a child tag inside its parents; chains are followed in rounds."""
    for level, tag in enumerate(tags):
        for _ in range(rounds):
            df = correct_level(df, tag, tags[:level], ratio, weight, edits, indels)
    return df


def group_metric(df: DataFrame, by: Sequence[str], metric: str, of: str | None = None, weight: str = "weight") -> DataFrame:
    """(by, metric): sum_weight, or nunique of a column."""
    agg = F.sum(weight) if metric == "sum_weight" else F.countDistinct(of).cast("double")
    return df.groupBy(*by).agg(agg.cast("double").alias("metric"))


def otsu_threshold(df: DataFrame, metric: str = "metric", bins_per_decade: int = 10, inflate: float = 1.0) -> float:
    """Otsu's threshold on the histogram of log10 metric, each group counted metric**inflate times. The histogram is what
    reaches the driver: its size is set by the range of the metric."""
    b = F.floor(F.log10(metric) * bins_per_decade).cast("int")
    hist = df.where(F.col(metric) > 0).groupBy(b.alias("bin")).agg(F.sum(F.pow(F.col(metric), F.lit(inflate - 1))).alias("n")).orderBy("bin").collect()
    if len(hist) < 2:
        return 0.0
    x, n = np.array([r["bin"] for r in hist], float), np.array([r["n"] for r in hist], float)
    low = np.cumsum(n)[:-1]
    high = n.sum() - low
    m_low = np.cumsum(n * x)[:-1] / low
    m_high = ((n * x).sum() - np.cumsum(n * x)[:-1]) / high
    at = int(np.argmax(low * high * (m_low - m_high) ** 2))
    return float(10 ** ((x[at + 1]) / bins_per_decade))


def filter_groups(df: DataFrame, by: Sequence[str], op: str, arg=None, metric: str = "sum_weight", of: str | None = None, weight: str = "weight", within: Sequence[str] = ()) -> DataFrame:
    """Rows of groups that pass: top (N groups), cumtop (share of the metric), range (low, high), minimal_share (of the
    sum inside `within`), otsu. `within` sets the scope in which groups compete."""
    m = group_metric(df, by, metric, of, weight)
    if op == "range":
        low, high = arg
        ok = m.where(F.col("metric").between(low, high))
    elif op == "otsu":
        ok = m.where(F.col("metric") >= otsu_threshold(m))
    elif op == "top":
        w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
        ok = m.withColumn("_r", F.row_number().over(w.orderBy(F.col("metric").desc(), *by))).where(F.col("_r") <= arg)
    elif op == "cumtop":
        w = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy(F.col("metric").desc(), *by).rowsBetween(Window.unboundedPreceding, -1)
        total = m.groupBy(*within).agg(F.sum("metric").alias("_t")) if within else m.agg(F.sum("metric").alias("_t"))
        run = m.withColumn("_b", F.coalesce(F.sum("metric").over(w), F.lit(0.0)))
        run = run.join(total, list(within)) if within else run.join(F.broadcast(total))
        ok = run.where(F.col("_b") < F.lit(arg) * F.col("_t"))
    elif op == "minimal_share":
        total = m.groupBy(*within).agg(F.sum("metric").alias("_t"))
        ok = m.join(total, list(within)).where(F.col("metric") >= F.lit(arg) * F.col("_t"))
    else:
        raise ValueError(f"unknown filter {op!r}")
    return df.join(ok.select(*by), list(by), "left_semi")


def transform_tag(name: str, *args) -> Column:
    """Expressions on tags: tag, concatenate, constant, plus, multiply."""
    cols = [a if isinstance(a, Column) else F.lit(a) for a in args]
    if name == "tag":
        return F.col(args[0])
    if name == "concatenate":
        return F.concat(*cols)
    if name == "constant":
        return cols[0]
    if name == "plus":
        return cols[0] + cols[1]
    if name == "multiply":
        return cols[0] * cols[1]
    raise ValueError(f"unknown expression {name!r}")


def map_tags(df: DataFrame, tags: Sequence[str], rules: DataFrame, out: Sequence[str], keep: bool = True) -> DataFrame:
    """Tuples of tags replaced by a rule table (tags -> out); unmatched rows are dropped. keep leaves the old tags there."""
    got = df.join(rules.select(*tags, *out), list(tags))
    return got if keep else got.drop(*[t for t in tags if t not in out])


def sample_sheet(df: DataFrame, sheet: DataFrame, tags: Sequence[str], fuzzy: bool = False) -> DataFrame:
    """The sample of each record by its tags, and status NotMatched where there is none. fuzzy allows one mismatch in the
    first tag if exactly one sample is that near."""
    exact = df.join(sheet.select(*tags, F.col("sample").alias("_s")), list(tags), "left")
    if fuzzy:
        first, rest = tags[0], list(tags[1:])
        near = df.select(*tags).distinct().join(sheet.select(F.col(first).alias("_f"), *rest, F.col("sample").alias("_n")), [F.length(first) == F.length("_f")] if not rest else rest) if rest else df.select(*tags).distinct().join(F.broadcast(sheet.select(F.col(first).alias("_f"), F.col("sample").alias("_n"))), F.length(first) == F.length("_f"))
        from ..functions.sequence import hamming

        best = near.where(hamming(F.col(first), F.col("_f")) == 1).groupBy(*tags).agg(F.min("_n").alias("_near"), F.countDistinct("_n").alias("_k")).where("_k = 1").drop("_k")
        exact = exact.join(best, list(tags), "left").withColumn("_s", F.coalesce("_s", "_near")).drop("_near")
    return exact.withColumn("status", F.when(F.col("_s").isNull(), "NotMatched").otherwise("Good")).withColumnRenamed("_s", "sample")


def divide_by_tags(clone_tags: DataFrame, tags: Sequence[str], clone: str = "clone_id", weight: str = "weight") -> DataFrame:
    """Clones split into one for each prefix of tags: (clone, tags, weight)."""
    return clone_tags.groupBy(clone, *tags).agg(F.sum(weight).alias("weight"))
