"""Connected components and neighbour joins on short strings, shared by clustering, barcode correction and cell grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloneloom.scratch import cut as settle
from cloneloom.scratch import release


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): each node of edges (a, b) with the smallest node it is connected to.

    Large-star and small-star steps (Kiveris et al., 2014); the rounds grow with the logarithm of the component size, so
    `rounds` are enough for any table; an unsettled result is an error."""
    e = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    last = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        before, e = e, settle(star.where("a <> b").distinct())
        release(before)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    pairs = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component")).distinct()


def deletions(s: Column) -> Column:
    """The string and all it becomes when one character is left out, each marked with the length and place: strings of
    one length that differ in one place share the mark of that place."""
    n = F.length(s)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(n.cast("string"), F.lit("_"), i.cast("string"), F.lit("_"), F.substr(s, F.lit(1), i - 1), F.lit("?"), F.substr(s, i + 1, n)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def one_mismatch_pairs(df: DataFrame, key: str, by: list[str], weight: str) -> DataFrame:
    """(by, child, parent, child_weight, parent_weight): pairs of strings of one length that differ in one place, the
    parent being the heavier, or the larger string of equally heavy ones.

    Strings meet at a deletion mark, so pairs come from small groups, never from all strings of a length. In a mark's group
    every string is paired with the heaviest one only: a heavier neighbour of a string that is not the heaviest is itself a
    child of the heaviest."""
    marks = df.select(*by, F.col(key).alias("s"), F.col(weight).alias("w"), F.explode(deletions(F.col(key))).alias("mark"))
    best = marks.groupBy(*by, "mark").agg(F.max_by(F.struct("s", "w"), F.struct("w", "s")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    pairs = marks.join(best, [*by, "mark"]).where("s <> best.s")
    return pairs.select(*by, F.col("s").alias("child"), F.col("best.s").alias("parent"), F.col("w").alias("child_weight"), F.col("best.w").alias("parent_weight")).distinct()


def fewer(s: Column, n: int) -> Column:
    """The string and all it becomes when up to n characters are left out: strings within n edits share one of them."""
    out = last = F.array(s)
    for _ in range(n):
        last = F.array_distinct(F.flatten(F.transform(last, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1, F.length(t)))))))
        out = F.array_union(out, last)
    return out


def near_pairs(df: DataFrame, key: str, by: list[str], weight: str, ratio: float, edits: int = 1, indels: bool = False) -> DataFrame:
    """As one_mismatch_pairs, of strings that differ by up to `edits` mismatches, or insertions and deletions as well, the
    parent being `ratio` times as heavy. Beyond one mismatch strings meet at what is left without `edits` characters, and
    are verified."""
    if edits == 1 and not indels:
        return one_mismatch_pairs(df, key, by, weight).where(F.col("parent_weight") >= ratio * F.col("child_weight"))
    marks = settle(df.select(*by, F.col(key).alias("s"), F.col(weight).alias("w"), F.explode(fewer(F.col(key), edits)).alias("mark")))
    a, b = (marks.select(*by, "mark", F.col("s").alias(n), F.col("w").alias(f"{n}_weight")) for n in ("child", "parent"))
    heavier = (F.col("parent_weight") >= ratio * F.col("child_weight")) & (F.struct("parent_weight", "parent") > F.struct("child_weight", "child"))
    pairs = a.join(b, [*by, "mark"]).where(heavier).drop("mark").distinct()
    if indels:
        return pairs.where(F.levenshtein("child", "parent", edits) >= 0)
    differ = F.aggregate(F.zip_with(F.split("child", ""), F.split("parent", ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda n, v: n + v)
    return pairs.where((F.length("child") == F.length("parent")) & (differ <= edits))
