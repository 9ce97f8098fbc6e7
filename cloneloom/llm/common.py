"""What several operators of this subpackage share: scratch tables, folds, broadcasts of checked size, components."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneloom.scratch import cut, release  # noqa: F401
from cloneloom.shipping import ship  # noqa: F401

#: Words are maximal runs of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most this many rows, as counted, may be broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most `limit` rows, counted now; else df, for Spark to join by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 5; null ids are in fold 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)), F.lit(1))


def give_back() -> None:
    """Hand freed memory of this Python process back to the system, where Arrow's pool and the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def tidy(run):
    """run, a function over batches, such that what its task freed is given back at its end: workers live on, beside those
    of other stages."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def min_labels(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): (node, label), label being the component's smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014), which need a number of rounds that grows with
    the logarithm of the number of nodes. Each step's minimum is combined before its shuffle, and edges are joined to
    the minima, so a node with many neighbours is split by adaptive execution, never gathered in one task.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large-star: each larger neighbour is linked to the node's minimum
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small-star: the node and its smaller neighbours are linked to the minimum
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = star.unionByName(down.select("a", F.col("m").alias("b")))
        last, e = e, cut(star.where("a <> b").distinct())
        release(last)
        now = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = now
    raise RuntimeError("components did not settle")


#: Groups of at most this many nodes are compared pair by pair.
FEW = 256


def link(groups: DataFrame, verify, near, refine=None, open_=None) -> DataFrame | None:
    """(node, label) of the linked nodes of groups (sig, node, own, sketch, ...); None if no two are linked. Of a group's
    pairs only those count that hold a node of which the group's key is its own: others meet under another key.

    In each round every group's nodes are verified against its hub, the largest own node; then the hub, all of whose pairs in
    the group are settled, leaves, and groups within one component or without own nodes are done. Of what remains, groups of
    at most FEW nodes are verified pair by pair across components, and so are those that can't be refined (open_, a condition
    on a group's rows); refine gives the others finer groups, in which every linked pair of a group still meets, and they
    come to the next round. near(a, b) is a condition on two
    sketches that every linked pair meets; it is part of the joins, so other pairs are never written out. verify takes
    distinct pairs (a, b) and returns the linked ones.
    """
    edges, labels, more = None, None, False

    def settled(pairs: DataFrame) -> None:
        nonlocal edges, more
        found = cut(verify(pairs))
        if found.limit(1).count():
            edges, more = found if edges is None else cut(edges.unionByName(found)), True

    def known() -> DataFrame | None:
        nonlocal labels, more
        if more:
            labels, more = min_labels(edges), False
        return labels

    def across(rows: DataFrame) -> DataFrame:
        x, y = (rows.select("sig", F.col("node").alias(n), F.col("label").alias(f"l{n}"), F.col("own").alias(f"o{n}"), F.col("sketch").alias(f"s{n}")) for n in "ab")
        return x.join(y, (x["sig"] == y["sig"]) & (F.col("la") < F.col("lb")) & (F.col("oa") | F.col("ob")) & near(F.col("sa"), F.col("sb"))).select("a", "b").distinct()

    while True:
        hubs = groups.groupBy("sig").agg(F.max(F.struct("own", "node", "sketch")).alias("hub"), F.count("*").alias("k")).where("k > 1").select("sig", F.col("hub.node").alias("b"), F.col("hub.sketch").alias("sb"))
        met = groups.join(hubs, "sig").where(F.col("node") != F.col("b"))
        settled(met.where(near(F.col("sketch"), F.col("sb"))).select(F.col("node").alias("a"), "b").distinct())
        rest = met.select(*groups.columns)
        if known() is None:
            rest = rest.withColumn("label", F.col("node"))
        else:
            rest = rest.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = rest.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("own").alias("any"), F.count("*").alias("k")).where("lo <> hi and any").select("sig", "k")
        left = cut(rest.join(mixed, "sig").select(*groups.columns, "label", "k"))
        fine = F.lit(False) if refine is None else (F.col("k") > FEW) & open_
        n, coarse = left.agg(F.count("*"), F.sum(fine.cast("int"))).first()
        if n > (coarse or 0):
            settled(across(left.where(~fine)))
        if not coarse:
            return known()
        groups = cut(refine(left.where(fine).select(*groups.columns)))
