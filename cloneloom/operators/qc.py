"""Quality control: counters of steps, ratios with thresholds, coverage and usage tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """part / whole against two thresholds; if `high` values are good, below `middle` is WARN and below `upper` ALERT is
    the other way round: OK from `upper` on, WARN from `middle` on, else ALERT. If low values are good the signs turn."""

    name: str
    part: str
    whole: str
    middle: float
    upper: float
    high_is_good: bool = True


#: The names of the checks, which are those of the interface surveyed. For each: part, whole, high_is_good.
NAMES = {
    "SuccessfullyAlignedReads": ("aligned", "total", True),
    "OffTargetReads": ("off_target", "total", False),
    "ReadsWithNoVOrJHits": ("no_v_or_j", "total", False),
    "ReadsUsedInClonotypes": ("used", "total", True),
    "AlignmentsWithNoAssemblingFeature": ("no_feature", "aligned", False),
    "AlignmentsDroppedLowQuality": ("low_quality", "aligned", False),
    "ClonesDroppedInPostFiltering": ("clones_dropped", "clones", False),
    "AlignmentsDroppedInPostFiltering": ("alignments_dropped", "aligned", False),
    "ReadsWithNoBarcode": ("no_barcode", "total", False),
    "ReadsDroppedInTagRefinement": ("tag_refinement", "aligned", False),
    "TagArtificialDiversityEliminated": ("tag_diversity", "tags", False),
    "ReadsDroppedInTagCorrection": ("tag_correction", "aligned", False),
    "ReadsDroppedInTagFiltering": ("tag_filtering", "aligned", False),
    "TagGroupsWithNoAssemblingFeature": ("groups_no_feature", "groups", False),
    "TagGroupsWithMultipleConsensuses": ("groups_multiple", "groups", False),
    "UnassignedAlignments": ("unassigned", "aligned", False),
    "OverlappedReadsMoreBetter": ("overlapped", "total", True),
    "OverlappedReadsLessBetter": ("overlapped", "total", False),
    "CellBarcodesWithFoundGroups": ("cells_grouped", "cells", True),
    "SpikeInControls": ("spike_in", "spike_expected", True),
}


def checks(**thresholds: tuple[float, float]) -> list[Check]:
    """Checks with the (middle, upper) thresholds given by name; there are no others, for they depend on the protocol."""
    return [Check(name, part, whole, middle, upper, good) for name, (middle, upper) in thresholds.items() for part, whole, good in (NAMES[name],)]


def verdict(ratio: Column, check: Check) -> Column:
    if check.high_is_good:
        return F.when(ratio >= check.upper, "OK").when(ratio >= check.middle, "WARN").otherwise("ALERT")
    return F.when(ratio <= check.upper, "OK").when(ratio <= check.middle, "WARN").otherwise("ALERT")


def run_checks(counters: DataFrame, checks: Sequence[Check], sample: str = "sample") -> DataFrame:
    """(sample, check, value, status) of a counter table, one row a sample; checks without their counters are left out."""
    have = set(counters.columns)
    usable = [c for c in checks if {c.part, c.whole} <= have]
    if not usable:
        return counters.select(sample).limit(0).withColumns({"check": F.lit(""), "value": F.lit(0.0), "status": F.lit("")})
    ratio = lambda c: F.try_divide(F.col(c.part).cast("double"), F.col(c.whole))
    rows = F.array(*[F.struct(F.lit(c.name).alias("check"), ratio(c).alias("value"), F.when(ratio(c).isNotNull(), verdict(ratio(c), c)).alias("status")) for c in usable])
    return counters.select(sample, F.explode(rows).alias("x")).select(sample, "x.*")


def observed(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """df, and an Observation that has the counters once an action on it has run; no further job is needed."""
    o = Observation(name)
    return df.observe(o, *[c.alias(n) for n, c in counters.items()]), o


def coverage(alignments: DataFrame, start: str = "start", end: str = "end", by: Sequence[str] = ("sample",)) -> DataFrame:
    """How many intervals cover each position: changes at the ends are summed, so long intervals cost two rows each."""
    from pyspark.sql.window import Window

    ends = alignments.select(*by, F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("d")), F.struct(F.col(end).alias("pos"), F.lit(-1).alias("d")))).alias("e")).groupBy(*by, "e.pos").agg(F.sum("e.d").alias("d"))
    return ends.withColumn("coverage", F.sum("d").over(Window.partitionBy(*by).orderBy("pos"))).select(*by, "pos", "coverage")


def chain_usage(df: DataFrame, chain: Column, by: Sequence[str] = ("sample",)) -> DataFrame:
    return df.groupBy(*by, chain.alias("chain")).agg(F.count(F.lit(1)).alias("n"))
