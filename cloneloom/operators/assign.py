"""Records and the clones they belong to: assignment, and the way back from clones to reads and alignments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign(records: DataFrame, clones: DataFrame, keys: Sequence[str], clone: str = "clone_id") -> DataFrame:
    """records with their clone's id, -1 where no clone has their keys."""
    return records.join(clones.select(*keys, clone), list(keys), "left").withColumn(clone, F.coalesce(clone, F.lit(-1)))


def records_for_clones(assigned: DataFrame, ids: DataFrame | None = None, clone: str = "clone_id") -> DataFrame:
    """Records of the listed clones (all assigned ones without a list); -1 in the list asks for unassigned ones."""
    if ids is None:
        return assigned.where(F.col(clone) >= 0)
    return assigned.join(ids.select(clone).distinct(), clone, "left_semi")


def write_by_clone(records: DataFrame, path: str, clone: str = "clone_id") -> None:
    """One folder a clone. Rows are dealt by clone first, so a clone has few files, and large clones several."""
    records.repartition(clone, F.floor(F.rand(1) * 4)).write.partitionBy(clone).mode("overwrite").parquet(path)


def reports_table(reports: DataFrame, counters: Sequence[str], sample: str = "sample", step: str = "step") -> DataFrame:
    """One row a sample, one column a step and counter; reports: sample, step, counters (map<string,double>)."""
    rows = reports.select(sample, step, F.explode("counters").alias("name", "value"))
    named = rows.withColumn("column", F.concat_ws(".", step, "name"))
    return named.groupBy(sample).pivot("column", list(counters)).agg(F.first("value"))
