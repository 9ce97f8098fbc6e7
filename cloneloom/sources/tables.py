"""Tables in and out: samples as partitions, delimited text, metadata, reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_samples(df: DataFrame, path: str, by: Sequence[str] = ("sample",), bucket: str | None = None, buckets: int = 64, table: str | None = None) -> None:
    """One folder for each sample; or a table bucketed by a key, for joins on it without a shuffle."""
    if table and bucket:
        df.write.bucketBy(buckets, bucket).sortBy(bucket).mode("overwrite").saveAsTable(table)
        return
    df.write.partitionBy(*by).mode("overwrite").parquet(path)


def write_tsv(df: DataFrame, path: str, header: bool = True, by: Sequence[str] = ()) -> None:
    """Delimited text; arrays are joined by commas."""
    cols = [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    w = df.select(*cols).write.option("sep", "\t").option("header", header).mode("overwrite")
    (w.partitionBy(*by) if by else w).csv(path)


def read_metadata(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Sample metadata: names lower-cased; a column is numeric if all its values are; a `sample` column must be there."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    if "sample" not in raw.columns:
        raise ValueError("the metadata have no column `sample`")
    numeric = raw.agg(*[F.every(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").try_cast("double").isNotNull()).alias(c) for c in raw.columns]).first().asDict()
    return raw.select(*[F.col(f"`{c}`").cast("double").alias(c) if numeric[c] and c != "sample" else F.col(f"`{c}`") for c in raw.columns])


def match_metadata(samples: DataFrame, metadata: DataFrame) -> DataFrame:
    """Samples with their metadata; a sample without any is an error that names some. A metadata name matches a sample
    that it equals, or whose name without folders and extensions it equals."""
    bare = F.regexp_replace(F.regexp_replace("sample", r"^.*/", ""), r"\..*$", "")
    both = samples.withColumn("_bare", bare).join(metadata.withColumnRenamed("sample", "_meta"), (F.col("sample") == F.col("_meta")) | (F.col("_bare") == F.col("_meta")), "left")
    lost = [r["sample"] for r in both.where("_meta is null").select("sample").limit(5).collect()]
    if lost:
        raise ValueError(f"no metadata for {lost}")
    return both.drop("_bare", "_meta")


def write_report(counters: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(counters, f, indent=1, sort_keys=True)


def reports_table(spark: SparkSession, path: str) -> DataFrame:
    """JSON reports of steps, one row a sample and step, counters as a map."""
    return spark.read.option("multiLine", True).json(path)
