"""Sequencing files as tables, and back: FASTQ, FASTA and SAM text.

Files are read by Spark's own text reader with a record separator, so any store that Spark reads works, files are listed by
pattern, large plain files are split, and lines never pass through Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """(file, descr, seq) of each record."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^>", "").alias("r")).where("trim(r) <> ''")
    return rows.select("file", F.trim(F.substring_index("r", "\n", 1)).alias("descr"), F.regexp_replace(F.regexp_replace("r", "^[^\n]*\n?", ""), r"\s", "").alias("seq"))


def read_fastq(spark: SparkSession, path, replace_wildcards: bool = False) -> DataFrame:
    """(file, read_no, descr, seq, qual): records of four lines, numbered in the order of each file.

    Quality lines may begin like headers, so records can't be cut at a separator: files are read whole lines, and numbered
    by whole-file reads; a file is one task, as a compressed one is anyway."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\r?\n").alias("l"))
    n = F.floor((F.size("l") + F.when(F.element_at("l", -1) == "", -1).otherwise(0)) / 4).cast("int")
    rec = files.select("file", "l", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("i"))
    line = lambda k: F.get("l", F.col("i") * 4 + k)
    seq = F.regexp_replace(F.upper(line(1)), "[^ACGTN]", "N") if replace_wildcards else line(1)
    return rec.select("file", F.col("i").cast("long").alias("read_no"), F.regexp_replace(line(0), "^@", "").alias("descr"), seq.alias("seq"), line(3).alias("qual"))


def read_pairs(spark: SparkSession, first, second, **how) -> DataFrame:
    """(read_no, descr, r1, q1, r2, q2): two synchronized files, joined by the record's number."""
    a, b = (read_fastq(spark, p, **how) for p in (first, second))
    return a.select("read_no", "descr", F.col("seq").alias("r1"), F.col("qual").alias("q1")).join(b.select("read_no", F.col("seq").alias("r2"), F.col("qual").alias("q2")), "read_no")


def read_sam(spark: SparkSession, path, drop_mapped_elsewhere: Sequence[str] = ()) -> DataFrame:
    """(descr, flag, reference, position, mate, seq, qual) of a SAM text's alignments; reads mapped to any of the named
    references can be dropped. BAM and CRAM need a converter that writes SAM."""
    v = F.split("value", "\t")
    rows = spark.read.text(path).where("not startswith(value, '@')").select(v.alias("v")).where("size(v) >= 11")
    flag = F.col("v")[1].cast("int")
    seq = F.when(flag.bitwiseAND(16) != 0, F.reverse(F.translate(F.col("v")[9], "ACGT", "TGCA"))).otherwise(F.col("v")[9])
    qual = F.when(flag.bitwiseAND(16) != 0, F.reverse(F.col("v")[10])).otherwise(F.col("v")[10])
    out = rows.select(F.col("v")[0].alias("descr"), flag.alias("flag"), F.col("v")[2].alias("reference"), F.col("v")[3].cast("int").alias("position"), F.when(flag.bitwiseAND(128) != 0, 2).otherwise(1).alias("mate"), seq.alias("seq"), qual.alias("qual"))
    return out.where(~F.col("reference").isin(list(drop_mapped_elsewhere))) if drop_mapped_elsewhere else out


def write_fastq(df: DataFrame, path: str, by: Sequence[str] = (), descr: str = "descr", seq: str = "seq", qual: str = "qual") -> None:
    """FASTQ text, one folder for each value of `by`."""
    rec = F.concat(F.lit("@"), descr, F.lit("\n"), seq, F.lit("\n+\n"), qual)
    out = df.select(*by, rec.alias("value"))
    (out.write.partitionBy(*by) if by else out.write).text(path)


def file_tags(df: DataFrame, pattern: str, file: str = "file") -> DataFrame:
    """Tags from file names: in the pattern {{NAME}} captures and * is anything."""
    import re

    names = re.findall(r"\{\{(\w+)\}\}", pattern)
    rx = re.escape(pattern).replace(r"\*", ".*")
    rx = re.sub(r"\\\{\\\{\w+\\\}\\\}", "([^/]*?)", rx) + "$"
    return df.withColumns({n: F.regexp_extract(file, rx, i + 1) for i, n in enumerate(names)})
