"""Classification reports, alignment tables and file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the tabular alignment format.
ALIGNMENT = "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double"


def sample_id(path: Column) -> Column:
    """Sample of a report file: the first SRR part of its name, else a known data set, else the name's stem."""
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]+)$", 1), "(_report)?\\.txt$", "")
    run = F.regexp_extract(stem, "(?:^|_)(SRR[^_]*)", 1)
    return F.when(run != "", run).when(stem.contains("no_errors") | stem.contains("error_free"), F.lit("error_free")).when(stem.contains("miseq_error"), F.lit("miseq_error")).otherwise(stem)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(sample, line_no, pct, rank, taxid, name) of report files with six or, with minimizer counts, eight columns.

    Copies without comments (`*_clean_report.txt`) repeat another file and are left out.
    """
    lines = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    lines = lines.where(~F.col("path").contains("_clean_report") & ~F.col("line").startswith("#"))
    part = F.split("line", "\t")
    x = lines.withColumn("p", part).where(F.size("p").isin(6, 8))
    last = F.size("p")
    return x.select(sample_id(F.col("path")).alias("sample"), F.col("line_no").cast("long").alias("line_no"), F.trim(F.col("p")[0]).alias("pct"), F.trim(F.element_at("p", last - 2)).alias("rank"), F.trim(F.element_at("p", last - 1)).alias("taxid"), F.element_at("p", last).alias("name"))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Rows of tab-separated alignments with all twelve fields."""
    return spark.read.csv(path, sep="\t", schema=ALIGNMENT, mode="DROPMALFORMED")


def aligned_reads(alignments: DataFrame) -> DataFrame:
    return alignments.select(F.col("qseqid").alias("read_id")).distinct()


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of per-read outputs."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def find_read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(sample, forward, reverse): paired (`_1`/`_2`, `.1`/`.2`, `_R1`/`_R2`) or single FASTQ files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    stem = F.regexp_extract("path", "([^/]+?)\\.(?:fastq|fq)(?:\\.gz)?$", 1)
    x = files.withColumn("stem", stem).where("stem <> ''")
    x = x.withColumn("mate", F.regexp_extract("stem", "[._]R?([12])$", 1)).withColumn("sample", F.regexp_replace("stem", "[._]R?[12]$", ""))
    return x.groupBy("sample").agg(F.coalesce(F.min(F.when(F.col("mate") == "1", F.col("path"))), F.min(F.when(F.col("mate") == "", F.col("path")))).alias("forward"), F.min(F.when(F.col("mate") == "2", F.col("path"))).alias("reverse"))
