"""Sequence tables derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import dna


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if its scan has fewer partitions than there are cores; larger tables stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def genomes(spark: SparkSession, sf_dir: str, keep_n: bool = False) -> DataFrame:
    """(seq_id, organism, seq): a document's bases (with N if asked for); the organism is its language."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return docs.select(F.col("doc_id").alias("seq_id"), F.col("lang").alias("organism"), dna(F.col("text"), keep_n).alias("seq"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, seq): bases of the benchmark items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("read_id"), dna(F.col("text"), False).alias("seq"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a classification report: samples are languages, taxa are sources, ranks come from the source's name."""
    docs = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("sample"), F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    total = docs.groupBy("sample").agg(F.sum("n").alias("total"))
    letter = F.expr("substring('GFOCPDSX', 1 + CAST(substring(name, 4) AS INT) % 8, 1)")
    x = docs.join(total, "sample").select("sample", F.col("name"), letter.alias("rank"), F.expr("substring(name, 4)").alias("taxid"), F.round(100.0 * F.col("n") / F.col("total"), 4).cast("string").alias("pct"), F.expr("CAST(substring(name, 4) AS BIGINT)").alias("line_no"))
    return x.withColumn("name", F.concat(F.lit("  "), "name"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, vec): mean embedding of each label, the samples of the small-matrix operators."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    by = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return by.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))


def phred_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with an error probability per base, from a score made of each base's place."""
    return reads(spark, sf_dir).withColumn("err", F.transform(F.sequence(F.lit(1), F.greatest(F.length("seq"), F.lit(1))), lambda i: F.pow(F.lit(10.0), -((i * 7) % 40 + 2) / 10.0)))
