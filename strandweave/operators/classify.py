"""Read classification: joins of read k-mers with an index, votes and labels."""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kmers import kmers
from .minimizers import minimizers

UNCLASSIFIED, AMBIGUOUS, MULTI = "unclassified", "ambiguous", "multi-match"


def hits(reads: DataFrame, index: DataFrame, k: int, read: str = "read_id", seq: str = "seq") -> DataFrame:
    """(read, organism, hits): occurrences of a read's k-mers that the organism has at all."""
    present = index.select("kmer", "organism").distinct()
    return kmers(reads.select(read, seq), k, seq).join(present, "kmer").groupBy(read, "organism").agg(F.count(F.lit(1)).alias("hits"))


def _every(reads: DataFrame, labelled: DataFrame, read: str, label: Column) -> DataFrame:
    return reads.select(read).distinct().join(labelled, read, "left").withColumn("label", F.coalesce(label, F.lit(UNCLASSIFIED)))


def classify_basic(reads: DataFrame, index: DataFrame, k: int, read: str = "read_id", seq: str = "seq") -> DataFrame:
    """(read, label, hits): the organism with most hits; ties go to the first name, reads without a hit are unclassified."""
    best = hits(reads, index, k, read, seq).groupBy(read).agg(F.min(F.struct((-F.col("hits")).alias("h"), "organism")).alias("best"))
    return _every(reads, best, read, F.col("best.organism")).select(read, "label", F.coalesce(-F.col("best.h"), F.lit(0)).cast("long").alias("hits"))


def classify_weighted(reads: DataFrame, index: DataFrame, k: int, organisms: int, read: str = "read_id", seq: str = "seq") -> DataFrame:
    """(read, label, n_best): k-mers vote 1 / (organisms that have them); more than one organism above 0.9 of the best is ambiguous.

    Votes are kept as integers over the least common multiple of 1..organisms, so sums are exact in any order.
    """
    unit = lcm(*range(1, max(1, organisms) + 1))
    present = index.select("kmer", "organism").distinct()
    weight = present.groupBy("kmer").agg((F.lit(unit) / F.count(F.lit(1))).cast("long").alias("weight"))
    votes = kmers(reads.select(read, seq), k, seq).join(present.join(weight, "kmer"), "kmer").groupBy(read, "organism").agg(F.sum("weight").alias("v"))
    by = votes.groupBy(read).agg(F.max("v").alias("m"), F.collect_list(F.struct("organism", "v")).alias("all"))
    near = F.filter("all", lambda x: 10 * x["v"] > 9 * F.col("m"))
    by = by.withColumn("near", near).select(read, F.size("near").alias("n_best"), F.when(F.size("near") == 1, F.element_at("near", 1)["organism"]).otherwise(F.lit(AMBIGUOUS)).alias("l"))
    return _every(reads, by, read, F.col("l")).select(read, "label", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"))


def _by_threshold(parts: DataFrame, index: DataFrame, part: str, reads: DataFrame, threshold: float, read: str) -> DataFrame:
    """Label by the organisms that hold at least `threshold` of a read's parts."""
    size = parts.groupBy(read).agg(F.count(F.lit(1)).alias("n"))
    present = index.select(F.col(part), "organism").distinct()
    share = parts.join(present, part).groupBy(read, "organism").agg(F.count(F.lit(1)).alias("h")).join(size, read)
    good = share.where(F.col("h") >= threshold * F.col("n")).groupBy(read).agg(F.count(F.lit(1)).alias("n_organisms"), F.min("organism").alias("one"))
    out = _every(reads, good, read, F.when(F.col("n_organisms") == 1, F.col("one")).when(F.col("n_organisms") > 1, F.lit(MULTI)))
    return out.select(read, "label", F.coalesce("n_organisms", F.lit(0)).cast("long").alias("n_organisms"))


def classify_threshold(reads: DataFrame, index: DataFrame, k: int, threshold: float = 0.1, read: str = "read_id", seq: str = "seq") -> DataFrame:
    """(read, label, n_organisms): one organism with enough of the read's k-mers, several, or none."""
    return _by_threshold(kmers(reads.select(read, seq), k, seq), index, "kmer", reads, threshold, read)


def classify_minimizers(reads: DataFrame, index: DataFrame, k: int, w: int, threshold: float = 0.1, read: str = "read_id", seq: str = "seq") -> DataFrame:
    """As classify_threshold with the set of a read's minimizers."""
    return _by_threshold(minimizers(reads.select(read, seq), k, w, seq), index, "minimizer", reads, threshold, read)


def percentages(labelled: DataFrame, categories: DataFrame) -> DataFrame:
    """(label, n, pct) for every category, those without a read included."""
    total = labelled.agg(F.count(F.lit(1)).alias("total"))
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    both = categories.join(counts, "label", "left").crossJoin(F.broadcast(total))  # one row
    return both.select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce(F.round(100.0 * F.try_divide(F.coalesce("n", F.lit(0)), "total"), 6), F.lit(0.0)).alias("pct"))


def label_categories(index: DataFrame, several: bool = True) -> DataFrame:
    """All organisms of an index, the multi-match label and the unclassified label."""
    spark = index.sparkSession
    more = spark.createDataFrame([(MULTI,), (UNCLASSIFIED,)] if several else [(UNCLASSIFIED,)], "label string")
    return index.select(F.col("organism").alias("label")).distinct().unionByName(more)


def first_organism(found: DataFrame, reads: DataFrame, priority: DataFrame, read: str = "read_id") -> DataFrame:
    """(read, label): of the organisms found for a read, the one that comes first in (organism, priority)."""
    best = found.join(priority, "organism").groupBy(read).agg(F.min(F.struct("priority", "organism")).alias("best"))
    return _every(reads, best, read, F.col("best.organism")).select(read, "label")


def match_buckets(found: DataFrame, reads: DataFrame, read: str = "read_id") -> DataFrame:
    """(bucket, n, pct): reads with one, several or no organism."""
    n = found.select(read, "organism").distinct().groupBy(read).agg(F.count(F.lit(1)).alias("k"))
    by = reads.select(read).distinct().join(n, read, "left").groupBy(F.when(F.col("k") == 1, "unique").when(F.col("k") > 1, "multiple").otherwise("none").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    spark = reads.sparkSession
    names = spark.createDataFrame([("unique",), ("multiple",), ("none",)], "bucket string")
    total = reads.select(read).distinct().agg(F.count(F.lit(1)).alias("total"))
    return names.join(by, "bucket", "left").crossJoin(F.broadcast(total)).select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce(F.round(100.0 * F.try_divide(F.coalesce("n", F.lit(0)), "total"), 6), F.lit(0.0)).alias("pct"))


def organism_counts(found: DataFrame, read: str = "read_id") -> DataFrame:
    """(organism, n_reads): a read counts for every organism that it matches."""
    return found.select(read, "organism").distinct().groupBy("organism").agg(F.count(F.lit(1)).alias("n_reads"))


def lowest_common(found: DataFrame, reads: DataFrame, taxonomy: DataFrame, read: str = "read_id") -> DataFrame:
    """(read, label, depth, most_specific): the taxon that all organisms found for a read have in common, by (organism, path).

    `path` is the array of taxa from the root to the organism.  What all paths
    of a read share is what its smallest and its largest path share, so two
    aggregates that combine map-side do.  most_specific is the last taxon of the
    deepest path (ties: the first) if all others are on it, else null.
    """
    paths = found.select(read, "organism").distinct().join(taxonomy.select("organism", "path"), "organism")
    deepest = F.min(F.struct((-F.size("path")).alias("d"), "path"))["path"]
    by = paths.groupBy(read).agg(F.min("path").alias("lo"), F.max("path").alias("hi"), deepest.alias("deep"))
    common = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size("lo"), F.size("hi"))), lambda i: F.slice("lo", F.lit(1), i) == F.slice("hi", F.lit(1), i)))
    by = by.withColumn("depth", F.when(F.least(F.size("lo"), F.size("hi")) > 0, common).otherwise(0))
    chain = by.join(paths.select(F.col(read).alias("_r"), F.col("path").alias("p")), F.col(read) == F.col("_r")).groupBy(read).agg(F.min(F.slice("deep", F.lit(1), F.size("p")) == F.col("p")).alias("one"))
    by = by.join(chain, read).select(read, "depth", F.when(F.col("depth") > 0, F.element_at("lo", F.greatest("depth", F.lit(1)))).alias("l"), F.when(F.col("one"), F.element_at("deep", -1)).alias("most_specific"))
    return _every(reads, by, read, F.col("l")).select(read, "label", F.coalesce("depth", F.lit(0)).alias("depth"), "most_specific")
