"""Classification along a taxonomy: an index of lowest common taxa, heaviest paths and a report by clade.

A taxon is its path from the root, an array of names.  Of paths in order, the
first and the last share exactly the prefix that all of them share, so the lowest
common taxon of any number of organisms is a minimum and a maximum, which are
combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .minimizers import minimizers

UNCLASSIFIED = "unclassified"


def common_path(a: Column, b: Column) -> Column:
    """Longest common prefix of two paths."""
    same = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"].eqNullSafe(x["b"]))
    first_off = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first_off == 0, a).otherwise(F.slice(a, F.lit(1), F.greatest(first_off - 1, F.lit(0))))


def starts_path(a: Column, b: Column) -> Column:
    """Whether path a is b or above it."""
    return F.slice(b, F.lit(1), F.size(a)) == a


def lineage(path: Column) -> Column:
    """The taxa on a path, from the root down."""
    return F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(path, F.lit(1), n))


def taxon_index(genomes: DataFrame, taxonomy: DataFrame, k: int, w: int, organism: str = "organism", seq: str = "seq") -> DataFrame:
    """(minimizer, taxon): the lowest common taxon of the organisms with that minimizer, by `taxonomy` (organism, path).

    Organisms that the taxonomy lacks, or that have no path, add nothing.
    """
    paths = taxonomy.where(F.size("path") > 0).groupBy("organism").agg(F.min("path").alias("path"))
    held = minimizers(genomes.select(F.col(organism).alias("organism"), F.col(seq).alias("seq")), k, w).select("organism", "minimizer").distinct().join(paths, "organism")
    return held.groupBy("minimizer").agg(F.min("path").alias("_a"), F.max("path").alias("_b")).select("minimizer", common_path(F.col("_a"), F.col("_b")).alias("taxon")).where(F.size("taxon") > 0)


def classify_taxa(reads: DataFrame, index: DataFrame, k: int, w: int, confidence: float = 0.0, read: str = "read_id", seq: str = "seq") -> DataFrame:
    """(read, label, path, depth, n_hits, n_parts, support) of each read.

    A read's distinct minimizers vote for their taxa.  The taxon whose path from
    the root holds most votes is chosen; of equal ones their lowest common taxon.
    Then the path is cut until votes at or below its end are at least `confidence`
    of all the read's minimizers.  Reads without a vote, or whose root falls
    short, are unclassified: path empty, depth 0.  `support` is the share of votes at
    or below the label.  A read's votes are as many rows as the taxa it meets.
    """
    parts = minimizers(reads.select(F.col(read).alias("_read"), F.col(seq).alias("seq")), k, w)
    size = parts.groupBy("_read").agg(F.count(F.lit(1)).alias("n_parts"))
    votes = parts.join(index, "minimizer").groupBy("_read", "taxon").agg(F.count(F.lit(1)).alias("n"))
    by = votes.groupBy("_read").agg(F.collect_list(F.struct("taxon", "n")).alias("v"), F.sum("n").alias("n_hits"))

    def votes_where(fits) -> Column:
        return F.aggregate(F.filter("v", lambda h: fits(h["taxon"])), F.lit(0).cast("long"), lambda total, h: total + h["n"])

    scored = by.withColumn("s", F.transform("v", lambda t: F.struct(votes_where(lambda h: starts_path(h, t["taxon"])).alias("score"), t["taxon"].alias("taxon"))))
    top = F.array_max(F.transform("s", lambda x: x["score"]))
    scored = scored.withColumn("top", top).withColumn("best", F.transform(F.filter("s", lambda x: x["score"] == F.col("top")), lambda x: x["taxon"]))
    chosen = scored.withColumn("path", common_path(F.array_min("best"), F.array_max("best"))).join(size, "_read")
    # From the label up: the clade's votes only grow.
    held = F.transform(lineage(F.col("path")), lambda p: F.struct(p.alias("path"), votes_where(lambda h: starts_path(p, h)).alias("n")))
    kept = F.filter(held, lambda x: x["n"] >= F.lit(confidence) * F.col("n_parts"))
    label = chosen.withColumn("kept", F.try_element_at(kept, F.lit(-1)))
    found = label.select("_read", F.col("kept.path").alias("path"), F.col("kept.n").alias("clade"), "n_hits", "n_parts")
    every = reads.select(F.col(read).alias("_read")).distinct().join(size.withColumnRenamed("n_parts", "all_parts"), "_read", "left").join(found.drop("n_parts"), "_read", "left")
    none = F.array().cast("array<string>")
    return every.select(
        F.col("_read").alias(read),
        F.coalesce(F.element_at(F.when(F.size("path") > 0, F.col("path")), -1), F.lit(UNCLASSIFIED)).alias("label"),
        F.coalesce("path", none).alias("path"),
        F.when(F.col("path").isNull(), 0).otherwise(F.size("path")).alias("depth"),
        F.coalesce("n_hits", F.lit(0).cast("long")).alias("n_hits"),
        F.coalesce("all_parts", F.lit(0).cast("long")).alias("n_parts"),
        F.coalesce(F.round(F.col("clade") / F.col("all_parts"), 6), F.lit(0.0)).alias("support"),
    )


def taxon_report(classified: DataFrame) -> DataFrame:
    """(taxon, depth, n_clade, n_own, pct): reads at or below each taxon and on it, and the clade's share of all reads in percent.

    The unclassified reads are a row of depth 0.
    """
    path = F.when(F.col("depth") > 0, F.col("path")).otherwise(F.array(F.lit(UNCLASSIFIED)))
    own = classified.groupBy(path.alias("path"), (F.col("depth") > 0).alias("known")).agg(F.count(F.lit(1)).alias("n"))
    rows = own.select("known", "n", "path", F.explode(lineage(F.col("path"))).alias("taxon"))
    by = rows.groupBy("taxon", "known").agg(F.sum("n").alias("n_clade"), F.coalesce(F.sum(F.when(F.col("taxon") == F.col("path"), F.col("n"))), F.lit(0).cast("long")).alias("n_own"))
    total = classified.agg(F.count(F.lit(1)).alias("total"))  # one row
    return by.crossJoin(F.broadcast(total)).select(F.array_join("taxon", ";").alias("taxon"), F.when(F.col("known"), F.size("taxon")).otherwise(0).alias("depth"), "n_clade", "n_own", F.round(100.0 * F.col("n_clade") / F.col("total"), 6).alias("pct"))
