"""k-mers as rows, indexes as (kmer, organism, cnt) tables, and statistics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequence import CHUNK, words

#: Chunks in a coarse piece.
COARSE = 64


def chunks(df: DataFrame, seq: str = "seq", size: int = CHUNK, overlap: int = 0, start: str = "chunk_start") -> DataFrame:
    """Cut long sequences: pieces of `size` plus `overlap` further bases, with their 0-based start; empty ones vanish.

    Cutting goes in two steps, as substring() walks a string from its start.
    """
    big = COARSE * size
    none = F.array().cast("array<int>")
    outer = F.when(F.length(seq) > 0, F.sequence(F.lit(0), F.length(seq) - 1, F.lit(big))).otherwise(none)
    out = df.withColumn("_outer", F.explode(outer)).withColumn(seq, F.expr(f"substring({seq}, _outer + 1, {big + overlap})"))
    inner = F.sequence(F.lit(0), F.least(F.length(seq), F.lit(big)) - 1, F.lit(size))
    out = out.withColumn("_inner", F.explode(inner)).withColumn(seq, F.expr(f"substring({seq}, _inner + 1, {size + overlap})"))
    return out.withColumn(start, F.col("_outer") + F.col("_inner")).drop("_outer", "_inner")


def kmers(df: DataFrame, k: int, seq: str = "seq", skip_n: bool = True) -> DataFrame:
    """One row per overlapping k-mer: `kmer` and its 0-based `pos`; those with an N are left out unless skip_n is off."""
    # A chunk overlaps the next one by k - 1 bases, so a start belongs to the chunk that it lies in.
    cut = chunks(df, seq, overlap=k - 1, start="_chunk")
    out = cut.select(*(c for c in cut.columns if c != seq), F.posexplode(words(F.col(seq), k)).alias("_i", "kmer"))
    out = out.withColumn("pos", (F.col("_chunk") + F.col("_i")).cast("int")).drop("_chunk", "_i")
    return out.where(~F.col("kmer").contains("N")) if skip_n else out


def kmers_of_lengths(df: DataFrame, lengths, seq: str = "seq") -> DataFrame:
    """Input columns and `kmer` for every overlapping piece of each of the given lengths, with any letters."""
    lengths = [int(k) for k in lengths]
    if not lengths:
        return df.drop(seq).withColumn("kmer", F.lit("")).limit(0)
    cut = chunks(df, seq, overlap=max(lengths) - 1, start="_chunk").withColumn("_k", F.explode(F.array(*map(F.lit, lengths))))
    at = F.when(F.length(seq) >= F.col("_k"), F.sequence(F.lit(1), F.least(F.length(seq) - F.col("_k") + 1, F.lit(CHUNK)))).otherwise(F.array().cast("array<int>"))
    return cut.withColumn("_i", F.explode(at)).withColumn("kmer", F.expr(f"substring({seq}, _i, _k)")).drop(seq, "_chunk", "_i", "_k")


def kmer_index(genomes: DataFrame, k: int, organism: str = "organism", seq: str = "seq") -> DataFrame:
    """(kmer, organism, cnt); counted map-side before the one shuffle."""
    return kmers(genomes.select(organism, seq), k, seq).groupBy("kmer", organism).agg(F.count(F.lit(1)).alias("cnt"))


def genome_stats(genomes: DataFrame, k: int, organism: str = "organism", seq: str = "seq") -> DataFrame:
    """Per organism: bases, k-mers and distinct k-mers."""
    size = genomes.groupBy(organism).agg(F.sum(F.length(seq)).alias("bases"))
    index = kmer_index(genomes, k, organism, seq).groupBy(organism).agg(F.sum("cnt").alias("total_kmers"), F.count(F.lit(1)).alias("distinct_kmers"))
    zero = F.lit(0).cast("long")
    return size.join(index, organism, "left").select(organism, F.coalesce("bases", zero).alias("bases"), F.coalesce("total_kmers", zero).alias("total_kmers"), F.coalesce("distinct_kmers", zero).alias("distinct_kmers"))


def sharing(index: DataFrame) -> DataFrame:
    """How many k-mers occur in 1, 2, ... organisms, and their share of all distinct k-mers in percent."""
    by = index.groupBy("kmer").agg(F.countDistinct("organism").alias("n_organisms")).groupBy("n_organisms").agg(F.count(F.lit(1)).alias("n_kmers"))
    return by.withColumn("pct", F.round(100.0 * F.col("n_kmers") / F.sum("n_kmers").over(Window.partitionBy()), 6))


def spectrum(counts: DataFrame, cnt: str = "cnt") -> DataFrame:
    """Per frequency: distinct k-mers, cumulative fractions of the distinct and of all k-mers, and presence per million."""
    by = counts.groupBy(F.col(cnt).alias("frequency")).agg(F.count(F.lit(1)).alias("n_distinct"))
    upto = Window.orderBy("frequency").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    weight = F.col("frequency") * F.col("n_distinct")
    total = F.sum(weight).over(every)
    return by.select(
        "frequency",
        "n_distinct",
        F.round(F.sum("n_distinct").over(upto) / F.sum("n_distinct").over(every), 6).alias("cum_distinct"),
        F.round(F.sum(weight).over(upto) / total, 6).alias("cum_total"),
        F.round(F.col("frequency") / total * 1e6, 6).alias("presence"),
    )


def spectrum_summary(counts: DataFrame, k: int, cnt: str = "cnt") -> DataFrame:
    """Unique, distinct, present and missing k-mers (missing: of all 4**k)."""
    return counts.agg(F.count_if(F.col(cnt) == 1).alias("n_unique"), F.count(F.lit(1)).alias("n_distinct"), F.coalesce(F.sum(cnt), F.lit(0)).cast("long").alias("n_present")).withColumn("n_missing", (F.lit(4**k).cast("decimal(38,0)") - F.col("n_distinct")).cast("decimal(38,0)").cast("string"))


def quality_value(assembly: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """Consensus quality from k-mers of the assembly that the reads support: shared, total, error rate and QV.

    error = 1 - (shared / total) ** (1 / k); QV = -10 log10(error), null where every k-mer is supported.
    """
    have = assembly.groupBy("kmer").agg(F.sum("cnt").alias("cnt"))
    known = reads.select("kmer").distinct().withColumn("known", F.lit(1))
    got = have.join(known, "kmer", "left").agg(F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("cnt"))), F.lit(0)).cast("long").alias("shared"), F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("total"))
    error = 1.0 - F.pow(F.try_divide(F.col("shared").cast("double"), F.col("total").cast("double")), F.lit(1.0 / k))
    return got.withColumn("error_rate", F.round(error, 9)).withColumn("qv", F.when(error > 0, F.round(-10.0 * F.log10(error), 6)))
