"""Assembly metrics: lengths, GC, N50 and its kin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequence import gc_bases


def length_metrics(contigs: DataFrame, length: str = "length", by: list[str] | None = None) -> DataFrame:
    """Per group: total_length, num_contigs, largest_contig, n50, n90, l50, l90.

    Equal lengths are counted together first, so the running sums go over
    distinct lengths and not over contigs.
    """
    by = by or []
    counts = contigs.groupBy(*by, F.col(length).cast("long").alias("len")).agg(F.count(F.lit(1)).alias("k"))
    every = Window.partitionBy(*by)
    down = every.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumns({"upto": F.sum(F.col("len") * F.col("k")).over(down), "seen": F.sum("k").over(down), "total": F.sum(F.col("len") * F.col("k")).over(every)})
    before = F.col("upto") - F.col("len") * F.col("k")

    def rank(share: float):
        # Contigs of this length that the threshold still needs, on top of all longer ones.
        need = F.ceil((share * F.col("total") - before) / F.greatest("len", F.lit(1)))
        return F.min(F.when(F.col("upto") >= share * F.col("total"), F.col("seen") - F.col("k") + F.greatest(need, F.lit(1)))).cast("long")

    def reached(share: float):
        return F.max(F.when(F.col("upto") >= share * F.col("total"), F.col("len")))

    return run.groupBy(*by).agg(
        F.max("total").alias("total_length"),
        F.sum("k").alias("num_contigs"),
        F.max("len").alias("largest_contig"),
        reached(0.5).alias("n50"),
        reached(0.9).alias("n90"),
        rank(0.5).alias("l50"),
        rank(0.9).alias("l90"),
    )


def assembly_metrics(contigs: DataFrame, seq: str = "seq", by: list[str] | None = None) -> DataFrame:
    """length_metrics and gc_content in percent."""
    by = by or []
    sized = contigs.select(*by, F.length(seq).cast("long").alias("length"), gc_bases(F.col(seq)).alias("gc"))
    gc = sized.groupBy(*by).agg(F.round(100.0 * F.try_divide(F.sum("gc"), F.sum("length")), 6).alias("gc_content"))
    lengths = length_metrics(sized, "length", by)
    return lengths.join(gc, by) if by else lengths.crossJoin(F.broadcast(gc))  # one row each


def contig_report(contigs: DataFrame, seq: str = "seq", least: int = 500, steps: tuple[int, ...] = (0, 500, 1000)) -> DataFrame:
    """Reference-free quality report: (metric, value); counts and lengths from each step on, the rest on contigs of `least` or more."""
    sized = contigs.select(F.length(seq).cast("long").alias("length"), gc_bases(F.col(seq)).alias("gc"), F.length(F.regexp_replace(seq, "[^N]", "")).alias("ns"))
    cells = []
    for s in steps:
        cells += [F.count_if(F.col("length") >= s).cast("double").alias(f"contigs (>= {s})"), F.coalesce(F.sum(F.when(F.col("length") >= s, F.col("length"))), F.lit(0)).cast("double").alias(f"total length (>= {s})")]
    kept = sized.where(F.col("length") >= least)
    a = sized.agg(*cells)
    b = kept.agg(F.round(100.0 * F.try_divide(F.sum("gc"), F.sum("length")), 6).alias("GC (%)"), F.round(100000.0 * F.try_divide(F.sum("ns"), F.sum("length")), 6).alias("N's per 100 kbp"))
    c = length_metrics(kept).select(*[F.col(x).cast("double").alias(x.upper() if x[1:] in ("50", "90") else x) for x in ("num_contigs", "largest_contig", "n50", "n90", "l50", "l90")])
    wide = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in wide.columns])).alias("x")).select("x.metric", "x.value")


def length_classes(contigs: DataFrame, length: str = "length", large: int = 10_000, huge: int = 1_000_000) -> DataFrame:
    """Contigs and bases in all, beyond `large` and beyond `huge`, the two longest, and the N50 of the large ones."""
    base = contigs.select(F.col(length).cast("long").alias("length"))
    both = base.agg(F.count(F.lit(1)).alias("contigs"), F.sum("length").alias("total_length"), F.count_if(F.col("length") > large).alias("contigs_large"), F.coalesce(F.sum(F.when(F.col("length") > large, F.col("length"))), F.lit(0)).cast("long").alias("length_large"), F.count_if(F.col("length") > huge).alias("contigs_huge"), F.max("length").alias("longest"))
    second = base.orderBy(F.desc("length")).limit(2).agg(F.min("length").alias("second_longest"))
    n50 = length_metrics(base.where(F.col("length") > large)).select(F.col("n50").alias("n50_large"))
    return both.crossJoin(F.broadcast(second)).join(F.broadcast(n50), F.lit(True), "left")  # one row each
