"""Abundance profiles and matrix analytics over (sample, taxon, pct) rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .overlap import ward_linkage

# Rank letters of classification reports that are kept.
RANKS = ("G", "F", "O", "C", "P", "D", "S")


def report_taxa(rows: DataFrame, least: float = 0.01, rank: str | None = None, sample: str = "sample") -> DataFrame:
    """(sample, taxon, pct) from report rows (sample, line_no, pct, rank, taxid, name): the last row of a taxon counts.

    Numbers that do not parse are skipped, as are ranks outside RANKS.  The
    row of taxid 0 and names `unclassified` become `Unclassified`.
    """
    x = rows.withColumn("pct", F.try_cast("pct", "double") if hasattr(F, "try_cast") else F.expr("try_cast(pct AS double)")).withColumn("name", F.trim("name"))
    x = x.where(F.col("pct") >= least)
    if rank is not None:
        x = x.where(F.col("rank") == rank)
    taxon = F.when((F.col("taxid") == "0") | (F.lower("name") == "unclassified"), F.lit("Unclassified")).when(F.col("rank").isin(*RANKS), F.concat("rank", F.lit("_"), "name"))
    return x.withColumn("taxon", taxon).where("taxon is not null").groupBy(sample, "taxon").agg(F.max_by("pct", "line_no").alias("pct"))


def profile_matrix(taxa: DataFrame, sample: str = "sample") -> DataFrame:
    """Every sample with every taxon, 0 where it is absent: the long form of the matrix."""
    names = taxa.select("taxon").distinct()
    full = taxa.select(sample).distinct().crossJoin(names)  # the matrix itself: samples x taxa cells
    return full.join(taxa, [sample, "taxon"], "left").select(sample, "taxon", F.coalesce("pct", F.lit(0.0)).alias("pct"))


def wide_matrix(taxa: DataFrame, sample: str = "sample") -> DataFrame:
    """One row per sample and one column per taxon."""
    return taxa.groupBy(sample).pivot("taxon").agg(F.first("pct")).na.fill(0.0)


def sample_group(sample: Column, prefixes: dict[str, str], other: str = "Unknown") -> Column:
    """Group of a sample by the first prefix that fits."""
    out = None
    for p, g in prefixes.items():
        out = F.when(sample.startswith(p), F.lit(g)) if out is None else out.when(sample.startswith(p), F.lit(g))
    return F.lit(other) if out is None else out.otherwise(F.lit(other))


def standardize(matrix: DataFrame, value: str = "pct", column: str = "taxon") -> DataFrame:
    """z: the value less its column's mean over the population deviation; 0 in constant columns."""
    stats = matrix.groupBy(column).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return matrix.join(stats, column).withColumn("z", F.when(F.col("_s") > 1e-12, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))).drop("_m", "_s")


def top_taxa(matrix: DataFrame, n: int = 20, sample: str = "sample") -> DataFrame:
    """(sample, taxon, pct, scaled) of the n taxa with the largest mean, scaled per taxon to 0..1."""
    top = matrix.groupBy("taxon").agg(F.avg("pct").alias("mean")).orderBy(F.desc(F.round("mean", 9)), "taxon").limit(n)
    w = Window.partitionBy("taxon")
    lo, hi = F.min("pct").over(w), F.max("pct").over(w)
    return matrix.join(F.broadcast(top.select("taxon")), "taxon").withColumn("scaled", F.coalesce(F.try_divide(F.col("pct") - lo, hi - lo), F.lit(0.0)))


def distances(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(a, b, distance) of all pairs a < b: the condensed Euclidean distance matrix, quadratic by definition."""
    x = vectors.select(F.col(key).alias("a"), F.col(vec).alias("va"))
    y = vectors.select(F.col(key).alias("b"), F.col(vec).alias("vb"))
    square = F.aggregate(F.zip_with("va", "vb", lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", F.sqrt(square).alias("distance"))


def pca(vectors: DataFrame, k: int = 2, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(key, pc array): principal components of standardised columns; each loading's largest entry is positive."""
    import numpy as np

    rows = vectors.select(F.col(key), F.transform(vec, lambda v: v.cast("double")).alias("v"))
    n, size = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    flat = rows.select(key, F.posexplode("v").alias("i", "v"))
    stats = flat.groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()  # one row per column
    m, s = np.array([r.m for r in stats]), np.array([r.s if r.s and r.s > 1e-12 else 1.0 for r in stats])

    def gram(batches):
        total = np.zeros((size, size))
        for pdf in batches:
            if len(pdf):
                z = (np.array(pdf["v"].tolist()) - m) / s
                total += z.T @ z
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "g": total.ravel()})

    cells = rows.select("v").mapInPandas(gram, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect()  # columns x columns
    cov = np.zeros((size, size))
    for r in cells:
        cov[r.i, r.j] = r.g / max(1, n)
    value, axes = np.linalg.eigh(cov)
    axes = axes[:, np.argsort(-value)[:k]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    share = np.sort(value)[::-1][:k] / max(value.sum(), 1e-300)
    parts = [F.aggregate(F.zip_with("v", F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(c)).alias("c")) for a, b, c in zip(m, s, axes[:, q])]), lambda x, t: (x - t["a"]) / t["b"] * t["c"]), F.lit(0.0), lambda p, x: p + x).alias(f"pc{q + 1}") for q in range(axes.shape[1])]
    return rows.select(key, *parts, *[F.lit(float(x)).alias(f"explained{q + 1}") for q, x in enumerate(share)])


def group_separation(scores: DataFrame, group: str = "sample_group", clear: float = 2.0, strong: float = 0.25) -> DataFrame:
    """(group, n, mean_pc1, mean_pc2, clear, strong): clear if any two groups' means are more than `clear` apart on an axis."""
    by = scores.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("pc1").alias("mean_pc1"), F.avg("pc2").alias("mean_pc2"), F.max("explained1").alias("e1"))
    every = Window.partitionBy()
    far = (F.max("mean_pc1").over(every) - F.min("mean_pc1").over(every) > clear) | (F.max("mean_pc2").over(every) - F.min("mean_pc2").over(every) > clear)
    return by.select(group, "n", "mean_pc1", "mean_pc2", (far & (F.count(F.lit(1)).over(every) > 1)).alias("clear"), (F.col("e1") > strong).alias("strong"))


def ward(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(left, right, height, size): Ward merges of a small set of samples; leaves are numbered in key order.

    Agglomeration looks at all pairs at once, so the samples form one group: it
    is meant for matrices of samples, not for tables of reads.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return ward_linkage(pdf.sort_values("k", kind="stable"))

    rows = vectors.select(F.col(key).alias("k"), F.transform(vec, lambda v: v.cast("double")).alias("vec"), F.lit(0).alias("one"))
    return rows.groupBy("one").applyInPandas(merge, "left long, right long, height double, size long")


def flat_cut(merges: DataFrame, share: float = 0.7) -> DataFrame:
    """Merges below `share` of the greatest height: those inside a flat cluster."""
    top = merges.agg(F.max("height").alias("top"))
    return merges.crossJoin(F.broadcast(top)).where(F.col("height") < share * F.col("top")).drop("top")  # one row


def kraken_counts(lines: DataFrame, line: str = "line") -> DataFrame:
    """Classified (first field C) and unclassified (U) lines of a per-read output, with percentages of all lines."""
    first = F.split(line, "\t")[0]
    out = lines.agg(F.count(F.lit(1)).alias("total"), F.count_if(first == "C").alias("classified"), F.count_if(first == "U").alias("unclassified"))
    return out.withColumns({"classified_pct": F.coalesce(F.round(100.0 * F.try_divide("classified", "total"), 6), F.lit(0.0)), "unclassified_pct": F.coalesce(F.round(100.0 * F.try_divide("unclassified", "total"), 6), F.lit(0.0))})


def species_percentages(rows: DataFrame, species: dict[str, str], sample: str = "sample") -> DataFrame:
    """(sample, label, pct): the percentage of the last report row whose name contains a label's text; 0 where none does."""
    spark = rows.sparkSession
    names = spark.createDataFrame(sorted(species.items()), "needle string, label string")
    x = rows.withColumn("pct", F.expr("try_cast(pct AS double)")).where("pct is not null")
    hit = x.join(F.broadcast(names), F.lower("name").contains(F.lower("needle"))).groupBy(sample, "label").agg(F.max_by("pct", "line_no").alias("pct"))
    every = rows.select(sample).distinct().crossJoin(F.broadcast(names.select("label").distinct()))  # labels are a parameter
    return every.join(hit, [sample, "label"], "left").select(sample, "label", F.coalesce("pct", F.lit(0.0)).alias("pct"))


def require_samples(rows: DataFrame, sample: str = "sample", least: int = 2) -> DataFrame:
    """rows unchanged; fewer than `least` samples raise an error, as no comparison is then possible."""
    n = rows.select(sample).distinct().limit(least).count()
    if n < least:
        raise ValueError(f"{n} samples; at least {least} are needed")
    return rows
