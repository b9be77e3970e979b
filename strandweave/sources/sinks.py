"""Sinks: frames of text lines or tables ready to write, and writers for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fasta_lines(contigs: DataFrame, key: str, seq: str = "seq", width: int = 60) -> DataFrame:
    """(line): one FASTA record per row, wrapped at `width`."""
    body = F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    return contigs.select(F.concat(F.lit(">"), F.col(key).cast("string"), F.lit(" length="), F.length(seq).cast("string"), F.lit("\n"), body).alias("line"))


def summary_wide(labelled: DataFrame, datasets: list[str]) -> DataFrame:
    """(label, one column of percentages for each dataset), two decimals, 0 where a label is absent."""
    n = labelled.groupBy("dataset").agg(F.count(F.lit(1)).alias("total"))
    by = labelled.groupBy("label", "dataset").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(n), "dataset")  # one row per dataset
    return by.withColumn("pct", F.round(100.0 * F.col("n") / F.col("total"), 2)).groupBy("label").pivot("dataset", datasets).agg(F.first("pct")).na.fill(0.0)


def write_matches(matches: DataFrame, path: str) -> None:
    """TSV with header: Chromosome, Start, End and, where there are any, Mismatches."""
    cols = [F.col("seq_id").alias("Chromosome"), F.col("start").alias("Start"), F.col("end").alias("End")]
    cols += [F.col("mismatches").alias("Mismatches")] if "mismatches" in matches.columns else []
    matches.select(*cols).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_index(index: DataFrame, path: str) -> None:
    """A k-mer index as Parquet, clustered by k-mer so that look-ups read few row groups."""
    index.repartitionByRange("kmer").sortWithinPartitions("kmer").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, organism, cnt) of a stored index; filters on kmer reach its row groups."""
    return spark.read.schema("kmer string, organism string, cnt long").parquet(path)


def _numbered(parts: list[DataFrame]) -> DataFrame:
    """(line_no, line) of frames (rank, line) one after the other; each frame's lines go by rank, then text."""
    out = None
    for i, p in enumerate(parts):
        p = p.select(F.lit(i).alias("part"), F.col("rank").cast("double").alias("rank"), "line")
        out = p if out is None else out.unionByName(p)
    return out.select(F.row_number().over(Window.orderBy("part", "rank", "line")).cast("long").alias("line_no"), "line")  # a report's few lines


def _constant(spark: SparkSession, *lines: str) -> DataFrame:
    return spark.createDataFrame([(float(i), x) for i, x in enumerate(lines)], "rank double, line string")


def classification_lines(labelled: DataFrame, organisms: DataFrame) -> DataFrame:
    """(line_no, line): organisms, reads of each, and how many reads are classified, ambiguous and unclassified."""
    spark, text = labelled.sparkSession, lambda c: F.col(c).cast("string")
    names = organisms.select("organism").distinct()
    n = labelled.groupBy(F.col("label").alias("organism")).agg(F.count(F.lit(1)).alias("n"))
    each = names.join(n, "organism", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    zero = F.lit(0.0).alias("rank")
    total = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(zero, F.concat(F.lit("classified reads: "), text("n")).alias("line"))
    other = [labelled.agg(F.count_if(F.col("label") == x).alias("n")).select(zero, F.concat(F.lit(f"{x} reads: "), text("n")).alias("line")) for x in ("ambiguous", "unclassified")]
    listed = names.select(zero, F.concat(F.lit("organism: "), "organism").alias("line"))
    counts = each.select(zero, F.concat(F.lit("reads of "), "organism", F.lit(": "), text("n")).alias("line"))
    return _numbered([_constant(spark, "classification"), listed, counts, total, *other])


def match_lines(buckets: DataFrame, organisms: DataFrame, seconds: float | None = None, megabytes: float | None = None) -> DataFrame:
    """(line_no, line): time and memory if given, reads with one, several or no match, and reads per organism, most first.

    `buckets` has (bucket, n, pct), `organisms` (organism, n_reads).
    """
    spark = buckets.sparkSession
    share = lambda n, t: F.concat(F.col(n).cast("string"), F.lit(" ("), F.format_number(F.coalesce(F.try_divide(100.0 * F.col(n), F.col(t)), F.lit(0.0)), 2), F.lit(" %)"))
    total = buckets.agg(F.sum("n").alias("t"))
    head = ["matches", *[f"{name}: {x:.2f}" for name, x in (("seconds", seconds), ("megabytes", megabytes)) if x is not None]]
    place = F.when(F.col("bucket") == "unique", 0).when(F.col("bucket") == "multiple", 1).otherwise(2)
    by = buckets.crossJoin(F.broadcast(total)).select(place.alias("rank"), F.concat(F.lit("reads with "), F.col("bucket"), F.lit(" match: "), share("n", "t")).alias("line"))  # one row
    per = organisms.crossJoin(F.broadcast(total)).select((-F.col("n_reads")).alias("rank"), F.concat("organism", F.lit(": "), share("n_reads", "t")).alias("line"))
    return _numbered([_constant(spark, *head), total.select(F.lit(0).alias("rank"), F.concat(F.lit("reads: "), F.col("t").cast("string")).alias("line")), by, per])


def metrics_lines(metrics: DataFrame) -> DataFrame:
    """(line_no, line): one `name: value` line for each column of a row of assembly metrics."""
    cells = [F.struct(F.lit(float(i)).alias("rank"), F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))).alias("line")) for i, c in enumerate(metrics.columns)]
    return _numbered([_constant(metrics.sparkSession, "assembly metrics"), metrics.select(F.explode(F.array(*cells)).alias("x")).select("x.*")])


def summary_lines(profile: DataFrame, groups: DataFrame, explained: DataFrame, separation: DataFrame) -> DataFrame:
    """(line_no, line) of a Markdown summary: samples and groups, taxa, variance of the first two components, separation.

    `profile` has (sample, taxon, pct), `groups` (sample, sample_group),
    `explained` (explained1, explained2), `separation` (sample_group, clear, strong).
    """
    spark, zero = profile.sparkSession, F.lit(0).alias("rank")
    say = lambda df, *parts: df.select(zero, F.concat(*parts).alias("line"))
    size = profile.agg(F.countDistinct("sample").alias("s"), F.countDistinct("taxon").alias("t"))
    each = groups.groupBy("sample_group").agg(F.countDistinct("sample").alias("n"))
    pct = lambda c: F.format_number(100.0 * F.col(c), 2)
    one = explained.select("explained1", "explained2").limit(1)
    parts = separation.agg(F.max(F.col("clear")).alias("c"), F.max(F.col("strong")).alias("s"))
    return _numbered(
        [
            _constant(spark, "# Summary", "## Samples"),
            say(size, F.lit("samples: "), F.col("s").cast("string")),
            say(each, F.lit("- **"), F.col("sample_group"), F.lit("**: "), F.col("n").cast("string")),
            say(size, F.lit("taxa: "), F.col("t").cast("string")),
            _constant(spark, "## Components"),
            say(one, F.lit("PC1 explains "), pct("explained1"), F.lit(" %, PC2 "), pct("explained2"), F.lit(" % of the variance")),
            say(parts, F.when(F.col("c"), F.lit("groups are clearly apart")).otherwise(F.lit("groups are not clearly apart")), F.when(F.col("s"), F.lit("; the first component is strong")).otherwise(F.lit(""))),
        ]
    )


def sample_types(spark: SparkSession, types: dict[str, list[str]]) -> DataFrame:
    """(sample_id, type) of the samples listed for each type, ready for write_csv."""
    return spark.createDataFrame([(s, t) for t, names in types.items() for s in names], "sample_id string, type string")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def without_comments(lines: DataFrame, line: str = "value") -> DataFrame:
    """Report lines less those that start with #."""
    return lines.where(~F.col(line).startswith("#"))


def combine(*frames: DataFrame) -> DataFrame:
    """One frame after the other, columns by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
