"""Classification of a stream of reads against a static index: a stream-static join without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import windows
from ..operators.classify import UNCLASSIFIED


def read_stream(spark: SparkSession, folder: str, schema: str = "read_id long, seq string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def classify_batch(reads: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(read_id, label) of one micro-batch; used by `start`."""
    words = F.transform(windows(F.col("seq"), k), lambda i: F.substring(F.col("seq"), i, F.lit(k)))
    parts = reads.select("read_id", F.explode_outer(words).alias("kmer"))
    hits = parts.join(index.select("kmer", "organism").distinct(), "kmer", "left").groupBy("read_id", "organism").agg(F.count("organism").alias("hits"))
    best = hits.groupBy("read_id").agg(F.min(F.struct((-F.col("hits")).alias("h"), "organism")).alias("b"))
    return best.select("read_id", F.coalesce("b.organism", F.lit(UNCLASSIFIED)).alias("label"))


def start(reads: DataFrame, index: DataFrame, k: int, out: str, checkpoint: str):
    """A query that labels every micro-batch and appends it to `out`; a batch that is replayed overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        classify_batch(batch, index, k).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
