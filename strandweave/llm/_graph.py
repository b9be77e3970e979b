"""Shared-folder tables and connected components, by DataFrame operations only."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where it is unset, a local master gets a folder of our own (tests); a cluster
    gets an error, as its executors would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    of_context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if of_context.isDefined():
        return of_context.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "strandweave")


#: Seconds between two requests to free what finished steps have left behind.
SWEEP_S = 4.0
_swept = [0.0]


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it from there.

    Lineage ends, so a lost executor costs no recomputation from the start, and
    columns are stored compressed.  The table goes when the application ends, or
    with `forget`.  Shuffle files are freed once the driver has collected the
    plans that made them, which it is asked to do now and then.
    """
    return cut_in_turn([df])


def cut_in_turn(parts: Iterable[DataFrame]) -> DataFrame:
    """Like `cut`, of the union of the parts: one is written after the other, so that the disk holds the shuffle files of one at a time."""
    path = None
    for df in parts:
        if path is None:
            spark, schema = df.sparkSession, df.schema
            path = f"{shared_folder(spark)}/strandweave-{uuid.uuid4().hex}"
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
        df.write.mode("append").parquet(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
        del df
        if time.monotonic() - _swept[0] > SWEEP_S:
            spark._jvm.System.gc()
            _swept[0] = time.monotonic()
    out = spark.read.schema(schema).parquet(path)
    out._strandweave_table = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that `cut` has written, when nothing that is still to run reads them."""
    for df in tables:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df._strandweave_table)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, label): label is the smallest node id of the component.

    Alternating large-star and small-star steps; the number of rounds is
    logarithmic in the longest path, each round is two shuffled aggregations and
    no round sees more rows than there are edges.  Nodes without an edge are not
    in the result.  Edges with a null end are ignored; loops and repeats do no harm.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull()).where("u > v").distinct()
    e = cut(e)
    before = None
    while True:
        # Large star: every larger neighbour of u is hung on u's smallest neighbour or u itself.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # Small star: the smaller neighbours of u and u itself are hung on the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        last, e = e, cut(small)
        forget(last)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


#: Ids that are broadcast to pick rows at most; more are joined by a shuffle.
PICKED = 1 << 18


def few(ids: DataFrame) -> bool:
    """Whether ids are few enough for a broadcast: counted, not guessed."""
    return ids.limit(PICKED + 1).count() <= PICKED
