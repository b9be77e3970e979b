"""Overlap, layout and consensus of reads."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.sequence import mismatches
from .components import components, stored
from .metrics import assembly_metrics
from .minimizers import sketch
from .rolling import Texts, asked, asked_bits, text_pieces


def contained(reads: DataFrame, seed: int = 16, read: str = "read_id", seq: str = "seq") -> DataFrame:
    """(read) of reads that are a strictly shorter part of another read.

    A read's first window has `seed` bytes, or twice as many as often as they fit (shorter reads: all of theirs).
    Windows of the reads are hashed where the reads are, and those that begin none go by a filter, so what is shuffled
    are hits and not all windows.  At a hit, parts of every length that a read with this first window has are
    compared by their digests (sha256); only sequences with a hit travel, once each.
    Of short reads each task hands over those that it finds, once.  Empty reads lie in any other that is not empty.
    """
    ids = reads.schema[read].dataType
    some = reads.where(F.length(seq) > 0).select(F.col(read).alias("a"), F.col(seq).alias("seq"))
    own = stored(_first_windows(some, seed, ids))
    starts = own.select("w", "first").distinct()
    sizes = sorted(r[0] for r in own.select("w").distinct().collect())
    hits = stored(_hits(some, sizes, seed, asked_bits(starts, "first", starts.count()), ids))
    # Lengths of the reads that have the same first window: few, also where many reads are alike.
    lengths = own.where(F.col("w") >= seed).groupBy("w", "first").agg(F.collect_set("la").alias("las"))
    fit = F.filter("las", lambda n: (n < F.col("lb")) & (F.col("pos") + n <= F.col("lb")))
    found = hits.where("piece is null").join(lengths, ["w", "first"]).select("b", "pos", fit.alias("las")).where(F.size("las") > 0)
    both = found.join(some.select(F.col("a").alias("b"), F.encode("seq", "UTF-8").alias("sb")), "b").select("pos", "sb", F.explode("las").alias("la"))
    inside = both.select(F.unhex(F.sha2(F.substring("sb", F.col("pos") + 1, F.col("la")), 256)).alias("digest")).distinct()
    long = own.where(F.col("w") >= seed).join(inside, "digest", "left_semi").select("a")
    tiny = own.where(F.col("w") < seed).join(hits.select("piece").where("piece is not null").distinct(), "piece", "left_semi").select("a")
    empty = reads.where(F.length(seq) == 0).select(F.col(read).alias("a"))
    if not sizes:
        empty = empty.limit(0)
    return long.distinct().unionByName(tiny.distinct()).unionByName(empty).withColumnRenamed("a", read)


def _first_windows(some: DataFrame, seed: int, ids: T.DataType) -> DataFrame:
    """(a, la, w, first, digest, piece) of reads (a, seq): bytes, bytes and hash of the first window, sha256, and the read itself if shorter than `seed`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, "seq"):
            texts = Texts(batch.column("seq"))
            n = texts.size
            w = np.where(n < seed, n, seed << np.log2(np.maximum(n // seed, 1)).astype(np.int64))
            raw = [texts.bytes[s:e].tobytes() for s, e in zip(texts.start.tolist(), texts.end.tolist(), strict=True)]
            digest = pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary())
            piece = pa.array([x if len(x) < seed else None for x in raw], pa.binary())
            first = texts.hashes(texts.start, w).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("a"), pa.array(n.astype(np.int32)), pa.array(w.astype(np.int32)), pa.array(first), digest, piece], names=schema.names)

    schema = T.StructType().add("a", ids).add("la", "integer").add("w", "integer").add("first", "long").add("digest", "binary").add("piece", "binary")
    return some.mapInArrow(run, schema)


def _hits(some: DataFrame, sizes: list[int], seed: int, bits: np.ndarray, ids: T.DataType) -> DataFrame:
    """(b, pos, lb, w, first) of windows that begin a read, by the filter `bits`; or `piece`, a window of fewer than `seed` bytes that is one, once a piece."""
    shared = some.sparkSession.sparkContext.broadcast(bits)
    schema = T.StructType().add("b", ids).add("pos", "integer").add("lb", "integer").add("w", "integer").add("first", "long").add("piece", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, "seq"):
            texts, key = Texts(batch.column("seq")), batch.column("a")
            for w in sizes:
                row, start = texts.windows(w)
                longer = texts.size[row] > w  # a read that is as long as the window is the window
                row, start = row[longer], start[longer]
                h = texts.hashes(start, w)
                at = asked(shared.value, h)
                if w < seed:
                    at = at[np.unique(h[at], return_index=True)[1]]
                row, start, h = row[at], start[at], h[at]
                none = w < seed
                piece = pa.array([texts.bytes[s : s + w].tobytes() if none else None for s in start.tolist()], pa.binary())
                columns = [key.take(pa.array(row)), pa.array((start - texts.start[row]).astype(np.int32)), pa.array(texts.size[row].astype(np.int32)), pa.array(np.full(len(row), w, np.int32)), pa.array(h.view(np.int64)), piece]
                if len(row):
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return some.mapInArrow(run, schema)


def candidate_pairs(sketches: DataFrame, inside: DataFrame, least: float = 0.1, read: str = "read_id") -> DataFrame:
    """Ordered (src, dst) of reads that are in no other and whose sketches are similar enough; a join on sketch hashes."""
    from .minimizers import sketch_jaccard

    free = sketches.join(inside.select(read), read, "left_anti")
    near = sketch_jaccard(free, read).where(F.col("jaccard") >= least).select("a", "b")
    return near.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(near.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def best_overlaps(pairs: DataFrame, reads: DataFrame, least: int = 20, read: str = "read_id", seq: str = "seq") -> DataFrame:
    """(src, dst, overlap_len, identity): the suffix of src that fits the prefix of dst best; ties go to the shorter."""
    s = reads.select(F.col(read).alias("src"), F.col(seq).alias("s1"))
    d = reads.select(F.col(read).alias("dst"), F.col(seq).alias("s2"))
    both = pairs.join(s, "src").join(d, "dst").where((F.length("s1") >= least) & (F.length("s2") >= least))
    lengths = F.sequence(F.lit(least), F.least(F.length("s1"), F.length("s2")))
    same = F.transform(lengths, lambda n: F.struct(((mismatches(F.right("s1", n), F.substring(F.col("s2"), F.lit(1), n))) / n).alias("miss"), n.alias("n")))
    best = both.withColumn("best", F.array_min(same))
    return best.select("src", "dst", F.col("best.n").alias("overlap_len"), (1.0 - F.col("best.miss")).alias("identity"))


def overlap_edges(overlaps: DataFrame, identity: float = 0.9) -> DataFrame:
    """Accepted overlaps with their weight: length times identity."""
    good = overlaps.where(F.col("identity") >= identity)
    return good.select("src", "dst", "overlap_len", F.round("identity", 6).alias("identity"), F.round(F.col("overlap_len") * F.col("identity"), 6).alias("weight"))


def overlap_stats(edges: DataFrame) -> DataFrame:
    """Reads with an outgoing edge, and edges."""
    return edges.agg(F.countDistinct("src").alias("n_nodes"), F.count(F.lit(1)).alias("n_edges"))


def greedy_paths(edges: DataFrame) -> DataFrame:
    """(path, ord, read_id): walks along the heaviest edges to reads not yet used, of two reads or more.

    Starts are reads without an incoming edge, or, where a component has none,
    those with one at most, by id; each step takes the heaviest edge, ties to the
    smaller id.  `path` is the id of the first read; ids keep their type.  The
    walk is sequential, so each weak component is one group.
    """
    label = components(edges.select("src", "dst")).select(F.col("node").alias("src"), F.col("label").alias("component"))
    own = edges.select("src", "dst", "weight").join(label, "src")
    ids = edges.schema["src"].dataType
    schema = T.StructType([T.StructField("path", ids), T.StructField("ord", T.LongType()), T.StructField("read_id", ids)])

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        targets = part.sort_values(["weight", "dst"], ascending=[False, True]).groupby("src")["dst"].agg(list).to_dict()
        incoming = part["dst"].value_counts().to_dict()
        free = dict.fromkeys(sorted({*part["src"], *part["dst"]}))  # in order of ids
        heads = [r for r in free if r not in incoming] or [r for r in free if incoming[r] == 1]
        rows = []
        for head in heads:
            path = []
            step = [head] if head in free else []
            while step:
                path.append(step[0])
                del free[step[0]]
                step = [r for r in targets.get(path[-1], ()) if r in free][:1]
            if len(path) > 1:
                rows.extend((head, place, r) for place, r in enumerate(path))
        return pd.DataFrame(rows, columns=schema.names)

    return own.groupBy("component").applyInPandas(walk, schema)


def layout(paths: DataFrame, edges: DataFrame, reads: DataFrame, read: str = "read_id", seq: str = "seq") -> DataFrame:
    """(path, ord, read, pos): each read starts where the one before ends, less their overlap."""
    along = Window.partitionBy("path").orderBy("ord")
    sized = paths.join(reads.select(read, F.length(seq).alias("len")), read).withColumn("before", F.lag(read).over(along)).withColumn("len_before", F.lag("len").over(along))
    step = sized.join(edges.select(F.col("src").alias("before"), F.col("dst").alias(read), "overlap_len"), ["before", read], "left")
    shift = F.coalesce(F.col("len_before") - F.col("overlap_len"), F.lit(0))
    return step.withColumn("pos", F.sum(shift).over(along.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).select("path", "ord", read, "pos")


def consensus_bases(placed: DataFrame, reads: DataFrame, read: str = "read_id", seq: str = "seq", err: str = "err") -> DataFrame:
    """(path, place, base, weight): at each covered place the base with the largest sum of 1 - error; ties to the smaller base."""
    bases = placed.join(reads.select(read, F.filter(F.split(seq, ""), lambda c: c != "").alias("b"), err), read)
    one = bases.select("path", "pos", F.posexplode(F.arrays_zip("b", err)).alias("i", "x")).select("path", (F.col("pos") + F.col("i")).alias("place"), F.col("x.b").alias("base"), (1.0 - F.col(f"x.{err}")).alias("w"))
    summed = one.groupBy("path", "place", "base").agg(F.round(F.sum("w"), 9).alias("weight"))
    return summed.groupBy("path", "place").agg(F.min(F.struct((-F.col("weight")).alias("w"), "base")).alias("best")).select("path", "place", F.col("best.base").alias("base"), (-F.col("best.w")).alias("weight"))


def consensus(called: DataFrame) -> DataFrame:
    """(path, seq) from called bases; places that no read covers become N."""
    by = called.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("place", "base"))).alias("m"), F.max("place").alias("last"))
    return by.select("path", F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), "last"), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("N"))), "").alias("seq"))


def assemble(reads: DataFrame, k: int = 15, size: int = 100, least_jaccard: float = 0.1, least: int = 20, identity: float = 0.9, read: str = "read_id", seq: str = "seq", err: str | None = None) -> dict[str, DataFrame]:
    """Overlap, layout and consensus of reads: contained reads, overlap edges, paths, contigs (path, seq) and their metrics.

    `err` names the reads' error probabilities per base; without it every base weighs the same.
    """
    held = reads.select(read, seq, (F.col(err) if err else F.transform(F.sequence(F.lit(1), F.greatest(F.length(seq), F.lit(1))), lambda i: F.lit(0.0))).alias("err"))
    inside = stored(contained(held.select(read, seq), read=read, seq=seq))
    pairs = candidate_pairs(sketch(held.select(read, seq), k, size, read, seq), inside, least_jaccard, read)
    graph = stored(overlap_edges(best_overlaps(pairs, held, least, read, seq), identity))
    paths = stored(greedy_paths(graph))
    placed = layout(paths.withColumnRenamed("read_id", read), graph, held, read, seq)
    contigs = stored(consensus(consensus_bases(placed, held, read, seq)))
    return {"contained": inside, "edges": graph, "paths": paths, "contigs": contigs, "metrics": assembly_metrics(contigs)}


def ward_linkage(points: pd.DataFrame) -> pd.DataFrame:
    """Merge table of Ward's method by the Lance-Williams update; columns left, right, height, size."""
    x = np.array(points["vec"].tolist(), float)
    n = len(x)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0)) if n else np.zeros((0, 0))
    np.fill_diagonal(d, np.inf)
    size, name, live, rows = np.ones(n), list(range(n)), np.ones(n, bool), []
    for step in range(max(0, n - 1)):
        at = int(np.argmin(d))
        i, j = sorted(divmod(at, n))
        h, si, sj = d[i, j], size[i], size[j]
        rows.append((min(name[i], name[j]), max(name[i], name[j]), float(h), int(si + sj)))
        k = live.copy()
        k[[i, j]] = False
        sk = size[k]
        new = np.sqrt(((si + sk) * d[i, k] ** 2 + (sj + sk) * d[j, k] ** 2 - sk * h**2) / (si + sj + sk))
        d[i, k] = d[k, i] = new
        d[j, :] = d[:, j] = np.inf
        live[j], size[i], name[i] = False, si + sj, n + step
    return pd.DataFrame(rows, columns=["left", "right", "height", "size"])
