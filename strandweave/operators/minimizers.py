"""Window minimizers and bottom-s sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.sequence import windows
from .components import stored
from .kmers import CHUNK, chunks
from .packed import MOST, roll

#: Bases of a piece that is sketched by itself.
SKETCH_PIECE = 1 << 15
#: Bases of a stretch whose minimizers are found at once.
PIECE = 2048
#: Sketches and hashes of a block, about, at most; blocks are compared in pairs.  Tables of fewer sketches have up to SPREAD blocks, of SMALL or more, for more tasks.
BLOCK, HASHES, SPREAD, SMALL = 1 << 16, 1 << 22, 8, 2048
#: Pairs that a task hands over at once.
ROWS = 1 << 17
#: Stands for a k-mer with an N: above every code.
NONE = np.iinfo(np.int64).max
_LETTERS = np.frombuffer(b"ACGT", np.uint8)
#: Deletes bases and N.
_BASES = str.maketrans("", "", "ACGTN")


def _lowest(code: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbouring codes, distinct and in order; windows of nothing but NONE give none."""
    least = code[: len(code) - w + 1].copy()
    for i in range(1, w):
        np.minimum(least, code[i : i + len(least)], out=least)
    found = np.unique(least)
    return found[found != NONE]


def _found(text: str | None, k: int, w: int) -> np.ndarray:
    """Letters of the distinct minimizers of a stretch, one row of k letters each: as bytes if it has bases and N only, else as code points."""
    n = len(text or "") - k + 1
    if n < w:
        return np.zeros((0, k), np.uint8)
    if k <= MOST and text.isascii() and not text.translate(_BASES):
        code = np.full(n, NONE, np.int64)
        packed, at = roll(np.frombuffer(text.encode(), np.uint8), k)
        code[at] = packed
        return _LETTERS[(_lowest(code, w)[:, None] >> (2 * np.arange(k - 1, -1, -1))) & 3]
    pieces = sliding_window_view(np.frombuffer(text.encode("utf-32-le"), "<u4"), k)
    each, name = np.unique(pieces, axis=0, return_inverse=True)
    return each[_lowest(np.where((pieces == ord("N")).any(axis=1), NONE, name.reshape(-1)), w)]


def _window_minima(k: int, w: int):
    """Column function: distinct minimizers of each stretch of a batch."""

    @F.arrow_udf("array<string>")
    def minima(texts: pa.Array) -> pa.Array:
        found = [_found(text.as_py(), k, w) for text in texts]
        if any(x.dtype != np.uint8 for x in found):
            return pa.array([["".join(map(chr, row)) for row in x.tolist()] for x in found], pa.list_(pa.string()))
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        letters = np.concatenate(found) if found else np.zeros((0, k), np.uint8)
        strings = pa.StringArray.from_buffers(len(letters), pa.py_buffer(np.arange(0, (len(letters) + 1) * k, k, np.int32)), pa.py_buffer(letters.tobytes()))
        return pa.ListArray.from_arrays(pa.array(ends), strings)

    return minima


def minimizers(df: DataFrame, k: int, w: int, seq: str = "seq") -> DataFrame:
    """Distinct (input columns, minimizer): the smallest k-mer without N of each full window of w consecutive k-mers.

    Each stretch of a sequence keeps its own distinct minimizers, so no row leaves
    its partition before the final distinct.
    """
    cut = chunks(df, seq, PIECE, w + k - 2, "_start").drop("_start")
    found = cut.select(*(c for c in cut.columns if c != seq), _window_minima(k, w)(F.col(seq)).alias("_found"))
    return found.withColumn("minimizer", F.explode("_found")).drop("_found").distinct()


def minimizer_index(genomes: DataFrame, k: int, w: int, organism: str = "organism", seq: str = "seq") -> DataFrame:
    """Distinct (minimizer, organism)."""
    return minimizers(genomes.select(organism, seq), k, w, seq).select("minimizer", organism)  # distinct already


def sketch(df: DataFrame, k: int, size: int, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """(key, rank, hash): the `size` smallest hashes (first 8 hex digits of md5) of each sequence's distinct k-mers.

    Each piece of a sequence keeps its own `size` smallest hashes, and only these
    are merged, so what travels is bounded by pieces and not by k-mers.
    """
    cut = chunks(df.select(key, seq), seq, SKETCH_PIECE, k - 1, "_start")
    # Hashes are made stretch by stretch, as substring() walks a string from its start.
    inside = lambda p: F.transform(windows(p, k), lambda i: F.substring(F.md5(F.substring(p, i, F.lit(k))), 1, 8))
    parts = F.transform(F.sequence(F.lit(1), F.length(seq), F.lit(CHUNK)), lambda b: F.substring(F.col(seq), b, F.lit(CHUNK + k - 1)))
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.transform(parts, inside)))), 1, size)
    return merge_sketches(cut.select(key, F.explode(least).alias("hash")), size, key)


def merge_sketches(hashes: DataFrame, size: int, key: str = "seq_id") -> DataFrame:
    """(key, rank, hash): the sketch of the union of whatever (key, hash) rows were sketched apart, to the same size or a larger one."""
    return hashes.select(key, "hash").distinct().withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("hash"))).where(F.col("rank") <= size).select(key, "rank", "hash")


def distinct_estimate(sketches: DataFrame, size: int, key: str = "seq_id") -> DataFrame:
    """(key, n_distinct): distinct k-mers, exact where a sketch is not full, else from its largest hash."""
    by = sketches.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("hash").alias("last"))
    share = (F.conv("last", 16, 10).cast("double") + 1) / F.lit(2.0**32)
    return by.select(key, F.when(F.col("n") < size, F.col("n").cast("double")).otherwise(F.round((size - 1) / share)).cast("long").alias("n_distinct"))


def _joined(hashes: Column) -> tuple[Column, Column]:
    """Hashes as they travel: four bytes each where all are 8 hex digits, else as they are; one of the two is null."""
    digits = F.array_join(hashes, "")
    plain = F.forall(hashes, lambda h: F.length(h) == 8) & digits.rlike("^[0-9a-f]*$")
    return F.when(plain, F.unhex(digits)), F.when(~plain, hashes)


def _numbered(packed: pa.ChunkedArray, rest: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sketches, and a number for each of their hashes, one sketch's after another's; equal hashes have equal numbers."""
    if rest.null_count == len(rest):
        size = pc.binary_length(packed).to_numpy() // 4
        name = np.unique(np.frombuffer(b"".join(packed.to_pylist()), ">u4"), return_inverse=True)[1]
        return size.astype(np.int64), name.astype(np.int32)
    lists = [h if h is not None else [p[i : i + 4].hex() for i in range(0, len(p), 4)] for p, h in zip(packed.to_pylist(), rest.to_pylist(), strict=True)]
    flat = pa.array([x for h in lists for x in h], pa.string())
    return np.array([len(h) for h in lists], np.int64), flat.dictionary_encode().indices.to_numpy()


def sketch_jaccard(sketches: DataFrame, key: str = "seq_id", least: float = 0.0) -> DataFrame:
    """(a, b, shared, total, jaccard) for pairs a < b of sketches that share a hash and have a rounded jaccard of `least` or more.

    Sketches are dealt into blocks by their key, and each pair of blocks is one group, so pairs are
    counted where they arise: what travels are sketches, four bytes a hash, once for each block, and not a
    row for each hash of each pair.  A group's sketches are held together, its rows leave it bit by bit.
    """
    packed, rest = _joined(F.col("hashes"))
    held = stored(sketches.groupBy(key).agg(F.collect_list("hash").alias("hashes")).select(key, F.size("hashes").alias("n"), packed.alias("packed"), rest.alias("rest")))
    n, hashes = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK), -(-hashes // HASHES), min(SPREAD, n // SMALL))
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    dealt = held.withColumn("_block", block).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # The number of tasks follows the work, which is in the pairs, not in the few bytes that travel.
    dealt = dealt.select(key, "packed", "rest", "_block", F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high")).repartition(blocks * (blocks + 1) // 2, "_low", "_high")
    ids = sketches.schema[key].dataType
    schema = T.StructType([T.StructField("a", ids), T.StructField("b", ids), T.StructField("shared", T.LongType()), T.StructField("total", T.LongType()), T.StructField("jaccard", T.DoubleType())])

    def count(pair: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = (x.as_py() for x in pair)
        group = pa.Table.from_batches(list(batches)).sort_by(key).combine_chunks()
        keys, side = group[key].combine_chunks(), group["_block"].to_numpy()
        size, name = _numbered(group["packed"], group["rest"])
        left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
        at = np.zeros(len(size), np.int32)
        at[right] = np.arange(len(right))
        row = np.repeat(np.arange(len(size), dtype=np.int32), size)
        held = side[row] == high
        many = np.argsort(name[held], kind="stable")
        to, by = at[row[held]][many], name[held][many]
        bound = np.searchsorted(by, np.arange(name.max(initial=-1) + 2))
        begin = np.concatenate(([0], np.cumsum(size)))
        del group, row, held, many, by

        def out(parts: list) -> pa.RecordBatch:
            i, j, shared = (np.concatenate(x) for x in zip(*parts, strict=True))
            total = size[i] + size[j] - shared
            jaccard = pc.round(pa.array(shared / np.maximum(total, 1)), 6, "half_towards_infinity")
            near = pa.array(np.asarray(jaccard) >= least)
            # Rows are sorted by key, so the smaller place is the smaller key.
            columns = [keys.take(pa.array(np.minimum(i, j))), keys.take(pa.array(np.maximum(i, j))), pa.array(shared.astype(np.int64)), pa.array(total.astype(np.int64)), jaccard]
            return pa.RecordBatch.from_arrays([c.filter(near) for c in columns], names=schema.names)

        parts, rows = [], 0
        for i in left:  # one row of the matrix at a time
            mine = name[begin[i] : begin[i + 1]]
            if not len(mine):
                continue
            shared = np.bincount(np.concatenate([to[bound[x] : bound[x + 1]] for x in mine]), minlength=len(right))
            j = np.flatnonzero(shared)
            j = j[(right[j] > i)] if low == high else j
            parts.append([np.full(len(j), i), right[j], shared[j]])
            rows += len(j)
            if rows >= ROWS:
                yield out(parts)
                parts, rows = [], 0
        if rows:
            yield out(parts)

    return dealt.groupBy("_low", "_high").applyInArrow(count, schema)
