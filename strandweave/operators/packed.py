"""k-mers packed two bits a base into one long: A 0, C 1, G 2, T 3, the first base highest.

Packed k-mers of one length keep the order of their texts, are a fixed eight bytes
in shuffles and aggregations, and become text only at the edge.  k is 31 at most, so
the sign bit stays clear.  A k-mer with any other letter has no code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kmers import chunks

#: Longest packed k-mer; bases of a piece that is packed at once; codes that a task hands over at once.
MOST, PIECE, ROWS = 31, 1 << 18, 1 << 16
#: Code of each byte, 4 for what is no base.
_CODES = np.full(256, 4, np.uint8)
for _i, _pair in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    _CODES[list(_pair)] = _i


def pack(kmer: Column) -> Column:
    """Code of a k-mer of at most 31 bases; null where a letter is none of A, C, G, T."""
    digits = F.translate(F.upper(kmer), "ACGT", "0123")
    return F.when(F.upper(kmer).rlike("^[ACGT]*$") & (F.length(kmer) <= MOST), F.coalesce(F.conv(digits, 4, 10).cast("long"), F.lit(0).cast("long")))


def unpack(code: Column, k: int) -> Column:
    """Text of a code of k bases."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT") if k else F.lit("")


def _check(k: int) -> None:
    if not 1 <= k <= MOST:
        raise ValueError(f"packed k-mers have 1 to {MOST} bases")


def roll(letters: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all k-mers of an array of bytes without foreign letters, and their places; blocks of 1, 2, 4, ... bases are joined."""
    n = len(letters) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    digit = _CODES[letters]
    bad = np.concatenate(([0], np.cumsum(digit > 3)))
    block, size = digit.astype(np.int64), 1
    code, done = np.zeros(n, np.int64), 0
    while True:
        if k & size:
            code = (block[k - done - size : k - done - size + n]) << (2 * done) | code
            done += size
        if done == k:
            break
        block = block[:-size] << (2 * size) | block[size:]
        size *= 2
    place = np.flatnonzero(bad[k:] == bad[:n])
    return code[place], place


def packed_kmers(df: DataFrame, k: int, seq: str = "seq", counted: bool = False) -> DataFrame:
    """The other columns, `code` and `pos` of each k-mer of A, C, G and T.

    With `counted`, `cnt` in place of `pos`: how often a code occurs in a piece of one
    row, so that counting starts before the first shuffle.
    """
    _check(k)
    cut = chunks(df, seq, PIECE, k - 1, "_start")
    names = [c for c in df.columns if c != seq]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts = batch.column(seq), batch.column("_start").to_pylist()
            row, codes, last = [], [], []
            held = 0

            def out() -> pa.RecordBatch:
                at = pa.array(np.repeat(np.array(row, np.int32), [len(c) for c in codes]))
                return pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in names], pa.array(np.concatenate(codes)), pa.array(np.concatenate(last))], names=[*names, "code", "cnt" if counted else "pos"])

            for i, start in enumerate(starts):
                text = texts[i].as_buffer()
                code, place = roll(np.frombuffer(text, np.uint8) if text is not None else np.zeros(0, np.uint8), k)
                # A start belongs to the piece that it lies in, not to the margin of the one before.
                own = place < PIECE
                code, place = code[own], place[own] + start
                if counted:
                    code, place = np.unique(code, return_counts=True)
                row.append(i), codes.append(code), last.append(place)
                held += len(code)
                if held >= ROWS:
                    yield out()
                    row, codes, last, held = [], [], [], 0
            if held:
                yield out()

    schema = df.select(*names).schema.add("code", T.LongType()).add("cnt" if counted else "pos", T.LongType())
    return cut.select(*names, F.upper(seq).alias(seq), "_start").mapInArrow(run, schema)


def packed_index(genomes: DataFrame, k: int, organism: str = "organism", seq: str = "seq") -> DataFrame:
    """(code, organism, cnt): kmer_index with codes."""
    return packed_kmers(genomes.select(organism, seq), k, seq, counted=True).groupBy("code", organism).agg(F.sum("cnt").alias("cnt"))


def packed_edges(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(code, src, dst, base, cnt): the edges of a de Bruijn graph with nodes as codes of k - 1 bases and the last base as a number."""
    counts = packed_kmers(reads.select(seq), k, seq, counted=True).groupBy("code").agg(F.sum("cnt").alias("cnt"))
    low = F.lit((1 << (2 * (k - 1))) - 1).cast("long")
    return counts.select("code", F.shiftright("code", 2).alias("src"), F.col("code").bitwiseAND(low).alias("dst"), F.col("code").bitwiseAND(F.lit(3).cast("long")).cast("int").alias("base"), "cnt")
