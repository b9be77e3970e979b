"""Vectorised text helpers shared by the Arrow-backed operators.

Texts stay UTF-8 bytes in numpy arrays: Arrow hands a column over as one buffer
with offsets, words are found with a byte table, and every word is identified by
a 64-bit polynomial hash taken from prefix sums, so no Python object is made per
word.  All functions work on one bounded piece (a few MB) of a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Text bytes that are worked on at once by one task; a longer text is a piece of its own.
PIECE_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _byte_table(is_word: Callable[[int], bool]) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], bool)


#: `[^\x20\x09-\x0D]+`: everything but ASCII white space.
NOT_SPACE = _byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, a-z and all beyond ASCII.
ALNUM = _byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse, modulo 2**64; kept for later calls."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(n + 1, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of (values[t] + 1) * base**t for i <= t < j, modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair; equal spans at different places get equal hashes."""
    return mix(((h[end] - h[start]) * powers(len(h))[1][start]) ^ (np.asarray(end - start).astype(np.uint64) << np.uint64(40)))


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), then those of start[1], and so on."""
    return np.repeat(start - np.concatenate(([0], np.cumsum(count)))[:-1], count) + np.arange(int(count.sum()))


class Piece:
    """Texts of some rows as one byte array, a space after each; null counts as empty."""

    def __init__(self, column: pa.Array):
        n = len(column)
        wide = pa.types.is_large_string(column.type)
        valid, offsets, data = (column if wide or pa.types.is_string(column.type) else column.cast(pa.string())).buffers()
        at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        size = np.diff(at)
        if column.null_count:
            size = np.where(np.asarray(column.is_valid()), size, 0)
        self.size = size
        self.start = np.zeros(n, np.int64)
        if n:
            self.start[1:] = np.cumsum(size + 1)[:-1]
        self.end = self.start + size
        self.bytes = np.full(int(size.sum()) + n, 32, np.uint8)
        for s, e, a in zip(self.start.tolist(), self.end.tolist(), at[:-1].tolist()):
            self.bytes[s:e] = raw[a : a + e - s]

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word in the lower-cased bytes, and the row that it stands in."""
        self.lower = LOWER[self.bytes]
        inside = table[self.lower]
        if not len(inside):
            z = np.zeros(0, np.int64)
            return z, z, z
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate(([0], edge))
        start, end = edge[0::2], edge[1::2]
        return start, end, np.searchsorted(self.start, start, "right") - 1

    def word_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return span_hash(prefix_hash(self.lower), start, end)


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `limit` text bytes each, or one row."""
    n = batch.num_rows
    if not n:
        return
    size = np.diff(np.concatenate(([0], np.cumsum(_sizes(batch.column(column))))))
    at = 0
    total = np.cumsum(size)
    while at < n:
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def _sizes(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def map_pieces(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, limit: int = PIECE_BYTES) -> DataFrame:
    """Apply `fn` to bounded pieces of every partition through Arrow; no shuffle.

    Few rows go into an Arrow batch, as texts can be long: memory is bounded by
    rows per batch times text length on the JVM's side and by `limit` here.
    """

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, column, limit):
                out = fn(piece)
                if out is not None:
                    yield out

    small_batches(df)
    return df.mapInArrow(run, schema)


def small_batches(df: DataFrame, rows: int = 1000) -> None:
    """Ask for Arrow batches of few rows, unless the session already asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    now = int(conf.get(key, "10000"))
    if now <= 0 or now > rows:
        conf.set(key, str(rows))


def sums_by(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n)
