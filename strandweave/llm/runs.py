"""Periodic runs of words in texts: maximal stretches that repeat with a smallest period.

Names of blocks of 1, 2, 4, ... words come from prefix doubling, which also gives
the suffix array; the longest common prefix of two suffixes is read off the names
from the largest block down.  Longest previous factors of the suffix array give
the blocks of a Lempel-Ziv cut.  A run that touches a border between blocks is
found by extending from the border both ways; any other run lies inside a block
and is copied from the block's earlier occurrence.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import map_pieces

#: Shortest run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Text of one map call.
PIECE = 1 << 20


class Names:
    """Names of all blocks of 2**l words of some texts that are laid end to end, and their suffix arrays.

    `words` are numbers of which no two texts share one; text i is words[edges[i]:edges[i + 1]].
    names[l][i] == names[l][j] if and only if the 2**l words from i and from j on
    are equal; a block that its text cuts short equals no other.
    """

    def __init__(self, words: np.ndarray, edges: np.ndarray):
        n = len(words)
        self.end = np.repeat(edges[1:], np.diff(edges))
        self.begin = np.repeat(edges[:-1], np.diff(edges))
        order = np.argsort(words, kind="stable")
        name = np.empty(n, np.int64)
        name[order] = self._heads(words[order])
        self.order, self.names, size = order, [name], 1
        while True:
            # Only suffixes that still share a name are sorted on; a name is the place of its first suffix in the array.
            sorted_names = name[order]
            first = np.flatnonzero(np.append(True, sorted_names[1:] != sorted_names[:-1]))
            count = np.diff(np.append(first, n))
            open_ = np.flatnonzero(np.repeat(count > 1, count))
            if not len(open_):
                break
            at = order[open_]
            nxt = np.where(at + size < self.end[at], name[np.minimum(at + size, n - 1)] + 1, -1 - at)
            key = np.lexsort((nxt, name[at]))
            at, nxt = at[key], nxt[key]
            order = order.copy()
            order[open_] = at
            same = (name[at][1:] == name[at][:-1]) & (nxt[1:] == nxt[:-1])
            head = np.maximum.accumulate(np.where(np.append(True, ~same), open_, 0))
            name = name.copy()
            name[at] = head
            size *= 2
            self.order = order
            self.names.append(name)

    @staticmethod
    def _heads(values: np.ndarray) -> np.ndarray:
        """For each place of a sorted array, the first place with the same value."""
        return np.maximum.accumulate(np.where(np.append(True, values[1:] != values[:-1]), np.arange(len(values)), 0)) if len(values) else values

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from i and from j on (i != j, in one text; ends count as places)."""
        i, j = i.copy(), j.copy()
        start, top = i.copy(), len(self.begin) - 1
        stop = self.end[np.minimum(np.minimum(i, j), top)]
        for l in range(len(self.names) - 1, -1, -1):
            size, name = 1 << l, self.names[l]
            fits = (np.maximum(i, j) + size <= stop) & (name[np.minimum(i, top)] == name[np.minimum(j, top)])
            i, j = i + size * fits, j + size * fits
        return i - start

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words that end before i and before j (i != j, in one text)."""
        i, j = i.copy(), j.copy()
        start, top = i.copy(), len(self.begin) - 1
        stop = self.begin[np.minimum(np.minimum(i, j), top)]
        for l in range(len(self.names) - 1, -1, -1):
            size, name = 1 << l, self.names[l]
            a, b = i - size, j - size
            fits = (np.minimum(a, b) >= stop) & (name[np.maximum(a, 0)] == name[np.maximum(b, 0)])
            i, j = i - size * fits, j - size * fits
        return start - i


def previous_factors(order: np.ndarray, lcp: np.ndarray) -> tuple[list[int], list[int]]:
    """Longest previous factor of each place and where it was, from a suffix array and its lcp with the suffix before.

    Suffixes leave the array from the last place to the first: what is next to a
    leaving suffix starts before it, and the common prefix of what becomes
    neighbours is the smaller of the two.
    """
    n = len(order)
    above, below = [-1] * n, [-1] * n
    common = [0] * (n + 1)  # with the neighbour above
    sa, shared = order.tolist(), lcp.tolist()
    for k, p in enumerate(sa):
        above[p] = sa[k - 1] if k else -1
        below[p] = sa[k + 1] if k + 1 < n else -1
        common[p] = shared[k] if k else 0
    factor, source = [0] * n, [-1] * n
    for p in range(n - 1, -1, -1):
        a, b = above[p], below[p]
        up, down = common[p], common[b] if b >= 0 else 0
        if up >= down:
            if up:
                factor[p], source[p] = up, a
        else:
            factor[p], source[p] = down, b
        if b >= 0:
            above[b] = a
            common[b] = up if up < down else down
        if a >= 0:
            below[a] = b
    return factor, source


def blocks_of(factor: list[int]) -> list[int]:
    """Borders of the Lempel-Ziv cut: each block is the longest previous factor, or one new word."""
    borders, at = [0], 0
    while at < len(factor):
        at += max(1, factor[at])
        borders.append(at)
    return borders


def runs_at_borders(names: Names, base: int, borders: np.ndarray, least: int) -> np.ndarray:
    """(start, end, period) of stretches of `least` periods or more that touch a border, by extension from it.

    Such a stretch has its last word in the block after the border or ends there; if
    its second period began before the block before, that block would have been
    longer.  So (least - 1) periods are shorter than the two blocks together.
    """
    before = np.diff(borders)
    after = np.append(before[1:], 0)
    most = (before + after - 1) // (least - 1)
    spot = np.repeat(borders[1:], most)
    period = np.arange(int(most.sum())) - np.repeat(np.cumsum(most) - most, most) + 1
    found = []
    n = int(borders[-1])
    for shift in (0, 1):  # the border at the end of a first period, or at the start of one
        i = spot - period * shift
        ok = (i >= 0) & (i + period <= n)
        i, q = i[ok] + base, period[ok]
        ahead = names.forward(i, i + q)
        back = names.backward(i, i + q)
        length = ahead + back + q
        good = length >= least * q
        start = i[good] - back[good] - base
        found.append(np.stack((start, start + length[good], q[good]), 1))
    return np.concatenate(found)


def runs_of(names: Names, base: int, n: int, order: np.ndarray, lcp: np.ndarray, least: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one text with `least` (2 or more) periods or more, by start, then period."""
    factor, source = previous_factors(order, lcp)
    borders = blocks_of(factor)
    period: dict[tuple[int, int], int] = {}
    for s, e, q in runs_at_borders(names, base, np.array(borders, np.int64), least).tolist():
        if q < period.get((s, e), n + 1):
            period[s, e] = q  # a stretch has all multiples of its period; the smallest counts
    # Runs within a block are copied from where the block was before, in order of their starts.
    by_start = sorted(period)
    for at, end in zip(borders, borders[1:]):
        shift = at - source[at]
        if source[at] < 0 or end - at < least:
            continue
        k = bisect_right(by_start, (at - shift, n))
        while k < len(by_start) and by_start[k][0] < end - shift:
            s, e = by_start[k]
            if e < end - shift and (s + shift, e + shift) not in period:
                period[s + shift, e + shift] = period[s, e]
                insort(by_start, (s + shift, e + shift))
            k += 1
    return sorted((s, e - s, q) for (s, e), q in period.items())


def find_runs(texts: list[list[bytes]], least_words: int = LEAST_WORDS, least: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, given as words: maximal, of `least_words` words and `least` periods or more."""
    numbers, edges = [], [0]
    seen = 0
    for words in texts:
        own: dict[bytes, int] = {}
        numbers += [own.setdefault(w, seen + len(own)) for w in words]
        seen += len(own)
        edges.append(len(numbers))
    edge = np.array(edges, np.int64)
    names = Names(np.array(numbers, np.int64), edge)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not numbers:
        return out
    # A run of length n and period q has a previous factor of n - q words: texts in which no block of half that size repeats have none.
    shortest = max(least_words - least_words // least, least - 1)
    level = shortest.bit_length() - 1
    if level >= len(names.names):
        return out
    # Suffixes of one text are neighbours, as texts share no words and words are numbered text by text.
    order = names.order
    block = names.names[level][order]
    for i in np.unique(np.searchsorted(edge, order[1:][block[1:] == block[:-1]], "right") - 1).tolist():
        a, b = edges[i], edges[i + 1]
        own = order[a:b]
        lcp = np.append(0, names.forward(own[:-1], own[1:]))
        if lcp.max() >= shortest:
            out[i] = [r for r in runs_of(names, a, b - a, own - a, lcp, least) if r[1] >= least_words]
    return out


def periodic_words(key: str | None, text: str | None) -> list[bytes]:
    """Words of a text; where the key's checksum is a multiple of ten, from some word on a stretch repeats to the end."""
    words = text.encode().split() if text else []
    h, n = zlib.crc32((key or "").encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]
    return words


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run has after its first period."""
    if not runs:
        return words
    keep = bytearray(b"\1") * len(words)
    for start, length, period in runs:
        keep[start + period : start + length] = bytes(length - period)
    return [w for w, k in zip(words, keep) if k]


def run_digest(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, least: int = LEAST_PERIODS, planted: bool = False, with_text: bool = False) -> DataFrame:
    """Runs of each text: their number, the longest (ties: smallest start, then period), digests of all and of the text without repeats.

    One row per input row; null and empty texts have no words and no runs.  With
    `planted`, periodic_words() is looked at instead of the words themselves.  With
    `with_text`, `runs` (array of start, length, period) and `collapsed` are added.
    Other columns are not looked at.  One pass, no shuffle; a text is one piece of work.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [periodic_words(k, t) if planted else (t.encode().split() if t else []) for k, t in zip(batch.column("_name").to_pylist(), batch.column("_text").to_pylist())]
        found = find_runs(texts, least_words, least)
        best = [max(r, key=lambda x: (x[1], -x[0], -x[2])) if r else (None, None, None) for r in found]
        left = [b" ".join(collapse(w, r)) for w, r in zip(texts, found)]
        long = lambda values: pa.array(values, pa.int64())
        columns = {
            key: batch.column(key),
            "n_runs": long([len(r) for r in found]),
            "start": long([b[0] for b in best]),
            "length": long([b[1] for b in best]),
            "period": long([b[2] for b in best]),
            "exponent_milli": long([1000 * b[1] // b[2] if b[2] else None for b in best]),
            "runs_sha256": pa.array([hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()).hexdigest() for r in found]),
            "collapsed_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in left]),
        }
        if with_text:
            columns["runs"] = pa.array([[dict(zip(("start", "length", "period"), x)) for x in r] for r in found], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
            columns["collapsed"] = pa.array([x.decode() for x in left], pa.string())
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    source = docs.select(key, F.col(key).cast("string").alias("_name"), F.col(text).alias("_text"))
    schema = source.select(key).schema
    for name in ("n_runs", "start", "length", "period", "exponent_milli"):
        schema = schema.add(name, "long")
    schema = schema.add("runs_sha256", "string").add("collapsed_sha256", "string")
    if with_text:
        schema = schema.add("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))).add("collapsed", "string")
    return map_pieces(source, "_text", run, schema, PIECE)
