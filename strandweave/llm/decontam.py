"""Benchmark decontamination with suffix arrays over the training text.

Every task sorts the word suffixes of a bounded shard of documents into a suffix
array and binary-searches every benchmark suffix in it.  Found ranges give the
documents, places and lengths of verbatim matches; words under a match of a full
window are hit, and a document with enough hit words is contaminated.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import ALNUM, Piece, map_pieces, prefix_hash, span_hash, spread

WINDOW = 13
#: Text bytes of benchmark items that are broadcast at once; a larger benchmark goes out in several such blocks.
BLOCK_BYTES = 8 << 20


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Positions of s ordered by their first `depth` symbols at least (prefix doubling); the end sorts first.

    After each round only positions that still share their rank are sorted again.
    """
    n = len(s)
    sa = np.argsort(s, kind="stable")
    new = np.ones(n, bool)
    new[1:] = s[sa[1:]] != s[sa[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)  # 0 beyond the end
    rank[sa] = first + 1
    h = 1
    while h < depth:
        shared = ~new
        shared[:-1] |= ~new[1:]
        slot = np.flatnonzero(shared)
        if not len(slot):
            break
        pos = sa[slot]
        key = rank[pos] << 32 | rank[np.minimum(pos + h, n)]
        order = np.argsort(key, kind="stable")
        pos, key = pos[order], key[order]
        sa[slot] = pos
        new[slot] = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.maximum.accumulate(np.where(new[slot], slot, 0))
        rank[pos] = first + 1
        h *= 2
    return sa


@dataclass
class BenchmarkIndex:
    """Windows of some items, as places in one array of word hashes with WINDOW zeros after each item.

    Places are ordered by their window; those of equal windows form a class.
    """

    symbols: np.ndarray
    width: int
    place: np.ndarray  # class w is place[owner_at[w]] to place[owner_at[w + 1]]
    owner_at: np.ndarray
    length: np.ndarray  # words in each class's window
    item: np.ndarray  # of each place
    item_at: np.ndarray  # first place of each item
    ids: list[str]
    lower: np.ndarray  # the items' bytes, and where the word of each place lies in them
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def build(cls, ids: list, texts: pa.Array | list, window: int = WINDOW) -> BenchmarkIndex:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        piece = Piece(column)
        start, end, row = piece.words(ALNUM)
        at = np.searchsorted(row, np.arange(len(column) + 1))
        n = np.diff(at)
        item_at = at[:-1] + window * np.arange(len(column))
        size = len(start) + window * len(column)
        symbols, place_start, place_end = np.zeros(size + window, np.uint64), np.zeros(size + window, np.int32), np.zeros(size + window, np.int32)
        word_place = np.arange(len(start)) + window * row
        symbols[word_place], place_start[word_place], place_end[word_place] = _symbols(piece, start, end), start, end
        many = np.where(n == 0, 0, np.maximum(1, n - window + 1))
        is_window = np.zeros(size + window, bool)
        is_window[spread(item_at, many)] = True
        place = suffix_array(symbols[:size], window) if size else np.zeros(0, np.int64)
        place = place[is_window[place]]
        item = np.searchsorted(item_at, place, "right") - 1
        length = np.minimum(n[item], window)
        out = cls(symbols, window, place, np.zeros(1, np.int64), length, item, item_at, ["" if i is None else str(i) for i in ids], piece.lower, place_start, place_end)
        new = np.ones(len(place), bool)
        if len(place) > 1:  # classes are equal in bytes, not in hashes only
            new[1:] = (length[1:] != length[:-1]) | ~_same_words(out, place[1:], out, place[:-1], length[1:])
        out.owner_at, out.length = np.append(np.flatnonzero(new), len(place)), length[new]
        return out


def _same_words(x, i: np.ndarray, y, j: np.ndarray, length: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Whether x's words from i on and y's from j on are the same bytes, `length` words each; `step` pairs at a time."""
    out = np.ones(len(i), bool)
    for at in range(0, len(i), step):
        live = np.arange(at, min(at + step, len(i)))
        k = 0
        while len(live):
            live = live[length[live] > k]
            a, b = x.start[i[live] + k].astype(np.int64), y.start[j[live] + k].astype(np.int64)
            size = x.end[i[live] + k] - a
            same = size == y.end[j[live] + k] - b
            out[live[~same]] = False
            live, a, b, size = live[same], a[same], b[same], size[same]
            of = np.repeat(np.arange(len(live)), size)
            differ = np.bincount(of[x.lower[spread(a, size)] != y.lower[spread(b, size)]], minlength=len(live)) > 0
            out[live[differ]] = False
            live = live[~differ]
            k += 1
    return out


def _symbols(piece: Piece, start: np.ndarray, end: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Hashes of the words, none 0; `step` words at a time, as prefix sums take many bytes for each letter."""
    out = np.zeros(len(start), np.uint64)
    for i in range(0, len(start), step):
        a, b = start[i : i + step], end[i : i + step]
        out[i : i + step] = span_hash(prefix_hash(piece.lower[a[0] : b[-1]]), a - a[0], b - a[0])
    return np.maximum(out, np.uint64(1))


def _search(s: np.ndarray, sa: np.ndarray, index: BenchmarkIndex, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """For each class of windows, the range of sa whose suffixes start with it; `step` classes at a time."""
    width = index.width
    padded = np.concatenate((s, np.zeros(width, np.uint64)))
    leading, own = s[sa], index.place[index.owner_at[:-1]]
    low = np.searchsorted(leading, index.symbols[own], "left")
    high = np.searchsorted(leading, index.symbols[own], "right")
    out = [low.copy(), low.copy()]
    some = np.flatnonzero(low < high)
    for at in range(0, len(some), step):
        part = some[at : at + step]
        wanted, length = index.symbols[own[part][:, None] + np.arange(width)], index.length[part]
        for upper in (False, True):
            a, b = low[part], high[part]
            live = np.arange(len(part))
            while len(live):
                mid = (a[live] + b[live]) >> 1
                x, y = padded[sa[mid][:, None] + np.arange(width)], wanted[live]
                differ = (x != y) & (np.arange(width) < length[live][:, None])
                first = differ.argmax(1)
                unequal = differ[np.arange(len(live)), first]
                left = np.take_along_axis(x, first[:, None], 1)[:, 0] < np.take_along_axis(y, first[:, None], 1)[:, 0]
                right = np.where(unequal, left, upper)  # go on to the right of mid
                a[live[right]] = mid[right] + 1
                b[live[~right]] = mid[~right]
                live = live[a[live] < b[live]]
            out[upper][part] = a
    return out[0], out[1]


@dataclass
class Matches:
    """What a shard's documents share with the benchmark, one entry per row of the shard."""

    n_words: np.ndarray
    n_hit: np.ndarray
    items: list[set[str]]
    longest: np.ndarray
    longest_item: list[str | None]
    longest_at: np.ndarray


@dataclass
class _Words:
    lower: np.ndarray
    start: np.ndarray
    end: np.ndarray


def match_shard(column: pa.Array, indexes, window: int = WINDOW, items: bool = True) -> Matches:
    """Search all windows of all indexes in the suffix array of these texts.

    Words are compared by hash in the searches; each found window is then
    compared byte by byte.  With `items` false, only words are counted, so
    windows that many items share cost no more than others.
    """
    piece, n = Piece(column), len(column)
    start, end, row = piece.words(ALNUM)
    h = _symbols(piece, start, end)
    s = np.zeros(len(h) + n, np.uint64)  # a 0 after each text keeps matches inside it
    place = np.arange(len(h)) + row
    s[place] = h
    word_at = np.full(len(s) + 1, -1, np.int64)
    word_at[place] = np.arange(len(h))
    first = np.searchsorted(row, np.arange(n))
    n_words = np.bincount(row, minlength=n)
    hit = np.zeros(len(h) + 1, np.int64)
    out = Matches(n_words, np.zeros(n, np.int64), [set() for _ in range(n)], np.zeros(n, np.int64), [None] * n, np.full(n, -1, np.int64))
    sa = suffix_array(s, window) if len(h) else np.zeros(0, np.int64)
    text = _Words(piece.lower, start, end)
    for index in indexes:
        if not len(sa) or not len(index.length):
            continue
        lo, hi = _search(s, sa, index)
        found = np.flatnonzero(hi > lo)
        times = hi[found] - lo[found]
        w = np.repeat(found, times)
        at = word_at[sa[spread(lo[found], times)]]
        same = _same_words(text, at, index, index.place[index.owner_at[w]], index.length[w])
        w, at = w[same], at[same]
        if not len(w):
            continue
        np.add.at(hit, at, 1)
        np.add.at(hit, at + index.length[w], -1)
        if items:
            order = np.argsort(row[at], kind="stable")
            _name_items(out, index, w[order], at[order], row, first)
    covered = np.cumsum(hit[:-1]) > 0
    out.n_hit = np.bincount(row[covered], minlength=n)
    return out


def _name_items(out: Matches, index: BenchmarkIndex, w: np.ndarray, at: np.ndarray, row: np.ndarray, first: np.ndarray, most: int = 1 << 20) -> None:
    """Items and longest matches of the documents with these windows, some documents (`most` places, or one document) at a time."""
    many = index.owner_at[w + 1] - index.owner_at[w]
    edge = np.flatnonzero(np.diff(row[at], prepend=-1))
    total = np.concatenate(([0], np.cumsum(np.add.reduceat(many, edge))))
    edge = np.append(edge, len(w))
    d = 0
    while d < len(edge) - 1:
        to = max(d + 1, int(np.searchsorted(total, total[d] + most, "right")) - 1)
        part = slice(edge[d], edge[to])
        d = to
        entry = spread(index.owner_at[w[part]], many[part])
        x, size = np.repeat(at[part], many[part]), np.repeat(index.length[w[part]], many[part])
        item = index.item[entry]
        offset = index.place[entry] - index.item_at[item]
        pair = np.unique(row[x] * len(index.ids) + item)
        for r, i in zip((pair // len(index.ids)).tolist(), (pair % len(index.ids)).tolist()):
            out.items[r].add(index.ids[i])
        # Windows of one item on one diagonal that follow each other are one verbatim match.
        order = np.lexsort((x, x - offset, item))
        x, item, offset, size = x[order], item[order], offset[order], size[order]
        new = np.ones(len(x), bool)
        new[1:] = (item[1:] != item[:-1]) | (x[1:] - offset[1:] != x[:-1] - offset[:-1]) | (x[1:] != x[:-1] + 1)
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(x)) - 1
        length = x[last] - x[begin] + size[last]
        order = np.lexsort((np.arange(len(begin)), -length, row[x[begin]]))
        order = order[np.flatnonzero(np.diff(row[x[begin[order]]], prepend=-1))]
        for b, long in zip(begin[order].tolist(), length[order].tolist()):
            r = int(row[x[b]])
            if long > out.longest[r]:
                out.longest[r], out.longest_item[r], out.longest_at[r] = long, index.ids[item[b]], x[b] - first[r]


def broadcast_benchmark(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list:
    """The benchmark's windows as broadcast blocks of checked size.

    The total is measured first; items are dealt by hash to as many blocks as it
    takes, each collected, indexed and broadcast alone.  A worker holds one block
    at a time; the driver builds one at a time, and its block store keeps all.
    """
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    sc = benchmark.sparkSession.sparkContext
    out = []
    for k in range(blocks):
        part = (rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)).orderBy("i", "t").toArrow().combine_chunks()
        texts = part.column("t")
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        out.append(sc.broadcast(BenchmarkIndex.build(part.column("i").to_pylist(), texts, window)))
    return out


def _indexes(blocks: list):
    for b in blocks:
        yield b.value
        if len(blocks) > 1:
            b.__dict__.pop("_value", None)  # read again from disk when next asked for


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, items and the longest match with its place.

    Null and empty texts have no words and no hits; items without words have no
    windows; items that share an id count once; an item without id is listed as
    ''.  No shuffle: documents stay where they are read.  A key with the name of an
    added column is returned with `_key` after its name.
    """
    blocks = broadcast_benchmark(benchmark, window=window)
    added = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "longest_match", "longest_item", "longest_at"]
    own = f"{key}_key" if key in added else key
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = match_shard(batch.column(1), _indexes(blocks), window)
        items = [sorted(x) for x in m.items]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(m.n_words, pa.int64()),
                pa.array(m.n_hit, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                pa.array((m.n_hit > 0) & (share * m.n_hit >= m.n_words), pa.bool_()),
                pa.array(items, pa.list_(pa.string())),
                pa.array(m.longest, pa.int64()),
                pa.array(m.longest_item, pa.string()),
                pa.array(m.longest_at, pa.int64()),
            ],
            names=[own, *added],
        )

    schema = f"`{own}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, longest_match long, longest_item string, longest_at long"
    return map_pieces(docs.select(F.col(key).alias(own), F.col(text).alias("_text")), "_text", run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """docs without the contaminated ones; all columns stay. Null and empty texts are kept. No shuffle."""
    blocks = broadcast_benchmark(benchmark, window=window)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = match_shard(batch.column(text), _indexes(blocks), window, items=False)
        return batch.filter(pa.array((m.n_hit == 0) | (share * m.n_hit < m.n_words), pa.bool_()))

    return map_pieces(docs, text, run, docs.schema)
