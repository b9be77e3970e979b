"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if it lies in a `length`-byte string that also starts elsewhere.
Sorting every suffix of the corpus would move it many times over, so suffixes are
first grouped by anchors: the smallest hashed gram of each window, which equal
windows place alike.  Runs of windows whose whole surroundings repeat are settled
by their prefix-hash digests; what is left around the ends of matches is settled
window by window.  There each shard mergesorts its suffixes, comparing them by
polynomial prefix hashes and binary search for the common extension, verifies
equal neighbours byte by byte, and the shards' sorted classes meet in a shuffled
aggregation by digest.  No group is ever gathered in one task.

The same search runs over words as well as bytes: the passages of 50 words or
more that documents share with one another.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import cut, few, forget
from ._text import ALNUM, Piece, map_pieces, mix, powers, prefix_hash, span_hash

#: Of repeated byte strings: their length, that of the grams they are anchored by, and of the cells that runs are cut into.
LENGTH, GRAM, CELL = 400, 100, 32
#: The same of shared passages, in words.
WORDS, WORD_GRAM, WORD_CELL = 50, 8, 8
#: Text bytes that a task works on at once.  The arrays of a search hold about a hundred times as many bytes.
PIECE_BYTES = 1 << 20
_UNITS = "rid long, start int, n int, core long, ctx long"


# --- the sort -------------------------------------------------------------------------------------------------


class Suffixes:
    """Suffixes of an array of bytes or words, compared on their first `limit` symbols by prefix hashes."""

    def __init__(self, data: np.ndarray, limit: int):
        self.data, self.limit, self.h = data, limit, prefix_hash(data)
        self.head = data  # first word or first eight bytes, for the first distribution
        if data.dtype == np.uint8:
            padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
            self.head = np.zeros(len(data), np.uint64)
            for k in range(8):
                self.head = self.head << np.uint64(8) | padded[k : k + len(data)]

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the common extension of each pair, up to the limit: binary search over prefix hashes."""
        a, b = np.minimum(p, q), np.maximum(p, q)
        shift = powers(len(self.h))[0][b - a]
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.limit, len(self.data) - b)
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                return lo
            mid = (lo[live] + hi[live] + 1) >> 1
            x, y = a[live], b[live]
            same = (self.h[x + mid] - self.h[x]) * shift[live] == self.h[y + mid] - self.h[y]
            lo[live[same]] = mid[same]
            hi[live[~same]] = mid[~same] - 1

    def before(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether suffix p sorts before suffix q; suffixes equal up to the limit go by position."""
        n = self.common(p, q)
        end = (n >= self.limit) | (np.maximum(p, q) + n >= len(self.data))
        at = np.where(end, 0, n)
        return np.where(end, p < q, self.data[p + at] < self.data[q + at])

    def sort(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, lcp): positions sorted by suffix, and the common extension with the one before (0 for the first).

        Positions are dealt by their first eight bytes; within each such group runs
        of doubling length are merged, every element finding its place in the
        sibling run by binary search.
        """
        pos = pos[np.argsort(self.head[pos], kind="stable")]
        head = self.head[pos]
        first = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1]))) if len(pos) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(pos)))
        begin, end = np.repeat(first, size), np.repeat(first + size, size)
        width, largest = 1, int(size.max()) if len(size) else 0
        at = np.arange(len(pos))
        while width < largest:
            live = np.flatnonzero(end - begin > width)
            i, b, e = at[live], begin[live], end[live]
            run = (i - b) // width
            own = b + run * width
            sib = np.where(run & 1, own - width, own + width)
            lo, hi = np.minimum(sib, e), np.minimum(sib + width, e)
            base, me = lo.copy(), pos[live]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                less = self.before(pos[mid], me[open_])
                lo[open_[less]] = mid[less] + 1
                hi[open_[~less]] = mid[~less]
            place = np.minimum(own, np.where(run & 1, own - width, own)) + (i - own) + (lo - base)
            merged = pos.copy()
            merged[place] = me
            pos = merged
            width *= 2
        lcp = np.zeros(len(pos), np.int64)
        if len(pos) > 1:
            lcp[1:] = self.common(pos[:-1], pos[1:])
            self._verify(pos, lcp)
        return pos, lcp

    def _verify(self, pos: np.ndarray, lcp: np.ndarray, block: int = 4096) -> None:
        """Compare equal neighbours byte by byte; where hashes collided, the true extension is put in."""
        equal = np.flatnonzero(lcp >= self.limit)
        for k in range(0, len(equal), block):
            i = equal[k : k + block]
            span = np.arange(self.limit)
            differ = self.data[pos[i - 1][:, None] + span] != self.data[pos[i][:, None] + span]
            for j in np.flatnonzero(differ.any(1)):
                lcp[i[j]] = int(differ[j].argmax())


# --- candidates -----------------------------------------------------------------------------------------------


def _window_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of key[i : i + width] for each i that has so many, in linear time."""
    n = len(key)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


class _Symbols:
    """The bytes of some texts, or their lower-cased words as 64-bit hashes, end to end; start, end and size of each text."""

    def __init__(self, column: pa.Array, words: bool):
        piece = Piece(column)
        self.data, self.start, self.end, self.size = piece.bytes, piece.start, piece.end, piece.size
        if words:
            start, end, row = piece.words(ALNUM)
            at = np.searchsorted(row, np.arange(len(column) + 1))
            self.data, self.start, self.end, self.size = piece.word_hashes(start, end), at[:-1], at[1:], np.diff(at)

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, at, "right") - 1


class _Anchored:
    """The windows of a piece's texts, as runs that share their anchor."""

    def __init__(self, column: pa.Array, words: bool, length: int, gram: int):
        self.piece, self.length, self.gram = _Symbols(column, words), length, gram
        data = self.piece.data
        self.h = prefix_hash(data)
        z = np.zeros(0, np.int64)
        self.row = self.first = self.n = self.anchor = z
        if len(data) < length:
            return
        at = np.arange(len(data) - gram + 1)
        value = span_hash(self.h, at, at + gram)
        low = np.uint64((1 << 30) - 1)  # pieces stay far below 2**30 bytes; leftmost wins a tie
        smallest = _window_min((value & ~low) | at.astype(np.uint64), length - gram + 1)
        long = np.flatnonzero(self.piece.size >= length)
        many = self.piece.size[long] - length + 1
        window = np.repeat(self.piece.start[long], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        anchor = (smallest[window] & low).astype(np.int64)
        new = np.ones(len(window), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
        begin = np.flatnonzero(new)
        self.first, self.n, self.anchor = window[begin], np.diff(np.append(begin, len(window))), anchor[begin]
        self.row = self.piece.row_of(self.first)

    def digest(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return mix(span_hash(self.h, start, end) + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _units(rid: pa.Array, a: _Anchored, row: np.ndarray, start: np.ndarray, n: np.ndarray, core: np.ndarray, ctx: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([rid.take(pa.array(row)), pa.array((start - a.piece.start[row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(core), pa.array(ctx)], names=["rid", "start", "n", "core", "ctx"])


def _runs(docs: DataFrame, words: bool, length: int, gram: int) -> DataFrame:
    """Every run of windows that share an anchor: core is the anchor's gram, ctx all bytes of the run's windows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a = _Anchored(batch.column("_text"), words, length, gram)
        core = a.digest(a.anchor, a.anchor + gram, np.zeros(len(a.n)))
        ctx = a.digest(a.first, a.first + a.n - 1 + length, a.anchor - a.first)
        return _units(batch.column("rid"), a, a.row, a.first, a.n, core, ctx)

    return map_pieces(docs, "_text", run, _UNITS, PIECE_BYTES)


def _wanted_runs(batch: pa.RecordBatch, words: bool, length: int, gram: int) -> tuple[_Anchored, np.ndarray]:
    """The piece's runs and which of them start at a place listed in the column `want`."""
    a = _Anchored(batch.column("_text"), words, length, gram)
    want = batch.column("want")
    flat = np.asarray(want.flatten(), np.int64)
    row = np.repeat(np.arange(batch.num_rows), np.asarray([len(x) for x in want], np.int64))
    return a, np.isin(a.first, a.piece.start[row] + flat)


def _cells(docs: DataFrame, words: bool, length: int, gram: int, cell: int) -> DataFrame:
    """Wanted runs cut into cells at fixed distances from the anchor; core is what all windows of a cell share."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, use = _wanted_runs(batch, words, length, gram)
        first, n, anchor, row = a.first[use], a.n[use], a.anchor[use], a.row[use]
        far, near = (anchor - first) // cell, (anchor - first - n + 1) // cell
        many = far - near + 1
        number = np.repeat(near, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        first, n, anchor, row = (np.repeat(x, many) for x in (first, n, anchor, row))
        lowest, highest = anchor - number * cell - cell + 1, anchor - number * cell
        text_start, text_end = a.piece.start[row], a.piece.end[row]
        left, right = np.maximum(lowest, text_start), np.minimum(highest + length, text_end)
        core = a.digest(highest, np.maximum(lowest + length, highest), number)
        ctx = a.digest(left, right, number * 4096 + (left - lowest) * 64 + (highest + length - right))
        start = np.maximum(lowest, first)
        return _units(batch.column("rid"), a, row, start, np.minimum(highest, first + n - 1) - start + 1, core, ctx)

    return map_pieces(docs, "_text", run, _UNITS, PIECE_BYTES)


def _windows(docs: DataFrame, words: bool, length: int) -> DataFrame:
    """Single windows of the listed cells: each shard's suffixes are mergesorted and equal ones share a verified digest."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        piece, want = _Symbols(batch.column("_text"), words), batch.column("want")
        cells = np.asarray([len(x) for x in want], np.int64)
        flat = want.flatten()
        start, n = np.asarray(flat.field("start"), np.int64), np.asarray(flat.field("n"), np.int64)
        row = np.repeat(np.repeat(np.arange(batch.num_rows), cells), n)
        pos = piece.start[row] + np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pos, at = np.unique(pos, return_index=True)
        row = row[at]
        order, lcp = Suffixes(piece.data, length).sort(pos)
        first = np.maximum.accumulate(np.where(lcp < length, np.arange(len(order)), 0)) if len(order) else order
        h = prefix_hash(piece.data)
        digest = span_hash(h, order[first], order[first] + length).view(np.int64) if len(order) else order
        row = row[np.searchsorted(pos, order)]
        return pa.RecordBatch.from_arrays([batch.column("rid").take(pa.array(row)), pa.array((order - piece.start[row]).astype(np.int32)), pa.array(np.ones(len(order), np.int32)), pa.array(digest), pa.array(digest)], names=["rid", "start", "n", "core", "ctx"])

    return map_pieces(docs, "_text", run, _UNITS, PIECE_BYTES)


# --- settling -------------------------------------------------------------------------------------------------


def _settle(units: DataFrame, across: bool) -> tuple[DataFrame, DataFrame]:
    """(repeated, open): tables of the units whose ctx occurs again, and of those that a finer look must compare.

    A unit whose core occurs once is unique, and only the others are looked at
    again.  One whose core occurs again but not its ctx is open, and so is one
    unit for each repeated ctx of that core.  With `across`, occurrences in one
    text count once, and units of two texts are open for each repeated ctx.
    """
    many = [F.count(F.lit(1)).alias("c"), *([F.min("rid").alias("r0"), F.max("rid").alias("r1")] if across else [])]
    again, mark = "r0 < r1" if across else "c > 1", F.xxhash64("rid", "start")
    cores = units.groupBy("core").agg(*many, F.min("ctx").alias("c0"), F.max("ctx").alias("c1")).where(again)
    held = cut(units.join(cores.select("core", (F.col("c0") == F.col("c1")).alias("same")), "core"))
    rest = held.where("not same").drop("same")
    kinds = rest.groupBy("core", "ctx").agg(*many, F.min(mark).alias("pick")).withColumn("again", F.expr(again))
    alone = kinds.groupBy("core").agg(F.max(~F.col("again")).alias("alone"))
    known = cut(rest.join(kinds.join(alone, "core"), ["core", "ctx"]))
    place = ["rid", "start", "n"]
    repeated = cut(held.where("same").select(*place).unionByName(known.where("again").select(*place)))
    picked = (F.col("rid") == F.col("r0")) | (F.col("rid") == F.col("r1")) if across else F.col("pick") == mark
    open_ = cut(known.where(~F.col("again") | (F.col("alone") & picked)).select(*place))
    forget(held, known, units)
    return repeated, open_


def _with_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """docs joined with per-row lists; rows without a list are left out early if their ids are few enough to broadcast."""
    lists = cut(lists)
    ids = lists.select("rid")
    if few(ids):
        docs = docs.join(F.broadcast(ids), "rid", "left_semi")
    return docs.join(lists, "rid")


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, cell: int = CELL, words: bool = False) -> DataFrame:
    """(rid, start, n): runs of window starts whose windows occur again; rid hashes key and text.

    Windows are of bytes and may occur again in the same text, or with `words`
    of words, and must occur in another text.
    """
    src = _keyed(docs, key, text)
    full, open_ = _settle(cut(_runs(src, words, length, gram)), words)
    near = cut(_with_lists(src, open_.groupBy("rid").agg(F.collect_set("start").alias("want"))))
    more, open_ = _settle(cut(_cells(near, words, length, gram, cell)), words)
    fine = cut(near.select("rid", "_text").join(cut(open_.groupBy("rid").agg(F.collect_set(F.struct("start", "n")).alias("want"))), "rid"))
    forget(near)
    last, _ = _settle(cut(_windows(fine, words, length)), words)
    forget(fine)
    return full.unionByName(more).unionByName(last)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("rid"), F.col(text).alias("_text"))


def _covered(symbols: _Symbols, marks: pa.Array, length: int) -> np.ndarray:
    """Which symbols lie in a window that the lists of marks name."""
    count = np.asarray([len(x) for x in marks], np.int64)
    flat = marks.flatten()
    row = np.repeat(np.arange(len(marks)), count)
    start = symbols.start[row] + np.asarray(flat.field("start"), np.int64)
    change = np.zeros(len(symbols.data) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + np.asarray(flat.field("n"), np.int64) - 1 + length, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, with_text: bool = False, words: int = WORDS) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words, shared_passage (and kept: the remaining bytes) of every text.

    Matches never cross texts and are judged on the input.  Null counts as
    empty; texts shorter than `length` keep every byte.  Rows that repeat key
    and text are occurrences of their own and get equal results.
    n_shared_words counts the words (lower-cased runs of digits, letters and all
    beyond ASCII) in passages of `words` words that another text holds as well;
    it decides nothing about what is removed.
    """
    kind = docs.schema[key].dataType.simpleString()
    found = repeated_windows(docs, key, text, length, gram).select("rid", F.struct("start", "n").alias("b"), F.lit(None).cast("struct<start:int,n:int>").alias("w"))
    shared = repeated_windows(docs, key, text, words, WORD_GRAM, WORD_CELL, True).select("rid", F.lit(None).cast("struct<start:int,n:int>").alias("b"), F.struct("start", "n").alias("w"))
    marks = cut(found.unionByName(shared).groupBy("rid").agg(F.collect_list("b").alias("marks"), F.collect_list("w").alias("word_marks")))
    src = docs.select(F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("rid"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    empty = F.array().cast("array<struct<start:int,n:int>>")
    ids = marks.select("rid")
    lists = ("marks", "word_marks")
    if few(ids):
        near = F.broadcast(ids)
        both = src.join(near, "rid", "left_anti").select("_key", "_text", *[empty.alias(c) for c in lists]).unionByName(src.join(near, "rid", "left_semi").join(marks, "rid").select("_key", "_text", *lists))
    else:
        both = src.join(marks, "rid", "left").select("_key", "_text", *[F.coalesce(c, empty).alias(c) for c in lists])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("_text")
        piece = _Symbols(column, False)
        gone = _covered(piece, batch.column("marks"), length)
        n_shared = np.zeros(batch.num_rows, np.int64)
        marked = np.flatnonzero([len(x) > 0 for x in batch.column("word_marks")])
        if len(marked):
            of = _Symbols(column.take(pa.array(marked)), True)
            total = np.concatenate(([0], np.cumsum(_covered(of, batch.column("word_marks").take(pa.array(marked)), words))))
            n_shared[marked] = total[of.end] - total[of.start]
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        out = []
        for s, e in zip(piece.start.tolist(), piece.end.tolist()):
            kept = piece.data[s:e][~gone[s:e]].tobytes()
            out.append((e - s, int(gone[s:e].sum()), int(edge[s:e].sum()), hashlib.sha256(kept).hexdigest(), kept))
        names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words", "shared_passage"] + ["kept"] * with_text
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        columns = [pa.array([x[i] for x in out], kinds[i]) for i in range(5)]
        return pa.RecordBatch.from_arrays([batch.column("_key"), *columns[:4], pa.array(n_shared), pa.array(n_shared > 0), *columns[4:][: len(names) - 7]], names=names)

    return map_pieces(both, "_text", run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long, shared_passage boolean" + ", kept binary" * with_text, PIECE_BYTES)
