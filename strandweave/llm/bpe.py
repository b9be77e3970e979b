"""Byte-level BPE with a segment tree over byte positions.

A word's bytes are leaves of a binary tree; each live position holds the rank of
the pair that it forms with its live right neighbour, and each inner node the
leftmost smallest rank below it.  A merge reads the root, joins two neighbours
and updates three leaves, each in a logarithmic number of steps.  The trees of
many words are worked on side by side as rows of numpy arrays; few words of a
width, as very long ones are, are worked on one by one.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._text import map_pieces, spread

_NONE = np.int64(1) << np.int64(62)
#: Cells of the trees worked on at once, and distinct words kept between pieces by one Python worker.
CELLS, KEPT_WORDS = 1 << 20, 300_000
#: Words of one width that are worked on side by side at least; fewer are encoded one by one.
SIDE_BY_SIDE = 16


class Ranks:
    """Vocabulary of a rank file: bytes of each id, and the table of pairs that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.single < 0).any():
            raise ValueError("every single byte must have a rank")
        self.base = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    @classmethod
    def read(cls, path: str) -> Ranks:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(r) for a, r in (line.split() for line in f if line.strip())})

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's union, or _NONE."""
        if not len(self.keys):
            return np.full(len(a), _NONE)
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def _encode_block(self, raw: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids, one word's after another's, and their number, of words given as rows of `width` bytes, a power of two of at least 2."""
        n = len(size)
        ids = np.where(np.arange(width) < size[:, None], self.single[raw], 0)
        nxt = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        prv = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        live = np.arange(width) < size[:, None]
        # Leaves hold rank * width + position, so the smallest is the leftmost of the lowest rank.
        tree = np.full((n, 2 * width), _NONE)
        first = self.pair_rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        first[np.arange(1, width) >= size[:, None]] = _NONE
        tree[:, width : 2 * width - 1] = np.where(first < _NONE, first * width + np.arange(width - 1), _NONE)
        step = width
        while step > 1:
            tree[:, step // 2 : step] = np.minimum(tree[:, step : 2 * step : 2], tree[:, step + 1 : 2 * step : 2])
            step //= 2
        row = np.flatnonzero(tree[:, 1] < _NONE)
        while len(row):
            root = tree[row, 1]
            pos, rank = root % width, root // width
            gone = nxt[row, pos]
            after = nxt[row, gone]
            ids[row, pos] = rank
            live[row, gone] = False
            nxt[row, pos] = after
            inside = after < size[row]
            prv[row[inside], after[inside]] = pos[inside]
            before = prv[row, pos]
            right = np.full(len(row), _NONE)
            right[inside] = self.pair_rank(rank[inside], ids[row[inside], after[inside]])
            self._update(tree, row, gone, np.full(len(row), _NONE), width)
            self._update(tree, row, pos, np.where(right < _NONE, right * width + pos, _NONE), width)
            has = before >= 0
            if has.any():
                left = self.pair_rank(ids[row[has], before[has]], rank[has])
                self._update(tree, row[has], before[has], np.where(left < _NONE, left * width + before[has], _NONE), width)
            row = row[tree[row, 1] < _NONE]
        return ids[live], live.sum(1)

    @staticmethod
    def _update(tree: np.ndarray, row: np.ndarray, leaf: np.ndarray, value: np.ndarray, width: int) -> None:
        node = leaf + width
        tree[row, node] = value
        while width > 1:
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            width >>= 1

    def _encode_one(self, raw: bytes) -> np.ndarray:
        """Ids of one word of at least two bytes: the same tree in plain numbers, where an update ends at the first node that keeps its value."""
        n, none, get, base = len(raw), int(_NONE), self.pairs.get, self.base
        width = 1 << (n - 1).bit_length()
        known = self.single[np.frombuffer(raw, np.uint8)]
        whole = np.full(2 * width, _NONE)
        first = self.pair_rank(known[:-1], known[1:])
        whole[width : width + n - 1] = np.where(first < _NONE, first * width + np.arange(n - 1), _NONE)
        step = width
        while step > 1:
            whole[step // 2 : step] = np.minimum(whole[step : 2 * step : 2], whole[step + 1 : 2 * step : 2])
            step //= 2
        after_, before_ = np.arange(1, n + 1), np.arange(-1, n - 1)
        tree, ids, nxt, prv = whole.data, known.data, after_.data, before_.data

        def update(leaf: int, value: int) -> None:
            node = leaf + width
            tree[node] = value
            while node > 1:
                other, node = tree[node ^ 1], node >> 1
                if other < value:
                    value = other
                if tree[node] == value:
                    return
                tree[node] = value

        while tree[1] < none:
            rank, pos = divmod(tree[1], width)
            gone = nxt[pos]
            after, before = nxt[gone], prv[pos]
            ids[pos], ids[gone], nxt[pos] = rank, -1, after
            right = None
            if after < n:
                prv[after] = pos
                right = get(rank * base + ids[after])
            update(gone, none)
            update(pos, none if right is None else right * width + pos)
            if before >= 0:
                left = get(ids[before] * base + rank)
                update(before, none if left is None else left * width + before)
        return known[known >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one's after another's, and their number for each.

        A word that is a token of its own is that token, whatever the merges: such is the library's rule.
        """
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        size = np.array([len(w) for w in words], np.int64)
        count = np.where(whole >= 0, 1, 0)
        width = np.where((whole < 0) & (size > 0), 2 ** np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64), 0)
        done = []
        for w in np.unique(width[width > 0]).tolist():
            members, many = np.flatnonzero(width == w), max(1, CELLS // (4 * w))
            if min(len(members), many) < SIDE_BY_SIDE:
                for i in members.tolist():
                    ids = self._encode_one(words[i])
                    count[i] = len(ids)
                    done.append((np.array([i]), ids, count[i : i + 1]))
                continue
            for at in range(0, len(members), many):
                part = members[at : at + many]
                raw = np.frombuffer(b"".join([words[i].ljust(w, b"\0") for i in part.tolist()]), np.uint8).reshape(len(part), w)
                ids, n = self._encode_block(raw, size[part], w)
                count[part] = n
                done.append((part, ids, n))
        start = np.concatenate(([0], np.cumsum(count)))
        out = np.zeros(int(start[-1]), np.uint32)
        out[start[:-1][whole >= 0]] = whole[whole >= 0]
        for part, ids, n in done:
            out[spread(start[part], n)] = ids
        return out, count

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


@lru_cache(4)
def load_ranks(path: str) -> Ranks:
    return Ranks.read(path)


class Encoder:
    """Splits texts by a pattern and encodes each match; distinct words are encoded once and kept within a bound."""

    def __init__(self, ranks: Ranks, pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.number = _Numbers()
        self.flat, self.start, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.number) > KEPT_WORDS:
            self._forget()
        known, of, rows = len(self.number), self.number.__getitem__, []
        for t in texts:
            rows.append(np.array(list(map(of, self.find(t))) if t else [], np.int64))
        if len(self.number) > known:
            ids, count = self.ranks.encode_words([w.encode() for w in list(self.number)[known:]])
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(count) - count))
            self.count = np.concatenate((self.count, count))
            self.flat = np.concatenate((self.flat, ids))
        words = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        n = self.count[words]
        ids = self.flat[spread(self.start[words], n)]
        ends = np.cumsum(n)[np.cumsum([len(r) for r in rows]) - 1] if len(words) else np.zeros(len(rows), np.int64)
        done = np.concatenate(([0], np.where(np.cumsum([len(r) for r in rows]) > 0, ends, 0))) if rows else np.zeros(1, np.int64)
        return [ids[a:b] for a, b in zip(done[:-1].tolist(), done[1:].tolist())]


def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(load_ranks(path), pattern)


_encoders: dict[tuple[str, str], Encoder] = {}


def _here(path: str, pattern: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = _encoder(path, pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """docs with `out`: array<int> of ids (null text: no ids). No shuffle; the vocabulary file must be on every machine."""
    names = [c for c in docs.columns if c != out]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = _here(path, pattern).encode_batch(batch.column(text).to_pylist())
        at = np.zeros(len(ids) + 1, np.int32)
        at[1:] = np.cumsum([len(x) for x in ids])
        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=[*names, out])

    schema = docs.select(*names).schema.add(out, T.ArrayType(T.IntegerType()))
    return map_pieces(docs.select(*names), text, run, schema, 1 << 20)


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with `out`: the bytes of an array of ids as binary (null: empty). No shuffle."""
    names = [c for c in df.columns if c != out]

    def run(batches):
        of = load_ranks(path).decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array([of(x or []) for x in batch.column(ids).to_pylist()], pa.binary())], names=[*names, out])

    return df.select(*names).mapInArrow(run, df.select(*names).schema.add(out, "binary"))


def token_digest(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, kept columns, n_tokens and digests of the ids and of the bytes that decoding the ids gives.

    One row per input row; null and empty texts have no tokens and the digests
    of no bytes.  Kept columns that clash with the added ones are replaced.  One
    pass, no shuffle.
    """
    names = [key, *[c for c in keep if c not in ("n_tokens", "ids_sha256", "decoded_sha256")]]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = _here(path, pattern)
        ids = enc.encode_batch(batch.column("_text").to_pylist())
        of = enc.ranks.decode
        return pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in names],
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(of(x.tolist())).hexdigest() for x in ids], pa.string()),
            ],
            names=[*names, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    schema = docs.select(*names).schema
    for name, kind in (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")):
        schema = schema.add(name, kind)
    return map_pieces(docs.select(*names, docs[text].alias("_text")), "_text", run, schema, 1 << 20)
