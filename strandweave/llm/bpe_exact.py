"""Exact BPE by backtracking, in time linear in the word.

An Aho-Corasick automaton gives the longest token that starts at each byte.  The
encoder goes from left to right with the longest token whose pair with the token
before is compatible, tries that token's shorter prefixes otherwise, and steps
back where none fits; a byte from which no way leads on is never entered again.
Two tokens are compatible if merging in rank order leaves the border between
them, so a chain of compatible neighbours is what the merges give.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bpe
from ._text import map_pieces, spread

#: Pairs whose compatibility is kept, and distinct words kept between pieces, by one Python worker.
KEPT_PAIRS, KEPT_WORDS = 1 << 20, 800_000
#: Text of one map call.
PIECE = 1 << 20

# Ranges of letters and numbers of later Unicode versions than the one that the splitting pattern stands for.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


def public_pattern() -> str:
    """The pattern by which vocabulary files of this kind split texts into words."""
    return r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _split_pattern(later: str) -> str:
    """The same with some letters and numbers taken for other signs; it is slower."""
    letter, number, other = rf"[\p{{L}}--[{later}]]", rf"[\p{{N}}--[{later}]]", rf"[[^\s\p{{L}}\p{{N}}]||[{later}]]"
    return rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable Latin-1 for itself, the others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Tokens:
    """A vocabulary: bytes of each id as one array with offsets, merges, the automaton of tokens that merging can give."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]], added: dict[str, int]):
        import ahocorasick

        self.added = added
        texts = {i: t for t, i in tokens.items()} | {i: t.encode() for t, i in added.items()}
        laid = [texts.get(i, b"") for i in range(max(texts) + 1)]
        self.base = len(laid)  # a pair of ids is left * base + right
        self.merged: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            left, right, whole = tokens[a], tokens[b], tokens[a + b]
            if whole in self.rank or any(len(x) > 1 and tokens[x] not in self.rank for x in (a, b)):
                raise ValueError("every token must have one merge, of tokens that were merged before it")
            self.merged[left * self.base + right] = self.rank[whole] = r
            self.halves[whole] = left, right
        if not all(bytes([b]) in tokens for b in range(256)):
            raise ValueError("every single byte must be a token")
        self.size = [len(t) for t in laid]
        #: Decoding table: token i is data[offset[i]:offset[i + 1]].
        self.offset = np.concatenate(([0], np.cumsum(self.size))).astype(np.int64)
        self.data = np.frombuffer(b"".join(laid), np.uint8)
        self.pairs: dict[int, bool] = {}
        # Tokens that merging their own bytes gives; no other can be in a result.
        reached = {i for t, i in tokens.items() if len(t) == 1}
        for whole, (left, right) in self.halves.items():
            if left in reached and right in reached and self._border_holds(left, right, self.rank[whole]):
                reached.add(whole)
        used = {texts[i]: i for i in reached}
        self.find = ahocorasick.Automaton()
        for t, i in used.items():
            self.find.add_word(t.decode("latin-1"), i)
        self.find.make_automaton()
        #: The longest shorter token that begins a token, or -1.
        self.shorter = {i: next((used[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in used), -1) for t, i in used.items()}

    def _border_holds(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether merging the bytes of two tokens side by side, by ranks below `before`, never merges across their border.

        Undoing merges from the last to the first shows every two pieces that meet at
        the border.  They merge if their rank is below that of the merge that either
        goes into next; at equal ranks the place further left is first.
        """
        rank, halves, merged, base = self.rank, self.halves, self.merged, self.base
        next_left = next_right = len(rank) if before is None else before
        while True:
            r = merged.get(left * base + right)
            if r is not None and r < next_left and r <= next_right:
                return False
            of_left, of_right = rank.get(left, -1), rank.get(right, -1)
            if of_left > of_right:
                next_left, left = of_left, halves[left][1]
            elif of_right >= 0:
                next_right, right = of_right, halves[right][0]
            else:
                return True

    @classmethod
    def read(cls, path: str) -> Tokens:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE files are read")
        of = byte_letters()
        raw = lambda t: bytes(map(of.__getitem__, t))
        added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        tokens = {raw(t): i for t, i in model["vocab"].items() if t not in added}
        return cls(tokens, [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]], added)

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word."""
        n, base = len(word), self.base
        longest, shorter, size, pairs = [-1] * n, self.shorter, self.size, self.pairs
        for end, token in self.find.iter(word.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # ends rise, so the longest stays
        dead = bytearray(n + 1)
        out: list[int] = []
        pos, last, token = 0, -1, longest[0] if n else -1
        while pos < n:
            while token >= 0:
                if not dead[pos + size[token]]:
                    if last < 0:
                        break
                    fits = pairs.get(last * base + token)
                    if fits is None:
                        if len(pairs) >= KEPT_PAIRS:
                            pairs.clear()
                        fits = pairs[last * base + token] = self._border_holds(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos, last = pos + size[token], token
                token = longest[pos] if pos < n else -1
            else:
                dead[pos] = 1
                token = out.pop()
                pos, last = pos - size[token], out[-1] if out else -1
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one's after another's, and their number for each; an added token is itself."""
        added = {t.encode(): [i] for t, i in self.added.items()}
        ids = [added.get(w) or self.encode_word(w) for w in words]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        at = self.offset[ids]
        return self.data[spread(at, self.offset[ids + 1] - at)].tobytes()


@lru_cache(4)
def load_tokens(path: str) -> Tokens:
    return Tokens.read(path)


class Encoder(bpe.Encoder):
    """Cuts texts at added tokens and by the pattern; distinct words are encoded once and kept within a bound."""

    def __init__(self, tokens: Tokens):
        import regex

        super().__init__(tokens, public_pattern())
        self.tokens, self._plain = tokens, self.find
        later = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in LATER)
        self._careful = regex.compile(_split_pattern(later)).findall
        self._may_have_later = re.compile(f"[{chr(LATER[0][0])}-{chr(0x10FFFF)}]").search
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(tokens.added, key=len, reverse=True))) + ")").split if tokens.added else lambda t: [t]
        self.find = self._words

    def _forget(self) -> None:
        if not hasattr(self, "number") or len(self.number) > KEPT_WORDS:
            super()._forget()

    def _words(self, text: str) -> list[str]:
        split = self._plain if text.isascii() or not self._may_have_later(text) else self._careful
        parts = self._cut(text)
        if len(parts) == 1:
            return split(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else split(part))]


@lru_cache(4)
def _here(path: str) -> Encoder:
    return Encoder(load_tokens(path))


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """docs with `out`: array<int> of ids (null text: no ids). No shuffle; the vocabulary file must be on every machine."""
    names = [c for c in docs.columns if c != out]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [x.astype(np.int32) for x in _here(path).encode_batch(batch.column(text).to_pylist())]
        at = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=[*names, out])

    return map_pieces(docs.select(*names), text, run, docs.select(*names).schema.add(out, T.ArrayType(T.IntegerType())), PIECE)


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with `out`: the text of an array of ids (null: empty), bytes that are no UTF-8 replaced. No shuffle."""
    names = [c for c in df.columns if c != out]

    def run(batches):
        of = load_tokens(path).decode
        for batch in batches:
            texts = [of(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string())], names=[*names, out])

    return df.select(*names).mapInArrow(run, df.select(*names).schema.add(out, "string"))


def token_digest(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens and digests of the ids and of the text that decoding them gives.

    One row per input row, in any order; null and empty texts have no tokens and
    the digests of no bytes.  Added tokens in a text are those tokens.  Other
    columns are not looked at.  One pass, no shuffle.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = _here(path)
        ids = enc.encode_batch(batch.column("_text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(enc.tokens.decode(x).decode("utf-8", "replace").encode()).hexdigest() for x in ids], pa.string()),
            ],
            names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    schema = docs.select(key).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return map_pieces(docs.select(key, docs[text].alias("_text")), "_text", run, schema, PIECE)
