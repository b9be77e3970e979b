"""Hidden Markov language model trained with Baum-Welch over partitions.

Tokens are emitted through symbols: each of the most frequent words is a symbol
of its own, every other word belongs to the symbol of its ending, within which it
has its smoothed relative frequency.  Latent states emit symbols.  Expected counts
are computed per partition by the scaled forward-backward recursion, summed by a
shuffled aggregation, and re-estimate the states; the scaled forward recursion
then gives the exact probability of every whole text.

Word statistics cover all training texts: counts of frequent words travel as a
table of bounded size, those of all other words by a shuffled join.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import cut
from ._text import NOT_SPACE, Piece, map_pieces, mix, small_batches

#: Latent states, rounds of Baum-Welch, words with a symbol of their own, symbols of endings.
STATES, ROUNDS, OWN, ENDINGS = 8, 3, 4096, 1024
#: Counts sent to every worker at most (16 bytes each), tokens that a task runs the recursion on at once.
FREQUENT, TOKENS = 1 << 17, 1_200_000
END = np.uint64(0x1DE5D0F1E57)  # the end token's place among word hashes
SYMBOLS = OWN + ENDINGS + 1


def is_held_out(key: object) -> bool:
    """crc32 of the key as text modulo 7 is 2; no key: the empty text."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % 7 == 2


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and ending class of every token in order, with each text's end token (class ENDINGS)."""
    piece, n = Piece(column), len(column)
    start, end, row = piece.words(NOT_SPACE)
    h = piece.word_hashes(start, end)
    size, low = end - start, piece.lower.astype(np.uint64)
    ending = np.zeros(len(h), np.uint64)
    for back in (1, 2, 3):
        ending = ending << np.uint64(8) | np.where(size >= back, low[np.maximum(end - back, 0)], np.uint64(0))
    ending = (mix(ending) % np.uint64(ENDINGS)).astype(np.int64)
    at = np.searchsorted(row, np.arange(1, n + 1))  # after each text's last word
    return np.insert(row, at, np.arange(n)), np.insert(h, at, END), np.insert(ending, at, ENDINGS)


def word_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(h, ending, c) of the training texts' tokens: summed per piece, then by a shuffled aggregation."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        train = np.array([not is_held_out(k) for k in batch.column(0).to_pylist()], bool)
        row, h, ending = _tokens(batch.column(1))
        use = train[row]
        seen, at, c = np.unique(h[use], return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(ending[use][at].astype(np.int32)), pa.array(c.astype(np.int64))], names=["h", "ending", "c"])

    parts = map_pieces(docs.select(key, text), text, run, "h long, ending int, c long")
    return parts.groupBy("h").agg(F.max("ending").alias("ending"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What every worker knows: counts and symbols of the frequent words, mass of each ending's class, totals."""

    h: np.ndarray
    log_count: np.ndarray
    symbol: np.ndarray
    log_mass: np.ndarray
    unigram: np.ndarray
    tokens: int
    distinct: int

    @classmethod
    def build(cls, counts: DataFrame) -> Vocabulary:
        """From the table of all counts; the driver gets FREQUENT words at most, chosen by a count threshold."""
        level = F.floor(8 * F.log2("c")).cast("int")
        steps = counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).orderBy(F.desc("l")).collect()
        tokens, distinct, have, lowest = sum(r.n for r in steps), sum(r.v for r in steps), 0, None
        for r in steps:
            if have + r.v > FREQUENT:
                break
            have, lowest = have + r.v, r.l
        frequent = counts.where(level >= (1 << 30 if lowest is None else lowest)).select("h", "ending", "c").toArrow()
        h, ending, c = (frequent.column(k).to_numpy() for k in ("h", "ending", "c"))
        h = h.view(np.uint64)
        order = np.argsort(h)
        h, ending, c = h[order], ending[order].astype(np.int64), c[order].astype(np.int64)
        symbol = OWN + ending
        top = np.lexsort((h, -c))
        top = top[ending[top] != ENDINGS][:OWN]
        symbol[top] = np.arange(len(top))
        mass = np.ones(SYMBOLS)  # one place in each class for words never seen
        for r in counts.groupBy("ending").agg(F.sum(F.col("c") + 1).alias("m")).collect():
            mass[OWN + r.ending] += r.m
        np.subtract.at(mass, OWN + ending[top], c[top] + 1)
        mass[:OWN] = 0
        mass[: len(top)] = c[top] + 1
        mass[OWN + ENDINGS] = mass[OWN + ENDINGS] or 1
        return cls(h, np.log10(c + 1.0), symbol, np.log10(np.maximum(mass, 1)), mass / mass.sum(), int(tokens), int(distinct))


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str, text: str) -> DataFrame:
    """One row per text: symbols as 16-bit numbers, sums over its frequent words and the hashes of its other words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        v, n = shared.value, batch.num_rows
        row, h, ending = _tokens(batch.column("_text"))
        at = np.minimum(np.searchsorted(v.h, h), max(len(v.h) - 1, 0))
        known = v.h[at] == h if len(v.h) else np.zeros(len(h), bool)
        symbol = OWN + ending
        symbol[known] = v.symbol[at[known]]
        logs = np.zeros(len(h))
        logs[known] = v.log_count[at[known]]
        classed = (symbol >= OWN) & (symbol < OWN + ENDINGS)
        size = np.bincount(row, minlength=n)
        ends = np.concatenate(([0], np.cumsum(size)))
        packed = symbol.astype("<u2").tobytes()
        rare = ~known
        rare_at = np.concatenate(([0], np.cumsum(np.bincount(row[rare], minlength=n)))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                batch.column(key),
                pa.array([is_held_out(k) for k in batch.column(key).to_pylist()], pa.bool_()),
                pa.array(size, pa.int64()),
                pa.array(np.bincount(row, weights=known, minlength=n).astype(np.int64)),
                pa.array(np.bincount(row, weights=logs, minlength=n)),
                pa.array(np.bincount(row, weights=np.where(classed, logs - v.log_mass[symbol], 0.0), minlength=n)),
                pa.array([packed[2 * a : 2 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary()),
                pa.ListArray.from_arrays(pa.array(rare_at), pa.array(h[rare].view(np.int64))),
            ],
            names=["row", key, "held_out", "n_tokens", "n_frequent", "log_frequent", "log_classed", "symbols", "rare"],
        )

    src = docs.select(F.monotonically_increasing_id().alias("row"), key, F.col(text).alias("_text"))
    return map_pieces(src, "_text", run, f"row long, `{key}` {kind}, held_out boolean, n_tokens long, n_frequent long, log_frequent double, log_classed double, symbols binary, rare array<long>")


@dataclass
class Model:
    """Start, transition and emission probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states

    @classmethod
    def first(cls, unigram: np.ndarray, states: int = STATES) -> Model:
        """Sticky states that lean, each in its own fixed way, away from the overall symbol frequencies."""
        move = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
        code = mix(np.arange(len(unigram) * states, dtype=np.uint64) + np.uint64(17)).reshape(len(unigram), states)
        emit = unigram[:, None] * np.where(code & np.uint64(1), 1.5, 0.5)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> Model:
        """Smoothed re-estimates: no state rules any symbol out, so no text gets probability 0."""
        emit = emit + 1e-3 * emit.sum(0) * unigram[:, None] + 1e-6 * unigram[:, None]
        start, move = start + 1e-3, move + 1e-3
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


class _Batch:
    """Sequences side by side, longest first: at each step those that still run are the first rows."""

    def __init__(self, sequences: list[np.ndarray]):
        size = np.array([len(s) for s in sequences], np.int64)
        self.order = np.argsort(-size, kind="stable")
        size = size[self.order]
        longest = int(size[0]) if len(size) else 0
        self.active = np.searchsorted(-size, -np.arange(longest), "left")
        self.at = np.concatenate(([0], np.cumsum(self.active)))
        step = np.concatenate([np.arange(n) for n in size]) if len(size) else np.zeros(0, np.int64)
        rank = np.repeat(np.arange(len(size)), size)
        place = self.at[step] + rank
        self.x = np.zeros(len(place), np.int64)
        self.rank = np.zeros(len(place), np.int64)
        self.x[place] = np.concatenate([sequences[i] for i in self.order]) if len(size) else 0
        self.rank[place] = rank
        self.n = len(size)

    def forward(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward variables, scales and emissions of every step."""
        emit = model.emit.astype(np.float32)[self.x]
        alpha, scale = np.empty_like(emit), np.ones(len(self.x), np.float32)
        move, before = model.move.astype(np.float32), None
        for t, n in enumerate(self.active.tolist()):
            a, b = int(self.at[t]), int(self.at[t]) + n
            now = emit[a:b] * (model.start.astype(np.float32) if before is None else before[:n] @ move)
            c = now.sum(1)
            scale[a:b] = c
            now /= c[:, None]
            alpha[a:b] = now
            before = now
        return alpha, scale, emit

    def log_likelihood(self, scale: np.ndarray) -> np.ndarray:
        """Natural logarithm of each sequence's probability, in the order in which sequences were given."""
        out = np.zeros(self.n)
        out[self.order] = np.bincount(self.rank, weights=np.log(scale.astype(np.float64)), minlength=self.n)
        return out

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of starts, moves and emissions by the scaled forward-backward recursion."""
        alpha, scale, emit = self.forward(model)
        log_likelihood = float(np.log(scale.astype(np.float64)).sum())
        k = model.move.shape[0]
        moves, back = np.zeros((k, k)), np.ascontiguousarray(model.move.T.astype(np.float32))
        later = None  # emission times backward variable over scale, one step on
        for t in range(len(self.active) - 1, -1, -1):
            a, n = int(self.at[t]), int(self.active[t])
            here = alpha[a : a + n]
            beta = np.ones((n, k), np.float32)
            if later is not None:
                moves += here[: len(later)].T @ later
                beta[: len(later)] = later @ back
            later = emit[a : a + n] * beta / scale[a : a + n, None]
            here *= beta
        starts = alpha[: int(self.active[0])].sum(0, dtype=np.float64) if len(self.active) else np.zeros(k)
        emits = np.stack([np.bincount(self.x, weights=alpha[:, j], minlength=len(model.emit)) for j in range(k)], 1)
        return starts, moves * model.move, emits, log_likelihood


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2").astype(np.int64) for x in column.to_pylist()]


def expected_counts(encoded: DataFrame, model: Model) -> Model:
    """Baum-Welch counts of all training rows: one vector of fixed size per task, summed by cell."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    k, symbols = model.move.shape[0], len(model.emit)

    def run(batches):
        m, total, held, size = shared.value, np.zeros(k + k * k + symbols * k + 1), [], 0

        def work() -> None:
            if held:
                starts, moves, emits, ll = _Batch(held).expected(m)
                np.add(total, np.concatenate([starts, moves.ravel(), emits.ravel(), [ll]]), out=total)
                held.clear()

        for batch in batches:
            for s in _sequences(batch.column(0)):
                held.append(s)
                size += len(s)
                if size >= TOKENS:
                    work()
                    size = 0
        work()
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], names=["cell", "value"])

    small_batches(encoded)
    sums = encoded.where("not held_out").select("symbols").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(k + k * k + symbols * k + 1)
    out[sums.column("cell").to_numpy()] = sums.column("value").to_numpy()
    return Model(out[:k], out[k : k + k * k].reshape(k, k), out[k + k * k : -1].reshape(symbols, k))


def baum_welch(encoded: DataFrame, unigram: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """States trained on all training rows, `rounds` passes over them."""
    model = Model.first(unigram, states)
    for _ in range(rounds):
        c = expected_counts(encoded, model)
        model = Model.from_counts(c.start, c.move, c.emit, unigram)
    return model


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every text.

    Null and empty texts are one end token.  Rows that repeat a key are scored
    each by its own text; a null key counts as the empty text for the fold.  With
    no training rows all counts are 0.  An empty table gives no rows.  A key with
    the name of an added column is returned with `_key` after its name.
    """
    own = docs.select(F.col(key).alias("_key"), F.col(text).alias("_body"))
    counts = cut(word_counts(own, "_key", "_body"))
    v = Vocabulary.build(counts)
    encoded = cut(encode(own, v, "_key", "_body"))
    model = baum_welch(encoded, v.unigram, states, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            seqs, out, held, size, at = _sequences(batch.column("symbols")), [], [], 0, 0
            for s in seqs:
                held.append(s)
                size += len(s)
                if size >= TOKENS:
                    b = _Batch(held)
                    out.append(b.log_likelihood(b.forward(shared.value)[1]))
                    held, size = [], 0
            if held:
                b = _Batch(held)
                out.append(b.log_likelihood(b.forward(shared.value)[1]))
            ll = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(ll / np.log(10))], names=[*names, "log_symbols"])

    names = ["row", "_key", "held_out", "n_tokens", "n_frequent", "log_frequent", "log_classed"]
    plain = encoded.select(*names, "symbols")
    scored = plain.mapInArrow(run, encoded.select(*names).schema.add("log_symbols", "double"))
    # Words that the frequent table lacks: their count from the whole table, or 0.
    rare = encoded.select("row", F.explode("rare").alias("h")).join(counts.select("h", "c"), "h", "left")
    rare = rare.groupBy("row").agg(F.count("c").alias("n_rare"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("log_rare"))
    out = scored.join(rare, "row", "left")
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    added = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    return out.select(
        F.col("_key").alias(f"{key}_key" if key in added else key),
        "held_out",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("log_frequent") + log_rare - F.col("n_tokens") * F.lit(float(np.log10(v.tokens + v.distinct + 1)))).alias("base_score"),
        (F.col("log_symbols") + F.col("log_classed") + log_rare).alias("score"),
    )
