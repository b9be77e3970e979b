"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models; each later model
also sees the probabilities of the earlier ones.  In training those are
out-of-fold predictions, so a later model never learns from an earlier one's
memory of its own rows.  Fitting uses a bounded sample of labelled rows;
scoring covers every whole text in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import cut, forget
from ._text import ALNUM, Piece, map_pieces

#: Labelled rows that are fitted on at most, folds, word features of a model at most and how far from chance a word must be.
SAMPLE_ROWS, FOLDS, WORDS, Z = 12_000, 5, 64, 6.0
CATEGORIES = ("quality", "toxic")
_DENSE = 5
#: Text bytes whose words' features are worked on at once.
PIECE_BYTES = 1 << 20


def _piece_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, word hash) pairs in order, and dense features of each row."""
    piece, n = Piece(column), len(column)
    start, end, row = piece.words(ALNUM)
    h = piece.word_hashes(start, end)
    order = np.lexsort((h, row))
    row_, h_ = row[order], h[order]
    new = np.ones(len(h_), bool)
    new[1:] = (row_[1:] != row_[:-1]) | (h_[1:] != h_[:-1])
    row_, h_ = row_[new], h_[new]
    words = np.bincount(row, minlength=n).astype(float)
    inside = np.bincount(row, weights=(end - start).astype(float), minlength=n)
    digits = np.concatenate(([0], np.cumsum((piece.bytes >= 0x30) & (piece.bytes <= 0x39))))
    size = np.maximum(piece.size, 1).astype(float)
    dense = np.stack(
        [
            np.log1p(words),
            np.divide(inside, words, out=np.zeros(n), where=words > 0) / 10,
            1 - inside / size,
            (digits[piece.end] - digits[piece.start]) / size,
            np.divide(np.bincount(row_, minlength=n), words, out=np.zeros(n), where=words > 0),
        ],
        1,
    )
    return row_, h_, dense


@dataclass
class Linear:
    """Logistic regression on chosen words, dense features and earlier probabilities."""

    words: np.ndarray
    weight: np.ndarray
    center: np.ndarray
    scale: np.ndarray

    def predict(self, row: np.ndarray, h: np.ndarray, other: np.ndarray) -> np.ndarray:
        z = np.c_[np.ones(len(other)), _scaled(other, self.center, self.scale)] @ self.weight[: 1 + other.shape[1]]
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            on = self.words[at] == h
            z = z + np.bincount(row[on], weights=self.weight[1 + other.shape[1] :][at[on]], minlength=len(other))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _scaled(x: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised and held within three deviations, so that odd texts (of no words, say) are not extrapolated to."""
    return np.clip((x - center) / scale, -3, 3)


def _z(a, b, n1, n0, sqrt):
    """How far apart the shares a / n1 and b / n0 are, in standard deviations (numbers, arrays or columns)."""
    p = (a + b + 1) / (n1 + n0 + 2)
    return (a / n1 - b / n0) / sqrt(p * (1 - p) * (1 / n1 + 1 / n0))


def choose_words(row: np.ndarray, h: np.ndarray, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The words that tell the rows of `use` (a mask) apart best: WORDS at most, Z standard deviations or more; sorted."""
    n1, n0 = int(y[use].sum()), int((~y[use]).sum())
    if not n1 or not n0:
        return np.zeros(0, np.uint64)
    inside = use[row]
    r, v = row[inside], h[inside]
    seen, code = np.unique(v, return_inverse=True)
    a = np.bincount(code, weights=y[r].astype(float), minlength=len(seen))
    z = _z(a, np.bincount(code, minlength=len(seen)) - a, n1, n0, np.sqrt)
    best = np.lexsort((seen.view(np.int64), -np.abs(z)))[:WORDS]
    return np.sort(seen[best[np.abs(z[best]) > Z]])


def _fit(row: np.ndarray, h: np.ndarray, other: np.ndarray, y: np.ndarray, use: np.ndarray, words: np.ndarray, ridge: float = 1.0) -> Linear:
    """Fit on the rows of `use` (a mask) and the chosen words, by Newton's method with a ridge penalty."""
    n1, n0 = int(y[use].sum()), int((~y[use]).sum())
    center, scale = other[use].mean(0) if use.any() else np.zeros(other.shape[1]), other[use].std(0) + 1e-6 if use.any() else np.ones(other.shape[1])
    if not n1 or not n0:  # one class only: a constant
        w = np.zeros(1 + other.shape[1])
        w[0] = 8.0 if n1 else -8.0
        return Linear(np.zeros(0, np.uint64), w, center, scale)
    x = np.zeros((len(y), len(words)))
    if len(words):
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        on = words[at] == h
        x[row[on], at[on]] = 1
    m = np.c_[np.ones(len(y)), _scaled(other, center, scale), x][use]
    t, w, penalty = y[use].astype(float), np.zeros(m.shape[1]), np.full(m.shape[1], ridge)
    penalty[0] = 1e-6
    penalty[1 + other.shape[1] :] = 0.1
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve((m * (q * (1 - q))[:, None]).T @ m + np.diag(penalty), m.T @ (t - q) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return Linear(words, w, center, scale)


@dataclass
class Chain:
    """Models of the categories, in order."""

    categories: tuple[str, ...]
    models: list[Linear]

    def predict(self, column: pa.Array) -> np.ndarray:
        """Rows x categories probabilities; null and empty texts have features of no words."""
        row, h, other = _piece_features(column)
        out = []
        for model in self.models:
            p = model.predict(row, h, other)
            out.append(p)
            other = np.c_[other, p]
        return np.stack(out, 1) if out else np.zeros((len(column), 0))


def fit_rows(row: np.ndarray, h: np.ndarray, dense: np.ndarray, labels: np.ndarray, fold: np.ndarray, categories: tuple[str, ...], words: dict | None = None) -> Chain:
    """Fit the chain; `fold` deals rows to FOLDS parts for the out-of-fold probabilities.

    (row, h) are the words of each row.  `words` has the chosen words of each
    category and fold left out (-1: none); they are chosen here if it is None.
    """
    models, other, every = [], dense, np.ones(len(dense), bool)
    for k in range(len(categories)):
        y = labels[:, k].astype(bool)
        chosen = lambda f, use: choose_words(row, h, y, use) if words is None else words[k, f]  # noqa: B023, E731
        models.append(_fit(row, h, other, y, every, chosen(-1, every)))
        held = np.zeros(len(y))
        for f in range(FOLDS):
            use = fold != f
            if use.any() and not use.all():
                held[~use] = _fit(row, h, other, y, use, chosen(f, use)).predict(row, h, other)[~use]
        other = np.c_[other, held]
    return Chain(tuple(categories), models)


def _sample(docs: DataFrame, labels: DataFrame, flags: dict[str, str], key: str, text: str, max_rows: int) -> DataFrame:
    """(_key, _order, fold, labels, h, dense) of at most max_rows labelled documents, one for each key."""
    want = labels.select(F.col(key).alias("_key"), *[F.col(c).cast("int").alias(a) for a, c in flags.items()]).dropna()
    want = want.groupBy("_key").agg(*[F.max(a).alias(a) for a in flags]).withColumn("_order", F.xxhash64("_key")).orderBy("_order", "_key").limit(max_rows)
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text")).join(F.broadcast(want), "_key")
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, h, dense = _piece_features(batch.column("_text"))
        at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64))), pa.FixedSizeListArray.from_arrays(pa.array(dense.ravel()), _DENSE).cast(pa.list_(pa.float64()))]
        same = ["_key", "_hash", "_order", *flags]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in same], *lists], names=[*same, "h", "dense"])

    schema = f"_key {kind}, _hash long, _order long, " + ", ".join(f"{a} int" for a in flags) + ", h array<long>, dense array<double>"
    found = map_pieces(rows.select("_key", "_hash", "_order", *flags, "_text"), "_text", run, schema, PIECE_BYTES)
    one = found.groupBy("_key").agg(F.min_by(F.struct("_order", *flags, "h", "dense"), "_hash").alias("x"))
    return one.select("_key", "x.*").withColumn("fold", F.pmod("_order", F.lit(FOLDS)).cast("int"))


def _chosen(sample: DataFrame, flags: list[str]) -> dict:
    """The chosen words of each category and fold left out, counted by a shuffled aggregation; WORDS rows a model come to the driver."""
    parts = [(k, f) for k in range(len(flags)) for f in (-1, *range(FOLDS))]
    of = lambda f: F.col("fold") != f
    sizes = sample.agg(*[F.coalesce(F.sum(F.when(of(f) & (F.col(flags[k]) > 0), 1).otherwise(0)), F.lit(0)).alias(f"p{i}") for i, (k, f) in enumerate(parts)], *[F.coalesce(F.sum(F.when(of(f), 1).otherwise(0)), F.lit(0)).alias(f"n{i}") for i, (k, f) in enumerate(parts)]).first()
    word = sample.select("fold", *flags, F.explode("h").alias("h"))
    held = [F.sum(F.when(F.col("fold") == f, 1).otherwise(0)).alias(f"n{f}") for f in range(FOLDS)]
    held += [F.sum(F.when((F.col("fold") == f) & (F.col(a) > 0), 1).otherwise(0)).alias(f"p{k}_{f}") for k, a in enumerate(flags) for f in range(FOLDS)]
    counts = cut(word.groupBy("h").agg(*held))
    out = {part: np.zeros(0, np.uint64) for part in parts}
    best = None
    for i, (k, f) in enumerate(parts):
        n1, n0 = sizes[f"p{i}"], sizes[f"n{i}"] - sizes[f"p{i}"]
        if not n1 or not n0:
            continue
        a = sum((F.col(f"p{k}_{g}") for g in range(FOLDS) if g != f), F.lit(0)).cast("double")
        b = sum((F.col(f"n{g}") for g in range(FOLDS) if g != f), F.lit(0)).cast("double") - a
        top = counts.select(F.lit(i).alias("part"), "h", F.abs(_z(a, b, n1, n0, F.sqrt)).alias("z")).where(F.col("z") > Z).orderBy(F.desc("z"), "h").limit(WORDS)
        best = top if best is None else best.unionByName(top)
    if best is not None:
        rows = best.collect()
        for i, part in enumerate(parts):
            out[part] = np.sort(np.array([r["h"] for r in rows if r["part"] == i], np.int64).view(np.uint64))
    forget(counts)
    return out


def train_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, key: str = "doc_id", text: str = "text", max_rows: int = SAMPLE_ROWS) -> Chain:
    """Fit on at most `max_rows` labelled documents, chosen by the hash of their key.

    Rows without a key or with a null label are left out; of repeated labels the
    larger counts; of documents that share a key the one with the smallest text
    hash counts.  Without labelled rows every probability is near 0.  Words are
    counted and chosen on the executors: the driver receives WORDS words a model,
    and of each sampled row its labels, dense features and chosen words.
    """
    flags = {f"_y{i}": c for i, c in enumerate(categories)}
    sample = cut(_sample(docs, labels, flags, key, text, max_rows))
    words = _chosen(sample, list(flags))
    every = np.unique(np.concatenate([*words.values(), np.zeros(0, np.uint64)])).astype(np.uint64)
    ours = F.array(*[F.lit(int(x)).cast("long") for x in every.view(np.int64)]) if len(every) else F.array().cast("array<long>")
    got = sample.select("_order", *flags, F.array_intersect("h", ours).alias("h"), "dense").toArrow().combine_chunks()
    got = got.take(pa.array(np.argsort(got.column("_order").to_numpy(), kind="stable")))
    forget(sample)
    n = got.num_rows
    size = np.array([len(x) for x in got.column("h")], np.int64)
    h = np.concatenate([np.asarray(x.values) for x in got.column("h")] or [np.zeros(0, np.int64)]).astype(np.int64).view(np.uint64)
    dense = np.array(got.column("dense").to_pylist(), float).reshape(n, _DENSE)
    y = np.stack([got.column(a).to_numpy() > 0 for a in flags], 1) if n else np.zeros((0, len(flags)), bool)
    fold = got.column("_order").to_numpy() % FOLDS if n else np.zeros(0, np.int64)
    return fit_rows(np.repeat(np.arange(n), size), h, dense, y, fold, categories, words)


def score(docs: DataFrame, chain: Chain, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with p_<category> for each category and toxic (the last category's probability reaches the threshold).

    Whole texts, one pass, no shuffle; null and empty texts are scored as texts
    without words.  Columns of the input that clash with the added ones are replaced.
    """
    added = [f"p_{c}" for c in chain.categories]
    names = [c for c in docs.columns if c not in (*added, "toxic")]
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = shared.value.predict(batch.column(text))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(p[:, k]) for k in range(len(added))], pa.array(p[:, -1] >= threshold)], names=[*names, *added, "toxic"])

    schema = docs.select(*names).schema
    for c in added:
        schema = schema.add(c, "double")
    return map_pieces(docs.select(*names), text, run, schema.add("toxic", "boolean"), PIECE_BYTES)


def remove_toxic(docs: DataFrame, chain: Chain, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without those that the chain rejects; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(shared.value.predict(batch.column(text))[:, -1] < threshold))

    return map_pieces(docs, text, run, docs.schema, PIECE_BYTES)
