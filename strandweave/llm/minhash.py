"""Near-duplicate groups from bottom-k sketches of word shingles.

One hash function orders all shingles; a document's sketch is its k smallest.
Inverted lists of the retained values generate candidate pairs, the estimate
from the union's sketch filters them, and the exact Jaccard similarity on full
sets verifies every link.

How groups of thousands stay near linear: equal sets collapse first; only a
sketch's rarest values are listed (as many as a qualifying partner must hit at
least once); each list is first compared with its pivot, its most central member,
only.  Members that are then still in different components differ from the pivot
themselves, and a link between them means that they share more than half of one's
differences: an inverted list of the rarest differences finds such pairs.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._graph import components, cut, few
from ._text import NOT_SPACE, Piece, map_pieces, mix

WORDS, K, MISS = 5, 48, 1e-9
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def required_overlap(percent: int, k: int = K, miss: float = MISS) -> int:
    """Retained values that sketches of k share but for probability `miss`, if the sets' similarity is percent / 100."""
    p, below = percent / 100, 0.0
    for o in range(k + 1):
        below += comb(k, o) * p**o * (1 - p) ** (k - o)
        if below > miss:
            return max(1, o)
    return k


def shingles(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted; fewer words than a shingle make one of all."""
    piece = Piece(column)
    start, end, row = piece.words(NOT_SPACE)
    h = piece.word_hashes(start, end)
    n = np.bincount(row, minlength=len(column))
    acc, size = np.zeros(len(h), np.uint64), np.minimum(n, words)[row]
    padded = np.concatenate((h, np.zeros(words, np.uint64)))
    for j in range(words):
        acc = np.where(j < size, acc * _FACTOR + padded[j : j + len(h)], acc)
    at = np.arange(len(h)) - np.searchsorted(row, np.arange(len(column)))[row] if len(h) else np.zeros(0, np.int64)
    full = at + size <= n[row]
    v, row = mix(acc[full] ^ size[full].astype(np.uint64)).view(np.int64), row[full]
    order = np.lexsort((v, row))
    v, row = v[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (row[1:] != row[:-1])
    return row[new], v[new]


def _set_ids(row: np.ndarray, v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's set."""
    u = v.view(np.uint64)
    total = np.zeros(len(n), np.uint64)
    other = np.zeros(len(n), np.uint64)
    at = np.cumsum(n) - n
    some = n > 0
    if some.any():
        total[some] = np.add.reduceat(mix(u + np.uint64(0x9E37)), at[some])
        other[some] = np.add.reduceat(mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at[some])
    size = n.astype(np.uint64)
    return mix(total ^ (size << np.uint64(32))).view(np.int64), mix(other + size).view(np.int64)


def sketches(docs: DataFrame, text: str, keep: list[str], k: int = K, words: int = WORDS) -> DataFrame:
    """Kept columns with n_shingles, node and check (digests of the set) and sketch. No shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, v = shingles(batch.column("_text"), words)
        n = np.bincount(row, minlength=batch.num_rows)
        node, check = _set_ids(row, v, n)
        rank = np.arange(len(v)) - (np.cumsum(n) - n)[row]
        few = rank < k
        at = np.concatenate(([0], np.cumsum(np.minimum(n, k)))).astype(np.int32)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(n, pa.int64()), pa.array(node), pa.array(check), pa.ListArray.from_arrays(pa.array(at), pa.array(v[few]))], names=[*keep, "n_shingles", "node", "check", "sketch"])

    schema = docs.select(*keep).schema
    for name, kind in (("n_shingles", T.LongType()), ("node", T.LongType()), ("check", T.LongType()), ("sketch", T.ArrayType(T.LongType()))):
        schema = schema.add(name, kind)
    return map_pieces(docs.select(*keep, F.col(text).alias("_text")), "_text", run, schema)


def part_nodes(df: DataFrame) -> DataFrame:
    """df (node, check, ...) where sets with equal `node` but unequal `check` get nodes of their own, so that two digests tell sets apart."""
    mixed = cut(df.groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo < hi").select("node", F.lit(True).alias("mixed")))
    if mixed.isEmpty():
        return df
    if few(mixed):
        mixed = F.broadcast(mixed)
    own = F.when(F.col("mixed"), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return df.join(mixed, "node", "left").withColumn("node", own).select(*df.columns)


def _full_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, v = shingles(batch.column("_text"), words)
        n = np.bincount(row, minlength=batch.num_rows)
        at = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(v))], names=["node", "n", "set"])

    return map_pieces(docs, "_text", run, "node long, n long, set array<long>")


def _estimate_passes(a: Column, b: Column, k: int, need: int) -> Column:
    """Whether the union's sketch holds `need` shared values at least; sets that k does not cut are left to the exact check."""
    x, y = F.slice(a, 1, k), F.slice(b, 1, k)
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, k)
    return (F.size(union) < k) | (F.size(F.array_intersect(union, F.array_intersect(x, y))) >= need)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int, k: int, need: int) -> DataFrame:
    """The (a, b) pairs whose full sets have similarity percent / 100 or more."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    shared = F.when(_estimate_passes(F.col("sa"), F.col("sb"), k, need), F.size(F.array_intersect("sa", "sb"))).otherwise(0).cast("long")
    return both.select("a", "b", "na", "nb", shared.alias("i")).where(100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")


def _apart(member: DataFrame, label: DataFrame, sets: DataFrame, percent: int, could) -> DataFrame:
    """(a, b) with different labels that may be linked, among the members (pivot, node) of each pivot.

    D(x) is the symmetric difference of x and the pivot p.  If x and y are linked,
    |D(x)| + |D(y)| - 2 |D(x) & D(y)| = |x ^ y| <= r (|x| + |y|) with r = (1 - t) / (1 + t).
    Of two nodes with different labels one, say x, is not labelled as p, so
    |D(x)| > r (|x| + |p|), and y shares more than (|D(y)| - r (|y| - |p|)) / 2 of
    its differences; and x shares |D(x)| - r |x| (1 + 1 / t) at least, as y is no
    larger than |x| / t.  Of differences ordered by rarity both list as many as it
    takes to hold one of so many shared ones.
    """
    r = (100 - percent) / (100 + percent)
    own = member.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    home = member.select("pivot").distinct().join(label.select(F.col("node").alias("pivot"), F.col("label").alias("home")), "pivot", "left").withColumn("home", F.coalesce("home", "pivot"))
    own = own.join(home, "pivot")
    mixed = own.groupBy("pivot").agg(F.min(F.least("label", "home")).alias("lo"), F.max(F.greatest("label", "home")).alias("hi")).where("lo < hi").select("pivot")
    full = own.join(mixed, "pivot").join(sets.select("node", "set"), "node").join(sets.select(F.col("node").alias("pivot"), F.col("n").alias("np"), F.col("set").alias("ps")), "pivot")
    cols = ["pivot", "node", "label", "home", "n", "usable", "np"]
    delta = full.select(*cols, F.concat(F.array_except("set", "ps"), F.array_except("ps", "set")).alias("d"))
    delta = cut(delta.select(*cols, F.size("d").alias("nd"), F.explode("d").alias("e")))
    often = delta.groupBy("pivot", "e").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = delta.join(often, ["pivot", "e"]).groupBy(*cols, "nd").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("held"))
    stranger = F.ceil(F.col("nd") - r * F.col("n") * (1 + 100 / percent) - 1e-6)
    homely = F.floor((F.col("nd") - r * (F.col("n") - F.col("np"))) / 2 - 1e-6) + 1
    shares = F.greatest(F.when(F.col("label") != F.col("home"), stranger).otherwise(homely), F.lit(1))
    listed = held.withColumn("spare", (F.size("held") - shares + 1).cast("int")).where("spare > 0")
    listed = listed.select(*cols, "nd", F.size("held").alias("size"), F.posexplode(F.slice("held", F.lit(1), F.col("spare"))).alias("i", "x"))
    listed = cut(listed.select(*cols, "nd", F.col("x.e").alias("e"), (F.col("size") - F.col("i")).alias("rest")))
    x = listed.select("pivot", "e", F.col("node").alias("a"), F.col("n").alias("na"), F.col("usable").alias("ua"), F.col("label").alias("la"), F.col("nd").alias("da"), F.col("rest").alias("ra"))
    y = listed.select("pivot", "e", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("usable").alias("ub"), F.col("label").alias("lb"), F.col("nd").alias("db"), F.col("rest").alias("rb"))
    # At the first difference that they share, no more than the rest of either list can be shared.
    near = 2 * F.least("ra", "rb", "da", "db") >= F.col("da") + F.col("db") - r * (F.col("na") + F.col("nb")) - 1e-6
    return x.join(y, ["pivot", "e"]).where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & near & could(F.col("na"), F.col("ua"), F.col("nb"), F.col("ub"))).select("a", "b").distinct()


def near_duplicate_groups(docs: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text", words: int = WORDS, k: int = K) -> DataFrame:
    """One row per row of docs: key, text_key, n_shingles, component_id, kept.

    Documents with 100 * intersection >= percent * union are linked; a component
    is named by its smallest key, whose row is kept.  Null and empty texts have
    no shingles and are linked with nothing.  Rows that repeat a key get their own
    text's component; a null key is never a name unless no member has a key, and
    then those rows are kept.  `text_key` (a hash of the text) tells rows with
    equal keys apart.  Extra columns are ignored; an empty table gives no rows.
    """
    need = required_overlap(percent, k)
    src = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("text_key"))
    all_ = part_nodes(cut(sketches(src.withColumnRenamed("_text", "t"), "t", ["_key", "text_key"], k, words)))
    reps = all_.where("n_shingles > 0").groupBy("node").agg(F.min("_key").alias("first_key"), F.min("text_key").alias("text_key"), F.max("n_shingles").alias("n"), F.first("sketch").alias("sketch"))

    # Inverted lists: each sketch's values by frequency; those found once only can match nothing.
    value = reps.select("node", "n", "text_key", F.explode("sketch").alias("v"))
    often = value.groupBy("v").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df > 1")
    exact = F.ceil(F.col("n") * percent / 100)
    overlap = F.when(F.col("n") * 100 <= k * percent, exact).otherwise(F.lit(need))
    lists = value.join(often, "v").groupBy("node").agg(F.first("n").alias("n"), F.first("text_key").alias("text_key"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("held"), F.sum("df").alias("weight"))
    lists = lists.withColumn("spare", (F.size("held") - overlap + 1).cast("int")).where("spare > 0")
    index = cut(lists.select("node", "n", "text_key", "weight", F.explode(F.slice("held", F.lit(1), F.col("spare"))).alias("e")).select("node", "n", "text_key", "weight", F.col("e.v").alias("v")))
    shared = index.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    index = index.join(shared.select("v"), "v")

    # Full sets of the documents that any list brings together with another.
    wanted = index.groupBy("node").agg(F.min("text_key").alias("text_key"))
    bodies = src.select("text_key", "_text").join(wanted, "text_key").groupBy("node").agg(F.first("_text").alias("_text"))
    sets = cut(_full_sets(bodies, words))
    single = sets.select("node", F.explode("set").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("single"))
    usable = cut(sets.select("node", "n").join(single, "node", "left").select("node", (F.col("n") - F.coalesce("single", F.lit(0))).alias("usable")))
    index = cut(index.select("v", "node", "n", "weight").join(usable, "node").where(100 * F.col("usable") >= percent * F.col("n")))
    pivots = index.groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("weight", "node")).alias("pivot")).where("c > 1")
    member = cut(index.join(pivots.select("v", F.col("pivot.node").alias("pivot")), "v").where("pivot <> node").select("pivot", "node", "n", "usable").distinct())

    def could(na: Column, ua: Column, nb: Column, ub: Column) -> Column:
        return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * F.least(ua, ub) >= percent * (na + nb))

    # First every list's members against its pivot, the member whose values are the most common.
    ends = sets.select(F.col("node").alias("pivot"), F.col("n").alias("np")).join(usable.select(F.col("node").alias("pivot"), F.col("usable").alias("up")), "pivot")
    star = member.join(ends, "pivot").where(could(F.col("n"), F.col("usable"), F.col("np"), F.col("up")))
    links = cut(_verify(star.select(F.col("pivot").alias("a"), F.col("node").alias("b")), sets, percent, k, need))
    label = components(links, "a", "b")
    # Then members of one list that are still apart.
    apart = _apart(member, label, sets, percent, could)
    more = cut(_verify(apart, sets, percent, k, need))
    label = components(links.unionByName(more), "a", "b")

    first = reps.select("node", "first_key")
    named = label.join(first, "node")
    group = named.groupBy("label").agg(F.min("first_key").alias("component"))
    linked = named.join(group, "label").select("node", "component")
    own = first.join(linked, "node", "left").select("node", F.coalesce("component", "first_key").alias("component"))
    out = all_.join(own, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("_key"))
    return out.select(F.col("_key").alias(key), "text_key", "n_shingles", component.alias("component_id"), F.col("_key").eqNullSafe(component).alias("kept"))


def remove_near_duplicates(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group: the one with the smallest key; all columns stay."""
    gone = near_duplicate_groups(docs, percent, key, text).where(~F.col("kept")).select(F.col(key).alias("_gone_key"), F.col("text_key").alias("_gone_text")).distinct()
    return docs.join(gone, docs[key].eqNullSafe(F.col("_gone_key")) & (F.xxhash64(docs[text]) == F.col("_gone_text")), "left_anti")
