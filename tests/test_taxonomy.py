"""Lowest common taxa, heaviest paths and clade reports against plain versions."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from strandweave.operators import taxonomy as X

TREE = {"a1": ["root", "a", "a1"], "a2": ["root", "a", "a2"], "b1": ["root", "b", "b1"], "b2": ["root", "b", "bb", "b2"], "b3": ["root", "b", "bb", "b3"], "odd": []}
K, W = 6, 3


def lca(paths):
    out = []
    for level in zip(*paths):
        if len(set(level)) > 1:
            break
        out.append(level[0])
    return tuple(out)


def plain_minimizers(seq):
    words = [seq[i : i + K] for i in range(len(seq) - K + 1)]
    return {min(words[i : i + W]) for i in range(len(words) - W + 1)}


def plain_labels(genomes, reads, confidence):
    held = collections.defaultdict(set)
    for o, s in genomes:
        if TREE.get(o):
            for m in plain_minimizers(s):
                held[m].add(tuple(TREE[o]))
    index = {m: lca(sorted(p)) for m, p in held.items()}
    out = {}
    for r, s in reads:
        parts = plain_minimizers(s)
        votes = collections.Counter(index[m] for m in parts if m in index)
        path = ()
        if votes:
            score = {t: sum(n for h, n in votes.items() if t[: len(h)] == h) for t in votes}
            path = lca([t for t in votes if score[t] == max(score.values())])
        clade = lambda p: sum(n for h, n in votes.items() if h[: len(p)] == p)
        while path and clade(path) < confidence * len(parts):
            path = path[:-1]
        out[r] = (path[-1] if path else "unclassified", path, len(path), votes.total(), len(parts), round(clade(path) / len(parts), 6) if path else 0.0)
    return out


@pytest.fixture(scope="module")
def data():
    rng = random.Random(8)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    every, fam = dna(60), {"a": dna(80), "b": dna(80)}
    low = dna(50)
    genomes = [(o, dna(150) + every + fam[(p[1] if p else "a")] + (low if "bb" in p else "")) for o, p in TREE.items()] + [("unknown", dna(99))]
    reads = []
    for k in range(80):
        parts = [rng.choice(genomes)[1] for _ in range(rng.randrange(1, 3))]
        text = "".join(g[(at := rng.randrange(len(g))) : at + rng.randrange(10, 60)] for g in parts) + dna(rng.randrange(30))
        reads.append((k, text))
    return genomes, [*reads, (90, ""), (91, "ACG"), (92, every), (93, low), (94, fam["a"])]


@pytest.mark.parametrize("confidence", [0.0, 0.2, 0.5, 1.0])
def test_labels_equal_a_plain_version(spark, data, confidence):
    genomes, reads = data
    index = X.taxon_index(spark.createDataFrame(genomes, "organism string, seq string"), spark.createDataFrame(list(TREE.items()), "organism string, path array<string>"), K, W)
    got = X.classify_taxa(spark.createDataFrame(reads, "read_id long, seq string"), index, K, W, confidence).collect()
    assert {r.read_id: (r.label, tuple(r.path), r.depth, r.n_hits, r.n_parts, r.support) for r in got} == plain_labels(genomes, reads, confidence)
    if confidence == 0.0:
        assert {"root", "a", "b", "bb", "unclassified"} <= {r.label for r in got}


def test_report_counts_clades(spark, data):
    genomes, reads = data
    index = X.taxon_index(spark.createDataFrame(genomes, "organism string, seq string"), spark.createDataFrame(list(TREE.items()), "organism string, path array<string>"), K, W)
    labelled = X.classify_taxa(spark.createDataFrame(reads, "read_id long, seq string"), index, K, W)
    plain = plain_labels(genomes, reads, 0.0).values()
    paths = [p[1] or ("unclassified",) for p in plain]
    got = {r.taxon: (r.n_clade, r.n_own) for r in X.taxon_report(labelled).collect()}
    assert got == {";".join(t): (sum(p[: len(t)] == t for p in paths), paths.count(t)) for t in {p[:n] for p in paths for n in range(1, len(p) + 1)}}
    assert abs(sum(r.pct for r in X.taxon_report(labelled).where("depth <= 1").collect()) - 100) < 1e-3


def test_common_paths_and_empty_tables(spark):
    pairs = [(["r", "a"], ["r", "b"]), (["r", "a"], ["r", "a", "x"]), (["r"], ["s"]), (["r", "a"], ["r", "a"]), ([], ["r"])]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    assert [r[0] for r in df.select(X.common_path(F.col("a"), F.col("b"))).collect()] == [list(lca(p)) for p in pairs]
    none = spark.createDataFrame([], "organism string, seq string")
    tree = spark.createDataFrame(list(TREE.items()), "organism string, path array<string>")
    index = X.taxon_index(none, tree, K, W)
    got = X.classify_taxa(spark.createDataFrame([(1, "ACGTACGTACGTACGT")], "read_id long, seq string"), index, K, W).collect()
    assert [(r.label, r.depth) for r in got] == [("unclassified", 0)]
    assert X.classify_taxa(spark.createDataFrame([], "read_id long, seq string"), index, K, W).count() == 0
