"""Greedy paths and assemblies with ids of any value and type, and the registered queries against a plain walk."""

import random

import pytest

from strandweave.operators import overlap
from strandweave.plans import registry

SF = "/root/testdata/sf0.001"


def plain_paths(edges):
    """Paths from (src, dst, weight) by the definition, one component after another."""
    group = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for s, d, _ in edges:
        group[find(s)] = find(d)
    out = []
    for root in {find(x) for x in list(group)}:
        own = [e for e in edges if find(e[0]) == root]
        nodes = sorted({x for e in own for x in e[:2]})
        n_in = {x: sum(e[1] == x for e in own) for x in nodes}
        used = set()
        for at in [x for x in nodes if n_in[x] == 0] or [x for x in nodes if n_in[x] <= 1]:
            path = []
            while at is not None and at not in used:
                path.append(at)
                used.add(at)
                ways = sorted((-w, d) for s, d, w in own if s == at and d not in used)
                at = ways[0][1] if ways else None
            if len(path) > 1:
                out += [(path[0], i, r) for i, r in enumerate(path)]
    return sorted(out)


def found(spark, edges, kind):
    return sorted(map(tuple, overlap.greedy_paths(spark.createDataFrame(edges, f"src {kind}, dst {kind}, weight double")).collect()))


@pytest.mark.parametrize("ids", [(0, 1, 2, 3), (1, 0, 2, 3), (1, 2, 0, 3), (3, 2, 1, 0), (-1, 0, 5, 2), (11, 10, 12, 13)])
def test_every_id_can_be_anywhere_on_a_path(spark, ids):
    edges = [(a, b, 5.0) for a, b in zip(ids, ids[1:])]
    assert found(spark, edges, "long") == [(ids[0], i, r) for i, r in enumerate(ids)]


def test_paths_equal_a_plain_walk(spark):
    rng = random.Random(7)
    for n in (5, 12, 30):
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)}
        edges = [(a, b, float(rng.randrange(1, 4))) for a, b in sorted(pairs) if a != b]
        assert found(spark, edges, "long") == plain_paths(edges)
        named = [(f"r{a}", f"r{b}", w) for a, b, w in edges]
        assert found(spark, named, "string") == plain_paths(named)


def test_registered_paths_equal_a_plain_walk(spark):
    known = registry.queries()
    edges = [(r.src, r.dst, r.weight) for r in known["o5_edges"](spark, SF).collect()]
    got = sorted(map(tuple, known["o7_paths"](spark, SF).select("path", "ord", "read_id").collect()))
    assert got == plain_paths(edges) and any(r[2] == 0 for r in got) == any(0 in e[:2] for e in edges)


@pytest.mark.parametrize("first", [0, 3, 12])
def test_a_sequence_comes_back_whole_whatever_the_ids(spark, first):
    rng = random.Random(3)
    genome = "".join(rng.choice("ACGT") for _ in range(300))
    reads = [((k + first) % 13, genome[i : i + 60]) for k, i in enumerate(range(0, 241, 20))]
    got = overlap.assemble(spark.createDataFrame(reads, "read_id long, seq string"), 11, 100, 0.1, 20, 0.9)
    assert [r.seq for r in got["contigs"].collect()] == [genome]


def test_registered_contigs_follow_their_paths(spark):
    """Every contig is as long as its layout and begins with its first read where no other read covers."""
    known = registry.queries()
    contigs = {r.path: r.seq for r in known["o11_assemble"](spark, SF).collect()}
    edges = {(r.src, r.dst): (r.overlap_len, r.weight) for r in known["o5_edges"](spark, SF).collect()}
    length = {r.read_id: len(r.seq) for r in registry.reads(spark, SF).collect()}
    paths = {}
    for head, _, read in plain_paths([(s, d, w) for (s, d), (_, w) in edges.items()]):
        paths.setdefault(head, []).append(read)
    assert contigs.keys() == paths.keys()
    for head, path in paths.items():
        at, last = 0, 0
        for before, read in zip([None, *path], path):
            at += 0 if before is None else length[before] - edges[before, read][0]
            last = max(last, at + length[read])
        assert len(contigs[head]) == last
