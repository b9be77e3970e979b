"""Chains and Euler trails in rounds of joins, against following edges one by one."""

import collections
import random

import pytest

from strandweave.operators import trails


def test_chains_equal_following_predecessors(spark):
    rng = random.Random(1)
    for n in (1, 2, 3, 17, 60):
        ids = list(range(n))
        rng.shuffle(ids)
        up = {}
        while ids:
            size = min(len(ids), rng.choice([1, 2, 5, 30]))
            part, ids = ids[:size], ids[size:]
            for a, b in zip(part, part[1:]):
                up[b] = a
            up[part[0]] = part[-1] if rng.random() < 0.5 else None
        want = {}
        for i in up:
            seen, at = [i], up[i]
            while at is not None and at != i:
                seen.append(at)
                at = up[at]
            want[i] = (min(seen), None, True) if at == i else (seen[-1], len(seen) - 1, False)
        df = spark.createDataFrame(list(up.items()), "id long, up long")
        assert {r.id: (r["head"], r.pos, r.ring) for r in trails.chains(df).collect()} == want
        for r in trails.placed_chains(df).collect():
            assert (r["head"], r.pos) == want[r.id][:2] if not want[r.id][2] else (r.pos == 0) == (r.id == r["head"])


def check(edges, rows):
    ends = {i: (s, d) for i, s, d in edges}
    by = collections.defaultdict(list)
    for r in rows:
        by[r.trail].append((r.pos, r.id))
    assert sorted(r.id for r in rows) == sorted(ends)
    for t, steps in by.items():
        steps.sort()
        assert [p for p, _ in steps] == list(range(len(steps))) and steps[0][1] == t
        assert all(ends[a][1] == ends[b][0] for (_, a), (_, b) in zip(steps, steps[1:]))
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    spare = collections.Counter()
    for _, s, d in edges:
        group[root(s)] = root(d)
        spare[s] += 1
        spare[d] -= 1
    least = {root(x): 0 for x in list(group)}
    for x, n in spare.items():
        least[root(x)] += max(0, n)
    assert len(by) == sum(max(1, n) for n in least.values())


@pytest.mark.parametrize("seed", range(4))
def test_trails_use_every_edge_once_and_are_fewest(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([2, 4, 9, 15])
    edges = [(i, rng.randrange(n), rng.randrange(n)) for i in range(rng.choice([1, 12, 40]))]
    edges += [(100 + i, 50 + rng.randrange(3), 50 + rng.randrange(3)) for i in range(9)]
    # Rings that meet rings: a flower of loops and a row of circles.
    edges += [(200 + 2 * i, 80, 81 + i) for i in range(5)] + [(201 + 2 * i, 81 + i, 80) for i in range(5)]
    edges += [x for i in range(6) for x in ((300 + 2 * i, 90 + i, 91 + i), (301 + 2 * i, 91 + i, 90 + i))] + [(400, 99, 99)]
    check(edges, trails.euler_trails(spark.createDataFrame(edges, "id long, src long, dst long")).collect())


def test_trails_of_nothing_and_of_text_ids(spark):
    assert trails.euler_trails(spark.createDataFrame([], "id long, src long, dst long")).count() == 0
    edges = [("e1", "a", "b"), ("e2", "b", "a"), ("e3", "a", "c"), ("e4", "b", "b")]
    check(edges, trails.euler_trails(spark.createDataFrame(edges, "id string, src string, dst string")).collect())
