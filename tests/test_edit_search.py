"""Search with insertions and deletions, and the stored seed index, against plain dynamic programming."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strandweave.operators import match
from strandweave.operators.seed_index import SeedIndex


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def windows(seq, pattern, limit):
    m = len(pattern)
    return [(s, e, d) for s in range(len(seq)) for e in range(s + max(1, m - limit), min(len(seq), s + m + limit) + 1) if (d := distance(seq[s:e], pattern)) <= limit]


def best(found, m):
    out = {}
    for s, e, d in found:
        out.setdefault(s, []).append((d, abs(e - s - m), e - s, e))
    return sorted((s, min(v)[3], min(v)[0]) for s, v in out.items())


def test_every_window_within_the_limit_is_found(spark):
    rng = random.Random(2)
    pattern = "GATTACAGATC"
    seqs = []
    for i in range(30):
        p = list(pattern)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(p))
            p[at : at + rng.randrange(2)] = [rng.choice("ACGTN")] * rng.randrange(2)
        seqs.append((i, "".join(rng.choice("ACGT") for _ in range(rng.randrange(30))) + "".join(p) + "".join(rng.choice("ACGT") for _ in range(rng.randrange(9)))))
    seqs += [(90, ""), (91, None), (92, "A"), (93, ("ACGT" * 200 + pattern[:5] + "T" + pattern[5:]) * 2), (94, pattern.lower())]
    df = spark.createDataFrame(seqs, "seq_id long, seq string")
    for limit in (0, 1, 2, 3):
        want = sorted((i, *w) for i, s in seqs if s for w in windows(s.upper(), pattern, limit))
        assert sorted(map(tuple, match.edit_matches(df, pattern, limit).select("seq_id", "start", "end", "edits").collect())) == want
        want = sorted((i, *w) for i, s in seqs if s for w in best(windows(s.upper(), pattern, limit), len(pattern)))
        assert sorted(map(tuple, match.edit_matches(df, pattern, limit, best=True).select("seq_id", "start", "end", "edits").collect())) == want


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("AC", max_size=24), st.text("AC", min_size=1, max_size=6), st.integers(0, 3))
def test_short_patterns_equal_dynamic_programming(spark, seq, pattern, limit):
    df = spark.createDataFrame([(0, seq)], "seq_id long, seq string")
    assert sorted((r.start, r.end, r.edits) for r in match.edit_matches(df, pattern, limit).collect()) == windows(seq, pattern, limit)


@pytest.fixture(scope="module")
def collection():
    rng = random.Random(4)
    seqs = [(i, f"org{i % 3}", "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate((700, 64, 65, 63, 1, 0, 300))] + [(9, "org0", "ACAC" * 60)]
    reads = []
    for k in range(60):
        i = rng.randrange(len(seqs))
        s = seqs[i][2]
        n = rng.randrange(1, 50)
        at = rng.randrange(max(1, len(s) - n + 1))
        r = list(s[at : at + n])
        for _ in range(rng.randrange(3)):
            if r:
                j = rng.randrange(len(r))
                r[j : j + rng.randrange(2)] = [rng.choice("ACGT")] * rng.randrange(2)
        reads.append((k, "".join(r)))
    return seqs, [*reads, (90, ""), (91, None), (92, "ACACACACAC"), (93, "acacacacac")]


def test_index_finds_every_place(spark, collection):
    seqs, reads = collection
    index = SeedIndex.build(spark.createDataFrame(seqs, "seq_id long, organism string, seq string"), 8, "seedtest", 64, 60, 4)
    again = SeedIndex.load(spark, "seedtest")
    assert (again.k, again.piece, again.margin) == (8, 64, 60)
    asked = spark.createDataFrame(reads, "read_id long, seq string")
    some = [(i, r.upper()) for i, r in reads if r]
    for limit in (0, 1, 2):
        want = sorted((i, j, o, at, m) for i, r in some for j, o, s in seqs for at in range(len(s) - len(r) + 1) if (m := sum(x != y for x, y in zip(r, s[at : at + len(r)]))) <= limit)
        assert sorted(map(tuple, index.find(asked, limit).collect())) == want
    longer = [(i, r) for i, r in some if len(r) > 5]
    for limit in (0, 1, 2):
        want = sorted((i, j, o, *w) for i, r in longer for j, o, s in seqs for w in best(windows(s, r, limit), len(r)))
        assert sorted(map(tuple, again.find_edited(asked.where("length(seq) > 5"), limit).collect())) == want
    with pytest.raises(ValueError, match="margin of 63"):
        index.find(spark.createDataFrame([(0, "A" * 61)], "read_id long, seq string"), 1)


def test_look_ups_do_not_shuffle_the_index(spark, collection):
    seqs, reads = collection
    index = SeedIndex.build(spark.createDataFrame(seqs, "seq_id long, organism string, seq string"), 8, "seedplan", 64, 60, 4)
    asked = spark.createDataFrame([r for r in reads if r[1] and len(r[1]) >= 8], "read_id long, seq string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index._candidates(index._own(asked, 0, "read_id", "seq"), 0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    for table in ("seedplan_seeds", "seedplan_pieces"):
        at = next(i for i, line in enumerate(lines) if table in line)
        depth = lines[at].index("FileScan")
        over = []
        for line in reversed(lines[:at]):
            here = len(line) - len(line.lstrip(" :+-*"))
            if here < depth:
                over.append(line)
                depth = here
        below_join = over[: next(i for i, line in enumerate(over) if "Join" in line)]
        assert not any("Exchange" in line for line in below_join), plan


def test_index_of_nothing(spark):
    index = SeedIndex.build(spark.createDataFrame([], "seq_id long, organism string, seq string"), 4, "seedempty", 64, 60, 2)
    assert index.find(spark.createDataFrame([(1, "ACGTACGT")], "read_id long, seq string")).count() == 0
    full = SeedIndex.build(spark.createDataFrame([(1, "o", "ACGTACGT")], "seq_id long, organism string, seq string"), 4, "seedempty", 64, 60, 2)
    assert full.find(spark.createDataFrame([], "read_id long, seq string")).count() == 0 and full.seeds.count() == 8


def test_reads_across_pieces_are_matched(spark, monkeypatch):
    """read_matches and occurrence_counts compare within pieces; their cuts change nothing."""
    rng = random.Random(14)
    seqs = [(i, "o", "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate((900, 130, 64, 33))]
    reads = []
    for k in range(40):
        s = seqs[k % 4][2]
        n = rng.randrange(20, min(90, len(s)) + 1)
        r = list(s[(at := rng.randrange(len(s) - n + 1)) : at + n])
        if k % 2:
            r[rng.randrange(n)] = rng.choice("ACGT")
        reads.append((k, "".join(r)))
    df, asked = spark.createDataFrame(seqs, "seq_id long, organism string, seq string"), spark.createDataFrame(reads, "read_id long, seq string")
    for piece in (2048, 32):
        monkeypatch.setattr(match, "PIECE", piece)
        for limit in (0, 1):
            want = sorted({(i, j, o) for i, r in reads for j, o, s in seqs if any(sum(x != y for x, y in zip(r, s[at : at + len(r)])) <= limit for at in range(len(s) - len(r) + 1))})
            assert sorted(map(tuple, match.read_matches(asked, df, limit).collect())) == want
        counts = {r.pattern: r.n for r in match.occurrence_counts(df, asked.selectExpr("seq AS pattern")).collect()}
        assert counts == {r: sum(s.startswith(r, at) for _, _, s in seqs for at in range(len(s))) for _, r in reads}
