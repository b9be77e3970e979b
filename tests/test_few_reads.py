"""Few reads are compared where they are found: the rows of the shuffled way and of plain Python, without a shuffle of k-mers."""

import random

import pytest
from pyspark.sql import functions as F

from strandweave.operators import match


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(7)
    text = lambda n: "".join(draw.choices("ACGT", k=n))
    seqs = [text(n) for n in (0, 1, 3, 30, 511, 513, 1500, 3000)]
    reads = ["", "A", "CA", "GATC", text(9), seqs[6][505:521], seqs[6][500:531], seqs[7][2000:2700], seqs[4], seqs[7][1020:1027] + "T" + seqs[7][1028:1060], seqs[6][500:531]]
    g = [(i, "o" + str(i % 2), s) for i, s in enumerate(seqs)]
    r = list(enumerate(reads))
    return g, r, spark.createDataFrame(g, "seq_id long, organism string, seq string"), spark.createDataFrame(r, "read_id long, seq string")


def starts(read, seq, limit):
    return [s for s in range(len(seq) - len(read) + 1) if sum(a != b for a, b in zip(read, seq[s:])) <= limit] if read else []


@pytest.mark.parametrize("limit", [0, 1, 2])
def test_matches(tables, limit, monkeypatch):
    g, r, genomes, reads = tables
    want = sorted((i, j, o) for i, read in r for j, o, s in g if starts(read, s, limit))
    assert sorted(map(tuple, match.read_matches(reads, genomes, limit).collect())) == want
    monkeypatch.setattr(match, "FEW", 0)
    assert sorted(map(tuple, match.read_matches(reads, genomes, limit).collect())) == want


def test_counts(tables, monkeypatch):
    g, r, genomes, reads = tables
    want = sorted({(read, sum(len(starts(read, s, 0)) for _, _, s in g)) for _, read in r})
    patterns = reads.select(F.col("seq").alias("pattern"))
    assert sorted(map(tuple, match.occurrence_counts(genomes, patterns).collect())) == want
    monkeypatch.setattr(match, "FEW", 0)
    assert sorted(map(tuple, match.occurrence_counts(genomes, patterns).collect())) == want


def test_candidates(tables):
    g, r, genomes, reads = tables
    parts = {i: [p for p in (read[: len(read) // 2], read[len(read) // 2 :]) if p] for i, read in r}
    want = sorted((i, any(starts(read, s, 1) for _, _, s in g), any(p in s for p in parts[i] for _, _, s in g)) for i, read in r)
    assert sorted(map(tuple, match.pattern_candidates(reads, genomes, 1).collect())) == want


def test_no_shuffle_before_the_result(tables):
    _, _, genomes, reads = tables
    text = match.read_matches(reads, genomes, 1)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and text.count("Exchange hashpartitioning") == 1
