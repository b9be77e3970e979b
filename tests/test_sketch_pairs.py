"""Sketches are compared in pairs of blocks: the rows of plain Python, without a row for each hash of each pair."""

import random

from strandweave.operators import minimizers


def test_blocks_of_sketches(spark, monkeypatch):
    draw = random.Random(2)
    held = {i: set(draw.sample("abcdefghijkl", draw.randint(1, 6))) for i in range(-5, 12)}
    df = spark.createDataFrame([(i, h) for i, hs in held.items() for h in hs], "seq_id long, hash string")
    pairs = [(a, b, len(held[a] & held[b]), len(held[a] | held[b])) for a in held for b in held if a < b and held[a] & held[b]]
    want = sorted((a, b, s, t, round(s / t, 6)) for a, b, s, t in pairs)
    for block in (3, 2048):
        monkeypatch.setattr(minimizers, "BLOCK", block)
        assert sorted(map(tuple, minimizers.sketch_jaccard(df).collect())) == want
        made = minimizers.sketch_jaccard(df, least=0.4)
        assert sorted(map(tuple, made.collect())) == [r for r in want if r[4] >= 0.4]
        assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    assert minimizers.sketch_jaccard(df.limit(0)).collect() == []
