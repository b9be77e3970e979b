"""Contained reads: rows of plain Python for letters of any kind, and hits instead of all k-mers in the shuffle."""

import random

from strandweave.operators import overlap, rolling


def test_rows_of_plain_python(spark, monkeypatch):
    draw = random.Random(8)
    texts = ["".join(draw.choice("ACGTé🧬") for _ in range(draw.randint(30, 300))) for _ in range(12)]
    for t in list(texts) * 6:
        a = draw.randrange(len(t))
        texts.append(t[a : a + draw.choice([1, 2, 5, 15, 16, 17, 31, 32, 33, 64, 100])])
    texts += [texts[0], texts[0][:-1], texts[0][1:], "", None, "N" * 40, "N" * 39, "GATTACA" * 9, "GATTACA" * 8]
    rows = [(f"r{i}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "read_id string, seq string")
    want = sorted(i for i, t in rows if t is not None and any(u and len(t) < len(u) and t in u for _, u in rows))
    for seed, piece in ((16, 1 << 20), (16, 100), (3, 1 << 20)):
        monkeypatch.setattr(rolling, "PIECE_BYTES", piece)
        assert sorted(r.read_id for r in overlap.contained(df, seed).collect()) == want


def test_hits_are_shuffled_and_not_all_windows(spark, monkeypatch):
    draw = random.Random(9)
    whole = ["".join(draw.choice("ACGT") for _ in range(2000)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate([*whole, *(t[500:900] for t in whole[:10])])]
    tables, through = [], overlap.stored
    monkeypatch.setattr(overlap, "stored", lambda df: tables.append(through(df)) or tables[-1])
    got = sorted(r.read_id for r in overlap.contained(spark.createDataFrame(rows, "read_id long, seq string")).collect())
    assert got == list(range(40, 50))
    assert tables[1].count() < 300  # of 84,000 windows, and each of three sizes
