"""k-mers and minimizers are cut in one pass: the same rows as plain Python's, from plans that walk no string for each place."""

import random

import pytest

from strandweave.functions.sql import register_functions
from strandweave.operators import kmers, minimizers

ODD = [(0, ""), (1, "ACG"), (2, "NNNNNNNNNNNN"), (3, "acgtACGTRYKacgt"), (4, "A😀C😀GT😀ACGTA"), (5, None), (6, "ÉÀACGTÉÀNACGTÉ")]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    return ODD + [(10 + i, "".join(draw.choices("ACGTN", (9, 9, 9, 9, 1), k=n))) for i, n in enumerate((5, 40, 511, 512, 513, 2047, 2060, 5000))]


def plain(s, k):
    return [s[i : i + k] for i in range(len(s or "") - k + 1)]


@pytest.mark.parametrize("k", [1, 4, 33])
def test_kmers(spark, rows, k):
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    want = sorted((i, p, x) for i, s in rows for p, x in enumerate(plain(s, k)))
    assert sorted((r.seq_id, r.pos, r.kmer) for r in kmers.kmers(df, k, skip_n=False).collect()) == want
    assert sorted((r.seq_id, r.pos, r.kmer) for r in kmers.kmers(df, k).collect()) == [x for x in want if "N" not in x[2]]


@pytest.mark.parametrize("k,w", [(1, 1), (4, 3), (12, 5), (33, 4)])
def test_minimizers(spark, rows, k, w):
    df = spark.createDataFrame(rows + rows[-1:], "seq_id long, seq string")
    want = {(i, min(free)) for i, s in rows for a in range(len(plain(s, k)) - w + 1) if (free := [x for x in plain(s, k)[a : a + w] if "N" not in x])}
    assert sorted(map(tuple, minimizers.minimizers(df, k, w).collect())) == sorted(want)
    df.createOrReplaceTempView("odd_seqs")
    got = register_functions(spark).sql(f"SELECT DISTINCT seq_id, minimizer FROM (SELECT seq_id, minimizers(seq, {k}, {w}) AS f FROM odd_seqs), LATERAL inline(f)")
    assert {tuple(r) for r in got.collect()} == want


def test_no_place_walks_its_string(spark):
    df = spark.createDataFrame([(0, "ACGT")], "seq_id long, seq string")
    df.createOrReplaceTempView("odd_seqs")
    sql = register_functions(spark).sql("SELECT kmers(seq, 3) AS f, minimizers(seq, 3, 2) AS g FROM odd_seqs")
    plan = lambda made: made._jdf.queryExecution().executedPlan().toString()
    assert "substring" not in plan(sql)
    assert "explode(regexp_extract_all(" in plan(kmers.kmers(df, 3))
    assert "lambda" not in plan(kmers.kmers(df, 3)) and "lambda" not in plan(minimizers.minimizers(df, 3, 2))
