"""Packed k-mers, mergeable sketches and the functions for spark.sql."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.functions.sql import register_functions
from strandweave.operators import kmers, minimizers, packed


def code(word):
    return sum("ACGT".index(c) << (2 * i) for i, c in enumerate(reversed(word)))


@pytest.fixture(scope="module")
def seqs():
    rng = random.Random(3)
    return [(i, f"o{i % 3}", "".join(rng.choice("ACGTACGTN") for _ in range(n))) for i, n in enumerate((0, 1, 5, 40, 600, 1700))] + [(7, "o1", None), (8, None, "acgtnACGT" * 4), (9, "o1", "ACGTACGTACGTACGT" * 5)]


def test_rolled_codes_equal_plain_ones():
    rng = random.Random(1)
    for k in (1, 2, 3, 7, 16, 21, 31):
        text = "".join(rng.choice("ACGTACGTACGTN") for _ in range(120))
        got, place = packed.roll(np.frombuffer(text.encode(), np.uint8), k)
        want = [(i, code(text[i : i + k])) for i in range(len(text) - k + 1) if "N" not in text[i : i + k]]
        assert list(zip(place.tolist(), got.tolist())) == want


@pytest.mark.parametrize("k", [1, 6, 31])
def test_packed_kmers_equal_text_kmers(spark, seqs, k, monkeypatch):
    df = spark.createDataFrame(seqs, "seq_id long, organism string, seq string")
    want = sorted((i, p, (s or "").upper()[p : p + k]) for i, _, s in seqs for p in range(len(s or "") - k + 1) if "N" not in s.upper()[p : p + k])
    for piece in (packed.PIECE, 64):
        monkeypatch.setattr(packed, "PIECE", piece)
        got = packed.packed_kmers(df.select("seq_id", "seq"), k)
        assert sorted(map(tuple, got.select("seq_id", "pos", packed.unpack(F.col("code"), k)).collect())) == want
        index = packed.packed_index(df, k).select(packed.unpack(F.col("code"), k).alias("kmer"), "organism", "cnt")
        upper = df.withColumn("seq", F.upper("seq"))
        assert sorted(map(tuple, index.collect()), key=str) == sorted(map(tuple, kmers.kmer_index(upper, k).select("kmer", "organism", "cnt").collect()), key=str)


def test_codes_keep_order_and_limits(spark):
    words = spark.createDataFrame([(w,) for w in ("A", "T", "ACG", "TTT", "ACN", "", "A" * 31, "T" * 31, "A" * 32)], "w string")
    got = {r.w: r.c for r in words.select("w", packed.pack(F.col("w")).alias("c")).collect()}
    assert got == {"A": 0, "T": 3, "ACG": 6, "TTT": 63, "ACN": None, "": 0, "A" * 31: 0, "T" * 31: 4**31 - 1, "A" * 32: None}
    for k in (0, 32):
        with pytest.raises(ValueError):
            packed.packed_kmers(words, k, "w")


def test_packed_counts_shuffle_fewer_bytes(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(f"o{i % 4}", "".join(rng.choice("ACGT") for _ in range(20_000))) for i in range(8)], "organism string, seq string").repartition(4).cache()
    df.count()
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled(index):
        before = sum(store.executorList(True).apply(i).totalShuffleWrite() for i in range(store.executorList(True).size()))
        index.write.format("noop").mode("overwrite").save()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return sum(store.executorList(True).apply(i).totalShuffleWrite() for i in range(store.executorList(True).size())) - before

    text, codes = shuffled(kmers.kmer_index(df, 31)), shuffled(packed.packed_index(df, 31))
    print("bytes shuffled", text, codes)
    assert 0 < codes < 0.8 * text


def test_sketches_of_parts_merge(spark, seqs, monkeypatch):
    df = spark.createDataFrame(seqs, "seq_id long, organism string, seq string").where("seq is not null")
    k, size = 5, 30
    plain = {}
    for i, _, s in seqs:
        if s and len(s) >= k:
            plain[i] = sorted({hashlib.md5(s[p : p + k].encode()).hexdigest()[:8] for p in range(len(s) - k + 1)})
    for piece in (minimizers.SKETCH_PIECE, 100):
        monkeypatch.setattr(minimizers, "SKETCH_PIECE", piece)
        got = minimizers.sketch(df, k, size).collect()
        assert sorted((r.seq_id, r["rank"], r.hash) for r in got) == sorted((i, n, h) for i, hs in plain.items() for n, h in enumerate(hs[:size], 1))
    half = [minimizers.sketch(df.where(f"seq_id % 2 = {x}"), k, size) for x in (0, 1)]
    every = half[0].unionByName(half[1]).withColumn("all", F.lit("all"))
    union = sorted({h for hs in plain.values() for h in hs})[:size]
    assert [r.hash for r in minimizers.merge_sketches(every, size, "all").orderBy("rank").collect()] == union
    counts = {r.seq_id: r.n_distinct for r in minimizers.distinct_estimate(minimizers.sketch(df, k, 10_000), 10_000).collect()}
    assert counts == {i: len(hs) for i, hs in plain.items()}
    rough = {r.seq_id: r.n_distinct for r in minimizers.distinct_estimate(minimizers.sketch(df, k, 200), 200).collect()}
    assert abs(rough[5] - len(plain[5])) < 0.3 * len(plain[5])


def test_sql_functions(spark, seqs):
    register_functions(spark)
    df = spark.createDataFrame(seqs, "seq_id long, organism string, seq string").withColumn("seq", F.upper("seq"))
    df.createOrReplaceTempView("some_seqs")
    got = spark.sql("SELECT seq_id, pos, kmer FROM (SELECT seq_id, kmers(seq, 7) AS f FROM some_seqs), LATERAL inline(f)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, kmers.kmers(df, 7).select("seq_id", "pos", "kmer").collect()))
    got = spark.sql("SELECT seq_id, minimizer FROM (SELECT seq_id, minimizers(seq, 7, 4) AS f FROM some_seqs), LATERAL inline(f)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, minimizers.minimizers(df.select("seq_id", "seq"), 7, 4).collect()))
    assert spark.sql("SELECT kmers('ACGT', 0) AS a, kmers('', 3) AS b, kmers(NULL, 3) AS c, pack_kmer('acgN') AS d, unpack_kmer(pack_kmer('acgt'), 4) AS e, gc_percent('ggAA') AS f, gc_percent('') AS g").first()[:] == ([], [], None, None, "ACGT", 50.0, None)
    text = "skipped\n>a one two\r\nac\r\n\r\ngt\n> b\n>c x>y\nA>C\nN"
    rows = spark.createDataFrame([(text,)], "t string").selectExpr("fasta_records(t) AS f").selectExpr("inline(f)").collect()
    assert [tuple(r) for r in rows] == [("a", "one two", "ACGT"), ("b", "", ""), ("c", "x>y", "A>CN")]
    plan = spark.sql("SELECT kmers(seq, 7) AS f FROM some_seqs")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan
