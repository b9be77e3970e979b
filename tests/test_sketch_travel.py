"""Sketches travel packed, in few copies, and pairs leave a group bit by bit; hashes of any kind are counted."""

import random

from pyspark.sql import functions as F

from strandweave.operators import minimizers


def _pairs(held):
    return sorted((a, b, len(held[a] & held[b]), len(held[a] | held[b])) for a in held for b in held if a < b and held[a] & held[b])


def test_hex_and_other_hashes(spark, monkeypatch):
    draw = random.Random(4)
    plain = [f"{draw.getrandbits(32):08x}" for _ in range(12)]
    monkeypatch.setattr(minimizers, "ROWS", 5)
    for words in (plain, [*plain, "ABCDEF01", plain[0].upper(), "1234567", "123456789", ""]):
        held = {f"s{i}": set(draw.sample(words, draw.randint(1, 6))) for i in range(30)}
        df = spark.createDataFrame([(i, h) for i, hs in held.items() for h in hs], "seq_id string, hash string")
        for block in (4, 1 << 16):
            monkeypatch.setattr(minimizers, "BLOCK", block)
            assert sorted(tuple(r)[:4] for r in minimizers.sketch_jaccard(df).collect()) == _pairs(held)


def test_sketches_have_few_copies_of_four_bytes_a_hash(spark):
    hashes = F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.substring(F.md5(F.concat_ws("-", "id", i)), 1, 8))
    df = spark.range(20_000).select(F.col("id").alias("seq_id"), F.explode(hashes).alias("hash"))
    made = minimizers.sketch_jaccard(df)
    plan = made._jdf.queryExecution().analyzed().toString()
    blocks = 1 + int(plan.split("explode(sequence(0, ")[1].split(",")[0].rstrip(")"))
    assert blocks == 8 and "packed" in plan  # 10 blocks of 2,048 before, and more with each further sketch
    assert {r[0] for r in spark.range(1).select(F.octet_length(minimizers._joined(F.array(F.lit("0123abcd"), F.lit("ffffffff")))[0])).collect()} == {8}
