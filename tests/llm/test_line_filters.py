"""Cheap tests that come before edit distances lose no similar lines, and the classifier works on pieces of 1 MB."""

import random

from pyspark.sql import functions as F

from strandweave.llm import line_dedup, toxicity


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_missing_words_and_lengths_let_every_similar_pair_pass(spark):
    draw = random.Random(5)
    rows = []
    for i in range(300):
        x = [draw.choice("abcdefghij") * draw.randint(1, 3) for _ in range(draw.randint(1, 30))]
        y = list(x)
        for _ in range(draw.randint(0, 8)):
            at = draw.randrange(len(y) + 1)
            y[at : at + draw.randint(0, 1)] = [draw.choice("abcxyz")] * draw.randint(0, 1)
        rows.append((i, x, y or ["a"]))
    df = spark.createDataFrame(rows, "i long, x array<string>, y array<string>").withColumns({"n": F.size("x"), "m": F.size("y")})
    similar = {i for i, x, y in rows if _distance(x, y) <= max(len(x), len(y)) * 20 // 100}
    passed = {r.i for r in df.where(line_dedup._few_words_missing("x", "y")).collect()}
    fit = {r.i for r in df.where(line_dedup._lengths("n", "m")).collect()}
    assert similar <= passed <= fit and len(similar) > 50 and len(passed) < 250


def test_lines_of_unlike_lengths_are_not_compared(spark, monkeypatch):
    lines = {1: "one two three four five six seven eight nine ten eleven twelve", 2: "a b c d e f g h i j k l m n o p", 3: "one two three four five six seven eight nine ten eleven twelvth"}
    monkeypatch.setattr(line_dedup, "_heads", lambda x, y, n, m: F.lit(True))  # what gets there passes
    named = spark.createDataFrame([(7, 1, h, 0, len(lines[h].split()), h) for h in lines], "block long, parts int, h1 long, simhash long, n int, label long")
    got = line_dedup._apart(named, spark.createDataFrame(list(lines.items()), "h1 long, line string"))
    assert sorted(map(tuple, got.collect())) == [(1, 3)]  # 16 words and 31 letters never meet 12 words and 62 letters


def test_texts_are_classified_in_pieces_of_a_megabyte(spark, monkeypatch):
    limits, through = [], toxicity.map_pieces
    monkeypatch.setattr(toxicity, "map_pieces", lambda df, column, fn, schema, limit=None: limits.append(limit) or through(df, column, fn, schema, limit))
    chain = toxicity.Chain((), [])
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    toxicity.score(docs, toxicity.Chain(("toxic",), [toxicity.Linear(*[toxicity.np.zeros(0, dtype) for dtype in ("uint64", float, float, float)])]))
    toxicity.remove_toxic(docs, chain)
    assert limits == [1 << 20, 1 << 20]
