"""Lexical search, exact BPE and periodic runs against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandweave.llm import bpe_exact, lexical, runs

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def prose(rng, n, words=60):
    return " ".join(f"w{int(rng.random() ** 3 * words)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(0, 80))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " .,; "), (63, "Ünï CODE code ÜNÏ x-y 12 w1"), (64, rows[3][1]), (65, rows[3][1]), (3, rows[3][1]), (7, "w1 w1 w1 other"), (None, "w2 w3 w4"), (66, prose(rng, 20_000, 900))]
    return rows


# --- lexical search -------------------------------------------------------------------------------------------
def brute_ranks(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = {(i, t): collections.Counter(terms(t)) for i, t in docs}
    held = {d: c for d, c in held.items() if c}
    n_docs, total = len(held), sum(c.total() for c in held.values())
    df = collections.Counter(w for c in held.values() for w in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = collections.Counter()
    for i, words in asked.items():
        scored = []
        for (d, t), c in held.items():
            m = 50 + 50 * c.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in words if w in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, s, d))
        for r, x in enumerate(sorted(scored)[:k], 1):
            out[i, r, x[4], x[3]] += 1
    return out


def ranked(found):
    return collections.Counter(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()))


ASKED = [(0, "w1 w2 W3 nothing"), (1, None), (2, ""), (3, "code Ünï"), (4, "w1"), (4, "w40 w41 w1"), (5, "absent words"), (None, "w9 w10"), (6, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9")]


def test_ranks_equal_brute_force(spark, texts):
    docs = spark.createDataFrame([(*r, "x", 1) for r in texts], DOCS + ", term string, n long")
    items = spark.createDataFrame([(*r, 5) for r in ASKED], ITEMS + ", tf long")
    for k in (3, 50):
        assert ranked(lexical.rank_documents(docs, items, k)) == brute_ranks(texts, ASKED, k)


def test_ranks_by_shuffled_joins_are_the_same(spark, texts, monkeypatch):
    monkeypatch.setattr(lexical, "FEW_TERMS", 2)
    got = lexical.rank_documents(spark.createDataFrame(texts, DOCS), spark.createDataFrame(ASKED, ITEMS), 10)
    assert ranked(got) == brute_ranks(texts, ASKED, 10)


def test_ranks_of_nothing(spark, texts):
    docs, items = spark.createDataFrame(texts, DOCS), spark.createDataFrame(ASKED, ITEMS)
    assert lexical.rank_documents(docs.limit(0), items).count() == 0
    assert lexical.rank_documents(docs, items.limit(0)).count() == 0
    assert lexical.rank_documents(docs.where("text is null or text = ''"), items).count() == 0


def test_a_stored_index_answers_further_searches(spark, texts, tmp_path):
    built = lexical.Index.build(spark.createDataFrame(texts, DOCS), path=f"file://{tmp_path}/index")
    index = lexical.Index.load(spark, f"file://{tmp_path}/index")
    assert (index.documents, index.length) == (built.documents, built.length)
    for asked in (ASKED, ASKED[:1], [(9, "w33 w1")]):
        got = index.search(lexical.item_terms(spark.createDataFrame(asked, ITEMS)), 4).selectExpr("item AS item_id", "rank", "doc AS doc_id", "score")
        assert ranked(got) == brute_ranks(texts, asked, 4)


def test_equal_scores_rank_by_id(spark):
    docs = [(i, "same text here") for i in (9, 4, 7, 1)] + [(100 + i, f"filler{i}") for i in range(9)]
    got = lexical.rank_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(0, "text")], ITEMS), 3).orderBy("rank").collect()
    assert [(r.rank, r.doc_id) for r in got] == [(1, 1), (2, 4), (3, 7)]


# --- exact BPE ------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def vocabulary():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return bpe_exact.Encoder(bpe_exact.load_tokens(vocabulary))


ODD = ["", "a", "<|endoftext|>", "x<|endoftext|> <|endoftext|><|endoftext|>y", "<|endoftext|", " \xa0 \n\n  x", "\x00\x1c\x85", "aaaa" * 300, "=" * 700, "'s'T'LL don't", "ñandú́ \U0001f600\U0001f468‍\U0001f469", "՘a꟎1\U00010940", "1234567890 ²½"]


def test_pattern_is_the_published_one():
    assert bpe_exact.public_pattern() == public_tokenizers.PATTERN


def test_ids_and_text_equal_the_library(encoder, library, texts):
    rng = random.Random(2)
    more = ["".join(rng.choice(["the", "ing", "a", "b", "e", "'", " ", "  ", "\n", "<|endoftext|>", "ation", "12", "é", "中", "=="]) for _ in range(rng.randrange(60))) for _ in range(1500)]
    more += ["".join(rng.choice("etaoinsh") for _ in range(rng.randrange(300))) for _ in range(200)]
    every = [*ODD, *[t for _, t in texts if t], *more]
    for t, ids, want in zip(every, encoder.encode_batch(every), library.encode_batch(every, add_special_tokens=False)):
        assert ids.tolist() == want.ids, t
        assert encoder.tokens.decode(ids).decode("utf-8", "replace") == library.decode(want.ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library(encoder, library, text):
    assert encoder.encode_batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_small_vocabularies_equal_plain_merging():
    """Random merge lists, whose tokens often don't merge from their own bytes alone."""
    rng = random.Random(6)

    def plain(word, ranks):
        parts = [bytes([b]) for b in word]
        while True:
            best = min(((ranks[a, b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in ranks), default=None)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for _ in range(60):
        tokens, merges = [bytes([b]) for b in range(256)], []
        while len(merges) < 25:
            a, b = (rng.choice([b"a", b"b", b"c", *tokens[256:]]) for _ in range(2))
            if a + b not in tokens:
                tokens.append(a + b)
                merges.append((a, b))
        t = bpe_exact.Tokens({x: i for i, x in enumerate(tokens)}, merges, {})
        ranks = {m: r for r, m in enumerate(merges)}
        for _ in range(40):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(40)))
            assert [tokens[i] for i in t.encode_word(word)] == plain(word, ranks)


def test_long_words_take_linear_time(encoder):
    word = "".join(random.Random(1).choice("etaoinshr") for _ in range(300_000))
    ids = encoder.encode_batch([word])[0]
    assert encoder.tokens.decode(ids) == word.encode()


def test_token_digest(spark, vocabulary, library):
    rows = [*enumerate(ODD), (1, "a"), (99, None), (None, "key is null")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", n_tokens string")
    want = collections.Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, bpe_exact.token_digest(docs, vocabulary).collect())) == want
    assert bpe_exact.token_digest(docs.limit(0), vocabulary).count() == 0


def test_encode_and_decode_tables(spark, vocabulary):
    docs = spark.createDataFrame([*enumerate(ODD), (50, None)], DOCS)
    back = bpe_exact.decode(bpe_exact.encode(docs, vocabulary), vocabulary).collect()
    assert all(r.decoded == (r.text or "") for r in back) and len(back) == len(ODD) + 1


# --- periodic runs --------------------------------------------------------------------------------------------
def brute_runs(words, least_words, least):
    n, out = len(words), {}
    for q in range(1, n // least + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= least * q:
                out.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((s, e - s, q) for (s, e), q in out.items() if e - s >= least_words)


def repeated(rng):
    letters = [b"a", b"b", b"c", b"d"][: rng.randrange(1, 5)]
    some = lambda n: [rng.choice(letters) for _ in range(n)]
    kind = rng.randrange(4)
    if kind == 0:
        return some(rng.randrange(60))
    if kind == 1:
        return some(8) + some(rng.randrange(1, 6)) * rng.randrange(1, 9) + some(5)
    if kind == 2:
        u, v = some(rng.randrange(1, 4)) * rng.randrange(3, 7), some(5)
        return u + [b"x"] + v + u + [b"y"] + v + u + [b"x"] + v + u
    a, b = [b"a"], [b"a", b"b"]
    for _ in range(rng.randrange(8)):
        a, b = b, b + a
    return b


def test_runs_equal_brute_force():
    rng = random.Random(9)
    for _ in range(250):
        many = [repeated(rng) for _ in range(rng.randrange(1, 9))]
        for least_words, least in ((6, 4), (2, 2), (3, 3)):
            assert runs.find_runs(many, least_words, least) == [brute_runs(w, least_words, least) for w in many]


def test_previous_factors_equal_brute_force():
    rng = random.Random(3)
    for _ in range(100):
        w = repeated(rng) or [b"a"]
        number = {x: i for i, x in enumerate(dict.fromkeys(w))}
        names = runs.Names(np.array([number[x] for x in w]), np.array([0, len(w)]))
        order = names.order
        assert sorted(range(len(w)), key=lambda i: [number[x] for x in w[i:]]) == order.tolist()
        factor, source = runs.previous_factors(order, np.append(0, names.forward(order[:-1], order[1:])))
        for i in range(len(w)):
            common = [next((k for k in range(len(w) - i) if w[i + k] != w[j + k]), len(w) - i) for j in range(i)]
            assert factor[i] == max(common, default=0) and (not factor[i] or common[source[i]] == factor[i])


def run_rows(rows):
    want = collections.Counter()
    for i, t in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        h, n = zlib.crc32(b"" if i is None else str(i).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        found = brute_runs(words, 6, 4)
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        want[i, len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()] += 1
    return want


def test_run_digest(spark, texts):
    rng = random.Random(8)
    rows = [*[(i, t) for i, t in texts if not t or len(t) < 9999], *[(100 + i, prose(rng, rng.randrange(1, 90), 5)) for i in range(150)], (300, "la " * 50), (301, "a b a b\x0b" * 9), (302, "Tick tock. " * 12 + "end " * 6), (303, "x\x1cy " * 8)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", start string")
    got = runs.run_digest(docs, planted=True)
    assert collections.Counter(map(tuple, got.collect())) == run_rows(rows)
    assert runs.run_digest(docs.limit(0), planted=True).count() == 0


def test_collapsed_text_and_runs_as_columns(spark):
    docs = spark.createDataFrame([(0, "go " * 7 + "on"), (1, "no repeats"), (2, None)], DOCS)
    got = {r.doc_id: r for r in runs.run_digest(docs, with_text=True).collect()}
    assert got[0].collapsed == "go on" and [tuple(x) for x in got[0].runs] == [(0, 7, 1)]
    assert got[1].collapsed == "no repeats" and got[1].runs == [] and got[2].collapsed == "" and got[2].n_runs == 0


def test_long_periodic_text():
    words = [b"u%d" % i for i in range(50_000)] + [b"a", b"b", b"c"] * 60_000 + [b"end"]
    assert runs.find_runs([words]) == [[(50_000, 180_000, 3)]]


def test_keys_named_like_other_columns(spark):
    """Decontamination and language-model scores with keys that have names of their own columns."""
    from strandweave.llm import decontam, hmm

    docs = [(i, f"some words of text {i} and more words here") for i in range(9)]
    bench = spark.createDataFrame([(1, "words of text")], ITEMS)
    plain = {r.doc_id: r[1:] for r in decontam.contamination(spark.createDataFrame(docs, DOCS), bench).collect()}
    for name in ("n_words", "row", "items"):
        got = decontam.contamination(spark.createDataFrame(docs, f"{name} long, text string"), bench, key=name)
        assert {r[0]: r[1:] for r in got.collect()} == plain and got.columns[0] == (name if name == "row" else f"{name}_key")
    want = {r.doc_id: r[1:] for r in hmm.score_texts(spark.createDataFrame(docs, DOCS), states=2, rounds=1).collect()}
    for name in ("row", "score"):
        got = hmm.score_texts(spark.createDataFrame(docs, f"{name} long, text string"), name, states=2, rounds=1)
        assert {r[0]: r[1:] for r in got.collect()} == want and got.columns[0] == (name if name == "row" else "score_key")
