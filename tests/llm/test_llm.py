"""Training-data operators against brute force, exact round trips and held-out likelihood."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave.llm import _graph, _text, bpe, decontam, hmm, line_dedup, media_ts, minhash, sharding, suffix_dedup, toxicity, url_rules

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, extra string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"W{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Nulls, empty and long texts, copies, near copies, ties and repeated rows."""
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.choice([1, 3, 30, 80, 200]))) for i in range(40)]
    base = prose(rng, 120)
    for i in range(30):
        w = base.split()
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(["", "zz", f"q{i}"])
        rows.append((100 + i, " ".join(w)))
    rows += [(200, base), (201, base), (202, None), (203, ""), (204, "  \n\n "), (205, None), (None, base), (None, "alone here"), (206, prose(rng, 5000)), (207, "a b"), (208, "A B"), (1, rows[1][1])]
    return rows


# --- 1 --------------------------------------------------------------------------------------------------------
def test_transport_stream_round_trip():
    rng = random.Random(1)
    for n in [0, 1, 5, 160, 176, 183, 184, 185, 191, 192, 193, 3071, 3072, 3073, 50_000]:
        payload = media_ts.pad(bytes(rng.randrange(256) for _ in range(n)))
        assert len(payload) % 192 == 0 and payload
        p = media_ts.parse(media_ts.mux(payload))
        stream = p.streams[media_ts.DATA_PID]
        assert stream.data == payload
        assert (p.continuity_errors, p.sync_errors, p.table_errors, p.broken_pes, p.programs) == (0, 0, 0, 0, {1: media_ts.PMT_PID})
        assert [u[0] for u in stream.units] == [k * media_ts.TICKS for k in range(len(stream.units))]
        assert [k for k, u in enumerate(stream.units) if u[2]] == list(range(0, len(stream.units), media_ts.KEY_EVERY))


def test_transport_stream_damage_is_counted():
    ts = media_ts.mux(media_ts.pad(b"x" * 9000))
    lost = ts[: 188 * 5] + ts[188 * 6 :]
    assert media_ts.parse(lost).continuity_errors == 1 and media_ts.parse(lost).broken_pes >= 1
    twice = ts[: 188 * 6] + ts[188 * 5 :]
    assert media_ts.parse(twice).continuity_errors == 0 and media_ts.parse(twice).streams[256].data == media_ts.parse(ts).streams[256].data
    assert media_ts.parse(b"\0\0" + ts).sync_errors == 1
    bad = bytearray(ts)
    bad[14] ^= 1
    assert media_ts.parse(bytes(bad)).table_errors == 1
    assert media_ts.parse(None).n_packets == media_ts.parse(b"").n_packets == 0


def test_media_digest(spark, corpus):
    got = media_ts.text_media_digest(frame(spark, corpus)).collect()
    assert len(got) == len(corpus)
    want = collections.Counter((i, len((t or "").encode()), hashlib.sha256(media_ts.pad((t or "").encode())).hexdigest(), zlib.crc32(media_ts.pad((t or "").encode())[-16:])) for i, t in corpus)
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    stored = media_ts.store_text(frame(spark, corpus[:5] + [(202, None)]))
    parsed = media_ts.parse_media(stored).collect()
    assert [bytes(r.streams[0].data) for r in parsed] == [media_ts.pad((t or "").encode()) for _, t in corpus[:5] + [(202, None)]]
    assert media_ts.text_media_digest(frame(spark, [])).count() == 0


# --- 2 --------------------------------------------------------------------------------------------------------
def brute_contamination(docs, bench):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = lambda t: rx.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in bench:
        x = w(t)
        n = min(13, len(x))
        for k in range(len(x) - n + 1 if x else 0):
            windows.setdefault(tuple(x[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        x, items = w(t), set()
        hit = [0] * len(x)
        for n in {len(k) for k in windows}:
            for k in range(len(x) - n + 1):
                if own := windows.get(tuple(x[k : k + n])):
                    items |= own
                    hit[k : k + n] = [1] * n
        out.append((d, len(x), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(x)))
    return collections.Counter(out)


def test_decontamination(spark, corpus):
    rng = random.Random(3)
    bench = [(i, " ".join(corpus[i * 2][1].split()[:40])) for i in range(10)] + [(50, "solo"), (51, None), (52, ""), (None, prose(rng, 20)), (53, "w1 w1 w1 w1"), (10, "b, c!")]
    docs = corpus + [(300, "x SOLO y"), (301, "w1 " * 50), (302, bench[13][1] + " " + bench[3][1])]
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = decontam.contamination(frame(spark, docs), b)
    assert collections.Counter(tuple(r)[:6] for r in got.collect()) == brute_contamination(docs, bench)
    kept = decontam.decontaminate(frame(spark, docs), b)
    assert kept.columns == ["doc_id", "text", "extra"]
    assert kept.count() == sum(n for r, n in brute_contamination(docs, bench).items() if not r[5])
    assert decontam.contamination(frame(spark, docs), b.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_benchmark_in_blocks_gives_the_same(spark, corpus):
    bench = spark.createDataFrame([(i, corpus[i][1]) for i in range(12)], "item_id long, text string")
    one = decontam.broadcast_benchmark(bench)
    many = decontam.broadcast_benchmark(bench, block_bytes=500)
    assert len(one) == 1 < len(many)
    texts = pa.array([t for _, t in corpus], pa.string())
    a, b = (decontam.match_shard(texts, [x.value for x in blocks]) for blocks in (one, many))
    assert (a.n_hit == b.n_hit).all() and a.items == b.items and (a.longest == b.longest).all()


def test_windows_that_many_items_share():
    rng = random.Random(8)
    shared = " ".join(f"s{i}" for i in range(13))
    bench = [(i, f"{prose(rng, 9)} {shared} own{i}") for i in range(300)] + [(400, "two words"), (401, "two words"), (402, "Two, WORDS!")]
    docs = [(i, f"d{i} {shared} end two words") for i in range(60)] + [(60, bench[7][1]), (61, shared[:-1]), (62, ""), (63, None)]
    index = decontam.BenchmarkIndex.build([i for i, _ in bench], [t for _, t in bench])
    texts = pa.array([t for _, t in docs], pa.string())
    m, plain = decontam.match_shard(texts, [index]), decontam.match_shard(texts, [index], items=False)
    want = {r[0]: r for r in brute_contamination(docs, bench)}
    for i in range(len(docs)):
        assert (m.n_words[i], m.n_hit[i], len(m.items[i])) == want[i][1:4] and plain.n_hit[i] == m.n_hit[i]
    words = re.findall(r"[0-9a-z]+", bench[7][1])
    assert (m.longest[60], m.longest_item[60], m.longest_at[60]) == (len(words), "7", 0)


def test_equal_hashes_do_not_make_equal_windows(monkeypatch):
    monkeypatch.setattr(decontam, "_symbols", lambda piece, start, end: np.ones(len(start), np.uint64))
    index = decontam.BenchmarkIndex.build([1, 2, 3], ["red fox", "tan cat", "red fox"])
    m = decontam.match_shard(pa.array(["a red fox", "tan cat", "tan fox", "tanc at"]), [index])
    assert m.items == [{"1", "3"}, {"2"}, set(), set()] and m.n_hit.tolist() == [2, 2, 0, 0]


# --- 3 --------------------------------------------------------------------------------------------------------
def test_forward_recursion_is_exact():
    m = hmm.Model.first(np.array([0.1, 0.2, 0.3, 0.4]), 3)
    seqs = [np.array([0, 3, 2, 1]), np.array([1]), np.array([2, 2]), np.zeros(0, np.int64)]
    b = hmm._Batch(seqs)
    got = b.log_likelihood(b.forward(m)[1])
    for s, l in zip(seqs[:3], got):
        p = sum(np.prod([m.start[z[0]] * m.emit[s[0], z[0]]] + [m.move[z[i - 1], z[i]] * m.emit[s[i], z[i]] for i in range(1, len(s))]) for z in itertools.product(range(3), repeat=len(s)))
        assert abs(math.log(p) - l) < 1e-5
    assert got[3] == 0


def test_expected_counts_equal_enumeration_and_raise_likelihood():
    rng = np.random.default_rng(0)
    m = hmm.Model.first(np.ones(4) / 4, 2)
    seqs = [rng.integers(0, 4, n) for n in (1, 3, 5)]
    starts, moves, emits, before = hmm._Batch(seqs).expected(m)
    ws, wm, we = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for s in seqs:
        paths = list(itertools.product(range(2), repeat=len(s)))
        p = np.array([np.prod([m.start[z[0]] * m.emit[s[0], z[0]]] + [m.move[z[i - 1], z[i]] * m.emit[s[i], z[i]] for i in range(1, len(s))]) for z in paths])
        for z, q in zip(paths, p / p.sum()):
            ws[z[0]] += q
            for i in range(1, len(s)):
                wm[z[i - 1], z[i]] += q
            for x, k in zip(s, z):
                we[x, k] += q
    assert np.allclose(starts, ws, atol=1e-4) and np.allclose(moves, wm, atol=1e-4) and np.allclose(emits, we, atol=1e-4)
    after = hmm._Batch(seqs).expected(hmm.Model(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0)))[3]
    assert after > before


def test_language_model(spark, corpus):
    got = hmm.score_texts(frame(spark, corpus), states=2, rounds=2).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in corpus if not held(i) for w in [*words(t), "\n"])
    total, distinct = sum(c.values()), len(c)
    want = collections.Counter()
    for i, t in corpus:
        w = [*words(t), "\n"]
        want[i, held(i), len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in w), 6)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert hmm.score_texts(frame(spark, []), states=2, rounds=1).count() == 0


def test_words_beyond_the_frequent_table_are_joined(spark, corpus, monkeypatch):
    full = {(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 6)) for r in hmm.score_texts(frame(spark, corpus), states=2, rounds=1).collect()}
    monkeypatch.setattr(hmm, "FREQUENT", 20)
    few = {(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 6)) for r in hmm.score_texts(frame(spark, corpus), states=2, rounds=1).collect()}
    assert full == few


def test_hidden_states_beat_word_frequencies_on_held_out_texts(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{rng.randrange(30)}" for _ in range(60))) for i in range(200)]
    got = hmm.score_texts(frame(spark, rows), states=4, rounds=6).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


# --- 4 --------------------------------------------------------------------------------------------------------
def brute_repeats(rows, length):
    c = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        c.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = collections.Counter()
    for d, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if c[b[p : p + length]] > 1:
                m[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, m) if not g)
        out[d, len(b), sum(m), sum(m[i] and (i == 0 or not m[i - 1]) for i in range(len(b))), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_suffix_sort_equals_python():
    rng = random.Random(5)
    data = np.frombuffer(b"".join(rng.choice([b"ab", b"abab", b"c", b"aaaa"]) for _ in range(800)), np.uint8)
    pos = np.arange(len(data) - 40)
    order, lcp = suffix_dedup.Suffixes(data, 40).sort(pos)
    assert order.tolist() == sorted(pos.tolist(), key=lambda p: (data[p : p + 40].tobytes(), p))
    for a, b, n in zip(order, order[1:], lcp[1:]):
        x, y = data[a : a + 40].tobytes(), data[b : b + 40].tobytes()
        assert n == next((i for i in range(40) if x[i] != y[i]), 40)


def test_collisions_are_found_by_comparing_bytes():
    s = suffix_dedup.Suffixes(np.frombuffer(b"abcdefgh12345678abcdefgh1234567X", np.uint8), 16)
    lcp = np.array([0, 16])
    s._verify(np.array([0, 16]), lcp)
    assert lcp.tolist() == [0, 15]


@pytest.mark.parametrize("length,gram", [(40, 10), (400, 100)])
def test_repeats(spark, length, gram):
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh é") for _ in range(600))
    rows = [(0, base), (1, base), (2, "x" * 300 + base[50:]), (3, None), (4, ""), (5, "a" * 900), (6, base[:250] + "Q" + base[251:]), (7, "ab" * 400), (8, base[100:320] + base[90:]), (9, "short"), (None, base[7:500]), (2, "x" * 300 + base[50:])]
    rows += [(10 + i, base[i : 100 + 3 * i] + rng.choice("zyx") * rng.randint(0, 9) + base[200 - i :]) for i in range(15)]
    got = suffix_dedup.remove_repeats(frame(spark, rows), length=length, gram=gram, with_text=True)
    assert collections.Counter(tuple(r)[:5] for r in got.collect()) == brute_repeats(rows, length)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got.collect())


def brute_shared(rows, n):
    """Words in windows of n words that a row with another key or text holds as well."""
    split = [re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").translate(LOWER)) for _, t in rows]
    owners = collections.defaultdict(set)
    for r, w in zip(rows, split):
        for p in range(len(w) - n + 1):
            owners[tuple(w[p : p + n])].add(r)
    out = collections.Counter()
    for r, w in zip(rows, split):
        hit = set()
        for p in range(len(w) - n + 1):
            if len(owners[tuple(w[p : p + n])]) > 1:
                hit.update(range(p, p + n))
        out[r[0], len(hit)] += 1
    return out


def test_shared_passages(spark):
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("aeiourst") for _ in range(rng.choice([1, 2, 4])))
    text = lambda n: [word() for _ in range(n)]
    passages = [text(n) for n in (49, 50, 51, 55, 60, 130)]
    rows = []
    for i in range(40):
        w = text(rng.randrange(0, 200))
        for p in rng.sample(passages, rng.randrange(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        rows.append((i, " ".join(w)))
    own = text(60)
    rows += [(100, " ".join(own + ["x"] + own)), (101, "la " * 300), (102, "la " * 120 + "LA, la!"), (103, None), (104, ""), (None, " ".join(passages[3])), (105, " ".join(passages[5][10:90])), rows[3], rows[3], (106, "\n".join(x.upper() + "." for x in passages[2]))]
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.n_shared_words) for r in got) == brute_shared(rows, suffix_dedup.WORDS)
    assert all(r.shared_passage == (r.n_shared_words > 0) for r in got)
    assert brute_repeats(rows, 400) == collections.Counter(tuple(r)[:5] for r in got)


@pytest.mark.parametrize("most", [0, 1 << 18])
def test_repeats_in_larger_texts(spark, monkeypatch, most):
    """Several megabytes, by hashing all windows, with and without the broadcast of ids."""
    monkeypatch.setattr(_graph, "PICKED", most)
    rng = random.Random(42)
    block = ["".join(rng.choice("abcdefghij ") for _ in range(rng.choice([150, 390, 399, 400, 401, 700, 3000]))) for _ in range(60)]
    rows = [(i, "".join(rng.choice(block) if rng.random() < 0.3 else "".join(rng.choices("abcdefghijklmnop ", k=rng.randrange(1, 2500))) for _ in range(rng.randrange(1, 12)))) for i in range(300)]
    rows.append((1000, "".join(rng.choices("abcdefghijkl ", k=5_000_000)) + block[3] * 2))
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    data = [np.frombuffer(t.encode(), np.uint8) for _, t in rows]
    digests = [[hash(t[p : p + 400]) for p in range(max(0, len(t) - 399))] for _, t in rows]
    seen, again = set(), set()
    for d in digests:
        for x in d:
            (again if x in seen else seen).add(x)
    for r, (_, t), b, d in zip(sorted(got, key=lambda r: r.doc_id), rows, data, digests):
        change = np.zeros(len(b) + 1, np.int64)
        for p, x in enumerate(d):
            if x in again:
                change[p] += 1
                change[p + 400] -= 1
        gone = np.cumsum(change[:-1]) > 0
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(b), int(gone.sum()), hashlib.sha256(b[~gone].tobytes()).hexdigest())


def test_searches_for_repeats_work_on_small_pieces(spark, monkeypatch):
    limits, mapped = [], suffix_dedup.map_pieces
    monkeypatch.setattr(suffix_dedup, "map_pieces", lambda df, column, fn, schema, limit=_text.PIECE_BYTES: limits.append(limit) or mapped(df, column, fn, schema, limit))
    rng = random.Random(43)
    shared = prose(rng, 120)
    suffix_dedup.remove_repeats(frame(spark, [(i, prose(rng, 50) + shared) for i in range(4)])).count()
    assert len(limits) == 7
    batch = pa.RecordBatch.from_arrays([pa.array([prose(rng, 500) for _ in range(2000)])], names=["text"])
    assert batch.nbytes > 3 << 20
    tracemalloc.start()
    for piece in _text.pieces(batch, "text", max(limits)):
        suffix_dedup._Anchored(piece.column("text"), False, suffix_dedup.LENGTH, suffix_dedup.GRAM)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


def test_repeats_of_nothing(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


# --- 5 --------------------------------------------------------------------------------------------------------
def test_url_rules(spark):
    urls = [None, "", "no scheme/x", "http://A.Org", "https://x.example.org/es/1", "http://example.org/es", "http://www.example.org/en/19?q#f", "http://example.org/en/2", "http://a.com/de/x", "http://com/fr/", "http://acom/de/", "http://b.net/casino", "http://b.net/casinos", "ftp://x.com/fr/?a", "http://x.com?/de/", "http://x.com/DE/", "a://b://c.org/", "http://www.cheap-pills.example.com/de/1", "http://www.cheap-pills.example.net/", "http://x.example.org.evil.net/es/", "http://x.net/cheappills/", "http://x.net/Xcasino/", "http://x.net/a/xxxA", "http://x.net/casino\u212a", "http://x.net/x\ncasino"]
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    got = {r.page_id: r for r in url_rules.filter_urls(spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fit = max((r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])), key=lambda r: len(r[0] + r[1]), default=None)
        bad = any(re.search(r.pattern, host + path) for r in url_rules.CONTENT_RULES)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, fit and fit[0] + fit[1], fit[2] if fit else "block" if bad else "allow"), u


def test_rules_are_filed_under_their_rarest_token():
    rules = (url_rules.Rule("block", "example.org", "/es/"), url_rules.Rule("block", "com", "/e"), url_rules.Rule("block", pattern="x+"), url_rules.Rule("block", pattern="/(ads|banner)/"))
    assert url_rules.build_index(rules, {"example": 9, "org": 20, "es": 3, "com": 50}) == {"es": [0], "com": [1], "": [2], "ads": [3], "banner": [3]}


def test_tokens_of_a_pattern_are_in_every_match():
    of = url_rules.pattern_tokens
    assert of(url_rules.CONTENT_RULES[0].pattern) == (("cheappills",), ("cheap", "pills"))
    assert of(r"/ads/\d+\.gif$") == (("ads", "gif"),)
    assert of(r"\bcasino\b") == (("casino",),)
    for p in ("casino", "(?i)/casino/", "/cas.no/", "/(casino|x+)/", "/casino?", "[", "/a+/", "/[a-z]ads/", r"/\Qads\E/", "/ads[^a-z]"):
        assert of(p) == (), p


def test_long_rule_lists_equal_brute_force(spark):
    rng = random.Random(51)
    label = lambda n: f"h{rng.randrange(n)}"
    hosts = [f"{label(40000)}.{rng.choice(['com', 'net', 'co.uk'])}" for _ in range(100_000)]
    rules = tuple(dict.fromkeys(url_rules.Rule(rng.choice(["allow", "block"]), h, rng.choice(["/", "/a", "/a/b/", "/C/"])) for h in hosts)) + (url_rules.Rule("block", "com", "/zz/"),)
    content = url_rules.CONTENT_RULES + (url_rules.Rule("block", pattern="q[0-9]q"), url_rules.Rule("allow", pattern="/(fine|good)/"))
    urls = [f"http://{rng.choice(['', 'www.', 'a.b.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/a', '/a/b/c', '/C/', '/c/', '/zz/', '/q7q', '/good/', '/casino', '/cheappills/'])}" for _ in range(3000)] + [None, "", "http://x.com/casino", "http://x.com/casino", "http://other.org/fine/q1q"]
    by_host = collections.defaultdict(list)
    for n, r in enumerate(rules):
        by_host[r.host].append((n, r))
    got = url_rules.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, content).collect()
    assert len(got) == len(urls)
    few_ = url_rules.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), (), content).collect()
    assert {r.page_id: r.content_rule for r in few_} == {r.page_id: r.content_rule for r in got}
    for r in got:
        labels = r.host.split(".")
        fit = [(-len(x.name), n, x) for k in range(len(labels)) for n, x in by_host.get(".".join(labels[k:]), []) if r.path.startswith(x.path)]
        own = [(-len(x.name), n, x) for n, x in enumerate(content) if re.search(x.pattern, r.host + r.path)]
        best = min(fit or own, default=None, key=lambda f: f[:2])
        assert (r.rule, r.verdict) == (best[2].name if fit else None, best[2].action if best else "allow"), r
        assert r.content_rule == (min(own, key=lambda f: f[:2])[2].name if own else None)


# --- 6 --------------------------------------------------------------------------------------------------------
def shingle_set(t):
    w = words(t)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(zip(*[w[i:] for i in range(5)]))


def brute_components(rows, percent):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        if not sets[i]:
            out.append((d, 0, d))
        else:
            ids = [rows[j][0] for j in range(len(rows)) if sets[j] and find(j) == find(i) and rows[j][0] is not None]
            out.append((d, len(sets[i]), min(ids, default=None)))
    return collections.Counter(out)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, corpus, percent):
    got = minhash.near_duplicate_groups(frame(spark, corpus), percent)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(corpus, percent)
    assert got.where("kept <> (doc_id <=> component_id)").count() == 0


def test_sets_that_share_one_digest_are_told_apart(spark):
    rows = [(1, 5, 50), (2, 5, 51), (3, 5, 50), (4, 6, 60), (5, 6, 60)]
    got = {r.i: r.node for r in minhash.part_nodes(spark.createDataFrame(rows, "i long, node long, check long")).collect()}
    assert got[1] == got[3] != got[2] and got[4] == got[5] == 6


def test_near_duplicates_link_through_chains(spark):
    rng = random.Random(8)
    w = prose(rng, 150, 10_000).split()
    rows = []
    for i in range(40):  # each differs a little from the one before; the ends have little in common
        w[(7 * i) % 150] = f"n{i}"
        rows.append((500 - i, " ".join(w)))
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicate_groups(frame(spark, rows)).collect()) == brute_components(rows, 85)


def test_remove_near_duplicates(spark, corpus):
    kept = minhash.remove_near_duplicates(frame(spark, corpus), 80)
    want = [d for (d, n, c), k in brute_components(corpus, 80).items() for _ in range(k) if d == c]
    assert kept.columns == ["doc_id", "text", "extra"]
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == sorted(-1 if d is None else d for d in want)
    assert minhash.near_duplicate_groups(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(60)] + [(None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs[:-1]:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in _graph.components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in parent}


# --- 7 --------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    return path, public.PATTERN, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, corpus, tokenizer):
    path, pattern, library = tokenizer
    texts = [t for _, t in corpus] + ["", None, " ", "a" * 3000, "\n\n\n  x", "<|endoftext|> 北京 日本語 🎉🎉 é́", "=-" * 900, "it's 12 o'clock"]
    enc = bpe.Encoder(bpe.load_ranks(path), pattern)
    for t, ids in zip(texts, enc.encode_batch(texts)):
        assert ids.tolist() == library.encode_ordinary(t or "")
        assert enc.ranks.decode(ids.tolist()) == (t or "").encode()
    rng = random.Random(6)
    for long in ("".join(rng.choices("abcdeghilnorstu", k=1 << 20)), "ab" * 100_000, "é" * 30_001):
        (ids,) = enc.encode_batch([long])
        assert ids.tolist() == library.encode_ordinary(long)
    docs = frame(spark, list(enumerate(texts)))
    back = bpe.decode(bpe.encode(docs, path, pattern), path)
    assert {r.doc_id: bytes(r.decoded) for r in back.collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    clash = bpe.token_digest(docs.withColumn("n_tokens", F.lit("x")), path, pattern, keep=("extra", "n_tokens"))
    assert clash.columns == ["doc_id", "extra", "n_tokens", "ids_sha256", "decoded_sha256"] and dict(clash.dtypes)["n_tokens"] == "bigint"
    digest = {r.doc_id: r for r in bpe.token_digest(docs, path, pattern).collect()}
    for i, t in enumerate(texts):
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        assert (digest[i].n_tokens, digest[i].ids_sha256, digest[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


# --- 8 --------------------------------------------------------------------------------------------------------
def test_toxicity_chain(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(900):
        w = prose(rng, rng.randrange(20, 200)).split()
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "scum"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    rows += [(2000, None), (2001, ""), (2002, "!!"), (None, "idiot moron scum w1 w2 w3 w4 w5")]
    docs, marks = frame(spark, rows), spark.createDataFrame([*labels, labels[0], (None, 1, 1), (5000, None, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train_chain(docs.where("doc_id < 600 or doc_id is null"), marks)
    got = toxicity.score(docs, chain)
    assert got.columns == ["doc_id", "text", "extra", "p_quality", "p_toxic", "toxic"]
    held = got.where("doc_id between 600 and 899").collect()
    assert np.mean([r.toxic == (r.doc_id % 6 == 0) for r in held]) > 0.97
    assert not any(r.toxic for r in got.where("doc_id >= 2000").collect())
    kept = toxicity.remove_toxic(docs, chain)
    assert kept.columns == docs.columns and kept.count() == got.where("not toxic").count()
    nothing = toxicity.train_chain(docs, marks.limit(0))
    assert toxicity.score(docs, nothing).where("toxic").count() == 0


def test_words_chosen_on_executors_equal_those_chosen_from_all_rows(spark):
    rng = random.Random(31)
    rows, labels = [], []
    for i in range(400):
        bad, dull = i % 4 == 0, i % 3 == 0
        rows.append((i, prose(rng, 60, 80) + " idiot" * bad + " moron" * (bad and i % 8 == 0) + " meh meh" * dull))
        labels.append((i, int(dull), int(bad)))
    rows += [(7, "another text of the same key")] * 50 + [(None, "idiot"), (900, None)]
    docs, marks = frame(spark, rows), spark.createDataFrame([*labels, (900, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train_chain(docs, marks)
    # The same rows by brute force: for each key its text with the smallest hash, in the order of the key's hash.
    keyed = docs.join(marks, "doc_id").select("doc_id", "text", "quality", "toxic", F.xxhash64("doc_id").alias("o"), F.xxhash64("text").alias("t")).collect()
    one = sorted({r.doc_id: r for r in sorted(keyed, key=lambda r: -r.t)}.values(), key=lambda r: r.o)
    row, h, dense = toxicity._piece_features(pa.array([r.text for r in one], pa.string()))
    want = toxicity.fit_rows(row, h, dense, np.array([(r.quality, r.toxic) for r in one]), np.array([r.o % toxicity.FOLDS for r in one]), toxicity.CATEGORIES)
    for a, b in zip(chain.models, want.models):
        assert a.words.tolist() == b.words.tolist() and np.allclose(a.weight, b.weight, atol=1e-6)
    assert len(chain.models[1].words)
    few = toxicity._sample(docs, marks, {"_y0": "quality", "_y1": "toxic"}, "doc_id", "text", 5)
    assert few.count() == 5


def test_out_of_fold_probabilities_feed_the_next_model():
    rng = np.random.default_rng(1)
    n = 400
    y = np.c_[rng.random(n) < 0.5, rng.random(n) < 0.5]
    h = np.where(y[:, 0], 11, 22).astype(np.uint64)
    chain = toxicity.fit_rows(np.arange(n), h, np.zeros((n, toxicity._DENSE)), y, np.arange(n) % 5, ("a", "b"))
    assert len(chain.models[1].center) == toxicity._DENSE + 1


# --- 9 --------------------------------------------------------------------------------------------------------
def brute_lines(spark, rows):
    """Groups by the definition: SimHash within BITS bits and edit distance in words, over all pairs."""
    norm = lambda l: re.sub("[^0-9a-z\x80-\U0010ffff]+", " ", l.lower()).strip(" ")
    lines = sorted({norm(l) for _, t in rows for l in (t or "").split("\n")} - {""})
    vocabulary = sorted({w for l in lines for w in l.split(" ")})
    h = {r.w: r.h & (2**64 - 1) for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.xxhash64("w").alias("h")).collect()}

    def simhash(l):
        w = l.split(" ")
        return None if len(w) < line_dedup.LEAST_WORDS else sum(1 << i for i in range(64) if 2 * sum(h[x] >> i & 1 for x in w) > len(w))

    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            q = [i]
            for j, e in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != e)))
            p = q
        return p[-1]

    parent = {l: l for l in lines}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    s = {l: simhash(l) for l in lines}
    for a, b in itertools.combinations([l for l in lines if s[l] is not None], 2):
        if (s[a] ^ s[b]).bit_count() <= line_dedup.BITS:
            x, y = a.split(" "), b.split(" ")
            if distance(x, y) <= max(len(x), len(y)) * (100 - line_dedup.SIMILARITY) // 100:
                parent[find(a)] = find(b)
    keys = {(r.doc_id, r.text): r.k for r in frame(spark, rows).select("doc_id", "text", F.xxhash64("text").alias("k")).collect()}
    first = {}
    order = lambda d, t, i: ((d is not None, d or 0), keys[d, t], i)
    for d, t in rows:
        for i, l in enumerate((t or "").split("\n")):
            if norm(l):
                g = find(norm(l))
                first[g] = min(first.get(g, order(d, t, i)), order(d, t, i))
    out = collections.Counter()
    for d, t in rows:
        kept = [l for i, l in enumerate((t or "").split("\n")) if not norm(l) or first[find(norm(l))] == order(d, t, i)]
        n = len(t.split("\n")) if t is not None else 0
        out[d, None if t is None else "\n".join(kept), n, n - len(kept) if t is not None else 0] += 1
    return out


def test_line_dedup(spark):
    rng = random.Random(12)
    pool = [prose(rng, rng.choice([1, 2, 6, 12, 40]), 300) for _ in range(25)]
    for l in list(pool):
        w = l.split()
        for _ in range(2):
            v = list(w)
            v[rng.randrange(len(v))] = rng.choice(["new", "W7", "é"])
            pool.append(" ".join(v))
    rows = [(i, "\n".join(rng.choice(["", "!!", rng.choice(pool), rng.choice(pool).upper() + "."]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, pool[0] + "\nown line of null"), (3, rows[3][1]), (103, prose(rng, 9000))]
    got = line_dedup.dedup_lines(frame(spark, rows))
    assert collections.Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == brute_lines(spark, rows)
    kept = line_dedup.remove_duplicate_lines(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "extra"]
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def edited(rng, line, words, letters):
    """The line with some words replaced and, in other words, one letter each."""
    w = line.split()
    at = rng.sample(range(len(w)), words + letters)
    for i in at[:words]:
        w[i] = "".join(rng.choice("bcdfgh") for _ in range(7))
    for i in at[words:]:
        j = rng.randrange(len(w[i]))
        w[i] = w[i][:j] + "x" + w[i][j + 1 :]
    return " ".join(w)


def found(spark, pairs):
    """Whether the second line of each pair, a text each, goes."""
    got = line_dedup.dedup_lines(frame(spark, [(i, f"{a}\n{b}") for i, (a, b) in enumerate(pairs)])).select("doc_id", "n_dropped").collect()
    gone = {r.doc_id: r.n_dropped == 1 for r in got}
    return [gone[i] for i in range(len(pairs))]


def own_line(rng, n):
    return " ".join("".join(rng.choice("aeiourstlnmp") for _ in range(rng.choice([2, 3, 5, 7, 9]))) for _ in range(n))


def test_lines_with_replaced_words_are_found(spark):
    rng = random.Random(21)
    kinds = [(n, words) for n in (5, 8, 10, 20, 50) for words in {1, n // 5} for _ in range(60)]
    lines = [(own_line(rng, n), words) for n, words in kinds]
    got = found(spark, [(l, edited(rng, l, words, 0)) for l, words in lines])
    for kind in set(kinds):
        assert np.mean([g for g, k in zip(got, kinds) if k == kind]) >= 0.95, kind


def test_lines_beyond_the_packed_counters_have_simhashes(spark):
    rng = random.Random(22)
    line = prose(rng, 9000)
    rows = frame(spark, [(1, line), (2, line.replace(" ", "  ", 1))])
    w = line.lower().split()
    h = {r.w: r.h for r in spark.createDataFrame([(x,) for x in set(w)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    want = sum(1 << i for i in range(64) if 2 * sum(h[x] >> i & 1 for x in w) > len(w))
    assert [r.simhash & (2**64 - 1) for r in line_dedup.occurrences(rows).collect()] == [want, want]
    assert found(spark, [(line, edited(rng, line, 1, 0))]) == [True]


def test_lines_with_changed_letters_are_found(spark):
    rng = random.Random(23)
    kinds = [(10, 3), (20, 6), (50, 15)]
    lines = [(own_line(rng, n), n, letters) for n, letters in kinds for _ in range(60)]
    short = [("greetings everybody", "greetinqs everybody"), ("internationale", "internatiomale"), ("one two three seventeen", "one two threx seventeen"), ("hello there again my friends", "hallo there again my friend"), ("thoroughly different", "something unrelated")]
    got = found(spark, [(l, edited(rng, l, 0, letters)) for l, _, letters in lines] + short)
    for n, _ in kinds:
        share = np.mean([g for g, l in zip(got, lines) if l[1] == n])
        print("letters", n, share)
        assert share >= 0.8, n
    assert got[-5:] == [True, True, True, True, False]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_dropped_lines_equal_groups_by_words_or_letters(spark):
    """Groups of lines that are 80 % alike in words or in letters, over all pairs; nothing of the operator is used."""
    rng = random.Random(31)
    lines = []
    for n in (1, 2, 3, 4, 5, 6, 8, 10, 12, 14, 18) * 3:
        line = own_line(rng, n)
        lines += [line, edited(rng, line, n // 6, 0), edited(rng, line, 0, (n + 2) // 4), own_line(rng, n)]
    lines = list(dict.fromkeys(lines))
    alike = lambda a, b: 5 * edit_distance(a, b) <= max(len(a), len(b))
    group = {l: l for l in lines}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(lines, 2):
        if abs(len(a) - len(b)) * 5 <= max(len(a), len(b)) and alike(a, b) or alike(a.split(), b.split()):
            group[root(b)] = root(a)
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(frame(spark, list(enumerate(lines)))).collect()}
    first: dict = {}
    want = {}
    for i, l in enumerate(lines):
        want[i] = int(root(l) in first)
        first.setdefault(root(l), i)
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.97 * sum(want.values())


def test_signatures_let_every_similar_pair_pass(spark):
    """The filter before short lines are fetched loses no pair that is alike in words or in letters, and most others go."""
    rng = random.Random(1)
    rows = []
    for n in range(1, 12):
        for kind in [k % 3 for k in range(180)]:
            a = own_line(rng, n)
            b = edited(rng, a, n // 5, 0) if kind == 0 else edited(rng, a, 0, max(1, n // 3)) if kind == 1 else own_line(rng, n)
            w = b.split()
            if rng.random() < 0.3:
                w.insert(rng.randrange(len(w) + 1), "zq")
            rows.append((a, " ".join(w[:11]), n, len(w[:11])))
    df = spark.createDataFrame(rows, "a string, b string, na int, nb int").withColumns({"sa": line_dedup._signature(F.col("a")), "sb": line_dedup._signature(F.col("b"))})
    gone = 0
    for r in df.withColumn("could", line_dedup._could("sa", "sb", "na", "nb")).collect():
        alike = 5 * edit_distance(r.a, r.b) <= max(len(r.a), len(r.b)) or 5 * edit_distance(r.a.split(), r.b.split()) <= max(r.na, r.nb)
        assert r.could or not alike
        gone += not r.could
    assert gone > 400


def test_pairs_are_compared_in_rounds(spark, monkeypatch):
    rng = random.Random(41)
    lines = [own_line(rng, 20) for _ in range(12)]
    rows = [(i, edited(rng, line, 1, 0)) for i, line in enumerate(lines)] + [(100 + i, line) for i, line in enumerate(lines)]
    want = sorted(map(tuple, line_dedup.dedup_lines(frame(spark, rows)).collect()))
    assert sum(r[-1] for r in want) >= 10
    of_round, compared = [], line_dedup._compared

    def counted(pairs, *lines):
        of_round.append(pairs.count())
        return compared(pairs, *lines)

    monkeypatch.setattr(line_dedup, "_compared", counted)
    monkeypatch.setattr(line_dedup, "ROUND_LETTERS", 200)
    assert sorted(map(tuple, line_dedup.dedup_lines(frame(spark, rows)).collect())) == want
    assert len(of_round) > 3 and max(of_round) < 10 <= sum(of_round)


def test_heads_let_every_similar_pair_pass(spark):
    """Comparing first letters loses no pair that is alike in letters, wherever its edits stand, and most others go."""
    rng = random.Random(51)
    rows = []
    for k in range(400):
        a = own_line(rng, rng.choice([1, 3, 12, 25]))
        if k % 4:
            b, most = list(a), len(a) // 5
            at = rng.randrange(len(a))
            for _ in range(most):
                # Edits come in one place or all over; letters come, go or change.
                i = min(at, len(b) - 1) if k % 4 == 1 else rng.randrange(len(b))
                b[i : i + rng.choice([0, 1, 1])] = rng.choice(["", "x", "x"])
                b = b or ["x"]
            b = "".join(b)
        else:
            b = own_line(rng, len(a.split()))
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a string, b string")
    short = lambda c: F.left(c, F.floor(F.length(c) * line_dedup.HEADS[-1] / 100).cast("int"))
    df = df.select("a", "b", short("a").alias("x"), short("b").alias("y"))
    gone = 0
    for r in df.select("a", "b", line_dedup._heads("x", "y", F.length("a"), F.length("b")).alias("heads"), line_dedup._heads("a", "b", F.length("a"), F.length("b")).alias("lines")).collect():
        alike = 5 * edit_distance(r.a, r.b) <= max(len(r.a), len(r.b))
        assert r.heads == r.lines and (r.heads or not alike)
        gone += not r.heads
    assert gone > 60


def test_unlike_pairs_of_a_block_do_not_travel_with_their_texts(spark, monkeypatch):
    """Lines of one block and SimHash that are unlike in words and letters go before lines are fetched for pairs; the links stay, in dealt blocks too."""
    rng = random.Random(52)
    lines = [own_line(rng, 30) for _ in range(12)]
    pairs = [(line, edited(rng, line, 4, 0)) for line in lines]
    h1 = {l: i for i, l in enumerate(l for p in pairs for l in p)}
    rows = [(7, i, 5, 30, i, 3) for i in h1.values()] + [(8, i, 5, 30, i, 1) for i in h1.values()]
    named = spark.createDataFrame(rows, "block long, h1 long, simhash long, n int, label long, parts int")
    got = line_dedup._apart(named.transform(_graph.cut), spark.createDataFrame([(i, l) for l, i in h1.items()], "h1 long, line string"))
    want = {(h1[a], h1[b]) for a, b in pairs}
    found = [tuple(r) for r in got.collect()]
    assert want <= set(found) and len(found) == len(set(found)) and len(found) < 3 * len(want)


def test_lines_and_blocks_are_shuffled_in_turns(spark, monkeypatch):
    """The disk holds a share of the documents or blocks at a time; every line and block has its turn, and the result stays."""
    rng = random.Random(53)
    lines = [own_line(rng, 30) for _ in range(12)]
    rows = [(i, edited(rng, line, 1, 0)) for i, line in enumerate(lines)] + [(100 + i, line) for i, line in enumerate(lines)]
    want = sorted(map(tuple, line_dedup.dedup_lines(frame(spark, rows)).collect()))
    h1 = {l: i for i, l in enumerate(l for _, l in rows)}
    named = spark.createDataFrame([(b, i, 5, 30, i, 1) for b in range(20) for i in h1.values() if (i + b) % 3], "block long, h1 long, simhash long, n int, label long, parts int").transform(_graph.cut)
    texts = spark.createDataFrame([(i, l) for l, i in h1.items()], "h1 long, line string")
    pairs = sorted(map(tuple, line_dedup._apart(named, texts).collect()))
    of_turns, in_turn = [], _graph.cut_in_turn

    def counted(parts):
        out = [_graph.cut(p) for p in parts]
        of_turns.append([p.count() for p in out])
        return in_turn(out)

    for name, value in (("cut_in_turn", counted), ("TURN_ROWS", 1), ("TURN_DOCS", 1)):
        monkeypatch.setattr(line_dedup, name, value)
    assert sorted(map(tuple, line_dedup._apart(named, texts).collect())) == pairs and pairs
    assert len(of_turns[0]) == line_dedup.TURNS and sum(n > 0 for n in of_turns[0]) > 1
    assert sorted(map(tuple, line_dedup.dedup_lines(frame(spark, rows)).collect())) == want
    assert len(of_turns[1]) == line_dedup.TURNS and max(of_turns[1]) < sum(of_turns[1])


def test_most_pairs_of_a_block_fall_at_a_small_test(spark, monkeypatch):
    """The join's own condition has no edit distance, marks or signatures: with them its method was too large for the JVM to compile."""
    named = spark.createDataFrame([(7, i, 5, 30, i, 1) for i in range(3)], "block long, h1 long, simhash long, n int, label long, parts int").transform(_graph.cut)
    plans, in_turn = [], _graph.cut_in_turn

    def seen(parts):
        parts = list(parts)
        plans.extend(p._jdf.queryExecution().optimizedPlan().toString() for p in parts)
        return in_turn(parts)

    monkeypatch.setattr(line_dedup, "cut_in_turn", seen)
    line_dedup._apart(named, spark.createDataFrame([(i, f"line {i}") for i in range(3)], "h1 long, line string"))
    joins = [l for p in plans for l in p.splitlines() if "Join Inner" in l]
    assert joins and all("levenshtein" in p for p in plans)
    assert not any(w in j for j in joins for w in ("levenshtein", "array_intersect", ".m0"))


def test_letters_changed_in_half_of_the_words(spark):
    """Recall by number of words; it falls with the number of words, as the README says."""
    rng = random.Random(5)
    floor = {10: 0.8, 20: 0.2, 40: 0.2}
    lines = [(n, own_line(rng, n)) for n in floor for _ in range(60)]
    got = found(spark, [(l, edited(rng, l, 0, n // 2)) for n, l in lines])
    for n, least in floor.items():
        assert np.mean([g for g, l in zip(got, lines) if l[0] == n]) >= least, n


def test_long_words_with_changed_letters(spark):
    rng = random.Random(6)
    pairs = []
    for size in (330, 420, 510, 1000, 30_000):
        for changed in (2, size // 10, size // 6) if size < 2000 else (2,):
            w = [rng.choice("aeiourstlnmpbcdfg") for _ in range(size)]
            v = list(w)
            for i in rng.sample(range(size), changed):
                v[i] = "x"
            pairs.append(("".join(w), "".join(v)))
    assert all(found(spark, pairs))


# --- 10 -------------------------------------------------------------------------------------------------------
def test_shards_are_balanced_and_gapless(spark, corpus, tmp_path):
    rng = random.Random(13)
    rows = corpus + [(1000 + i, prose(rng, rng.randrange(1, 60))) for i in range(3000)]
    docs = frame(spark, rows)
    plan = sharding.plan_shards(docs, 8)
    got = sharding.assign_shards(docs, plan).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    load, places = collections.Counter(), collections.defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert set(load) == set(range(8)) and max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 8
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    more = plan.grown()
    assert all(more.shard[s] in (plan.shard[s], 8) for s in plan.shard) and 8 in more.shard.values() and more.version == 2
    plan.save(spark, str(tmp_path / "map"))
    more.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")).shard == more.shard
    assert sharding.SlotMap.load(spark, str(tmp_path / "map"), 1).shard == plan.shard
    assert sharding.SlotMap.load(spark, str(tmp_path / "map"), 2) == more
    with pytest.raises(Exception, match="(?i)exists"):
        more.save(spark, str(tmp_path / "map"))
    clash = docs.selectExpr("doc_id", "text", "'a' shard", "'b' slot", "'c' place", "'d' slot_base", "'e' key", "'f' row", "'g' version")
    again = sharding.assign_shards(clash, plan)
    assert again.columns == ["doc_id", "text", "place", "slot_base", "key", "row", "version", *sharding._ADDED]
    mine = lambda rs: collections.Counter((r.doc_id, r.shard, r.slot, r.virtual_slot) for r in rs)
    assert mine(again.collect()) == mine(got) and again.where("row = 'f' and key = 'e'").count() == len(rows)
    empty = frame(spark, [])
    assert sharding.assign_shards(empty, sharding.plan_shards(empty, 8)).count() == 0


# --- pipeline -------------------------------------------------------------------------------------------------
def test_pipeline_stages_read_what_was_written(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    frame(spark, [(1, "a"), (2, "b")]).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []

    def stage(spark, docs, sf_dir):
        seen.append(docs.inputFiles())
        return docs.withColumn("extra", F.concat("extra", F.lit("y")))

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage)])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert all("documents.parquet" in f for f in seen[0]) and seen[1] and not any("documents.parquet" in f for f in seen[1] + out.inputFiles())
    assert sorted(map(tuple, out.collect())) == [(1, "a", "xyy"), (2, "b", "xyy")]


def test_pipeline_equals_brute_force(spark, tmp_path, tokenizer):
    import corpus_pipeline

    rng = random.Random(12)
    line = lambda: " ".join(f"v{rng.randrange(5000)}" for _ in range(30))
    rows = []
    for i in range(240):
        body = [line() for _ in range(3)]
        if i % 6 == 0:
            body[1] += " idiot moron scum idiot moron"
        rows.append((i, "\n".join(body)))
    shared, again, item = line(), line().split() + line().split(), line()
    rows[7] = (7, rows[7][1] + "\n" + shared)
    rows[8] = (8, shared.upper() + "!\n" + rows[8][1])
    rows[9] = (9, shared)  # loses its only line
    rows += [(300, "\n".join(" ".join(again[k : k + 10]) for k in range(0, 60, 10))), (301, "\n".join(" ".join(again[k : k + 15]) for k in range(0, 60, 15)))]
    rows += [(302, f"{line()} {item}"), (303, None), (304, ""), (305, "!!\n!!"), (None, line()), rows[10]]
    docs = spark.createDataFrame([(i, t, f"lang{i}", 77, 78, 79) for i, t in rows], "doc_id long, text string, lang string, n_lines int, n_tokens int, toxic int")
    marks = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int")
    bench = [(1, item), (2, None)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def brute(name, rows):
        if name == "toxicity":
            return [(i, t) for i, t in rows if "idiot" not in (t or "")]
        if name == "lines":
            seen, out = {}, []
            for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
                for k, l in enumerate((t or "").split("\n")):
                    norm = re.sub("[^0-9a-z]+", " ", l.lower()).strip()
                    seen.setdefault(norm or (i, k), (i, t, k))
            for i, t in rows:
                lines = (t or "").split("\n")
                stay = [l for k, l in enumerate(lines) if seen[re.sub("[^0-9a-z]+", " ", l.lower()).strip() or (i, k)] == (i, t, k)]
                if t is None or stay:
                    out.append((i, None if t is None else "\n".join(stay)))
            return out
        if name == "near_duplicates":
            name_of = {(i, t): c for (i, t), c in zip(rows, [None] * len(rows))}
            sets = {r: shingle_set(r[1]) for r in name_of}
            for r in name_of:
                linked = [q[0] for q in name_of if sets[q] and sets[r] and 100 * len(sets[q] & sets[r]) >= 80 * len(sets[q] | sets[r]) and q[0] is not None]
                name_of[r] = min(linked, default=r[0])
            return [r for r in rows if name_of[r] == r[0]]
        dirty = {r[0] for r in brute_contamination(rows, bench) if r[5]}
        return [r for r in rows if r[0] not in dirty]

    want, got = rows, spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = [len(want)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, want = _graph.cut(stage(spark, got, str(tmp_path))), brute(name, want)
        assert got.columns == docs.columns and got.where("n_lines <> 77 or n_tokens <> 78 or toxic <> 79").isEmpty()
        assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter(want), name
        sizes.append(len(want))
    assert all(a > b for a, b in zip(sizes, sizes[1:]))
    library = tokenizer[2]
    for out in (corpus_pipeline.run(spark, str(tmp_path)), _graph.cut(corpus_pipeline.STAGES[-1][1](spark, got, str(tmp_path)))):
        assert collections.Counter((r.doc_id, r.n_tokens) for r in out.collect()) == collections.Counter((i, len(library.encode_ordinary(t or ""))) for i, t in want)
    empty = got.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = _graph.cut(stage(spark, empty, str(tmp_path)))
        assert empty.isEmpty()
