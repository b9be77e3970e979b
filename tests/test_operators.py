"""Operators against plain Python models on tiny sequences, round trips, and edge cases."""

import random

import numpy as np
import pytest

from strandweave.operators import classify, debruijn, kmers, match, metrics, minimizers, overlap, profile
from strandweave.operators.components import components
from strandweave.sources import reports, sequences, sinks
from strandweave.streaming import classify_stream


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


@pytest.fixture(scope="module")
def seqs():
    rng = random.Random(11)
    return [(i, dna(rng, n)) for i, n in enumerate([0, 1, 5, 30, 200, 512, 33_500])] + [(9, "ACGTNNACGTACGTN" * 4)]


def test_kmers_of_long_sequences_cross_chunks(spark, seqs):
    df = spark.createDataFrame(seqs, "seq_id long, seq string")
    got = sorted((r.seq_id, r.pos, r.kmer) for r in kmers.kmers(df, 7).collect())
    assert got == sorted((i, p, s[p : p + 7]) for i, s in seqs for p in range(len(s) - 6) if "N" not in s[p : p + 7])


def test_minimizers_equal_model(spark, seqs):
    df = spark.createDataFrame(seqs, "seq_id long, seq string")
    k, w, want = 5, 4, set()
    for i, s in seqs:
        words = [s[p : p + k] for p in range(len(s) - k + 1)]
        for p in range(len(words) - w + 1):
            good = [x for x in words[p : p + w] if "N" not in x]
            if good:
                want.add((i, min(good)))
    assert {(r.seq_id, r.minimizer) for r in minimizers.minimizers(df, k, w).collect()} == want


def test_matches_equal_model(spark, seqs):
    df = spark.createDataFrame(seqs, "seq_id long, seq string")
    p = "ACG"
    exact = {(r.seq_id, r.start, r.end) for r in match.exact_matches(df, p).collect()}
    assert exact == {(i, a, a + 3) for i, s in seqs for a in range(len(s) - 2) if s[a : a + 3] == p}
    near = {(r.seq_id, r.start, r.mismatches) for r in match.inexact_matches(df, "ACGTA", 1).collect()}
    ham = lambda a, b: sum(x != y for x, y in zip(a, b))
    assert near == {(i, a, ham(s[a : a + 5], "ACGTA")) for i, s in seqs for a in range(len(s) - 4) if ham(s[a : a + 5], "ACGTA") <= 1}
    assert match.exact_matches(df, "").count() == 0


@pytest.mark.parametrize("limit", [0, 1, 2])
def test_read_matches_equal_model(spark, limit):
    rng = random.Random(limit)
    genomes = [(i, f"o{i % 2}", dna(rng, 120)) for i in range(5)]
    reads = []
    for i in range(12):
        g = list(genomes[i % 5][2][i * 3 : i * 3 + 25 + i])
        for _ in range(i % 4):
            g[rng.randrange(len(g))] = "A"
        reads.append((i, "".join(g)))
    reads += [(20, "AC"), (21, "")]
    got = {(r.read_id, r.seq_id) for r in match.read_matches(spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(genomes, "seq_id long, organism string, seq string"), limit).collect()}
    ham = lambda a, b: sum(x != y for x, y in zip(a, b))
    assert got == {(i, j) for i, r in reads for j, _, g in genomes if r and any(ham(g[a : a + len(r)], r) <= limit for a in range(len(g) - len(r) + 1))}


def test_contained_reads(spark):
    rows = [(0, "ACGTACGTACGTACGTACGTA"), (1, "CGTACGTACGTACGTACG"), (2, "ACGT"), (3, "ACGTACGTACGTACGTACGTA"), (4, "TTTT"), (5, "")]
    got = sorted(r.read_id for r in overlap.contained(spark.createDataFrame(rows, "read_id long, seq string")).collect())
    assert got == [1, 2, 5]


def test_unitigs_rebuild_a_sequence_without_repeats(spark):
    rng = random.Random(5)
    s = dna(rng, 600)
    reads = [(i, s[i : i + 80]) for i in range(0, 521, 20)]
    e = debruijn.edges(spark.createDataFrame(reads, "read_id long, seq string"), 21)
    assert [r.seq for r in debruijn.unitigs(e, 21).collect()] == [s]
    assert [r.seq for r in debruijn.euler_walks(e, 21).collect()] == [s]


def test_unitigs_of_a_cycle(spark):
    e = debruijn.edges(spark.createDataFrame([(0, "ACGTTGCACGTT")], "read_id long, seq string"), 5)
    got = debruijn.unitigs(e, 5).collect()
    assert sum(r.n_edges for r in got) == e.count()


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in parent}


def test_metrics(spark):
    r = metrics.assembly_metrics(spark.createDataFrame([("ACGT" * 10,), ("GG" * 15,), ("A" * 20,), ("C" * 10,)], "seq string")).first()
    assert (r.total_length, r.num_contigs, r.largest_contig, r.n50, r.n90, r.l50, r.l90) == (100, 4, 40, 30, 20, 2, 3)
    assert r.gc_content == 60.0


def test_weighted_vote_and_labels(spark):
    index = spark.createDataFrame([("AAA", "x", 1), ("AAA", "y", 1), ("CCC", "x", 1), ("GGG", "y", 2)], "kmer string, organism string, cnt long")
    reads = spark.createDataFrame([(0, "AAA"), (1, "CCC"), (2, "TTT"), (3, ""), (4, "AAACCC")], "read_id long, seq string")
    got = {r.read_id: r.label for r in classify.classify_weighted(reads, index, 3, 2).collect()}
    assert got == {0: "ambiguous", 1: "x", 2: "unclassified", 3: "unclassified", 4: "x"}
    assert {r.read_id: r.label for r in classify.classify_basic(reads, index, 3).collect()} == {0: "x", 1: "x", 2: "unclassified", 3: "unclassified", 4: "x"}


def test_pca_and_ward(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, (6, 4)), rng.normal(8, 1, (6, 4))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = profile.pca(df).orderBy("vec_id").toPandas()
    z = (x - x.mean(0)) / x.std(0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(np.abs(got.pc1), np.abs(u[:, 0] * s[0]))
    assert np.isclose(got.explained1[0], s[0] ** 2 / (s**2).sum())
    merges = profile.ward(df).orderBy("height").toPandas()
    assert len(merges) == 11 and merges["size"].iloc[-1] == 12 and merges["height"].iloc[-1] > 3 * merges["height"].iloc[-2]
    assert profile.flat_cut(profile.ward(df)).count() == 10


def test_files_round_trip(spark, tmp_path):
    import gzip

    (tmp_path / "a.fasta").write_text(">s1 first one\nACGT\nacgt\n>s2\n\n>s3 x\nGG\n")
    got = sequences.whole_records(sequences.read_fasta(spark, str(tmp_path / "a.fasta"), piece=3)).orderBy("record_idx").collect()
    assert [(r.seq_id, r.description, r.seq) for r in got] == [("s1", "first one", "ACGTACGT"), ("s2", "", ""), ("s3", "x", "GG")]
    assert sequences.count_records(spark, str(tmp_path / "a.fasta")) == 3
    with gzip.open(tmp_path / "r_1.fastq.gz", "wt") as f:
        f.write("@r1 x\nACG\n+\n@I!\n@r2\nTT\n+r2\n55\n@cut\nA\n")
    reads = sequences.read_fastq(spark, str(tmp_path / "r_1.fastq.gz")).orderBy("record_idx").collect()
    assert [(r.read_id, r.seq, r.qual) for r in reads] == [("r1", "ACG", [31, 40, 0]), ("r2", "TT", [20, 20])]
    assert abs(reads[1].err[0] - 0.01) < 1e-12
    (tmp_path / "s_2.fastq").write_text("@x\nA\n+\nI\n")
    (tmp_path / "s_1.fastq").write_text("@x\nC\n+\nI\n")
    files = {r["sample"]: (r.forward is not None, r.reverse is not None) for r in reports.find_read_files(spark, str(tmp_path)).collect()}
    assert files == {"r": (True, False), "s": (True, True)}


def test_reports(spark, tmp_path):
    (tmp_path / "x_SRR12_report.txt").write_text("50.0\t5\t1\tG\t7\t  Gen us\nbad\t1\t1\tG\t8\tOther\n 9.5\t1\t1\t2\t3\tG\t9\tWide\n20\t2\t2\tU\t0\tunclassified\n1\t1\t1\tX\t5\tDropped\n")
    (tmp_path / "x_SRR12_clean_report.txt").write_text("99\t5\t1\tG\t7\tGen us\n")
    rows = reports.read_reports(spark, str(tmp_path / "*_report.txt"))
    got = {(r["sample"], r.taxon): r.pct for r in profile.report_taxa(rows).collect()}
    assert got == {("SRR12", "G_Gen us"): 50.0, ("SRR12", "G_Wide"): 9.5, ("SRR12", "Unclassified"): 20.0}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "ACGTACGTA")], "id long, seq string")
    assert [r.line for r in sinks.fasta_lines(df, "id", width=4).collect()] == [">1 length=9\nACGT\nACGT\nA"]
    m = spark.createDataFrame([("c", 1, 4)], "seq_id string, start long, end long")
    sinks.write_matches(m, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), sep="\t", header=True).columns == ["Chromosome", "Start", "End"]


def test_stream_labels_equal_batch(spark, tmp_path):
    index = spark.createDataFrame([("AAA", "x", 1), ("CCC", "y", 1)], "kmer string, organism string, cnt long")
    reads = spark.createDataFrame([(0, "AAAA"), (1, "CCC"), (2, "TT")], "read_id long, seq string")
    reads.write.parquet(str(tmp_path / "in"))
    q = classify_stream.start(classify_stream.read_stream(spark, str(tmp_path / "in")), index, 3, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert {r.read_id: r.label for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0: "x", 1: "y", 2: "unclassified"}


@pytest.mark.parametrize("seed", range(6))
def test_euler_walks_use_every_edge_once(spark, seed):
    rng = random.Random(seed)
    reads = [(i, dna(rng, rng.choice([4, 9, 30, 60]))) for i in range(6)] + [(90, "ACACACACAC"), (91, "TTTTTTT")]
    e = debruijn.edges(spark.createDataFrame(reads, "read_id long, seq string"), 4)
    walks = [r.seq for r in debruijn.euler_walks(e, 4).collect()]
    used = sorted(w[p : p + 4] for w in walks for p in range(len(w) - 3))
    assert used == sorted(r.kmer for r in e.collect())
    degree = {}
    for x in used:
        degree[x[:3]] = degree.get(x[:3], 0) + 1
        degree[x[1:]] = degree.get(x[1:], 0) - 1
    weak = components(e.select("src", "dst")).select("label").distinct().count()
    assert weak <= len(walks) <= weak + sum(d for d in degree.values() if d > 0)


def test_assemblies_rebuild_a_sequence(spark):
    rng = random.Random(6)
    s = dna(rng, 300)
    reads = spark.createDataFrame([(i, s[i : i + 60]) for i in range(0, 241, 20)], "read_id long, seq string")
    got = debruijn.assemble(reads, 21)
    assert [r.seq for r in got["contigs"].collect()] == [s] and got["metrics"].first().n50 == 300
    paths = [r.line for r in got["gfa"].collect() if r.line.startswith("P")]
    assert paths == ["P\tcontig_1\t" + ",".join(s[p : p + 20] + "+" for p in range(281)) + "\t*"]
    both = overlap.assemble(reads, 15, 100, 0.1, 20, 0.95)
    assert [r.seq for r in both["contigs"].collect()] == [s] and both["contained"].count() == 0 and both["metrics"].first().total_length == 300


def test_contained_reads_equal_model(spark):
    rng = random.Random(9)
    long = [dna(rng, n) for n in (40, 40, 90, 16, 17, 15, 200)]
    rows = long + [x[a : a + n] for x in long for a, n in ((0, 1), (3, 9), (20, 15), (len(x) - 5, 5), (1, len(x) - 1), (len(x) - 18, 18))] + [long[0], "ACGTACGTACGTACC", "G" * 8]
    rows = [(i, x) for i, x in enumerate(rows) if x]
    got = {r.read_id for r in overlap.contained(spark.createDataFrame(rows, "read_id long, seq string")).collect()}
    assert got == {i for i, a in rows if any(a in b and len(a) < len(b) for _, b in rows)}


def test_long_patterns_equal_model(spark, seqs):
    rng = random.Random(12)
    p = dna(rng, 60)
    ham = lambda a, b: sum(x != y for x, y in zip(a, b))
    rows = [(i, s[:700]) for i, s in seqs]
    for i in range(30):
        q = list(p)
        for _ in range(i % 5):
            q[rng.randrange(60)] = rng.choice("ACGT")
        rows.append((100 + i, dna(rng, 480 + i) + "".join(q) + dna(rng, i % 4)))
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    for limit in (0, 1, 3):
        near = {(r.seq_id, r.start, r.mismatches) for r in match.inexact_matches(df, p, limit).collect()}
        assert near == {(i, a, ham(s[a : a + 60], p)) for i, s in rows for a in range(len(s) - 59) if ham(s[a : a + 60], p) <= limit}
    both = match.search_assembly(df, p, 1).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in both}["exact"] <= {r["kind"]: r["count"] for r in both}["inexact"]
    counts = {r.pattern: r.n for r in match.occurrence_counts(df, spark.createDataFrame([(p,), (p[:16],), (p[:5],), ("",), ("G" * 40,)], "pattern string")).collect()}
    assert counts == {x: sum(s.startswith(x, a) for _, s in rows for a in range(len(s))) if x else 0 for x in (p, p[:16], p[:5], "", "G" * 40)}


def test_lowest_common_taxa(spark):
    found = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "a"), (3, "c"), (4, "g"), (4, "a"), (5, "zz")], "read_id long, organism string")
    taxonomy = spark.createDataFrame([("a", ["r", "g", "a"]), ("b", ["r", "g", "b"]), ("c", ["r", "h", "c"]), ("g", ["r", "g"])], "organism string, path array<string>")
    reads = spark.createDataFrame([(i, "A") for i in range(1, 7)], "read_id long, seq string")
    got = {r.read_id: (r.label, r.depth, r.most_specific) for r in classify.lowest_common(found, reads, taxonomy).collect()}
    assert got == {1: ("a", 3, "a"), 2: ("g", 2, None), 3: ("r", 1, None), 4: ("g", 2, "a"), 5: ("unclassified", 0, None), 6: ("unclassified", 0, None)}


def test_reports_as_lines(spark):
    labelled = spark.createDataFrame([(1, "x"), (2, "x"), (3, "ambiguous"), (4, "unclassified")], "read_id long, label string")
    names = spark.createDataFrame([("x",), ("y",)], "organism string")
    text = lambda df: [r.line for r in df.orderBy("line_no").collect()]
    assert text(sinks.classification_lines(labelled, names)) == ["classification", "organism: x", "organism: y", "reads of x: 2", "reads of y: 0", "classified reads: 2", "ambiguous reads: 1", "unclassified reads: 1"]
    buckets = spark.createDataFrame([("none", 1, 25.0), ("unique", 2, 50.0), ("multiple", 1, 25.0)], "bucket string, n long, pct double")
    per = spark.createDataFrame([("y", 1), ("x", 3)], "organism string, n_reads long")
    assert text(sinks.match_lines(buckets, per, seconds=1.5)) == ["matches", "seconds: 1.50", "reads: 4", "reads with unique match: 2 (50.00 %)", "reads with multiple match: 1 (25.00 %)", "reads with none match: 1 (25.00 %)", "x: 3 (75.00 %)", "y: 1 (25.00 %)"]
    one = metrics.assembly_metrics(spark.createDataFrame([("ACGT",)], "seq string"))
    assert text(sinks.metrics_lines(one))[:2] == ["assembly metrics", "total_length: 4"]
    taxa = spark.createDataFrame([("s", "t", 1.0), ("u", "t", 2.0)], "sample string, taxon string, pct double")
    groups = spark.createDataFrame([("s", "gut"), ("u", "water")], "sample string, sample_group string")
    explained = spark.createDataFrame([(0.5, 0.25)], "explained1 double, explained2 double")
    apart = spark.createDataFrame([("gut", True, True), ("water", True, True)], "sample_group string, clear boolean, strong boolean")
    assert text(sinks.summary_lines(taxa, groups, explained, apart)) == ["# Summary", "## Samples", "samples: 2", "- **gut**: 1", "- **water**: 1", "taxa: 1", "## Components", "PC1 explains 50.00 %, PC2 25.00 % of the variance", "groups are clearly apart; the first component is strong"]
    assert sinks.sample_types(spark, {"gut": ["a", "b"], "water": ["c"]}).count() == 3
    profile.require_samples(taxa)
    with pytest.raises(ValueError):
        profile.require_samples(taxa.limit(1))


def test_fastq_batches_and_archives(spark, tmp_path):
    import gzip
    import zipfile

    records = [f"@r{i} x\nACGT\n+\n@II{i % 10}\n" for i in range(25)]
    (tmp_path / "a.fastq").write_text("".join(records[:20]))
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress("".join(records[20:]).encode()))
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("one.fa", ">c1 first\nAC\nGT\n")
        z.writestr("sub/two.fa", ">c2\nTTTT\n")
    one = str(tmp_path / "a.fastq")
    batches = [[r.read_id for r in sequences.read_fastq_batch(spark, one, at, 8).orderBy("record_idx").collect()] for at in (0, 8, 16, 24)]
    assert [len(b) for b in batches] == [8, 8, 4, 0] and sum(batches, []) == [f"r{i}" for i in range(20)]
    every = sequences.with_global_index(sequences.read_fastq(spark, str(tmp_path / "*.fastq*")))
    assert sorted((r.read_idx, r.read_id) for r in every.collect()) == [(i, f"r{i}") for i in range(25)]
    packed = sequences.read_fasta(spark, str(tmp_path / "g.zip"))
    assert sorted((r.seq_id, r.seq) for r in packed.collect()) == [("c1", "ACGT"), ("c2", "TTTT")]
    index = spark.createDataFrame([("ACG", "x", 2), ("CGT", "y", 1)], "kmer string, organism string, cnt long")
    sinks.write_index(index, str(tmp_path / "index"))
    assert sorted(map(tuple, sinks.read_index(spark, str(tmp_path / "index")).collect())) == sorted(map(tuple, index.collect()))
