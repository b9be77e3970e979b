"""The splittable formats against serial parsing, cut at every byte."""

import gzip
import io
import random
import zipfile

import pytest

from strandweave.sources import splittable as S
from strandweave.sources.sequences import parse_fasta, parse_fastq

FASTQ = b"@r1 first\nACGT\n+\n@+@@\n@r2\nACG\n+r2\n@II\n\n@r3\n\n+\n\nstray line\n@r4\r\nAC\r\n+\r\n++\r\n@r5\nACGT\n+\nII\n@r6\nTTTT\n+\n@@@@\n@cut\nAC\n+\n"
FASTA = b"; comment\n>a one two\nACGT\nacg\n\n>b\n>c x\r\nNNN\r\n> d spaced\nA>C\nGG\n>e\nTTTTTTTTTT"


def fastq_split(data, cuts):
    out = []
    for a, b in zip(cuts, cuts[1:]):
        h = io.BytesIO(data)
        out += S.fastq_rows(S.lines_from(h, S.line_start(h, a, 3) if a else 0), a, b)
    return out


def fasta_split(data, cuts, piece=4):
    out = []
    for a, b in zip(cuts, cuts[1:]):
        h = io.BytesIO(data)
        out += S.fasta_rows(S.lines_from(h, S.line_start(h, a) if a else 0), b, piece)
    return out


def test_line_starts_equal_a_plain_search(monkeypatch):
    rng = random.Random(1)
    for _ in range(200):
        data = bytes(rng.choice(b"ab\n") for _ in range(rng.randrange(40)))
        starts = [0, *[i + 1 for i, c in enumerate(data) if c == 10]]
        for at in range(len(data) + 1):
            for before in (0, 3):
                first = next((k for k, s in enumerate(starts) if s >= at), len(starts))
                want = (starts[first] if first < len(starts) else len(data)) if not before else starts[max(0, first - before)] if first else 0
                assert S.line_start(io.BytesIO(data), at, before) == want, (data, at, before)


def test_fastq_is_the_same_at_every_cut():
    whole = fastq_split(FASTQ, [0, len(FASTQ)])
    assert [r[2] for r in whole if r[2]] == ["r1", "r2", "r3", "r4", "r6"]
    assert [r[5] for r in whole if r[5]] == ["stray line", "@r5", "ACGT", "+", "II", "@cut", "AC", "+"]
    for a in range(len(FASTQ) + 1):
        assert fastq_split(FASTQ, [0, a, len(FASTQ)]) == whole
        assert fastq_split(FASTQ, [0, a, min(a + 7, len(FASTQ)), len(FASTQ)]) == whole
    assert fastq_split(FASTQ, range(len(FASTQ) + 1)) == whole


def test_well_formed_fastq_equals_the_serial_parser():
    rng = random.Random(5)
    text = "".join(f"@read{i} x\n{''.join(rng.choice('ACGTN') for _ in range(n))}\n+\n{''.join(rng.choice('@+IJ#') for _ in range(n))}\n" for i, n in enumerate(rng.randrange(60) for _ in range(60)))
    want = [r[1:] for r in parse_fastq(io.StringIO(text))]
    data = text.encode()
    for _ in range(60):
        cuts = sorted({0, len(data), *[rng.randrange(len(data)) for _ in range(rng.randrange(20))]})
        assert [r[2:5] for r in fastq_split(data, cuts)] == want


def test_fasta_is_the_same_at_every_cut_and_equals_the_serial_parser():
    whole = fasta_split(FASTA, [0, len(FASTA)])
    assert [r[1:] for r in whole] == [r[1:] for r in parse_fasta(io.TextIOWrapper(io.BytesIO(FASTA)), 4)]
    for a in range(len(FASTA) + 1):
        assert fasta_split(FASTA, [0, a, len(FASTA)]) == whole
    assert fasta_split(FASTA, range(len(FASTA) + 1)) == whole


@pytest.fixture(scope="module")
def formats(spark):
    return S.register(spark)


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_formats_read_files_in_many_tasks(formats, tmp_path):
    (tmp_path / "a.fastq").write_bytes(FASTQ)
    (tmp_path / "b.fastq").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(FASTQ)
    one = formats.read.format("fastq").load(str(tmp_path))
    many = formats.read.format("fastq").option("splitbytes", 16).load(f"file://{tmp_path}")
    assert many.rdd.getNumPartitions() == -(-len(FASTQ) // 16)
    cols = ("offset", "next_offset", "read_id", "seq", "quality", "malformed")
    assert rows(one, *cols) == rows(many, *cols) == sorted(fastq_split(FASTQ, [0, len(FASTQ)]), key=str)
    assert [tuple(r)[1:] for r in S.read_counts(many).collect()] == [(5, 8)]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "x.fa").write_bytes(FASTA)
    genome = formats.read.format("fasta").option("splitbytes", 9).option("piece", 4).load(str(tmp_path / "g"))
    assert rows(genome, "offset", "seq_id", "description", "piece_start", "seq") == sorted(fasta_split(FASTA, [0, len(FASTA)]), key=str)
    numbers = {r.seq_id: r.record_idx for r in S.numbered(genome, 10).collect()}
    assert numbers == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4}
    assert formats.read.format("fasta").load(str(tmp_path / "b.fastq")).count() == 0
    with pytest.raises(Exception, match="absent"):
        formats.read.format("fasta").load(str(tmp_path / "absent")).count()


def test_packed_files_are_one_task_each(formats, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(FASTQ))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("x.fq", FASTQ)
        z.writestr("y/z.fq", FASTQ)
    got = formats.read.format("fastq").option("splitbytes", 16).load(str(tmp_path))
    assert got.rdd.getNumPartitions() == 3
    assert {r.path.rsplit("/", 1)[-1]: tuple(r)[1:] for r in S.read_counts(got).collect() if "y/z" not in r.path} == {"a.gz": (5, 8), "b.zip!x.fq": (5, 8)}


def test_batches_go_on_where_the_last_one_ended(formats, tmp_path):
    (tmp_path / "a.fastq").write_bytes(FASTQ)
    whole = rows(formats.read.format("fastq").load(str(tmp_path)), "offset", "read_id", "malformed")
    got, at = [], 0
    while at < len(FASTQ):
        batch = formats.read.format("fastq").option("start", at).option("stop", at + 40).load(str(tmp_path))
        got += rows(batch, "offset", "read_id", "malformed")
        after = [r.next_offset for r in S.next_starts(batch).collect()]
        at = max([at + 40, *after])
    assert sorted(got, key=str) == whole


def test_reads_become_contigs(formats, tmp_path):
    """From a FASTQ file to contigs, with read names as ids."""
    from strandweave.operators.overlap import assemble
    from strandweave.sources.sequences import read_fastq

    rng = random.Random(12)
    genome = "".join(rng.choice("ACGT") for _ in range(300))
    path = tmp_path / "reads.fastq"
    path.write_text("".join(f"@read-{k}\n{genome[i:i + 60]}\n+\n{'I' * 60}\n" for k, i in enumerate(range(0, 241, 20))))
    from_source = formats.read.format("fastq").load(str(path)).where("read_id is not null")
    for reads, err in ((read_fastq(formats, str(path)).select("read_id", "seq", "err"), "err"), (from_source.select("read_id", "seq"), None)):
        got = assemble(reads, 11, 100, 0.1, 20, 0.9, err=err)
        assert [r.seq for r in got["contigs"].collect()] == [genome]
        assert [r.read_id for r in got["paths"].orderBy("ord").collect()] == [f"read-{k}" for k in range(13)]
