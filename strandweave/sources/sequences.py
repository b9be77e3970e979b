"""FASTA and FASTQ as Spark sources.

`read_fasta` and `read_fastq` split the work by file through Spark's own readers,
so any store that Spark reads will do, gzip and ZIP members included.  A file is
parsed as a stream of lines within its task.
"""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequence import error_probability

#: Bases of one row at most where a record is cut into pieces, and rows that a task hands over at once.
PIECE, ROWS = 1 << 20, 2000
_FASTA = "path string, record_idx long, seq_id string, description string, piece_start long, seq string"
_FASTQ = "path string, record_idx long, read_id string, seq string, quality string"


def _streams(path: str, content: bytes) -> Iterator[io.TextIOBase]:
    if content[:2] == b"\x1f\x8b":
        yield io.TextIOWrapper(gzip.GzipFile(fileobj=io.BytesIO(content)), "utf-8", "replace")
    elif content[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in sorted(z.namelist()):
                if not name.endswith("/"):
                    yield io.TextIOWrapper(z.open(name), "utf-8", "replace")
    else:
        yield io.TextIOWrapper(io.BytesIO(content), "utf-8", "replace")


def parse_fasta(lines: Iterator[str], piece: int = PIECE) -> Iterator[tuple[int, str, str, int, str]]:
    """(record, id, description, start, bases): the header's first word is the id; long records come in pieces."""
    record, name, text, start, held, size = -1, "", "", 0, [], 0
    for line in lines:
        line = line.strip()
        if line.startswith(">"):
            if record >= 0:
                yield record, name, text, start, "".join(held)
            record += 1
            name, _, text = line[1:].strip().partition(" ")
            start, held, size = 0, [], 0
        elif line and record >= 0:
            held.append(line.upper())
            size += len(line)
            while size >= piece:
                whole = "".join(held)
                yield record, name, text, start, whole[:piece]
                start, held, size = start + piece, [whole[piece:]], size - piece
    if record >= 0 and (size or not start):
        yield record, name, text, start, "".join(held)


def parse_fastq(lines: Iterator[str]) -> Iterator[tuple[int, str, str, str]]:
    """(record, id, bases, quality): four lines each, as a quality may start with @; a cut-off record ends the file."""
    record = 0
    rows = (x.rstrip("\r\n") for x in lines)
    for head in rows:
        if not head:
            continue
        seq, plus, quality = next(rows, None), next(rows, None), next(rows, None)
        if quality is None or not head.startswith("@") or not plus.startswith("+"):
            return
        yield record, head[1:].split(" ", 1)[0], seq.upper(), quality
        record += 1


def _read(spark: SparkSession, path: str, schema: str, parse) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for stream in _streams(where, content):
                    for row in parse(stream):
                        rows.append((where, *row))
                        if len(rows) >= ROWS:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
                            rows = []
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def read_fasta(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """(path, record_idx, seq_id, description, piece_start, seq) of FASTA files, plain, gzip or ZIP."""
    return _read(spark, path, _FASTA, lambda s: parse_fasta(s, piece))


def whole_records(fasta: DataFrame) -> DataFrame:
    """One row per record: its pieces in order."""
    by = fasta.groupBy("path", "record_idx", "seq_id", "description").agg(F.sort_array(F.collect_list(F.struct("piece_start", "seq"))).alias("x"))
    return by.select("path", "record_idx", "seq_id", "description", F.array_join(F.transform("x", lambda p: p["seq"]), "").alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(path, record_idx, read_id, seq, quality, qual, err): Phred scores (offset 33) and error probabilities."""
    return _scored(_read(spark, path, _FASTQ, parse_fastq))


def _scored(raw: DataFrame) -> DataFrame:
    scores = F.transform(F.filter(F.split("quality", ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)
    return raw.withColumn("qual", scores).withColumn("err", F.transform("qual", error_probability))


def read_fastq_batch(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """The n records of each file from number `start` on, as read_fastq gives them; the next batch starts at start + n.

    Parsing stops with the last record asked for, so a run can be resumed at any batch.
    """
    raw = _read(spark, path, _FASTQ, lambda s: islice(parse_fastq(s), start, start + n))
    return _scored(raw)


def with_global_index(records: DataFrame) -> DataFrame:
    """records with `read_idx`: their number over all files, in order of path and place in the file.

    Only one count per file is ordered; no record leaves its partition.
    """
    sizes = records.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    return records.join(first, "path").withColumn("read_idx", F.col("_first") + F.col("record_idx")).drop("_first")


def count_records(spark: SparkSession, path: str) -> int:
    """Header lines of FASTA files."""
    return spark.read.text(path).where(F.col("value").startswith(">")).count()
