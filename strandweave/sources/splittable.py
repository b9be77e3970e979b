"""FASTA and FASTQ as formats of spark.read, split by byte ranges.

    register(spark)
    spark.read.format("fastq").option("splitbytes", 64 << 20).load("/data/reads")

A plain file is cut into byte ranges; each task finds the first record that starts
in its range and reads on to the end of its last record, so every record belongs to
one task whatever the cuts are.  A gzip file and each member of a ZIP file cannot be
cut and are one task each.  Files are opened through pyarrow's file systems (local
or mounted folders and the stores that pyarrow reaches by URI); for stores that only
Spark reaches there are read_fasta and read_fastq.

Options: `splitbytes`; `start` and `stop`, to read only records that start in that
range of bytes of each plain file, so a run can go on where another ended without
reading what came before; FASTA: `piece`, the bases of one row at most.
"""

from __future__ import annotations

import gzip
import io
import re
import zipfile
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

#: Bytes of a split, bases of a row of FASTA, rows that a task hands over at once.
SPLIT_BYTES, PIECE, ROWS = 64 << 20, 1 << 20, 4000
FASTA_SCHEMA = "path string, offset long, seq_id string, description string, piece_start long, seq string"
FASTQ_SCHEMA = "path string, offset long, next_offset long, read_id string, seq string, quality string, malformed string"

Line = tuple[int, bytes]
_BASES = re.compile(rb"[A-Za-z.*-]*").fullmatch


def _open_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


@dataclass
class Split(InputPartition):
    """One task's share: records that start in [start, stop) of a file, or a whole packed stream."""

    path: str
    kind: str
    start: int
    stop: int
    member: str = ""


def plan_splits(path: str, size: int, start: int = 0, stop: int | None = None) -> list[Split]:
    """Splits of a file or of all files below a folder, in order of path; hidden files are left out."""
    system, base = _open_system(path)
    info = system.get_file_info(base)
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info] if info.is_file else [f for f in system.get_file_info(arrow_fs.FileSelector(base, recursive=True)) if f.is_file and not f.base_name.startswith((".", "_"))]
    prefix = path[: len(path) - len(base)] if path.endswith(base) else ""
    out = []
    for f in sorted(files, key=lambda f: f.path):
        name = prefix + f.path
        with system.open_input_file(f.path) as handle:
            head = handle.read(4)
            if head[:2] == b"\x1f\x8b":
                out.append(Split(name, "gzip", 0, f.size))
            elif head == b"PK\x03\x04":
                handle.seek(0)
                with zipfile.ZipFile(handle) as z:
                    out += [Split(name, "zip", 0, z.getinfo(m).file_size, m) for m in sorted(z.namelist()) if not m.endswith("/")]
            else:
                last = f.size if stop is None else min(stop, f.size)
                out += [Split(name, "plain", at, min(at + size, last)) for at in range(start, last, size)]
    return out


def line_start(handle, at: int, before: int = 0) -> int:
    """Offset of the first line that starts at or after `at`, less `before` lines (or the file's start)."""
    reach = 1 << 12
    while True:
        low = max(0, at - 1 - reach)
        handle.seek(low)
        block = handle.read(at - low)
        breaks = block.count(b"\n")
        if low == 0 or breaks > before + 1:
            break
        reach *= 4
    starts = [0] if low == 0 else []
    place = block.find(b"\n")
    while place >= 0:
        starts.append(low + place + 1)
        place = block.find(b"\n", place + 1)
    earlier = [s for s in starts if s < at]
    if starts and starts[-1] == at and (low or at):
        first = at
    elif at == 0:
        first = 0
    else:
        handle.seek(at)
        rest = handle.readline()
        first = at + len(rest)
    if not before:
        return first
    return earlier[-before] if len(earlier) >= before else (earlier[0] if earlier else first)


def lines_from(handle, at: int) -> Iterator[Line]:
    handle.seek(at)
    for line in handle:
        yield at, line
        at += len(line)


def fasta_rows(lines: Iterator[Line], stop: int, piece: int = PIECE) -> Iterator[tuple[int, str, str, int, str]]:
    """(offset, id, description, piece_start, bases) of records whose header starts before `stop`; lines before the first header are not looked at."""
    head, name, text, start, held, size = -1, "", "", 0, [], 0
    for at, line in lines:
        line = line.strip()
        if line.startswith(b">"):
            if head >= 0:
                yield head, name, text, start, b"".join(held).decode("utf-8", "replace")
            if at >= stop:
                return
            head = at
            name, _, text = line[1:].strip().decode("utf-8", "replace").partition(" ")
            start, held, size = 0, [], 0
        elif head < 0 and at >= stop:
            return
        elif line and head >= 0:
            held.append(line.upper())
            size += len(line)
            while size >= piece:
                whole = b"".join(held)
                yield head, name, text, start, whole[:piece].decode("utf-8", "replace")
                start, held, size = start + piece, [whole[piece:]], size - piece
    if head >= 0 and (size or not start):
        yield head, name, text, start, b"".join(held).decode("utf-8", "replace")


def fastq_rows(lines: Iterator[Line], start: int, stop: int) -> Iterator[tuple[int, int, str | None, str | None, str | None, str | None]]:
    """(offset, next offset, id, bases, quality, malformed) of records and of stray lines that start in [start, stop).

    Four lines are a record if the first starts with @, the second is bases only,
    the third starts with + and the fourth is as long as the second.  A line with which no
    record starts and that is in none is a row of its own with `malformed` set;
    empty lines are passed over.  Lines before `start` only tell where records lie.
    """
    ahead: deque[Line] = deque()
    lines = iter(lines)
    while True:
        while len(ahead) < 4 and (line := next(lines, None)) is not None:
            ahead.append(line)
        if not ahead or ahead[0][0] >= stop:
            return
        at, head = ahead[0]
        if len(ahead) == 4 and head.startswith(b"@") and ahead[2][1].startswith(b"+"):
            seq, quality = ahead[1][1].rstrip(b"\r\n"), ahead[3][1].rstrip(b"\r\n")
            if len(seq) == len(quality) and _BASES(seq):
                end = ahead[3][0] + len(ahead[3][1])
                ahead.clear()
                if at >= start:
                    name = head.rstrip(b"\r\n")[1:].split(b" ", 1)[0]
                    yield at, end, name.decode("utf-8", "replace"), seq.upper().decode(), quality.decode("latin-1"), None
                continue
        ahead.popleft()
        text = head.rstrip(b"\r\n")
        if at >= start and text:
            yield at, at + len(head), None, None, None, text.decode("utf-8", "replace")


class _Reader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.schema = schema
        self.path = options["path"]
        self.size = int(options.get("splitbytes", SPLIT_BYTES))
        self.start, self.stop = int(options.get("start", 0)), int(options["stop"]) if "stop" in options else None
        self.piece = int(options.get("piece", PIECE))
        if self.size < 1 or self.piece < 1 or self.start < 0:
            raise ValueError("splitbytes and piece must be at least 1, start at least 0")

    def partitions(self) -> list[Split]:
        return plan_splits(self.path, self.size, self.start, self.stop) or [Split("", "none", 0, 0)]

    def rows(self, handle, split: Split) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if split.kind == "none":
            return
        system, base = _open_system(split.path)
        where = f"{split.path}!{split.member}" if split.member else split.path
        names, kinds = self.schema.names, [pa.int64() if f.dataType.typeName() == "long" else pa.string() for f in self.schema]
        with system.open_input_file(base) as raw:
            if split.kind == "gzip":
                handle, split = io.BufferedReader(gzip.GzipFile(fileobj=raw)), Split(split.path, "gzip", 0, 1 << 62)
            elif split.kind == "zip":
                handle, split = io.BufferedReader(zipfile.ZipFile(raw).open(split.member)), Split(split.path, "zip", 0, 1 << 62)
            else:
                handle = io.BufferedReader(raw, 1 << 20)
            held: list[tuple] = []
            weight = 0
            for row in self.rows(handle, split):
                held.append((where, *row))
                weight += len(row[-1] or "")
                if len(held) >= ROWS or weight >= 16 * PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                    held, weight = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


class _FastaReader(_Reader):
    def rows(self, handle, split: Split) -> Iterator[tuple]:
        return fasta_rows(lines_from(handle, line_start(handle, split.start) if split.start else 0), split.stop, self.piece)


class _FastqReader(_Reader):
    def rows(self, handle, split: Split) -> Iterator[tuple]:
        # The three lines before may begin a record that reaches into this split.
        return fastq_rows(lines_from(handle, line_start(handle, split.start, 3) if split.start else 0), split.start, split.stop)


class FastaSource(DataSource):
    """spark.read.format("fasta"): (path, offset, seq_id, description, piece_start, seq); long records come in pieces."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return FASTA_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _FastaReader(schema, self.options)


class FastqSource(DataSource):
    """spark.read.format("fastq"): (path, offset, next_offset, read_id, seq, quality, malformed); stray lines have `malformed` set and no id."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return FASTQ_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _FastqReader(schema, self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make the formats "fasta" and "fastq" known to a session."""
    spark.dataSource.register(FastaSource)
    spark.dataSource.register(FastqSource)
    return spark


def next_starts(records: DataFrame) -> DataFrame:
    """(path, next_offset): where the next batch of each file starts after a batch of FASTQ records."""
    return records.groupBy("path").agg(F.max("next_offset").alias("next_offset"))


def read_counts(records: DataFrame) -> DataFrame:
    """(path, n_records, n_malformed) of FASTQ rows."""
    return records.groupBy("path").agg(F.count("read_id").alias("n_records"), F.count("malformed").alias("n_malformed"))


def numbered(records: DataFrame, stretch: int = SPLIT_BYTES) -> DataFrame:
    """records with `record_idx`, their number within their file by offset.

    Records are numbered within stretches of `stretch` bytes; only one count for
    each stretch is added up over a file.
    """
    placed = records.withColumn("_stretch", F.floor(F.col("offset") / stretch))
    heads = placed.select("path", "_stretch", "offset").distinct()
    counts = heads.groupBy("path", "_stretch").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("path", "_stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("path", "_stretch").orderBy("offset")
    return placed.withColumn("_in", F.dense_rank().over(inside) - 1).join(first, ["path", "_stretch"]).withColumn("record_idx", F.col("_first") + F.col("_in")).drop("_first", "_in", "_stretch")
