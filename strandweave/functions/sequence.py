"""Column functions over sequences; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest stretch from which k-mers are cut directly: substring() walks a string from its start.
CHUNK = 512


def dna(text: Column, keep_n: bool = True) -> Column:
    """Upper-cased text without anything but A, C, G, T (and N)."""
    return F.regexp_replace(F.upper(text), "[^ACGTN]+" if keep_n else "[^ACGT]+", "")


def gc_bases(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "[^GC]", ""))


def mismatches(a: Column, b: Column) -> Column:
    """Hamming distance of two strings of equal length."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda z: z))


def within(a: Column, b: Column, limit: int) -> Column:
    """Whether two strings of equal length differ in at most `limit` places: edit distance, which is never larger, is asked first."""
    if limit <= 0:
        return a == b
    return F.when(F.levenshtein(a, b, limit) >= 0, mismatches(a, b) <= limit).otherwise(False)


def part_bounds(size: int, limit: int) -> list[tuple[int, int]]:
    """Start and end of limit + 1 parts, one of which any place with at most `limit` mismatches leaves alone."""
    return [(size * i // (limit + 1), size * (i + 1) // (limit + 1)) for i in range(limit + 1)]


def phred(quality: Column) -> Column:
    """Phred scores of a quality string (offset 33)."""
    return F.transform(F.filter(F.split(quality, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def error_probability(score: Column) -> Column:
    return F.pow(F.lit(10.0), -score / 10.0)


def windows(seq: Column, size: int) -> Column:
    """Start positions (from 1) of all windows of `size`; an empty array where none fits."""
    return F.when(F.length(seq) >= size, F.sequence(F.lit(1), F.length(seq) - (size - 1))).otherwise(F.array().cast("array<int>"))


def words(seq: Column, size: int, most: int | None = None) -> Column:
    """All overlapping pieces of `size` in order, or of up to `most` letters where they are there.

    One pass of a pattern whose matches are empty, so none walks the string from
    its start.  A place within a surrogate pair of Java's strings is no start.
    """
    return F.regexp_extract_all(seq, F.lit(rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{{size},{most or size}}}))"), F.lit(1))


def seed_length(length: Column, limit: int, seed: int) -> Column:
    """Bases of the seeds of a read: `seed`, or half as many as often as it takes to fit each of limit + 1 parts; 1 at least."""
    sizes = [seed >> i for i in range(seed.bit_length())]
    return F.coalesce(*(F.when(length >= s * (limit + 1), s) for s in sizes), F.lit(1))
