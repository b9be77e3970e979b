"""Pattern search: exact and inexact positions, and reads against genomes by seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import CHUNK, mismatches, part_bounds, seed_length, windows, within, words
from .kmers import chunks, kmers, kmers_of_lengths

#: Bases of a piece within which a hit is compared, besides the longest read or pattern.
PIECE = 2048
#: Seeds and letters of reads that are broadcast at most.
FEW, LETTERS = 1 << 18, 1 << 24


def _positions(seqs: DataFrame, seq: str, size: int, extra: int = 0, some_of: tuple[str, ...] = ()) -> DataFrame:
    """Every 0-based `start` at which `size` bases fit, with `_piece`: those bases and up to `extra` more.

    Stretches that hold none of the texts `some_of` are dropped before positions are made.
    """
    cut = chunks(seqs.withColumn("_n", F.length(seq)), seq, overlap=size + extra - 1, start="_chunk")
    if all(some_of) and some_of:
        cut = cut.where(reduce(Column.__or__, [F.col(seq).contains(p) for p in sorted(set(some_of))]))
    out = cut.withColumn("_i", F.explode(windows(F.col(seq), size))).where(F.col("_i") <= CHUNK)
    out = out.withColumn("_piece", F.expr(f"substring({seq}, _i, {size + extra})")).withColumn("start", (F.col("_chunk") + F.col("_i") - 1).cast("long"))
    return out.drop(seq, "_chunk", "_i")


def exact_matches(seqs: DataFrame, pattern: str, seq: str = "seq") -> DataFrame:
    """All overlapping occurrences, 0-based and half-open; sequences without one are dropped before positions are made."""
    p = pattern.upper()
    if not p:
        return seqs.drop(seq).limit(0).withColumns({"start": F.lit(0).cast("long"), "end": F.lit(0).cast("long")})
    hit = seqs.withColumn(seq, F.upper(seq)).where(F.col(seq).contains(p))
    out = _positions(hit, seq, len(p), some_of=(p,)).where(F.col("_piece") == p)
    return out.withColumn("end", F.col("start") + len(p)).drop("_piece", "_n")


def inexact_matches(seqs: DataFrame, pattern: str, limit: int = 1, compat: bool = False, seq: str = "seq") -> DataFrame:
    """(start, end, mismatches) of every place within `limit` mismatches.

    With `compat`, each start also reports the shortened and the shifted window:
    the pattern less its last base one base short (where a base follows the
    window), and the window one to the right, one base long (where two follow).
    """
    p = pattern.upper()
    m = len(p)
    up = seqs.withColumn(seq, F.upper(seq))
    texts = (p, p[:-1]) if compat else (p,)
    parts = tuple(t[a:b] for t in texts for a, b in part_bounds(len(t), limit))
    whole = _positions(up, seq, m, 1 if compat else 0, parts)

    def near(at: DataFrame, first: int, text: str, longer: int) -> DataFrame:
        # One of limit + 1 parts is equal: a plain comparison discards nearly all places before mismatches are counted.
        bounds = part_bounds(len(text), limit)
        if all(a < b for a, b in bounds):
            at = at.where(reduce(Column.__or__, [F.substring("_piece", first + a, b - a) == text[a:b] for a, b in bounds]))
        here = F.substring("_piece", first, len(text))
        return at.withColumn("mismatches", mismatches(here, F.lit(text))).withColumn("end", F.col("start") + (m + longer)).where(F.col("mismatches") <= limit)

    out = near(whole, 1, p, 0)
    if compat:
        out = out.unionByName(near(whole.where(F.col("start") < F.col("_n") - m), 1, p[:-1], -1))
        out = out.unionByName(near(whole.where(F.col("start") < F.col("_n") - m - 1), 2, p, 1))
    return out.drop("_piece", "_n")


def edit_matches(seqs: DataFrame, pattern: str, limit: int = 1, best: bool = False, seq: str = "seq") -> DataFrame:
    """(start, end, edits) of every window within `limit` substitutions, insertions and deletions of the pattern.

    Windows have len(pattern) - limit to len(pattern) + limit bases; empty ones are none.  One of limit + 1
    parts of the pattern lies in the window as it is, moved by `limit` places at
    most: plain comparisons discard nearly all places before a banded edit distance
    is counted.  With `best`, each start has one row: fewest edits, then the length nearest to
    the pattern's, then the shorter.
    """
    p = pattern.upper()
    m = len(p)
    least = max(1, m - limit)
    bounds = part_bounds(m, limit)
    parts = tuple(p[a:b] for a, b in bounds)
    at = _positions(seqs.withColumn(seq, F.upper(seq)), seq, least, m + limit - least, parts)
    if all(parts):
        moved = [F.substring("_piece", a + d + 1, b - a) == p[a:b] for a, b in bounds for d in range(-limit, limit + 1) if a + d >= 0]
        at = at.where(reduce(Column.__or__, moved))
    sizes = F.filter(F.sequence(F.lit(least), F.lit(m + limit)), lambda n: n <= F.length("_piece"))
    ends = F.filter(F.transform(sizes, lambda n: F.struct(F.levenshtein(F.substring(F.col("_piece"), F.lit(1), n), F.lit(p), limit).alias("edits"), F.abs(n - m).alias("off"), n.alias("n"))), lambda x: x["edits"] >= 0)
    if best:
        ends = F.slice(F.array_sort(ends), 1, 1)
    out = at.withColumn("_w", F.explode(ends))
    return out.withColumn("end", F.col("start") + F.col("_w.n")).withColumn("edits", F.col("_w.edits")).drop("_piece", "_n", "_w")


def search_assembly(seqs: DataFrame, pattern: str, limit: int = 1, compat: bool = False, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """(kind, key, start, end, mismatches): exact and inexact matches of a pattern in one plan; exact ones have 0 mismatches."""
    base = seqs.select(key, seq)
    exact = exact_matches(base, pattern, seq).select(F.lit("exact").alias("kind"), key, "start", "end", F.lit(0).alias("mismatches"))
    near = inexact_matches(base, pattern, limit, compat, seq).select(F.lit("inexact").alias("kind"), key, "start", "end", "mismatches")
    return exact.unionByName(near)


def _few_places(some: DataFrame, genomes: DataFrame, limit: int, seed: int, read: str, keys: list[str], seq: str) -> DataFrame | None:
    """(read, *keys): a row for each place of a read in a genome, or for each seed of it if mismatches are allowed; None if the reads are too many.

    The reads' seeds are broadcast to the genomes' pieces, and a read is compared in the very piece: neither k-mers,
    hits nor genomes are shuffled.  A read's seeds have `seed` bases, or half as many as often as its parts ask for it,
    so a short read does not shorten the others' seeds; all lengths are looked up in one pass.
    """
    n, letters, most = some.agg(F.count(F.lit(1)), F.sum(F.length(seq)), F.max(F.length(seq))).first()
    if n * (limit + 1) > FEW or (letters or 0) > LETTERS:
        return None
    own = some.withColumn("_w", seed_length(F.length(seq), limit, seed))
    part = F.transform(F.sequence(F.lit(0), F.lit(limit)), lambda p: F.floor(p * F.length(seq) / (limit + 1)).cast("int"))
    seeds = own.select(F.col(read), F.col(seq).alias("_read"), "_w", F.explode(part).alias("_at")).withColumn("_kmer", F.expr("substring(_read, _at + 1, _w)"))
    sizes = sorted(r[0] for r in own.select("_w").distinct().collect()) or [seed]
    size = max(CHUNK, 4 * (most or 0))
    cut = chunks(genomes.select(*keys, F.col(seq).alias("_piece")), "_piece", size, max(most or 0, 1) - 1, "_from").withColumn("_long", F.length("_piece"))
    at = cut.select(*keys, "_piece", "_long", F.posexplode(words(F.col("_piece"), sizes[0], sizes[-1])).alias("_pos", "_word"))
    if len(sizes) > 1:
        at = at.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("_size")).where(F.length("_word") >= F.col("_size")).withColumn("_word", F.expr("substring(_word, 1, _size)")).drop("_size")
    # A start belongs to the piece that it lies in, not to the overlap of the one before.
    hit = at.join(F.broadcast(seeds), F.col("_word") == F.col("_kmer")).withColumn("_start", F.col("_pos") - F.col("_at")).where((F.col("_start") >= 0) & (F.col("_start") < size) & (F.col("_start") + F.length("_read") <= F.col("_long")))
    near = within(F.expr("substring(_piece, _start + 1, length(_read))"), F.col("_read"), limit)
    return hit.where(near).select(read, *keys)


def occurrence_counts(seqs: DataFrame, patterns: DataFrame, key: str = "seq_id", seq: str = "seq", seed: int = 16) -> DataFrame:
    """(pattern, n): overlapping occurrences of each pattern in all sequences.

    Patterns are found by an equi-join on their first letters and compared there: if few, in
    the piece that is at hand; else those of `seed` letters or more by a shuffle, shorter ones by one for each length.
    """
    some = patterns.select("pattern").where("pattern <> ''").distinct()
    found = _few_places(some.withColumn("_seq", F.col("pattern")), seqs.select(F.col(seq).alias("_seq")), 0, seed, "pattern", [], "_seq")
    if found is None:
        found = _many_occurrences(some, seqs, key, seq, seed)
    n = found.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return patterns.select("pattern").distinct().join(n, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _many_occurrences(some: DataFrame, seqs: DataFrame, key: str, seq: str, seed: int) -> DataFrame:
    """(pattern) once for each occurrence, both sides shuffled."""
    short, long = some.where(F.length("pattern") < seed), some.where(F.length("pattern") >= seed)
    sizes = sorted(r[0] for r in short.select(F.length("pattern")).distinct().collect())  # below the seed's length
    found = kmers_of_lengths(seqs.select(seq), sizes, seq).join(short.select(F.col("pattern").alias("kmer")), "kmer").select(F.col("kmer").alias("pattern"))
    starts = long.select("pattern", F.expr(f"substring(pattern, 1, {seed})").alias("kmer"))
    hit = kmers(seqs.select(F.col(key).alias("_key"), F.col(seq).alias("seq")), seed, "seq", skip_n=False).join(starts, "kmer").select("_key", "pattern", "pos")
    longest = long.agg(F.max(F.length("pattern"))).first()[0] or seed
    pieces = chunks(seqs.select(F.col(key).alias("_key"), F.col(seq).alias("_seq")), "_seq", PIECE, longest, "_from").withColumn("_piece", F.expr(f"_from div {PIECE}"))
    whole = hit.where(F.length("pattern") > seed).withColumn("_piece", F.expr(f"pos div {PIECE}")).join(pieces, ["_key", "_piece"])
    whole = whole.where(F.expr("substring(_seq, pos - _from + 1, length(pattern))") == F.col("pattern")).select("pattern")
    return found.unionByName(hit.where(F.length("pattern") == seed).select("pattern")).unionByName(whole)


def _places(some: DataFrame, genomes: DataFrame, limit: int, seed: int, read: str, keys: list[str], genome: str, seq: str) -> DataFrame:
    """(read, *keys) of reads that are not empty, with repetitions."""
    own = some.where(F.length(seq) > limit)
    found = _few_places(own, genomes, limit, seed, read, keys, seq)
    found = _many_matches(own, genomes, limit, seed, read, genome, seq).select(read, *keys) if found is None else found
    # Reads of no more bases than mismatches have no part that must be left alone: they lie wherever they fit.
    tiny = some.where(F.length(seq) <= limit).select(read, F.length(seq).alias("_n"))
    if limit and tiny.limit(1).count():
        found = found.unionByName(genomes.select(*keys, F.length(seq).alias("_long")).join(tiny, F.col("_long") >= F.col("_n")).select(read, *keys))
    return found


def read_matches(reads: DataFrame, genomes: DataFrame, limit: int = 0, seed: int = 16, read: str = "read_id", genome: str = "seq_id", seq: str = "seq") -> DataFrame:
    """Distinct (read, genome, organism) of reads that lie in a genome with at most `limit` mismatches.

    A read of limit + 1 parts has one part without a mismatch: the first bases of
    each part are seeds, an equi-join finds them in the genomes, and the whole
    read is then compared at that place.  Seeds have `seed` bases at most; short reads
    are searched apart, so they do not shorten the others' seeds.  Few reads are broadcast, many are
    shuffled.  Empty reads match nothing.
    """
    return _places(reads.where(F.length(seq) > 0), genomes, limit, seed, read, [genome, "organism"], genome, seq).distinct()


def _many_matches(some: DataFrame, genomes: DataFrame, limit: int, seed: int, read: str, genome: str, seq: str) -> DataFrame:
    """(read, genome, organism) with both sides shuffled."""
    bound = (limit + 1) * seed // 2
    short = some.where(F.length(seq) < bound)
    if seed > 1 and short.limit(1).count() and some.where(F.length(seq) >= bound).limit(1).count():
        args = (genomes, limit)
        rest = _many_matches(some.where(F.length(seq) >= bound), *args, seed, read, genome, seq)
        return rest.unionByName(_many_matches(short, *args, max(1, seed // 2), read, genome, seq)).distinct()
    least, most = some.agg(F.min(F.length(seq)), F.max(F.length(seq))).first()
    if least is None:
        return some.select(read).join(genomes.select(genome, "organism"), F.lit(False))
    w = max(1, min(seed, least // (limit + 1)))
    part = F.transform(F.sequence(F.lit(0), F.lit(limit)), lambda p: F.floor(p * F.length(seq) / (limit + 1)).cast("int"))
    seeds = some.select(F.col(read), F.col(seq).alias("_read"), F.explode(part).alias("_at")).select(read, "_at", F.expr(f"substring(_read, _at + 1, {w})").alias("kmer")).distinct()
    found = kmers(genomes.select(genome, seq), w, seq, skip_n=False).join(seeds, "kmer").select(genome, read, (F.col("pos") - F.col("_at")).alias("_start")).where("_start >= 0").distinct()
    # A hit is compared within a piece of the genome that holds the longest read from any start: no row has a whole genome.
    pieces = chunks(genomes.select(genome, "organism", F.col(seq).alias("_genome")), "_genome", PIECE, most, "_from").withColumn("_piece", F.expr(f"_from div {PIECE}"))
    both = found.withColumn("_piece", F.expr(f"_start div {PIECE}")).join(pieces, [genome, "_piece"]).join(some.select(read, F.col(seq).alias("_read")), read)
    here = F.expr("substring(_genome, _start - _from + 1, length(_read))")
    near = here == F.col("_read") if limit == 0 else (F.length(here) == F.length("_read")) & within(here, F.col("_read"), limit)
    return both.where(near).select(read, genome, "organism").distinct()


def seed_hits(reads: DataFrame, genomes: DataFrame, w: int = 28, read: str = "read_id", seq: str = "seq") -> DataFrame:
    """Distinct (read, organism) that share an exact w-mer."""
    return kmers(reads.select(read, seq), w, seq).select("kmer", read).distinct().join(kmers(genomes.select("organism", seq), w, seq).select("kmer", "organism").distinct(), "kmer").select(read, "organism").distinct()


def pattern_candidates(reads: DataFrame, genomes: DataFrame, limit: int = 1, seed: int = 16, read: str = "read_id", seq: str = "seq") -> DataFrame:
    """(read, has_match, candidate): whether a verified match exists, and whether just a seed occurs."""
    yes = _places(reads.where(F.length(seq) > 0), genomes, limit, seed, read, [], "seq_id", seq).distinct().withColumn("m", F.lit(True))
    parts = F.transform(F.sequence(F.lit(0), F.lit(limit)), lambda p: F.substring(F.col(seq), F.floor(p * F.length(seq) / (limit + 1)).cast("int") + 1, (F.floor((p + 1) * F.length(seq) / (limit + 1)) - F.floor(p * F.length(seq) / (limit + 1))).cast("int")))
    seeds = reads.select(F.col(read).alias("_of"), F.posexplode(parts).alias("_part", "_seq")).where("_seq <> ''")
    seeds = seeds.select(F.struct("_of", "_part").alias(read), F.col("_seq").alias(seq))
    maybe = _places(seeds, genomes, 0, seed, read, [], "seq_id", seq).select(F.col(f"{read}._of").alias(read)).distinct().withColumn("c", F.lit(True))
    return reads.select(read).distinct().join(yes, read, "left").join(maybe, read, "left").select(read, F.coalesce("m", F.lit(False)).alias("has_match"), F.coalesce("c", F.lit(False)).alias("candidate"))
