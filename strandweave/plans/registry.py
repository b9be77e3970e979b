"""All registered queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import dna
from ..functions.sql import register_functions
from ..operators import classify as C
from ..operators import debruijn as D
from ..operators import kmers as K
from ..operators import match as P
from ..operators import metrics as E
from ..operators import minimizers as M
from ..operators import overlap as O
from ..operators import packed as Q
from ..operators import profile as T
from ..operators import taxonomy as X
from ..operators.components import temporary_folder
from ..operators.seed_index import SeedIndex
from .tables import genomes, phred_reads, reads, report, table, vectors

Query = Callable[[SparkSession, str], DataFrame]

KMER, WINDOW, PATTERN = 12, 5, "ATTA"
PRIORITY = [("en", 0), ("fr", 1), ("de", 2), ("es", 3)]
SPECIES = {"src1": "one", "src7": "seven", "none": "missing"}
PREFIXES = {"e": "west", "d": "middle"}

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# --- SQL parts ------------------------------------------------------------------------------------------------
_SEQ = "regexp_replace(upper(text), '[^ACGT]', '', 'g')"
_GENOMES = f"genomes AS (SELECT doc_id AS seq_id, lang AS organism, {_SEQ} AS seq FROM documents)"
_READS = f"reads AS (SELECT item_id AS read_id, {_SEQ} AS seq FROM benchmark)"


def _kmers_sql(name: str, source: str, keys: str, k: int, skip_n: bool = True) -> str:
    where = "WHERE NOT contains(kmer, 'N')" if skip_n else ""
    return f"{name} AS (SELECT * FROM (SELECT {keys}, i - 1 AS pos, substr(seq, i, {k}) AS kmer FROM (SELECT {keys}, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM {source})) {where})"


def _minimizers_sql(name: str, source: str, keys: str, k: int, w: int) -> str:
    return f"""{name}_k AS (SELECT {keys}, i, CASE WHEN NOT contains(substr(seq, i, {k}), 'N') THEN substr(seq, i, {k}) END AS kmer FROM (SELECT {keys}, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM {source})),
{name} AS (SELECT DISTINCT {keys}, minimizer FROM (SELECT {keys}, min(kmer) OVER x AS minimizer, count(*) OVER x AS n FROM {name}_k WINDOW x AS (PARTITION BY {keys} ORDER BY i ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)) WHERE n = {w} AND minimizer IS NOT NULL)"""


_INDEX = ",\n".join([_GENOMES, _kmers_sql("gk", "genomes", "organism", KMER), "idx AS (SELECT kmer, organism, count(*) AS cnt FROM gk GROUP BY 1, 2)"])
_HITS = ",\n".join([_INDEX, _READS, _kmers_sql("rk", "reads", "read_id", KMER), "hits AS (SELECT read_id, organism, count(*) AS hits FROM rk JOIN idx USING (kmer) GROUP BY 1, 2)"])
_THRESHOLD = """size AS (SELECT read_id, count(*) AS n FROM {parts} GROUP BY 1),
share AS (SELECT read_id, organism, count(*) AS h FROM {parts} JOIN {index} USING ({part}) GROUP BY 1, 2),
good AS (SELECT read_id, count(*) AS n_organisms, min(organism) AS one FROM share JOIN size USING (read_id) WHERE h >= 0.1 * n GROUP BY 1),
{out} AS (SELECT read_id, CASE WHEN n_organisms = 1 THEN one WHEN n_organisms > 1 THEN 'multi-match' ELSE 'unclassified' END AS label, coalesce(n_organisms, 0) AS n_organisms FROM (SELECT DISTINCT read_id FROM reads) LEFT JOIN good USING (read_id))"""
_C3 = ",\n".join([_HITS, _THRESHOLD.format(parts="rk", index="idx", part="kmer", out="c3")])
_MIN = ",\n".join([_GENOMES, _READS, _minimizers_sql("gm", "(SELECT seq_id, organism, seq FROM genomes)", "seq_id, organism", KMER, WINDOW), _minimizers_sql("rm", "reads", "read_id", KMER, WINDOW), "midx AS (SELECT DISTINCT minimizer, organism FROM gm)"])
_CATEGORIES = "cats AS (SELECT DISTINCT organism AS label FROM {index} UNION ALL SELECT 'multi-match' UNION ALL SELECT 'unclassified')"
_PCT = "SELECT label, coalesce(n, 0) AS n, coalesce(round(100.0 * coalesce(n, 0) / nullif((SELECT count(*) FROM {of}), 0), 6), 0.0) AS pct FROM cats LEFT JOIN (SELECT label, count(*) AS n FROM {of} GROUP BY 1) USING (label)"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _index(spark: SparkSession, d: str) -> DataFrame:
    return K.kmer_index(genomes(spark, d), KMER)


# --- k-mers ---------------------------------------------------------------------------------------------------
@query("k1_kmers", f"WITH {_READS}, {_kmers_sql('rk', 'reads', 'read_id', KMER)} SELECT read_id, CAST(pos AS INTEGER) AS pos, kmer FROM rk")
def _(spark, d):
    return K.kmers(reads(spark, d), KMER)


@query("k2_kmer_index", f"WITH {_INDEX} SELECT * FROM idx")
def _(spark, d):
    return _index(spark, d)


@query("k2_packed", f"WITH {_INDEX} SELECT * FROM idx")
def _(spark, d):
    return Q.packed_index(genomes(spark, d), KMER).select(Q.unpack(F.col("code"), KMER).alias("kmer"), "organism", "cnt")


_INDEX_N = _INDEX.replace("[^ACGT]", "[^ACGTN]")


@query("k2_kmer_index_n", f"WITH {_INDEX_N} SELECT * FROM idx")
def _(spark, d):
    return K.kmer_index(genomes(spark, d, keep_n=True), KMER)


@query("k3_genome_stats", f"WITH {_INDEX} SELECT organism, bases, total_kmers, distinct_kmers FROM (SELECT organism, CAST(sum(length(seq)) AS BIGINT) AS bases FROM genomes GROUP BY 1) JOIN (SELECT organism, CAST(sum(cnt) AS BIGINT) AS total_kmers, count(*) AS distinct_kmers FROM idx GROUP BY 1) USING (organism)")
def _(spark, d):
    return K.genome_stats(genomes(spark, d), KMER)


@query("k4_sharing", f"WITH {_INDEX}, s AS (SELECT kmer, count(DISTINCT organism) AS n_organisms FROM idx GROUP BY 1) SELECT n_organisms, count(*) AS n_kmers, round(100.0 * count(*) / (SELECT count(*) FROM s), 6) AS pct FROM s GROUP BY 1")
def _(spark, d):
    return K.sharing(_index(spark, d))


@query("k5_theoretical", f"WITH {_INDEX} SELECT '16777216' AS possible, count(DISTINCT kmer) AS seen, round(100.0 * count(DISTINCT kmer) / 16777216, 9) AS pct FROM idx")
def _(spark, d):
    return _index(spark, d).agg(F.lit(str(4**KMER)).alias("possible"), F.countDistinct("kmer").alias("seen"), F.round(100.0 * F.countDistinct("kmer") / F.lit(4**KMER), 9).alias("pct"))


@query("k6_index_totals", f"WITH {_INDEX} SELECT count(*) AS n_rows, count(DISTINCT kmer) AS n_kmers, CAST(sum(cnt) AS BIGINT) AS n_occurrences FROM idx")
def _(spark, d):
    return _index(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("kmer").alias("n_kmers"), F.sum("cnt").alias("n_occurrences"))


@query("k7_minimizers", f"WITH {_MIN} SELECT seq_id, organism, minimizer FROM gm")
def _(spark, d):
    return M.minimizers(genomes(spark, d), KMER, WINDOW)


@query("k7_minimizers_n", f"WITH {_MIN.replace('[^ACGT]', '[^ACGTN]')} SELECT seq_id, organism, minimizer FROM gm")
def _(spark, d):
    return M.minimizers(genomes(spark, d, keep_n=True), KMER, WINDOW)


@query("k8_minimizer_index", f"WITH {_MIN} SELECT minimizer, organism FROM midx")
def _(spark, d):
    return M.minimizer_index(genomes(spark, d), KMER, WINDOW)


@query("k9_reduction", f"WITH {_MIN}, {_kmers_sql('gk', 'genomes', 'organism', KMER)} SELECT (SELECT count(DISTINCT minimizer) FROM midx) AS n_minimizers, (SELECT count(DISTINCT kmer) FROM gk) AS n_kmers, round((SELECT count(DISTINCT minimizer) FROM midx) / (SELECT count(DISTINCT kmer) FROM gk), 6) AS ratio")
def _(spark, d):
    few = M.minimizer_index(genomes(spark, d), KMER, WINDOW).agg(F.countDistinct("minimizer").alias("n_minimizers"))
    return few.crossJoin(F.broadcast(_index(spark, d).agg(F.countDistinct("kmer").alias("n_kmers")))).withColumn("ratio", F.round(F.col("n_minimizers") / F.col("n_kmers"), 6))  # one row each


_SKETCH = ",\n".join([_GENOMES, _kmers_sql("gk", "genomes", "seq_id", 8, False), "h AS (SELECT DISTINCT seq_id, substr(md5(kmer), 1, 8) AS hash FROM gk)", "sk AS (SELECT seq_id, hash, row_number() OVER (PARTITION BY seq_id ORDER BY hash) AS rank FROM h QUALIFY rank <= 50)"])
_JACCARD = f"{_SKETCH},\nsz AS (SELECT seq_id, count(*) AS n FROM sk GROUP BY 1), sh AS (SELECT a.seq_id AS a, b.seq_id AS b, count(*) AS shared FROM sk a JOIN sk b ON a.hash = b.hash AND a.seq_id < b.seq_id GROUP BY 1, 2), jac AS (SELECT a, b, shared, x.n + y.n - shared AS total, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM sh JOIN sz x ON a = x.seq_id JOIN sz y ON b = y.seq_id)"


@query("k10_sketch", f"WITH {_SKETCH} SELECT seq_id, hash, CAST(rank AS INTEGER) AS rank FROM sk")
def _(spark, d):
    return M.sketch(genomes(spark, d), 8, 50).select("seq_id", "hash", "rank")


@query("k11_jaccard", f"WITH {_JACCARD} SELECT * FROM jac WHERE jaccard >= 0.1")
def _(spark, d):
    return M.sketch_jaccard(M.sketch(genomes(spark, d), 8, 50), least=0.1)


_COUNTS = ",\n".join([_GENOMES, _kmers_sql("gk", "genomes", "organism", 8), "c AS (SELECT kmer, count(*) AS cnt FROM gk GROUP BY 1)"])


@query("k10_merged", f"WITH {_SKETCH.replace('seq_id', 'organism').replace('doc_id AS organism, lang AS organism', 'lang AS organism')} SELECT organism, hash, CAST(rank AS INTEGER) AS rank FROM sk")
def _(spark, d):
    own = M.sketch(genomes(spark, d), 8, 50).join(genomes(spark, d).select("seq_id", "organism"), "seq_id")
    return M.merge_sketches(own, 50, "organism").select("organism", "hash", "rank")


@query("k12_spectrum", f"WITH {_COUNTS}, f AS (SELECT cnt AS frequency, count(*) AS n_distinct FROM c GROUP BY 1), t AS (SELECT sum(n_distinct) AS d, sum(frequency * n_distinct) AS p FROM f) SELECT frequency, n_distinct, round(sum(n_distinct) OVER (ORDER BY frequency) / (SELECT d FROM t), 6) AS cum_distinct, round(sum(frequency * n_distinct) OVER (ORDER BY frequency) / (SELECT p FROM t), 6) AS cum_total, round(frequency / (SELECT p FROM t) * 1e6, 6) AS presence FROM f")
def _(spark, d):
    return K.spectrum(K.kmers(genomes(spark, d), 8).groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt")))


@query("k12_spectrum_summary", f"WITH {_COUNTS} SELECT count(*) FILTER (cnt = 1) AS n_unique, count(*) AS n_distinct, CAST(sum(cnt) AS BIGINT) AS n_present, CAST(65536 - count(*) AS VARCHAR) AS n_missing FROM c")
def _(spark, d):
    return K.spectrum_summary(K.kmers(genomes(spark, d), 8).groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt")), 8)


@query("k13_qv", f"WITH {_GENOMES}, {_READS}, {_kmers_sql('gk', 'genomes', 'organism', 8)}, {_kmers_sql('rk', 'reads', 'read_id', 8)}, g AS (SELECT kmer FROM (SELECT DISTINCT kmer FROM gk)), s AS (SELECT count(*) FILTER (kmer IN (SELECT kmer FROM g)) AS shared, count(*) AS total FROM rk) SELECT shared, total, round(1.0 - pow(shared / total, 1.0 / 8), 9) AS error_rate, CASE WHEN shared < total THEN round(-10.0 * log10(1.0 - pow(shared / total, 1.0 / 8)), 6) END AS qv FROM s")
def _(spark, d):
    return K.quality_value(K.kmer_index(reads(spark, d).withColumn("organism", F.lit("reads")), 8), K.kmer_index(genomes(spark, d), 8), 8)


# --- classification -------------------------------------------------------------------------------------------
@query("c1_basic", f"WITH {_HITS}, b AS (SELECT read_id, organism, hits, row_number() OVER (PARTITION BY read_id ORDER BY hits DESC, organism) AS r FROM hits) SELECT read_id, coalesce(organism, 'unclassified') AS label, coalesce(hits, 0) AS hits FROM (SELECT DISTINCT read_id FROM reads) LEFT JOIN (SELECT * FROM b WHERE r = 1) USING (read_id)")
def _(spark, d):
    return C.classify_basic(reads(spark, d), _index(spark, d), KMER)


@query("c2_weighted", f"WITH {_HITS}, w AS (SELECT kmer, CAST(12 / count(*) AS BIGINT) AS weight FROM idx GROUP BY 1), v AS (SELECT read_id, organism, sum(weight) AS v FROM rk JOIN idx USING (kmer) JOIN w USING (kmer) GROUP BY 1, 2), m AS (SELECT read_id, max(v) AS m FROM v GROUP BY 1), n AS (SELECT read_id, count(*) AS n_best, min(organism) AS o FROM v JOIN m USING (read_id) WHERE 10 * v > 9 * m GROUP BY 1) SELECT read_id, CASE WHEN n_best = 1 THEN o WHEN n_best > 1 THEN 'ambiguous' ELSE 'unclassified' END AS label, coalesce(n_best, 0) AS n_best FROM (SELECT DISTINCT read_id FROM reads) LEFT JOIN n USING (read_id)")
def _(spark, d):
    return C.classify_weighted(reads(spark, d), _index(spark, d), KMER, 4)


@query("c3_threshold", f"WITH {_C3} SELECT * FROM c3")
def _(spark, d):
    return C.classify_threshold(reads(spark, d), _index(spark, d), KMER, 0.1)


_C4 = ",\n".join([_MIN, _THRESHOLD.format(parts="rm", index="midx", part="minimizer", out="c4").replace("size AS", "size4 AS").replace("JOIN size ", "JOIN size4 ").replace("share AS", "share4 AS").replace("FROM share ", "FROM share4 ").replace("good AS", "good4 AS").replace("JOIN good ", "JOIN good4 ")])


@query("c4_minimizer", f"WITH {_C4} SELECT * FROM c4")
def _(spark, d):
    return C.classify_minimizers(reads(spark, d), M.minimizer_index(genomes(spark, d), KMER, WINDOW), KMER, WINDOW, 0.1)


@query("c5_percentages", f"WITH {_C3}, {_CATEGORIES.format(index='idx')} {_PCT.format(of='c3')}")
def _(spark, d):
    index = _index(spark, d)
    return C.percentages(C.classify_threshold(reads(spark, d), index, KMER, 0.1), C.label_categories(index))


_C6_PARTS = _C4.split(_READS + ",\n", 1)[1]


@query("c6_compare", f"WITH {_C3}, {_C6_PARTS}, {_CATEGORIES.format(index='idx')}, full_ AS ({_PCT.format(of='c3')}), min_ AS ({_PCT.format(of='c4')}) SELECT label, f.pct AS full_pct, m.pct AS min_pct, round(m.pct - f.pct, 6) AS diff FROM full_ f JOIN min_ m USING (label)")
def _(spark, d):
    index, r = _index(spark, d), reads(spark, d)
    cats = C.label_categories(index)
    full = C.percentages(C.classify_threshold(r, index, KMER, 0.1), cats).select("label", F.col("pct").alias("full_pct"))
    few = C.percentages(C.classify_minimizers(r, M.minimizer_index(genomes(spark, d), KMER, WINDOW), KMER, WINDOW, 0.1), cats).select("label", F.col("pct").alias("min_pct"))
    return full.join(few, "label").withColumn("diff", F.round(F.col("min_pct") - F.col("full_pct"), 6))


_FOUND = f"{_GENOMES}, {_READS}, found AS (SELECT DISTINCT read_id, seq_id, organism FROM reads r JOIN genomes g ON length(r.seq) > 0 AND contains(g.seq, r.seq))"


@query("c7_per_organism", f"WITH {_FOUND} SELECT organism, count(DISTINCT read_id) AS n_reads FROM found GROUP BY 1")
def _(spark, d):
    return C.organism_counts(P.read_matches(reads(spark, d), genomes(spark, d)))


@query("c8_buckets", f"WITH {_FOUND}, n AS (SELECT read_id, count(DISTINCT organism) AS k FROM found GROUP BY 1), b AS (SELECT CASE WHEN k = 1 THEN 'unique' WHEN k > 1 THEN 'multiple' ELSE 'none' END AS bucket, count(*) AS n FROM reads LEFT JOIN n USING (read_id) GROUP BY 1) SELECT bucket, coalesce(n, 0) AS n, coalesce(round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM reads), 6), 0.0) AS pct FROM (VALUES ('unique'), ('multiple'), ('none')) v(bucket) LEFT JOIN b USING (bucket)")
def _(spark, d):
    r = reads(spark, d)
    return C.match_buckets(P.read_matches(r, genomes(spark, d)), r)


@query("c9_total_check", f"WITH {_C3}, {_CATEGORIES.format(index='idx')}, p AS ({_PCT.format(of='c3')}) SELECT round(sum(pct), 3) AS total_pct, abs(sum(pct) - 100) <= 1 AS ok FROM p")
def _(spark, d):
    index = _index(spark, d)
    p = C.percentages(C.classify_threshold(reads(spark, d), index, KMER, 0.1), C.label_categories(index))
    return p.agg(F.round(F.sum("pct"), 3).alias("total_pct"), (F.abs(F.sum("pct") - 100) <= 1).alias("ok"))


@query("c10_kraken_counts", "WITH l AS (SELECT CASE WHEN n_chars % 3 = 0 THEN 'U' ELSE 'C' END AS f FROM documents) SELECT count(*) AS total, count(*) FILTER (f = 'C') AS classified, count(*) FILTER (f = 'U') AS unclassified, round(100.0 * count(*) FILTER (f = 'C') / count(*), 6) AS classified_pct, round(100.0 * count(*) FILTER (f = 'U') / count(*), 6) AS unclassified_pct FROM l")
def _(spark, d):
    return T.kraken_counts(table(spark, d, "documents").select(F.concat(F.when(F.col("n_chars") % 3 == 0, "U").otherwise("C"), F.lit("\t"), F.col("doc_id").cast("string")).alias("line")))


_REPORT = "rep AS (SELECT lang AS sample, source AS name, substr('GFOCPDSX', 1 + CAST(substr(source, 4) AS INT) % 8, 1) AS rank, substr(source, 4) AS taxid, round(100.0 * n / total, 4) AS pct, CAST(substr(source, 4) AS BIGINT) AS line_no FROM (SELECT lang, source, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang) AS total FROM documents GROUP BY 1, 2))"


@query("c11_species", f"WITH {_REPORT}, s(needle, label) AS (VALUES ('src1', 'one'), ('src7', 'seven'), ('none', 'missing')), h AS (SELECT sample, label, arg_max(pct, line_no) AS pct FROM rep JOIN s ON contains(name, needle) GROUP BY 1, 2) SELECT sample, label, coalesce(pct, 0.0) AS pct FROM (SELECT DISTINCT sample FROM rep) CROSS JOIN (SELECT label FROM s) LEFT JOIN h USING (sample, label)")
def _(spark, d):
    return T.species_percentages(report(spark, d), SPECIES)


# --- pattern search -------------------------------------------------------------------------------------------
_POS = f"{_GENOMES}, pos AS (SELECT seq_id, length(seq) AS n, seq, unnest(range(0, length(seq) - 3)) AS s FROM genomes WHERE length(seq) >= 4)"


@query("p2_exact", f"WITH {_POS} SELECT seq_id, s AS start, s + 4 AS \"end\" FROM pos WHERE substr(seq, s + 1, 4) = 'ATTA'")
def _(spark, d):
    return P.exact_matches(genomes(spark, d).select("seq_id", "seq"), PATTERN)


_LONG, _LPOS = "ATTATACATT", f"{_GENOMES}, pos AS (SELECT seq_id, length(seq) AS n, seq, unnest(range(0, length(seq) - 9)) AS s FROM genomes WHERE length(seq) >= 10)"


@query("p3_clean", f"WITH {_LPOS} SELECT * FROM (SELECT seq_id, s AS start, s + 10 AS \"end\", CAST(hamming(substr(seq, s + 1, 10), '{_LONG}') AS INTEGER) AS mismatches FROM pos) WHERE mismatches <= 2")
def _(spark, d):
    return P.inexact_matches(genomes(spark, d).select("seq_id", "seq"), _LONG, 2).select("seq_id", "start", "end", "mismatches")


@query("p3_compat", f"""WITH {_LPOS}, u AS (
SELECT seq_id, s AS start, s + 10 AS "end", hamming(substr(seq, s + 1, 10), '{_LONG}') AS m FROM pos
UNION ALL SELECT seq_id, s, s + 9, hamming(substr(seq, s + 1, 9), '{_LONG[:-1]}') FROM pos WHERE s < n - 10
UNION ALL SELECT seq_id, s, s + 11, hamming(substr(seq, s + 2, 10), '{_LONG}') FROM pos WHERE s < n - 11)
SELECT seq_id, start, "end", CAST(m AS INTEGER) AS mismatches FROM u WHERE m <= 1""")
def _(spark, d):
    return P.inexact_matches(genomes(spark, d).select("seq_id", "seq"), _LONG, 1, compat=True).select("seq_id", "start", "end", "mismatches")


@query("p6_count", f"WITH {_GENOMES}, p AS (SELECT DISTINCT {_SEQ} AS pattern FROM benchmark), k AS (SELECT seq, unnest(range(1, length(seq) + 1)) AS i FROM genomes), h AS (SELECT pattern, count(*) AS n FROM p JOIN k ON substr(k.seq, i, length(pattern)) = pattern WHERE pattern <> '' GROUP BY 1) SELECT pattern, coalesce(n, 0) AS n FROM p LEFT JOIN h USING (pattern)")
def _(spark, d):
    return P.occurrence_counts(genomes(spark, d), reads(spark, d).select(F.col("seq").alias("pattern")))


@query("p5_assembly", f"""WITH {_LPOS} SELECT 'exact' AS kind, seq_id, s AS start, s + 10 AS "end", 0 AS mismatches FROM pos WHERE substr(seq, s + 1, 10) = '{_LONG}'
UNION ALL SELECT * FROM (SELECT 'inexact', seq_id, s, s + 10, CAST(hamming(substr(seq, s + 1, 10), '{_LONG}') AS INTEGER) AS m FROM pos) WHERE m <= 1""")
def _(spark, d):
    return P.search_assembly(genomes(spark, d), _LONG, 1)


_NEAR = f"{_GENOMES}, {_READS}, near AS (SELECT DISTINCT read_id, seq_id, organism FROM (SELECT seq_id, organism, seq AS g, unnest(range(0, length(seq))) AS s FROM genomes) JOIN reads r ON length(r.seq) > 0 AND s + length(r.seq) <= length(g) AND CASE WHEN length(substr(g, s + 1, length(r.seq))) = length(r.seq) THEN hamming(substr(g, s + 1, length(r.seq)), r.seq) ELSE 99 END <= 1)"


@query("p7_has_match", f"WITH {_NEAR}, halves AS (SELECT read_id, unnest([substr(seq, 1, length(seq) // 2), substr(seq, length(seq) // 2 + 1)]) AS part FROM reads), cand AS (SELECT DISTINCT read_id FROM halves WHERE part <> '' AND EXISTS (SELECT 1 FROM genomes WHERE contains(genomes.seq, part))) SELECT read_id, read_id IN (SELECT read_id FROM near) AS has_match, read_id IN (SELECT read_id FROM cand) AS candidate FROM reads")
def _(spark, d):
    return P.pattern_candidates(reads(spark, d), genomes(spark, d), 1)


@query("p8_contains", f"WITH {_FOUND} SELECT * FROM found")
def _(spark, d):
    return P.read_matches(reads(spark, d), genomes(spark, d))


@query("p9_hamming", f"WITH {_NEAR} SELECT * FROM near")
def _(spark, d):
    return P.read_matches(reads(spark, d), genomes(spark, d), 1)


@query("p10_organisms", f"WITH {_FOUND} SELECT read_id, string_agg(organism, ',' ORDER BY organism) AS organisms FROM (SELECT DISTINCT read_id, organism FROM found) GROUP BY 1")
def _(spark, d):
    return P.read_matches(reads(spark, d), genomes(spark, d)).groupBy("read_id").agg(F.array_join(F.array_sort(F.collect_set("organism")), ",").alias("organisms"))


@query("p13_edits", f"""WITH {_GENOMES}, w AS (SELECT seq_id, s, n, substr(seq, s + 1, n) AS piece FROM (SELECT seq_id, seq, s, unnest([9, 10, 11]) AS n FROM (SELECT seq_id, seq, unnest(range(0, length(seq))) AS s FROM genomes)) WHERE s + n <= length(seq))
SELECT seq_id, s AS start, s + n AS "end", CAST(levenshtein(piece, '{_LONG}') AS INTEGER) AS edits FROM w WHERE levenshtein(piece, '{_LONG}') <= 1""")
def _(spark, d):
    return P.edit_matches(genomes(spark, d).select("seq_id", "seq"), _LONG, 1).select("seq_id", "start", "end", "edits")


def _seed_index(spark: SparkSession, d: str, k: int) -> SeedIndex:
    name = f"strandweave_{uuid.uuid4().hex}"
    return SeedIndex.build(genomes(spark, d), k, name, folder=temporary_folder(spark, name))


@query("p14_index_places", f"WITH {_GENOMES}, {_READS} SELECT read_id, seq_id, organism, CAST(s AS BIGINT) AS start, CAST(hamming(substr(g, s + 1, length(r.seq)), r.seq) AS INTEGER) AS mismatches FROM (SELECT seq_id, organism, seq AS g, unnest(range(0, length(seq))) AS s FROM genomes) JOIN reads r ON length(r.seq) > 0 AND s + length(r.seq) <= length(g) AND CASE WHEN length(substr(g, s + 1, length(r.seq))) = length(r.seq) THEN hamming(substr(g, s + 1, length(r.seq)), r.seq) ELSE 99 END <= 1")
def _(spark, d):
    return _seed_index(spark, d, 16).find(reads(spark, d), 1)


_HALVES = "substr(r.seq, 1, length(r.seq) // 2) AS h1, substr(r.seq, length(r.seq) // 2 + 1) AS h2"
_EDITED = f"""{_GENOMES}, {_READS}, r AS (SELECT read_id, seq, length(seq) AS n, {_HALVES} FROM reads r WHERE length(seq) > 0),
near AS (SELECT read_id, r.seq, n, seq_id, organism, g, s FROM (SELECT seq_id, organism, seq AS g, unnest(range(0, length(seq))) AS s FROM genomes) JOIN r ON contains(substr(g, s + 1, n + 1), h1) OR contains(substr(g, s + 1, n + 1), h2)),
w AS (SELECT read_id, seq_id, organism, s, n, k, levenshtein(substr(g, s + 1, k), seq) AS edits FROM (SELECT *, unnest([n - 1, n, n + 1]) AS k FROM near) WHERE k > 0 AND s + k <= length(g))"""


@query("p15_index_edits", f"WITH {_EDITED} SELECT read_id, seq_id, organism, CAST(s AS BIGINT) AS start, CAST(s + k AS BIGINT) AS \"end\", CAST(edits AS INTEGER) AS edits FROM w WHERE edits <= 1 QUALIFY row_number() OVER (PARTITION BY read_id, seq_id, s ORDER BY edits, abs(k - n), k) = 1")
def _(spark, d):
    return _seed_index(spark, d, 16).find_edited(reads(spark, d), 1)


_WMER = ",\n".join([_GENOMES, _READS, _kmers_sql("gw", "genomes", "organism", 14), _kmers_sql("rw", "reads", "read_id", 14), "hit AS (SELECT DISTINCT read_id, organism FROM rw JOIN gw USING (kmer))"])


@query("p11_wmer", f"WITH {_WMER} SELECT * FROM hit")
def _(spark, d):
    return P.seed_hits(reads(spark, d), genomes(spark, d), 14)


@query("p12_priority", f"WITH {_WMER}, pr(organism, p) AS (VALUES ('en', 0), ('fr', 1), ('de', 2), ('es', 3)) SELECT read_id, coalesce(label, 'unclassified') AS label FROM reads LEFT JOIN (SELECT read_id, arg_min(organism, p) AS label FROM hit JOIN pr USING (organism) GROUP BY 1) USING (read_id)")
def _(spark, d):
    r = reads(spark, d)
    return C.first_organism(P.seed_hits(r, genomes(spark, d), 14), r, spark.createDataFrame(PRIORITY, "organism string, priority int"))


@query("c13_lowest_common", f"""WITH {_WMER}, t(organism, family) AS (VALUES ('en', 'germanic'), ('de', 'germanic'), ('fr', 'romance'), ('es', 'romance')),
x AS (SELECT read_id, count(*) AS n, count(DISTINCT family) AS f, min(organism) AS one, min(family) AS fam FROM hit JOIN t USING (organism) GROUP BY 1)
SELECT read_id, CASE WHEN n = 1 THEN one WHEN f = 1 THEN fam WHEN n > 1 THEN 'root' ELSE 'unclassified' END AS label, CAST(CASE WHEN n = 1 THEN 3 WHEN f = 1 THEN 2 WHEN n > 1 THEN 1 ELSE 0 END AS INTEGER) AS depth, CASE WHEN n = 1 THEN one END AS most_specific FROM reads LEFT JOIN x USING (read_id)""")
def _(spark, d):
    r = reads(spark, d)
    families = {"en": "germanic", "de": "germanic", "fr": "romance", "es": "romance"}
    taxonomy = spark.createDataFrame([(o, ["root", f, o]) for o, f in families.items()], "organism string, path array<string>")
    return C.lowest_common(P.seed_hits(r, genomes(spark, d), 14), r, taxonomy)


FAMILIES = {"en": "germanic", "de": "germanic", "fr": "romance", "es": "romance"}
_LCA = "CASE WHEN {a} = {b} THEN {a} WHEN split_part({a}, ';', 2) = split_part({b}, ';', 2) THEN 'root;' || split_part({a}, ';', 2) ELSE 'root' END"
_TREE = ",\n".join([_MIN, """tree(organism, p) AS (VALUES ('en', 'root;germanic;en'), ('de', 'root;germanic;de'), ('fr', 'root;romance;fr'), ('es', 'root;romance;es')),
tidx AS (SELECT minimizer, """ + _LCA.format(a="min(p)", b="max(p)") + """ AS node FROM midx JOIN tree USING (organism) GROUP BY 1),
parts AS (SELECT read_id, count(*) AS n_parts FROM rm GROUP BY 1),
votes AS (SELECT read_id, node, count(*) AS n FROM rm JOIN tidx USING (minimizer) GROUP BY 1, 2),
scores AS (SELECT t.read_id, t.node, sum(h.n) AS score FROM votes t JOIN votes h ON t.read_id = h.read_id AND starts_with(t.node || ';', h.node || ';') GROUP BY 1, 2),
chosen AS (SELECT read_id, """ + _LCA.format(a="min(node)", b="max(node)") + """ AS node FROM (SELECT *, max(score) OVER (PARTITION BY read_id) AS top FROM scores) WHERE score = top GROUP BY 1),
ways AS (SELECT read_id, node, unnest(range(1, len(string_split(node, ';')) + 1)) AS depth FROM chosen),
clades AS (SELECT w.read_id, w.depth, array_to_string(string_split(w.node, ';')[:w.depth], ';') AS taxon, sum(v.n) AS n FROM ways w JOIN votes v ON v.read_id = w.read_id AND starts_with(v.node || ';', array_to_string(string_split(w.node, ';')[:w.depth], ';') || ';') GROUP BY ALL),
ends AS (SELECT read_id, max(depth) AS depth, arg_max(taxon, depth) AS taxon, arg_max(n, depth) AS n FROM clades JOIN parts USING (read_id) WHERE n >= {confidence} * n_parts GROUP BY 1),
labelled AS (SELECT r.read_id, coalesce(string_split(e.taxon, ';')[-1], 'unclassified') AS label, coalesce(e.taxon, '') AS path, CAST(coalesce(e.depth, 0) AS INTEGER) AS depth, CAST(coalesce(h.n_hits, 0) AS BIGINT) AS n_hits, coalesce(n_parts, 0) AS n_parts, coalesce(round(e.n / n_parts, 6), 0.0) AS support FROM reads r LEFT JOIN ends e USING (read_id) LEFT JOIN parts USING (read_id) LEFT JOIN (SELECT read_id, sum(n) AS n_hits FROM votes GROUP BY 1) h USING (read_id))"""])


def _taxa(spark: SparkSession, d: str, confidence: float) -> DataFrame:
    taxonomy = spark.createDataFrame([(o, ["root", f, o]) for o, f in FAMILIES.items()], "organism string, path array<string>")
    return X.classify_taxa(reads(spark, d), X.taxon_index(genomes(spark, d), taxonomy, KMER, WINDOW), KMER, WINDOW, confidence)


def _register_taxa(name: str, confidence: float) -> None:
    @query(name, f"WITH {_TREE.replace('{confidence}', str(confidence))} SELECT * FROM labelled")
    def _(spark, d):
        return _taxa(spark, d, confidence).withColumn("path", F.array_join("path", ";"))


for _name, _confidence in (("c12_taxa", 0.0), ("c12_taxa_third", 0.34), ("c12_taxa_all", 1.0)):
    _register_taxa(_name, _confidence)


@query("c12_report", f"""WITH {_TREE.replace('{confidence}', '0.34')}, p AS (SELECT CASE WHEN depth > 0 THEN path ELSE 'unclassified' END AS path, depth FROM labelled),
x AS (SELECT path, depth, unnest(range(1, greatest(depth, 1) + 1)) AS i FROM p)
SELECT array_to_string(string_split(path, ';')[:i], ';') AS taxon, CAST(CASE WHEN depth > 0 THEN i ELSE 0 END AS INTEGER) AS depth, count(*) AS n_clade, count(*) FILTER (i = greatest(depth, 1)) AS n_own, round(100.0 * count(*) / (SELECT count(*) FROM labelled), 6) AS pct FROM x GROUP BY ALL""")
def _(spark, d):
    return X.taxon_report(_taxa(spark, d, 0.34))


# --- de Bruijn graphs -----------------------------------------------------------------------------------------
_EDGES = ",\n".join([_READS, _kmers_sql("rk", "reads", "read_id", KMER, False), f"e AS (SELECT kmer, substr(kmer, 1, {KMER - 1}) AS src, substr(kmer, 2) AS dst, substr(kmer, {KMER}, 1) AS base, count(*) AS cnt FROM rk GROUP BY 1)", "deg AS (SELECT node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1)"])


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return D.edges(reads(spark, d), KMER)


@query("d1_edges", f"WITH {_EDGES} SELECT * FROM e")
def _(spark, d):
    return _edges(spark, d)


@query("d1_packed", f"WITH {_EDGES} SELECT * FROM e")
def _(spark, d):
    e = Q.packed_edges(reads(spark, d), KMER)
    node = lambda c: Q.unpack(F.col(c), KMER - 1).alias(c)
    return e.select(Q.unpack(F.col("code"), KMER).alias("kmer"), node("src"), node("dst"), F.translate(F.col("base").cast("string"), "0123", "ACGT").alias("base"), "cnt")


@query("d2_size", f"WITH {_EDGES} SELECT (SELECT count(*) FROM deg) AS n_nodes, count(*) AS n_edges, CAST(sum(cnt) AS BIGINT) AS n_kmers FROM e")
def _(spark, d):
    return D.graph_size(_edges(spark, d))


@query("d3_degrees", f"WITH {_EDGES} SELECT node, n_in, n_out, n_out > n_in AS is_start FROM deg")
def _(spark, d):
    return D.degrees(_edges(spark, d))


@query("d4_euler")
def _(spark, d):
    return D.euler_walks(_edges(spark, d), KMER)


@query("d4_euler_cover", f"WITH {_EDGES} SELECT count(*) AS n_edges, count(*) AS n_once FROM e")
def _(spark, d):
    return D.walk_coverage(D.euler_walks(_edges(spark, d), KMER), _edges(spark, d), KMER)


@query("d5_contigs", "WITH p AS (SELECT item_id AS path, " + _SEQ + " AS seq FROM benchmark) SELECT path, seq FROM p WHERE length(seq) >= 11")
def _(spark, d):
    nodes = K.kmers(reads(spark, d), KMER - 1, skip_n=False).select(F.col("read_id").alias("path"), F.col("pos").alias("ord"), F.col("kmer").alias("node"))
    return D.path_sequences(nodes)


@query("d6_metrics", f"""WITH {_GENOMES}, s AS (SELECT organism, length(seq) AS len, length(regexp_replace(seq, '[^GC]', '', 'g')) AS gc FROM genomes),
r AS (SELECT organism, len, sum(len) OVER (PARTITION BY organism ORDER BY len DESC ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY organism ORDER BY len DESC) AS k, sum(len) OVER (PARTITION BY organism) AS total FROM s)
SELECT organism, CAST(total_length AS BIGINT) AS total_length, num_contigs, largest_contig, n50, n90, l50, l90, gc_content FROM (SELECT organism, max(total) AS total_length, count(*) AS num_contigs, max(len) AS largest_contig, max(len) FILTER (upto >= 0.5 * total) AS n50, max(len) FILTER (upto >= 0.9 * total) AS n90, min(k) FILTER (upto >= 0.5 * total) AS l50, min(k) FILTER (upto >= 0.9 * total) AS l90 FROM r GROUP BY 1) JOIN (SELECT organism, round(100.0 * sum(gc) / sum(len), 6) AS gc_content FROM s GROUP BY 1) USING (organism)""")
def _(spark, d):
    return E.assembly_metrics(genomes(spark, d), by=["organism"])


@query("d8_gfa", f"WITH {_EDGES} SELECT concat('H', chr(9), 'VN:Z:1.0') AS line UNION ALL SELECT concat('S', chr(9), node, chr(9), node) FROM deg UNION ALL SELECT concat('L', chr(9), src, chr(9), '+', chr(9), dst, chr(9), '+', chr(9), '{KMER - 2}M', chr(9), 'RC:i:', cnt) FROM e UNION ALL SELECT concat('P', chr(9), path, chr(9), string_agg(node || '+', ',' ORDER BY i), chr(9), '*') FROM (SELECT path, i, substr(seq, i, {KMER - 1}) AS node FROM (SELECT read_id AS path, seq, unnest(range(1, length(seq) - {KMER - 1} + 2)) AS i FROM reads)) GROUP BY path")
def _(spark, d):
    paths = K.kmers(reads(spark, d), KMER - 1, skip_n=False).select(F.col("read_id").alias("path"), F.col("pos").alias("ord"), F.col("kmer").alias("node"))
    return D.gfa_lines(_edges(spark, d), KMER, paths)


_UNITIGS = f"""{_EDGES}, mid AS (SELECT node FROM deg WHERE n_in = 1 AND n_out = 1),
walk AS (SELECT kmer AS head, kmer, dst, kmer AS seq, cnt AS total, 1 AS n FROM e WHERE src NOT IN (SELECT node FROM mid)
UNION ALL SELECT walk.head, e.kmer, e.dst, walk.seq || e.base, walk.total + e.cnt, walk.n + 1 FROM walk JOIN e ON e.src = walk.dst WHERE walk.dst IN (SELECT node FROM mid)),
unitigs AS (SELECT seq, n AS n_edges, round(total / n, 6) AS coverage FROM (SELECT head, arg_max(seq, n) AS seq, CAST(max(n) AS BIGINT) AS n, arg_max(total, n) AS total FROM walk GROUP BY head))"""


@query("d9_unitigs", f"WITH RECURSIVE {_UNITIGS} SELECT * FROM unitigs")
def _(spark, d):
    return D.unitigs(_edges(spark, d), KMER)


_METRICS = """l AS (SELECT len, gc, sum(len) OVER (ORDER BY len DESC ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (ORDER BY len DESC) AS r, sum(len) OVER () AS total FROM sized),
met AS (SELECT CAST(max(total) AS BIGINT) AS total_length, count(*) AS num_contigs, max(len) AS largest_contig, max(len) FILTER (upto >= 0.5 * total) AS n50, max(len) FILTER (upto >= 0.9 * total) AS n90, min(r) FILTER (upto >= 0.5 * total) AS l50, min(r) FILTER (upto >= 0.9 * total) AS l90, round(100.0 * sum(gc) / sum(len), 6) AS gc_content FROM l)"""


@query("d7_assemble", f"WITH RECURSIVE {_UNITIGS}, sized AS (SELECT length(seq) AS len, length(regexp_replace(seq, '[^GC]', '', 'g')) AS gc FROM unitigs), {_METRICS} SELECT * FROM met")
def _(spark, d):
    return D.assemble(reads(spark, d), KMER)["metrics"]


# --- evaluation -----------------------------------------------------------------------------------------------
_REPORTED = "big AS (SELECT * FROM genomes WHERE length(seq) >= 500), sized AS (SELECT length(seq) AS len, length(regexp_replace(seq, '[^GC]', '', 'g')) AS gc FROM big)"
_CELLS = [f"SELECT 'contigs (>= {x})' AS metric, CAST(count(*) AS DOUBLE) AS value FROM genomes WHERE length(seq) >= {x} UNION ALL SELECT 'total length (>= {x})', CAST(coalesce(sum(length(seq)), 0) AS DOUBLE) FROM genomes WHERE length(seq) >= {x}" for x in (0, 500, 1000)]
_CELLS += [f"SELECT '{name}', CAST({col} AS DOUBLE) FROM met" for name, col in (("GC (%)", "gc_content"), ("num_contigs", "nullif(num_contigs, 0)"), ("largest_contig", "largest_contig"), ("N50", "n50"), ("N90", "n90"), ("L50", "l50"), ("L90", "l90"))]
_CELLS += ["SELECT 'N''s per 100 kbp', CAST(CASE WHEN count(*) > 0 THEN 0.0 END AS DOUBLE) FROM big"]


@query("e1_contig_report", f"WITH {_GENOMES}, {_REPORTED}, {_METRICS} " + " UNION ALL ".join(_CELLS))
def _(spark, d):
    return E.contig_report(genomes(spark, d))


@query("e3_length_classes", """WITH s AS (SELECT n_chars AS len FROM documents), big AS (SELECT len, sum(len) OVER (ORDER BY len DESC ROWS UNBOUNDED PRECEDING) AS upto, sum(len) OVER () AS total FROM s WHERE len > 10000)
SELECT count(*) AS contigs, CAST(sum(len) AS BIGINT) AS total_length, count(*) FILTER (len > 10000) AS contigs_large, CAST(coalesce(sum(len) FILTER (len > 10000), 0) AS BIGINT) AS length_large, count(*) FILTER (len > 1000000) AS contigs_huge, max(len) AS longest, (SELECT len FROM s ORDER BY len DESC LIMIT 1 OFFSET 1) AS second_longest, (SELECT max(len) FROM big WHERE upto >= 0.5 * total) AS n50_large FROM s""")
def _(spark, d):
    return E.length_classes(table(spark, d, "documents").select(F.col("n_chars").alias("length")))


# --- overlap assembly -----------------------------------------------------------------------------------------
_INSIDE = f"{_READS}, ins AS (SELECT DISTINCT a.read_id FROM reads a JOIN reads b ON length(a.seq) < length(b.seq) AND contains(b.seq, a.seq))"


@query("o1_contained", f"WITH {_GENOMES} SELECT DISTINCT a.seq_id AS read_id FROM genomes a JOIN genomes b ON length(a.seq) < length(b.seq) AND contains(b.seq, a.seq)")
def _(spark, d):
    return O.contained(genomes(spark, d).select(F.col("seq_id").alias("read_id"), "seq"))


_PAIRS = ",\n".join([_INSIDE, _kmers_sql("rk4", "reads", "read_id", 4, False), "rh AS (SELECT DISTINCT read_id, substr(md5(kmer), 1, 8) AS hash FROM rk4)", "rs AS (SELECT read_id, hash FROM rh QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY hash) <= 100)", "rz AS (SELECT read_id, count(*) AS n FROM rs GROUP BY 1)", "pr AS (SELECT a.read_id AS src, b.read_id AS dst, count(*) AS shared FROM rs a JOIN rs b ON a.hash = b.hash AND a.read_id <> b.read_id WHERE a.read_id NOT IN (SELECT read_id FROM ins) AND b.read_id NOT IN (SELECT read_id FROM ins) GROUP BY 1, 2)", "pairs AS (SELECT src, dst FROM pr JOIN rz x ON src = x.read_id JOIN rz y ON dst = y.read_id WHERE round(shared / (x.n + y.n - shared), 6) >= 0.1)"])
_OVER = f"{_PAIRS},\nov AS (SELECT src, dst, L AS overlap_len, 1.0 - miss AS identity, row_number() OVER (PARTITION BY src, dst ORDER BY miss, L) AS r FROM (SELECT src, dst, L, hamming(substr(a.seq, length(a.seq) - L + 1), substr(b.seq, 1, L)) / L AS miss FROM (SELECT src, dst, unnest(range(8, least(length(a.seq), length(b.seq)) + 1)) AS L FROM pairs JOIN reads a ON src = a.read_id JOIN reads b ON dst = b.read_id) JOIN reads a ON src = a.read_id JOIN reads b ON dst = b.read_id)), best AS (SELECT src, dst, CAST(overlap_len AS INTEGER) AS overlap_len, identity FROM ov WHERE r = 1), oe AS (SELECT src, dst, overlap_len, round(identity, 6) AS identity, round(overlap_len * identity, 6) AS weight FROM best WHERE identity >= 0.6)"


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    r = reads(spark, d)
    return O.best_overlaps(O.candidate_pairs(M.sketch(r, 4, 100, "read_id"), O.contained(r)), r, 8)


@query("o3_pairs", f"WITH {_PAIRS} SELECT * FROM pairs")
def _(spark, d):
    r = reads(spark, d)
    return O.candidate_pairs(M.sketch(r, 4, 100, "read_id"), O.contained(r))


@query("o4_overlaps", f"WITH {_OVER} SELECT src, dst, overlap_len, round(identity, 6) AS identity FROM best")
def _(spark, d):
    return _overlaps(spark, d).withColumn("identity", F.round("identity", 6))


@query("o5_edges", f"WITH {_OVER} SELECT * FROM oe")
def _(spark, d):
    return O.overlap_edges(_overlaps(spark, d), 0.6)


@query("o6_stats", f"WITH {_OVER} SELECT count(DISTINCT src) AS n_nodes, count(*) AS n_edges FROM oe")
def _(spark, d):
    return O.overlap_stats(O.overlap_edges(_overlaps(spark, d), 0.6))


@query("g_components", f"WITH RECURSIVE {_OVER}, both_ways AS (SELECT src, dst FROM oe UNION SELECT dst, src FROM oe), reach(node, label) AS (SELECT src, src FROM both_ways UNION SELECT b.dst, reach.label FROM reach JOIN both_ways b ON b.src = reach.node) SELECT node, min(label) AS label FROM reach GROUP BY 1")
def _(spark, d):
    from ..operators.components import components

    return components(O.overlap_edges(_overlaps(spark, d), 0.6))


@query("o11_assemble")
def _(spark, d):
    return O.assemble(phred_reads(spark, d), 4, 100, 0.1, 8, 0.6, err="err")["contigs"]


@query("o7_paths")
def _(spark, d):
    return O.greedy_paths(O.overlap_edges(_overlaps(spark, d), 0.6))


# A given layout: reads in id order overlap by a quarter of the shorter one.
_LAYOUT = f"{_READS}, o AS (SELECT read_id, length(seq) AS len, lag(read_id) OVER w AS prev, lag(length(seq)) OVER w AS plen, row_number() OVER w - 1 AS ord FROM reads WINDOW w AS (ORDER BY read_id)), lay AS (SELECT 0 AS path, ord, read_id, CAST(sum(coalesce(plen - least(plen, len) // 4, 0)) OVER (ORDER BY ord) AS BIGINT) AS pos FROM o)"


def _given_layout(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    r = reads(spark, d)
    w = Window.orderBy("read_id")  # a few benchmark reads on one given path
    order = r.select("read_id", F.length("seq").alias("len"), F.lag("read_id").over(w).alias("prev"), F.lag(F.length("seq")).over(w).alias("plen"), (F.row_number().over(w) - 1).cast("long").alias("ord"))
    e = order.where("prev is not null").select(F.col("prev").alias("src"), F.col("read_id").alias("dst"), F.floor(F.least("plen", "len") / 4).cast("int").alias("overlap_len"))
    return O.layout(order.select(F.lit(0).alias("path"), "ord", "read_id"), e, r)


@query("o8_layout", f"WITH {_LAYOUT} SELECT path, ord, read_id, pos FROM lay")
def _(spark, d):
    return _given_layout(spark, d)


_CALLED = f"{_LAYOUT}, b AS (SELECT path, pos + i - 1 AS place, substr(seq, i, 1) AS base, 1.0 - pow(10.0, -((i * 7) % 40 + 2) / 10.0) AS w FROM (SELECT path, pos, seq, unnest(range(1, length(seq) + 1)) AS i FROM lay JOIN reads USING (read_id))), s AS (SELECT path, place, base, round(sum(w), 9) AS weight FROM b GROUP BY 1, 2, 3), called AS (SELECT path, place, base, weight FROM s QUALIFY row_number() OVER (PARTITION BY path, place ORDER BY weight DESC, base) = 1)"


@query("o9_consensus_bases", f"WITH {_CALLED} SELECT path, place, base, round(weight, 6) AS weight FROM called")
def _(spark, d):
    return O.consensus_bases(_given_layout(spark, d), phred_reads(spark, d)).withColumn("weight", F.round("weight", 6))


@query("o9_consensus", f"WITH {_CALLED} SELECT path, string_agg(coalesce(base, 'N'), '' ORDER BY place) AS seq FROM (SELECT 0 AS path, unnest(range(0, (SELECT max(place) + 1 FROM called))) AS place) LEFT JOIN called USING (path, place) GROUP BY 1")
def _(spark, d):
    return O.consensus(O.consensus_bases(_given_layout(spark, d), phred_reads(spark, d)))


# --- profiles -------------------------------------------------------------------------------------------------
_TAXA = f"{_REPORT}, taxa AS (SELECT sample, CASE WHEN taxid = '0' THEN 'Unclassified' ELSE rank || '_' || name END AS taxon, arg_max(pct, line_no) AS pct FROM rep WHERE pct >= 0.1 AND (taxid = '0' OR rank <> 'X') GROUP BY 1, 2), mat AS (SELECT sample, taxon, coalesce(pct, 0.0) AS pct FROM (SELECT DISTINCT sample FROM taxa) CROSS JOIN (SELECT DISTINCT taxon FROM taxa) LEFT JOIN taxa USING (sample, taxon))"


@query("t1_report_taxa", f"WITH {_TAXA} SELECT sample, taxon, pct FROM taxa")
def _(spark, d):
    return T.report_taxa(report(spark, d), 0.1)


@query("t2_profile", f"WITH {_TAXA} SELECT sample, taxon, pct FROM mat")
def _(spark, d):
    return T.profile_matrix(T.report_taxa(report(spark, d), 0.1))


@query("t2_profile_wide", f"WITH {_TAXA} SELECT * FROM (PIVOT mat ON taxon IN ('Unclassified', 'F_src1', 'G_src8') USING coalesce(max(pct), 0.0) GROUP BY sample)")
def _(spark, d):
    return T.wide_matrix(T.report_taxa(report(spark, d), 0.1)).select("sample", "Unclassified", "F_src1", "G_src8")


@query("t3_groups", "SELECT lang AS sample, CASE WHEN starts_with(lang, 'e') THEN 'west' WHEN starts_with(lang, 'd') THEN 'middle' ELSE 'Unknown' END AS sample_group, count(*) AS n FROM documents GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "documents").groupBy(F.col("lang").alias("sample")).agg(F.count(F.lit(1)).alias("n")).withColumn("sample_group", T.sample_group(F.col("sample"), PREFIXES))


@query("m1_zscore", f"WITH {_TAXA} SELECT sample, taxon, pct, round(CASE WHEN s > 1e-12 THEN (pct - m) / s ELSE 0.0 END, 6) + 0.0 AS z FROM mat JOIN (SELECT taxon, avg(pct) AS m, stddev_pop(pct) AS s FROM mat GROUP BY 1) USING (taxon)")
def _(spark, d):
    return T.standardize(T.profile_matrix(T.report_taxa(report(spark, d), 0.1))).select("sample", "taxon", "pct", (F.round("z", 6) + 0.0).alias("z"))


@query("m2_pca")
def _(spark, d):
    return T.pca(table(spark, d, "embeddings"))


_MEANS = "v AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2)"


@query("m3_distances", f"WITH {_MEANS} SELECT a.label AS a, b.label AS b, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 6) AS distance FROM v a JOIN v b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2")
def _(spark, d):
    return T.distances(vectors(spark, d), "label", "vec").withColumn("distance", F.round("distance", 6))


@query("m4_ward")
def _(spark, d):
    return T.ward(vectors(spark, d), "label", "vec")


@query("m5_flat_cut")
def _(spark, d):
    return T.flat_cut(T.ward(vectors(spark, d), "label", "vec"))


@query("m6_top_taxa", f"WITH {_TAXA}, top AS (SELECT taxon FROM mat GROUP BY 1 ORDER BY round(avg(pct), 9) DESC, taxon LIMIT 10) SELECT sample, taxon, pct, round(coalesce((pct - min(pct) OVER w) / nullif(max(pct) OVER w - min(pct) OVER w, 0), 0.0), 6) AS scaled FROM mat WHERE taxon IN (SELECT taxon FROM top) WINDOW w AS (PARTITION BY taxon)")
def _(spark, d):
    return T.top_taxa(T.profile_matrix(T.report_taxa(report(spark, d), 0.1)), 10).withColumn("scaled", F.round("scaled", 6))


_SCORES = "sc AS (SELECT CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS sample_group, CAST(embedding[1] AS DOUBLE) AS pc1, CAST(embedding[2] AS DOUBLE) AS pc2 FROM embeddings)"


@query("m7_separation", f"WITH {_SCORES}, g AS (SELECT sample_group, count(*) AS n, avg(pc1) AS m1, avg(pc2) AS m2 FROM sc GROUP BY 1) SELECT sample_group, n, round(m1, 6) AS mean_pc1, round(m2, 6) AS mean_pc2, (max(m1) OVER () - min(m1) OVER () > 2 OR max(m2) OVER () - min(m2) OVER () > 2) AND count(*) OVER () > 1 AS clear, 0.3 > 0.25 AS strong FROM g")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.when(F.col("label") < 5, "a").otherwise("b").alias("sample_group"), F.col("embedding")[0].cast("double").alias("pc1"), F.col("embedding")[1].cast("double").alias("pc2"), F.lit(0.3).alias("explained1"))
    return T.group_separation(e).withColumns({"mean_pc1": F.round("mean_pc1", 6), "mean_pc2": F.round("mean_pc2", 6)})


# --- SQL only ------------------------------------------------------------------------------------------------
_SQL_GENOMES = "SELECT doc_id AS seq_id, lang AS organism, regexp_replace(upper(text), '[^ACGTN]+', '') AS seq FROM parquet.`{d}/documents.parquet`"


@query("sql_kmer_counts", f"WITH {_INDEX_N} SELECT * FROM idx")
def _(spark, d):
    return register_functions(spark).sql(f"SELECT kmer, organism, count(*) AS cnt FROM (SELECT organism, kmers(seq, {KMER}) AS found FROM ({_SQL_GENOMES.format(d=d)})), LATERAL inline(found) GROUP BY kmer, organism")


@query("sql_minimizers", f"WITH {_MIN.replace('[^ACGT]', '[^ACGTN]')} SELECT seq_id, organism, minimizer FROM gm")
def _(spark, d):
    return register_functions(spark).sql(f"SELECT seq_id, organism, minimizer FROM (SELECT seq_id, organism, minimizers(seq, {KMER}, {WINDOW}) AS found FROM ({_SQL_GENOMES.format(d=d)})), LATERAL inline(found)")


@query("sql_fasta", f"WITH {_GENOMES} SELECT organism, CAST(seq_id AS VARCHAR) AS seq_id, 'of ' || organism AS description, seq, CASE WHEN length(seq) > 0 THEN round(100.0 * length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq), 6) END AS gc FROM genomes")
def _(spark, d):
    text = "concat('; made of documents', char(10), '>', seq_id, ' of ', organism, char(10), regexp_replace(lower(regexp_replace(seq, 'N', '')), '(.{60})', concat('$1', char(13), char(10))), char(10))"
    return register_functions(spark).sql(f"SELECT organism, x.seq_id, x.description, x.seq, round(gc_percent(x.seq), 6) AS gc FROM (SELECT organism, fasta_records({text}) AS found FROM ({_SQL_GENOMES.format(d=d)})), LATERAL inline(found) AS x")


# --- sinks as rows --------------------------------------------------------------------------------------------
@query("w5_summary_wide", f"WITH {_C3}, p AS (SELECT label, read_id % 2 AS g FROM c3), t AS (SELECT g, count(*) AS n FROM p GROUP BY 1) SELECT label, coalesce(round(100.0 * count(*) FILTER (p.g = 0) / (SELECT n FROM t WHERE g = 0), 2), 0.0) AS \"even\", coalesce(round(100.0 * count(*) FILTER (p.g = 1) / (SELECT n FROM t WHERE g = 1), 2), 0.0) AS \"odd\" FROM p GROUP BY 1")
def _(spark, d):
    from ..sources.sinks import summary_wide

    labelled = C.classify_threshold(reads(spark, d), _index(spark, d), KMER, 0.1)
    return summary_wide(labelled.withColumn("dataset", F.when(F.col("read_id") % 2 == 0, "even").otherwise("odd")), ["even", "odd"])


@query("w6_fasta_lines", f"WITH {_READS} SELECT concat('>', read_id, ' length=', length(seq), chr(10), trim(regexp_replace(seq, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10))) AS line FROM reads")
def _(spark, d):
    from ..sources.sinks import fasta_lines

    return fasta_lines(reads(spark, d), "read_id")
