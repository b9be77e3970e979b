"""The sequence functions for spark.sql: SQL functions that Spark inlines into the plan.

    register_functions(spark)
    SELECT read_id, pos, kmer FROM (SELECT read_id, kmers(seq, 12) AS found FROM reads), LATERAL inline(found)

Those with many results return an array of structs for `inline`, so a row's results are made
where the row is; table functions would be planned as joins on whole sequences.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _words(pattern: str) -> str:
    """What `pattern` finds at each place of `seq` (none within a surrogate pair), in one pass: substring() would walk the string from its start."""
    return rf"CASE WHEN k > 0 OR seq IS NULL THEN regexp_extract_all(seq, concat(r'(?s)(?![\x{{DC00}}-\x{{DFFF}}])', {pattern}), 1) ELSE CAST(array() AS ARRAY<STRING>) END"


def _with(name: str, value: str, result: str) -> str:
    """`result`, an array made of `value` under a name; null without one."""
    return f"flatten(transform(array({value}), {name} -> {result}))"


#: Signature and body of each function; null sequences give null, so no rows.
FUNCTIONS = {
    # (pos, kmer) of each k-mer without N.
    "kmers(seq STRING, k INT) RETURNS ARRAY<STRUCT<pos: BIGINT, kmer: STRING>>": _with(
        "found", _with("words", _words("'(?=(.{', k, '}))'"), "transform(words, (x, i) -> struct(CAST(i AS BIGINT) AS pos, x AS kmer))"), "CASE WHEN contains(seq, 'N') THEN filter(found, x -> NOT contains(x.kmer, 'N')) ELSE found END"
    ),
    # (minimizer), distinct: the smallest k-mer without N of each full window of w k-mers; words with an N are found as empty.
    "minimizers(seq STRING, k INT, w INT) RETURNS ARRAY<STRUCT<minimizer: STRING>>": "transform(array_distinct(filter("
    + _with(
        "words",
        _with("words", _words("'(?=.{', k, '})(?:(?=([^N]{', k, '}))|)'"), "CASE WHEN contains(seq, 'N') THEN transform(words, x -> nullif(x, '')) ELSE words END"),
        "transform(CASE WHEN w > 0 AND size(words) >= w THEN sequence(1, size(words) - w + 1) ELSE CAST(array() AS ARRAY<INT>) END, i -> array_min(slice(words, i, w)))",
    )
    + ", m -> m IS NOT NULL)), m -> struct(m AS minimizer))",
    # (seq_id, description, seq) of each record of a FASTA text; what comes before the first header is left out.
    "fasta_records(text STRING) RETURNS ARRAY<STRUCT<seq_id: STRING, description: STRING, seq: STRING>>": r"transform(filter(split(text, r'(?m)^>'), (r, i) -> i > 0), r -> struct("
    r"regexp_extract(r, r'^[ \t]*([^ \r\n]*)', 1) AS seq_id, trim(regexp_extract(r, r'^[ \t]*[^ \r\n]* ?([^\r\n]*)', 1)) AS description, upper(regexp_replace(regexp_replace(r, r'^[^\r\n]*', ''), r'\s', '')) AS seq))",
    # Share of G and C in percent, null if empty.
    "gc_percent(seq STRING) RETURNS DOUBLE": "100.0D * length(regexp_replace(upper(seq), '[^GC]', '')) / nullif(length(seq), 0)",
    # Code of a k-mer, two bits a base; null where a letter is none of A, C, G, T or there are more than 31.
    "pack_kmer(kmer STRING) RETURNS BIGINT": "CASE WHEN length(kmer) <= 31 AND upper(kmer) RLIKE '^[ACGT]+$' THEN CAST(conv(translate(upper(kmer), 'ACGT', '0123'), 4, 10) AS BIGINT) END",
    "unpack_kmer(code BIGINT, k INT) RETURNS STRING": "translate(lpad(conv(CAST(code AS STRING), 10, 4), k, '0'), '0123', 'ACGT')",
}


def register_functions(spark: SparkSession) -> SparkSession:
    """Make the functions known to a session, replacing temporary ones of the same names."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return spark
