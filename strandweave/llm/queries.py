"""Registered queries of the training-data operators, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bpe_exact, decontam, hmm, lexical, line_dedup, media_ts, minhash, runs, sharding, suffix_dedup, toxicity, url_rules
from ._graph import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text (null: empty) stored as a transport stream, read back and described."""
    return media_ts.text_media_digest(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document under 13-word benchmark windows, the items found and the verdict; null has no words."""
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of each text (null: empty) under word frequencies and under the hidden Markov model."""
    return hmm.score_texts(_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each text (null: empty) in 400-byte strings that start elsewhere too, what is left, and shared passages of 50 words."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, longest fitting rule and verdict of each page; null and odd urls have neither host nor path."""
    return url_rules.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "content_rule")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count, group and whether it is kept, of each document; documents without words are groups of their own."""
    return minhash.near_duplicate_groups(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_key")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of each text (null: empty)."""
    return bpe.token_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the chain's categories and the verdict, of each document; null and empty texts are texts without words."""
    docs = _table(spark, sf_dir, "documents")
    chain = toxicity.train_chain(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), chain).drop("text")


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without repeated or similar lines, and how many went; null stays null."""
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of each document by the first version of a stored slot map, and the slot itself; law `bytes`."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_folder(spark)}/strandweave-slots-{uuid.uuid4().hex}"
    sharding.plan_shards(docs, 8).save(spark, path)
    out = sharding.assign_shards(docs, sharding.SlotMap.load(spark, path, 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item, by integer scores over a stored table of postings; texts without terms are never found."""
    return lexical.rank_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text"), 50)


def op12_exact_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of each text (null: empty); the added token in a text is that token."""
    return bpe_exact.token_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in each text (null: no words), the longest one, and the text without their repeats."""
    return runs.run_digest(_table(spark, sf_dir, "documents"), planted=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_transport_stream, op2_decontamination, op3_hidden_markov, op4_suffix_dedup, op5_url_filter, op6_minhash, op7_byte_bpe, op8_toxicity, op9_fuzzy_lines, op10_virtual_slots, op11_lexical_search, op12_exact_bpe, op13_periodic_runs)}


#: DuckDB SQL with the same rows, where SQL can express them.
ORACLE: dict[str, str] = {
    "op5_url_filter": r"""
WITH u AS (
  SELECT page_id, url,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r(h, p, a) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
c(pat) AS (VALUES ('(^|[^0-9a-z])cheap[-_.]?pills([^0-9a-z]|$)'), ('(^|[^0-9a-z])casino([^0-9a-z]|$)'), ('(^|[^0-9a-z])xxx([^0-9a-z]|$)')),
m AS (
  SELECT u.page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.a, length(r.h || r.p)) AS a
  FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
  GROUP BY u.page_id),
k AS (
  SELECT u.page_id, arg_max(c.pat, length(c.pat)) AS content_rule
  FROM u JOIN c ON regexp_matches(u.host || u.path, c.pat) GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.a, CASE WHEN k.content_rule IS NOT NULL THEN 'block' END, 'allow') AS verdict, k.content_rule
FROM u LEFT JOIN m USING (page_id) LEFT JOIN k USING (page_id)
""",
    "op2_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(2, len(w) - 11))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM i),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT dw.doc_id, dw.s, dw.n, i.item_id FROM dw JOIN i ON dw.win = i.win AND dw.n = i.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS l FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(d.w), false) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op6_minhash": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM shared JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.doc_id),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN size USING (doc_id)
""",
    "op11_lexical_search": r"""
WITH d AS (
  SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT doc_id, text, n, term, count(*) AS tf FROM (SELECT doc_id, text, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
m AS (
  SELECT item_id, doc_id, text, CAST(sum(f.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY item_id, doc_id, text)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, text) AS INTEGER) AS rank, doc_id, score
FROM m WHERE score > 0 QUALIFY rank <= 50
""",
}
