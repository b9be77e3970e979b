"""Ranked lexical search over a term-bucketed table of postings.

A posting is a row (term, document, its occurrences there, the document's
length).  Postings lie in directories by bucket of their term; within a bucket
they are dealt by document, so a term that most documents hold is spread.  A
search joins the items' terms with the postings, scores each match in integers,
sums by item and document, and keeps the first k of each item.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._graph import cut, shared_folder
from ._text import LOWER, map_pieces

#: Buckets of terms, and parts that the documents of one bucket are dealt to.
BUCKETS, PARTS = 16, 1024
#: Items' term rows that are broadcast at most; more are joined by a shuffle.
FEW_TERMS = 1 << 17

# ASCII letters and digits and all bytes beyond ASCII are kept, lower-cased; the rest separates terms.
_TO_TERMS = bytes(int(LOWER[b]) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in order, as UTF-8; null has none."""
    return text.encode().translate(_TO_TERMS).split() if text else []


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term), once each; rows with one key are one item."""
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.split(lower, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return items.select(F.col(key).alias("item"), F.explode(F.array_distinct(words)).alias("term")).where("term <> ''").distinct()


def _bucket(term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int").alias("bucket")


@dataclass
class Index:
    """A stored index: postings (bucket, term, doc, text_key, n, tf), the number of documents with terms and of all their terms."""

    postings: DataFrame
    documents: int
    length: int

    @classmethod
    def build(cls, docs: DataFrame, terms: DataFrame | None = None, key: str = "doc_id", text: str = "text", path: str | None = None) -> Index:
        """Index all documents in one pass over their texts and one shuffle.

        With `terms` (a column `term`) only those terms' postings are kept; counts
        of documents and lengths cover all documents in any case.  Documents are
        told apart by key and text: rows that repeat both count once.  Null keys
        are a key of their own.  The table goes to `path` or to the shared folder,
        from where it is deleted when the application ends.
        """
        spark, name, none = docs.sparkSession, key, None
        wanted = None
        if terms is not None:
            some = terms.select("term").distinct()
            rows = some.limit(FEW_TERMS + 1).collect()  # bounded
            if len(rows) <= FEW_TERMS:
                wanted = spark.sparkContext.broadcast(frozenset(r[0].encode() for r in rows))
                some = none

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, term, tf, length = [], [], [], []
            for i, t in enumerate(batch.column("_text").to_pylist()):
                count = Counter(terms_of(t))
                n = count.total()
                if not n:
                    continue
                # A row without a term stands for the document itself.
                kept = count.items() if wanted is None else [(w, count[w]) for w in count.keys() & wanted.value]
                row.append(i), term.append(None), tf.append(0), length.append(n)
                for w, c in kept:
                    row.append(i), term.append(w), tf.append(c), length.append(n)
            at = pa.array(row, pa.int32())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc").take(at), batch.column("text_key").take(at), pa.array(term, pa.binary()).cast(pa.string()), pa.array(length, pa.int64()), pa.array(tf, pa.int64())],
                names=["doc", "text_key", "term", "n", "tf"],
            )

        source = docs.select(F.col(name).alias("doc"), F.xxhash64(text).alias("text_key"), F.col(text).alias("_text"))
        schema = source.select("doc", "text_key").schema.add("term", "string").add("n", "long").add("tf", "long")
        found = map_pieces(source, "_text", run, schema)
        if terms is not None and some is not None:
            found = found.join(some.withColumn("_kept", F.lit(True)), "term", "left").where("term IS NULL OR _kept").drop("_kept")
        found = found.withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(_bucket())).withColumn("part", F.pmod(F.xxhash64("doc", "text_key"), F.lit(PARTS)))
        # Dealt by bucket and part, so repeated rows meet without a further shuffle.
        dealt = found.repartition("bucket", "part").groupBy("bucket", "part", "term", "doc", "text_key").agg(F.first("n").alias("n"), F.first("tf").alias("tf")).drop("part")
        own = path or f"{shared_folder(spark)}/strandweave-postings-{uuid.uuid4().hex}"
        dealt.write.partitionBy("bucket").parquet(own)
        if path is None:
            at = spark._jvm.org.apache.hadoop.fs.Path(own)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
        return cls.load(spark, own, dealt.schema)

    @classmethod
    def load(cls, spark: SparkSession, path: str, schema=None) -> Index:
        """An index written by `build`."""
        every = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
        n, total = every.where("bucket = -1").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        return cls(every.where("bucket >= 0"), n, total)

    def weights(self, asked: DataFrame) -> DataFrame:
        """(bucket, term, uses): each asked term that occurs, with the array of (item, w) that ask for it; weights of 0 add nothing and go."""
        words = asked.select("term").distinct().select("term", _bucket())
        df = self.postings.join(self._bounded(words, words), ["bucket", "term"]).groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
        w = F.floor(1000 * F.log(F.lit(2.0 * self.documents + 2) / (2 * F.col("df") + 1))).cast("long")
        return df.withColumn("w", w).where("w > 0").join(asked, "term").groupBy("bucket", "term").agg(F.collect_list(F.struct("item", "w")).alias("uses"))

    @staticmethod
    def _bounded(side: DataFrame, counted: DataFrame) -> DataFrame:
        return F.broadcast(side) if counted.limit(FEW_TERMS + 1).count() <= FEW_TERMS else side

    def search(self, asked: DataFrame, k: int = 50) -> DataFrame:
        """(item, rank, doc, score): the k best documents of each item of `asked` (item, term), with scores above 0.

        score = sum over the item's terms of w * ((10**9 * tf) div (1000 * tf + 20 * m)),
        w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 50 + (50 n N) div L.  Equal scores
        rank by key (nulls last), then by the text's digest.  Items of which nothing
        is found have no rows.
        """
        asked = cut(asked.select("item", "term").distinct())
        uses = self._bounded(self.weights(asked), asked)
        m = F.expr(f"50 + (50 * n * {self.documents}L) div {max(self.length, 1)}L")
        unit = F.expr("(1000000000L * tf) div (1000L * tf + 20L * m)")
        hit = self.postings.join(uses, ["bucket", "term"]).withColumn("m", m).select("doc", "text_key", unit.alias("unit"), "uses")
        # All matches of a document meet before they are multiplied by the items that ask for them.
        match = hit.repartition("doc", "text_key").select("doc", "text_key", "unit", F.explode("uses").alias("use"))
        summed = match.groupBy("doc", "text_key", F.col("use.item").alias("item")).agg(F.sum(F.col("use.w") * F.col("unit")).alias("score")).where("score > 0")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"), "text_key")
        return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "rank", "doc", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, rank, key, score) of the k best documents of each item, from an index of the items' terms over all documents.

    Empty or null texts hold no terms: such documents are never found and such
    items find nothing; without documents or items there are no rows.  Other
    columns are not looked at.
    """
    asked = cut(item_terms(items, item, text))
    found = Index.build(docs, asked, key, text).search(asked, k)
    return found.select(F.col("item").alias(item), "rank", F.col("doc").alias(key), "score")
