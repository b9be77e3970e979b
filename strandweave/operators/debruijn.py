"""De Bruijn graphs as edge tables, unitigs by pointer jumping, Eulerian walks of contracted graphs in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components, stored
from .kmers import kmers
from .metrics import assembly_metrics
from .trails import euler_trails, placed_chains


def edges(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer, src, dst, base, cnt): each distinct k-mer is an edge between its prefix and its suffix."""
    counts = kmers(reads.select(seq), k, seq, skip_n=False).groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.select("kmer", F.expr(f"substring(kmer, 1, {k - 1})").alias("src"), F.expr(f"substring(kmer, 2, {k - 1})").alias("dst"), F.expr(f"substring(kmer, {k}, 1)").alias("base"), "cnt")


def degrees(e: DataFrame) -> DataFrame:
    """(node, n_in, n_out, is_start): is_start marks nodes with more edges out than in."""
    both = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out")).withColumn("is_start", F.col("n_out") > F.col("n_in"))


def graph_size(e: DataFrame) -> DataFrame:
    """nodes, edges and k-mer occurrences."""
    nodes = degrees(e).agg(F.count(F.lit(1)).alias("n_nodes"))
    return nodes.crossJoin(F.broadcast(e.agg(F.count(F.lit(1)).alias("n_edges"), F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("n_kmers"))))  # one row


def unitigs(e: DataFrame, k: int) -> DataFrame:
    """(seq, n_edges, coverage): maximal paths through nodes with one edge in and one out; cycles start at their smallest k-mer.

    Every edge learns its path's first edge and its distance from it by pointer
    jumping: a logarithmic number of joins, each cut into a table.
    """
    through = degrees(e).where("n_in = 1 and n_out = 1").select("node")
    prev = e.select(F.col("kmer").alias("up"), F.col("dst").alias("node")).join(through, "node")
    links = e.select(F.col("kmer").alias("id"), "src").join(prev, F.col("src") == F.col("node"), "left").select("id", "up")
    path = placed_chains(links).join(e.select(F.col("kmer").alias("id"), "base", "cnt"), "id")
    by = path.groupBy("head").agg(F.sort_array(F.collect_list(F.struct("pos", "base", "cnt"))).alias("x"))
    return by.select(F.concat(F.expr(f"substring(head, 1, {k - 1})"), F.array_join(F.transform("x", lambda s: s["base"]), "")).alias("seq"), F.size("x").cast("long").alias("n_edges"), F.round(F.aggregate("x", F.lit(0).cast("long"), lambda a, s: a + s["cnt"]) / F.size("x"), 6).alias("coverage"))


def euler_walks(e: DataFrame, k: int) -> DataFrame:
    """(component, walk, seq): walks of each weak component that together use every edge exactly once, as few as possible.

    Paths without a branch are contracted first; what is left is walked in rounds of
    joins, so no component is one group.  `walk` is the walk's first k-mer.
    """
    whole = unitigs(e, k).select(F.expr(f"substring(seq, 1, {k})").alias("id"), F.expr(f"substring(seq, 1, {k - 1})").alias("src"), F.right("seq", F.lit(k - 1)).alias("dst"), "seq")
    whole = stored(whole)
    label = components(whole.select("src", "dst")).select(F.col("node").alias("src"), F.col("label").alias("component"))
    part = euler_trails(whole).join(whole.select("id", "seq", "src"), "id").join(label, "src")
    by = part.groupBy("component", F.col("trail").alias("walk")).agg(F.sort_array(F.collect_list(F.struct("pos", "seq"))).alias("x"))
    text = F.concat(F.element_at("x", 1)["seq"], F.array_join(F.transform(F.slice("x", F.lit(2), F.size("x")), lambda s: F.substring(s["seq"], F.lit(k), F.length(s["seq"]))), ""))
    return by.select("component", "walk", text.alias("seq"))


def walk_coverage(walks: DataFrame, e: DataFrame, k: int) -> DataFrame:
    """(n_edges, n_once): the graph's edges, and those that exactly one place of one walk uses."""
    used = kmers(walks.select("seq"), k, "seq", skip_n=False).groupBy("kmer").agg(F.count(F.lit(1)).alias("times"))
    return e.select("kmer").join(used, "kmer", "full_outer").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("times") == 1).alias("n_once"))


def assemble(reads: DataFrame, k: int, seq: str = "seq") -> dict[str, DataFrame]:
    """Graph, contigs (contig, seq, n_edges, coverage; longest first), their metrics and GFA lines, in that order of steps."""
    graph = stored(edges(reads, k, seq))
    found = unitigs(graph, k)
    found = stored(found.withColumn("size", F.length("seq")))
    # Only one count for each length is ordered over all contigs.
    longer = found.groupBy("size").agg(F.count(F.lit(1)).alias("n")).select("size", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("size").orderBy("seq"))
    contigs = stored(found.withColumn("n", inside).join(longer, "size").select((F.col("before") + F.col("n")).cast("long").alias("contig"), "seq", "n_edges", "coverage"))
    paths = kmers(contigs.select("contig", "seq"), k - 1, skip_n=False).select(F.concat(F.lit("contig_"), F.col("contig").cast("string")).alias("path"), F.col("pos").alias("ord"), F.col("kmer").alias("node"))
    return {"edges": graph, "contigs": contigs, "metrics": assembly_metrics(contigs), "gfa": gfa_lines(graph, k, paths)}


def gfa_lines(e: DataFrame, k: int, paths: DataFrame | None = None) -> DataFrame:
    """(line) of a GFA 1.0 file: a header, a segment for each node, a link of k - 2 bases for each edge, with its count.

    With (path, ord, node), also a line for each path that names its segments in order.
    """
    spark = e.sparkSession
    head = spark.createDataFrame([("H\tVN:Z:1.0",)], "line string")
    nodes = degrees(e).select(F.concat(F.lit("S\t"), "node", F.lit("\t"), "node").alias("line"))
    links = e.select(F.concat(F.lit("L\t"), "src", F.lit("\t+\t"), "dst", F.lit(f"\t+\t{k - 2}M\tRC:i:"), F.col("cnt").cast("string")).alias("line"))
    lines = head.unionByName(nodes).unionByName(links)
    if paths is None:
        return lines
    by = paths.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ord", "node"))).alias("x"))
    named = F.array_join(F.transform("x", lambda s: F.concat(s["node"], F.lit("+"))), ",")
    return lines.unionByName(by.select(F.concat(F.lit("P\t"), F.col("path").cast("string"), F.lit("\t"), named, F.lit("\t*")).alias("line")))


def path_sequences(paths: DataFrame) -> DataFrame:
    """(path, seq) from (path, ord, node): the first node and the last base of each further one."""
    by = paths.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ord", "node"))).alias("x"))
    return by.select("path", F.concat(F.element_at("x", 1)["node"], F.array_join(F.transform(F.slice("x", F.lit(2), F.size("x")), lambda s: F.right(s["node"], F.lit(1))), "")).alias("seq"))
