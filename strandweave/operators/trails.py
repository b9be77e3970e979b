"""Chains and Euler trails of large graphs, by rounds of joins.

A chain is what following one predecessor at a time gives.  Pointer jumping finds
every member's first member and its distance from it in a logarithmic number of
rounds; members of rings learn the ring's smallest member.

Trails: at every node incoming and outgoing edges are paired, which cuts the graph
into paths and rings.  A ring that meets another trail at a node is spliced in there by
exchanging successors.  Each round every ring hooks onto the smallest trail that
it meets, so hooks never form a circle, and all rings that hook at a node are spliced at
once.  Paths are as few as can be from the start; in the end a component is either
paths only or one ring, which is cut at its smallest edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import discard, stored


def chains(links: DataFrame) -> DataFrame:
    """(id, head, pos, ring) from (id, up), the predecessor or null; of a ring's members head is the smallest and pos null.

    The result is a stored table.
    """
    at = stored(links.select("id", "up", F.when(F.col("up").isNull(), F.col("id")).alias("head"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.least("id", "up").alias("low"), F.lit(True).alias("new")))
    while True:
        far = at.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("head").alias("head2"), F.col("dist").alias("dist2"), F.col("low").alias("low2"))
        low = F.least("low", "low2")
        # Progress: a member reached its head, or a ring's member heard of a smaller one.
        step = at.where("up is not null").join(far, "up").select("id", F.col("up2").alias("up"), F.col("head2").alias("head"), (F.col("dist") + F.col("dist2")).alias("dist"), low.alias("low"), (F.col("up2").isNull() | (low < F.col("low"))).alias("new"))
        last, at = at, stored(step.unionByName(at.where("up is null").withColumn("new", F.lit(False))))
        discard(last)
        if at.where("new").limit(1).count() == 0:
            break
    return at.select("id", F.coalesce("head", "low").alias("head"), F.when(F.col("up").isNull(), F.col("dist")).alias("pos"), F.col("up").isNotNull().alias("ring"))


def placed_chains(links: DataFrame) -> DataFrame:
    """(id, head, pos): as chains(), with rings cut before their smallest member."""
    found = chains(links)
    rings = found.where("ring").select("id", "head")
    if rings.limit(1).count() == 0:
        return found.select("id", "head", "pos")
    cut = links.join(rings, "id").select("id", F.when(F.col("id") != F.col("head"), F.col("up")).alias("up"))
    return found.where("not ring").select("id", "head", "pos").unionByName(chains(cut).select("id", "head", "pos"))


def euler_trails(edges: DataFrame) -> DataFrame:
    """(id, trail, pos): trails that together use each edge (id, src, dst) once, as few as possible; trail is the first edge's id.

    ids are unique and not null.  In- and outgoing edges of one node are ranked
    together, so a node's edges must fit a task; all else is spread by edge.
    """
    own = edges.select("id", "src", "dst")
    ins = own.select(F.col("dst").alias("node"), F.row_number().over(Window.partitionBy("dst").orderBy("id")).alias("n"), F.col("id").alias("a"))
    outs = own.select(F.col("src").alias("node"), F.row_number().over(Window.partitionBy("src").orderBy("id")).alias("n"), F.col("id").alias("b"))
    slots = stored(ins.join(outs, ["node", "n"], "full_outer"))
    label = chains(slots.where("b is not null").select(F.col("b").alias("id"), F.col("a").alias("up"))).select("id", F.col("head").alias("trail"), "ring")
    last, slots = slots, stored(slots.join(label, F.coalesce("b", "a") == F.col("id")).drop("id"))
    discard(last)
    while True:
        least = slots.groupBy("node").agg(F.min(F.struct("ring", "trail")).alias("root"))
        met = slots.where("ring").select("trail", "node").join(least, "node").where(F.col("root") < F.struct(F.lit(True), F.col("trail")))
        hooks = stored(met.groupBy("trail").agg(F.min(F.struct(F.col("root.ring").alias("ring"), F.col("root.trail").alias("trail"), "node")).alias("h")).select("trail", "h.node", F.col("h.trail").alias("root"), F.col("h.ring").alias("root_ring")))
        if hooks.limit(1).count() == 0:
            break
        # One place of each ring that hooks at a node, and one of the trail it hooks onto.
        joins = hooks.select("node", "trail", F.lit(1).alias("rank")).unionByName(hooks.select("node", F.col("root").alias("trail"), F.lit(0).alias("rank")).distinct())
        place = slots.join(joins, ["node", "trail"]).groupBy("node", "trail", "rank").agg(F.min(F.struct("n", "b")).alias("s")).select("node", "trail", "rank", "s.n", "s.b")
        around = Window.partitionBy("node").orderBy("rank", "trail")
        whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        turned = place.select("node", "n", F.coalesce(F.lead(F.struct("b")).over(around), F.first(F.struct("b")).over(whole)).alias("next"))
        names = hooks.select(F.col("trail").alias("id"), F.col("root").alias("up")).unionByName(hooks.select(F.col("root").alias("id")).distinct().join(hooks.select(F.col("trail").alias("id")), "id", "left_anti").withColumn("up", F.lit(None)))
        final = chains(names).select(F.col("id").alias("trail"), F.col("head").alias("to"))
        kind = hooks.select(F.col("root").alias("to"), "root_ring").distinct()
        renamed = final.join(kind, "to")
        step = slots.join(turned, ["node", "n"], "left").join(renamed, "trail", "left")
        step = step.select("node", "n", "a", F.when(F.col("next").isNotNull(), F.col("next.b")).otherwise(F.col("b")).alias("b"), F.coalesce("to", "trail").alias("trail"), F.coalesce("root_ring", "ring").alias("ring"))
        last, slots = slots, stored(step)
        discard(last)
        discard(hooks)
    links = slots.where("b is not null").select(F.col("b").alias("id"), F.when(~F.col("ring") | (F.col("b") != F.col("trail")), F.col("a")).alias("up"))
    return chains(links).select("id", F.col("head").alias("trail"), "pos")
