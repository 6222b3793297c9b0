"""Connected components of a large edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.names import lookup
from cohortlens.workspace import Workspace

#: Neighbours of one node that a task takes; those of a larger hub are dealt to several.
HUB = 20_000
#: Tables of nodes up to so many rows are broadcast.
SMALL = 100_000


def _toward_minimum(edges: DataFrame, both_ways: bool, ws: Workspace, name: str) -> DataFrame:
    """Point a node's neighbours (all of them, or only the smaller ones) at the smallest.
    Minima are taken before and after the shuffle, so a hub's neighbours never meet; they
    learn its minimum by a broadcast, or in parts of HUB neighbours."""
    out = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    if both_ways:
        out = out.union(edges.select("v", "u"))
    least = out.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    least = ws.table(least.select("a", F.least("a", "m").alias("m"), F.ceil(F.col("n") / HUB).alias("parts")), name)
    if least.count() <= SMALL:
        moved = out.join(F.broadcast(least), "a")
    else:
        hubs = least.where("parts > 1").select(F.col("a").alias("hub"), "parts")
        dealt = lookup(out, "a", hubs, "hub", hubs.count() <= SMALL, "left")
        dealt = dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1).cast("long"))).alias("part"))
        moved = dealt.join(least.select("a", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")), ["a", "part"])
    if both_ways:
        return moved.where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    return moved.select(F.col("b").alias("u"), F.col("m").alias("v")).union(least.select("a", "m")).where("u != v")


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """``(node, component)`` for every node of an edge table ``(u, v)``, the component
    being its smallest node. Loops and repeated edges are ignored; no edges give an empty
    table. Each contraction is a written table, so the plan stays short; it is the last
    once every node points at one other, which points nowhere."""
    now = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, step = ws.table(now, f"{name}-0"), 0
    while True:
        step += 1
        large = ws.table(_toward_minimum(now, True, ws, f"{name}-{step}-large-least").distinct(), f"{name}-{step}-large")
        ws.drop(f"{name}-{step - 1}")
        now = ws.table(_toward_minimum(large, False, ws, f"{name}-{step}-least").distinct(), f"{name}-{step}")
        for done in ("large-least", "large", "least"):
            ws.drop(f"{name}-{step}-{done}")
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.where("up > 1 OR up = 1 AND down = 1").head(1):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
