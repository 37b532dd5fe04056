"""Closures over reference edges: walks, impacts, cycles, chains. Each step joins the frontier with the edges once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismet.session import written


def inner_edges(pairs: DataFrame) -> DataFrame:
    """Edges (src, dst) that lead on: their dst has edges of its own. The others, most of them as a rule, end a walk wherever it is."""
    return pairs.join(pairs.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def reached(seeds: DataFrame, pairs: DataFrame) -> DataFrame:
    """(origin, node, depth): seeds and what is reachable from them along inner edges, breadth first, each at its least depth."""
    steps = written(inner_edges(pairs))
    frontier = written(seeds.select("origin", "node").distinct().withColumn("depth", F.lit(0)))
    visited, parts, depth = frontier, 1, 0
    while True:
        depth += 1
        nxt = frontier.join(steps, frontier["node"] == steps["src"]).select("origin", F.col("dst").alias("node")).distinct()
        frontier = written(nxt.join(visited, ["origin", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.take(1):
            return visited
        visited, parts = visited.union(frontier), parts + 1
        if parts == 8:  # what is visited is read each round: keep it in few tables
            visited, parts = written(visited), 1


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(origin, node, depth): all that is reachable from each seed along src -> dst [G1-G4]; cycles end at visited nodes.

    ``seeds`` has origin and node. Breadth first: a node keeps its least depth. It ends when nothing new is reached, however
    long the longest way is. Rounds see edges that lead on; all edges are passed once, at the end.
    """
    pairs = edges.select("src", "dst")
    inside = reached(seeds, pairs)
    last = inside.join(pairs, inside["node"] == pairs["src"]).select("origin", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"))
    return inside.union(last).groupBy("origin", "node").agg(F.min("depth").alias("depth"))


def impact(corrections: DataFrame, references: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Records that depend on each correction's targets [G2, G3]; references point from a record to what it uses."""
    reverse = references.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    out = closure(corrections.select(F.col("correction").alias("origin"), F.col("target").alias("node")), reverse)
    return out.where(F.split("node", ":")[0].isin(*kinds)) if kinds else out


def result_effects(reached: DataFrame, results: DataFrame) -> DataFrame:
    """Invalidated, restricted and preserved results of each correction [G3]; what it does not reach is counted, not listed."""
    hit = reached.select(F.col("origin").alias("correction"), "node").distinct().join(results.select("node", "strength"), "node", "left")
    yes = lambda c: F.sum(F.when(c, 1).otherwise(0))
    known = F.col("strength").isNotNull()
    counts = hit.groupBy("correction").agg(yes(known & (F.col("strength") == "essential")).alias("invalidated"), yes(known & (F.col("strength") != "essential")).alias("restricted"))
    total = results.agg(F.count(F.lit(1)).alias("_all"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("correction", "invalidated", "restricted", (F.col("_all") - F.col("invalidated") - F.col("restricted")).alias("preserved"))


def cyclic_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes on a cycle or behind one [G5, G7]: those left when nodes without remaining parents are peeled off, until none is."""
    left = written(nodes.select("node").distinct())
    edges = written(edges.select("src", "dst").distinct())
    n = left.count()
    while True:
        held = edges.join(left.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        left = written(left.join(held, "node", "left_semi"))
        m = left.count()
        if m in (0, n):
            return left
        n = m


def successors(records: DataFrame) -> DataFrame:
    """State of each revision [G8]: superseded by one, by several, by one of another sample, or current."""
    nxt = records.where(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("id"), F.col("id").alias("_next"), F.col("sample_id").alias("_s"))
    out = records.join(nxt, "id", "left").groupBy("id", "sample_id").agg(F.count("_next").alias("_n"), F.bool_or(F.col("_s") != F.col("sample_id")).alias("_cross"))
    return out.select("id", "sample_id", F.when(F.col("_cross"), "cross_sample_supersession").when(F.col("_n") > 0, "selected_revision_superseded").otherwise("current").alias("state"))


def composite_chain(members: DataFrame) -> DataFrame:
    """Whether the ordered members of a composite join end to start [G6, G9]."""
    w = Window.partitionBy("composite").orderBy("place")
    ok = F.col("start").eqNullSafe(F.lag("end").over(w)) | (F.row_number().over(w) == 1)
    return members.withColumn("_ok", ok).groupBy("composite").agg(F.bool_and("_ok").alias("connected"), F.count(F.lit(1)).alias("members"))
