"""Scopes of a query: the cheapest tree that joins its terminals, within a factor of two, and what lies around.

Every node gets its nearest terminal by a shortest path search from all terminals at once; links whose ends
belong to different terminals bridge them at the cost of both paths and the link. The minimum spanning tree over
the terminals' cheapest bridges, read back to paths by each node's parent, is the tree. Its
cost is at most twice the least possible; in each part of the graph that holds terminals, they form a tree of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import few, reach, spanning_forest, work_folder, written


def distances(graph: DataFrame) -> DataFrame:
    """src, dst, length both ways: 1 / max(0.1, weight)."""
    one = graph.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg((1 / F.greatest(F.lit(0.1), F.max("weight"))).alias("length"))
    ends = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "length"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "length"))
    return one.select(F.explode(ends).alias("e")).select("e.*")


def nearest_terminals(links: DataFrame, terminals: DataFrame, most: float | None = None) -> DataFrame:
    """node, distance, terminal, parent of every node that a terminal reaches over links (src, dst, length), by distance,
    then the smaller terminal and parent (most: no farther than this). Only nodes that a round made nearer pass it on; rounds are
    as many as the longest shortest path has links, each written."""
    folder = work_folder(links.sparkSession)
    kind = links.schema["src"].dataType
    start = terminals.select(F.col("node").cast(kind).alias("node")).distinct()
    known = frontier = written(start.select("node", F.lit(0.0).alias("distance"), F.col("node").alias("terminal"), F.lit(None).cast(kind).alias("parent")), f"{folder}/0")
    turn = 0
    while not frontier.isEmpty():
        turn += 1
        step = links.join(few(frontier.withColumnRenamed("node", "src").drop("parent")), "src")
        step = step.select(F.col("dst").alias("node"), (F.col("distance") + F.col("length")).alias("distance"), "terminal", F.col("src").alias("parent"))
        step = step if most is None else step.where(F.col("distance") <= most)
        best = step.groupBy("node").agg(F.min(F.struct("distance", "terminal", "parent")).alias("n"))
        both = known.withColumn("o", F.struct("distance", "terminal", "parent")).select("node", "o").join(best, "node", "full_outer")
        nearer = F.col("o").isNull() | (F.col("n.distance") < F.col("o.distance")) | ((F.col("n.distance") == F.col("o.distance")) & (F.col("n.terminal") < F.col("o.terminal")))
        after = written(both.select("node", F.coalesce(F.when(F.col("n").isNotNull() & nearer, F.col("n")), F.col("o")).alias("x"), (F.col("n").isNotNull() & nearer).alias("new")).select("node", "x.*", "new"), f"{folder}/{turn}")
        known, frontier = after.drop("new"), after.where("new").drop("new")
    return known


def steiner_tree(graph: DataFrame, terminals: DataFrame) -> DataFrame:
    """a < b, length: the links of a tree over graph (a, b, weight) that joins terminals (node)."""
    spark, folder = graph.sparkSession, work_folder(graph.sparkSession)
    links = written(distances(graph), f"{folder}/links")
    near = nearest_terminals(links, terminals)
    side = lambda end, t, d: near.select(F.col("node").alias(end), F.col("terminal").alias(t), F.col("distance").alias(d))
    across = links.where("src < dst").join(side("src", "s", "ds"), "src").join(side("dst", "t", "dt"), "dst").where("s <> t")
    cost = F.struct((F.col("ds") + F.col("length") + F.col("dt")).alias("cost"), "src", "dst", "length")
    bridges = written(across.groupBy(F.least("s", "t").alias("ca"), F.greatest("s", "t").alias("cb")).agg(F.min(cost).alias("x")).select("ca", "cb", "x.*"), f"{folder}/bridges")
    joined = spanning_forest(bridges.select("ca", "cb", (-F.col("cost")).alias("weight")))
    kept = bridges.join(joined, ["ca", "cb"]).select("src", "dst", "length")
    tree = written(kept.select(F.col("src").alias("a"), F.col("dst").alias("b"), "length"), f"{folder}/tree-0")
    up = near.where("parent is not null").select("node", "parent")
    at = written(tree.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"{folder}/at-0")
    seen, turn = at, 0
    while not at.isEmpty():
        turn += 1
        step = written(up.join(few(at), "node"), f"{folder}/up-{turn}")
        priced = step.join(links, (F.col("node") == F.col("src")) & (F.col("parent") == F.col("dst"))).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "length")
        tree = written(tree.union(priced), f"{folder}/tree-{turn}")
        at = written(step.select(F.col("parent").alias("node")).distinct().join(seen, "node", "left_anti"), f"{folder}/at-{turn}")
        seen = written(seen.union(at), f"{folder}/seen-{turn}")
    return tree.distinct()


def query_scope(graph: DataFrame, terminals: list, alone: int = 2, around: int = 1) -> DataFrame:
    """node: what a query covers of a graph (a, b, weight). One terminal: what lies within `alone` hops of it; several: their
    tree, and what lies within `around` hops of each; none: nothing."""
    kind = graph.schema["a"].dataType.simpleString()
    seeds = graph.sparkSession.createDataFrame([(t,) for t in terminals], f"node {kind}")
    both = graph.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")
    near = reach(both, seeds.withColumnRenamed("node", "seed"), alone if len(terminals) == 1 else around).select("node")
    if len(terminals) < 2:
        return near.distinct()
    tree = steiner_tree(graph, seeds)
    return near.union(tree.select(F.explode(F.array("a", "b")))).distinct()
