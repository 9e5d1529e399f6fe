"""Graphs as edge tables (src, dst, edge_type): routing, neighbours, reach, paths, ranks and trees.

Traversals loop on the driver over written steps; no edge list comes to the driver.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as V

#: The five graphs and the edge types that each holds.
GRAPHS = {"dependency": ("import",), "call": ("call",), "inheritance": ("inherit",), "reference": ("ref",), "containment": ("contain",)}
EDGE_WEIGHTS = {"call": 3.0, "inherit": 2.5, "import": 2.0, "ref": 1.5, "contain": 1.0}
#: A side is broadcast only if it is counted to have no more rows.
BROADCAST_ROWS = 100_000
#: The same for names of hubs, of which a graph has at most one for a hundred nodes.
BROADCAST_HUBS = 1_000_000
#: Rows of a part whose keys a task holds at once.
PART_ROWS = 500_000


def work_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or a local one where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        base = f"file://{tempfile.mkdtemp(prefix='millrace-')}" if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/graph-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df, written and read back: iterations keep a short lineage and outlive lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys in counted parts of about PART_ROWS rows: what a task holds of them doesn't grow with the table."""
    return df.repartition(max(df.count() // PART_ROWS + 1, df.sparkSession.sparkContext.defaultParallelism), *keys)


# -- building -----------------------------------------------------------------
def route_edges(edges: DataFrame) -> DataFrame:
    """graph, src, dst and the attributes of the last of parallel edges; unknown types are dropped.
    edges: src_id, dst_id, edge_type, ord. Parallel edges meet in parts of a bounded size; few are parallel, so they aren't reduced before."""
    graph = F.element_at(F.create_map(*[F.lit(x) for g, kinds in GRAPHS.items() for k in kinds for x in (k, g)]), F.col("edge_type"))
    rest = [c for c in edges.columns if c not in ("src_id", "dst_id", "ord")]
    routed = edges.withColumn("graph", graph).where("graph is not null")
    last = dealt(routed, "src_id", "dst_id").groupBy("graph", "src_id", "dst_id").agg(F.max_by(F.struct(*rest), "ord").alias("__last"))
    return last.select("graph", "src_id", "dst_id", *[F.col(f"__last.{c}").alias(c) for c in rest])


def nodes_of(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.select(F.col(src).alias("node")).union(edges.select(F.col(dst))).distinct()


def typed_nodes(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, node: elements by type, isolated ones too, and all endpoints (G02). edges: graph, src_id, dst_id."""
    kinds = {"dependency": ("file",), "inheritance": ("class",), "call": ("function", "method", "file")}
    own = [elements.where(F.col("type").isin(*k)).select(F.lit(g).alias("graph"), F.col("id").alias("node")) for g, k in kinds.items()]
    ends = [edges.select("graph", F.col(c).alias("node")) for c in ("src_id", "dst_id")]
    return reduce(DataFrame.union, own + ends).distinct()


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both edge tables as one; what the second says of an edge wins."""
    both = first.withColumn("__side", F.lit(0)).unionByName(second.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("src", "dst", "edge_type", "__side")]
    last = both.groupBy("src", "dst", "edge_type").agg(F.max_by(F.struct(F.col("__side").alias("side"), *rest), "__side").alias("__last"))
    return last.select("src", "dst", "edge_type", *[F.col(f"__last.{c}").alias(c) for c in rest]).select([c for c in both.columns if c != "__side"])


# -- neighbours and reach ---------------------------------------------------------
def successors(edges: DataFrame, node: str) -> DataFrame:
    """What a node points to: dependencies, superclasses or callees, by the graph."""
    return edges.where(F.col("src") == node).select(F.col("dst").alias("node")).distinct()


def predecessors(edges: DataFrame, node: str) -> DataFrame:
    """What points to a node: dependents, subclasses or callers."""
    return edges.where(F.col("dst") == node).select(F.col("src").alias("node")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    return both_ways(edges).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse in one pass over the edges, repeats included."""
    return edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst")


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= most else df


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """seed, node, distance of what lies at most so many hops along the edges, the seed itself at 0.
    seeds: seed. Each hop's new pairs are written; while they are few, a hop reads the edges without a shuffle."""
    folder = work_folder(edges.sparkSession)
    found = frontier = written(seeds.select("seed", F.col("seed").alias("node")).distinct().withColumn("distance", F.lit(0)), f"{folder}/0")
    links = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    for hop in range(1, hops + 1):
        step = links.join(few(frontier), "node").select("seed", F.col("next").alias("node")).distinct()
        frontier = written(step.join(found, ["seed", "node"], "left_anti").withColumn("distance", F.lit(hop)), f"{folder}/{hop}")
        found = found.union(frontier)
    return found.select("seed", "node", "distance")


def related(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """Nodes within so many hops forwards or backwards, in each graph by itself, seeds included.
    edges: graph, src, dst."""
    parts = []
    for graph in ("dependency", "inheritance", "call"):
        own = edges.where(F.col("graph") == graph)
        parts += [reach(own, seeds, hops), reach(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds, hops)]
    return reduce(DataFrame.union, parts).groupBy("seed", "node").agg(F.min("distance").alias("distance"))


def related_undirected(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """Nodes within so many hops over all graphs, either way, without the seeds."""
    return reach(both_ways(edges), seeds, hops).where("node <> seed")


def related_with_fallback(facts: DataFrame, legacy: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """The first graph's neighbours; the second's for seeds that have none there."""
    found = related_undirected(facts, seeds, hops)
    rest = seeds.join(found.select("seed").distinct(), "seed", "left_anti")
    return found.unionByName(related_undirected(legacy, rest, hops))


def expand(rows: DataFrame, neighbours: DataFrame, elements: DataFrame, weight: float = 0.1, best: int = 10) -> DataFrame:
    """Rows and the neighbours of the ten best, at half the parent's score times the weight (G06). Of several
    parents the best counts; elements that are there already stay as they are. neighbours: seed, node."""
    parents = rows.orderBy(F.desc("total_score"), "id").limit(best).select(F.col("id").alias("seed"), F.col("name").alias("related_to"), F.col("total_score").alias("__parent"))
    near = neighbours.join(F.broadcast(parents), "seed").groupBy(F.col("node").alias("id")).agg(F.max(F.struct("__parent", "seed", "related_to")).alias("p"))
    new = elements.join(near, "id").join(rows.select("id"), "id", "left_anti").withColumn("graph_score", F.col("p.__parent") * 0.5 * weight)
    new = new.withColumn("total_score", F.col("graph_score")).withColumn("related_to", F.col("p.related_to")).drop("p")
    for name in ("semantic_score", "keyword_score", "pseudocode_score"):
        new = new.withColumn(name, F.lit(0.0))
    return rows.unionByName(new, allowMissingColumns=True)


def shortest_path(edges: DataFrame, source, target, most: int | None = None) -> DataFrame:
    """path, hops of the shortest path, the smallest of equal ones; no row without one (G08). The search goes on until it
    meets the target or finds nothing new (most: a bound on the hops, if wanted). Each level is written and keeps one
    path per node that is new, so that it never outgrows the nodes."""
    spark = edges.sparkSession
    folder, kind = work_folder(spark), edges.schema["src"].dataType
    links, hop = edges.select("src", "dst"), 0
    level = written(spark.range(1).select(F.lit(source).cast(kind).alias("node"), F.array(F.lit(source).cast(kind)).alias("path")), f"{folder}/0")
    seen = level.select("node")
    while True:
        hit = level.where(F.col("node") == F.lit(target))
        if not hit.isEmpty() or hop == most or level.isEmpty():
            return hit.select("path", (F.size("path") - 1).alias("hops"))
        hop += 1
        step = links.join(few(level), links["src"] == level["node"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        level = written(step.join(seen, "node", "left_anti"), f"{folder}/{hop}")
        seen = written(seen.union(level.select("node")), f"{folder}/seen-{hop}") if hop % 8 == 0 else seen.union(level.select("node"))


def call_chain(edges: DataFrame, seed, hops: int = 2, direction: str = "callees") -> DataFrame:
    """node, depth, parent of what a call leads to (or comes from), each node once at its least depth."""
    links = edges.select("src", "dst") if direction == "callees" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    kind, folder = edges.schema["src"].dataType, work_folder(edges.sparkSession)
    seed = edges.sparkSession.range(1).select(F.lit(seed).cast(kind).alias("node"), F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent"))
    out = level = written(seed, f"{folder}/0")
    for depth in range(1, min(hops, 5) + 1):
        found = few(level).join(links, level["node"] == links["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent")).select("node", F.lit(depth).alias("depth"), "parent")
        level = written(found.join(out.select("node"), "node", "left_anti"), f"{folder}/{depth}")
        out = out.union(level)
    return out


# -- measures -----------------------------------------------------------------------
def graph_stats(edges: DataFrame) -> DataFrame:
    """graph, nodes, edges (A10). edges: graph, src, dst. Each end of a distinct edge counts the edges that it begins, so that
    only nodes are shuffled for the sums."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.when(F.col("dst").isNotNull(), 1).otherwise(0).alias("begun")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("begun")))
    nodes = edges.select("graph", "src", "dst").distinct().select("graph", F.explode(ends).alias("x")).groupBy("graph", "x.node").agg(F.sum("x.begun").alias("begun"))
    return nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("nodes"), F.sum("begun").alias("edges"))


def average_degree(edges: DataFrame) -> DataFrame:
    """nodes, edges and 2E / N."""
    nodes = nodes_of(edges).agg(F.count(F.lit(1)).alias("nodes"))
    return nodes.crossJoin(edges.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("edges"))).withColumn("avg_degree", F.when(F.col("nodes") > 0, 2 * F.col("edges") / F.col("nodes")).otherwise(0.0))


def is_acyclic(edges: DataFrame) -> bool:
    """Whether peeling nodes without incoming edges, again and again, leaves none."""
    folder = work_folder(edges.sparkSession)
    left = written(edges.select("src", "dst").distinct(), f"{folder}/0")
    count, i = left.count(), 0
    while count:
        i += 1
        left = written(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), f"{folder}/{i}")
        before, count = count, left.count()
        if before == count:
            return False
    return True


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: distinct neighbours. Pairs are made distinct once, not once from each end, and only sums of nodes are shuffled then."""
    turned = F.coalesce(F.col("src") > F.col("dst"), F.isnull("dst"))
    pairs = edges.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("b")).distinct()
    ends = F.when(F.equal_null("a", "b"), F.array("a")).otherwise(F.array("a", "b"))
    return pairs.select(F.explode(ends).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def weight_of(edge_type: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in EDGE_WEIGHTS.items() for x in kv]), edge_type), F.lit(1.0))


def weighted_graph(edges: DataFrame, nodes: DataFrame | None = None, fallback: DataFrame | None = None) -> DataFrame:
    """a < b, weight, edge_types of an undirected graph: the sum over its edges, by type (A12). Edges whose ends
    aren't both nodes are dropped, where nodes are given; if none is left, the fallback edges (src, dst) count 1 each."""
    own = edges
    if nodes is not None:
        known = nodes.select("node")
        own = edges.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    a, b = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    out = own.groupBy(a, b).agg(F.sum(weight_of(F.col("edge_type"))).alias("weight"), F.array_sort(F.collect_set("edge_type")).alias("edge_types"))
    if fallback is None:
        return out
    spare = fallback.select(a, b, F.lit(1.0).alias("weight"), F.array(F.lit("contain")).alias("edge_types"))
    return out.unionByName(spare.join(out.limit(1).select(F.lit(1).alias("__some")), how="left_anti"))


def damp_hubs(graph: DataFrame, least: int = 30) -> DataFrame:
    """Edges of nodes whose degree exceeds the 99th percentile (nearest rank below, 30 at least) weigh 0.5 at most.
    The graph is written once and, unless it is counted to have very many hubs, not shuffled again for them."""
    folder = work_folder(graph.sparkSession)
    graph = written(graph, f"{folder}/graph")
    degree = graph.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    ranked = degree.groupBy("degree").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("degree"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    at = F.floor(F.lit(0.99) * (F.col("all") - 1)) + 1
    limit = ranked.where(F.col("upto") >= at).agg(F.greatest(F.min("degree"), F.lit(least)).alias("limit"), F.max("all").alias("nodes"))
    hubs = degree.crossJoin(F.broadcast(limit)).where("degree > limit and nodes >= 20").select("node")
    hubs = few(written(hubs, f"{folder}/hubs"), BROADCAST_HUBS)
    rest = [c for c in graph.columns if c not in ("a", "b", "weight")]
    touched = graph.join(hubs.withColumnRenamed("node", "a").withColumn("ha", F.lit(True)), "a", "left").join(hubs.withColumnRenamed("node", "b").withColumn("hb", F.lit(True)), "b", "left")
    hub = F.coalesce("ha", "hb", F.lit(False))
    return touched.select("a", "b", F.when(hub, F.least("weight", F.lit(0.5))).otherwise(F.col("weight")).alias("weight"), *rest, hub.alias("compressed_by_hub"))


def query_terminals(nodes: DataFrame, degree: DataFrame, query: str, most: int = 12) -> DataFrame:
    """node, score: words of the query in the node's title, path or kind, plus log1p of its degree."""
    import re

    words = list(dict.fromkeys(w for w in re.findall("[a-zA-Z0-9_]+", query.lower()) if len(w) > 1))
    text = F.lower(F.concat_ws(" ", "title", "path", "symbol_kind"))
    hits = reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words], F.lit(0))
    scored = nodes.join(degree, "node", "left").withColumn("hits", hits).where("hits > 0")
    return scored.select("node", (F.col("hits") + F.log1p(F.coalesce("degree", F.lit(0)))).alias("score")).orderBy(F.desc("score"), F.desc("node")).limit(most)


def pagerank(graph: DataFrame, alpha: float = 0.85, rounds: int = 20) -> DataFrame:
    """node, rank after a fixed number of rounds over a weighted undirected graph (a, b, weight).
    Mass of nodes without edges is dealt to all. Every few rounds are written, so the lineage stays short."""
    folder = work_folder(graph.sparkSession)
    both = graph.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").union(graph.select("b", "a", "weight"))
    strength = both.groupBy("src").agg(F.sum("weight").alias("out"))
    links = written(both.join(strength, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")), f"{folder}/links")
    nodes = written(links.select(F.col("src").alias("node")).distinct(), f"{folder}/nodes")
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(rounds):
        given = links.join(ranks, links["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        ranks = nodes.join(given, nodes["node"] == given["dst"], "left").select("node", (F.lit((1 - alpha) / max(n, 1)) + alpha * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % 5 == 4:
            ranks = written(ranks, f"{folder}/{i}")
    return ranks


def pagerank_to(graph: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6, chained: int = 4) -> DataFrame:
    """node, rank of a weighted undirected graph (a, b, weight), the mean of all errors at most the tolerance.

    Ranks start in proportion to the nodes' strength, which is what they are without jumps, so the first residual is known
    at once. Then only nodes whose residual is above their share of the tolerance pass it on, until none is left. A few
    rounds are chained before the step is written.
    """
    folder = work_folder(graph.sparkSession)
    ends = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    both = graph.where("weight > 0").select(F.explode(ends).alias("e"), "weight").select("e.*", "weight")
    strength = both.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("strength"))
    nodes = written(strength, f"{folder}/nodes")
    n, total = nodes.agg(F.count(F.lit(1)), F.sum("strength")).first()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    links = written(both.join(nodes.withColumnRenamed("node", "src"), "src").select("src", "dst", (F.col("weight") / F.col("strength")).alias("share")), f"{folder}/links")
    start = F.col("strength") / total
    state = nodes.select("node", start.alias("rank"), ((1 - alpha) * (1.0 / n - start)).alias("residual"))
    least, turn = tolerance * (1 - alpha), 0
    while True:
        turn += 1
        for _ in range(chained):
            moving = F.abs("residual") > least
            got = links.join(state.where(moving).select(F.col("node").alias("src"), "residual"), "src").groupBy(F.col("dst").alias("node")).agg((alpha * F.sum(F.col("residual") * F.col("share"))).alias("got"))
            after = F.when(moving, 0.0).otherwise(F.col("residual")) + F.coalesce("got", F.lit(0.0))
            state = state.join(got, "node", "left").select("node", (F.col("rank") + F.when(moving, F.col("residual")).otherwise(0.0)).alias("rank"), after.alias("residual"))
        state = written(state, f"{folder}/{turn}")
        if state.where(F.abs("residual") > least).isEmpty():
            return state.select("node", (F.col("rank") + F.col("residual")).alias("rank"))


def connected(graph: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component: the smallest node reachable; each step takes the smallest label around and jumps along it.
    Steps shuffle both sides: a label table that is sent to all tasks passes through the driver at each of them."""
    folder = work_folder(graph.sparkSession)
    both = written(graph.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(graph.select("b", "a")), f"{folder}/edges")
    labels = written(both.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")), f"{folder}/start")
    for i in range(rounds):
        near = both.join(labels.hint("shuffle_hash"), both["dst"] == labels["node"]).groupBy("src").agg(F.min("component").alias("near"))
        step = labels.join(near.hint("shuffle_hash"), labels["node"] == near["src"]).select("node", F.least("component", "near").alias("component"))
        # pointer jumping: a label takes its own label
        own = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = written(step.join(own.hint("shuffle_hash"), "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component")), f"{folder}/{i}")
        changed = not new.join(labels.hint("shuffle_hash"), ["node", "component"], "left_anti").isEmpty()
        labels = new
        if not changed:
            return labels
    raise RuntimeError(f"components need more than {rounds} rounds")


def representatives(labels: DataFrame, ranks: DataFrame, degree: DataFrame) -> DataFrame:
    """cluster, node: the best of a cluster by (rank, degree), then the smaller node."""
    order = Window.partitionBy("cluster").orderBy(F.desc("rank"), F.desc("degree"), "node")
    x = labels.join(ranks, "node", "left").join(degree, "node", "left")
    return x.withColumn("r", F.row_number().over(order)).where("r = 1").select("cluster", "node", "rank", "degree")


def cluster_graph(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """ca < cb, weight, confidence between clusters."""
    x = graph.join(labels.select(F.col("node").alias("a"), F.col("cluster").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("cluster").alias("y")), "b").where("x <> y")
    return x.groupBy(F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb")).agg(F.sum("weight").alias("weight")).withColumn("confidence", V.xref_confidence(F.col("weight")))


def spanning_forest(links: DataFrame) -> DataFrame:
    """ca, cb of a maximum spanning forest of links (ca < cb, weight), ties by the ends as texts. In each round every
    component takes its best link to another one, so that rounds are no more than the logarithm of the nodes."""
    spark, folder = links.sparkSession, work_folder(links.sparkSession)
    order = F.struct((-F.col("weight")).alias("w"), F.col("ca").cast("string").alias("a"), F.col("cb").cast("string").alias("b"), "ca", "cb")
    open_links = written(links.select("ca", "cb", order.alias("o"), F.col("ca").alias("la"), F.col("cb").alias("lb")), f"{folder}/0")
    tree, i = spark.createDataFrame([], open_links.select("ca", "cb").schema), 0
    while not open_links.isEmpty():
        i += 1
        ends = open_links.select(F.explode(F.array(F.struct(F.col("la").alias("own"), F.col("lb").alias("other")), F.struct(F.col("lb").alias("own"), F.col("la").alias("other")))).alias("e"), "o")
        best = written(ends.groupBy("e.own").agg(F.min(F.struct("o", "e.other")).alias("m")).select("own", "m.other", "m.o.ca", "m.o.cb"), f"{folder}/best-{i}")
        tree = written(tree.union(best.select("ca", "cb")).distinct(), f"{folder}/tree-{i}")
        parts = connected(best.select(F.col("own").alias("a"), F.col("other").alias("b")))
        for end in ("la", "lb"):
            to = parts.select(F.col("node").alias(end), F.col("component").alias("__to"))
            open_links = open_links.join(to, end, "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
        open_links = written(open_links.where("la <> lb").select("ca", "cb", "o", "la", "lb"), f"{folder}/{i}")
    return tree


def backbone(clusters: DataFrame, links: DataFrame) -> DataFrame:
    """parent, child of a maximum spanning tree over the clusters (cluster, size), from the largest one; each part that
    has no link to it is a tree from its own largest (G14). Levels are written; nothing comes to the driver."""
    spark, folder = clusters.sparkSession, work_folder(clusters.sparkSession)
    known = clusters.select("cluster")
    own = links.select("ca", "cb", "weight").join(known.withColumnRenamed("cluster", "ca"), "ca", "left_semi").join(known.withColumnRenamed("cluster", "cb"), "cb", "left_semi")
    tree = spanning_forest(own)
    both = written(both_ways(tree.select(F.col("ca").alias("src"), F.col("cb").alias("dst"))), f"{folder}/tree")
    parts = connected(tree.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    sized = parts.join(clusters.select(F.col("cluster").alias("node"), "size"), "node")
    level = written(sized.groupBy("component").agg(F.min(F.struct((-F.col("size")).alias("s"), "node"))["node"].alias("node")).select("node"), f"{folder}/0")
    kind = clusters.schema["cluster"].dataType.simpleString()
    seen, out, i = level, spark.createDataFrame([], f"parent {kind}, child {kind}"), 0
    while not level.isEmpty():
        i += 1
        step = both.join(few(level), both["src"] == level["node"]).select(F.col("src").alias("parent"), F.col("dst").alias("node"))
        step = written(step.join(seen, "node", "left_anti").select("parent", F.col("node").alias("child")), f"{folder}/{i}")
        out, level = out.union(step), step.select(F.col("child").alias("node"))
        seen = seen.union(level)
        if i % 8 == 0:  # the plan stays short on long chains
            out, seen = written(out, f"{folder}/out-{i}"), written(seen, f"{folder}/seen-{i}")
    return out


def ego(edges: DataFrame, node, hops: int = 1) -> DataFrame:
    """The nodes of a neighbourhood, the centre among them."""
    seed = edges.sparkSession.range(1).select(F.lit(node).cast(edges.schema["src"].dataType).alias("seed"))
    return reach(both_ways(edges), seed, hops).select("node")
