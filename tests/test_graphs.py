"""Communities against a greedy method by modularity, and scopes against the cheapest trees of small graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import communities as C
from millrace.operators import graph as G
from millrace.operators import steiner


def quality(edges, label):
    m2 = 2 * sum(w for _, _, w in edges)
    inside = sum(2 * w for a, b, w in edges if label[a] == label[b])
    total = {}
    for a, b, w in edges:
        for x in (a, b):
            total[label[x]] = total.get(label[x], 0) + w
    return inside / m2 - sum(t * t for t in total.values()) / m2**2


def greedy(edges):
    """Merges the two communities that gain most, until none gains."""
    m2 = 2 * sum(w for _, _, w in edges)
    between, total, label = {}, {}, {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            between.setdefault(x, {})[y] = between.get(x, {}).get(y, 0) + w
            total[x] = total.get(x, 0) + w
            label[x] = {x}
    while True:
        gain, x, y = max(((w - total[x] * total[y] / m2, x, y) for x, ys in between.items() for y, w in ys.items()), default=(0, 0, 0))
        if gain <= 1e-12:
            return {n: c for c, ns in label.items() for n in ns}
        for z, w in between.pop(y).items():
            between[z].pop(y)
            if z != x:
                between[x][z] = between[z][x] = between[x].get(z, 0) + w
        total[x] += total.pop(y)
        label[x] |= label.pop(y)


def blocks(rnd, sizes, inside, outside):
    of = [i for i, n in enumerate(sizes) for _ in range(n)]
    return [(a, b, 1.0) for a, b in itertools.combinations(range(len(of)), 2) if rnd.random() < (inside if of[a] == of[b] else outside)]


def preferential(rnd, n, k):
    ends, edges = [0], set()
    for i in range(1, n):
        for j in {rnd.choice(ends) for _ in range(k)}:
            edges.add((j, i, rnd.choice((1.0, 2.0, 3.0))))
            ends += [i, j]
    return sorted(edges)


GRAPHS = {
    "path": [(i, i + 1, 1.0) for i in range(40)],
    "star": [(0, i, 1.0) for i in range(1, 60)] + [(100, i, 1.0) for i in range(101, 140)] + [(0, 100, 1.0)],
    "ring of cliques": [(6 * c + a, 6 * c + b, 1.0) for c in range(12) for a, b in itertools.combinations(range(6), 2)] + [(6 * c, (6 * c + 9) % 72, 1.0) for c in range(12)],
    "blocks": blocks(random.Random(1), (30, 20, 25, 10), 0.35, 0.02),
    "preferential": preferential(random.Random(3), 150, 2),
}


def connected_in(edges, nodes):
    around = {}
    for a, b, _ in edges:
        if a in nodes and b in nodes:
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)
    seen, todo = set(), [min(nodes)]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += around.get(x, ())
    return seen == nodes


@pytest.mark.parametrize("name, local_links", [*((name, 200_000) for name in GRAPHS), ("star", 0), ("ring of cliques", 40)])
def test_communities(spark, name, local_links):
    """By one task, by joins alone, and by joins until few links are left."""
    edges = GRAPHS[name]
    graph = spark.createDataFrame(edges, "a int, b int, weight double")
    found = C.communities(graph, local_links=local_links)
    label = {r.node: r.cluster for r in found.collect()}
    assert set(label) == {x for a, b, _ in edges for x in (a, b)}
    members = {}
    for n, c in label.items():
        members.setdefault(c, set()).add(n)
    assert all(c == min(ns) and connected_in(edges, ns) for c, ns in members.items())
    assert quality(edges, label) >= 0.95 * quality(edges, greedy(edges))
    assert C.modularity(graph, found).first().modularity == pytest.approx(quality(edges, label))


def test_moving_one_node_at_a_time():
    rnd = random.Random(8)
    for _ in range(6):
        edges = blocks(rnd, [rnd.randrange(3, 25) for _ in range(6)], 0.4, 0.03) + [(i, i + 1, 0.5) for i in range(20)]
        edges = [(a, b, w) for (a, b), w in {(a, b): w for a, b, w in edges}.items()]
        label = C.optimise([x for a, b, w in edges for x in ((a, b, w), (b, a, w))], {})
        assert quality(edges, label) >= 0.97 * quality(edges, greedy(edges))


def test_communities_of_nothing(spark):
    none = spark.createDataFrame([(1, 1, 1.0), (2, 3, 0.0)], "a int, b int, weight double")
    assert C.communities(none).count() == 0 and C.modularity(none.where("false"), C.communities(none)).first().modularity is None


def cheapest(edges, terminals):
    """The least cost of a connected set of links over the terminals: spanning trees of all sets of nodes that hold them."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    rest, best = [n for n in nodes if n not in terminals], float("inf")
    for k in range(len(rest) + 1):
        for more in itertools.combinations(rest, k):
            own, parent, cost, joined = {*terminals, *more}, {}, 0.0, 0
            parent = {n: n for n in own}

            def root(x, parent=parent):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b, length in sorted((e for e in edges if e[0] in own and e[1] in own), key=lambda e: e[2]):
                if root(a) != root(b):
                    parent[root(a)] = root(b)
                    cost, joined = cost + length, joined + 1
            if joined == len(own) - 1:
                best = min(best, cost)
    return best


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_steiner_tree(spark, seed):
    rnd = random.Random(seed)
    weights = {(a, b): rnd.choice((0.0, 0.5, 1.0, 2.0, 3.0)) for a, b in itertools.combinations(range(9), 2) if b == a + 1 or rnd.random() < 0.25}
    terminals = rnd.sample(range(9), 4)
    graph = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "a int, b int, weight double")
    tree = [(r.a, r.b, r.length) for r in steiner.steiner_tree(graph, spark.createDataFrame([(t,) for t in terminals], "node int")).collect()]
    nodes = {x for a, b, _ in tree for x in (a, b)}
    assert set(terminals) <= nodes and len(tree) == len(nodes) - 1 and connected_in(tree, nodes)
    assert all(length == pytest.approx(1 / max(0.1, weights[(a, b)])) for a, b, length in tree)
    ends = [a for a, b, _ in tree] + [b for a, b, _ in tree]
    assert all(x in terminals for x in nodes if ends.count(x) == 1)
    least = cheapest([(a, b, 1 / max(0.1, w)) for (a, b), w in weights.items()], terminals)
    assert least - 1e-9 <= sum(e[2] for e in tree) <= 2 * least + 1e-9


def test_scope(spark):
    line = [(i, i + 1, 1.0) for i in range(12)] + [(20, 21, 1.0)]
    graph = spark.createDataFrame(line, "a int, b int, weight double")
    nodes = lambda *t: {r.node for r in steiner.query_scope(graph, list(t)).collect()}
    assert nodes() == set() and nodes(5) == {3, 4, 5, 6, 7}
    assert nodes(3, 6) == {2, 3, 4, 5, 6, 7}
    assert nodes(3, 6, 20) == {2, 3, 4, 5, 6, 7, 20, 21}
    far = steiner.nearest_terminals(steiner.distances(graph), spark.createDataFrame([(0,), (10,)], "node int"))
    assert {r.node: (r.distance, r.terminal) for r in far.where(F.col("node").isin(5, 6, 12)).collect()} == {5: (5.0, 0), 6: (4.0, 10), 12: (2.0, 10)}


def test_pagerank_to_a_tolerance(spark):
    edges = preferential(random.Random(9), 80, 2) + [(200, 201, 1.0)]
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    around = {n: {} for n in nodes}
    for a, b, w in edges:
        around[a][b] = around[b][a] = w
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(300):
        rank = {n: 0.15 / len(nodes) + 0.85 * sum(rank[o] * w / sum(around[o].values()) for o, w in around[n].items()) for n in nodes}
    got = {r.node: r.rank for r in G.pagerank_to(spark.createDataFrame(edges, "a int, b int, weight double"), tolerance=1e-8).collect()}
    assert set(got) == set(nodes) and sum(abs(got[n] - rank[n]) for n in nodes) <= 1e-8 * len(nodes)
    assert G.pagerank_to(spark.createDataFrame([], "a int, b int, weight double")).count() == 0


def test_rounds_send_no_table_through_the_driver(spark, monkeypatch):
    """All joins of the rounds, of the split and of the contraction shuffle both sides, however small; a community of texts
    has the name of its smallest node."""
    from millrace.operators import communities, graph

    seen, own = [], graph.written

    def kept(df, path):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return own(df, path)

    monkeypatch.setattr(communities, "written", kept)
    monkeypatch.setattr(graph, "written", kept)
    rows = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "xyz" for i in range(6) for j in range(i)] + [("x0", "y0", 1.0), ("y1", "z1", 1.0)]
    found = communities.communities(spark.createDataFrame(rows, "a string, b string, weight double"), local_links=0)
    assert {r.node: r.cluster for r in found.collect()} == {f"{g}{i}": f"{g}0" for g in "xyz" for i in range(6)}
    assert len(seen) > 10 and not [p for p in seen if "Broadcast" in p]


def test_damped_graphs_are_not_shuffled_for_their_hubs(spark):
    links = [("h", f"n{i:03d}", 2.0) for i in range(40)] + [(f"n{i:03d}", f"n{i + 1:03d}", 0.3 + i) for i in range(39)]
    got = G.damp_hubs(spark.createDataFrame(links, "a string, b string, weight double"))
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.a, r.b, r.weight, r.compressed_by_hub) for r in got.collect()} == {(a, b, 0.5 if a == "h" else w, a == "h") for a, b, w in links}


def test_routed_edges_meet_in_counted_parts(spark, monkeypatch):
    monkeypatch.setattr(G, "PART_ROWS", 10)
    edges = spark.range(400).select(F.concat(F.lit("a"), F.col("id") % 100).alias("src_id"), F.concat(F.lit("b"), F.col("id") % 7).alias("dst_id"), F.lit("call").alias("edge_type"), F.col("id").alias("ord"))
    routed = G.route_edges(edges)
    assert "REPARTITION_BY_NUM" in (plan := routed._jdf.queryExecution().executedPlan().toString()) and ", 41), REPARTITION" in plan
    got = G.graph_stats(routed.select("graph", F.col("src_id").alias("src"), F.col("dst_id").alias("dst")))
    assert [tuple(r) for r in got.collect()] == [("call", 107, len({(i % 100, i % 7) for i in range(400)}))]
    both = spark.createDataFrame([("g", "x", "y"), ("g", "x", "y"), ("g", "x", "x"), ("g", "z", None), ("h", "y", "x")], "graph string, src string, dst string")
    assert {tuple(r) for r in G.graph_stats(both).collect()} == {("g", 4, 2), ("h", 2, 1)}


def test_degrees_shuffle_each_pair_once(spark):
    edges = spark.createDataFrame([(f"n{i % 20}", f"n{i % 31}") for i in range(3000)] + [("n1", "n1"), ("n2", None), (None, "n2")], "src string, dst string")
    got = {r.node: r.degree for r in G.degrees(edges).collect()}
    pairs = {frozenset((f"n{i % 20}", f"n{i % 31}")) for i in range(3000)} | {frozenset(("n1",)), frozenset(("n2", None))}
    assert got == {n: sum(n in p for p in pairs) for n in {n for p in pairs for n in p}}
    plan = G.degrees(edges)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate [a#")  # pairs are made distinct before each gives its ends
