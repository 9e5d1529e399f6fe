"""Properties of ranking, selection, graphs and streams against plain Python."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph as G
from millrace.operators import projection
from millrace.operators import retrieval as Q
from millrace.operators import selection as S
from millrace.streaming import streams

ROW = "id int, repo_name string, relative_path string, type string, name string, start_line int, end_line int, total_score double"


def scored(spark, rows):
    return spark.createDataFrame(rows, ROW)


def test_fusion_is_the_sum_of_its_parts(spark):
    s, k, p = (spark.createDataFrame(x, "id int, score double") for x in ([(1, 0.5), (2, 0.9)], [(2, 4.0), (3, 8.0)], [(1, 1.0)]))
    got = {r.id: r for r in Q.fuse(s, k, p, spark.createDataFrame([(3, 50)], "id int, source_priority int")).collect()}
    assert got[1].total_score == pytest.approx(0.5 * 0.6 + 0.4) and got[2].total_score == pytest.approx(0.54 + 0.15) and got[3].total_score == pytest.approx(0.3 * 1.25)
    none = Q.fuse(s, k.limit(0)).collect()
    assert {r.id for r in none} == {1, 2} and all(r.keyword_score == 0 for r in none)


def test_containment_equals_the_greedy_rule(spark):
    rnd = random.Random(3)
    rows = [(i, "r", f"f{rnd.randrange(30)}", rnd.choice(["class", "function"]), f"n{i}", a := rnd.randrange(60), a + rnd.randrange(25), 1.0) for i in range(400)]
    got = {r.id for r in S.drop_contained(scored(spark, rows)).collect()}
    want = set()
    for f in {r[2] for r in rows}:
        kept = []
        size = lambda r: r[6] - r[5] + 1 if r[6] > r[5] else 0
        for r in sorted((r for r in rows if r[2] == f), key=lambda r: (-{"class": 2, "function": 1}[r[3]], -size(r), r[5], r[0])):
            if not any(k[5] <= r[5] and r[6] <= k[6] and (k[5] < r[5] or r[6] < k[6]) for k in kept):
                kept.append(r)
        want |= {k[0] for k in kept}
    assert got == want


def test_budget_equals_the_greedy_rule(spark):
    rnd = random.Random(4)
    rows = [(i, "r", f"q{i % 12}", "function", f"n{i}", 0, rnd.choice([0, 3, 10, 40, 200]), rnd.random()) for i in range(300)]
    got = {r.id for r in S.prune_to_budget(scored(spark, rows).withColumn("priority", F.col("total_score")), 100, "relative_path").collect()}
    want = set()
    for q in {r[2] for r in rows}:
        taken, used = [], 0
        for r in sorted((r for r in rows if r[2] == q), key=lambda r: (-r[7], r[0])):
            n = r[6] - r[5] + 1 if r[6] > r[5] else 0
            if not taken or used + n <= 100:
                taken.append(r[0])
                used += n
            elif len(taken) >= 5:
                break
        want |= set(taken)
    assert got == want


@pytest.mark.parametrize("least, fold_rows", [(1, 0), (3, 0), (5, 0), (3, 2000)])
def test_budget_in_every_order(spark, least, fold_rows, monkeypatch):
    """Two hundred groups in orders of their own, with ties, rows that fit nowhere and rows without lines."""
    monkeypatch.setattr(S, "FOLD_ROWS", fold_rows)
    rnd = random.Random(7 + least)
    rows = [(i, "r", f"q{i % 200}", "function", f"n{i}", 0, rnd.choice([0, 0, 1, 4, 9, 30, 150]), rnd.choice([0.1, 0.2, 0.3, rnd.random()])) for i in range(2600)]
    got = {r.id for r in S.prune_to_budget(scored(spark, rows).withColumn("priority", F.col("total_score")), 40, "relative_path", least).collect()}
    want = set()
    for q in {r[2] for r in rows}:
        taken, used = [], 0
        for r in sorted((r for r in rows if r[2] == q), key=lambda r: (-r[7], r[0])):
            n = r[6] - r[5] + 1 if r[6] > r[5] else 0
            if not taken or used + n <= 40:
                taken.append(r[0])
                used += n
            elif len(taken) >= least:
                break
        want |= set(taken)
    assert got == want


def test_budget_of_one_large_group(spark):
    rows = spark.range(400_000).select("id", F.lit(1).alias("start_line"), (F.col("id") % 50).alias("end_line"), (F.col("id") * 7919 % 400_009).cast("double").alias("priority"))
    got = S.prune_to_budget(rows, 3000)
    lines = got.agg(F.sum(S.lines_of(F.col("start_line"), F.col("end_line")))).first()[0]
    first = rows.orderBy(F.desc("priority"), "id").limit(got.count()).select("id")
    assert 2950 < lines <= 3000 and got.select("id").exceptAll(first).isEmpty()


def test_duplicates(spark):
    rows = [(1, "r", "a", "file", "a", 1, 9, 0.1), (2, "r", "a", "class", "C", 1, 5, 0.9), (3, "r", "b", "class", "D", 1, 5, 0.2), (3, "r", "b", "class", "D", 1, 5, 0.8)]
    got = [(r.id, r.total_score) for r in S.drop_duplicates(scored(spark, rows)).orderBy("id").collect()]
    assert got == [(1, 0.1), (3, 0.8)]
    assert [r.id for r in S.only_new(scored(spark, rows[:1]), scored(spark, rows[1:3])).orderBy("id").collect()] == [2, 3]


def test_stopping(spark):
    r = spark.createDataFrame([("a", 1, 40, 100), ("a", 2, 41, 4000), ("a", 3, 41, 8000), ("b", 1, 96, 10), ("c", 1, 50, 13_000), ("d", 1, 50, 100), ("d", 2, 70, 300)], "query_id string, round int, confidence int, total_lines int")
    got = {(x.query_id, x.round): x.stop_reason for x in S.stopping(r).collect()}
    assert got == {("a", 1): None, ("a", 2): None, ("a", 3): "stagnation", ("b", 1): "confidence_threshold_reached", ("c", 1): "line_budget_exhausted", ("d", 1): None, ("d", 2): None}
    summary = {x.query_id: x for x in S.iteration_summary(r).collect()}
    assert summary["a"].confidence_gain == 1 and summary["b"].efficiency == "excellent"


def test_tool_calls(spark):
    schema = "call_id int, tool string, parameters map<string,string>"
    made = spark.createDataFrame([(1, "grep", {"b": "2", "a": "1"})], schema)
    new = spark.createDataFrame([(1, "grep", {"a": "1", "b": "2"}), (2, "list", {}), (3, "LIST ", {})], schema)
    assert [r.call_id for r in S.tool_calls_to_make(new, made).collect()] == [2]


def test_tree_and_parse(spark):
    files = spark.createDataFrame([("a/b/c.py",), ("a/x.py",), ("z.py",), (".git/q",)], "path string")
    assert [r.line for r in S.directory_tree(files).collect()] == ["a/", "  b/", "    c.py", "  x.py", "z.py"]
    bad = S.parse_round(spark.createDataFrame([("{",), ('{"confidence": 7, "keep_files": ["a"]}',)], "json string")).collect()
    assert sorted((r.confidence, r.query_complexity, tuple(r.keep_files)) for r in bad) == [(0, 50, ()), (7, 50, ("a",))]


def random_graph(n, m, seed):
    rnd = random.Random(seed)
    return sorted({(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)})


def test_reach_grows_and_equals_search(spark):
    edges = random_graph(40, 60, 1)
    e = spark.createDataFrame(edges, "src int, dst int")
    before: set = set()
    for hops in range(4):
        got = {(r.node, r.distance) for r in G.reach(e, spark.createDataFrame([(0,)], "seed int"), hops).collect()}
        want, level = {0: 0}, {0}
        for h in range(1, hops + 1):
            level = {b for a, b in edges if a in level} - set(want)
            want |= dict.fromkeys(level, h)
        assert got == set(want.items()) and before <= got
        before = got


def test_components_and_cycles(spark):
    edges = random_graph(60, 45, 2)
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    g = spark.createDataFrame([(a, b, 1.0) for a, b in edges if a != b], "a int, b int, weight double")
    assert {(r.node, r.component) for r in G.connected(g).collect()} == {(x, root(x)) for x in {y for e in edges if e[0] != e[1] for y in e}}
    line = spark.createDataFrame([(i, i + 1) for i in range(5)], "src int, dst int")
    assert G.is_acyclic(line) and not G.is_acyclic(line.union(spark.createDataFrame([(5, 0)], "src int, dst int")))


def test_shortest_path_and_backbone(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e")], "src string, dst string")
    assert G.shortest_path(e, "a", "e").first().path == ["a", "b", "d", "e"] and G.shortest_path(e, "e", "a").count() == 0
    clusters = spark.createDataFrame([(1, 9), (2, 5), (3, 4), (4, 1)], "cluster int, size int")
    links = spark.createDataFrame([(1, 2, 5.0), (2, 3, 4.0), (1, 3, 1.0)], "ca int, cb int, weight double")
    assert {(r.parent, r.child) for r in G.backbone(clusters, links).collect()} == {(1, 2), (2, 3)}


def test_projection_layers(spark):
    edges = [(f"n{i}", f"n{(i + d) % 12}") for i in range(12) for d in (1, 2)] + [(f"m{i}", f"m{(i + 1) % 6}") for i in range(6)] + [("n0", "m0")]
    g = G.weighted_graph(spark.createDataFrame([(a, b, "call") for a, b in edges], "src string, dst string, edge_type string"), spark.createDataFrame(sorted({(x,) for e in edges for x in e}), "node string"))
    out = projection.project(g, g.select(F.col("a").alias("node"), F.col("a").alias("title")).distinct())
    assert {r.layer for r in out["layers"].collect()} == {"L0", "L1", "L2"} and out["clusters"].agg(F.sum("size")).first()[0] == 18
    assert all("covers_nodes" in r.node_json and "covers_edges" in r.node_json for r in out["layers"].collect())


def test_fallback_edges(spark):
    nodes = spark.createDataFrame([("s",), ("d",)], "node string")
    none = spark.createDataFrame([], "src string, dst string, edge_type string")
    spare = spark.createDataFrame([("s", "d")], "src string, dst string")
    assert G.weighted_graph(none, nodes, spare).count() == 1
    assert G.weighted_graph(spark.createDataFrame([("s", "d", "call")], none.schema), nodes, spare).first().weight == 3.0


def test_hidden_summaries():
    rnd = random.Random(1)
    text = "Answer <b> one<SUMMARY>secret</SUMMARY> two <SUM no <summary>x</summary>end"
    for _ in range(200):
        cuts = sorted(rnd.sample(range(len(text)), 6))
        buffer, hidden, shown = "", False, ""
        for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
            out, buffer, hidden = streams.visible(buffer, hidden, text[a:b])
            shown += out
        assert shown + buffer == "Answer <b> one two <SUM no end"


def test_hidden_parts_after_letters_that_grow_in_capitals():
    shown, buffer, hidden = streams.visible("", False, "Straße ŉ ﬁ <Summary>x</sUMMARY>end")
    assert (shown + buffer, hidden) == ("Straße ŉ ﬁ end", False)


def test_hidden_summaries_end(spark, tmp_path):
    """A null chunk shows what was held back, and the next answer starts anew."""
    folder, schema = tmp_path / "in", "session_id string, ord int, chunk string"
    folder.mkdir()
    chunks = ["a < b is true <", None, "next <SUMMARY>no", "t</SUMMARY> shown", None]
    spark.createDataFrame([("s", i, c) for i, c in enumerate(chunks)], schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = streams.hide_summaries(spark.readStream.schema(schema).parquet(str(folder)))
    seen = []
    stream.writeStream.foreachBatch(lambda rows, _: seen.extend(r.shown for r in rows.collect())).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert "".join(seen) == "a < b is true <next  shown"


def test_streams(spark, tmp_path):
    folder, schema = tmp_path / "in", "channel string, sender string, content string"
    folder.mkdir()
    (folder / "a.json").write_text('{"channel": "x", "sender": "u", "content": "1"}\n{"channel": "y", "sender": "v", "content": "2"}\n')
    seen = []
    stream = streams.allowed(streams.file_events(spark, f"file://{folder}", schema), {"y": ["nobody"]})
    sink = lambda channel, rows, step: seen.extend((channel, r.content) for r in rows.collect())
    streams.route(stream, ["x", "y"], f"file://{tmp_path}/c", sink).awaitTermination()
    (folder / "b.json").write_text('{"channel": "x", "sender": "u", "content": "3"}\n')
    streams.route(streams.file_events(spark, f"file://{folder}", schema), ["x", "y"], f"file://{tmp_path}/c", sink).awaitTermination()
    assert seen == [("x", "1"), ("x", "3")]  # the second run took up only the new file


def test_reindex(spark):
    at = datetime(2024, 1, 1)
    old = spark.createDataFrame([("a", at, 1, ["e1"]), ("b", at, 1, ["e2"]), ("c", at, 1, ["e3"])], "path string, mtime timestamp, size bigint, element_ids array<string>")
    scan = spark.createDataFrame([("a", at, 1), ("b", at, 2), ("d", at, 1)], "path string, mtime timestamp, size bigint")
    elements = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "id string")
    got, changes = streams.reindex_step(old, scan, elements, lambda todo: todo.select(F.concat(F.lit("new-"), "path").alias("id")))
    assert sorted(r.id for r in got.collect()) == ["e1", "new-b", "new-d"]
    assert {(r.path, r.status) for r in changes.collect()} == {("a", "unchanged"), ("b", "modified"), ("c", "deleted"), ("d", "added")}


def test_task_stream(spark, tmp_path):
    rows = [(1, "t", "pending", datetime(2024, 1, 1, 1)), (2, "t", "running", datetime(2024, 1, 1, 2)), (3, "t", "completed", datetime(2024, 1, 1, 3))]
    events = spark.createDataFrame(rows, "event_id bigint, task_id string, status string, at timestamp")
    events.write.parquet(f"file://{tmp_path}/e")
    states = streams.task_states(spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/e"))
    got = []
    states.writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/k").foreachBatch(lambda df, _: got.extend(df.collect())).trigger(availableNow=True).start().awaitTermination()
    assert [(r.status, r.attempts) for r in got] == [("completed", 1)]


def test_parameter_problems(spark):
    calls = spark.createDataFrame([(1, "grep", {"term": "x", "most": "5"}), (2, "grep", {"most": "five", "odd": "1"}), (3, "rm", {})], "call_id int, tool string, parameters map<string,string>")
    schema = {"grep": {"term": ("string", True), "most": ("integer", False)}}
    got = {r.call_id: sorted(r.problems) for r in S.parameter_problems(calls, schema).collect()}
    assert got == {1: [], 2: ["missing term", "most should be integer", "unknown odd"], 3: ["unknown tool rm"]}


def test_listing_of_several_repositories(spark):
    files = spark.createDataFrame([("a", "src/x.py"), ("b", "src/d/y.py"), ("b", "src/.z")], "repo_name string, path string")
    assert [(r.repo_name, r.name, r.is_directory) for r in Q.list_directories(files, "src").collect()] == [("a", "x.py", False), ("b", "d", True)]
