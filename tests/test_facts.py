"""Fixtures of facts: adapters, merge, checks, aliases, lineage, edges, publication."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace import schemas
from millrace.operators import facts as X
from millrace.operators import graph as G
from millrace.operators import versions as W

S, D, O, E = (schemas.RELATIONS[k] for k in ("symbols", "documents", "occurrences", "edges"))


def symbol(i, path="a.py", name="foo", kind="function", line=1, source="ast", **more):
    row = dict(symbol_id=i, external_symbol_id=None, path=path, display_name=name, kind=kind, language="python", qualified_name=None, signature=None, start_line=line, start_col=0, end_line=line, end_col=0, source_priority=10, source_set=[source], aliases=[], element_id=None)
    return tuple((row | more).values())


def occurrence(i, s, doc="d1", source="ast", role="definition", at=(10, 0, 20, 0)):
    return (i, s, doc, role, *at, source)


@pytest.fixture()
def pair(spark):
    ast = spark.createDataFrame([symbol("ast:s1"), symbol("ast:s2", name="only"), symbol("ast:s3", name="nl", line=None)], S)
    precise = spark.createDataFrame([symbol("scip:snap:1:foo", source="scip"), symbol("scip:nl", name="nl", line=None, source="scip")], S)
    return ast, precise


def test_merge_prefers_precise(pair):
    symbols, canonical = X.merge_symbols(*pair)
    got = {r.symbol_id: r for r in symbols.collect()}
    assert set(got) == {"scip:snap:1:foo", "ast:s2", "scip:nl"}
    assert got["scip:snap:1:foo"].aliases == ["ast:s1"] and got["scip:snap:1:foo"].source_set == ["ast", "scip"]
    assert got["scip:nl"].aliases == ["ast:s3"]  # null lines compare equal
    assert {(r.symbol_id, r.canonical_id) for r in canonical.collect()} == {("ast:s1", "scip:snap:1:foo"), ("ast:s3", "scip:nl")}


def test_merge_is_idempotent(pair):
    once, _ = X.merge_symbols(*pair)
    twice, _ = X.merge_symbols(pair[0], once)
    key = lambda t: sorted((r.symbol_id, r.aliases, r.source_set) for r in t.collect())
    assert key(once) == key(twice)


def test_merge_dedups_occurrences(spark, pair):
    _, canonical = X.merge_symbols(*pair)
    a = spark.createDataFrame([occurrence("o1", "ast:s1"), occurrence("o3", "ast:s2")], O)
    p = spark.createDataFrame([occurrence("o2", "scip:snap:1:foo", source="scip")], O)
    got = X.merge_occurrences(a, p, canonical).collect()
    assert sorted((r.occurrence_id, r.source) for r in got) == [("o2", "scip"), ("o3", "ast")]


def test_merge_edges_and_documents(spark, pair):
    _, canonical = X.merge_symbols(*pair)
    edge = lambda i, s, d, src: (i, s, d, "call", src, "x", "d1", "t")
    got = X.merge_edges(spark.createDataFrame([edge("e1", "ast:s1", "ast:s2", "ast")], E), spark.createDataFrame([edge("e2", "ast:s1", "ast:s1", "scip")], E), canonical).collect()
    assert sorted((r.src_id, r.dst_id) for r in got) == [("scip:snap:1:foo", "ast:s2"), ("scip:snap:1:foo", "scip:snap:1:foo")]
    docs = [spark.createDataFrame([("d1", "a.py", "python", [s])], D) for s in ("ast", "scip")]
    assert X.merge_documents(*docs).collect()[0].source_set == ["ast", "scip"]


def test_validate(spark):
    facts = {
        "documents": spark.createDataFrame([("d1", "a.py", "python", ["x"]), ("d2", "a.py", "python", ["x"])], D), "symbols": spark.createDataFrame([symbol("sym:1", source_set=[])], S),
        "occurrences": spark.createDataFrame([occurrence("o", "sym:missing")], O), "edges": spark.createDataFrame([("e1", "d1", "sym:missing", "call", "", None, None, None)], E),
    }
    got = {(r.rule, r.detail) for r in X.validate(facts).collect()}
    assert got == {("duplicate document path", "a.py"), ("occurrence references missing symbol_id", "sym:missing"), ("edge dst not found", "e1 -> sym:missing"), ("edge source missing", "e1"), ("edge confidence missing", "e1"), ("symbol provenance missing", "sym:1")}
    empty = {k: v.limit(0) for k, v in facts.items()}
    assert {r.rule for r in X.validate(empty).collect()} == {"snapshot must contain at least one document", "snapshot must contain at least one symbol"}


def elements(spark, rows):
    schema = "id string, type string, name string, relative_path string, language string, start_line int, start_col int, end_line int, qualified_name string, class_name string, signature string, imports array<string>, bases array<string>"
    return spark.createDataFrame(rows, schema)


def test_facts_of_elements(spark):
    e = elements(spark, [
        ("f1", "file", "app.py", "src/app.py", "python", 1, 0, 90, None, None, None, ["src.base", "os", "missing"], []), ("f2", "file", "base.py", "src/base.py", "python", 1, 0, 9, None, None, None, [], []),
        ("f3", "file", "repos.py", "src/repos.py", "python", 1, 0, 9, None, None, None, [], []),
        ("c1", "class", "App", "src/app.py", "python", 3, 0, 50, None, None, None, [], ["Base", "object"]), ("c2", "class", "Base", "src/base.py", "python", 2, 0, 8, None, None, None, [], []),
        ("m1", "method", "my_method", "src/app.py", "python", 42, 8, 50, "pkg.src.app.MyClass.my_method", "MyClass", None, [], []), ("m2", "function", "my_func", "src/app.py", "python", 10, None, 12, None, None, None, [], []),
    ])
    facts = X.from_elements(e, "snap")
    ids = {r.element_id: r.symbol_id for r in facts["symbols"].collect()}
    assert "pkg.src.app.MyClass.my_method" in ids["m1"] and ":42:8" in ids["m1"] and ":50:" not in ids["m1"]
    assert "my_func" in ids["m2"] and ids["m2"].endswith(":10:0") and set(ids) == {"c1", "c2", "m1", "m2"}
    edges = facts["edges"].collect()
    kinds = [r.edge_type for r in edges]
    assert kinds.count("contain") == 4 and kinds.count("inherit") == 1
    docs = {r.path: r.doc_id for r in facts["documents"].collect()}
    assert [(r.src_id, r.dst_id) for r in edges if r.edge_type == "import"] == [(docs["src/app.py"], docs["src/base.py"])]  # os is not repos.py
    assert X.validate(facts).count() == 0


def test_facts_of_an_index(spark, tmp_path):
    text = '{"indexer_name": "x", "documents": [{"path": "a.py", "language": "python", "symbols": [{"symbol": "pkg a/Foo.", "name": "Foo", "kind": "class"}], "occurrences": [{"symbol": "pkg a/Foo.", "role": "reference", "range": [5, 0, 5, 3]}, {"symbol": "ext/Bar.", "role": "type_definition", "range": [12, 0, 12, 5]}]}]}'
    (tmp_path / "i.json").write_text(text)
    from millrace.sources import readers

    facts = X.from_index(readers.read_index(spark, f"file://{tmp_path}/i.json"), "snap:repo:abc")
    names = {r.symbol_id: r.kind for r in facts["symbols"].collect()}
    assert names == {"scip:snap:repo:abc:pkg a/Foo.": "class", "scip:snap:repo:abc:ext/Bar.": "external"}
    edges = facts["edges"].collect()
    assert {r.edge_type for r in edges} == {"contain", "ref"} and all(r.extractor for r in edges)
    assert {r.role for r in facts["occurrences"].collect()} == {"reference", "type_definition"} and X.validate(facts).count() == 0


def test_one_document_id_for_both_sources(spark):
    a = X.from_elements(elements(spark, [("f", "file", "a.py", "a.py", "python", 1, 0, 2, None, None, None, [], [])]), "snap")
    p = X.from_index(spark.createDataFrame([("x", "1", [("a.py", "python", [], [])])], schemas.RELATIONS["index"]), "snap")
    assert X.merge_documents(a["documents"], p["documents"]).count() == 1


def test_aliases_and_resolution(spark, pair):
    symbols, _ = X.merge_symbols(*pair)
    asked = spark.createDataFrame([(1, "ast:s1", None, None), (2, "none", "foo", None), (3, None, None, "a.py"), (4, "none", "none", "none")], "ask_id int, symbol_id string, name string, path string")
    got = {r.ask_id: r.canonical_id for r in X.resolve(asked, symbols).collect()}
    assert got == {1: "scip:snap:1:foo", 2: "scip:snap:1:foo", 3: "ast:s2", 4: None}
    assert {r.canonical_id: r.aliases for r in X.aliases_of(symbols).collect()}["scip:snap:1:foo"] == ["ast:s1", "scip:snap:1:foo"]


def test_lineage(spark):
    snap = spark.createDataFrame([("s1", "repo", "main", "c1")], "snapshot_id string, repo_name string, branch string, commit_id string")
    manifest = spark.createDataFrame([("m1", "s1", "run1", "m0")], "manifest_id string, snapshot_id string, index_run_id string, previous_manifest_id string")
    docs, syms = spark.createDataFrame([("d1", "a.py", "python", ["x"])], D), spark.createDataFrame([symbol("sym:1")], S)
    nodes, edges = X.lineage(snap, manifest, docs, syms, spark.createDataFrame([("c1", "c0")], "commit_id string, parent_id string"))
    assert {r.type for r in nodes.collect()} == {"Repository", "Branch", "Commit", "Snapshot", "Manifest", "IndexRun", "DocumentVersion", "SymbolVersion"}
    assert {r.type for r in edges.collect()} == {"repository_snapshot", "branch_commit", "commit_parent", "snapshot_manifest", "manifest_supersedes", "manifest_run", "snapshot_document", "document_symbol"}


def test_edge_routing(spark):
    e = spark.createDataFrame([("d1", "sym:1", "contain", 1), ("sym:1", "sym:1", "call", 2), ("sym:1", "sym:1", "call", 3), ("a", "b", "odd", 4)], "src_id string, dst_id string, edge_type string, ord int")
    got = G.route_edges(e).groupBy("graph").count().collect()
    assert {r.graph: r["count"] for r in got} == {"containment": 1, "call": 1}


def test_publication(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    schema = schemas.RELATIONS["manifests"]
    log = W.publish(schemas.empty(spark, "manifests"), spark.createDataFrame([("m1", "repo", "main", "s1", "r1", at(1), None, "published")], schema))
    log = W.publish(log, spark.createDataFrame([("m2", "repo", "main", "s2", "r2", at(2), None, "published")], schema))
    head = W.heads(log).collect()
    assert len(head) == 1 and (head[0].manifest_id, head[0].previous_manifest_id) == ("m2", "m1")
    asked = spark.createDataFrame([("repo", "main", None), ("repo", "dev", None), ("x", "y", "given")], "repo_name string, ref_name string, snapshot_id string")
    assert {(r.ref_name, r.snapshot_id) for r in W.resolve_snapshot(asked, log).collect()} == {("main", "s2"), ("dev", None), ("y", "given")}


def test_idempotent_runs(spark):
    row = lambda i, k: (i, "repo", "s", None, None, k, "queued", None, None, None, None)
    schema = schemas.RELATIONS["index_runs"]
    runs = W.create_runs(spark.createDataFrame([row("r1", "k1")], schema), spark.createDataFrame([row("r2", "k1"), row("r3", "k2"), row("r4", None), row("r5", None)], schema))
    assert sorted(r.run_id for r in runs.collect()) == ["r1", "r3", "r4", "r5"]


def test_tasks(spark):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    e = spark.createDataFrame([(1, "t1", "pending", at(0)), (2, "t1", "running", at(1)), (3, "t1", "pending", at(2)), (4, "t2", "pending", at(1))], schemas.RELATIONS["task_events"])
    states = W.task_states(e)
    claimed = W.claim(states).collect()
    assert [(r.task_id, r.status, r.attempts) for r in claimed] == [("t1", "running", 2)]


def test_insert_new_has_null_safe_keys(spark):
    t = spark.createDataFrame([("r", None, 1)], "a string, b string, n int")
    got = W.insert_new(t, spark.createDataFrame([("r", None, 2), ("r", "x", 3), ("r", "x", 4)], "a string, b string, n int"), ["a", "b"])
    assert sorted((r.b or "", r.n) for r in got.collect())[0] == ("", 1) and got.count() == 2


def test_cache_and_sessions(spark):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    new = spark.createDataFrame([("k", bytearray(b"v1"), at(0)), ("z", bytearray(b"xy"), at(0))], "key string, value binary, stored_at timestamp")
    cache = W.cache_put(schemas.empty(spark, "cache"), new, 600)
    keys = spark.createDataFrame([("k",), ("q",)], "key string")
    assert W.cache_get(cache, keys, F.lit(at(9))).count() == 1 and W.cache_get(cache, keys, F.lit(at(10))).count() == 0
    stats = W.cache_stats(cache, F.lit(at(30))).first()
    assert (stats.entries, stats.bytes, stats.expired) == (2, 4, 2)
    turns = spark.createDataFrame([("s", n, at(n), f"q{n}", "a", None, n == 2) for n in (1, 2, 3, 5)], schemas.RELATIONS["turns"])
    assert [r.turn_number for r in W.last_turns(turns, 3).collect()] == [3, 5]  # 4 is missing and leaves a gap
    assert W.next_turn(turns).first().next_turn == 6 and W.session_index(turns).first().multi_turn
