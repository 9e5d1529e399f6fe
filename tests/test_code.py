"""Parsers, sources, the store, name resolution and the whole engine on a small repository of code."""

import zipfile
from datetime import UTC, datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import values as V
from millrace.operators import overview as O
from millrace.operators import parsing as P
from millrace.operators import retrieval as Q
from millrace.plans.pipelines import Engine
from millrace.sources import readers
from millrace.sources.sinks import Store, publish_lineage

APP = '''"""Application."""
import os
from pkg.base import Base, helper
from . import util as u

LIMIT = 3


class App(Base):
    """The app."""

    def __init__(self, n: int, *rest):
        self.store = Store()

    async def run(self, x: str = "a") -> bool:
        """Runs."""
        if x and self.store or LIMIT:
            helper(x)
        for i in range(3):
            self.store.put(i)
        self.stop()
        return u.go(x)

    def stop(self):
        pass


try:
    import fast
except ImportError:
    def fallback():
        return len("x")


def main():
    app = App(1)
    app.run()

    def inner():
        pass
'''
BASE = "class Base:\n    pass\n\n\nclass Store:\n    def put(self, x):\n        return x\n\n\ndef helper(x):\n    return Store()\n"
UTIL = "def go(x):\n    return x\n"
JS = "import React from 'react';\nconst x = require('fs');\nexport class View extends Base {\n  render(a, b) {\n    return 1;\n  }\n}\nexport async function load(url) {\n  return fetch(url);\n}\nconst f = (p, q) => {\n  return p;\n};\n"
RUST = "use std::io;\npub struct P {\n  x: i32,\n}\nimpl P {\n  pub fn new(x: i32) -> P {\n    P { x }\n  }\n}\n"
C = "#include <stdio.h>\nstruct node {\n  int v;\n};\nint add(int a, int b) {\n  return a + b;\n}\n"
CSHARP = "using System.Text;\npublic class Foo : Bar {\n  public int Get(string k) {\n    return 1;\n  }\n}\n"


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("code")
    for path, text in {"pkg/__init__.py": "# package\n", "pkg/app.py": APP, "pkg/base.py": BASE, "pkg/util.py": UTIL, "web/view.js": JS, "README.md": "# Demo\nLine", "build/out.py": "x = 1", "node_modules/m.js": "x", "broken.py": "def (", "big.py": "#" * 100}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "latin.py").write_bytes("# café\n".encode("latin-1"))
    (root / ".gitignore").write_text("# c\n\nbig.py\n*.log\n")
    return str(root)


def test_python_definitions():
    rows = {(r["kind"], r["class_name"], r["name"]): r for r in P.python_definitions(APP)}
    assert set(rows) == {("class", None, "App"), ("method", "App", "__init__"), ("method", "App", "run"), ("method", "App", "stop"), ("function", None, "fallback"), ("function", None, "main"), ("documentation", None, "module")}
    run = rows["method", "App", "run"]
    assert run["parameters"] == ["self", "x: str"] and run["return_type"] == "bool" and run["is_async"] and run["docstring"] == "Runs."
    assert run["complexity"] == 1 + 1 + 2 + 1  # if, two boolean operations, for
    assert rows["class", None, "App"]["bases"] == ["Base"] and rows["class", None, "App"]["header"] == "class App(Base):"
    assert P.python_definitions("def (") == P.python_definitions(None) == []
    assert len(P.python_definitions("```python\ntry:\n    pass\nexcept E as e as e:\n    pass\ndef f(): pass\n```\n\n")) == 1


def test_python_imports_calls_types():
    imports = P.python_imports(APP)
    assert {(r["module"], r["level"], r["is_from"], tuple(r["names"]), r["alias"]) for r in imports} == {("os", 0, False, ("os",), None), ("pkg.base", 0, True, ("Base", "helper"), None), ("", 1, True, ("util",), "u"), ("fast", 0, False, ("fast",), None)}
    calls = {(r["base_object"], r["call_name"], r["scope_id"], r["class_around"]) for r in P.python_calls(APP)}
    assert {(None, "helper", "method::run", "App"), ("self.store", "put", "method::run", "App"), ("self", "stop", "method::run", "App"), ("u", "go", "method::run", "App"), ("app", "run", "function::main", None), (None, "App", "function::main", None)} <= calls
    assert not {c[1] for c in calls} & {"range", "len"}
    assert {(r["scope_id"], r["variable"], r["class_name"]) for r in P.python_instance_types(APP)} == {("function::__init__", "self.store", "Store"), ("function::main", "app", "App")}
    scopes = {r["scope_id"]: APP.encode()[r["start_byte"] : r["end_byte"]] for r in P.python_scopes(APP)}
    assert scopes["function::stop"] == b"def stop(self):\n        pass"


def test_scan(spark, repo):
    patterns = readers.gitignore_patterns(spark, f"file://{repo}/.gitignore")
    assert patterns == ["big.py", "*.log"]
    rows = {r.relative_path: r for r in readers.scan(spark, f"file://{repo}", ignored=[*readers.IGNORED, *patterns], content=True).collect()}
    assert set(rows) == {"pkg/__init__.py", "pkg/app.py", "pkg/base.py", "pkg/util.py", "web/view.js", "README.md", "broken.py", "latin.py"}
    assert rows["latin.py"].content == "# café\n" and rows["pkg/app.py"].extension == ".py"
    assert readers.scan(spark, f"file://{repo}", megabytes=20 / 1048576).where("relative_path = 'pkg/app.py'").count() == 0


@pytest.mark.parametrize("pattern, path, want", [("*.pyc", "a/b.pyc", 1), ("*.pyc", "a/b.py", 0), ("dist/*", "dist/x/y.js", 1), ("dist/*", "a/dist/x.js", 0), ("node_modules", "a/node_modules/b", 1), ("doc/", "doc/x", 1), ("doc/", "doc", 0), ("**/t/*.js", "a/b/t/c.js", 1), ("/top.py", "top.py", 1), ("/top.py", "a/top.py", 0), ("*.[ch]", "x.c", 1), ("# c", "c", 0)])
def test_ignore_patterns(pattern, path, want):
    import re

    assert bool(re.search(readers.ignore_regex([pattern]), path)) == bool(want)


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, text in (("root/x.py", "x = 1"), ("root/d/y.py", "y"), ("root/../evil.py", "no")):
            z.writestr(name, text)
    rows = {r.relative_path: r.content for r in readers.read_zip(spark, f"file://{tmp_path}/a.zip").collect()}
    assert rows == {"x.py": "x = 1", "d/y.py": "y"}


def test_elements_and_structure(spark, repo):
    files = readers.scan(spark, f"file://{repo}", content=True).select(F.col("relative_path").alias("path"), "content")
    rows = P.elements(files, "demo").collect()
    by = {(r.type, r.name) for r in rows}
    assert {("file", "app.py"), ("class", "App"), ("function", "run"), ("documentation", "module"), ("class", "View")} <= by and len({r.id for r in rows}) == len(rows)
    run = next(r for r in rows if r.name == "run" and r.language == "python")
    assert run.signature == "async def run(self, x: str) -> bool" and run.code.startswith("    async def run") and run.id.startswith("demo_function_")
    counts = {r.path: (r.total_lines, r.code_lines, r.comment_lines) for r in P.line_counts(files).collect()}
    assert counts["latin.py"] == (1, 0, 1) and counts["pkg/util.py"] == (2, 2, 0)
    named = files.withColumn("repo_name", F.lit("demo"))
    assert O.readme(named).first().path == "README.md"
    over = O.structure_overview(named).first()
    assert over.primary_language == "python" and over.summary.startswith("demo is a python software project with")
    assert {(r.kind, r.name) for r in P.structure_summary(files).where("path = 'pkg/base.py'").collect()} == {("class", "Base"), ("class", "Store"), ("function", "put"), ("function", "helper")}
    listed = [(r.name, r.is_directory) for r in Q.list_directory(files.select("path")).collect()]
    assert ("pkg", True) in listed and ("latin.py", False) in listed and listed == sorted(listed, key=lambda x: (not x[1], x[0]))


def test_table_functions(spark):
    P.register(spark)
    spark.createDataFrame([(APP,)], "text string").createOrReplaceTempView("code")
    got = spark.sql("select d.name, d.kind from code, lateral python_definitions(code.text) d where d.kind = 'class'").collect()
    assert [(r.name, r.kind) for r in got] == [("App", "class")]


def test_engine(spark, repo, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    first = engine.index(f"file://{repo}", "demo", commit="c1")
    assert first["status"] == "published" and engine.head("demo") == first["snapshot_id"]
    assert engine.index(f"file://{repo}", "demo", commit="c1")["status"] == "reused"
    snap = first["snapshot_id"]
    names = {r.id: r.name for r in engine.elements(snap).collect()}
    calls = {(names[r.src], names[r.dst]) for r in engine.edges(snap).where("graph = 'call'").collect()}
    assert {("run", "helper"), ("run", "put"), ("run", "stop"), ("run", "go"), ("main", "run"), ("main", "App")} <= calls
    found = engine.search(snap, "helper store put", k=5).collect()
    assert found and len(found) <= 5 and "helper" in {r.name for r in found}
    assert engine.search_symbol(snap, "app").first().name == "App"
    chain = {names.get(r.node): r.depth for r in engine.call_chain(snap, "main", 2).collect()}
    assert chain["main"] == 0 and chain["run"] == 1 and chain["helper"] == 2
    reply = engine.ask(snap, "where is helper", session="s1")
    assert "helper" in reply["answer"] and engine.store.read("turns").count() == 1
    out = engine.project(snap)
    layers = {r.layer: r.summary for r in out["layers"].collect()}
    assert set(layers) == {"L0", "L1", "L2"} and "projection over" in layers["L0"] and out["chunks"].count() >= 1
    assert "modularity" in out["layers"].first().node_json
    engine.remove("demo")
    assert engine.head("demo") is None


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(FileNotFoundError):
        store.read("t")
    store.write("t", spark.range(3))
    old = store.read("t")
    store.write("t", spark.range(5))
    assert store.read("t").count() == 5 and old.count() == 3  # a reader keeps its version
    store.delete("t", spark.range(2), ["id"])
    assert store.read("t").count() == 3


def test_lineage_sink(spark):
    nodes = spark.range(7).selectExpr("cast(id as string) id", "'t' type", "'{}' props")
    edges = spark.range(2).selectExpr("'e' type", "'a' src", "'b' dst")
    got = publish_lineage(nodes, edges, "s1", "http://localhost:9", send=lambda url, key, body: 200, batch=4).collect()
    assert sum(r.sent for r in got) == 9 and all(r.status == 200 and r.key.startswith("s1:") for r in got)


def test_config(tmp_path):
    text = "# c\nloader:\n  extensions:\n    - .py\n    - \".js\"\n  max: 5\nstore:\n  index_path: data/x\n  on: true\n"
    got = readers.read_config(str(tmp_path / "c.yaml"), text)
    assert got["loader"] == {"extensions": [".py", ".js"], "max": 5} and got["store"]["index_path"] == f"{tmp_path}/data/x" and got["store"]["on"] is True


def test_paths_and_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    L = F.lit
    assert one(T.module_name(L("a/b/__init__.py"))) == "a.b" and one(T.module_name(L("a/c.py"))) == "a.c"
    assert one(T.normal_path(L("/a/./b/../c"))) == "/a/c" and one(T.is_safe_path(L("../x"), "/root/r")) is False and one(T.is_safe_path(L("x/../y"), "/root/r")) is True
    assert one(T.extension(L("a/b.tar.gz"))) == ".gz" and one(T.extension(L(".bashrc"))) == ""
    assert one(T.repo_name(L("https://h/o/name.git"))) == "name" and one(T.snake_to_camel(L("ab_cd_e"))) == "abCdE" and one(T.camel_to_snake(L("abCdE"))) == "ab_cd_e"
    assert one(T.code_entity(L('the function named "go_fast" here')))["name"] == "go_fast" and one(T.code_entity(L("nothing"))) is None
    assert one(T.query_filters(L("bugs in python file 'a/b.py'"))).asDict() == {"extension": ".py", "language": "python", "file_path": "a/b.py"}
    assert one(T.dedent(L("\n    a\n      b\n"))) == "a\n  b" and one(T.complexity(L("if x: for y"))) == 3
    assert one(T.source_kind(L("git@host.org:a/b"), L(False))) == "git" and one(T.source_kind(L("https://x"), L(True))) == "path"
    summary = spark.createDataFrame([("Text.\n<SUMMARY>short</SUMMARY>",), ("Text.\n## Summary\nshort",), ("Only",)], "a string").select(*T.split_summary(F.col("a"))).collect()
    assert [tuple(r) for r in summary] == [("Text.", "short"), ("Text.", "short"), ("Only", None)]


def test_tolerant_json():
    assert V.tolerant_json('x ```json\n{"a": [1, 2,], // c\n "b": "y}"}\n``` z') == '{"a":[1,2],"b":"y}"}'
    assert V.tolerant_json('{"a": {"b": [1, 2') == '{"a":{"b":[1,2]}}' and V.tolerant_json("none") is None and V.tolerant_json(None) is None


def test_cron(spark):
    at = datetime(2024, 2, 28, 23, 50, tzinfo=UTC)
    assert V.next_cron("*/15 * * * *", at) == datetime(2024, 2, 29, 0, 0, tzinfo=UTC)
    assert V.next_cron("0 9 * * 1-5", at, "Europe/Berlin").astimezone(UTC) == datetime(2024, 2, 29, 8, 0, tzinfo=UTC)
    assert V.next_cron("0 0 30 2 *", at) is None
    now = int(at.timestamp() * 1000)
    jobs = spark.createDataFrame([("at", now + 5, None, None), ("at", now - 5, None, None), ("every", None, 60_000, None), ("cron", None, None, "0 0 * * *")], "kind string, at_ms bigint, every_ms bigint, expr string")
    got = [r.n for r in jobs.select(V.next_run_ms(F.col("kind"), F.col("at_ms"), F.col("every_ms"), F.col("expr"), F.lit("UTC"), F.lit(now)).alias("n")).collect()]
    assert got == [now + 5, None, now + 60_000, now + 600_000]


def test_tokens_by_a_vocabulary(spark, tmp_path):
    """A vocabulary of single bytes and one pair: counts, cuts, texts that look like special tokens."""
    import base64

    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate([*(bytes([b]) for b in range(256)), b"ab"])))
    rows = spark.createDataFrame([(1, "abab c"), (2, None), (3, "<|endoftext|>"), (4, "é")], "id int, text string")
    got = {r.id: (r.n_tokens, r.cut) for r in T.bpe_tokens(rows, str(path), r"\S+|\s+", most=3).collect()}
    assert got == {1: (4, "abab "), 2: (0, None), 3: (13, "<|e"), 4: (2, "é")}


def test_bpe_tokens_in_slices(spark, tmp_path, monkeypatch):
    """A batch is given in slices bounded by rows and by bytes, in its order; a text longer than a slice is one of its own."""
    import base64

    path = tmp_path / "ranks"
    path.write_text("\n".join(f"{base64.b64encode(bytes([i])).decode()} {i}" for i in range(256)))
    monkeypatch.setattr(T, "SLICE_BYTES", 10)

    class Rows:
        schema, columns = spark.createDataFrame([], "id long, text string").schema, ["id", "text"]
        mapInArrow = staticmethod(lambda run, fields: run)

    texts = ["abc", None, "", "d" * 30, "é", "efghij", "kl"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["id", "text"])
    got = list(T.bpe_tokens(Rows, str(path), r"\S+|\s+", most=2)(iter([batch, batch.slice(0, 0)])))
    assert len(got) > 2 and max(sum(len(t or "") for t in b.column("text").to_pylist()) for b in got if b.num_rows > 1) <= 10
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["text"] for r in rows] == texts and [r["n_tokens"] for r in rows] == [3, 0, 0, 30, 2, 6, 2] and [r["cut"] for r in rows] == ["ab", None, "", "dd", "é", "ef", "kl"]
