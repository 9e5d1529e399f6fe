"""The command line over a small repository."""

import pytest

from millrace import __main__ as cli
from millrace.plans.pipelines import Engine


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repos")
    for repo, text in (("one", "def alpha(x):\n    return beta(x)\n\n\ndef beta(x):\n    return x\n"), ("two", "class Gamma:\n    def delta(self):\n        return 1\n")):
        (root / repo).mkdir()
        (root / repo / "m.py").write_text(text)
    engine = Engine(spark, f"file://{tmp_path_factory.mktemp('store')}/s")
    for repo in ("one", "two"):
        cli.run(engine, cli.parser().parse_args(["s", "index", f"file://{root}/{repo}", repo, "--commit", "c"]))
    return engine


def rows(engine, *arguments):
    out = cli.run(engine, cli.parser().parse_args(["s", *arguments]))
    return out if isinstance(out, str) else [r.asDict() for r in out.collect()]


def test_commands(engine):
    assert {r["repo_name"] for r in rows(engine, "list")} == {"one", "two"}
    assert [r["name"] for r in rows(engine, "symbols", "one", "alpha")] == ["alpha"]
    assert [(r["depth"], r["name"]) for r in rows(engine, "calls", "one", "alpha")] == [(0, "alpha"), (1, "beta")]
    assert [(r["depth"], r["name"]) for r in rows(engine, "calls", "one", "beta", "--callers")] == [(0, "beta"), (1, "alpha")]
    assert {r["type"] for r in rows(engine, "file", "two", "m.py")} == {"file", "class", "function"}
    assert rows(engine, "info", "two")[0]["classes"] == 1
    found = rows(engine, "query", "class gamma delta", "--repo", "two", "-k", "3")
    assert found and {r["repo_name"] for r in found} == {"two"}
    assert rows(engine, "query", "beta alpha function") and {r["type"] for r in rows(engine, "query", "delta", "--type", "class")} <= {"class"}
    assert {r["layer"] for r in rows(engine, "project", "one")} == {"L0", "L1", "L2"}


def test_dialogue_and_removal(engine):
    assert "alpha" in rows(engine, "ask", "one", "alpha function", "--session", "s1")
    rows(engine, "ask", "one", "beta", "--session", "s1")
    assert [r["total_turns"] for r in rows(engine, "sessions")] == [2] and [r["turn_number"] for r in rows(engine, "session", "s1", "-n", "1")] == [2]
    rows(engine, "forget", "s1")
    assert rows(engine, "sessions") == []
    rows(engine, "remove", "one")
    assert {r["repo_name"] for r in rows(engine, "list")} == {"two"}
    with pytest.raises(SystemExit):
        rows(engine, "info", "one")
