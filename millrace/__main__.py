"""The command line: python -m millrace STORE COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import overview as O
from .operators import versions as W
from .plans.pipelines import Engine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace", description="Index, search and project repositories of code.")
    p.add_argument("store", help="the folder of the store, a URI that Spark reaches")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple, **options) -> None:
        c = commands.add_parser(name, **options)
        for flags, more in arguments:
            c.add_argument(*flags, **more)

    repo, ref = (("repo",), {}), (("--ref",), {"default": "main"})
    command("index", (("source",), {}), repo, ref, (("--commit",), {}), (("--precise",), {"help": "an indexer's JSON"}), help="index a directory or an archive")
    command("query", (("question",), {}), (("--repo",), {"action": "append"}), (("-k",), {"type": int, "default": 10}), (("--language",), {}), (("--type",), {}), help="ranked elements for a question")
    command("ask", repo, (("question",), {}), (("--session",), {}), ref, help="an answer with its sources")
    command("list", ref, help="repositories and their heads")
    command("info", repo, ref, help="statistics of a repository")
    command("symbols", repo, (("name",), {}), ref, help="elements by name")
    command("file", repo, (("path",), {}), ref, help="what a file defines")
    command("calls", repo, (("name",), {}), (("--hops",), {"type": int, "default": 2}), (("--callers",), {"action": "store_true"}), ref, help="the call chain of an element")
    command("project", repo, (("--scope",), {"default": "snapshot", "choices": ["snapshot", "query", "entity"]}), (("--query",), {"default": ""}), (("--target",), {}), ref, help="layers of a snapshot")
    command("sessions", help="dialogues, newest first")
    command("session", (("session",), {}), (("-n",), {"type": int, "default": 10}), help="the last turns of a dialogue")
    command("forget", (("session",), {}), help="delete a dialogue")
    command("publish", repo, (("snapshot",), {}), ref, help="make a snapshot the head of a ref")
    command("remove", repo, help="delete a repository")
    return p


def run(engine: Engine, a: argparse.Namespace):
    """A DataFrame to show, or a text."""
    snapshot = None
    if "repo" in a and "ref" in a and a.command not in ("index", "publish"):
        snapshot = engine.head(a.repo, a.ref)
        if snapshot is None:
            raise SystemExit(f"{a.repo} has no head {a.ref}")
    match a.command:
        case "index":
            return str(engine.index(a.source, a.repo, a.ref, a.commit, a.precise))
        case "query":
            filters = {k: v for k, v in (("language", a.language), ("type", a.type)) if v}
            return engine.search_all(a.question, a.repo, a.k, **filters).select("repo_name", "relative_path", "type", "name", "start_line", "end_line", F.round("total_score", 4).alias("score"))
        case "ask":
            return engine.ask(snapshot, a.question, a.session)["answer"]
        case "list":
            return engine.repositories(a.ref)
        case "info":
            return O.repository_stats(engine.elements(snapshot))
        case "symbols":
            return engine.search_symbol(snapshot, a.name).select("type", "name", "relative_path", "start_line")
        case "file":
            return O.file_summary(engine.elements(snapshot), a.path)
        case "calls":
            chain = engine.call_chain(snapshot, a.name, a.hops, "callers" if a.callers else "callees")
            return chain.join(engine.elements(snapshot).select(F.col("id").alias("node"), "name", "relative_path"), "node").select("depth", "name", "relative_path").orderBy("depth", "name")
        case "project":
            return engine.project(snapshot, a.scope, a.query, a.target)["layers"].select("layer", "summary")
        case "sessions":
            turns = engine.store.read("turns", "turns")
            return W.session_list(W.session_index(turns), turns)
        case "session":
            turns = engine.store.read("turns", "turns").where(F.col("session_id") == a.session)
            return W.last_turns(turns, a.n).select("turn_number", "query", "answer")
        case "forget":
            engine.store.delete("turns", engine.spark.createDataFrame([(a.session,)], "session_id string"), ["session_id"])
            return "done"
        case "publish":
            engine.publish(a.snapshot, a.repo, a.ref, "")
            return "done"
        case "remove":
            engine.remove(a.repo)
            return "done"


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    out = run(Engine(SparkSession.builder.appName("millrace").getOrCreate(), a.store), a)
    print(out) if isinstance(out, str) else out.show(100, truncate=120)


if __name__ == "__main__":
    main()
