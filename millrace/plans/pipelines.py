"""Whole plans: index a source, answer a question, project a snapshot. The facade of the library.

Everything up to a write is one lazy plan. Model calls are optional callables; without one the rule-based
answer is used.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import facts as X
from ..operators import graph as G
from ..operators import overview as O
from ..operators import parsing as P
from ..operators import projection
from ..operators import resolve as R
from ..operators import retrieval as Q
from ..operators import selection as S
from ..operators import steiner
from ..operators import versions as W
from ..sources import readers
from ..sources.sinks import Store

#: What a text becomes where no embedding model is plugged in.
DIMENSIONS = 64


def embed(elements: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """elements with vector: by a model (id, text -> id, vector), else by hashed tokens."""
    text = T.embedding_document(*[F.col(c) for c in ("type", "name", "signature", "docstring", "summary", "code")])
    if model is None:
        return elements.withColumn("vector", V.hash_embedding(T.word_tokens(text), DIMENSIONS))
    return elements.join(model(elements.select("id", text.alias("text"))), "id", "left")


def resolve_calls(files: DataFrame, elements: DataFrame, repo: str) -> DataFrame:
    """Call edges (src, dst, calls) of parsed files."""
    ord_col = F.struct("relative_path", "start_line")
    own = elements.withColumn("ord", ord_col)
    whole = own.where("type = 'file'").select(F.col("id").alias("file_id"), "relative_path")
    modules = R.module_map(own.where("type = 'file'"))
    exports = R.export_map(own)
    parts = own.join(whole, "relative_path").withColumn("file_path", F.col("relative_path"))
    raw = P.imports(files).join(whole.withColumnRenamed("relative_path", "path"), "path")
    importer = T.module_name(F.col("path"))
    named = raw.select(F.col("file_id").alias("importer_id"), F.lit(repo).alias("repo_name"), importer.alias("importer_module"), F.endswith("path", F.lit("__init__.py")).alias("is_package"), "module", "level", "names", "is_from", "alias", F.col("line").alias("pos"))
    keyed = named.withColumn("target_module", R.import_key(F.col("module"), F.col("module"), F.col("level"), F.col("importer_module"), F.col("is_package")))
    bound = keyed.select(F.col("importer_id").alias("file_id"), "repo_name", "target_module", F.explode("names").alias("name"), "alias", "pos", (~F.col("is_from")).alias("is_module"))
    # from a import b may mean the module a.b
    inner = bound.where("not is_module").withColumn("target_module", F.concat_ws(".", F.nullif("target_module", F.lit("")), "name")).withColumn("is_module", F.lit(True))
    bound = bound.unionByName(inner)
    types = P.instance_types(files).withColumnRenamed("path", "file_path")
    called = P.calls(files).join(whole.withColumnRenamed("relative_path", "path"), "path").withColumn("repo_name", F.lit(repo)).withColumn("call_id", F.concat_ws(":", "path", "position", "call_name")).withColumnRenamed("path", "file_path")
    return R.call_edges(called, parts, bound, exports, types)


def index_files(files: DataFrame, repo: str, snapshot: str, precise: DataFrame | None = None, model: Callable | None = None) -> dict[str, DataFrame]:
    """elements, facts, edges of source files (path, content): parse, embed, adapt, merge, resolve (Entry A).
    precise: an indexer's output, read_index()."""
    elements = embed(P.elements(files, repo), model)
    own = X.from_elements(elements.withColumn("start_col", F.lit(0)).withColumn("qualified_name", F.lit(None).cast("string")), snapshot)
    merged = X.merge(own, X.from_index(precise, snapshot) if precise is not None else None)
    calls = resolve_calls(P.with_language(files), elements, repo)
    bridge = X.element_bridge(merged["symbols"])
    by_call = calls.join(bridge.select(F.col("element_id").alias("src"), F.col("symbol_id").alias("src_id")), "src").join(bridge.select(F.col("element_id").alias("dst"), F.col("symbol_id").alias("dst_id")), "dst")
    call = by_call.select(V.fact_id("edge", F.lit("call"), F.col("src_id"), F.col("dst_id")).alias("edge_id"), "src_id", "dst_id", F.lit("call").alias("edge_type"), F.lit("ast").alias("source"), F.lit("resolved").alias("confidence"), F.lit(None).cast("string").alias("doc_id"), F.lit("calls").alias("extractor"))
    merged = merged | {"edges": merged["edges"].unionByName(call)}
    return {"elements": elements, **{f"facts_{k}": v for k, v in merged.items()}}


class Engine:
    """Index, query, project and publish over one store.

    answer: a model that turns a prompt into text (X01, X04); without it, a list of what was found. embedding: a
    function of (id, text) to (id, vector). A store under a temporary root makes an engine for trials (Z20); what
    is stored is loaded, what isn't is made from the elements again (Z19).
    """

    def __init__(self, spark: SparkSession, root: str, answer: Callable[[str], str] | None = None, embedding: Callable | None = None):
        self.spark, self.store, self.answer, self.embedding = spark, Store(spark, root), answer, embedding

    # -- index ----------------------------------------------------------------------
    def load(self, source: str) -> DataFrame:
        """path, content of a directory or a zip archive."""
        if source.endswith(".zip"):
            return readers.read_zip(self.spark, source).select(F.col("relative_path").alias("path"), "content")
        return readers.scan(self.spark, source, content=True).select(F.col("relative_path").alias("path"), "content")

    def snapshot_of(self, files: DataFrame, repo: str, commit: str | None = None) -> str:
        """snap:repo:commit, or a digest of all paths and contents where there is no commit."""
        if commit:
            return f"snap:{repo}:{commit}"
        # files are digested by part of the path first, so that no list of all of them meets in one task
        of = lambda column: F.sha1(F.array_join(F.array_sort(F.collect_list(column)), "\n").cast("binary")).alias("d")
        own = files.select(F.substring(F.md5(F.col("path").cast("binary")), 1, 3).alias("part"), F.concat_ws(":", "path", F.md5(F.col("content").cast("binary"))).alias("f"))
        parts = own.groupBy("part").agg(of("f")).select(F.concat_ws(":", "part", "d").alias("p"))
        digest = parts.agg(of("p"))
        return f"snap:{repo}:{digest.first().d}"

    def index(self, source: str, repo: str, ref: str = "main", commit: str | None = None, precise: str | None = None, publish: bool = True) -> dict[str, str]:
        """Runs the index pipeline; a snapshot that is there is reused. Returns snapshot_id, run_id, status."""
        files = self.load(source)
        snapshot = self.snapshot_of(files, repo, commit)
        known = self.store.read("snapshots", "snapshots").where(F.col("snapshot_id") == snapshot)
        if not known.isEmpty():
            return {"snapshot_id": snapshot, "run_id": "", "status": "reused"}
        run, status = uuid.uuid4().hex, "succeeded"
        now = datetime.now(UTC).replace(tzinfo=None)
        index = None
        if precise:
            try:
                index = readers.read_index(self.spark, precise)
                index.count()
            except Exception:
                index, status = None, "degraded"
        out = index_files(files, repo, snapshot, index, self.embedding)
        facts = {k.removeprefix("facts_"): v for k, v in out.items() if k.startswith("facts_")}
        self.store.save_facts(snapshot, facts)
        stored = self.store.load_facts(snapshot)
        problems = X.validate(stored).limit(5).collect()
        if problems:
            raise ValueError("; ".join(f"{p.rule}: {p.detail}" for p in problems))
        self.store.write(f"elements/{_name(snapshot)}", out["elements"])
        row = self.spark.createDataFrame([(snapshot, repo, ref, commit, None, None, now)], "snapshot_id string, repo_name string, branch string, commit_id string, tree_id string, artifact_key string, created_at timestamp").withColumn("artifact_key", V.artifact_key(F.col("snapshot_id")))
        refs = row.select(F.concat_ws(":", F.lit("ref"), "snapshot_id", "branch").alias("ref_id"), "repo_name", "branch", "commit_id", "tree_id", "snapshot_id", "created_at")
        self.store.save_snapshot(row, refs)
        if publish:
            self.publish(snapshot, repo, ref, run)
            status = "published" if status == "succeeded" else status
        return {"snapshot_id": snapshot, "run_id": run, "status": status}

    def publish(self, snapshot: str, repo: str, ref: str, run: str) -> None:
        row = [(uuid.uuid4().hex, repo, ref, snapshot, run, datetime.now(UTC).replace(tzinfo=None), None, "published")]
        from ..schemas import RELATIONS

        self.store.publish(self.spark.createDataFrame(row, RELATIONS["manifests"]))

    def head(self, repo: str, ref: str = "main") -> str | None:
        found = W.heads(self.store.read("manifests", "manifests")).where((F.col("repo_name") == repo) & (F.col("ref_name") == ref)).first()
        return found.snapshot_id if found else None

    # -- query ---------------------------------------------------------------------------
    def elements(self, snapshot: str) -> DataFrame:
        return self.store.read(f"elements/{_name(snapshot)}")

    def search(self, snapshot: str, question: str, k: int = 10, **filters: str | None) -> DataFrame:
        """Ranked elements for a question in one plan (Entry B)."""
        return hybrid(self.elements(snapshot), question, self.query_vector(question), k, self.edges(snapshot), **filters)

    def repositories(self, ref: str = "main") -> DataFrame:
        """repo_name, snapshot_id of every repository's head."""
        return W.heads(self.store.read("manifests", "manifests")).where(F.col("ref_name") == ref).select("repo_name", "snapshot_id")

    def search_all(self, question: str, repos: list[str] | None = None, k: int = 10, most_repos: int = 5, **filters: str | None) -> DataFrame:
        """Ranked elements of several repositories: of those named, else of the most_repos that fit the question best."""
        heads = {r.repo_name: r.snapshot_id for r in self.repositories().collect()}  # a row per repository
        own = {r: s for r, s in heads.items() if repos is None or r in repos}
        if not own:
            raise ValueError("no such repository")
        both = self.store.read_all([f"elements/{_name(s)}" for s in own.values()])
        vector = self.query_vector(question)
        if repos is None and len(own) > 1:
            q = F.array(*[F.lit(float(x)) for x in vector])
            near = both.where("vector is not null").select("repo_name", V.l2_similarity(F.col("vector"), q).alias("score"))
            semantic = near.groupBy("repo_name").agg(F.max("score").alias("score"))
            text = T.lexical_document(*[F.col(c) for c in ("name", "type", "language", "relative_path", "docstring", "signature", "summary", "code")])
            hits = Q.bm25(both.select("id", text.alias("text")), question).join(both.select("id", "repo_name"), "id")
            keyword = hits.groupBy("repo_name").agg(F.sum("score").alias("score"))
            fitting = [r.repo_name for r in Q.select_repositories(semantic, keyword, most_repos).collect()]
            both = Q.in_repositories(both, fitting)
        return hybrid(both, question, vector, k, **filters)

    def query_vector(self, question: str) -> list[float]:
        row = self.spark.range(1).select(V.hash_embedding(T.word_tokens(F.lit(question)), DIMENSIONS).alias("v"))
        return row.first().v

    def edges(self, snapshot: str) -> DataFrame:
        """graph, src, dst between elements."""
        facts = self.store.load_facts(snapshot)
        bridge = X.element_bridge(facts["symbols"])
        routed = G.route_edges(facts["edges"].withColumn("ord", F.col("edge_id")))
        return routed.join(bridge.select(F.col("symbol_id").alias("src_id"), F.col("element_id").alias("src")), "src_id").join(bridge.select(F.col("symbol_id").alias("dst_id"), F.col("element_id").alias("dst")), "dst_id").select("graph", "src", "dst")

    def ask(self, snapshot: str, question: str, session: str | None = None, k: int = 10) -> dict:
        """answer, sources and context; the turn is kept if a session is named."""
        rows = self.search(snapshot, question, k)
        found = rows.collect()  # k rows
        text = O.context(self.spark.createDataFrame(found, rows.schema)).first().context if found else ""
        said = self.answer(f"Context:\n{text}\n\nQuestion: {question}") if self.answer else "\n".join(f"{r.type} {r.name} in {r.relative_path}:{r.start_line}-{r.end_line}" for r in found)
        if session:
            turns = self.store.read("turns", "turns")
            n = (turns.where(F.col("session_id") == session).agg(F.max("turn_number")).first()[0] or 0) + 1
            row = [(session, n, datetime.now(UTC).replace(tzinfo=None), question, said, None, True)]
            self.store.save_turn(self.spark.createDataFrame(row, turns.schema))
        return {"answer": said, "sources": [r.asDict() for r in found], "context": text}

    def search_symbol(self, snapshot: str, name: str) -> DataFrame:
        return Q.symbol_search(self.elements(snapshot), name)

    def call_chain(self, snapshot: str, name: str, hops: int = 2, direction: str = "callees") -> DataFrame:
        seed = Q.named_element(self.elements(snapshot), name).first()
        edges = self.edges(snapshot).where("graph = 'call'")
        return G.call_chain(edges, seed.id if seed else "", hops, direction)

    # -- projection -------------------------------------------------------------------------
    def project(self, snapshot: str, scope_kind: str = "snapshot", query: str = "", target: str | None = None) -> dict[str, DataFrame]:
        """Layers and chunks of a snapshot, a query's or an entity's surroundings (Entry C); stored by projection id."""
        facts = self.store.load_facts(snapshot)
        nodes = facts["documents"].select(F.col("doc_id").alias("node"), F.col("path").alias("title"), "path", F.lit("document").alias("symbol_kind")).union(facts["symbols"].select("symbol_id", "display_name", "path", "kind"))
        edges = facts["edges"].select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "edge_type")
        if scope_kind == "entity" and target:
            nodes = nodes.join(G.ego(edges, target, 2), "node", "left_semi")
        elif scope_kind == "query" and query:
            degree = G.degrees(edges)
            terminals = [r.node for r in G.query_terminals(nodes, degree, query).collect()]  # twelve at most
            if terminals:
                nodes = nodes.join(steiner.query_scope(G.weighted_graph(edges, nodes), terminals), "node", "left_semi")
        fallback = facts["symbols"].select(F.col("symbol_id").alias("src"), "path").join(facts["documents"].select(F.col("doc_id").alias("dst"), "path"), "path").select("src", "dst")
        out = projection.project(G.weighted_graph(edges, nodes, fallback), nodes.select("node", "title"), scope_kind)
        i = self.spark.range(1).select(V.projection_id(F.lit(snapshot), F.lit(scope_kind), F.lit(query or target or ""), F.lit(target).cast("string"), F.lit(query), F.create_map().cast("map<string,string>")).alias("i")).first().i
        self.store.save_projection(i, out["layers"], out["chunks"])
        return out | {"projection_id": self.spark.range(1).select(F.lit(i).alias("projection_id"))}

    def remove(self, repo: str) -> int:
        """Removes a repository's tables and rows; returns the freed bytes."""
        freed = 0
        for r in self.store.read("snapshots", "snapshots").where(F.col("repo_name") == repo).select("snapshot_id").toLocalIterator():
            freed += self.store.drop(f"elements/{_name(r.snapshot_id)}") + self.store.drop(f"facts/{_name(r.snapshot_id)}")
        return freed + sum(self.store.remove_repository(repo, ("snapshots", "snapshot_refs", "manifests")).values())


def _name(snapshot: str) -> str:
    return "".join(c if c.isalnum() or c in "._-" else "_" for c in snapshot)


def hybrid(elements: DataFrame, question: str, vector: list[float], k: int = 10, edges: DataFrame | None = None, text_col: str | None = None, priority: DataFrame | None = None, semantic_k: int = 20, keyword_k: int = 10, **filters: str | None) -> DataFrame:
    """Filter, search both ways, fuse, expand over the graph, rerank, diversify, limit: one plan (Entry B).

    elements: id, type, name, relative_path, file_path, language, start_line, end_line, code, ..., vector.
    """
    own = Q.apply_filters(Q.elements_only(elements), **filters) if filters else Q.elements_only(elements)
    text = F.col(text_col) if text_col else T.lexical_document(*[F.col(c) for c in ("name", "type", "language", "relative_path", "docstring", "signature", "summary", "code")])
    semantic = Q.vector_top(own.select("id", "vector"), vector, semantic_k)
    keyword = Q.top(Q.bm25(own.select("id", text.alias("text")), question), keyword_k)
    fused = Q.fuse(semantic, keyword, priority=priority)
    rows = own.drop("vector").join(F.broadcast(fused), "id")
    if edges is not None:
        best = rows.orderBy(F.desc("total_score"), "id").limit(10).select(F.col("id").alias("seed"))
        near = G.related_undirected(edges, best, 2)
        rows = G.expand(rows.withColumn("related_to", F.lit(None).cast("string")), near.select("seed", "node"), own.drop("vector"))
    return Q.top(Q.diversify(Q.rerank(rows)), k, "total_score")


def refine(first: DataFrame, more: DataFrame, budget: int = 12_000) -> DataFrame:
    """A round of refinement: both lists merged without repeats, priorities, the line budget (Z08, Z31, W14, W17);
    without anything new, the first list within its budget."""
    both = S.merge_elements(first, S.only_new(first, more))
    for name, kind in (("agent_found", "boolean"), ("llm_file_selected", "boolean"), ("selection_granularity", "string")):
        if name not in both.columns:
            both = both.withColumn(name, F.lit(None).cast(kind))
    return S.prune_to_budget(S.priority(both), budget)
