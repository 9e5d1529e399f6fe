"""Facts of code as relations: documents, symbols, occurrences, edges. Adapters, precedence merge, checks, aliases, lineage.

A bundle of facts is a dict of DataFrames with the keys documents, symbols, occurrences and edges.
"Precise" facts come from an indexer, "ast" facts from a parser; precise ones win.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V

DOCUMENT = ("doc_id", "path", "language", "source_set")
SYMBOL = ("symbol_id", "external_symbol_id", "path", "display_name", "kind", "language", "qualified_name", "signature", "start_line", "start_col", "end_line", "end_col", "source_priority", "source_set", "aliases", "element_id")
OCCURRENCE = ("occurrence_id", "symbol_id", "doc_id", "role", "start_line", "start_col", "end_line", "end_col", "source")
EDGE = ("edge_id", "src_id", "dst_id", "edge_type", "source", "confidence", "doc_id", "extractor")
AST_PRIORITY, PRECISE_PRIORITY = 10, 100
#: Roles of an indexer's occurrences that make a reference edge.
REFERENCE_ROLES = ("reference", "implementation", "type_definition", "import", "write_access", "forward_definition")
AST, SCIP = "ast", "scip"


def _sources(name: str) -> Column:
    return F.array(F.lit(name))


# -- adapters ---------------------------------------------------------------------
def from_elements(elements: DataFrame, snapshot: str) -> dict[str, DataFrame]:
    """Facts of parsed elements (G17). elements: id, type, name, relative_path, language, signature, start_line,
    start_col, end_line, qualified_name, class_name, imports array<string>, bases array<string>."""
    snap = F.lit(snapshot)
    doc = V.fact_id("doc", snap, F.col("relative_path"))
    own = elements.withColumn("doc_id", doc).withColumn("language", F.coalesce("language", F.lit("unknown")))
    documents = own.groupBy("doc_id").agg(F.min("relative_path").alias("path"), F.min("language").alias("language"), _sources(AST).alias("source_set"))
    qualified = F.coalesce("qualified_name", F.when(F.col("class_name").isNotNull(), F.concat_ws(".", "class_name", "name")), "name")
    parts = own.where(~F.col("type").isin("file", "documentation")).withColumn("qualified", qualified)
    parts = parts.withColumn("symbol_id", V.ast_symbol_id(snap, F.col("language"), F.col("relative_path"), F.col("type"), F.col("qualified"), F.col("start_line"), F.col("start_col")))
    none = F.lit(None).cast("string")
    symbols = parts.select(
        "symbol_id", none.alias("external_symbol_id"), F.col("relative_path").alias("path"), F.col("name").alias("display_name"), F.col("type").alias("kind"), "language", F.col("qualified").alias("qualified_name"),
        "signature", "start_line", F.coalesce("start_col", F.lit(0)).alias("start_col"), "end_line", F.lit(0).alias("end_col"), F.lit(AST_PRIORITY).alias("source_priority"), _sources(AST).alias("source_set"),
        F.array().cast("array<string>").alias("aliases"), F.col("id").alias("element_id"),
    )
    line = F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1))
    occurrences = parts.select(
        V.fact_id("occ", F.col("symbol_id"), F.col("doc_id"), F.col("start_line").cast("string"), F.col("end_line").cast("string")).alias("occurrence_id"), "symbol_id", "doc_id", F.lit("definition").alias("role"),
        line.alias("start_line"), F.lit(0).alias("start_col"), F.greatest(F.coalesce("end_line", "start_line", F.lit(1)), F.lit(1)).alias("end_line"), F.lit(0).alias("end_col"), F.lit(AST).alias("source"),
    )

    def edges(rows: DataFrame, kind: str, confidence: str, *key: Column) -> DataFrame:
        return rows.select(V.fact_id("edge", F.lit(kind), *key).alias("edge_id"), "src_id", "dst_id", F.lit(kind).alias("edge_type"), F.lit(AST).alias("source"), F.lit(confidence).alias("confidence"), "doc_id", F.lit("elements").alias("extractor"))

    contain = edges(parts.select(F.col("doc_id").alias("src_id"), F.col("symbol_id").alias("dst_id"), "doc_id"), "contain", "resolved", F.col("src_id"), F.col("dst_id"))
    imports = import_targets(own.where("type = 'file'").select("doc_id", F.explode("imports").alias("module")), documents)
    imports = edges(imports.select(F.col("doc_id").alias("src_id"), F.col("target").alias("dst_id"), "doc_id", "module"), "import", "heuristic", F.col("src_id"), F.col("dst_id"), F.col("module"))
    inherit = base_targets(parts.where("type = 'class'").select("symbol_id", "relative_path", "doc_id", F.explode("bases").alias("base")), symbols)
    inherit = edges(inherit.select(F.col("symbol_id").alias("src_id"), F.col("target").alias("dst_id"), "doc_id", "base"), "inherit", "heuristic", F.col("src_id"), F.col("dst_id"), F.col("base"))
    return {"documents": documents, "symbols": symbols, "occurrences": occurrences, "edges": contain.unionByName(imports).unionByName(inherit)}


def import_targets(imports: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, module, target: the first document whose path ends with the module's, at a path segment.
    Equi joins on every suffix of a document's module path instead of a comparison of all pairs."""
    parts = F.split(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/__init__$", ""), "/")
    ends = documents.select(F.col("doc_id").alias("target"), F.col("path").alias("target_path"), parts.alias("parts"))
    suffixes = ends.select("target", "target_path", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice("parts", F.size("parts") - n + 1, n), "."))).alias("module"))
    first = suffixes.groupBy("module").agg(F.min(F.struct("target_path", "target")).alias("t")).select("module", "t.target")
    return imports.where("module is not null and module <> ''").join(first, "module").where("doc_id <> target").select("doc_id", "module", "target").distinct()


def base_targets(bases: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol_id, base, doc_id, target: a class of the base's name in the same file, else the first symbol of that
    name (J16)."""
    here = symbols.where("kind = 'class'").groupBy(F.col("path").alias("relative_path"), F.col("display_name").alias("base")).agg(F.max("symbol_id").alias("same_file"))
    anywhere = symbols.groupBy(F.col("display_name").alias("base")).agg(F.min(F.struct("path", "start_line", "symbol_id")).alias("f")).select("base", F.col("f.symbol_id").alias("first"))
    found = bases.join(here, ["relative_path", "base"], "left").join(anywhere, "base", "left").withColumn("target", F.coalesce("same_file", "first"))
    return found.where("target is not null and target <> symbol_id").select("symbol_id", "base", "doc_id", "target")


def from_index(index: DataFrame, snapshot: str) -> dict[str, DataFrame]:
    """Facts of an indexer's nested output (G18, S10): documents array<path, language, symbols, occurrences>.
    Symbols that occur but are declared nowhere become external stubs (Q23)."""
    snap = F.lit(snapshot)
    docs = index.select(F.explode("documents").alias("d")).select("d.*").withColumn("doc_id", V.fact_id("doc", snap, F.col("path")))
    documents = docs.groupBy("doc_id").agg(F.min("path").alias("path"), F.min(F.coalesce("language", F.lit("unknown"))).alias("language"), _sources(SCIP).alias("source_set"))
    declared = docs.select("doc_id", "path", "language", F.explode("symbols").alias("s")).withColumn("symbol_id", V.scip_symbol_id(snap, F.col("s.symbol")))
    at = lambda c, i: F.get(c, i)
    own = declared.select(
        "symbol_id", F.col("s.symbol").alias("external_symbol_id"), "path", F.coalesce("s.name", "s.symbol").alias("display_name"), F.coalesce("s.kind", F.lit("symbol")).alias("kind"), F.coalesce("language", F.lit("unknown")).alias("language"),
        "s.qualified_name", "s.signature", at("s.range", 0).alias("start_line"), at("s.range", 1).alias("start_col"), at("s.range", 2).alias("end_line"), at("s.range", 3).alias("end_col"),
        F.lit(PRECISE_PRIORITY).alias("source_priority"), _sources(SCIP).alias("source_set"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("element_id"),
    ).dropDuplicates(["symbol_id"])
    seen = docs.select("doc_id", F.explode("occurrences").alias("o")).withColumn("symbol_id", V.scip_symbol_id(snap, F.col("o.symbol")))
    range_text = F.array_join(F.col("o.range").cast("array<string>"), ",")
    role = F.coalesce("o.role", F.lit("reference"))
    occurrences = seen.select(
        V.fact_id("occ", F.col("symbol_id"), F.col("doc_id"), role, range_text).alias("occurrence_id"), "symbol_id", "doc_id", role.alias("role"),
        *[F.coalesce(at("o.range", i), F.lit(0)).alias(n) for i, n in enumerate(("start_line", "start_col", "end_line", "end_col"))], F.lit(SCIP).alias("source"),
    ).dropDuplicates(["occurrence_id"])
    stubs = seen.join(own.select("symbol_id"), "symbol_id", "left_anti").select("symbol_id", F.col("o.symbol").alias("external_symbol_id"), F.lit("external").alias("kind")).dropDuplicates(["symbol_id"])
    symbols = own.unionByName(stubs.withColumn("display_name", F.col("external_symbol_id")).withColumn("path", F.lit("")).withColumn("language", F.lit("unknown")).withColumn("source_priority", F.lit(PRECISE_PRIORITY)).withColumn("source_set", _sources(SCIP)).withColumn("aliases", F.array().cast("array<string>")), allowMissingColumns=True)

    def edges(rows: DataFrame, kind: str, *key: Column) -> DataFrame:
        return rows.select(V.fact_id("edge", F.lit(kind), *key).alias("edge_id"), "src_id", "dst_id", F.lit(kind).alias("edge_type"), F.lit(SCIP).alias("source"), F.lit("precise").alias("confidence"), "doc_id", F.lit("index").alias("extractor"))

    contain = edges(declared.select(F.col("doc_id").alias("src_id"), F.col("symbol_id").alias("dst_id"), "doc_id").distinct(), "contain", F.col("src_id"), F.col("dst_id"))
    refs = occurrences.where(F.col("role").isin(*REFERENCE_ROLES)).select(F.col("doc_id").alias("src_id"), F.col("symbol_id").alias("dst_id"), "doc_id").distinct()
    return {"documents": documents, "symbols": symbols, "occurrences": occurrences, "edges": contain.unionByName(edges(refs, "ref", F.col("src_id"), F.col("dst_id")))}


# -- merge ------------------------------------------------------------------------
def merge_documents(*tables: DataFrame) -> DataFrame:
    """One document per id, with the union of its sources."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return both.groupBy("doc_id").agg(F.min("path").alias("path"), F.min("language").alias("language"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_set")))).alias("source_set"))


_KEY = ("path", "display_name", "kind")


def merge_symbols(ast: DataFrame, precise: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, canonical): on equal (path, name, kind, start_line, nulls equal) the precise symbol stays and takes
    the parser's id as an alias and its sources; other symbols stay as they are (J17). canonical: symbol_id, canonical_id."""
    key = lambda t: [F.coalesce(t[c], F.lit("")).alias(f"k_{c}") for c in _KEY] + [F.coalesce(t["start_line"], F.lit(-1)).alias("k_line")]
    names = [f"k_{c}" for c in _KEY] + ["k_line"]
    keyed = precise.select("symbol_id", *key(precise)).groupBy(*names).agg(F.max("symbol_id").alias("canonical_id"))
    matched = ast.select("symbol_id", F.col("source_set").alias("own_sources"), F.col("element_id").alias("own_element"), *key(ast)).join(keyed, names).select("symbol_id", "canonical_id", "own_sources", "own_element")
    gained = matched.groupBy(F.col("canonical_id").alias("symbol_id")).agg(F.array_sort(F.collect_list(F.when(F.col("symbol_id") != F.col("canonical_id"), F.col("symbol_id")))).alias("more"), F.flatten(F.collect_list("own_sources")).alias("sources"), F.min("own_element").alias("element"))
    none = F.array().cast("array<string>")
    kept = precise.join(gained, "symbol_id", "left").withColumn("aliases", F.array_sort(F.array_union("aliases", F.coalesce("more", none)))).withColumn("source_set", F.array_sort(F.array_union("source_set", F.coalesce("sources", none)))).withColumn("element_id", F.coalesce("element_id", "element")).drop("more", "sources", "element")
    gaps = ast.join(matched.select("symbol_id"), "symbol_id", "left_anti")
    return kept.unionByName(gaps, allowMissingColumns=True), matched.select("symbol_id", "canonical_id")


def canonical_of(column: str, rows: DataFrame, canonical: DataFrame) -> DataFrame:
    """rows with the canonical id in place of a symbol's."""
    to = canonical.select(F.col("symbol_id").alias("__from"), F.col("canonical_id").alias("__to"))
    return rows.join(to, rows[column] == to["__from"], "left").withColumn(column, F.coalesce("__to", column)).drop("__from", "__to")


def merge_occurrences(ast: DataFrame, precise: DataFrame, canonical: DataFrame) -> DataFrame:
    """One occurrence per symbol, document, role and range; the precise one of equals."""
    both = precise.withColumn("__rank", F.lit(0)).unionByName(ast.withColumn("__rank", F.lit(1)))
    place = ("symbol_id", "doc_id", "role", "start_line", "start_col", "end_line", "end_col")
    order = Window.partitionBy(*place).orderBy("__rank", "occurrence_id")
    return canonical_of("symbol_id", both, canonical).withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r", "__rank")


def merge_edges(ast: DataFrame, precise: DataFrame, canonical: DataFrame) -> DataFrame:
    """All edges of both, both ends canonical, none dropped."""
    return canonical_of("dst_id", canonical_of("src_id", ast.unionByName(precise), canonical), canonical)


def merge(ast: dict[str, DataFrame], precise: dict[str, DataFrame] | None) -> dict[str, DataFrame]:
    """Both bundles as one; its inputs stay as they are (Q22)."""
    if precise is None:
        return ast
    symbols, canonical = merge_symbols(ast["symbols"], precise["symbols"])
    return {
        "documents": merge_documents(ast["documents"], precise["documents"]), "symbols": symbols,
        "occurrences": merge_occurrences(ast["occurrences"], precise["occurrences"], canonical), "edges": merge_edges(ast["edges"], precise["edges"], canonical),
    }


# -- checks -----------------------------------------------------------------------
def validate(facts: dict[str, DataFrame]) -> DataFrame:
    """rule, detail of each violation of the eleven integrity rules (J20); edges may end in documents and symbols."""
    documents, symbols, occurrences, edges = (facts[k] for k in ("documents", "symbols", "occurrences", "edges"))
    ids, names = documents.select(F.col("doc_id").alias("i")).distinct(), symbols.select(F.col("symbol_id").alias("i")).distinct()
    nodes = ids.union(names).distinct()

    def empty(table: DataFrame, what: str) -> DataFrame:
        return table.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(f"snapshot must contain at least one {what}").alias("rule"), F.lit("").alias("detail"))

    def repeated(table: DataFrame, column: str, rule: str) -> DataFrame:
        return table.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.col(column).cast("string").alias("detail"))

    def missing(table: DataFrame, column: str, known: DataFrame, rule: str, shown: Column) -> DataFrame:
        return table.join(known, table[column] == known["i"], "left_anti").select(F.lit(rule).alias("rule"), shown.cast("string").alias("detail"))

    def blank(table: DataFrame, column: str, rule: str, shown: str) -> DataFrame:
        return table.where(F.coalesce(F.col(column), F.lit("")) == "").select(F.lit(rule).alias("rule"), F.col(shown).alias("detail"))

    arrow = lambda end: F.concat_ws(" -> ", "edge_id", end)
    return reduce(DataFrame.union, [
        empty(documents, "document"), empty(symbols, "symbol"),
        repeated(documents, "doc_id", "duplicate document id"), repeated(documents, "path", "duplicate document path"), repeated(symbols, "symbol_id", "duplicate symbol id"),
        missing(occurrences, "doc_id", ids, "occurrence references missing doc_id", F.col("doc_id")), missing(occurrences, "symbol_id", names, "occurrence references missing symbol_id", F.col("symbol_id")),
        missing(edges, "src_id", nodes, "edge src not found", arrow("src_id")), missing(edges, "dst_id", nodes, "edge dst not found", arrow("dst_id")),
        blank(edges, "source", "edge source missing", "edge_id"), blank(edges, "confidence", "edge confidence missing", "edge_id"),
        symbols.where(F.coalesce(F.size("source_set"), F.lit(0)) <= 0).select(F.lit("symbol provenance missing").alias("rule"), F.col("symbol_id").alias("detail")),
    ])


# -- aliases ------------------------------------------------------------------------
def alias_index(symbols: DataFrame) -> DataFrame:
    """alias, canonical_id of every alias and of each id itself."""
    return symbols.select(F.explode(F.array_union(F.array("symbol_id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"), F.col("symbol_id").alias("canonical_id")).distinct()


def aliases_of(symbols: DataFrame) -> DataFrame:
    """canonical_id, aliases sorted."""
    return alias_index(symbols).groupBy("canonical_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def symbols_by(symbols: DataFrame, column: str) -> DataFrame:
    """Ids by name or path."""
    return symbols.groupBy(column).agg(F.array_sort(F.collect_set("symbol_id")).alias("symbol_ids"))


def resolve(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """asked (ask_id, symbol_id, name, path) with canonical_id: by alias, else the least id of that name, else of
    that path (J21)."""
    by_alias = alias_index(symbols).groupBy("alias").agg(F.min("canonical_id").alias("c1"))
    by_name = symbols.groupBy(F.col("display_name").alias("n")).agg(F.min("symbol_id").alias("c2"))
    by_path = symbols.groupBy(F.col("path").alias("p")).agg(F.min("symbol_id").alias("c3"))
    x = asked.join(by_alias, asked["symbol_id"] == by_alias["alias"], "left").join(by_name, asked["name"] == by_name["n"], "left").join(by_path, asked["path"] == by_path["p"], "left")
    return x.select(*asked.columns, F.coalesce("c1", "c2", "c3").alias("canonical_id"))


def element_bridge(symbols: DataFrame) -> DataFrame:
    """element_id, symbol_id: which canonical symbol an element became."""
    return symbols.where("element_id is not null").groupBy("element_id").agg(F.min("symbol_id").alias("symbol_id"))


def source_refs(nodes: DataFrame, documents: DataFrame, symbols: DataFrame, snapshot: DataFrame) -> DataFrame:
    """node, ref of projected nodes: the symbol's place, else the document, else unknown, with repository and commit
    (Z23). snapshot: one row of repo_name, commit_id."""
    s = symbols.select(F.col("symbol_id").alias("node"), F.struct(F.lit("symbol").alias("kind"), "path", "start_line", "end_line").alias("s"))
    d = documents.select(F.col("doc_id").alias("node"), F.struct(F.lit("document").alias("kind"), "path", F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line")).alias("d"))
    none = F.struct(F.lit("unknown").alias("kind"), F.lit("").alias("path"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    x = nodes.join(s, "node", "left").join(d, "node", "left").crossJoin(F.broadcast(snapshot.select("repo_name", "commit_id").limit(1)))
    return x.select("node", F.struct("repo_name", "commit_id", F.coalesce("s", "d", none).alias("at")).alias("ref"))


# -- lineage ------------------------------------------------------------------------
def lineage(snapshot: DataFrame, manifest: DataFrame, documents: DataFrame, symbols: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of what a publication came from (G16): repository, branch, commit, snapshot, manifest, run,
    documents and symbols. snapshot: snapshot_id, repo_name, branch, commit_id; manifest: manifest_id, snapshot_id,
    index_run_id, previous_manifest_id; commits: commit_id, parent_id."""
    one = snapshot.join(manifest, "snapshot_id", "left")

    def node(rows: DataFrame, kind: str, key: Column, *props: Column) -> DataFrame:
        bag = F.to_json(F.struct(*(props or (key.alias("id"),))))
        return rows.where(key.isNotNull()).select(F.concat(F.lit(f"{kind}:"), key).alias("id"), F.lit(kind).alias("type"), bag.alias("props")).distinct()

    def edge(rows: DataFrame, kind: str, a: str, src: Column, b: str, dst: Column) -> DataFrame:
        return rows.where(src.isNotNull() & dst.isNotNull()).select(F.lit(kind).alias("type"), F.concat(F.lit(f"{a}:"), src).alias("src"), F.concat(F.lit(f"{b}:"), dst).alias("dst")).distinct()

    c = F.col
    version = lambda i: F.concat_ws("@", i, "snapshot_id")
    docs, syms = documents.crossJoin(F.broadcast(snapshot.select("snapshot_id").limit(1))), symbols.crossJoin(F.broadcast(snapshot.select("snapshot_id").limit(1)))
    first = documents.groupBy("path").agg(F.min("doc_id").alias("doc_id"))  # a document defines the symbols of its path (J33)
    defined = syms.join(first, "path")
    nodes = reduce(DataFrame.union, [
        node(one, "Repository", c("repo_name")), node(one, "Branch", F.concat_ws("/", "repo_name", "branch")), node(one, "Commit", c("commit_id")), node(one, "Snapshot", c("snapshot_id")), node(one, "Manifest", c("manifest_id")),
        node(one, "IndexRun", c("index_run_id")), node(docs, "DocumentVersion", version("doc_id"), c("path"), c("language")), node(syms, "SymbolVersion", version("symbol_id"), c("display_name"), c("kind")),
    ])
    edges = reduce(DataFrame.union, [
        edge(one, "repository_snapshot", "Repository", c("repo_name"), "Snapshot", c("snapshot_id")), edge(one, "branch_commit", "Branch", F.concat_ws("/", "repo_name", "branch"), "Commit", c("commit_id")),
        edge(commits, "commit_parent", "Commit", c("commit_id"), "Commit", c("parent_id")), edge(one, "snapshot_manifest", "Snapshot", c("snapshot_id"), "Manifest", c("manifest_id")),
        edge(one, "manifest_supersedes", "Manifest", c("manifest_id"), "Manifest", c("previous_manifest_id")), edge(one, "manifest_run", "Manifest", c("manifest_id"), "IndexRun", c("index_run_id")),
        edge(docs, "snapshot_document", "Snapshot", c("snapshot_id"), "DocumentVersion", version("doc_id")), edge(defined, "document_symbol", "DocumentVersion", version("doc_id"), "SymbolVersion", version("symbol_id")),
    ])
    return nodes, edges
