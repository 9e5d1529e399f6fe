"""Name resolution as joins: modules, imports, exports, inheritance, callers and callees.

Lookups that would compare all pairs are rewritten to equi joins on a computed key. "First" and "last" go by
an explicit ord column, never by arrival.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals

from ..functions import text as T


# -- maps -----------------------------------------------------------------------------
def module_map(files: DataFrame) -> DataFrame:
    """module, file_id, repo_name: the last file of a module path (J01). files: id, relative_path, repo_name, ord."""
    x = files.select(T.module_name(F.col("relative_path")).alias("module"), "repo_name", "id", "ord")
    return x.groupBy("repo_name", "module").agg(F.max_by("id", "ord").alias("file_id"))


def export_map(elements: DataFrame) -> DataFrame:
    """repo_name, module, symbol, id: classes, functions and, as Class.method too, methods; the last of a name."""
    module = T.module_name(F.col("relative_path"))
    own = elements.where(F.col("type").isin("class", "function", "method")).withColumn("module", module)
    plain = own.select("repo_name", "module", F.col("name").alias("symbol"), "id", "ord")
    dotted = own.where("class_name is not null").select("repo_name", "module", F.concat_ws(".", "class_name", "name").alias("symbol"), "id", "ord")
    return plain.unionByName(dotted).groupBy("repo_name", "module", "symbol").agg(F.max_by("id", "ord").alias("id"))


def map_stats(modules: DataFrame, exports: DataFrame) -> DataFrame:
    """modules, exports, modules_with_exports, coverage."""
    m, e = modules.agg(F.count(F.lit(1)).alias("modules")), exports.agg(F.count(F.lit(1)).alias("exports"), F.countDistinct("repo_name", "module").alias("modules_with_exports"))
    return m.crossJoin(e).withColumn("coverage", F.when(F.col("modules") > 0, F.col("modules_with_exports") / F.col("modules")).otherwise(0.0))


def map_problems(modules: DataFrame, exports: DataFrame, files: DataFrame) -> DataFrame:
    """problem, detail: exports of unknown modules, modules of unknown files, files with two modules."""
    a = exports.select("repo_name", "module").subtract(modules.select("repo_name", "module")).select(F.lit("export of unknown module").alias("problem"), F.col("module").alias("detail"))
    b = modules.join(files.select(F.col("id").alias("file_id")), "file_id", "left_anti").select(F.lit("module of unknown file"), F.col("module"))
    c = modules.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("file with several modules"), F.col("file_id").cast("string"))
    return a.union(b).union(c)


def exports_of(exports: DataFrame, module: str) -> DataFrame:
    """What a module exports."""
    return exports.where(F.col("module") == module).select("symbol", "id")


# -- imports ----------------------------------------------------------------------------
def import_key(module: Column, name: Column, level: Column, importer: Column, is_package: Column) -> Column:
    """The absolute module path that an import means: itself at level 0, else the importer's path without its last
    level parts (one less in a package) and the name behind (J03, J04, Z14)."""
    parts = F.split(importer, r"\.")
    strip = F.when(is_package, level - 1).otherwise(level)
    base = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - strip, F.lit(0)))
    relative = F.array_join(F.filter(F.concat(base, F.array(F.coalesce(name, F.lit("")))), lambda p: p != ""), ".")
    return F.when(F.coalesce(level, F.lit(0)) == 0, module).when(strip > F.size(parts), F.lit(None)).otherwise(relative)


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """imports with target_file; without one the import is third-party (J03, J04). imports: importer_id, repo_name,
    importer_module, is_package, module, level. A from-import of a name that is itself a module means that module."""
    own = imports.withColumn("key", import_key(F.col("module"), F.col("module"), F.col("level"), F.col("importer_module"), F.col("is_package")))
    return own.join(modules.select("repo_name", F.col("module").alias("key"), F.col("file_id").alias("target_file")), ["repo_name", "key"], "left")


def dependency_edges(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """src, dst of files of one repository, none to itself (J07). What no exact module matches is tried by its last
    parts, so that a prefix outside the repository doesn't matter (J08): an equi join on suffixes."""
    exact = resolve_imports(imports, modules)
    hit = exact.where("target_file is not null").select(F.col("importer_id").alias("src"), F.col("target_file").alias("dst"))
    rest = exact.where("target_file is null and key is not null").drop("target_file")
    parts = F.split("module", r"\.")
    ends = modules.select("repo_name", "file_id", "module", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))).alias("key"))
    first = ends.groupBy("repo_name", "key").agg(F.min_by("file_id", "module").alias("target_file"))
    loose = rest.join(first, ["repo_name", "key"]).select(F.col("importer_id").alias("src"), F.col("target_file").alias("dst"))
    return hit.unionByName(loose).where("src <> dst").distinct()


def imported_name(symbol: Column, name: Column, alias: Column) -> Column:
    """Whether an import gives the symbol: its name or alias, or a part of what they name (J06). As an equi join:
    the symbol's first part is the alias or name."""
    own = F.coalesce(alias, name)
    return (symbol == own) | F.startswith(symbol, F.concat(own, F.lit(".")))


def resolve_symbols(uses: DataFrame, elements: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """uses (use_id, file_id, repo_name, symbol) with target: a definition of the same file, else what the first
    fitting import exports (J05, Q13). imports: file_id, repo_name, target_module, name, alias, pos."""
    local = elements.groupBy("file_id", F.col("name").alias("symbol")).agg(F.min_by("id", "ord").alias("local"))
    head = F.substring_index(F.col("symbol"), ".", 1)
    given = imports.withColumn("head", F.substring_index(F.coalesce("alias", "name"), ".", 1))
    tried = uses.withColumn("head", head).join(given, ["file_id", "repo_name", "head"]).where(imported_name(F.col("symbol"), F.col("name"), F.col("alias")))
    # import m; m.f means the export f of m; from m import f means f; f.g means the method g of f
    bound = F.coalesce("alias", "name")
    tail = F.substr(F.col("symbol"), F.length(bound) + 2)
    inner = F.when(F.col("is_module"), tail).when(tail == "", F.col("name")).otherwise(F.concat_ws(".", "name", tail))
    tried = tried.withColumn("symbol_in_module", inner).join(exports.select("repo_name", F.col("module").alias("target_module"), F.col("symbol").alias("symbol_in_module"), F.col("id").alias("__id")), ["repo_name", "target_module", "symbol_in_module"])
    through = tried.groupBy("use_id").agg(F.min_by("__id", "pos").alias("imported"))
    x = uses.join(local, ["file_id", "symbol"], "left").join(through, "use_id", "left")
    return x.withColumn("target", F.coalesce("local", "imported")).withColumn("how", F.when(F.col("local").isNotNull(), "local").when(F.col("imported").isNotNull(), "import")).drop("local", "imported")


def resolution_stats(resolved: DataFrame) -> DataFrame:
    return resolved.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("how") == "local").alias("local"), F.count_if(F.col("how") == "import").alias("imported"), F.count_if(F.col("target").isNull()).alias("unresolved"))


# -- inheritance --------------------------------------------------------------------------
def inheritance_edges(classes: DataFrame, resolved: DataFrame) -> DataFrame:
    """src, dst from a class to each base: as resolved, else the first class of that name in the repository.
    classes: id, repo_name, name, bases, ord; resolved: class_id, base, target."""
    wanted = classes.select(F.col("id").alias("class_id"), "repo_name", F.explode("bases").alias("base"))
    first = classes.groupBy("repo_name", F.col("name").alias("last")).agg(F.min_by("id", "ord").alias("fallback"))
    x = wanted.join(resolved.select("class_id", "base", "target"), ["class_id", "base"], "left").withColumn("last", F.substring_index("base", ".", -1)).join(first, ["repo_name", "last"], "left")
    return x.select(F.col("class_id").alias("src"), F.coalesce("target", "fallback").alias("dst")).where("dst is not null and src <> dst").distinct()


# -- calls ----------------------------------------------------------------------------------
def innermost_scope(calls: DataFrame, scopes: DataFrame) -> DataFrame:
    """calls (call_id, file_path, position) with the scope that starts last among those around (J14), by one sweep over a
    file's calls and scopes in their order."""
    spans = scopes.select("file_path", F.col("scope_id").alias("span_id"), F.col("start_byte").alias("start"), F.col("end_byte").alias("end"))
    found = intervals.innermost(calls.select("file_path", F.col("call_id").alias("point_id"), "position"), spans)
    return calls.join(found.select(F.col("point_id").alias("call_id"), F.col("span_id").alias("scope_id")), "call_id", "left")


def callers(calls: DataFrame, elements: DataFrame) -> DataFrame:
    """calls with caller_id: the element of the scope's type, name and class in the file, else the file itself.
    scope_id: type::name; a method is a function with a class."""
    kind, name = F.substring_index("scope_id", "::", 1), F.substring_index("scope_id", "::", -1)
    scope_kind = F.when(kind == "method", "function").otherwise(kind)
    around = F.when(kind == "method", F.col("class_around")).otherwise("")
    parts = elements.where("type <> 'file'").withColumn("scope_class", F.coalesce("class_name", F.lit("")))
    named = parts.groupBy("file_path", F.when(F.col("type") == "method", "function").otherwise(F.col("type")).alias("scope_kind"), F.col("name").alias("scope_name"), "scope_class").agg(F.min_by("id", "ord").alias("in_scope"))
    files = elements.where("type = 'file'").groupBy("file_path").agg(F.min("id").alias("file_element"))
    x = calls.withColumn("scope_kind", scope_kind).withColumn("scope_name", name).withColumn("scope_class", around)
    x = x.join(named, ["file_path", "scope_kind", "scope_name", "scope_class"], "left").join(files, "file_path", "left")
    return x.withColumn("caller_id", F.coalesce("in_scope", "file_element")).drop("scope_kind", "scope_name", "scope_class", "in_scope", "file_element")


def instance_calls(calls: DataFrame, types: DataFrame, elements: DataFrame) -> DataFrame:
    """call_id, callee_id of variable.method(): the variable's class by its scope, else by __init__, else by the
    module; then that class's method, else a function of its file, else the class (J12).
    types: file_path, scope_id, variable, class_name; calls: call_id, file_path, scope_id, base_object, call_name."""
    of = lambda scope, name: types.where(scope).groupBy("file_path", F.col("variable").alias("base_object")).agg(F.min("class_name").alias(name))
    own = types.groupBy("file_path", "scope_id", F.col("variable").alias("base_object")).agg(F.min("class_name").alias("c1"))
    init, module = of(F.endswith("scope_id", F.lit("__init__")), "c2"), of(F.col("scope_id").isNull(), "c3")
    x = calls.join(own, ["file_path", "scope_id", "base_object"], "left").join(init, ["file_path", "base_object"], "left").join(module, ["file_path", "base_object"], "left")
    x = x.withColumn("class_name", F.coalesce("c1", "c2", "c3")).where("class_name is not null").select("call_id", "class_name", "call_name")
    classes = elements.where("type = 'class'").select(F.col("name").alias("class_name"), F.col("id").alias("class_id"), F.col("file_path").alias("class_file"))
    methods = elements.where("class_name is not null").groupBy("class_name", F.col("name").alias("call_name"), F.col("file_path").alias("class_file")).agg(F.min_by("id", "ord").alias("method"))
    functions = elements.where("type in ('function', 'method')").groupBy(F.col("file_path").alias("class_file"), F.col("name").alias("call_name")).agg(F.min_by("id", "ord").alias("function"))
    x = x.join(classes, "class_name").join(methods, ["class_name", "call_name", "class_file"], "left").join(functions, ["class_file", "call_name"], "left")
    return x.select("call_id", F.coalesce("method", "function", "class_id").alias("callee_id")).distinct()


def callees(calls: DataFrame, elements: DataFrame, imports: DataFrame, exports: DataFrame, types: DataFrame) -> DataFrame:
    """call_id, callee_id: plain and module-qualified names by resolve_symbols(), self.m by the class around, other
    objects by instance_calls() (J11). calls: call_id, file_id, file_path, repo_name, scope_id, class_around,
    base_object, call_name."""
    is_self = F.col("base_object").isin("self", "cls")
    symbol = F.when(F.col("base_object").isNull(), F.col("call_name")).otherwise(F.concat_ws(".", "base_object", "call_name"))
    named = resolve_symbols(calls.where(~F.coalesce(is_self, F.lit(False))).select(F.col("call_id").alias("use_id"), "file_id", "repo_name", symbol.alias("symbol")), elements, imports, exports)
    found = named.where("target is not null").select(F.col("use_id").alias("call_id"), F.col("target").alias("callee_id"))
    own = elements.where("class_name is not null").groupBy("file_path", F.col("class_name").alias("class_around"), F.col("name").alias("call_name")).agg(F.min_by("id", "ord").alias("callee_id"))
    mine = calls.where(is_self).join(own, ["file_path", "class_around", "call_name"]).select("call_id", "callee_id")
    left = calls.where(F.col("base_object").isNotNull() & ~is_self).join(found.select("call_id"), "call_id", "left_anti")
    return reduce(DataFrame.unionByName, [found, mine, instance_calls(left, types, elements)]).distinct()


def call_edges(calls: DataFrame, elements: DataFrame, imports: DataFrame, exports: DataFrame, types: DataFrame) -> DataFrame:
    """src, dst, calls of the call graph (J13), to be fed into the facts' edges as type call (Q3)."""
    return callers(calls, elements).join(callees(calls, elements, imports, exports, types), "call_id").where("caller_id is not null and caller_id <> callee_id").groupBy(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")).agg(F.count(F.lit(1)).alias("calls"))


def call_stats(kept: DataFrame, dropped: DataFrame) -> DataFrame:
    """total, kept, filtered and their shares in percent."""
    x = kept.agg(F.count(F.lit(1)).alias("kept")).crossJoin(dropped.agg(F.count(F.lit(1)).alias("filtered")))
    total = F.col("kept") + F.col("filtered")
    share = lambda c: F.when(total > 0, F.col(c) * 100.0 / total).otherwise(0.0)
    return x.select(total.alias("total"), "kept", "filtered", share("kept").alias("kept_pct"), share("filtered").alias("filtered_pct"))


def related_elements(elements: DataFrame, nodes: DataFrame, bridge: DataFrame, documents: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """Elements of graph nodes (node): by the bridge of ids; a document node's file elements by its path; symbols that the
    bridge lacks by path and name (J28, Q4). Equi joins on paths, which both sides hold relative to the repository."""
    asked = nodes.select("node").distinct()
    ids = bridge.join(asked.withColumnRenamed("node", "symbol_id"), "symbol_id", "left_semi").select(F.col("element_id").alias("id"))
    if documents is not None:
        paths = documents.join(asked.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").select(F.col("path").alias("relative_path")).distinct()
        ids = ids.union(elements.where("type = 'file'").join(paths, "relative_path", "left_semi").select("id"))
    if symbols is not None:
        rest = symbols.join(asked.withColumnRenamed("node", "symbol_id"), "symbol_id", "left_semi").join(bridge.select("symbol_id"), "symbol_id", "left_anti")
        ids = ids.union(elements.join(rest.select(F.col("path").alias("relative_path"), F.col("display_name").alias("name")).distinct(), ["relative_path", "name"], "left_semi").select("id"))
    return elements.join(ids.distinct(), "id", "left_semi")


def file_of_module(modules: DataFrame, module: str) -> DataFrame:
    """repo_name, file_id of a module."""
    return modules.where(F.col("module") == module).select("repo_name", "file_id")


def latest_first(rows: DataFrame, keys: list[str], ord_col: str = "ord") -> DataFrame:
    """The first row of each key by ord."""
    w = Window.partitionBy(*keys).orderBy(ord_col)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
