"""Registered queries over source code made by rule from the documents: parsing, resolution, facts, answers and stores.

Each document stands for one Python file whose text follows from its id, so that SQL can say what parsers must find.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import text as T
from .functions import values as V
from .operators import facts as X
from .operators import graph as G
from .operators import overview as O
from .operators import parsing as P
from .operators import projection
from .operators import resolve as R
from .operators import retrieval as Q
from .operators import selection as S
from .operators import versions as W
from .queries import _BIPARTITE, _ELEMENTS, _PATH, _ROUTED, _bipartite, _files, _routed, documents, elements, registered, table

def _none() -> Column:
    return F.lit(None).cast("string")


# -- source by rule --------------------------------------------------------------------
_NUMBERS = {"a": "doc_id % 10", "b": "doc_id % 37", "c": "doc_id * 3 % 37", "e": "doc_id % 7", "k": "doc_id % 50", "l": "doc_id % 11", "n": "(doc_id + 1) % 50", "d": "doc_id"}
_PYTHON = '''import os
import pkg{a}.mod{b} as m
from .mod{c} import f{e} as g

class C{k}(B{l}, Base):
    """Holds {k}."""
    def run(self, x: int) -> str:
        if x and self.y:
            return helper(x)
        obj = C{n}()
        return obj.run(x)

async def f{e}(a, b=1):
    for i in a:
        print(i)
    return m.g(a)
'''


def _rendered(template: str, **fixed: Column) -> Column:
    parts = re.split(r"\{(\w+)\}", template.replace("{{", "\x01").replace("}}", "\x02"))
    plain = lambda s: s.replace("\x01", "{").replace("\x02", "}")
    return F.concat(*[F.lit(plain(p)) if i % 2 == 0 else fixed[p] if p in fixed else F.expr(f"cast({_NUMBERS[p]} as string)") for i, p in enumerate(parts)])


def _rendered_sql(template: str) -> str:
    """The same in SQL; also for short texts such as names."""
    parts = re.split(r"\{(\w+)\}", template)
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return " || ".join(quoted(p) if i % 2 == 0 else f"({_NUMBERS[p]})::varchar" for i, p in enumerate(parts) if i % 2 or p)


_FILE = "source || '/' || doc_id || '.py'"
_n = _rendered_sql


def _python_files(spark, sf_dir):
    return documents(spark, sf_dir).select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".py"))).alias("path"), _rendered(_PYTHON).alias("content"), F.lit("python").alias("language"))


@registered(f"""select {_FILE} as path, 'class' as kind, {_n('C{k}')} as name, 5 as start_line, 11 as end_line, '' as parameters, null::varchar as return_type, false as is_async, null::varchar as class_name, {_n('B{l},Base')} as bases, null::int as complexity, {_n('Holds {k}.')} as docstring, {_n('class C{k}(B{l}, Base):')} as header from documents
    union all select {_FILE}, 'method', 'run', 7, 11, 'self,x: int', 'str', false, {_n('C{k}')}, '', 3, null, 'def run(self, x: int) -> str:' from documents
    union all select {_FILE}, 'function', {_n('f{e}')}, 13, 16, 'a,b', null, true, null, '', 2, null, {_n('async def f{e}(a, b=1):')} from documents""")
def parse_definitions(spark, sf_dir):
    rows = P.definitions(_python_files(spark, sf_dir))
    return rows.select("path", "kind", "name", "start_line", "end_line", F.array_join("parameters", ",").alias("parameters"), "return_type", "is_async", "class_name", F.array_join("bases", ",").alias("bases"), "complexity", "docstring", "header")


@registered(f"""select {_FILE} as path, 'os' as module, 'os' as names, false as is_from, 1 as line, 0 as level, null::varchar as alias from documents
    union all select {_FILE}, {_n('pkg{a}.mod{b}')}, {_n('pkg{a}.mod{b}')}, false, 2, 0, 'm' from documents union all select {_FILE}, {_n('mod{c}')}, {_n('f{e}')}, true, 3, 1, 'g' from documents""")
def parse_imports(spark, sf_dir):
    return P.imports(_python_files(spark, sf_dir)).select("path", "module", F.array_join("names", ",").alias("names"), "is_from", "line", "level", "alias")


@registered(f"""select {_FILE} as path, 'helper' as call_name, null::varchar as base_object, 'simple' as call_type, 'method::run' as scope_id, {_n('C{k}')} as class_around, 9 as line from documents
    union all select {_FILE}, {_n('C{n}')}, null, 'simple', 'method::run', {_n('C{k}')}, 10 from documents union all select {_FILE}, 'run', 'obj', 'attribute', 'method::run', {_n('C{k}')}, 11 from documents
    union all select {_FILE}, 'g', 'm', 'attribute', {_n('function::f{e}')}, null, 16 from documents""")
def parse_calls(spark, sf_dir):
    """All calls but those of built-in functions."""
    return P.calls(_python_files(spark, sf_dir)).select("path", "call_name", "base_object", "call_type", "scope_id", "class_around", "line")


@registered(f"""with s as (select {_FILE} as path, {_n(_PYTHON)} as t, {_n('class::C{k}')} as c, {_n('function::f{e}')} as f from documents)
    select path, c as scope_id, strpos(t, 'class C') - 1 as start_byte, strpos(t, chr(10) || 'async') - 2 as end_byte from s
    union all select path, 'function::run', strpos(t, 'def run') - 1, strpos(t, chr(10) || 'async') - 2 from s union all select path, f, strpos(t, 'async') - 1, length(t) - 1 from s""")
def parse_scopes(spark, sf_dir):
    return P.scopes(_python_files(spark, sf_dir)).select("path", "scope_id", F.col("start_byte").cast("long").alias("start_byte"), F.col("end_byte").cast("long").alias("end_byte"))


@registered(f"select {_FILE} as path, 'function::run' as scope_id, 'obj' as variable, {_n('C{n}')} as class_name from documents")
def parse_instance_types(spark, sf_dir):
    return P.instance_types(_python_files(spark, sf_dir)).select("path", "scope_id", "variable", "class_name")


@registered(f"""with e as (select {_FILE} as p, * from documents), k as (select p, 'file' as type, doc_id || '.py' as name, 1 as start_line, 16 as end_line, ['r', 'file', p] as key from e
    union all select p, 'class', {_n('C{k}')}, 5, 11, ['r', 'class', p, {_n('C{k}')}] from e union all select p, 'function', 'run', 7, 11, ['r', 'function', p, {_n('C{k}')}, 'run'] from e
    union all select p, 'function', {_n('f{e}')}, 13, 16, ['r', 'function', p, {_n('f{e}')}] from e)
    select 'r_' || type || '_' || left(md5(array_to_string(key, '/')), 16) as id, type, name, start_line, end_line from k""")
def parsed_elements(spark, sf_dir):
    return P.elements(_python_files(spark, sf_dir).drop("language"), "r").select("id", "type", "name", "start_line", "end_line")


@registered(f"""select {_FILE} as path, 1 as line_number, 'import' as kind, 'os' as name from documents union all select {_FILE}, 2, 'import', {_n('pkg{a}.mod{b}')} from documents union all select {_FILE}, 3, 'import', {_n('.mod{c}')} from documents
    union all select {_FILE}, 5, 'class', {_n('C{k}')} from documents union all select {_FILE}, 7, 'function', 'run' from documents union all select {_FILE}, 13, 'function', {_n('f{e}')} from documents""")
def structure_summaries(spark, sf_dir):
    return P.structure_summary(_python_files(spark, sf_dir))


#: extension -> source with each document's whole text in it: {text} in a comment, {quoted} in a text of the language.
_BRACES = {
    "js": """import x, {{ y }} from 'm{b}';
/* {text} */
class K{k} extends B {{ m{e}() {{ return /["{{]/; }} n(b) {{ return `{quoted}`; }} }}
""",
    "ts": """import type {{ A }} from 'm{b}';
/* {text} */
export const g{e} = <T,>(x: T) => x;
abstract class K{k}<P> extends B<P> {{
  private h = async (e: E): Promise<void> => {{ use(`{quoted}`); }};
  abstract later{d}(x: number): void;
}}
""",
    "cpp": """#include <m{b}>
/* {text} */
static int f{e}(int a,
    int b)
{{
  return R"doc({quoted})doc"[a];
}}
class K{k} : public B {{
  K{k}(int n) : x{{n}} {{ }}
  int m{d}() const {{ return '{{'; }}
  int x;
}};
""",
    "rs": """use a::m{b};
/* outer /* {text} */ {{ */
pub struct K{k}<T>(T);
impl<T> K{k}<T> {{
  pub fn f{e}(&self, s: &'a str) -> i32 {{
    let t = r##"{quoted}"##; '{{'
  }}
}}
trait S{d} {{ fn need(&self); }}
""",
    "cs": """using A.m{b};
namespace N {{
/* {text} */
class K{k} : B {{
  K{k}(int a) {{ }}
  int m{e}(string s) {{ return @"{quoted}"; }}
  int X => 1;
}}
}}
""",
}
#: extension -> how a text is written in it.
_WRITTEN = {"js": (r"[\\`$]", r"\\$0"), "ts": (r"[\\`$]", r"\\$0"), "cpp": (r'\)doc"', ") doc"), "rs": ('"##', '" ##'), "cs": ('"', '""')}


def _brace_files(spark, sf_dir):
    """Each document is read once and gives a file in each language."""
    whole = F.coalesce("text", F.lit(""))
    ways = list(dict.fromkeys(_WRITTEN.values()))
    d = documents(spark, sf_dir).select("doc_id", F.regexp_replace(whole, r"\*/|/\*", "* /").alias("plain"), *[F.regexp_replace(whole, *w).alias(f"quoted_{i}") for i, w in enumerate(ways)])
    files = [F.struct(F.lit(ext).alias("ext"), _rendered(template, text=F.col("plain"), quoted=F.col(f"quoted_{ways.index(_WRITTEN[ext])}")).alias("content")) for ext, template in _BRACES.items()]
    out = d.select("doc_id", F.explode(F.array(*files)).alias("f"))
    return P.with_language(out.select(F.concat_ws(".", F.col("doc_id").cast("string"), "f.ext").alias("path"), "f.content"))


#: extension, kind, name, first and last line and how often the text's lines come before each, surrounding type.
_FOUND = (
    ("js", "class", "K{k}", 3, 1, 3, 2, None), ("js", "method", "m{e}", 3, 1, 3, 1, "K{k}"), ("js", "method", "n", 3, 1, 3, 2, "K{k}"),
    ("ts", "function", "g{e}", 3, 1, 3, 1, None), ("ts", "class", "K{k}", 4, 1, 7, 2, None), ("ts", "method", "h", 5, 1, 5, 2, "K{k}"), ("ts", "method", "later{d}", 6, 2, 6, 2, "K{k}"),
    ("cpp", "function", "f{e}", 3, 1, 7, 2, None), ("cpp", "class", "K{k}", 8, 2, 12, 2, None), ("cpp", "method", "K{k}", 9, 2, 9, 2, "K{k}"), ("cpp", "method", "m{d}", 10, 2, 10, 2, "K{k}"),
    ("rs", "class", "K{k}", 3, 1, 3, 1, None), ("rs", "method", "f{e}", 5, 1, 7, 2, "K{k}"), ("rs", "class", "S{d}", 9, 2, 9, 2, None), ("rs", "method", "need", 9, 2, 9, 2, "S{d}"),
    ("cs", "class", "K{k}", 4, 1, 8, 2, None), ("cs", "method", "K{k}", 5, 1, 5, 1, "K{k}"), ("cs", "method", "m{e}", 6, 1, 6, 2, "K{k}"),
)
_LINES = "lines as (select *, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) as l from documents)"


@registered(f"with {_LINES} " + " union all ".join(
    f"select doc_id || '.{ext}' as path, '{kind}' as kind, {_n(name)} as name, {a} + {i} * l as start_line, {b} + {j} * l as end_line, {_n(of) if of else 'null::varchar'} as class_name from lines"
    for ext, kind, name, a, i, b, j, of in _FOUND))
def parse_brace_languages(spark, sf_dir):
    """JavaScript, TypeScript, C++, Rust and C#: whole documents stand in comments and texts, where their marks are no code."""
    return P.definitions(_brace_files(spark, sf_dir), ("kind", "name", "start_line", "end_line", "class_name"))


@registered(" union all ".join(f"select doc_id || '.{ext}' as path, {_n(name)} as module, 1 as line from documents" for ext, name in (("js", "m{b}"), ("ts", "m{b}"), ("cpp", "m{b}"), ("rs", "a::m{b}"), ("cs", "A.m{b}"))))
def parse_brace_imports(spark, sf_dir):
    return P.imports(_brace_files(spark, sf_dir)).select("path", "module", "line")


# -- resolution ------------------------------------------------------------------------------
_REPO = "source as repo_name"
_MODULE = "'pkg' || (doc_id % 10) || '/mod' || (doc_id % 37) || '.py'"


def _module_files(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select(F.col("doc_id").alias("id"), F.expr(_MODULE).alias("relative_path"), F.col("source").alias("repo_name"), F.col("doc_id").alias("ord"))


_MODULES = f"modules as (select source as repo_name, replace(replace({_MODULE}, '.py', ''), '/', '.') as module, max(doc_id) as file_id from documents group by all)"


@registered(f"with {_MODULES} select * from modules")
def module_map(spark, sf_dir):
    return R.module_map(_module_files(spark, sf_dir))


_EXPORTS = f"exports as (select source as repo_name, replace(replace({_MODULE}, '.py', ''), '/', '.') as module, 'f' || (doc_id % 3) as symbol, max(doc_id) as id from documents where doc_id % 4 > 0 group by all)"


def _exports(spark, sf_dir):
    e = _module_files(spark, sf_dir).where("id % 4 > 0").select("*", F.lit("function").alias("type"), F.concat(F.lit("f"), F.col("id") % 3).alias("name"), _none().alias("class_name"))
    return R.export_map(e)


@registered(f"with {_MODULES}, {_EXPORTS} select (select count(*) from modules) as modules, count(*) as exports, count(distinct (repo_name, module)) as modules_with_exports, round(count(distinct (repo_name, module)) / (select count(*) from modules), 6) as coverage from exports")
def map_stats(spark, sf_dir):
    return R.map_stats(R.module_map(_module_files(spark, sf_dir)), _exports(spark, sf_dir)).withColumn("coverage", F.round("coverage", 6))


@registered(f"""with {_MODULES}, {_EXPORTS}, known as (select * from modules where file_id % 5 > 0)
    select 'export of unknown module' as problem, module as detail from (select repo_name, module from exports except select repo_name, module from known)
    union all select 'module of unknown file', module from known where file_id % 3 = 0""")
def map_problems(spark, sf_dir):
    known = R.module_map(_module_files(spark, sf_dir)).where("file_id % 5 > 0")
    return R.map_problems(known, _exports(spark, sf_dir), documents(spark, sf_dir).where("doc_id % 3 > 0").select(F.col("doc_id").alias("id")))


@registered(f"with {_EXPORTS} select symbol, id from exports where module = 'pkg1.mod1'")
def exports_of(spark, sf_dir):
    return R.exports_of(_exports(spark, sf_dir), "pkg1.mod1")


@registered(f"with {_MODULES} select repo_name, file_id from modules where module = 'pkg1.mod1'")
def file_of_module(spark, sf_dir):
    return R.file_of_module(R.module_map(_module_files(spark, sf_dir)), "pkg1.mod1")


def _imports(spark, sf_dir):
    """One absolute import a file: of a module by its whole name, by its last part alone, or of nothing."""
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("pkg"), F.col("doc_id") % 10, F.lit(".mod"), F.col("doc_id") * 3 % 37)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("mod"), F.col("doc_id") * 3 % 37)).otherwise("numpy")
    return documents(spark, sf_dir).select(F.col("doc_id").alias("importer_id"), F.col("source").alias("repo_name"), F.lit("x.y").alias("importer_module"), F.lit(False).alias("is_package"), name.alias("module"), F.lit(0).alias("level"))


_IMPORTED = "case doc_id % 3 when 0 then 'pkg' || (doc_id % 10) || '.mod' || (doc_id * 3 % 37) when 1 then 'mod' || (doc_id * 3 % 37) else 'numpy' end"


@registered(f"""with {_MODULES}, i as (select doc_id, source as repo_name, {_IMPORTED} as m from documents), ends as (select repo_name, split_part(module, '.', 2) as m, arg_min(file_id, module) as file_id from modules group by all)
    select distinct doc_id as src, file_id as dst from (select doc_id, file_id from i join modules on modules.repo_name = i.repo_name and module = m
        union all select doc_id, file_id from i join ends on ends.repo_name = i.repo_name and ends.m = i.m) where doc_id <> file_id""")
def dependency_edges(spark, sf_dir):
    """File to file: exact modules first, then modules by their last parts."""
    return R.dependency_edges(_imports(spark, sf_dir), R.module_map(_module_files(spark, sf_dir)))


def _code_tables(spark, sf_dir):
    """elements, imports, exports, types, calls: a class Ci with a method run, a function fi and a helper per file."""
    d = documents(spark, sf_dir)
    i = F.col("doc_id").cast("string")
    name = lambda p: F.concat(F.lit(p), i)
    base = [F.col("doc_id").alias("file_id"), name("p").alias("file_path"), F.lit("r").alias("repo_name")]
    one = lambda kind, ident, label, cls, ord: d.select(*base, F.lit(kind).alias("type"), name(ident).alias("id"), label.alias("name"), cls.alias("class_name"), F.lit(ord).alias("ord"))
    parts = [one("file", "file", name("p"), _none(), 0), one("class", "class", name("C"), _none(), 1), one("method", "method", F.lit("run"), name("C"), 2), one("function", "function", name("f"), _none(), 3)]
    els = parts[0]
    for p in parts[1:]:
        els = els.union(p)
    other = F.concat(F.lit("f"), (F.col("doc_id") + 1).cast("string"))
    imports = d.select(F.col("doc_id").alias("file_id"), F.lit("r").alias("repo_name"), F.concat(F.lit("mod"), (F.col("doc_id") + 1).cast("string")).alias("target_module"), other.alias("name"), F.when(F.col("doc_id") % 2 == 0, F.lit("given")).alias("alias"), F.lit(0).alias("pos"), F.lit(False).alias("is_module"))
    exports = d.select(F.lit("r").alias("repo_name"), name("mod").alias("module"), name("f").alias("symbol"), name("function").alias("id"))
    types = d.select(name("p").alias("file_path"), F.lit("function::run").alias("scope_id"), F.lit("obj").alias("variable"), F.concat(F.lit("C"), (F.col("doc_id") + 2).cast("string")).alias("class_name"))
    call = lambda n, scope, around, obj, called: d.select(F.concat(i, F.lit(f"-{n}")).alias("call_id"), *base, scope.alias("scope_id"), around.alias("class_around"), obj.alias("base_object"), called.alias("call_name"))
    run = F.lit("method::run")
    rows = [
        call(1, run, name("C"), _none(), name("f")), call(2, F.concat(F.lit("function::f"), i), _none(), _none(), F.when(F.col("doc_id") % 2 == 0, F.lit("given")).otherwise(other)),
        call(3, run, name("C"), F.lit("self"), F.lit("run")), call(4, F.lit("function::run"), _none(), F.lit("obj"), F.lit("run")), call(5, _none(), _none(), _none(), F.lit("nothing")), call(6, F.lit("function::gone"), _none(), _none(), name("f")),
    ]
    calls = rows[0]
    for r in rows[1:]:
        calls = calls.union(r)
    return els, imports, exports, types, calls


_HAS = "(select count(*) from documents o where o.doc_id = documents.doc_id + {})"


@registered("""select call_id, caller_id from (select doc_id || '-1' as call_id, 'method' || doc_id as caller_id from documents union all select doc_id || '-2', 'function' || doc_id from documents union all select doc_id || '-3', 'method' || doc_id from documents
    union all select doc_id || '-4', 'file' || doc_id from documents union all select doc_id || '-5', 'file' || doc_id from documents union all select doc_id || '-6', 'file' || doc_id from documents)""")
def callers(spark, sf_dir):
    els, _, _, _, calls = _code_tables(spark, sf_dir)
    return R.callers(calls, els).select("call_id", "caller_id")


_USES = """uses as (select doc_id || '-1' as use_id, 'function' || doc_id as target, 'local' as how from documents union all select doc_id || '-6', 'function' || doc_id, 'local' from documents
    union all select d.doc_id || '-2', 'function' || o.doc_id, case when o.doc_id is not null then 'import' end from documents d left join documents o on o.doc_id = d.doc_id + 1 union all select doc_id || '-5', null, null from documents)"""


@registered(f"with {_USES} select use_id, target, how from uses")
def resolve_symbols(spark, sf_dir):
    els, imports, exports, _, calls = _code_tables(spark, sf_dir)
    uses = calls.where("base_object is null").select(F.col("call_id").alias("use_id"), "file_id", "repo_name", F.col("call_name").alias("symbol"))
    return R.resolve_symbols(uses, els, imports, exports).select("use_id", "target", "how")


@registered(f"with {_USES} select count(*) as total, count(*) filter (how = 'local') as local, count(*) filter (how = 'import') as imported, count(*) filter (target is null) as unresolved from uses")
def resolution_stats(spark, sf_dir):
    els, imports, exports, _, calls = _code_tables(spark, sf_dir)
    uses = calls.where("base_object is null").select(F.col("call_id").alias("use_id"), "file_id", "repo_name", F.col("call_name").alias("symbol"))
    return R.resolution_stats(R.resolve_symbols(uses, els, imports, exports))


@registered("select d.doc_id || '-4' as call_id, 'method' || o.doc_id as callee_id from documents d join documents o on o.doc_id = d.doc_id + 2")
def instance_calls(spark, sf_dir):
    els, _, _, types, calls = _code_tables(spark, sf_dir)
    return R.instance_calls(calls.where("base_object = 'obj'"), types, els)


_CALLEES = f"""{_USES}, found as (select use_id as call_id, target as callee_id from uses where target is not null union all select doc_id || '-3', 'method' || doc_id from documents
    union all select d.doc_id || '-4', 'method' || o.doc_id from documents d join documents o on o.doc_id = d.doc_id + 2)"""


@registered(f"with {_CALLEES} select call_id, callee_id from found")
def callees(spark, sf_dir):
    els, imports, exports, types, calls = _code_tables(spark, sf_dir)
    return R.callees(calls, els, imports, exports, types)


@registered(f"""with {_CALLEES}, c as (select call_id, callee_id, split_part(call_id, '-', 1) as d, case split_part(call_id, '-', 2) when '1' then 'method' when '2' then 'function' when '3' then 'method' else 'file' end as k from found)
    select k || d as src, callee_id as dst, count(*) as calls from c where k || d <> callee_id group by all""")
def call_edges(spark, sf_dir):
    els, imports, exports, types, calls = _code_tables(spark, sf_dir)
    return R.call_edges(calls, els, imports, exports, types)


@registered("select count(*) filter (doc_id % 3 > 0) + count(*) filter (doc_id % 3 = 0) as total, count(*) filter (doc_id % 3 > 0) as kept, count(*) filter (doc_id % 3 = 0) as filtered, round(count(*) filter (doc_id % 3 > 0) * 100.0 / count(*), 4) as kept_pct, round(count(*) filter (doc_id % 3 = 0) * 100.0 / count(*), 4) as filtered_pct from documents")
def call_stats(spark, sf_dir):
    d = documents(spark, sf_dir)
    return R.call_stats(d.where("doc_id % 3 > 0"), d.where("doc_id % 3 = 0")).select("total", "kept", "filtered", F.round("kept_pct", 4).alias("kept_pct"), F.round("filtered_pct", 4).alias("filtered_pct"))


# -- facts ---------------------------------------------------------------------------------------
def _fact_documents(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.expr(f"source || '/' || {_MODULE}").alias("path"))


@registered(f"""with docs as (select doc_id::varchar as target, source || '/' || {_MODULE} as path from documents), parts as (select target, path, string_split(replace(path, '.py', ''), '/') as p from docs),
    ends as (select target, path, array_to_string(p[len(p) - n + 1 :], '.') as module from parts, (values (1), (2), (3)) as v(n)), first as (select module, arg_min(target, (path, target)) as target from ends group by module)
    select distinct i.doc_id::varchar as doc_id, i.module, target from (select doc_id, {_IMPORTED} as module from documents) i join first on first.module = i.module where target <> i.doc_id::varchar""")
def import_targets(spark, sf_dir):
    """The first document whose path ends with the module's."""
    imports = _imports(spark, sf_dir).select(F.col("importer_id").cast("string").alias("doc_id"), "module")
    return X.import_targets(imports, _fact_documents(spark, sf_dir))


_CLASSES = "classes as (select 's' || lpad(doc_id::varchar, 9, '0') as symbol_id, source as path, 'C' || (doc_id % 50) as display_name, (doc_id % 5)::int as start_line, 'C' || (doc_id * 7 % 60) as base from documents)"


@registered(f"""with {_CLASSES}, here as (select path, display_name, max(symbol_id) as s from classes group by all), anywhere as (select display_name, arg_min(symbol_id, (path, start_line, symbol_id)) as s from classes group by all)
    select symbol_id, base, target from (select c.symbol_id, c.base, coalesce(h.s, a.s) as target from classes c left join here h on h.path = c.path and h.display_name = c.base left join anywhere a on a.display_name = c.base) where target is not null and target <> symbol_id""")
def base_targets(spark, sf_dir):
    c = documents(spark, sf_dir).select(F.concat(F.lit("s"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("symbol_id"), F.col("source").alias("path"), F.concat(F.lit("C"), F.col("doc_id") % 50).alias("display_name"), (F.col("doc_id") % 5).cast("int").alias("start_line"), F.concat(F.lit("C"), F.col("doc_id") * 7 % 60).alias("base"), F.lit("class").alias("kind"))
    return X.base_targets(c.select("symbol_id", F.col("path").alias("relative_path"), F.col("path").alias("doc_id"), "base"), c).select("symbol_id", "base", "target")


def _fact_elements(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 2 == 0, "class").otherwise("function")
    d = documents(spark, sf_dir)
    parts = d.select(F.col("doc_id").cast("string").alias("id"), kind.alias("type"), F.concat(F.lit("n"), F.col("doc_id")).alias("name"), F.col("source").alias("relative_path"), F.col("lang").alias("language"), _none().alias("signature"), (F.col("doc_id") % 90).cast("int").alias("start_line"), F.lit(0).alias("start_col"), (F.col("doc_id") % 90 + 5).cast("int").alias("end_line"), _none().alias("qualified_name"), _none().alias("class_name"), F.array().cast("array<string>").alias("imports"), F.array().cast("array<string>").alias("bases"))
    return parts


_FACT_SYMBOLS = """symbols as (select 'ast:s:' || lang || ':' || source || ':' || case doc_id % 2 when 0 then 'class' else 'function' end || ':n' || doc_id || ':' || (doc_id % 90) || ':0' as symbol_id, 'doc:' || left(md5('s:' || source), 24) as doc_id, (doc_id % 90)::int as start_line from documents)"""


@registered(f"with {_FACT_SYMBOLS} select 'edge:' || left(md5('contain:' || doc_id || ':' || symbol_id), 24) as edge_id, doc_id as src_id, symbol_id as dst_id, 'contain' as edge_type, 'resolved' as confidence from symbols")
def element_facts(spark, sf_dir):
    """Containment of parsed elements."""
    return X.from_elements(_fact_elements(spark, sf_dir), "s")["edges"].select("edge_id", "src_id", "dst_id", "edge_type", "confidence")


def _index(spark, sf_dir):
    """An indexer's output: a document per source, a symbol per even document, a reference to each and to odd ones, which are external."""
    d = documents(spark, sf_dir).withColumn("s", F.concat(F.lit("pkg "), F.col("doc_id")))
    r = F.array(*[F.lit(x) for x in (1, 0, 1, 3)])
    symbol = F.struct(F.col("s").alias("symbol"), F.col("s").alias("name"), F.lit("class").alias("kind"), r.alias("range"), _none().alias("signature"), _none().alias("qualified_name"))
    seen = F.struct(F.col("s").alias("symbol"), F.when(F.col("doc_id") % 3 == 0, "definition").otherwise("reference").alias("role"), r.alias("range"))
    docs = d.groupBy("source").agg(F.collect_list(F.when(F.col("doc_id") % 2 == 0, symbol)).alias("symbols"), F.collect_list(seen).alias("occurrences"))
    return docs.select(F.array(F.struct(F.col("source").alias("path"), F.lit("python").alias("language"), "symbols", "occurrences")).alias("documents"))


@registered("""with s as (select 'scip:s:pkg ' || doc_id as symbol_id, 'doc:' || left(md5('s:' || source), 24) as d, doc_id from documents)
    select d as src_id, symbol_id as dst_id, 'contain' as edge_type, 'precise' as confidence from s where doc_id % 2 = 0 union all select d, symbol_id, 'ref', 'precise' from s where doc_id % 3 > 0""")
def index_facts(spark, sf_dir):
    """Containment and references of an indexer's output."""
    return X.from_index(_index(spark, sf_dir), "s")["edges"].select("src_id", "dst_id", "edge_type", "confidence")


@registered("select 'scip:s:pkg ' || doc_id as symbol_id, case doc_id % 2 when 0 then 'class' else 'external' end as kind, case doc_id % 2 when 0 then source else '' end as path from documents")
def index_symbols(spark, sf_dir):
    """Declared symbols, and stubs of those that only occur."""
    return X.from_index(_index(spark, sf_dir), "s")["symbols"].select("symbol_id", "kind", "path")


@registered("""select 'a' || doc_id as edge_id, 'scip' || (doc_id % 9) as src_id, 'x' || doc_id as dst_id, 'ast' as source from documents union all select 'p' || doc_id, 'scip' || (doc_id % 9), 'x' || doc_id, 'scip' from documents where doc_id % 2 = 0""")
def merge_edges(spark, sf_dir):
    d = documents(spark, sf_dir)
    edge = lambda rows, p, s: rows.select(F.concat(F.lit(p), "doc_id").alias("edge_id"), F.concat(F.lit("ast"), F.col("doc_id") % 9).alias("src_id"), F.concat(F.lit("x"), "doc_id").alias("dst_id"), F.lit(s).alias("source"))
    canonical = d.select((F.col("doc_id") % 9).alias("i")).distinct().select(F.concat(F.lit("ast"), "i").alias("symbol_id"), F.concat(F.lit("scip"), "i").alias("canonical_id"))
    return X.merge_edges(edge(d, "a", "ast"), edge(d.where("doc_id % 2 = 0"), "p", "scip"), canonical).select("edge_id", "src_id", "dst_id", "source")


def _simple_symbols(spark, sf_dir):
    return documents(spark, sf_dir).select(F.concat(F.lit("s"), "doc_id").alias("symbol_id"), F.concat(F.lit("n"), F.col("doc_id") % 13).alias("display_name"), F.col("source").alias("path"), F.lit("class").alias("kind"), F.array(F.concat(F.lit("a"), F.col("doc_id") % 200)).alias("aliases"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("e"), F.col("doc_id") % 300)).alias("element_id"), (F.col("doc_id") % 5).cast("int").alias("start_line"), (F.col("doc_id") % 5 + 2).cast("int").alias("end_line"))


@registered("select 's' || doc_id as canonical_id, array_to_string(list_sort(['s' || doc_id, 'a' || (doc_id % 200)]), ',') as aliases from documents")
def aliases_of(spark, sf_dir):
    return X.aliases_of(_simple_symbols(spark, sf_dir)).select("canonical_id", F.array_join("aliases", ",").alias("aliases"))


@registered("select 'n' || (doc_id % 13) as display_name, count(*) as n, min('s' || doc_id) as first from documents group by 1")
def symbols_by_name(spark, sf_dir):
    return X.symbols_by(_simple_symbols(spark, sf_dir), "display_name").select("display_name", F.size("symbol_ids").cast("long").alias("n"), F.element_at("symbol_ids", 1).alias("first"))


@registered("select 'e' || (doc_id % 300) as element_id, min('s' || doc_id) as symbol_id from documents where doc_id % 2 = 0 group by 1")
def element_bridge(spark, sf_dir):
    return X.element_bridge(_simple_symbols(spark, sf_dir))


@registered("""select 's' || doc_id as node, 'r@c symbol ' || source || ' ' || (doc_id % 5) as place from documents union all select 'd' || doc_id, 'r@c document ' || source || ' ' from documents where doc_id % 3 = 0 union all select 'd' || doc_id, 'r@c unknown  ' from documents where doc_id % 3 > 0""")
def source_refs(spark, sf_dir):
    d = documents(spark, sf_dir)
    nodes = d.select(F.concat(F.lit("s"), "doc_id").alias("node")).union(d.select(F.concat(F.lit("d"), "doc_id")))
    docs = d.where("doc_id % 3 = 0").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.col("source").alias("path"))
    snapshot = spark.range(1).select(F.lit("r").alias("repo_name"), F.lit("c").alias("commit_id"))
    at = F.concat(F.col("ref.repo_name"), F.lit("@"), F.col("ref.commit_id"), F.lit(" "), F.col("ref.at.kind"), F.lit(" "), F.col("ref.at.path"), F.lit(" "), F.coalesce(F.col("ref.at.start_line").cast("string"), F.lit("")))
    return X.source_refs(nodes, docs, _simple_symbols(spark, sf_dir), snapshot).select("node", at.alias("place"))


@registered("""with d as (select distinct source from documents), f as (select doc_id, source from documents)
    select 'Repository' as type, 1 as n union all select 'Branch', 1 union all select 'Commit', 1 union all select 'Snapshot', 1 union all select 'Manifest', 1 union all select 'IndexRun', 1
    union all select 'DocumentVersion', (select count(*) from d) union all select 'SymbolVersion', (select count(*) from f)
    union all select 'repository_snapshot', 1 union all select 'branch_commit', 1 union all select 'commit_parent', 1 union all select 'snapshot_manifest', 1 union all select 'manifest_supersedes', 1 union all select 'manifest_run', 1
    union all select 'snapshot_document', (select count(*) from d) union all select 'document_symbol', (select count(*) from f)""")
def lineage_counts(spark, sf_dir):
    """How many nodes and edges of each kind a publication's lineage has."""
    one = lambda **kv: spark.range(1).select(*[F.lit(v).alias(k) for k, v in kv.items()])
    docs = documents(spark, sf_dir).select(F.col("source").alias("doc_id"), F.col("source").alias("path"), F.lit("x").alias("language")).distinct()
    nodes, edges = X.lineage(one(snapshot_id="s", repo_name="r", branch="b", commit_id="c"), one(manifest_id="m1", snapshot_id="s", index_run_id="i", previous_manifest_id="m0"), docs, _simple_symbols(spark, sf_dir), one(commit_id="c", parent_id="p"))
    return nodes.union(edges.select("src", "type", "dst")).groupBy("type").agg(F.count(F.lit(1)).cast("int").alias("n"))


# -- filters ----------------------------------------------------------------------------------------
@registered(f"with {_ELEMENTS} select id from elements where repo_name in ('src1', 'src2')")
def in_repositories(spark, sf_dir):
    return Q.in_repositories(elements(spark, sf_dir), ["src1", "src2"]).select("id")


@registered(f"with {_ELEMENTS} select id, name from elements where relative_path = 'src3/3'")
def by_file(spark, sf_dir):
    return Q.by_file(elements(spark, sf_dir), "src3/3").select("id", "name")


@registered(f"with {_ELEMENTS} select id, type from elements where type = 'class' order by id limit 50")
def by_type(spark, sf_dir):
    """The first fifty of a type: a report."""
    return Q.by_type(elements(spark, sf_dir), "class").select("id", "type")


@registered(f"with {_ELEMENTS} select id from elements where not coalesce(language = 'en', false)")
def delete_where(spark, sf_dir):
    return Q.delete_where(elements(spark, sf_dir), F.col("language") == "en").select("id")


@registered("select vec_id as id from embeddings where vec_id % 3 > 0")
def with_embedding(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 > 0, F.col("embedding")).alias("embedding"))
    return Q.with_embedding(e).select("id")


@registered(f"with {_ELEMENTS} select relative_path as file, repo_name as repo, type, name, start_line, end_line from elements where id % 3 > 0")
def stream_sources(spark, sf_dir):
    rows = elements(spark, sf_dir).withColumn("type", F.when(F.col("id") % 3 == 0, "repository_overview").otherwise(F.col("type")))
    return Q.stream_sources(Q.elements_only(rows)).select("file", "repo", "type", "name", "start_line", F.col("end_line").cast("long").alias("end_line"))


@registered(f"with {_ELEMENTS} select id, name from elements where name in (select name from elements where lower(name) = 'd7' order by name = 'D7' desc, id limit 1)")
def named_element(spark, sf_dir):
    return Q.named_element(elements(spark, sf_dir), "D7").select("id", "name")


@registered("select doc_id, case when source = 'src2' then 'src2' when source = 'src4' then 'SRC4' end as repo from documents")
def repo_in_path(spark, sf_dir):
    repos = F.array(F.lit("SRC4"), F.lit("src2"))
    return documents(spark, sf_dir).select("doc_id", T.repo_in_path(F.concat_ws("/", F.lit("a"), "source", "doc_id"), repos).alias("repo"))


@registered(f"with {_ELEMENTS} select repo_name, content from (select source as repo_name, count(*) as content from documents group by source) where repo_name in ('src1', 'src5')")
def overviews_of(spark, sf_dir):
    overviews = documents(spark, sf_dir).groupBy(F.col("source").alias("repo_name")).agg(F.count(F.lit(1)).alias("content"))
    return Q.overviews_of(overviews, spark.createDataFrame([("src1",), ("src5",), ("none",)], "repo_name string"))


def _scored(spark, sf_dir):
    rows = elements(spark, sf_dir)
    return rows.withColumns({c: F.lit(0.0) for c in Q.SCORES}).withColumn("total_score", (F.col("id") % 100).cast("double"))


@registered(f"""with {_ELEMENTS}, r as (select id, (id % 100)::double as s from elements where id % 2 = 0), sel as (select id, (id % 100)::double as s from elements where id % 3 = 0)
    select id, round(case when id in (select id from sel) then s * 1.3 else s end, 6) as total_score from r union all select id, s from sel where id not in (select id from r)""")
def boost_selected(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    return Q.boost_selected(rows.where("id % 2 = 0"), rows.where("id % 3 = 0")).select("id", F.round("total_score", 6).alias("total_score"))


# -- counts and summaries -----------------------------------------------------------------------------
@registered("select distinct source as repo_name from documents where source is not null")
def repositories(spark, sf_dir):
    return O.repositories(elements(spark, sf_dir))


@registered("select count(*) as elements from documents")
def total_elements(spark, sf_dir):
    return O.total(elements(spark, sf_dir))


@registered("select count(*) as files, round(sum(strlen(text)) / 1048576.0, 6) as megabytes from documents")
def scan_info(spark, sf_dir):
    return O.scan_info(documents(spark, sf_dir).select(F.octet_length("text").alias("size"))).withColumn("megabytes", F.round("megabytes", 6))


@registered(f"""with f as (select source as repo_name, {_PATH} as path from documents), d as (select repo_name, array_to_string(string_split(path, '/')[1:-2], '/') as d, count(*) as n from f group by all)
    select repo_name, string_agg(repeat('  ', (len(string_split(d, '/')) - 1)::int) || string_split(d, '/')[-1] || '/ (' || n || ' files)', chr(10) order by d) as structure_text from d group by repo_name""")
def structure_text(spark, sf_dir):
    d = documents(spark, sf_dir)
    suffix = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".js").when(F.col("lang") == "fr", ".rs").otherwise(".md")
    return O.structure_text(d.select(F.col("source").alias("repo_name"), F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/d"), F.col("doc_id"), suffix).alias("path")))


@registered(f"""with {_ELEMENTS}, k as (select *, 'g' || (id % 4) as p from elements) select p as relative_path, type, count(*) as n, string_agg(name, ',' order by name) as names, max(end_line) as last_line from k where p = 'g1' group by all""")
def file_summary(spark, sf_dir):
    rows = elements(spark, sf_dir).withColumn("relative_path", F.concat(F.lit("g"), F.col("id") % 4)).withColumn("class_name", _none())
    return O.file_summary(rows, "g1").select("relative_path", "type", "n", F.array_join("names", ",").alias("names"), F.col("last_line").cast("long").alias("last_line"))


@registered(f"""with f as (select source as repo_name, {_PATH} as path from documents), l as (select repo_name, case regexp_extract(path, '(\\.[a-z]+)$', 1) when '.py' then 'python' when '.js' then 'javascript' when '.rs' then 'rust' else 'markdown' end as language from f),
    c as (select repo_name, language, count(*) as n from l group by all) select repo_name, sum(n)::bigint as files, string_agg(language || '=' || n, ',' order by language) as languages from c group by repo_name""")
def repository_report(spark, sf_dir):
    d = documents(spark, sf_dir)
    suffix = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".js").when(F.col("lang") == "fr", ".rs").otherwise(".md")
    r = O.repository_report(d.select(F.col("source").alias("repo_name"), F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/d"), F.col("doc_id"), suffix).alias("path")))
    return r.select("repo_name", "files", F.array_join(F.transform(F.array_sort(F.map_entries("languages")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("languages"))


@registered("select 'https://x.org/a/r' || (doc_id % 30) || '.git' as source, 'r' || (doc_id % 30) as repo_name, 'git' as kind, case when doc_id % 30 >= 20 then 'clone' when doc_id % 30 % 2 = 0 then 'update' else 'use' end as action from documents")
def readiness(spark, sf_dir):
    wanted = documents(spark, sf_dir).select(F.concat(F.lit("https://x.org/a/r"), F.col("doc_id") % 30, F.lit(".git")).alias("source"), F.lit(False).alias("exists_locally"))
    return O.readiness(wanted, spark.range(20).select(F.concat(F.lit("r"), "id").alias("repo_name"), (F.col("id") % 2 == 0).alias("is_stale")))


_SOURCES = "case doc_id % 5 when 0 then 'a/' || source || '.zip' when 1 then source || '/d' || doc_id when 2 then 'https://h/' || source when 3 then 'me@h:' || source || '/r' || doc_id else 'what ' || doc_id end"


@registered(f"select doc_id, {_SOURCES} as source, case doc_id % 5 when 0 then 'zip' when 1 then 'path' when 4 then 'unknown' else 'git' end as kind from documents")
def source_kinds(spark, sf_dir):
    """Archives and folders that are there, addresses of two forms, and neither."""
    rows = documents(spark, sf_dir).select("doc_id", F.expr(_SOURCES).alias("source"), (F.col("doc_id") % 5 < 2).alias("here"))
    return rows.select("doc_id", "source", T.source_kind(F.col("source"), F.col("here")).alias("kind"))


@registered("""with f as (select source as repo_name, case doc_id % 5 when 0 then 'README.md' when 1 then 'readme.txt' else 'x' || doc_id end as path, doc_id from documents), r as (select repo_name, path, min(doc_id) as doc_id from f where path in ('README.md', 'readme.txt') group by all)
    select repo_name, path from (select repo_name, path, row_number() over (partition by repo_name order by path = 'README.md' desc) as n from r) where n = 1""")
def readme_probe(spark, sf_dir):
    name = F.when(F.col("doc_id") % 5 == 0, "README.md").when(F.col("doc_id") % 5 == 1, "readme.txt").otherwise(F.concat(F.lit("x"), "doc_id"))
    return O.readme(documents(spark, sf_dir).select(F.col("source").alias("repo_name"), name.alias("path"), F.col("text").alias("content"))).select("repo_name", "path")


@registered(f"""with {_ELEMENTS}, b as (select * from elements order by id % 100 desc, id limit 20) select string_agg('## ' || type || ' ' || name || ' (score ' || printf('%.3f', (id % 100)::double) || ')' || chr(10) || '```' || language || ' - ' || relative_path || ' (Line 1)' || chr(10) || code || chr(10) || '```', chr(10) || chr(10) order by id % 100 desc, id) as context from b""")
def answer_context(spark, sf_dir):
    """The twenty best rows as one text: a limit of the report."""
    return O.context(_scored(spark, sf_dir))


# -- graphs -------------------------------------------------------------------------------------------
@registered(f"""with {_ELEMENTS}, {_ROUTED}, own as (select 'dependency' as graph, id::varchar as node from elements where type = 'file' union all select 'inheritance', id::varchar from elements where type = 'class' union all select 'call', id::varchar from elements where type in ('function', 'method', 'file'))
    select graph, count(distinct node) as nodes from (select * from own union all select graph, src_id from routed union all select graph, dst_id from routed) group by graph""")
def typed_nodes(spark, sf_dir):
    els = elements(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    edges = _routed(spark, sf_dir).select("graph", F.col("src").alias("src_id"), F.col("dst").alias("dst_id"))
    return G.typed_nodes(els, edges).groupBy("graph").agg(F.count(F.lit(1)).alias("nodes"))


@registered("""with a as (select doc_id as src, doc_id % 50 as dst, 'call' as edge_type, 'first' as said from documents), b as (select doc_id as src, doc_id % 50 as dst, case doc_id % 3 when 0 then 'call' else 'ref' end as edge_type, 'second' as said from documents where doc_id % 2 = 0)
    select src, dst, edge_type, max(said) as said from (select * from a union all select * from b) group by src, dst, edge_type""")
def compose_graphs(spark, sf_dir):
    d = documents(spark, sf_dir)
    base = [F.col("doc_id").alias("src"), (F.col("doc_id") % 50).alias("dst")]
    a = d.select(*base, F.lit("call").alias("edge_type"), F.lit("first").alias("said"))
    return G.compose(a, d.where("doc_id % 2 = 0").select(*base, F.when(F.col("doc_id") % 3 == 0, "call").otherwise("ref").alias("edge_type"), F.lit("second").alias("said")))


@registered(f"with {_BIPARTITE}, two as (select src, dst from links union select dst, src from links) select 's2' as node union select dst from two where src = 's2'")
def ego_network(spark, sf_dir):
    return G.ego(_bipartite(spark, sf_dir), "s2").distinct()


@registered(f"""with {_BIPARTITE}, two as (select src, dst from links union select dst, src from links),
    a as (select distinct 's1' as seed, dst as node from two where src = 's1'), b as (select distinct 's999999' as seed, 'p1' as node) select seed, node from a union all select seed, node from b""")
def neighbours_with_fallback(spark, sf_dir):
    """One hop; a seed that the graph lacks is asked of another one."""
    legacy = spark.createDataFrame([("s999999", "p1"), ("s1", "p0")], "src string, dst string")
    return G.related_with_fallback(_bipartite(spark, sf_dir), legacy, spark.createDataFrame([("s1",), ("s999999",)], "seed string"), 1).select("seed", "node")


@registered(f"""with {_BIPARTITE}, ends as (select src as n from links union select dst from links) select (select count(*) from ends) as nodes, count(*) as edges, round(2 * count(*) / (select count(*) from ends), 6) as avg_degree from links""")
def average_degree(spark, sf_dir):
    return G.average_degree(_bipartite(spark, sf_dir)).withColumn("avg_degree", F.round("avg_degree", 6))


@registered(f"""with n as (select p_partkey as node, p_name as title, p_type as path, p_brand as kind, ln(1 + p_size) as d from part), h as (select node, (position('small' in lower(concat_ws(' ', title, path, kind))) > 0)::int + (position('steel' in lower(concat_ws(' ', title, path, kind))) > 0)::int as hits, d from n)
    select node, round(hits + d, 6) as score from h where hits > 0 order by hits + d desc, node desc limit 12""")
def query_terminals(spark, sf_dir):
    """The twelve best terminals: a limit of the feature."""
    p = table(spark, sf_dir, "part")
    nodes = p.select(F.col("p_partkey").alias("node"), F.col("p_name").alias("title"), F.col("p_type").alias("path"), F.col("p_brand").alias("symbol_kind"))
    return G.query_terminals(nodes, p.select(F.col("p_partkey").alias("node"), F.col("p_size").alias("degree")), "Small steel").select("node", F.round("score", 6).alias("score"))


@registered("""with n as (select n_nationkey as c from nation) select case when c % 5 = 0 then 0 else c - 1 end as parent, c as child from n where c > 0""")
def backbone_tree(spark, sf_dir):
    """The heaviest links: from 0 to every fifth nation, and from each to the next; others are lighter and left out."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c"))
    heavy = n.where("c > 0").select(F.when(F.col("c") % 5 == 0, F.lit(0)).otherwise(F.col("c") - 1).cast("int").alias("ca"), F.col("c").alias("cb"), F.lit(9.0).alias("weight"))
    light = n.where("c > 2").select((F.col("c") - 2).cast("int").alias("ca"), F.col("c").alias("cb"), (F.lit(1.0) + F.col("c") % 7).alias("weight"))
    return G.backbone(n.select(F.col("c").alias("cluster"), (F.lit(100) - F.col("c")).alias("size")), heavy.union(light))


@registered(f"""with {_ELEMENTS} select id from elements where id % 5 = 0 or (type = 'file' and repo_name = 'src2') or (id % 5 = 1 and id % 7 = 0)""")
def related_elements(spark, sf_dir):
    """By the bridge, by a document's path, and by path and name."""
    els = elements(spark, sf_dir)
    d = documents(spark, sf_dir)
    symbols = d.select(F.concat(F.lit("s"), "doc_id").alias("symbol_id"), F.concat_ws("/", "source", "doc_id").alias("path"), F.concat(F.lit("d"), "doc_id").alias("display_name"))
    nodes = d.where("doc_id % 5 = 0 or doc_id % 5 = 1 and doc_id % 7 = 0").select(F.concat(F.lit("s"), "doc_id").alias("node")).union(spark.createDataFrame([("dsrc2",)], "node string"))
    docs = d.where("doc_id % 4 = 2 and source = 'src2'").select(F.lit("dsrc2").alias("doc_id"), F.concat_ws("/", "source", "doc_id").alias("path"))
    bridge = d.where("doc_id % 5 = 0").select(F.col("doc_id").alias("element_id"), F.concat(F.lit("s"), "doc_id").alias("symbol_id"))
    return R.related_elements(els, nodes, bridge, docs, symbols).select("id")


@registered("""select cluster, count(*) as size, round(least(1.0, 0.3 + count(*) / 20.0), 6) as importance, coalesce(min(case when doc_id < 20 then 'd' || doc_id end), cluster) as label from (select source as cluster, doc_id from documents) group by cluster""")
def cluster_labels(spark, sf_dir):
    m = documents(spark, sf_dir).select(F.col("source").alias("cluster"), F.col("doc_id").alias("node"), F.concat(F.lit("d"), "doc_id").alias("title"), (F.col("doc_id") < 20).alias("is_representative"))
    return projection.cluster_labels(m).select("cluster", "size", F.round("importance", 6).alias("importance"), "label")


# -- texts -------------------------------------------------------------------------------------------------
@registered("select conv_id, turn, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+'), lambda w: length(w) > 1), ' ') as words from conversations")
def clean_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.clean_words(F.col("text")), " ").alias("words"))


@registered("select doc_id, case doc_id % 3 when 0 then '.py' end as extension, case doc_id % 3 when 1 then 'a/b' || doc_id || '.js' end as file_path from documents")
def query_filters(spark, sf_dir):
    q = F.when(F.col("doc_id") % 3 == 0, "open main.py please").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("see 'a/b"), "doc_id", F.lit(".js'"))).otherwise("nothing named")
    return documents(spark, sf_dir).select("doc_id", T.query_filters(q).alias("f")).select("doc_id", F.when(F.col("doc_id") % 3 == 1, F.lit(None)).otherwise(F.col("f.extension")).alias("extension"), "f.file_path")


@registered("select doc_id, case doc_id % 3 when 0 then 'function:f' || doc_id when 1 then 'class:c' || doc_id end as entity from documents")
def code_entities(spark, sf_dir):
    q = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("the function named f"), "doc_id")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("class 'C"), "doc_id", F.lit("'"))).otherwise("nothing")
    return documents(spark, sf_dir).select("doc_id", T.code_entity(q).alias("e")).select("doc_id", F.when(F.col("e").isNotNull(), F.concat_ws(":", "e.type", "e.name")).alias("entity"))


@registered("""with t as (select conv_id, turn, lower(text) as l, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as n from conversations),
    c as (select *, contains(l, 'function') or contains(l, 'class') or contains(l, 'method') or contains(l, 'variable') or contains(l, 'code') or contains(l, 'implementation') or contains(l, 'how to') or contains(l, 'algorithm') or contains(l, 'logic') or contains(l, 'file') or contains(l, 'module') or contains(l, 'import') or contains(l, 'api') or contains(l, 'endpoint') as is_code from t)
    select conv_id, turn, turn % 2 = 0 or n > 15 or (not is_code and n > 5) as wants from c""")
def wants_rewriting(spark, sf_dir):
    kind = F.when(F.col("turn") % 2 == 0, "how").otherwise("general")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.wants_rewriting(F.col("text"), kind).alias("wants"))


@registered("select doc_id, 'r' || doc_id as value from documents")
def reply_fields(spark, sf_dir):
    reply = F.concat(F.lit("Intent: how\n**Query**: `r"), "doc_id", F.lit("`\nother: x"))
    return documents(spark, sf_dir).select("doc_id", T.reply_field(reply, "query").alias("value"))


@registered(f"with {_ELEMENTS} select id, md5('Type: ' || type || chr(10) || 'Name: ' || name || case when code <> '' then chr(10) || 'Code: ' || left(code, 10000) else '' end) as digest from elements")
def embedding_document(spark, sf_dir):
    """The first ten thousand characters of code are what the feature embeds."""
    return elements(spark, sf_dir).select("id", F.md5(T.embedding_document(F.col("type"), F.col("name"), _none(), _none(), _none(), F.col("code")).cast("binary")).alias("digest"))


@registered("select doc_id, 'first ' || doc_id || chr(10) || '  second' || chr(10) || 'third' as doc from documents")
def dedented(spark, sf_dir):
    doc = F.concat(F.lit("\n    first "), "doc_id", F.lit("\n      second\n    third\n    "))
    return documents(spark, sf_dir).select("doc_id", T.dedent(doc).alias("doc"))


@registered("select doc_id, case doc_id % 2 when 0 then 'async def f' || doc_id || '(a, b) -> int' else 'def f' || doc_id || '(a, b)' end as s, 'class C' || doc_id || '(B)' as c from documents")
def signatures(spark, sf_dir):
    even = F.col("doc_id") % 2 == 0
    s = T.signature(F.concat(F.lit("f"), "doc_id"), F.array(F.lit("a"), F.lit("b")), F.when(even, "int"), even)
    return documents(spark, sf_dir).select("doc_id", s.alias("s"), T.class_signature(F.concat(F.lit("C"), "doc_id"), F.array(F.lit("B"))).alias("c"))


@registered("select doc_id, case doc_id % 3 when 2 then 'plain ' || doc_id else 'answer' end as answer, case doc_id % 3 when 2 then null else 'sum ' || doc_id end as summary from documents")
def split_summaries(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("answer\n<SUMMARY>sum "), i, F.lit("</SUMMARY>"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("answer\n## Summary:\nsum "), i)).otherwise(F.concat(F.lit("plain "), i))
    answer, summary = T.split_summary(text)
    return documents(spark, sf_dir).select("doc_id", answer.alias("answer"), summary.alias("summary"))


@registered("select doc_id, case when doc_id % 4 = 0 then 'q' else 'q' || chr(10) || 'Relevant files: a' || doc_id || ', b' end as q from documents")
def file_hints(spark, sf_dir):
    files = F.when(F.col("doc_id") % 4 > 0, F.array(F.concat(F.lit("a"), "doc_id"), F.lit("b")))
    return documents(spark, sf_dir).select("doc_id", T.with_file_hints(F.lit("q"), files).alias("q"))


@registered("select doc_id, 'someKey' || doc_id as camel, 'some_key' || doc_id as snake from documents")
def key_case(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.snake_to_camel(F.concat(F.lit("some_key"), "doc_id")).alias("camel"), T.camel_to_snake(F.concat(F.lit("someKey"), "doc_id")).alias("snake"))


@registered("select doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::int as tokens from documents")
def token_estimates(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@registered("select doc_id, case when lang in ('en', 'de') then 'openai' when lang = 'fr' then 'anthropic' else 'other' end as provider from documents")
def providers(spark, sf_dir):
    """A model's name for each language."""
    name = F.when(F.col("lang") == "en", "GPT-4o").when(F.col("lang") == "de", "my-gpt-small").when(F.col("lang") == "fr", "Claude-x").otherwise("llama")
    return documents(spark, sf_dir).select("doc_id", T.first_match(name, [("gpt", "openai"), ("claude", "anthropic")], "other").alias("provider"))


@registered()
def bpe_token_counts(spark, sf_dir):
    """Counts by a public vocabulary, and texts cut after a hundred tokens."""
    import public_tokenizers

    d = documents(spark, sf_dir).select("doc_id", "text")
    return T.bpe_tokens(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, most=100).select("doc_id", "n_tokens", F.md5(F.col("cut").cast("binary")).alias("cut_digest"))


# -- values ------------------------------------------------------------------------------------------------
@registered("select doc_id, round((least(greatest(log10(greatest(n_chars, 1)) / 2, 0.5), 2.0) + least(greatest(doc_id % 200 / 50, 0.5), 2.0) + least(greatest(doc_id % 12 / 5, 0.5), 2.0)) / 3, 6) as factor from documents")
def repo_complexity(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.round(V.repo_complexity(F.col("n_chars"), F.col("doc_id") % 200, F.col("doc_id") % 12), 6).alias("factor"))


@registered("select doc_id, least(greatest(floor(4 * (0.5 + doc_id % 4 * 0.5) * case when doc_id % 100 >= 70 then 1.2 when doc_id % 100 <= 30 then 0.7 else 1.0 end), 2), 6)::int as rounds from documents")
def adaptive_rounds(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", V.adaptive_rounds(F.col("doc_id") % 100, 0.5 + F.col("doc_id") % 4 * 0.5).alias("rounds"))


@registered("select doc_id, md5(text) as digest, 'q_' || md5(source || '_' || lang) as cache_key from documents")
def content_digests(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", V.content_digest(F.col("text")).alias("digest"), V.cache_key("q", F.col("source"), F.col("lang")).alias("cache_key"))


@registered("select doc_id, array_to_string(list_sort(list_distinct(['b', lang, 'a', 'b'])), ',') as s, case when lang = 'a' then 'b,a' else 'b,' || lang || ',a' end as o from documents where lang is not null")
def array_values(spark, sf_dir):
    a = F.array(F.lit("b"), F.col("lang"), F.lit("a"), F.lit("b"))
    return documents(spark, sf_dir).where("lang is not null").select("doc_id", F.array_join(V.sorted_set(a), ",").alias("s"), F.array_join(V.ordered_distinct(a), ",").alias("o"))


@registered("""select doc_id, '{"a":"2","b":"' || source || '","c":"3"}' as j, '{"doc_id":' || doc_id || ',"source":"' || source || '"}' as r from documents""")
def map_json(spark, sf_dir):
    m = V.merged(F.create_map(F.lit("b"), F.col("source"), F.lit("a"), F.lit("1")), F.create_map(F.lit("c"), F.lit("3"), F.lit("a"), F.lit("2")))
    return documents(spark, sf_dir).select("doc_id", V.canonical_json(m).alias("j"), V.to_row_json("doc_id", "source").alias("r"))


@registered("""select doc_id, '{"a":' || doc_id || ',"b":[1,2]}' as j from documents""")
def tolerant_json(spark, sf_dir):
    """JSON of replies with fences, comments, trailing commas and missing brackets."""
    i = F.col("doc_id").cast("string")
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('text ```json\n{"b": [1, 2,], "a": '), i, F.lit("}\n``` more"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('{"a": '), i, F.lit(', // note\n "b": [1,2]}'))).otherwise(F.concat(F.lit('so {"a": '), i, F.lit(', "b": [1, 2')))
    return documents(spark, sf_dir).select("doc_id", V.tolerant_json_udf()(reply).alias("j"))


@registered("select event_id, case event_id % 2 when 0 then case when event_id > 500 then event_id end else 500 + event_id end as next_run_ms from events")
def next_runs(spark, sf_dir):
    e, at = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.when(at % 2 == 0, "at").otherwise("every")
    return e.select("event_id", V.next_run_ms(kind, at, at, _none(), _none(), F.lit(500)).alias("next_run_ms"))


# -- selections ------------------------------------------------------------------------------------------------
@registered(f"with {_ELEMENTS} select id, 0.8::double as total_score from elements where type = 'file' and repo_name in ('src2', 'src6') and contains(relative_path, '/2')")
def file_elements(spark, sf_dir):
    return S.file_elements(spark.createDataFrame([("src2", "/2"), ("src6", "/2")], "repo_name string, path string"), elements(spark, sf_dir)).select("id", "total_score")


@registered(f"""with {_ELEMENTS}, c as (select source as repo_name, source || '/' || doc_id as path, doc_id as ord from documents where doc_id % 4 = 2 order by ord, repo_name, path limit 10) select id from elements where type = 'file' and relative_path in (select path from c)
    or (type = 'file' and exists (select 1 from c where c.repo_name = elements.repo_name and contains(elements.relative_path, c.path)))""")
def fallback_files(spark, sf_dir):
    """The first ten candidates: a limit of the feature."""
    c = documents(spark, sf_dir).where("doc_id % 4 = 2").select(F.col("source").alias("repo_name"), F.concat_ws("/", "source", "doc_id").alias("path"), F.col("doc_id").alias("ord"))
    return S.fallback_files(c, elements(spark, sf_dir)).select("id")


@registered(f"with {_ELEMENTS} select id from elements where repo_name = 'src1' and type in ('class', 'function')")
def children_of_file(spark, sf_dir):
    return S.children_of_file(elements(spark, sf_dir).withColumn("relative_path", F.lit("all")), "src1", "all").select("id")


@registered(f"with {_ELEMENTS} select id, (max(s))::double as total_score from (select id, id % 7 as s from elements where id % 2 = 0 union all select id, id % 5 from elements where id % 3 = 0) group by id")
def union_of_tools(spark, sf_dir):
    e = elements(spark, sf_dir)
    a, b = (e.where(f"id % {m} = 0").withColumn("total_score", (F.col("id") % n).cast("double")) for m, n in ((2, 7), (3, 5)))
    return S.union_of_tools(a, b).select("id", "total_score")


@registered(f"""with {_ELEMENTS}, g as (select *, case when id % 2 = 0 then 'tool' when id % 3 = 0 then 'graph' else 'retrieval' end as s from elements)
    select repo_name, string_agg(distinct s, ',' order by s) as sources, sum(case when end_line > 1 then end_line else 0 end)::bigint as lines, count(*) as elements from g group by repo_name""")
def grouped_by_file(spark, sf_dir):
    e = elements(spark, sf_dir).withColumns({"agent_found": F.col("id") % 2 == 0, "related_to": F.when(F.col("id") % 3 == 0, "x"), "signature": _none(), "relative_path": F.col("repo_name")})
    return S.grouped_by_file(e).select("repo_name", F.array_join("sources", ",").alias("sources"), "lines", "elements")


@registered(f"""with {_ELEMENTS}, r as (select id, repo_name, type, row_number() over (partition by repo_name, type order by start_line, id)::int as rank from elements where type in ('class', 'function'))
    select id, rank from r where rank <= 10 order by repo_name, type, rank limit 200""")
def display_candidates(spark, sf_dir):
    """Ten of a kind a file, two hundred rows: limits of the display."""
    e = elements(spark, sf_dir).withColumn("class_name", _none()).withColumn("relative_path", F.lit("f"))
    return S.display_candidates(e).select("id", "rank")


@registered("""with p as (select doc_id, case doc_id % 3 when 0 then '' when 1 then 'missing path' else 'most should be integer' end as problems from documents) select doc_id as call_id, case when doc_id % 7 = 0 then 'unknown tool z' else problems end as problems from p""")
def parameter_problems(spark, sf_dir):
    name = F.when(F.col("doc_id") % 7 == 0, "z").otherwise("grep")
    params = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("path"), F.lit("a"), F.lit("most"), F.lit("3"))).when(F.col("doc_id") % 3 == 1, F.create_map(F.lit("most"), F.lit("3"))).otherwise(F.create_map(F.lit("path"), F.lit("a"), F.lit("most"), F.lit("x")))
    calls = documents(spark, sf_dir).select(F.col("doc_id").alias("call_id"), name.alias("tool"), params.alias("parameters"))
    return S.parameter_problems(calls, {"grep": {"path": ("string", True), "most": ("integer", False)}}).select("call_id", F.array_join("problems", ",").alias("problems"))


@registered("select min(doc_id) as call_id from documents where doc_id % 20 >= 5 group by doc_id % 20")
def tool_calls_to_make(spark, sf_dir):
    calls = documents(spark, sf_dir).select(F.col("doc_id").alias("call_id"), F.lit("grep").alias("tool"), F.create_map(F.lit("term"), (F.col("doc_id") % 20).cast("string")).alias("parameters"))
    return S.tool_calls_to_make(calls, calls.where("call_id % 20 < 5")).select("call_id")


@registered("""select 1 as round, doc_id as call_id, 'grep' as tool, '[{"key":"a","value":"1"},{"key":"b","value":"' || doc_id || '"}]' as parameters_json from documents where doc_id % 2 = 0""")
def tool_call_log(spark, sf_dir):
    """What the second round is shown of the first."""
    calls = documents(spark, sf_dir).select(F.col("doc_id").alias("call_id"), F.lit("grep").alias("tool"), F.create_map(F.lit("b"), F.col("doc_id").cast("string"), F.lit("a"), F.lit("1")).alias("parameters"))
    empty = spark.createDataFrame([], "round int, call_id bigint, tool string, parameters_json string")
    log = S.tool_call_log(S.tool_call_log(empty, calls.where("call_id % 2 = 0"), 1), calls.where("call_id % 2 = 1"), 2)
    return S.calls_before(log, 2)


@registered("""select doc_id, case doc_id % 2 when 0 then (doc_id % 100)::int else 0 end as confidence, case doc_id % 2 when 0 then 7 else 50 end as query_complexity, case doc_id % 2 when 0 then 'k' || doc_id else '' end as keep from documents""")
def parse_rounds(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    reply = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"confidence": '), (F.col("doc_id") % 100).cast("string"), F.lit(', "query_complexity": 7, "keep_files": ["k'), i, F.lit('"]}'))).otherwise("no json")
    return S.parse_round(documents(spark, sf_dir).select("doc_id", reply.alias("json"))).select("doc_id", "confidence", "query_complexity", F.array_join("keep_files", ",").alias("keep"))


@registered(f"""with p as (select string_split({_PATH}, '/') as p from documents), n as (select distinct p[1:n] as x, n < len(p) as dir from p, (values (1), (2), (3)) as v(n))
    select array_to_string(x, '/') as path, len(x)::int as level, repeat('  ', (len(x) - 1)::int) || x[-1] || case when dir then '/' else '' end as line from n""")
def tree_lines(spark, sf_dir):
    return S.directory_tree(_files(spark, sf_dir))


@registered("""with r as (select conv_id as q, turn as round, least(100, turn * 17 % 101)::int as c, (turn * 400)::bigint as l from conversations group by all), g as (select *, row_number() over w as n, c - coalesce(lag(c) over w, 0) as gain, l - coalesce(lag(l) over w, 0) as added,
    max(c) over (partition by q order by round rows 2 preceding) - min(c) over (partition by q order by round rows 2 preceding) as spread from r window w as (partition by q order by round)),
    p as (select *, case when added > 0 then gain / added * 1000 else 0 end < 1.0 and n > 1 as poor from g), b as (select *, coalesce(lag(poor) over (partition by q order by round), false) as before from p)
    select q as query_id, round, case when c >= 95 then 'confidence_threshold_reached' when round >= 4 then 'max_iterations_reached' when l >= 12000 then 'line_budget_exhausted' when n >= 3 and spread < 2 then 'stagnation' when poor and before then 'low_roi' end as stop_reason from b""")
def stopping_rules(spark, sf_dir):
    r = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("round"), F.least(F.lit(100), F.col("turn") * 17 % 101).cast("int").alias("confidence"), (F.col("turn") * 400).cast("long").alias("total_lines")).distinct()
    return S.stopping(r).select("query_id", "round", "stop_reason")


# -- stores ------------------------------------------------------------------------------------------------------
@registered("select event_type as session_id, event_id as ord from (select *, row_number() over (partition by event_type order by event_id desc) as r from events) where r <= 50")
def last_messages(spark, sf_dir):
    return W.last_messages(table(spark, sf_dir, "events").select(F.col("event_type").alias("session_id"), F.col("event_id").alias("ord")))


@registered("select conv_id, (coalesce(max(turn), 0) + 1)::bigint as next_turn from conversations group by conv_id")
def next_turns(spark, sf_dir):
    return W.next_turn(table(spark, sf_dir, "conversations"), "conv_id", "turn").withColumn("next_turn", F.col("next_turn").cast("long"))


@registered("with n as (select o_orderkey as id, o_orderdate::date as date from orders) select id, date from n where date > (select max(date) from n) - 7")
def recent_notes(spark, sf_dir):
    notes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("date"))
    today = notes.agg(F.max("date")).first()[0]
    return W.recent_notes(notes, F.lit(today))


@registered("select count(*) as processed, count(*) filter (event_type = 'purchase') as succeeded, count(*) filter (event_type = 'click') as failed from events")
def retry_summary(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "failed").otherwise("pending")
    return W.retry_summary(table(spark, sf_dir, "events").select(status.alias("status")))


@registered("with t as (select max(ts) as t from events) select count(*) as entries, sum(strlen(event_type))::bigint as bytes, count(*) filter (t >= ts + interval 3600 second) as expired from events, t")
def cache_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts")).first()[0]
    cache = e.select(F.col("event_id").alias("key"), F.col("event_type").cast("binary").alias("value"), V.expires_at(F.col("ts")).alias("expires_at"))
    return W.cache_stats(cache, F.lit(last))


@registered("with t as (select max(ts) as t from events), l as (select user_id, arg_max(event_type, (ts, event_id)) as value, max(ts) as ts from events group by user_id) select user_id as key, value from l, t where t < ts + interval 864000 second and user_id % 2 = 0")
def cache_reads(spark, sf_dir):
    """Entries are put in order of time; only fresh ones are read."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts")).first()[0]
    newest = W.latest(e, ["user_id"], ["ts", "event_id"]).select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("ts").alias("stored_at"))
    old = newest.withColumn("value", F.lit("old")).withColumn("expires_at", F.col("stored_at"))
    return W.cache_get(W.cache_put(old, newest, 864_000), e.where("user_id % 2 = 0").select(F.col("user_id").alias("key")).distinct(), F.lit(last)).select("key", "value")


@registered("select conv_id, turn from conversations where conv_id % 3 > 0")
def delete_sessions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return W.delete_keys(c, c.where("conv_id % 3 = 0"), ["conv_id"]).select("conv_id", "turn")


@registered("select user_id as task_id from (select user_id, arg_max(event_type, (ts, event_id)) as s, min(ts) as c from events group by user_id) where s not in ('click', 'purchase') order by c, user_id limit 1")
def claimed_task(spark, sf_dir):
    status = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "completed").otherwise("pending")
    tasks = W.task_states(table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), "event_id", F.col("ts").alias("at"), status.alias("status")))
    return W.claim(tasks).select("task_id")


@registered("select event_id as run_id from (select event_id, row_number() over (partition by user_id order by event_id) as r, user_id from events where event_id % 2 = 0) where r = 1 union all select event_id from events where event_id % 2 = 1 and user_id not in (select user_id from events where event_id % 2 = 0)")
def idempotent_runs(spark, sf_dir):
    """Runs by key: the first of a key stays."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("idempotency_key"))
    first = W.earliest(e.where("run_id % 2 = 0"), ["idempotency_key"], ["run_id"])
    new = e.where("run_id % 2 = 1")
    made = W.create_runs(first, new)
    odd = made.where("run_id % 2 = 1").groupBy("idempotency_key").agg(F.count(F.lit(1)).alias("n"))  # any one of a new key may stay
    kept = made.where("run_id % 2 = 0").select("run_id")
    return kept.union(new.join(odd, "idempotency_key", "left_semi").select("run_id"))


@registered("""with h as (select user_id as repo_name, event_type as ref_name, arg_max(event_id, (ts, event_id)) as head from events group by all) select distinct e.user_id as repo_name, e.event_type as ref_name, case when e.user_id % 2 = 0 then -1 else head end as snapshot_id from events e join h on h.repo_name = e.user_id and h.ref_name = e.event_type""")
def resolve_snapshots(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    manifests = e.select(F.col("event_id").alias("manifest_id"), F.col("user_id").alias("repo_name"), F.col("event_type").alias("ref_name"), F.col("event_id").alias("snapshot_id"), F.col("ts").alias("published_at"))
    asked = e.select(F.col("user_id").alias("repo_name"), F.col("event_type").alias("ref_name"), F.when(F.col("user_id") % 2 == 0, F.lit(-1)).cast("long").alias("snapshot_id")).distinct()
    return W.resolve_snapshot(asked, manifests)
