"""Parsers as table-generating functions: source text in, rows of definitions, imports, calls, scopes and types out.

Python is parsed with the standard library's ast, other languages by the lexers and parsers of `grammar`; more can be
plugged in through PARSERS. A text that can't be parsed gives no rows, never an error.
Functions run in Arrow batches, one text at a time, so memory is bounded by the longest text.
"""

from __future__ import annotations

import ast
import inspect
import re
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions import values as V
from . import grammar

MOST_FUNCTION_LINES = 1000
# Names of built-in functions, whose calls say nothing about a repository.
BUILTINS = frozenset(
    "abs all any bin bool breakpoint bytearray bytes callable chr classmethod compile complex delattr dict dir divmod enumerate eval exec filter float "
    "format frozenset getattr globals hasattr hash help hex id input int isinstance issubclass iter len list locals map max memoryview min next object oct "
    "open ord pow print property range repr reversed round set setattr slice sorted staticmethod str sum super tuple type vars zip".split()
)

FUNCTION = "name string, start_line int, end_line int, docstring string, parameters array<string>, return_type string, is_async boolean, is_method boolean, class_name string, decorators array<string>, complexity int"
CLASS = f"name string, start_line int, end_line int, docstring string, bases array<string>, decorators array<string>, methods array<struct<{FUNCTION.replace(' ', ':', 1).replace(', ', ',')}>>"
IMPORT = "module string, names array<string>, is_from boolean, line int, level int, alias string"
DEFINITION_ROW = "path string, kind string, name string, start_line int, end_line int, docstring string, parameters array<string>, return_type string, is_async boolean, class_name string, bases array<string>, decorators array<string>, complexity int, header string"
IMPORT_ROW = f"path string, {IMPORT}"
CALL_ROW = "path string, call_name string, base_object string, call_type string, scope_id string, class_around string, line int, position int, node_text string"
SCOPE_ROW = "path string, scope_id string, start_byte int, end_byte int, start_line int, end_line int"
TYPE_ROW = "path string, scope_id string, variable string, class_name string"


# -- Python -------------------------------------------------------------------------
def repaired(text: str) -> str:
    """Without code fences around it and doubled "as" clauses."""
    if "except" in text:
        text = re.sub(r"except\s+(\w+)\s+as\s+(\w+)\s+as\s+\2\s*:", r"except \1 as \2:", text)
    start, end = 0, len(text)
    if text[: text.find("\n") + 1 or end].strip().startswith("```"):
        start = text.find("\n") + 1 or end + 1
    while start <= end:  # the last line begins at at
        at = max(text.rfind("\n", start, end) + 1, start)
        if text[at:end].strip() not in ("", "```"):
            return text[start:end]
        end = at - 1
    return ""


def repaired_column(text: Column) -> Column:
    """The same in the JVM, for texts whose parser is SQL."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"except\s+(\w+)\s+as\s+(\w+)\s+as\s+\2\s*:", "except $1 as $2:")
    return F.regexp_replace(F.regexp_replace(out, r"^[ \t]*```[^\n]*\n?", ""), r"(\n[ \t]*(```)?[ \t]*)+$", "")


def _tree(text: str | None) -> ast.Module | None:
    try:
        return ast.parse(repaired(text or ""))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


_BLOCKS = (ast.If, ast.Try, ast.TryStar, ast.With, ast.AsyncWith, ast.For, ast.AsyncFor, ast.While)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _top_level(body: list[ast.stmt]) -> Iterator[ast.stmt]:
    """Classes and functions of a module, also those inside blocks and handlers (Q14), not those inside functions."""
    for node in body:
        if isinstance(node, (ast.ClassDef, *_FUNCTIONS)):
            yield node
        elif isinstance(node, _BLOCKS):
            yield from _top_level(node.body)
            for handler in getattr(node, "handlers", ()):
                yield from _top_level(handler.body)
            yield from _top_level(getattr(node, "orelse", []))
            yield from _top_level(getattr(node, "finalbody", []))


def _decorators(node) -> list[str]:
    names = []
    for d in node.decorator_list:
        d = d.func if isinstance(d, ast.Call) else d
        if isinstance(d, ast.Name):
            names.append(d.id)
    return names


def complexity_of(node: ast.AST) -> int:
    """1 and each branch, loop, handler and boolean operation."""
    return 1 + sum(isinstance(x, (ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.And, ast.Or)) for x in ast.walk(node))


def _docstring(node) -> str | None:
    found = ast.get_docstring(node)
    return inspect.cleandoc(found).strip() if found else None


def _function(node, class_name: str | None) -> dict | None:
    end = node.end_lineno or node.lineno
    if end - node.lineno > MOST_FUNCTION_LINES:
        return None
    parameters = [a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "") for a in node.args.args]
    return {"kind": "method" if class_name else "function", "name": node.name, "start_line": node.lineno, "end_line": end, "docstring": _docstring(node), "parameters": parameters, "return_type": ast.unparse(node.returns) if node.returns else None, "is_async": isinstance(node, ast.AsyncFunctionDef), "class_name": class_name, "bases": [], "decorators": _decorators(node), "complexity": complexity_of(node)}


def _base(node: ast.expr) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{node.value.id}.{node.attr}" if isinstance(node.value, ast.Name) else node.attr
    return None


def python_definitions(text: str | None) -> list[dict]:
    """Classes, their methods and functions of a module, with the line that heads each."""
    tree = _tree(text)
    if tree is None:
        return []
    rows, lines = [], repaired(text or "").split("\n")
    for node in _top_level(tree.body):
        if isinstance(node, ast.ClassDef):
            rows.append({"kind": "class", "name": node.name, "start_line": node.lineno, "end_line": node.end_lineno or node.lineno, "docstring": _docstring(node), "parameters": [], "return_type": None, "is_async": False, "class_name": None, "bases": [b for x in node.bases if (b := _base(x))], "decorators": _decorators(node), "complexity": None})
            rows += [f for x in node.body if isinstance(x, _FUNCTIONS) and (f := _function(x, node.name))]
        elif f := _function(node, None):
            rows.append(f)
    if doc := _docstring(tree):
        rows.append({"kind": "documentation", "name": "module", "start_line": 1, "end_line": 1 + doc.count("\n"), "docstring": doc, "parameters": [], "return_type": None, "is_async": False, "class_name": None, "bases": [], "decorators": [], "complexity": None})
    for r in rows:
        r["header"] = lines[r["start_line"] - 1].strip() if r["start_line"] <= len(lines) else ""
    return rows


def python_imports(text: str | None) -> list[dict]:
    """A row for each name of an import, one for each from-import."""
    rows = []
    for node in ast.walk(_tree(text) or ast.Module([], [])):
        if isinstance(node, ast.Import):
            rows += [{"module": a.name, "names": [a.name], "is_from": False, "line": node.lineno, "level": 0, "alias": a.asname} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            alias = next((a.asname for a in node.names if a.asname), None)
            rows.append({"module": node.module or "", "names": [a.name for a in node.names], "is_from": True, "line": node.lineno, "level": node.level, "alias": alias})
    return rows


class _Offsets:
    def __init__(self, text: str):
        self.starts = [0]
        for line in text.encode().split(b"\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)

    def __call__(self, line: int, column: int) -> int:
        return self.starts[line - 1] + column


def python_scopes(text: str | None) -> list[dict]:
    """Byte and line ranges of functions and classes, as type::name."""
    tree, rows = _tree(text), []
    at = _Offsets(repaired(text or ""))
    for node in ast.walk(tree or ast.Module([], [])):
        if isinstance(node, (ast.ClassDef, *_FUNCTIONS)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            rows.append({"scope_id": f"{kind}::{node.name}", "start_byte": at(node.lineno, node.col_offset), "end_byte": at(node.end_lineno, node.end_col_offset), "start_line": node.lineno, "end_line": node.end_lineno})
    return rows


def python_calls(text: str | None) -> list[dict]:
    """Every call but those of built-in functions, with the innermost scope and the class around it."""
    tree, rows, at = _tree(text), [], _Offsets(repaired(text or ""))

    def visit(node: ast.AST, scope: str | None, around: str | None) -> None:
        if isinstance(node, ast.ClassDef):
            scope, around = f"class::{node.name}", node.name
        elif isinstance(node, _FUNCTIONS):
            scope = f"{'method' if around and scope == f'class::{around}' else 'function'}::{node.name}"
        elif isinstance(node, ast.Call):
            f = node.func
            name, base, kind = (f.id, None, "simple") if isinstance(f, ast.Name) else (f.attr, ast.unparse(f.value), "attribute") if isinstance(f, ast.Attribute) else (None, None, None)
            if name and not (base is None and name in BUILTINS):
                rows.append({"call_name": name, "base_object": base, "call_type": kind, "scope_id": scope, "class_around": around, "line": node.lineno, "position": at(node.lineno, node.col_offset), "node_text": ast.unparse(node)[:200]})
        for child in ast.iter_child_nodes(node):
            visit(child, scope, around)

    if tree is not None:
        try:
            visit(tree, None, None)
        except RecursionError:
            return rows
    return rows


def python_instance_types(text: str | None) -> list[dict]:
    """variable -> class of x = C(), self.x = C() and self.x: C, by scope."""
    rows: list[dict] = []

    def visit(node: ast.AST, scope: str | None) -> None:
        if isinstance(node, (ast.ClassDef, *_FUNCTIONS)):
            scope = f"{'class' if isinstance(node, ast.ClassDef) else 'function'}::{node.name}"
        target, of = None, None
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.value, ast.Call):
            target, of = node.targets[0], _base(node.value.func)
        elif isinstance(node, ast.AnnAssign):
            target, of = node.target, _base(node.annotation)
        if of and target is not None and of.split(".")[-1][:1].isupper():
            name = target.id if isinstance(target, ast.Name) else ast.unparse(target) if isinstance(target, ast.Attribute) else None
            if name:
                rows.append({"scope_id": scope, "variable": name, "class_name": of.split(".")[-1]})
        for child in ast.iter_child_nodes(node):
            visit(child, scope)

    tree = _tree(text)
    if tree is not None:
        try:
            visit(tree, None)
        except RecursionError:
            return rows
    return rows


# -- other languages ---------------------------------------------------------------------
def other_definitions(text: str | None, language: str) -> list[dict]:
    """Definitions of a language that has a grammar."""
    return grammar.declarations(repaired(text or ""), language).rows


def other_imports(text: str | None, language: str) -> list[dict]:
    return grammar.declarations(repaired(text or ""), language, with_rows=False).imports


#: language -> function of a text to definition rows; others can be added.
PARSERS: dict[str, Callable[[str | None], list[dict]]] = {"python": python_definitions} | {name: partial(other_definitions, language=name) for name in grammar.LANGUAGES}


def _generated(files: DataFrame, make: Callable[[str | None, str | None], list[dict]], schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """files (path, content, language) through a function that gives rows: the path and the columns asked for, or all."""
    spark = files.sparkSession
    kind = spark.createDataFrame([], schema).schema
    kind = StructType([f for f in kind.fields if columns is None or f.name in ("path", *columns)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)
    names = [f.name for f in kind.fields if f.name != "path"]  # path is the first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, r) for p, c, l in zip(*(x.to_pylist() for x in batch.columns), strict=True) for r in make(c, l)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], arrow.field("path").type), *[pa.array([r.get(n) for _, r in rows], arrow.field(n).type) for n in names]], schema=arrow)

    return files.select("path", "content", "language").mapInArrow(run, kind)


def with_language(files: DataFrame) -> DataFrame:
    """files (path, content) with the language of their extension."""
    return files.withColumn("language", T.language_of(T.extension(F.col("path"))))


def definitions(files: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of definitions of every file whose language has a parser (T01 to T11, T15), with the path and the columns asked for."""
    return _generated(files, lambda c, l: PARSERS[l](c) if l in PARSERS else [], DEFINITION_ROW, columns)


def imports(files: DataFrame) -> DataFrame:
    """Rows of imports."""

    def make(content, language):
        if language == "python":
            return python_imports(content)
        return other_imports(content, language) if language in grammar.LANGUAGES else []

    return _generated(files, make, IMPORT_ROW)


def calls(files: DataFrame) -> DataFrame:
    return _generated(files, lambda c, l: python_calls(c) if l == "python" else [], CALL_ROW)


def scopes(files: DataFrame) -> DataFrame:
    return _generated(files, lambda c, l: python_scopes(c) if l == "python" else [], SCOPE_ROW)


def instance_types(files: DataFrame) -> DataFrame:
    return _generated(files, lambda c, l: python_instance_types(c) if l == "python" else [], TYPE_ROW)


def register(spark) -> None:
    """The parsers as SQL table functions: python_definitions(text), python_imports(text), python_calls(text)."""
    from pyspark.sql.functions import udtf

    def table(name: str, make, schema: str) -> None:
        columns = [c.split()[0] for c in re.split(r",\s*(?![^<]*>)", schema.removeprefix("path string, "))]

        class Rows:
            def eval(self, text: str):
                for row in make(text):
                    yield tuple(row.get(c) for c in columns)

        spark.udtf.register(name, udtf(Rows, returnType=schema.removeprefix("path string, ")))

    table("python_definitions", python_definitions, DEFINITION_ROW)
    table("python_imports", python_imports, IMPORT_ROW)
    table("python_calls", python_calls, CALL_ROW)


# -- lines ------------------------------------------------------------------------------
def line_counts(files: DataFrame, text_col: str = "content", key: str = "path") -> DataFrame:
    """key, total_lines, code_lines, comment_lines of any text, in the JVM."""
    stripped = F.transform(F.split(repaired_column(F.col(text_col)), "\n"), lambda x: F.trim(x))
    comment = lambda x: F.rlike(x, F.lit(r"^(//|#|/\*|\*)"))
    lines = files.select(key, stripped.alias("lines"))
    return lines.select(key, F.size("lines").cast("long").alias("total_lines"), F.size(F.filter("lines", lambda x: (x != "") & ~comment(x))).cast("long").alias("code_lines"), F.size(F.filter("lines", comment)).cast("long").alias("comment_lines"))


def structure_summary(files: DataFrame, most_lines: int = 100) -> DataFrame:
    """path, line_number, kind, name of what the first lines define or import."""
    lines = files.select("path", F.posexplode(F.slice(F.split("content", "\n"), 1, most_lines)).alias("pos", "line"))
    pick = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    cls, fn, imp = pick(r"^\s*(?:export\s+)?class\s+(\w+)"), pick(r"^\s*(?:export\s+)?(?:async\s+)?(?:def|function|fn|func)\s+(\w+)"), pick(r"^\s*(?:import|from|use|using|#include)\s+[<\"]?([\w./:]+)")
    kind = F.when(cls.isNotNull(), "class").when(fn.isNotNull(), "function").when(imp.isNotNull(), "import")
    return lines.select("path", (F.col("pos") + 1).alias("line_number"), kind.alias("kind"), F.coalesce(cls, fn, imp).alias("name")).where("kind is not null")


# -- elements -----------------------------------------------------------------------------
def elements(files: DataFrame, repo: str) -> DataFrame:
    """Element rows at four levels: file, class, function (methods too), documentation (T22). files: path, content."""
    own = with_language(files)
    rows = definitions(own).join(own.select("path", "content", "language"), "path")
    kind = F.when(F.col("kind") == "method", "function").otherwise(F.col("kind"))
    r = F.lit(repo)
    name_part = F.when(F.col("class_name").isNotNull(), F.concat_ws("/", "class_name", "name")).otherwise(F.col("name"))
    signature = F.when(F.col("kind") == "class", T.class_signature(F.col("name"), F.col("bases"))).when(F.col("kind").isin("function", "method"), T.signature(F.col("name"), F.col("parameters"), F.col("return_type"), F.col("is_async")))
    code = F.when(F.col("kind") == "documentation", F.col("docstring")).otherwise(T.line_range(F.col("content"), F.col("start_line"), F.col("end_line")))
    parts = rows.select(V.element_id(r, kind, F.col("path"), name_part).alias("id"), kind.alias("type"), "name", F.col("path").alias("relative_path"), "language", "start_line", "end_line", code.alias("code"), signature.alias("signature"), "docstring", "class_name", "bases", "complexity")
    counts = line_counts(own)
    modules = imports(own).groupBy("path").agg(F.array_sort(F.collect_set("module")).alias("imports"))
    whole = own.join(counts, "path").join(modules, "path", "left")
    none = F.lit(None).cast("string")
    whole = whole.select(V.element_id(r, F.lit("file"), F.col("path")).alias("id"), F.lit("file").alias("type"), T.base_name(F.col("path")).alias("name"), F.col("path").alias("relative_path"), "language", F.lit(1).alias("start_line"), F.col("total_lines").cast("int").alias("end_line"), F.col("content").alias("code"), none.alias("signature"), none.alias("docstring"), none.alias("class_name"), F.array().cast("array<string>").alias("bases"), F.lit(None).cast("int").alias("complexity"), F.coalesce("imports", F.array().cast("array<string>")).alias("imports"))
    both = whole.unionByName(parts, allowMissingColumns=True).withColumn("imports", F.coalesce("imports", F.array().cast("array<string>")))
    return both.withColumn("repo_name", r).withColumn("file_path", F.col("relative_path")).withColumn("summary", F.concat_ws(" ", "type", "name", F.concat(F.lit("in "), "relative_path")))
