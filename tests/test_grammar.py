"""Lexers and parsers of the languages with braces."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators import grammar
from millrace.operators import parsing as P


def rows(text, language):
    return [(r["kind"], r["class_name"], r["name"], r["start_line"], r["end_line"]) for r in grammar.declarations(text, language).rows]


def named(text, language):
    return {(r["class_name"], r["name"]) for r in grammar.declarations(text, language).rows}


def row(text, language, name):
    return next(r for r in grammar.declarations(text, language).rows if r["name"] == name)


# -- texts in which line patterns fail ---------------------------------------------------------
def test_parameters_on_several_lines():
    text = "static unsigned long add(int a,\n                         int (*f)(int, char *))\n{\n  return a;\n}\n"
    assert rows(text, "c") == [("function", None, "add", 1, 5)]
    found = row(text, "c", "add")
    assert found["parameters"] == ["int a", "int (*f)(int, char *)"] and found["return_type"] == "unsigned long"


def test_members_without_modifiers():
    text = "class Foo : Bar<int>, IBaz {\n  Foo(int a) : base(a) { }\n  int Get(string k) { return 1; }\n  List<T> All<T>(T x) where T : class => null;\n  (int, int) Pair() => (1, 2);\n  ~Foo() { }\n  int X { get; set; } = 3;\n  Func<int, int> F = x => { return x; };\n}\n"
    assert rows(text, "csharp") == [("class", None, "Foo", 1, 9), ("method", "Foo", "Foo", 2, 2), ("method", "Foo", "Get", 3, 3), ("method", "Foo", "All", 4, 4), ("method", "Foo", "Pair", 5, 5), ("method", "Foo", "~Foo", 6, 6)]
    assert row(text, "csharp", "Foo")["bases"] == ["Bar", "IBaz"] and row(text, "csharp", "All")["return_type"] == "List<T>"


def test_methods_on_one_line():
    assert rows("class K { m() { return 1; } n(a, b) { if (a) { b(); } } static async *g() {} get v() { return 2; } #p() {} }", "javascript") == [("class", None, "K", 1, 1)] + [("method", "K", n, 1, 1) for n in ("m", "n", "g", "v", "#p")]


def test_generic_arrow():
    text = "export const g = <T,>(x: T) => x;\nexport const h = async <T extends { a: number }>(x: T, ...y: T[]): Promise<T> => {\n  return x;\n};\nconst k: (a: number) => void = (a) => { use(a); }, l = b => b + 1;\n"
    assert rows(text, "typescript") == [("function", None, "g", 1, 1), ("function", None, "h", 2, 4), ("function", None, "k", 5, 5), ("function", None, "l", 5, 5)]
    assert row(text, "typescript", "h")["parameters"] == ["x: T", "...y: T[]"] and row(text, "typescript", "h")["return_type"] == "Promise<T>" and row(text, "typescript", "h")["is_async"]


def test_regular_expressions():
    text = 'function a(x) {\n  const r = /["{]/g;\n  return /[/\'{]\\/`/.test(x) ? x / 2 / 1 : x;\n}\nfunction b() {}\n'
    assert rows(text, "javascript") == [("function", None, "a", 1, 4), ("function", None, "b", 5, 5)]


def test_raw_texts():
    rust = 'fn a() -> &\'static str {\n  r#"a " { quote"#\n}\nfn b<\'a>(x: &\'a str) { let c = \'{\'; let d = b\'\\\'\'; }\n'
    assert rows(rust, "rust") == [("function", None, "a", 1, 3), ("function", None, "b", 4, 4)]
    cpp = 'auto a() {\n  return R"x(" { )" )x";\n}\nint b() { return 1; }\n'
    assert rows(cpp, "cpp") == [("function", None, "a", 1, 3), ("function", None, "b", 4, 4)]
    sharp = 'class A {\n  string S() { return @"a ""{"" \\"; }\n  string T() => $"{(x ? "}" : "{")} {{";\n  string U() { return """\n  { " }\n  """; }\n  int V() { return 1; }\n}\n'
    assert rows(sharp, "csharp") == [("class", None, "A", 1, 8), ("method", "A", "S", 2, 2), ("method", "A", "T", 3, 3), ("method", "A", "U", 4, 6), ("method", "A", "V", 7, 7)]
    script = "function a() {\n  return `x ${ `${b({c: '}'})}` } {`;\n}\nfunction d() {}\n"
    assert rows(script, "javascript") == [("function", None, "a", 1, 3), ("function", None, "d", 4, 4)]


def test_nested_comments():
    assert rows("fn a() {\n  /* x /* { */ y { */\n  1\n}\nfn b() {}\n", "rust") == [("function", None, "a", 1, 4), ("function", None, "b", 5, 5)]


def test_implementations():
    text = "pub struct P<T>(T);\nimpl<T: Copy> P<T> where T: Send {\n  /// Makes one.\n  #[inline]\n  pub const fn new(x: T) -> Self { P(x) }\n  async fn go(&mut self, n: usize) -> Option<T> { fn inner() {} None }\n}\nimpl<'a> fmt::Display for a::Q<'a> { fn fmt(&self, f: &mut F) -> R { write!(f, \"{}\", 1) } }\ntrait S: Clone + 'static { fn need(&self); fn has(&self) -> i32 { 1 } }\nmod m { pub enum E { A { x: i32 }, B } fn free() {} }\n"
    assert rows(text, "rust") == [("class", None, "P", 1, 1), ("method", "P", "new", 5, 5), ("method", "P", "go", 6, 6), ("function", None, "inner", 6, 6), ("method", "Q", "fmt", 8, 8), ("class", None, "S", 9, 9), ("method", "S", "need", 9, 9), ("method", "S", "has", 9, 9), ("class", None, "E", 10, 10), ("function", None, "free", 10, 10)]
    assert row(text, "rust", "S")["bases"] == ["Clone"] and row(text, "rust", "new")["decorators"] == ["inline"] and row(text, "rust", "go")["parameters"] == ["n: usize"]
    assert row(text, "rust", "go")["return_type"] == "Option<T>" and row(text, "rust", "go")["is_async"]


# -- more of each language -----------------------------------------------------------------------
def test_scripts():
    text = """// About
// the module.
import React, { useState as use, type X } from 'react';
import * as ns from "ns";
import './side.css';
const fs = require('fs'), y = 1;
/**
 * A view.
 */
@Component({ a: "{" })
export default class View<P> extends base.View<P> implements A, B {
  private n: number = 1;
  handler = async (e: Event): Promise<void> => { this.go(e); };
  static { init(); }
  @Input() name?: string;
  constructor(private a: string, b = { c: 1 }) { super(); }
  render(): JSX.Element | { a: number } {
    const inner = () => 1;
    return <p>Don't</p>;
  }
  abstract later(x: number): void;
  'quoted name'() {}
}
interface I extends J<K>, L { m(a: string): void; n?: () => void }
export enum E { A = 1 }
type T<U> = { a: U } | null;
namespace N { export function deep(this: Window): asserts x is string { } }
export async function* load(url, { a, b } = {}) {
  for await (const x of y) { if (x) { function nested() {} } }
}
var old = function () { return 1 }
let late
module.exports = { old };
"""
    got = {(r["class_name"], r["name"]): r for r in grammar.declarations(text, "typescript").rows}
    assert set(got) == {(None, "View"), ("View", "handler"), ("View", "constructor"), ("View", "render"), (None, "inner"), ("View", "later"), ("View", "quoted name"), (None, "I"), ("I", "m"), (None, "E"), (None, "T"), (None, "deep"), (None, "load"), (None, "nested"), (None, "old")}
    view = got[None, "View"]
    assert view["bases"] == ["base.View", "A", "B"] and view["decorators"] == ["Component"] and (view["start_line"], view["end_line"]) == (11, 23)
    assert got["View", "constructor"]["parameters"] == ["private a: string", "b = { c: 1 }"] and got["View", "handler"]["is_async"] and got["View", "handler"]["return_type"] == "Promise<void>"
    assert got["View", "render"]["return_type"] == "JSX.Element | { a: number }" and (got["View", "render"]["start_line"], got["View", "render"]["end_line"]) == (17, 20)
    assert got[None, "I"]["bases"] == ["J", "L"] and got[None, "load"]["parameters"] == ["url", "{ a, b } = {}"]
    assert got[None, "T"]["end_line"] == 26 and got[None, "old"]["end_line"] == 31
    imports = [(i["module"], i["names"], i["alias"], i["line"]) for i in grammar.declarations(text, "typescript").imports]
    assert imports == [("react", ["React", "useState", "X"], None, 3), ("ns", ["*"], "ns", 4), ("./side.css", [], None, 5), ("fs", [], None, 6)]


def test_documentation():
    text = "/**\n * Adds.\n * @param a one\n */\nfunction add(a) {}\n\n// gone\n\n\nfunction b() {}\n// One\n// two\nfunction c() {}\n"
    assert row(text, "javascript", "add")["docstring"] == "Adds.\n@param a one" and row(text, "javascript", "b")["docstring"] is None and row(text, "javascript", "c")["docstring"] == "One\ntwo"


def test_native():
    text = """#include <vector>
# include "a/b.h" // here
#define OPEN {
#if 0
void gone() {
#else
namespace a::b {
#endif
template <typename T, int N = (1 > 0)>
class Grid final : public Base<T>, private virtual other::Mixin {
public:
  explicit Grid(int n) noexcept : size_{n}, rows_(n) { fill({1, 2}); }
  ~Grid() override = default;
  virtual auto at(int i) const -> T& { return rows_[i]; }
  bool operator==(const Grid& o) const { return true; }
  int operator()(int x) { return x; }
  struct Inner { int v; void f() {} } inner;
  int table[2] = {1, 2};
  void declared(int a);
};
template <> std::vector<int> Grid<int, 2>::all(std::map<int, int> m) const
{
  auto f = [&](int x) { return x; };
  return {};
}
}
enum class Color : int { Red, Green };
typedef struct { int x; } Point;
struct node *make(struct node *n, void (*done)(void)) { return n; }
extern "C" { int c_call(void) { return 1; } }
#ifdef A
int twice(int a) {
#else
int twice(long a) {
#endif
  return 2; }
int last = 1;
int main(void) { return '{' + 1; }
"""
    got = {(r["class_name"], r["name"]): r for r in grammar.declarations(text, "cpp").rows}
    assert set(got) == {(None, "Grid"), ("Grid", "Grid"), ("Grid", "at"), ("Grid", "operator=="), ("Grid", "operator()"), (None, "Inner"), ("Inner", "f"), ("Grid", "all"), (None, "Color"), (None, "Point"), (None, "make"), (None, "c_call"), (None, "twice"), (None, "main")}
    assert got[None, "Grid"]["bases"] == ["Base", "other::Mixin"] and got[None, "Grid"]["end_line"] == 20
    assert got["Grid", "all"]["return_type"] == "std::vector<int>" and got["Grid", "all"]["parameters"] == ["std::map<int, int> m"] and got["Grid", "all"]["start_line"] == 21
    assert got[None, "make"]["parameters"] == ["struct node *n", "void (*done)(void)"] and got[None, "main"]["parameters"] == []
    assert [(i["module"], i["line"]) for i in grammar.declarations(text, "cpp").imports] == [("vector", 1), ("a/b.h", 2)]


def test_uses():
    text = "use std::io;\npub use a::{b, c::{self, d as e}, f::*};\nuse x as y;\n"
    assert [(i["module"], i["names"], i["alias"]) for i in grammar.declarations(text, "rust").imports] == [("std::io", ["io"], None), ("a::b", ["b"], None), ("a::c", ["c"], None), ("a::c::d", ["d"], "e"), ("a::f::*", ["*"], None), ("x", ["x"], "y")]


def test_sharp():
    text = """using System.Text;
using static System.Math;
using L = System.Collections.Generic.List<int>;
#region here {
namespace A.B;
/// <summary>Does.</summary>
[Serializable, Obsolete("x{")]
public abstract partial class Foo<T> : Base, IDo<T> where T : new()
{
  public Foo() : this(1) { }
  [Test]
  public static async Task<int> Run(int a, params string[] b) { await Go(); int Local() => 1; return a; }
  void IDo<T>.Do(ref int x) { using (var y = Z()) { } }
  public static Foo<T> operator +(Foo<T> a, Foo<T> b) => a;
  public int this[int i] { get { return i; } }
  public event Action E { add { } remove { } }
  delegate int Handler(int x);
  Dictionary<string, Func<int>> map = new() { ["{"] = () => { return 1; } };
  protected abstract void Later();
  public record Point(int X, int Y);
  enum Color { Red, Blue }
  interface IIn { void M(); }
}
record struct R(int A) { public int B() => A; }
"""
    got = {(r["class_name"], r["name"]): r for r in grammar.declarations(text, "csharp").rows}
    assert set(got) == {(None, "Foo"), ("Foo", "Foo"), ("Foo", "Run"), ("Foo", "Do"), ("Foo", "operator +"), ("Foo", "Later"), (None, "Point"), (None, "Color"), (None, "IIn"), ("IIn", "M"), (None, "R"), ("R", "B")}
    foo = got[None, "Foo"]
    assert foo["bases"] == ["Base", "IDo"] and foo["decorators"] == ["Serializable", "Obsolete"] and foo["docstring"] == "<summary>Does.</summary>" and foo["end_line"] == 23
    assert got["Foo", "Run"]["parameters"] == ["int a", "params string[] b"] and got["Foo", "Run"]["is_async"] and got["Foo", "Run"]["return_type"] == "Task<int>"
    assert [(i["module"], i["alias"]) for i in grammar.declarations(text, "csharp").imports] == [("System.Text", None), ("System.Math", None), ("System.Collections.Generic.List<int>", "L")]


@pytest.mark.parametrize("language", grammar.LANGUAGES)
def test_texts_that_are_not_closed(language):
    for text in ("", "{", "}", "class", "class A", "class A {", "function f(", "int f(int a) {\n  return a;\n", "fn f(", "a = (", '"', "'", "`${", "/* ", "#", "#if 0\n", "class A { m(", "template <", "impl", "using", "[", "x < y", "R\"(", "r#\"", "@\"", "$\"{"):
        assert all(r["end_line"] >= r["start_line"] >= 1 for r in grammar.declarations(text, language).rows), text
    assert rows("int f(int a);\nint g(int a) {\n  return a;\n", "c") == [("function", None, "g", 2, 3)] or language != "c"


PIECES = st.lists(st.sampled_from(["class ", "A", " {", "}", "(", ")", "<", ">", "fn ", "f", ";", "=", "=>", ":", "\n", '"', "'", "`", "${", "/*", "*/", "//", "/", "#", "#if 0", "#else", "r#\"", "R\"x(", "@\"", "impl ", "struct ", "use ", "using ", "function ", "const ", "import ", "operator", "~", "::", ",", "[", "]", "enum ", "template <", "é"]), max_size=40)


@pytest.mark.parametrize("language", grammar.LANGUAGES)
@settings(max_examples=150, deadline=None)
@given(pieces=PIECES)
def test_any_text(language, pieces):
    found = grammar.declarations("".join(pieces), language)
    lines = "".join(pieces).count("\n") + 1
    assert all(1 <= r["start_line"] <= r["end_line"] <= lines for r in found.rows) and all(r["name"] for r in found.rows)


def test_long_texts_take_linear_time():
    import time

    took = []
    for n in (4000, 16000):
        text = "".join(f"fn f{i}(x: &'static str) -> i32 {{ if x == \"{{\" {{ {i} }} else {{ 0 }} }}\n" for i in range(n))
        began = time.perf_counter()
        assert len(rows(text, "rust")) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def test_languages_of_the_engine():
    js = "import React from 'react';\nexport class View extends Base {\n  render(a, b) {\n    return 1;\n  }\n}\n"
    assert [r["name"] for r in P.PARSERS["javascript"](f"```js\n{js}```\n")] == ["View", "render"] and P.PARSERS["c"](None) == []
    assert "cobol" not in P.PARSERS and [i["module"] for i in P.other_imports(js, "javascript")] == ["react"]


@pytest.mark.parametrize("language", ["javascript", "typescript", "cpp", "rust", "csharp"])
def test_imports_alone_make_no_rows_of_definitions(language):
    text = "import x from 'm';\n#include <m>\nuse a::m;\nusing A.m;\nstruct S { x: i32 }\n/* b */ class K { int f(int a) { return 1; } }\n"
    both, alone = grammar.declarations(text, language), grammar.declarations(text, language, with_rows=False)
    assert both.rows and both.imports and alone.imports == both.imports and not alone.rows


def test_marks_that_may_be_special():
    kinds = lambda text, language: [(t.kind, t.text) for t in grammar.Source(text, language).tokens]
    assert kinds("`a\\`${ {`}`} /* ` */ }b` / 'c' // `", "javascript") == [("text", "`a\\`${ {`}`} /* ` */ }b`"), ("mark", "/"), ("text", "'c'")]
    assert kinds("br b'x' 'a r#fn r##\"\"# \"## c", "rust") == [("word", "br"), ("text", "b'x'"), ("mark", "'a"), ("word", "r#fn"), ("text", 'r##""# "##'), ("word", "c")]
    assert kinds('@"a""b" @in $x u8R"-()")-" ', "csharp")[:4] == [("text", '@"a""b"'), ("word", "@in"), ("mark", "$"), ("word", "x")]
    assert kinds('u8R"-()")-" /*/ a */ .5e+3\\\n#if 0', "cpp") == [("text", 'u8R"-()")-"'), ("number", ".5e+3")]


def test_files_of_all_languages_read_each_document_once(spark):
    from millrace import code_queries

    plan = code_queries._brace_files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
