"""Declarations of JavaScript, TypeScript, C, C++, Rust and C#: a lexer per language, and parsers over its tokens.

The lexer knows what isn't code: comments (nested ones in Rust), texts of all kinds (raw, verbatim, templates with code inside),
regular expressions, preprocessor lines. Brackets are then matched, and a recursive parser walks the declarations: it takes
modules, types and functions apart by their keywords, and steps over everything else from bracket to bracket. What isn't
closed ends with its surroundings; text that fits no rule is stepped over, so that every text gives some rows and never an error.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


class Token(NamedTuple):
    kind: str  # word, number, text, mark, include
    text: str
    start: int
    end: int


_NUMBER = r"\.?\d(?:[\w.]|(?<=[eEpP])[+-])*"
_MARK = r"=>|->|::|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\.\.\.|."
_LINE_COMMENT, _NESTED = re.compile(r"//(?:[^\\\n]++|\\\n|\\)*+"), re.compile(r"/\*|\*/")
_QUOTED = {q: re.compile(rf"{q}(?:[^{q}\\\n]++|\\.)*+{q}?", re.S) for q in "\"'"}
_LONG_QUOTED, _VERBATIM = re.compile(r'"(?:[^"\\]++|\\.)*+"?', re.S), re.compile(r'(?:\$@|@\$|@)"(?:[^"]++|"")*+"?')
#: What stands in a template, or in code within one, and ends neither.
_IN_TEMPLATE, _IN_CODE = re.compile(r"[^\\`$]*"), re.compile("[^\"'/`{}]*")
_RAW_C, _DIRECTIVE, _CONDITION = re.compile(r'(?:u8|[uUL])?R"([^()\\\s]{0,16})\('), re.compile(r"#\s*(\w*)(?:\\\n|/\*.*?\*/|[^\n])*", re.S), re.compile(r"^[ \t]*#[ \t]*(\w+)[^\n]*", re.M)
_RAW_RUST, _TEXT_RUST, _CHARACTER, _LIFETIME, _RAW_WORD = re.compile(r'[bc]?r(#*)"'), re.compile(r'[bc]?(?=")'), re.compile(r"b?'(?:\\(?:x..|u\{[^}]*\}|.)|[^'\\\n])'", re.S), re.compile(r"'\w+"), re.compile(r"r#(\w+)")
_RAW_SHARP, _AT_WORD = re.compile(r'\$*("{3,})'), re.compile(r"@[^\W\d]\w*")
_SHORT, _DOLLARS = r"[^\W\d]\w*", r"[^\W\d][\w$]*|[$#@][^\W\d][\w$]*|\$[\w$]*"
_COMMENT_MARKS = re.compile(r"^\s*(?:///?!?|/\*+!?|\*+/|\*(?!/))\s?|\s*\*+/\s*$")
_KINDS = (None, "word", "number", "text", "mark")


def _plain(word: str, special: str) -> tuple[re.Pattern, re.Pattern]:
    """Space, then a word, number, text or mark as group 1 to 4, unless a comment or what is special may begin there; and the same whatever begins."""
    tokens = f"({word})|({_NUMBER})|({'|'.join(x.pattern for x in _QUOTED.values())})|({_MARK})"
    return re.compile(rf"(?:\s++|\\\n)*+(?:(?!/|{special})(?:{tokens}))?", re.S), re.compile(tokens, re.S)


_PLAIN = {"javascript": _plain(_DOLLARS, r"`|\A#"), "c": _plain(_SHORT, r'#|(?:u8|[uUL])?R"'), "rust": _plain(_SHORT, """[bc]?r?["#]|b?'"""), "csharp": _plain(_SHORT, '[#"$@]')}
_PLAIN |= {"typescript": _PLAIN["javascript"], "cpp": _PLAIN["c"]}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())


class Source:
    """A text's tokens, where brackets close, and the comments between."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.tokens: list[Token] = []
        self._words: list[str] = []  # of each token, as word() gives them
        self.comments: dict[int, tuple[int, int]] = {}  # end, start and end of the comment; by the place of the next token
        self._breaks = [m.start() for m in re.finditer("\n", text)]
        self._lex()
        self.match = self._matched()

    # -- lexer ------------------------------------------------------------------------
    def _lex(self) -> None:
        text, n, at, held = self.text, len(self.text), 0, None
        special, (plain, whatever) = getattr(self, f"_{self.language}"), _PLAIN[self.language]
        match, add, word = plain.match, self.tokens.append, self._words.append
        while True:
            m = match(text, at)
            if group := m.lastindex:
                kind, (start, end) = _KINDS[group], m.span(group)
            else:
                start = m.end()
                if start >= n:
                    break
                end = self._comment(start)
                if end:
                    held = (held[0] if held and not text[held[1] : start].strip() else start, end)
                    at = end
                    continue
                if found := special(start):
                    kind, end = found
                else:
                    m = whatever.match(text, start)
                    kind, end = _KINDS[m.lastindex], m.end()
            if kind != "skip":
                if held and text.count("\n", held[1], start) <= 1:
                    self.comments[len(self.tokens)] = held
                held, code = None, text[start:end]
                add(Token(kind, code, start, end))
                word(code if kind == "word" or kind == "mark" else "")
            at = end

    def _comment(self, at: int) -> int | None:
        text = self.text
        if text.startswith("//", at):
            return _LINE_COMMENT.match(text, at).end()
        if not text.startswith("/*", at):
            return None
        if self.language != "rust":
            end = text.find("*/", at + 2)
            return len(text) if end < 0 else end + 2
        depth = 0
        for m in _NESTED.finditer(text, at):
            depth += 1 if m.group() == "/*" else -1
            if not depth:
                return m.end()
        return len(text)

    def _javascript(self, at: int) -> tuple[str, int] | None:
        text, c = self.text, self.text[at]
        if c == "`":
            return "text", self._template(at)
        if c == "/":
            last = self.tokens[-1] if self.tokens else None
            operand = last and (last.kind in ("number", "text") or last.kind == "word" and last.text not in _BEFORE_REGEX or last.text in (")", "]"))
            if not operand and not (last and last.text == "<" and last.end == at) and (m := _REGEX.match(text, at)):
                return "text", m.end()
        return ("skip", (text.find("\n", at) + 1 or len(text))) if c == "#" and at == 0 and text.startswith("#!") else None

    _typescript = _javascript

    def _template(self, at: int) -> int:
        """The end of a template; code within ${} may hold texts and templates of its own."""
        text, n, todo = self.text, len(self.text), ["`"]
        at += 1
        while todo:
            at = (_IN_TEMPLATE if todo[-1] == "`" else _IN_CODE).match(text, at).end() if at < n else at
            if at >= n:
                break
            c = text[at]
            if todo[-1] == "`":
                if c == "\\":
                    at += 1
                elif c == "`":
                    todo.pop()
                elif c == "$" and text.startswith("${", at):
                    todo.append("}")
                    at += 1
            elif c in _QUOTED:
                at = _QUOTED[c].match(text, at).end() - 1
            elif end := self._comment(at):
                at = end - 1
            elif c in "`{":
                todo.append("`" if c == "`" else "}")
            elif c == "}":
                todo.pop()
            at += 1
        return at

    def _c(self, at: int) -> tuple[str, int] | None:
        text = self.text
        if m := _RAW_C.match(text, at):
            end = text.find(f'){m.group(1)}"', m.end())
            return "text", len(text) if end < 0 else end + len(m.group(1)) + 2
        if text[at] == "#" and not text[text.rfind("\n", 0, at) + 1 : at].strip():
            return self._directive(at)
        return None

    _cpp = _c

    def _directive(self, at: int) -> tuple[str, int]:
        """A preprocessor line. Of conditional parts the first counts, or the second after #if 0: so brackets stay in pairs."""
        text = self.text
        m = _DIRECTIVE.match(text, at)
        name = m.group(1)
        if name in ("include", "import", "include_next"):
            return "include", m.end()
        if name in ("else", "elif", "elifdef", "elifndef") or name == "if" and re.fullmatch(r"#\s*if\s+0\s*", m.group()):
            depth, end = 0, m.end()
            for d in _CONDITION.finditer(text, m.end()):
                if d.group(1) in ("if", "ifdef", "ifndef"):
                    depth += 1
                elif d.group(1) == "endif" or (depth == 0 and name == "if" and d.group(1) in ("else", "elif")):
                    if not depth:
                        return "skip", d.end()
                    depth -= 1
                end = d.end()
            return "skip", end
        return "skip", m.end()

    def _rust(self, at: int) -> tuple[str, int] | None:
        text = self.text
        if m := _RAW_RUST.match(text, at):
            end = text.find('"' + m.group(1), m.end())
            return "text", len(text) if end < 0 else end + 1 + len(m.group(1))
        if m := _TEXT_RUST.match(text, at):
            return "text", _LONG_QUOTED.match(text, m.end()).end()
        if m := _CHARACTER.match(text, at):
            return "text", m.end()
        if m := _LIFETIME.match(text, at):
            return "mark", m.end()  # a lifetime
        if m := _RAW_WORD.match(text, at):
            return "word", m.end()
        return None

    def _csharp(self, at: int) -> tuple[str, int] | None:
        text = self.text
        if m := _RAW_SHARP.match(text, at):
            end = text.find(m.group(1), m.end())
            return "text", len(text) if end < 0 else end + len(m.group(1))
        if m := _VERBATIM.match(text, at):
            return "text", m.end()
        if text.startswith('$"', at):
            return "text", self._interpolated(at + 2)
        if text[at] == "#" and not text[text.rfind("\n", 0, at) + 1 : at].strip():
            return "skip", (text.find("\n", at) + 1 or len(text))
        if m := _AT_WORD.match(text, at):
            return "word", m.end()
        return None

    def _interpolated(self, at: int) -> int:
        """The end of $"..", whose braces hold code with texts of its own."""
        text, depth = self.text, 0
        while at < len(text):
            c = text[at]
            if c == "\\" and not depth:
                at += 1
            elif c == "{":
                depth += not text.startswith("{{", at) or depth > 0
                at += text.startswith("{{", at) and not depth
            elif c == "}":
                depth = max(depth - 1, 0)
            elif c == '"':
                if not depth:
                    return at + 1
                at = _QUOTED['"'].match(text, at).end() - 1
            elif c == "\n" and not depth:
                return at
            at += 1
        return at

    def _matched(self) -> dict[int, int]:
        """Where each opening bracket closes, as places in tokens. A closing bracket closes the last that fits, and what stands open within."""
        out: dict[int, int] = {}
        todo: list[int] = []
        for i, c in enumerate(self._words):
            if c in OPEN:
                todo.append(i)
            elif c in CLOSE:
                fits = next((k for k in range(len(todo) - 1, -1, -1) if self.tokens[todo[k]].text == CLOSE[c]), None)
                # a brace isn't closed by another kind of bracket
                if fits is None or c != "}" and any(self.tokens[j].text == "{" for j in todo[fits + 1 :]):
                    continue
                for j in todo[fits:]:
                    out[j] = i
                del todo[fits:]
        return out | dict.fromkeys(todo, len(self.tokens))

    # -- places ----------------------------------------------------------------------------
    def word(self, i: int) -> str:
        """The text of a token; nothing beyond the end, and for texts."""
        return self._words[i] if 0 <= i < len(self._words) else ""

    def named(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "word"

    def after(self, i: int) -> int:
        """The place after a token, or after what it opens."""
        return self.match[i] + 1 if i in self.match else i + 1

    def line(self, i: int, last: bool = False) -> int:
        if i >= len(self.tokens):
            return len(self._breaks) + 1 - (self.text.endswith("\n") and bool(self._breaks))
        return bisect.bisect_left(self._breaks, self.tokens[i].end - 1 if last else self.tokens[i].start) + 1

    def line_end(self, at: int) -> int:
        """Where the line of a place in the text ends."""
        i = bisect.bisect_left(self._breaks, at)
        return self._breaks[i] if i < len(self._breaks) else len(self.text)

    def slice(self, lo: int, hi: int) -> str:
        """The code of tokens lo to hi - 1, on one line."""
        return " ".join(self.text[self.tokens[lo].start : self.tokens[min(hi, len(self.tokens)) - 1].end].split()) if lo < min(hi, len(self.tokens)) else ""

    def split(self, lo: int, hi: int) -> list[str]:
        """The parts between commas, of what stands outside of all brackets."""
        out, at, i, angles = [], lo, lo, 0
        while i < hi:
            c = self.word(i)
            angles = max(angles + (c == "<") - (c == ">"), 0)
            if c == "," and not angles:
                out.append(self.slice(at, i))
                at = i + 1
            i = self.after(i)
        return [x for x in [*out, self.slice(at, hi)] if x]

    def beyond_angles(self, i: int) -> int:
        """The place after a list in angle brackets that may stand here."""
        if self.word(i) != "<":
            return i
        depth, start = 0, i
        while i < len(self.tokens):
            c = self.word(i)
            depth += (c == "<") - (c == ">")
            if not depth:
                return i + 1
            if c in ";{" and c or c in CLOSE:
                return start if c != "{" else self._past(i, start)
            i = self.after(i)
        return start

    def _past(self, i: int, start: int) -> int:
        """A brace in angle brackets is a type or an argument, if the angles close on after it."""
        j = self.after(i)
        while j < len(self.tokens) and self.word(j) not in (";", "{", "}"):
            if self.word(j) == ">":
                return j + 1
            j = self.after(j)
        return start

    def comment_before(self, i: int) -> str | None:
        """What the comment right before a token says."""
        if i not in self.comments:
            return None
        lines = [_COMMENT_MARKS.sub("", x) if x.lstrip()[:1] in ("/", "*") or x.rstrip().endswith("*/") else x for x in self.text[slice(*self.comments[i])].split("\n")]
        return "\n".join(x.rstrip() for x in lines).strip() or None


@dataclass
class Declarations:
    """Rows of definitions, if they are wanted, and imports found so far."""

    source: Source
    rows: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    with_rows: bool = True

    def add(self, kind: str, name: str, first: int, last: int, *, at: int | None = None, parameters=(), returns: str = "", bases=(), is_async=False, class_name: str | None = None, decorators=()) -> None:
        """first, last: places of the first and last token; at: where the comment about it ends, if not at first."""
        if not self.with_rows:
            return
        s = self.source
        start, end = s.line(first), s.line(last, last=True)
        header = s.text[s.tokens[first].start : s.line_end(s.tokens[first].start)].strip()
        self.rows.append({"kind": kind, "name": name, "start_line": start, "end_line": max(start, end), "docstring": s.comment_before(first if at is None else at), "parameters": list(parameters), "return_type": returns or None, "is_async": is_async, "class_name": class_name, "bases": list(bases), "decorators": list(decorators), "complexity": None, "header": header})

    def function(self, name: str, first: int, last: int, class_name: str | None, **more) -> None:
        self.add("method" if class_name else "function", name, first, last, class_name=class_name, **more)

    def module(self, name: str, at: int, names=(), is_from=False, alias: str | None = None) -> None:
        self.imports.append({"module": name, "names": list(names), "is_from": is_from, "line": self.source.line(at), "level": 0, "alias": alias})


def _unquoted(text: str) -> str:
    return text[1:-1] if len(text) > 1 else ""


# -- JavaScript and TypeScript ---------------------------------------------------------------
_JS_BEFORE = frozenset("static async public private protected readonly abstract override get set declare accessor".split())
_JS_GOES_ON = frozenset("= + - * / % & | ^ ! ~ ? : , . < > ( [ { => && || ?? == === != !== <= >= extends instanceof in of".split())


class _Script:
    def __init__(self, found: Declarations, typed: bool):
        self.s, self.found, self.typed = found.source, found, typed

    def walk(self, lo: int, hi: int) -> None:
        """Declarations anywhere among tokens lo to hi - 1."""
        s, i = self.s, lo
        while i < hi:
            w = s.word(i)
            if w in ("class", "interface", "enum", "function", "const", "let", "var", "import", "require", "type", "namespace", "module") and s.word(i - 1) not in (".", "?.") and s.word(i + 1) not in (":", "=>", ")", ","):
                i = getattr(self, f"_{'variable' if w in ('const', 'let', 'var') else 'space' if w in ('namespace', 'module') else w}")(i, hi)
            else:
                i += 1

    def _class(self, i: int, hi: int, name: str = "") -> int:
        s, at = self.s, i + 1
        if s.named(at) and s.word(at) not in ("extends", "implements"):
            name, at = s.word(at), at + 1
        at, bases = self._heritage(s.beyond_angles(at), hi)
        if s.word(at) != "{":
            return i + 1
        first = i
        while s.word(first - 1) in ("abstract", "default", "export", "declare") and s.line(first - 1) == s.line(i):
            first -= 1
        end = s.match[at]
        if name:
            self.found.add("class", name, first, end, bases=bases, decorators=self._decorators(first))
        self._members(at + 1, end, name or None)
        return end + 1

    def _heritage(self, at: int, hi: int) -> tuple[int, list[str]]:
        s, bases = self.s, []
        while at < hi and s.word(at) in ("extends", "implements", ","):
            at, name = at + 1, ""
            while s.named(at) or s.word(at) == ".":
                name, at = name + s.word(at), at + 1
                if s.word(at) in ("implements", "extends"):
                    break
            at = s.beyond_angles(at)
            while s.word(at) in ("(", "[", "."):
                at = s.after(at)
            if name:
                bases.append(name)
        return at, bases

    def _decorators(self, first: int) -> list[str]:
        """Names of the @ before a declaration."""
        s, out = self.s, []
        i = first - 1
        while i >= 0:
            if s.word(i) == ")":
                i = next((j for j in range(i, -1, -1) if s.match.get(j) == i), -1) - 1
            if s.word(i).startswith("@"):
                out.insert(0, s.word(i)[1:])
                i -= 1
            else:
                break
        return out

    def _interface(self, i: int, hi: int) -> int:
        s = self.s
        if not (self.typed and s.named(i + 1)):
            return i + 1
        at, bases = self._heritage(s.beyond_angles(i + 2), hi)
        if s.word(at) != "{":
            return i + 1
        self.found.add("class", s.word(i + 1), i, s.match[at], bases=bases)
        self._members(at + 1, s.match[at], s.word(i + 1))
        return s.match[at] + 1

    def _enum(self, i: int, hi: int) -> int:
        s = self.s
        if not (self.typed and s.named(i + 1) and s.word(i + 2) == "{"):
            return i + 1
        self.found.add("class", s.word(i + 1), i, s.match[i + 2])
        return s.match[i + 2] + 1

    def _type(self, i: int, hi: int) -> int:
        s = self.s
        at = s.beyond_angles(i + 2)
        if not (self.typed and s.named(i + 1) and s.word(at) == "="):
            return i + 1
        end = self._expression_end(at + 1, hi)
        self.found.add("class", s.word(i + 1), i, end - 1)
        return end

    def _space(self, i: int, hi: int) -> int:
        return i + 1

    def _function(self, i: int, hi: int, name: str = "", first: int | None = None) -> int:
        s, at = self.s, i + 1
        at += s.word(at) == "*"
        if s.named(at):
            name, at = s.word(at), at + 1
        at = s.beyond_angles(at)
        if s.word(at) != "(":
            return i + 1
        before = s.word(i - 1) == "async"
        first = i - before if first is None else first
        while s.word(first - 1) in ("export", "default", "declare") and s.line(first - 1) == s.line(first):
            first -= 1
        body, returns = self._returns(s.after(at), hi)
        end = s.match[body] if s.word(body) == "{" else body - 1
        if name:
            self.found.function(name, first, end, None, parameters=s.split(at + 1, s.match[at]), returns=returns, is_async=before)
        self.walk(body, end)
        return end + 1

    def _returns(self, at: int, hi: int) -> tuple[int, str]:
        """The place after a type that may stand here, which is that of a body or the end of a signature."""
        s = self.s
        if s.word(at) != ":":
            return at, ""
        start = at = at + 1
        while at < hi:
            w = s.word(at)
            if w in (";", "}", "=>") or w == "{" and at > start and s.word(at - 1) not in ("|", "&", ":", "is"):
                break
            if s.line(at) > s.line(at - 1, last=True) and w not in ("|", "&", "{") and s.word(at - 1) not in ("|", "&", ":"):
                break
            at = s.beyond_angles(at) if w == "<" else s.after(at)
            if w == "<" and s.word(at) == "<":
                at += 1
        return at, s.slice(start, at)

    def _value(self, at: int, hi: int, name: str, first: int, class_name: str | None) -> int | None:
        """The place after a function or class that is the value of a name; None if it is something else."""
        s, start = self.s, at
        if s.word(at) == "class":
            return self._class(at, hi, name)
        is_async = s.word(at) == "async" and (s.named(at + 1) or s.word(at + 1) in ("(", "<"))
        at += is_async
        if s.word(at) == "function":
            if not class_name:
                return self._function(at, hi, name, first)
            return None
        at = s.beyond_angles(at)
        if s.word(at) == "(":
            parameters = s.split(at + 1, s.match[at])
            at, returns = self._returns(s.after(at), hi)
        elif s.named(at):
            parameters, returns, at = [s.word(at)], "", at + 1
        else:
            return None
        if s.word(at) != "=>":
            return None
        at += 1
        end = s.match[at] + 1 if s.word(at) == "{" else self._expression_end(at, hi)
        self.found.function(name, first, min(end, hi) - 1, class_name, parameters=parameters, returns=returns, is_async=is_async)
        self.walk(at, end)
        return max(end, start + 1)

    def _expression_end(self, at: int, hi: int) -> int:
        """The place after an expression: at a comma, a semicolon, or where a line ends that doesn't go on."""
        s, start = self.s, at
        while at < hi:
            w = s.word(at)
            if w in (",", ";") or w in CLOSE:
                return at
            if at > start and s.line(at) > s.line(at - 1, last=True) and s.word(at - 1) not in _JS_GOES_ON and w not in _JS_GOES_ON - {"(", "[", "{", "!"}:
                return at
            at = s.after(at)
        return hi

    def _variable(self, i: int, hi: int) -> int:
        """const a = .., b = .."""
        s, at = self.s, i + 1
        if s.word(at) == "enum":
            return at
        first = i - (s.word(i - 1) == "export" and s.line(i - 1) == s.line(i))
        while s.named(at):
            name, eq = s.word(at), at + 1
            if s.word(eq) in (":", "!"):
                while eq < hi and s.word(eq) not in ("=", ";", ",") and not (s.line(eq) > s.line(eq - 1) and s.word(eq) in ("const", "let", "var", "function", "class")):
                    eq = s.beyond_angles(eq) if s.word(eq) == "<" else s.after(eq)
            if s.word(eq) != "=":
                return max(eq, i + 1)
            end = self._value(eq + 1, hi, name, first, None)
            if end is None:
                end = self._expression_end(eq + 1, hi)
                self.walk(eq + 1, end)
            if s.word(end) != ",":
                return end
            at = first = end + 1
        return i + 1

    def _members(self, at: int, hi: int, name: str | None) -> None:
        s = self.s
        while at < hi:
            if s.word(at) in (";", ","):
                at += 1
                continue
            first, is_async, decorators = at, False, []
            while s.word(at).startswith("@"):
                decorators.append(s.word(at)[1:])
                at += 1
                while s.word(at) in (".", "(") or s.named(at) and s.word(at - 1) == ".":
                    at = s.after(at)
            head = at
            while s.word(at) in _JS_BEFORE and s.word(at + 1) not in ("(", "=", ":", ";", "?", "!", "<", "}", ""):
                is_async |= s.word(at) == "async"
                at += 1
            at += s.word(at) == "*"
            if s.word(at) == "{":  # a static block
                self.walk(at + 1, s.match[at])
                at = s.after(at)
                continue
            t = s.tokens[at]
            label = t.text if t.kind == "word" else _unquoted(t.text) if t.kind == "text" else s.slice(at, s.after(at))
            after = s.after(at)
            after += s.word(after) in ("?", "!")
            after = s.beyond_angles(after)
            if s.word(after) == "(" and t.kind != "mark" or s.word(after) == "(" and t.text == "[":
                body, returns = self._returns(s.after(after), hi)
                end = s.match[body] if s.word(body) == "{" else body - 1
                if name:
                    self.found.function(label, head, min(end, hi - 1), name, at=first, parameters=s.split(after + 1, s.match[after]), returns=returns, is_async=is_async, decorators=decorators)
                self.walk(after, end)
                at = end + 1
                continue
            if s.word(after) == ":":
                after += 1
                while after < hi and s.word(after) not in ("=", ";", ",", "}") and not (s.line(after) > s.line(after - 1, last=True) and s.word(after - 1) not in _JS_GOES_ON and s.word(after) not in ("|", "&")):
                    after = s.beyond_angles(after) if s.word(after) == "<" and s.beyond_angles(after) > after else s.after(after)
            if s.word(after) == "=":
                end = self._value(after + 1, hi, label, head, name)
                if end is None:
                    end = self._expression_end(after + 1, hi)
                    self.walk(after + 1, end)
                after = end
            at = max(after, first + 1)

    def _require(self, i: int, hi: int) -> int:
        s = self.s
        if s.word(i + 1) == "(" and i + 2 < hi and s.tokens[i + 2].kind == "text":
            self.found.module(_unquoted(s.tokens[i + 2].text), i, [])
        return i + 1

    def _import(self, i: int, hi: int) -> int:
        s, at, names, alias = self.s, i + 1, [], None
        if s.word(at) in ("(", "."):
            return at
        at += s.word(at) == "type" and s.word(at + 1) != "from"
        while at < hi and s.tokens[at].kind != "text":
            w = s.word(at)
            if w == "{":
                names += [re.split(r"\s+as\s+", re.sub(r"^type\s+", "", x))[0] for x in s.split(at + 1, s.match[at])]
            elif w == "*":
                names.append("*")
                alias = s.word(at + 2) if s.word(at + 1) == "as" else None
                at += 2
            elif w not in ("from", ",") and s.named(at):
                names.append(w)
            elif w in (";", "=") or w in CLOSE:
                return at
            at = s.after(at)
        if at < hi:
            self.found.module(_unquoted(s.tokens[at].text), i, names, bool(names), alias)
        return at + 1


# -- C and C++ ---------------------------------------------------------------------------------
_C_KINDS = ("class", "struct", "union", "enum")
_C_NOT_NAMES = frozenset("noexcept throw __attribute__ __declspec alignas decltype requires if for while switch return sizeof catch asm __asm__ explicit".split())


class _Native:
    def __init__(self, found: Declarations):
        self.s, self.found = found.source, found

    def walk(self, lo: int, hi: int, class_name: str | None = None) -> None:
        """Statements at the level of a file, a namespace or a type."""
        s, i = self.s, lo
        while i < hi:
            t = s.tokens[i]
            if t.kind == "include":
                if m := re.match(r"#\s*\w+\s*(?:<([^>\n]+)>|\"([^\"\n]+)\")", t.text):
                    self.found.module(m.group(1) or m.group(2), i)
                i += 1
            elif t.text in (";", "}", ")"):
                i += 1
            elif t.text in ("public", "private", "protected", "signals", "slots") and s.word(i + 1) == ":":
                i += 2
            else:
                i = max(self._statement(i, hi, class_name), i + 1)

    def _statement(self, i: int, hi: int, class_name: str | None) -> int:
        s, first = self.s, i
        while s.word(i) == "template" and s.word(i + 1) == "<":
            first = i = max(s.beyond_angles(i + 1), i + 2)
        while s.word(i) == "[" and s.word(i + 1) == "[":
            first = i = s.after(i)
        groups: list[int] = []  # parameter lists
        kind = colon = None
        at = i
        while at < hi:
            t = s.tokens[at]
            w = s.word(at)
            if t.kind == "include" or w == ";" or w == "}":
                return at + (w == ";")
            if w in _C_KINDS and kind is None and not groups and s.word(at - 1) not in ("<", ","):
                kind = at
            elif w == "operator":
                at += 1
                while at < hi and s.word(at) != "(" or s.word(at) == "(" and s.word(at + 1) == ")" and s.word(at - 1) == "operator":
                    at = s.after(at)
                continue
            elif w == "(" and colon is None and s.word(at - 1) not in _C_NOT_NAMES:
                groups.append(at)
            elif w == ":" and (groups or kind is not None) and colon is None:
                colon = at
            elif w == "=" and s.word(at - 1) != "operator":
                while at < hi and s.word(at) != ";":
                    at = s.after(at)
                return at + 1
            elif w == "<" and s.beyond_angles(at) > at:
                at = s.beyond_angles(at)
                continue
            elif w == "{":
                if colon is not None and groups and s.word(s.after(at)) in (",", "{"):  # a member set in braces
                    at = s.after(at)
                    continue
                return self._block(first, at, hi, groups, kind, colon, class_name)
            at = s.after(at)
        return hi

    def _block(self, first: int, at: int, hi: int, groups: list[int], kind: int | None, colon: int | None, class_name: str | None) -> int:
        s, end = self.s, self.s.match[at]
        head = [s.word(j) for j in range(first, at)]
        if "namespace" in head or head[:1] == ["extern"] and not groups:
            self.walk(at + 1, end, class_name)
            return end + 1
        if groups:
            self._function(first, groups[-1], end, class_name)
            return end + 1
        if kind is None:
            self.walk(at + 1, end, class_name)
            return end + 1
        words = [j for j in range(kind + 1, colon or at) if s.named(j) and s.word(j) not in ("class", "struct", "final", "__attribute__", "alignas", "__declspec") and s.word(j + 1) != "("]
        name = s.word(words[-1]) if words else ""
        after = end + 1
        if not name and s.named(after) and "typedef" in head:
            name = s.word(after)
        bases = []
        if colon is not None and s.word(kind) != "enum":
            for base in s.split(colon + 1, at):
                bases.append(re.sub(r"\b(public|private|protected|virtual)\b\s*", "", base).split("<")[0].replace(" ", ""))
        if name:
            self.found.add("class", name, first, end, bases=bases)
        if s.word(kind) != "enum":
            self.walk(at + 1, end, name or class_name)
        while after < hi and s.word(after) not in (";", "}") and s.line(after) == s.line(end):
            after = s.after(after)
        return after

    def _function(self, first: int, group: int, end: int, class_name: str | None) -> None:
        s, at = self.s, group - 1
        if s.word(at) == ">":  # a specialisation's arguments
            while at > first and s.word(at) != "<":
                at -= 1
            at -= 1
        operator = next((j for j in range(group - 1, first - 1, -1) if s.word(j) == "operator"), None)
        if operator is not None and group - operator <= 4:
            name, at = "".join(s.word(j) for j in range(operator, group)), operator
        else:
            if not s.named(at):
                return
            name = s.word(at)
            if s.word(at - 1) == "~":
                name, at = "~" + name, at - 1
        if s.word(at - 1) == "::":
            j = at - 2
            if s.word(j) == ">":
                while j > first and s.word(j) != "<":
                    j -= 1
                j -= 1
            class_name = s.word(j) or class_name
            at = j
        parameters = [p for p in s.split(group + 1, s.match[group]) if p != "void"]
        self.found.function(name, first, end, class_name, parameters=parameters, returns=re.sub(r"\b(static|inline|virtual|extern|constexpr|explicit|friend)\b\s*", "", s.slice(first, at)))


# -- Rust ----------------------------------------------------------------------------------------
class _Rust:
    def __init__(self, found: Declarations):
        self.s, self.found = found.source, found

    def walk(self, lo: int, hi: int, class_name: str | None = None) -> None:
        """Items at any depth; class_name: the type or trait whose body this is."""
        s, i = self.s, lo
        first, decorators = None, []
        while i < hi:
            w = s.word(i)
            if w == "#":
                i += 1 + (s.word(i + 1) == "!")
                if s.word(i) == "[":
                    decorators.append(s.word(i + 1))
                    i = s.after(i)
                continue
            if first is None:
                first = i
            if w == "pub":
                i += 1
                i = s.after(i) if s.word(i) == "(" else i
                continue
            if w in ("const", "async", "unsafe", "extern", "default") and (s.word(i + 1) in ("fn", "unsafe", "extern", "async", "trait", "impl") or i + 1 < hi and s.tokens[i + 1].kind == "text"):
                i += 1 + (i + 1 < hi and s.tokens[i + 1].kind == "text")
                continue
            begin, first, own, decorators = first, None, decorators, []
            if w in ("struct", "enum", "union", "trait") and s.named(i + 1):
                i = self._type(begin, i, hi, own)
            elif w == "impl":
                i = self._impl(i, hi)
            elif w == "fn" and s.named(i + 1):
                i = self._fn(begin, i, hi, class_name, own)
            elif w == "use" and s.word(i + 1) not in ("=", ".", ",", ")", "<"):
                end = i
                while end < hi and s.word(end) != ";":
                    end = s.after(end)
                self._use(i + 1, end, [], i)
                i = end + 1
            elif w == "macro_rules" or w == "!" and s.word(i + 1) in OPEN:
                i += 1
                while i < hi and s.word(i) not in OPEN:
                    i += 1
                i = s.after(i)
            elif w == "mod" and s.named(i + 1) and s.word(i + 2) == "{":
                self.walk(i + 3, s.match[i + 2])
                i = s.match[i + 2] + 1
            elif w == "{" :
                self.walk(i + 1, min(s.match[i], hi))
                i = s.after(i)
            else:
                i += 1

    def _body(self, i: int, hi: int) -> int:
        """The place of the brace or semicolon that ends a head."""
        s = self.s
        while i < hi and s.word(i) not in ("{", ";"):
            i = s.beyond_angles(i) if s.word(i) == "<" and s.beyond_angles(i) > i else s.after(i)
        return i

    def _type(self, begin: int, i: int, hi: int, decorators: list[str]) -> int:
        s, name = self.s, self.s.word(i + 1)
        at = self._body(i + 2, hi)
        end = s.match.get(at, at)
        bases = []
        colon = s.beyond_angles(i + 2)
        if s.word(i) == "trait" and s.word(colon) == ":":
            stop = next((j for j in range(colon, at) if s.word(j) == "where"), at)
            bases = [p.split("<")[0].strip() for p in s.slice(colon + 1, stop).split("+") if not p.strip().startswith(("'", "?"))]
        self.found.add("class", name, begin, min(end, hi - 1), bases=[b for b in bases if b], decorators=decorators)
        if s.word(i) == "trait" and s.word(at) == "{":
            self.walk(at + 1, end, name)
        return end + 1

    def _impl(self, i: int, hi: int) -> int:
        s = self.s
        at = self._body(s.beyond_angles(i + 1), hi)
        start = s.beyond_angles(i + 1)
        over = next((j + 1 for j in range(start, at) if s.word(j) == "for" and s.word(j + 1) != "<"), start)
        j, name = over, ""
        while j < at and s.word(j) not in ("where", "<"):
            if s.named(j) and s.word(j) not in ("dyn", "mut"):
                name = s.word(j)
            j += 1
        if s.word(at) == "{":
            self.walk(at + 1, s.match[at], name or None)
            return s.match[at] + 1
        return at + 1

    def _fn(self, begin: int, i: int, hi: int, class_name: str | None, decorators: list[str]) -> int:
        s = self.s
        open_ = s.beyond_angles(i + 2)
        if s.word(open_) != "(":
            return i + 1
        at = self._body(s.after(open_), hi)
        end = s.match.get(at, at)
        returns, arrow = "", s.after(open_)
        if s.word(arrow) == "->":
            stop = next((j for j in range(arrow, at) if s.word(j) == "where"), at)
            returns = s.slice(arrow + 1, stop)
        words = {s.word(j) for j in range(begin, i)}
        parameters = [p for p in s.split(open_ + 1, s.match[open_]) if not re.fullmatch(r"(?:&\s*)?(?:'\w+\s*)?(?:mut\s+)?self(?:\s*:.*)?", p)]
        self.found.function(s.word(i + 1), begin, min(end, hi - 1), class_name, parameters=parameters, returns=returns, is_async="async" in words, decorators=decorators)
        if s.word(at) == "{":
            self.walk(at + 1, end)
        return end + 1

    def _use(self, i: int, end: int, before: list[str], at: int) -> None:
        """A path, or several in braces after what they share."""
        s, path, i0 = self.s, list(before), i
        while i < end:
            w = s.word(i)
            if w == "{":
                lo = i + 1
                for j in self._commas(lo, s.match[i]):
                    self._use(lo, j, path, at)
                    lo = j + 1
                return
            if w == "as":
                self.found.module("::".join(path), at, path[-1:], len(path) > 1, s.word(i + 1))
                return
            if w not in ("::", ""):
                path.append(w)
            i += 1
        if i > i0:
            if path[-1:] == ["self"] and len(path) > 1:
                path.pop()
            self.found.module("::".join(path), at, path[-1:], len(path) > 1)

    def _commas(self, lo: int, hi: int) -> Iterator[int]:
        while lo < hi:
            if self.s.word(lo) == ",":
                yield lo
            lo = self.s.after(lo)
        yield hi


# -- C# ----------------------------------------------------------------------------------------------
_SHARP_BEFORE = frozenset("public private protected internal static virtual override abstract async sealed readonly partial new unsafe extern volatile required const file ref fixed event implicit explicit".split())
_SHARP_KINDS = ("class", "interface", "struct", "record", "enum")


class _Sharp:
    def __init__(self, found: Declarations):
        self.s, self.found = found.source, found

    def walk(self, lo: int, hi: int, class_name: str | None = None) -> None:
        s, i = self.s, lo
        while i < hi:
            w = s.word(i)
            if w == "using" and class_name is None and s.word(i + 1) != "(":
                i = self._using(i, hi)
            elif w == "namespace":
                at = i
                while at < hi and s.word(at) not in ("{", ";"):
                    at += 1
                if s.word(at) == "{":
                    self.walk(at + 1, s.match[at])
                i = s.after(at)
            elif w in (";", "}", ")", ","):
                i += 1
            else:
                i = max(self._member(i, hi, class_name), i + 1)

    def _using(self, i: int, hi: int) -> int:
        s, end = self.s, i
        while end < hi and s.word(end) != ";":
            end += 1
        at = i + 1
        at += s.word(at) == "static"
        alias = s.word(at) if s.word(at + 1) == "=" else None
        name = re.sub(r"\s+", "", s.slice(at + 2 * (alias is not None), end))
        if name:
            self.found.module(name, i, [name], False, alias)
        return end + 1

    def _member(self, i: int, hi: int, class_name: str | None) -> int:
        s, about, decorators, words = self.s, i, [], set()
        while s.word(i) == "[":
            decorators += [re.split(r"[(\s]", p.split(":")[-1].strip())[0] for p in s.split(i + 1, s.match[i])]
            i = s.after(i)
        first = i
        while s.word(i) in _SHARP_BEFORE and not (s.word(i) in ("ref", "file", "required") and s.word(i + 1) in ("(", "=", ";")):
            words.add(s.word(i))
            i += 1
        if s.word(i) in _SHARP_KINDS and s.named(i + 1) and s.word(i + 2) != "(" or s.word(i) == "record" and s.named(i + 1) and s.word(i - 1) != "new":
            return self._type(first, about, i, hi, decorators)
        at = i
        while at < hi:
            w = s.word(at)
            if w == ";" or w == "}":
                return at + (w == ";")
            if w == "<" and s.beyond_angles(at) > at:
                at = s.beyond_angles(at)
                continue
            if w in ("=", "=>"):
                while at < hi and s.word(at) != ";":
                    at = s.after(at)
                return at + 1
            if w == "{":  # a property, an event, or a block that isn't known
                if at == i:
                    self.walk(at + 1, s.match[at], class_name)
                at = s.after(at)
                return at if s.word(at) != "=" else self._to_semicolon(at, hi)
            if w == "(" and at > i:
                done = self._method(first, about, i, at, hi, class_name, decorators, words)
                if done:
                    return done
            at = s.after(at)
        return hi

    def _to_semicolon(self, at: int, hi: int) -> int:
        while at < hi and self.s.word(at) != ";":
            at = self.s.after(at)
        return at + 1

    def _method(self, first: int, about: int, i: int, group: int, hi: int, class_name: str | None, decorators: list[str], words: set[str]) -> int | None:
        s, at = self.s, group - 1
        if s.word(at) == ">":
            depth = 0
            while at > i:
                depth += (s.word(at) == ">") - (s.word(at) == "<")
                at -= 1
                if not depth:
                    break
        operator = next((j for j in range(group - 1, max(i - 1, group - 4), -1) if s.word(j) == "operator"), None)
        if operator is not None:
            name, at = s.slice(operator, group), operator
        elif not s.named(at):
            return None  # a tuple's type
        else:
            name = s.word(at)
            if s.word(at - 1) == "~":
                name, at = "~" + name, at - 1
        before = at
        while s.word(before - 1) == "." and before - 2 >= i:
            before -= 2
        end = s.after(group)
        while end < hi and s.word(end) not in ("{", ";", "=>", "}"):
            end = s.after(end)
        returns = s.slice(i, before)
        if class_name is None or "delegate" in returns.split() or returns in ("new", "return", "await", "throw") or returns.endswith("="):
            return s.after(end) if s.word(end) == "{" else self._to_semicolon(end, hi)
        if s.word(end) == "=>":
            last = self._to_semicolon(end, hi) - 1
        else:
            last = s.match.get(end, end)
        if returns or name.lstrip("~") == class_name:
            self.found.function(name, first, min(last, hi - 1), class_name, at=about, parameters=s.split(group + 1, s.match[group]), returns=returns, is_async="async" in words, decorators=decorators)
        return last + 1

    def _type(self, first: int, about: int, i: int, hi: int, decorators: list[str]) -> int:
        s = self.s
        kind = s.word(i)
        i += kind == "record" and s.word(i + 1) in ("struct", "class")
        name, at = s.word(i + 1), s.beyond_angles(i + 2)
        at = s.after(at) if s.word(at) == "(" else at
        bases = []
        if s.word(at) == ":":
            stop = at
            while stop < hi and s.word(stop) not in ("{", ";", "where"):
                stop = s.after(stop)
            bases = [re.split(r"[<(]", b)[0].strip() for b in s.split(at + 1, stop)]
        while at < hi and s.word(at) not in ("{", ";"):
            at = s.after(at)
        end = s.match.get(at, at)
        self.found.add("class", name, first, min(end, hi - 1), at=about, bases=bases, decorators=decorators)
        if s.word(at) == "{" and kind != "enum":
            self.walk(at + 1, end, name)
        return end + 1


_PARSERS: dict[str, Callable[[Declarations], object]] = {
    "javascript": lambda f: _Script(f, False), "typescript": lambda f: _Script(f, True), "c": _Native, "cpp": _Native, "rust": _Rust, "csharp": _Sharp,
}
LANGUAGES = tuple(_PARSERS)


def declarations(text: str | None, language: str, with_rows: bool = True) -> Declarations:
    """Definitions, in the order of their first lines, and imports of a text."""
    found = Declarations(Source(text or "", language), with_rows=with_rows)
    if language in _PARSERS:
        _PARSERS[language](found).walk(0, len(found.source.tokens))
    found.rows.sort(key=lambda r: r["start_line"])
    return found
