"""Text functions as column expressions: tokens, query understanding, paths, HTML, formatting.

All of them stay in the JVM. Null text counts as empty unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# Word lists, patterns and weights that results depend on.
STOP_WORDS = tuple(
    "the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will "
    "would could should may might can this that these those i you he she it we they".split()
)
CODE_TERMS = tuple(
    "function method class module variable parameter return import export api endpoint route database query model schema "
    "table authentication auth login user session test unittest spec testing".split()
)
INTENTS = {
    "how": ("how", "implement", "create", "build", "make"),
    "what": ("what", "is", "are", "does", "define", "purpose"),
    "where": ("where", "locate", "find", "which file"),
    "debug": ("error", "bug", "issue", "problem", "fix", "why not", "doesn't work"),
    "explain": ("explain", "describe", "tell me about", "understand"),
    "find": ("find", "search", "locate", "show me", "list"),
    "implement": ("implement", "write", "code", "develop", "algorithm"),
}
SYNONYMS = {
    "function": ("function", "method", "procedure", "routine"),
    "method": ("method", "function", "member function"),
    "class": ("class", "object", "type"),
    "error": ("error", "exception", "bug", "issue"),
    "api": ("api", "endpoint", "route", "service"),
    "database": ("database", "db", "storage", "persistence"),
    "auth": ("authentication", "authorization", "auth", "login"),
    "test": ("test", "unittest", "spec", "testing"),
}
CODE_INDICATORS = ("function", "class", "method", "variable", "code", "implementation", "how to", "algorithm", "logic", "file", "module", "import", "api", "endpoint")
LANGUAGE_CONTEXTS = {
    "python": r"\bin\s+python\b|\bpython\s+(code|implementation|script|function|class|module)\b|\busing\s+python\b|\bpython\s+implement",
    "javascript": r"\bin\s+(javascript|js)\b|\bjavascript\s+(code|implementation|function|class|module)\b|\busing\s+javascript\b|\bjs\s+(code|implementation)\b",
    "typescript": r"\bin\s+typescript\b|\btypescript\s+(code|implementation|function|class|module)\b|\busing\s+typescript\b|\bts\s+(code|implementation)\b",
    "java": r"\bin\s+java\b|\bjava\s+(code|implementation|class|method)\b|\busing\s+java\b",
    "go": r"\bin\s+(go|golang)\b|\bgo\s+(code|implementation|function|package)\b|\busing\s+go\b|\bgolang\s+(code|implementation)\b",
    "cpp": r"\bin\s+c\+\+\b|\bc\+\+\s+(code|implementation|class|function)\b|\busing\s+c\+\+\b",
    "rust": r"\bin\s+rust\b|\brust\s+(code|implementation|function|module)\b|\busing\s+rust\b",
}
EXTENSION_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".java": "java", ".go": "go",
    ".cpp": "cpp", ".cc": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".rs": "rust", ".rb": "ruby", ".php": "php", ".cs": "csharp",
    ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".r": "r", ".m": "objective-c", ".sh": "bash", ".sql": "sql", ".html": "html",
    ".css": "css", ".json": "json", ".xml": "xml", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".md": "markdown",
}
OVERVIEW_LANGUAGES = ("python", "javascript", "typescript", "java", "go", "cpp", "c", "rust", "ruby", "php", "csharp")
COMPLEXITY_WORDS = ("if", "elif", "else", "for", "while", "try", "except", "catch", "case", "switch", "&&", "||", "?")
KEY_FILES = ("main", "index", "app", "init", "config", "setup", "package.json", "requirements.txt", "go.mod", "cargo.toml", "dockerfile", "makefile", "cmakelists.txt")
README_NAMES = (
    "README.md", "readme.md", "README.MD", "Readme.md", "README.rst", "readme.rst", "README.RST", "Readme.rst", "README.txt", "readme.txt",
    "README.TXT", "README.markdown", "readme.markdown", "README.MARKDOWN", "README.mdown", "readme.mdown", "README", "readme",
)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


# -- tokens ---------------------------------------------------------------
def whitespace_tokens(text: Column) -> Column:
    """Lower-cased tokens between white space (ST01)."""
    return F.filter(F.split(F.lower(_text(text)), r"\s+"), lambda x: x != "")


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(_text(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def keywords(text: Column) -> Column:
    """Words of over two characters that aren't stop words, terms of code first (ST02)."""
    kept = F.filter(word_tokens(text), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    return F.concat(F.filter(kept, lambda w: w.isin(*CODE_TERMS)), F.filter(kept, lambda w: ~w.isin(*CODE_TERMS)))


def clean_words(text: Column) -> Column:
    """ASCII words of over one character (ST03)."""
    return F.filter(F.regexp_extract_all(F.lower(_text(text)), F.lit("[a-zA-Z0-9_]+"), F.lit(0)), lambda w: F.length(w) > 1)


def chunk_words(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Overlapping windows of words as array<struct<start_word, end_word, text>>; the last window ends the text."""
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the chunk")
    words = F.filter(F.split(_text(text), r"\s+"), lambda x: x != "")
    n = F.size(words)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int"))
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start_word"), F.least(s + size, n).alias("end_word"), F.array_join(F.slice(words, s + 1, size), " ").alias("text")))


# -- queries --------------------------------------------------------------
def intent(text: Column) -> Column:
    """The intent with the most matching phrases, the earlier of equals; general without any (ST04)."""
    low = F.lower(_text(text))
    scores = {name: reduce(lambda a, b: a + b, [F.instr(low, p).cast("boolean").cast("int") for p in phrases]) for name, phrases in INTENTS.items()}
    most = F.greatest(*scores.values())
    picked = F.lit("general")
    for name, score in reversed(scores.items()):
        picked = F.when((score == most) & (most > 0), F.lit(name)).otherwise(picked)
    return picked


def query_filters(text: Column) -> Column:
    """struct<extension, language, file_path>, null where the text names none (ST05)."""
    low = F.lower(_text(text))
    extension = F.regexp_extract(low, r"\.(py|js|ts|java|go|cpp|c|rs|rb|php|cs)\b", 0)
    language = F.lit(None).cast("string")
    for name, pattern in reversed(LANGUAGE_CONTEXTS.items()):
        language = F.when(low.rlike(pattern), F.lit(name)).otherwise(language)
    path = F.regexp_extract(_text(text), "[\"']([a-zA-Z0-9_/.-]+)[\"']", 1)
    return F.struct(F.nullif(extension, F.lit("")).alias("extension"), language.alias("language"), F.nullif(path, F.lit("")).alias("file_path"))


def expand(text: Column) -> Column:
    """Each word with its synonyms, repeats dropped, joined by spaces (ST06)."""
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), _strings(v))])
    return F.array_join(F.array_distinct(F.flatten(F.transform(whitespace_tokens(text), lambda w: F.coalesce(F.element_at(table, w), F.array(w))))), " ")


def decompose(text: Column, most: int = 3) -> Column:
    """Parts of a text of ten words or more, cut at and, or, commas and semicolons (ST07)."""
    words = F.size(F.filter(F.split(_text(text), r"\s+"), lambda x: x != ""))
    parts = F.transform(F.split(_text(text), " and | or |, |; "), lambda p: F.trim(p))
    parts = F.filter(parts, lambda p: (F.length(p) > 15) & (p != _text(text)))
    return F.when(words >= 10, F.slice(parts, 1, most)).otherwise(F.array().cast("array<string>"))


def code_entity(text: Column) -> Column:
    """struct<type, name> of the first thing of code that the text names; null without one (ST08)."""
    low, found = F.lower(_text(text)), F.lit(None).cast("struct<type:string,name:string>")
    patterns = ((r"function\s+(?:named\s+)?[\"']?(\w+)[\"']?", "function"), (r"class\s+(?:named\s+)?[\"']?(\w+)[\"']?", "class"), (r"method\s+(?:named\s+)?[\"']?(\w+)[\"']?", "function"), (r"[\"'](\w+)[\"']?\s+function", "function"), (r"[\"'](\w+)[\"']?\s+class", "class"))
    for pattern, kind in reversed(patterns):
        name = F.regexp_extract(low, pattern, 1)
        found = F.when(name != "", F.struct(F.lit(kind).alias("type"), name.alias("name"))).otherwise(found)
    return found


def is_code_query(text: Column) -> Column:
    """Whether any phrase of code is in the text."""
    return reduce(lambda a, b: a | b, [F.lower(_text(text)).contains(w) for w in CODE_INDICATORS])


def wants_rewriting(text: Column, intent_column: Column, mode: str = "adaptive") -> Column:
    """Whether a query is worth a rewriter: always, off, or if it is about how, debugging or implementing, or long, or has a rare form (ST09)."""
    if mode in ("always", "off"):
        return F.lit(mode == "always")
    words = F.size(whitespace_tokens(text))
    return intent_column.isin("how", "debug", "implement") | (words > 15) | (~is_code_query(text) & (words > 5))


def with_file_hints(text: Column, files: Column, most: int = 5) -> Column:
    """A query with the first file names appended (ST26)."""
    hints = F.array_join(F.slice(F.coalesce(files, F.array().cast("array<string>")), 1, most), ", ")
    return F.when(hints != "", F.concat(_text(text), F.lit("\nRelevant files: "), hints)).otherwise(_text(text))


def reply_field(text: Column, name: str) -> Column:
    """The value after "name:" in a model's reply, its fences and list marks removed (ST10)."""
    value = F.regexp_extract(_text(text), rf"(?im)^\s*\**{name}\**\s*:\s*(.+)$", 1)
    return F.nullif(F.trim(F.regexp_replace(value, r"^[*`\-\s]+|[*`\s]+$", "")), F.lit(""))


def split_summary(answer: Column) -> tuple[Column, Column]:
    """(answer without its summary, summary): in tags, or after a line that says Summary (ST23)."""
    tagged = F.regexp_extract(_text(answer), r"(?is)<summary>(.*?)</summary>", 1)
    titled = F.regexp_extract(_text(answer), r"(?is)\n\s*(?:#+\s*|\**)summary\**\s*:?\s*\n(.*)$", 1)
    summary = _stripped(F.when(tagged != "", tagged).otherwise(titled))
    rest = F.regexp_replace(_text(answer), r"(?is)<summary>.*?</summary>", "")
    rest = F.when(tagged != "", rest).otherwise(F.regexp_replace(rest, r"(?is)\n\s*(?:#+\s*|\**)summary\**\s*:?\s*\n.*$", ""))
    return _stripped(rest), F.nullif(summary, F.lit(""))


# -- documents of elements --------------------------------------------------
def lexical_document(name, kind, language, path, docstring, signature, summary, code, code_chars: int = 1000) -> Column:
    """What the lexical index reads of an element (ST12)."""
    return F.concat_ws(" ", name, kind, language, path, docstring, signature, summary, F.substring(code, 1, code_chars))


def embedding_document(kind, name, signature, docstring, summary, code, code_chars: int = 10_000) -> Column:
    """What an embedding is made of (ST11)."""
    def line(label, c):
        return F.when(_text(c) != "", F.concat(F.lit(f"{label}: "), c))

    return F.concat_ws("\n", line("Type", kind), line("Name", name), line("Signature", signature), line("Documentation", docstring), line("Summary", summary), line("Code", F.substring(code, 1, code_chars)))


def dedent(docstring: Column) -> Column:
    """A docstring without outer blank lines and common indent (ST13)."""
    lines = F.split(_text(docstring), "\n")
    full = F.filter(lines, lambda x: F.trim(x) != "")
    indent = F.coalesce(F.array_min(F.transform(full, lambda x: F.length(x) - F.length(F.ltrim(x)))), F.lit(0))
    cut = F.array_join(F.transform(lines, lambda x: F.when(F.length(x) > indent, F.substr(x, indent + 1)).otherwise(x)), "\n")
    return F.regexp_replace(cut, r"^\s+|\s+$", "")


def line_range(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last, counted from 1 (ST14)."""
    return F.array_join(F.slice(F.split(_text(text), "\n"), F.greatest(first, F.lit(1)), F.greatest(last - F.greatest(first, F.lit(1)) + 1, F.lit(0))), "\n")


def snippet(text: Column, start: Column, end: Column, context: int = 3) -> Column:
    """struct<code, start_line, end_line>: lines [start, end), counted from 0, with some around (ST14)."""
    lines = F.split(_text(text), "\n")
    a, b = F.greatest(start - context, F.lit(0)), F.least(end + context, F.size(lines))
    return F.struct(F.array_join(F.slice(lines, a + 1, F.greatest(b - a, F.lit(0))), "\n").alias("code"), (a + 1).alias("start_line"), b.alias("end_line"))


def signature(name: Column, parameters: Column, return_type: Column, is_async: Column) -> Column:
    """def name(parameters) -> type (ST17)."""
    head = F.concat(F.when(is_async, F.lit("async def ")).otherwise(F.lit("def ")), name, F.lit("("), F.array_join(parameters, ", "), F.lit(")"))
    return F.concat(head, F.when(_text(return_type) != "", F.concat(F.lit(" -> "), return_type)).otherwise(F.lit("")))


def class_signature(name: Column, bases: Column) -> Column:
    return F.concat(F.lit("class "), name, F.when(F.size(bases) > 0, F.concat(F.lit("("), F.array_join(bases, ", "), F.lit(")"))).otherwise(F.lit("")))


# -- HTML -----------------------------------------------------------------
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&"))


def decode_entities(text: Column) -> Column:
    for entity, plain in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def strip_html(html: Column) -> Column:
    """The text of a fetched page: no scripts, styles or tags, entities decoded (ST15, S24)."""
    out = F.regexp_replace(_text(html), r"(?is)<script[^>]*>.*?</script>", "")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", "")
    return F.trim(decode_entities(F.regexp_replace(out, "(?s)<[^>]+>", "")))


def html_to_markdown(html: Column) -> Column:
    """Links, headings and list items as Markdown, then the rest stripped and blanks normalised (ST16)."""
    out = F.regexp_replace(_text(html), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    out = F.regexp_replace(out, r"(?is)<a[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "[$2]($1)")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", "\n" + "#" * level + " $1\n")
    out = F.regexp_replace(out, r"(?is)<li[^>]*>(.*?)</li>", "\n- $1")
    out = F.regexp_replace(out, r"(?i)</(p|div|section|article)>", "\n\n")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|<hr\s*/?>", "\n")
    return normal_blanks(decode_entities(F.regexp_replace(out, "(?s)<[^>]+>", "")))


def normal_blanks(text: Column) -> Column:
    return _stripped(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


# -- paths and names --------------------------------------------------------
def base_name(path: Column) -> Column:
    return F.substring_index(_text(path), "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_extract(_text(path), "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The last suffix of the file name with its dot; none for names that only start with one."""
    return F.regexp_extract(base_name(path), r"[^.].*?(\.[^.]+)$|[^.](\.[^.]+)$", 1)


def language_of(ext: Column) -> Column:
    """The language of an extension, unknown without one (ST19)."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSION_LANGUAGES.items() for x in kv]), F.lower(_text(ext))), F.lit("unknown"))


def repo_name(url: Column) -> Column:
    """The last part of a URL, without .git (ST18)."""
    return F.substring_index(F.regexp_replace(F.regexp_replace(_text(url), r"\.git$", ""), "/+$", ""), "/", -1)


def module_name(path: Column) -> Column:
    """a/b/c.py -> a.b.c, a/b/__init__.py -> a.b (ST18)."""
    return F.replace(F.regexp_replace(F.regexp_replace(normal_path(path), r"\.py$", ""), r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def normal_path(path: Column) -> Column:
    """Forward slashes, no empty or dot parts, parents resolved (ST18, F16)."""
    parts = F.filter(F.split(F.replace(_text(path), F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.when(F.substring(_text(path), 1, 1) == "/", F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))


def is_safe_path(path: Column, root: str) -> Column:
    """Whether a path, taken below root, stays there (F16)."""
    whole = normal_path(F.when(F.substring(_text(path), 1, 1) == "/", path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), _text(path))))
    return (whole == root.rstrip("/")) | whole.startswith(root.rstrip("/") + "/")


def without_repo_prefix(path: Column, repo: Column) -> Column:
    """A path without its leading repository directory (ST18)."""
    return F.when(F.startswith(path, F.concat(repo, F.lit("/"))), F.substr(path, F.length(repo) + 2)).otherwise(path)


def repo_in_path(path: Column, repos: Column) -> Column:
    """The first of the repositories that is a segment of the path, exactly or but for case."""
    parts = F.split(_text(path), "/")
    exact = F.filter(repos, lambda r: F.array_contains(parts, r))
    loose = F.filter(repos, lambda r: F.array_contains(F.transform(parts, lambda p: F.lower(p)), F.lower(r)))
    return F.coalesce(F.get(exact, 0), F.get(loose, 0))


def is_key_file(path: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(base_name(path)).contains(k) for k in KEY_FILES])


def source_kind(source: Column, is_existing_path: Column) -> Column:
    """path, zip, git or unknown; a path that exists beats a URL."""
    remote = source.rlike(r"^(https?|git|ssh)://") | source.rlike(r"^[\w.-]+@[\w.-]+:.+") | source.endswith(".git")
    return F.when(is_existing_path & source.endswith(".zip"), "zip").when(is_existing_path, "path").when(remote, "git").otherwise("unknown")


def snake_to_camel(key: Column) -> Column:
    """ab_cd -> abCd (ST27)."""
    parts = F.split(key, "_")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))), "")


def camel_to_snake(key: Column) -> Column:
    return F.lower(F.regexp_replace(key, "([a-z0-9])([A-Z])", "$1_$2"))


# -- display --------------------------------------------------------------
def complexity(code: Column) -> Column:
    """1 and every occurrence of a control word (ST20)."""
    counts = [((F.length(_text(code)) - F.length(F.replace(_text(code), F.lit(w), F.lit("")))) / len(w)).cast("int") for w in COMPLEXITY_WORDS]
    return F.lit(1) + reduce(lambda a, b: a + b, counts)


def title(text: Column, most: int = 80) -> Column:
    """At most so many characters, with an ellipsis in them (ST24)."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def token_estimate(text: Column) -> Column:
    """Tokens between white space, where no vocabulary is at hand; else see bpe_tokens (ST21)."""
    return F.size(whitespace_tokens(text))


def truncate_tokens(text: Column, most: int) -> Column:
    words = F.split(_text(text), r"\s+")
    return F.when(F.size(words) <= most, text).otherwise(F.array_join(F.slice(words, 1, most), " "))


#: What a worker gives at once.
SLICE_ROWS, SLICE_BYTES = 1_024, 8 << 20


def bpe_tokens(rows: DataFrame, ranks_path: str, pattern: str, most: int | None = None, text_col: str = "text") -> DataFrame:
    """rows with n_tokens, the tokens of a text by a byte-pair vocabulary, and cut, the text of the first `most` of them
    (ST21). ranks_path: a file of lines "base64 of a token, its rank", which every worker can read. What looks like a special
    token in a text is text. A worker holds the tokens of one text and gives rows in slices bounded by rows and by bytes."""
    fields = StructType([*rows.schema.fields, StructField("n_tokens", IntegerType()), StructField("cut", StringType())])
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = bpe_library(ranks_path, pattern)
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            lo = 0
            while lo < b.num_rows:
                hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo : lo + SLICE_ROWS]), SLICE_BYTES, side="right")))
                counts, cut = [], []
                for text in b.column(at).slice(lo, hi - lo):
                    t = text.as_py()
                    tokens = library.encode_ordinary(t or "")
                    counts.append(len(tokens))
                    cut.append(t if most is None or len(tokens) <= most else library.decode(tokens[:most]))
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, pa.array(counts, pa.int32()), pa.array(cut, pa.string())], names=fields.fieldNames())
                lo = hi

    return rows.mapInArrow(run, fields)


@cache
def bpe_library(ranks_path: str, pattern: str):
    """A worker's encoder, made once."""
    import base64

    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("of the file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def code_block(code: Column, language: Column, path: Column, line: Column) -> Column:
    """A fenced block with its place (ST22)."""
    return F.concat(F.lit("```"), _text(language), F.when(_text(path) != "", F.concat(F.lit(" - "), path)).otherwise(F.lit("")), F.when(line.isNotNull(), F.format_string(" (Line %d)", line)).otherwise(F.lit("")), F.lit("\n"), _text(code), F.lit("\n```"))


def first_match(name: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first keyword that a name contains, but for case: provider by model name."""
    found = F.lit(default).cast("string")
    for keyword, value in reversed(rules):
        found = F.when(F.lower(name).contains(keyword.lower()), F.lit(value)).otherwise(found)
    return found


def normal_name(name: Column) -> Column:
    """For comparing names: trimmed, lower-cased, without quotes (ST25)."""
    return F.lower(F.trim(F.regexp_replace(_text(name), "[\"'`]", "")))


def name_tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal_name(name), r"[\s_/.-]+"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty (ST25, U06)."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
