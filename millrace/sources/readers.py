"""Sources: directories of files, archives, indexer output, stored tables, chat sessions, configuration."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import RELATIONS

# What a scan of a repository reads by default.
EXTENSIONS = (".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".cpp", ".c", ".h", ".rs", ".rb", ".php", ".cs", ".swift", ".kt", ".pyx", ".toml", ".md", ".txt", ".yaml", ".rst", ".json", ".html", ".css")
IGNORED = ("*.pyc", "__pycache__", "node_modules", ".git", "*.min.js", "*.bundle.js", "dist/*", "build/*", "*.lock")
MOST_MEGABYTES = 5


# -- paths ----------------------------------------------------------------------------
def ignore_regex(patterns: Sequence[str]) -> str:
    """One regular expression for patterns of .gitignore's kind (S03): ** crosses directories, a pattern without
    an inner slash fits at any depth, a trailing slash means a directory, and what lies below a match is matched."""
    parts = []
    for raw in patterns:
        p = raw.strip()
        if not p or p.startswith(("#", "!")):
            continue
        directory, anchored = p.endswith("/"), "/" in p.rstrip("/")
        p, out, i = p.strip("/"), "", 0
        while i < len(p):
            if p.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif p.startswith("**", i):
                out, i = out + ".*", i + 2
            elif p[i] == "[" and "]" in p[i + 1 :]:
                end = p.index("]", i + 1)
                out, i = out + p[i : end + 1].replace("[!", "[^"), end + 1
            else:
                out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(p[i], re.escape(p[i])), i + 1
        parts.append(("^" if anchored else "(?:^|/)") + out + ("/" if directory else "(?:/|$)"))
    return "|".join(parts) or r"(?!)"



def spread(df: DataFrame) -> DataFrame:
    """A table whose files give fewer partitions than there are cores, dealt to all of them; larger ones as they are.
    Rows are dealt evenly, so a file of one row group keeps no more than its scan in one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def gitignore_patterns(spark: SparkSession, path: str) -> list[str]:
    """The lines of a .gitignore but for blanks and comments (S02); a file of a few lines by nature."""
    jvm = spark.sparkContext._jvm  # Spark's own readers pass over names that start with a dot
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return [p for line in text.split("\n") if (p := line.strip()) and not p.startswith("#")]


def relative(path: Column, root: str) -> Column:
    """A path below root, without scheme and root."""
    plain = re.sub(r"^[a-z][a-z0-9+.-]*:(//[^/]*)?(?=/)", "", root.rstrip("/"))
    own = F.regexp_replace(path, r"^[a-z][a-z0-9+.-]*:(//[^/]*)?(?=/)", "")
    return F.regexp_replace(own, "^" + re.escape(plain) + "/", "")


def scan(spark: SparkSession, root: str, extensions: Sequence[str] = EXTENSIONS, ignored: Sequence[str] = IGNORED, megabytes: float = MOST_MEGABYTES, content: bool = False) -> DataFrame:
    """path, relative_path, size, extension, mtime (and content) of a directory's files.

    Without content the files aren't opened. Directories and files are both tested by relative path (Q17).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.select("path", relative(F.col("path"), root).alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content"] if content else []))
    if hidden := _underscored(spark, root):
        more = spark.createDataFrame(hidden, "path string, size bigint, mtime timestamp").withColumn("relative_path", relative(F.col("path"), root))
        rows = rows.unionByName(_with_content(more) if content else more)
    rows = rows.withColumn("extension", T.extension(F.col("relative_path")))
    kept = rows.where(F.lower("extension").isin(*extensions) & (F.col("size") <= int(megabytes * 1048576)) & ~F.col("relative_path").rlike(ignore_regex(ignored)))
    return kept.withColumn("content", decoded(F.col("content"))) if content else kept


def _underscored(spark: SparkSession, root: str) -> list[tuple]:
    """path, size, mtime of files whose name starts with an underscore, such as __init__.py: Spark's readers take
    them for hidden ones. Names only; the driver lists a source's files in any case."""
    from datetime import UTC, datetime

    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files, found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        name = f.getPath().getName()
        if name.startswith("_") and "=" not in name:
            found.append((f.getPath().toString(), f.getLen(), datetime.fromtimestamp(f.getModificationTime() / 1000, UTC)))
    return found


def _with_content(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            data = []
            for path in batch.column("path").to_pylist():
                system, place = FileSystem.from_uri(path if "://" in path else re.sub("^file:", "file://", path))
                with system.open_input_stream(place) as stream:
                    data.append(stream.read())
            yield batch.append_column("content", pa.array(data, pa.binary()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(run, f"{schema}, content binary")


def decoded(content: Column) -> Column:
    """Text as UTF-8 where it is valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def is_text(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def cut(content: Column, most: int = 10_000) -> Column:
    """struct<content, truncated> of at most so many characters."""
    return F.struct(F.substring(content, 1, most).alias("content"), (F.length(content) > most).alias("truncated"))


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """relative_path, content of an archive's files, a single root directory taken away (S07). Unsafe names and
    what isn't text are left out. A task reads one archive at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = [n for n in z.namelist() if not n.endswith("/") and not n.startswith("/") and ".." not in n.split("/")]
                    roots = {n.split("/", 1)[0] for n in names}
                    strip = len(roots) == 1 and all("/" in n for n in names)
                    for n in names:
                        raw = z.read(n)
                        try:
                            text = raw.decode()
                        except UnicodeDecodeError:
                            text = raw.decode("latin-1")
                        yield pa.RecordBatch.from_pydict({"relative_path": [n.split("/", 1)[1] if strip else n], "content": [text]})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "relative_path string, content string")


# -- other programs -----------------------------------------------------------------------
def clone(url: str, target: str, ref: str | None = None, seconds: int = 600) -> str:
    """A shallow clone of a repository into a folder that all executors reach (S05); scan() reads it."""
    import subprocess

    subprocess.run(["git", "clone", "--depth", "1", *(["--branch", ref] if ref else []), "--", url, target], check=True, capture_output=True, timeout=seconds)
    return target


def run_indexer(command: Sequence[str], root: str, out: str, seconds: int = 3600) -> str:
    """Runs an external indexer that writes JSON (S11); read_index() reads it. {root} and {out} stand for the paths."""
    import subprocess

    subprocess.run([c.format(root=root, out=out) for c in command], check=True, capture_output=True, timeout=seconds)
    return out


# -- stored tables ------------------------------------------------------------------------
def read_relation(spark: SparkSession, *paths: str, relation: str | None = None) -> DataFrame:
    """A stored table, with its schema given rather than inferred where it is one of the relations.
    A filter on its partition column reads only those folders."""
    reader = spark.read.schema(RELATIONS[relation]) if relation else spark.read
    return reader.parquet(*paths)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An indexer's JSON output, typed (S10); malformed files give nulls, not errors."""
    return spark.read.schema(RELATIONS["index"]).option("multiLine", True).json(path)


def read_chat_sessions(spark: SparkSession, path: str) -> DataFrame:
    """session file, ord, role, content, timestamp of JSONL sessions, their metadata lines left out (S23). The file names the
    session, so its key is never rebuilt from a name (Q21)."""
    rows = spark.read.schema("_type string, role string, content string, timestamp string").json(path)
    return rows.where("_type is null or _type <> 'metadata'").select(F.input_file_name().alias("session_id"), F.monotonically_increasing_id().alias("ord"), "role", "content", F.to_timestamp("timestamp").alias("timestamp"))


def read_config(path: str, text: str | None = None) -> dict:
    """Settings from a JSON file, or a flat YAML one of "section:", "key: value" and "- item" lines (S21); relative
    paths under keys that end in _path or _dir become absolute."""
    import os

    if text is None:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    try:
        found = json.loads(text)
    except ValueError:
        found = _plain_yaml(text)

    def absolute(value, key=""):
        if isinstance(value, dict):
            return {k: absolute(v, k) for k, v in value.items()}
        if isinstance(value, str) and key.endswith(("_path", "_dir", "_directory")) and value and not re.match(r"^(/|[a-z0-9+.-]+://)", value):
            return os.path.normpath(os.path.join(os.path.dirname(os.path.abspath(path)), value))
        return value

    return absolute(found)


def _plain_yaml(text: str) -> dict:
    root: dict = {}
    stack: list[tuple[int, dict | list]] = [(-1, root)]
    pending: tuple[dict, str, int] | None = None
    for line in text.split("\n"):
        body = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not body.strip():
            continue
        indent, item = len(body) - len(body.lstrip()), body.strip()
        if pending and indent > pending[2]:
            holder: dict | list = [] if item.startswith("- ") else {}
            pending[0][pending[1]] = holder
            stack.append((pending[2], holder))
        pending = None
        while len(stack) > 1 and indent <= stack[-1][0]:
            stack.pop()
        at = stack[-1][1]
        if item.startswith("- ") and isinstance(at, list):
            at.append(_scalar(item[2:]))
        elif isinstance(at, dict) and ":" in item:
            key, _, value = item.partition(":")
            at[key.strip()] = _scalar(value) if value.strip() else None
            if not value.strip():
                pending = (at, key.strip(), indent)
    return root


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1]:
        return text[1:-1]
    try:
        return json.loads(text)
    except ValueError:
        return text


def read_skills(spark: SparkSession, path: str) -> DataFrame:
    """name, description, always, body of skill files with front matter."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    head = F.regexp_extract("value", r"(?s)^---\n(.*?)\n---\n?", 1)
    field = lambda k: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{k}:\s*(.+)$", 1)), F.lit(""))
    return files.select(F.coalesce(field("name"), T.base_name(F.col("path"))).alias("name"), field("description").alias("description"), F.coalesce(field("always") == "true", F.lit(False)).alias("always"), F.regexp_replace("value", r"(?s)^---\n.*?\n---\n?", "").alias("body"))
