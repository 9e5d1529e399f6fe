"""Counts and summaries of repositories, files, symbols and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def repositories(rows: DataFrame) -> DataFrame:
    """Distinct names, sorted."""
    return rows.where("repo_name is not null").select("repo_name").distinct().orderBy("repo_name")


def count_by_repository(rows: DataFrame) -> DataFrame:
    """repo_name (unknown for null), elements."""
    return rows.groupBy(F.coalesce("repo_name", F.lit("unknown")).alias("repo_name")).agg(F.count(F.lit(1)).alias("elements"))


def total(rows: DataFrame) -> DataFrame:
    """How many rows there are."""
    return rows.agg(F.count(F.lit(1)).alias("elements"))


def repository_list(rows: DataFrame, info: DataFrame) -> DataFrame:
    """Counts with what is known of each repository (A04). info: repo_name, url, ..."""
    return count_by_repository(rows).join(info, "repo_name", "left").orderBy("repo_name")


def repository_stats(rows: DataFrame) -> DataFrame:
    """files, classes, functions, average lines and greatest path depth of each repository."""
    lines = F.when(F.col("end_line") > F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    return rows.groupBy("repo_name").agg(
        F.countDistinct("relative_path").alias("files"), F.count_if(F.col("type") == "class").alias("classes"), F.count_if(F.col("type") == "function").alias("functions"),
        F.coalesce(F.avg(lines), F.lit(0.0)).alias("avg_lines"), F.max(F.size(F.split("relative_path", r"[/\\]")) - 1).alias("max_depth"),
    )


def scan_info(files: DataFrame) -> DataFrame:
    """files, megabytes."""
    return files.agg(F.count(F.lit(1)).alias("files"), (F.coalesce(F.sum("size"), F.lit(0)) / 1048576).alias("megabytes"))


def catalogue(rows: DataFrame) -> DataFrame:
    """elements and files of each repository, exactly."""
    return rows.groupBy("repo_name").agg(F.count(F.lit(1)).alias("elements"), F.countDistinct("relative_path").alias("files"), F.min("repo_url").alias("url"))


def catalogue_estimate(rows: DataFrame, sample: int = 100) -> DataFrame:
    """elements, and files estimated from the share of distinct paths in the first rows by id (S16): a sampling
    operator, whose limit is its feature."""
    first = rows.orderBy("id").limit(sample).agg(F.countDistinct("relative_path").alias("d"), F.count(F.lit(1)).alias("n"))
    return rows.agg(F.count(F.lit(1)).alias("elements")).crossJoin(first).select("elements", F.when(F.col("n") > 0, F.round(F.col("elements") * F.col("d") / F.col("n"))).otherwise(0).cast("long").alias("files"))


# -- structure ------------------------------------------------------------------------
def extension_counts(files: DataFrame) -> DataFrame:
    """extension, language, files (A06). files: path."""
    ext = T.extension(F.col("path"))
    return files.groupBy(ext.alias("extension")).agg(F.count(F.lit(1)).alias("files")).withColumn("language", T.language_of(F.col("extension")))


def directories(files: DataFrame) -> DataFrame:
    """directory, files: every ancestor, with the names that lie directly in it."""
    parts = F.split("path", "/")
    rows = files.select(parts.alias("p")).where(F.size("p") > 1).select("p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("depth"))
    direct = F.when(F.col("depth") == F.size("p") - 1, F.element_at("p", -1))
    return rows.groupBy(F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/").alias("directory")).agg(F.array_sort(F.collect_set(direct)).alias("files"))


def key_files(files: DataFrame) -> DataFrame:
    return files.where(T.is_key_file(F.col("path"))).select("path")


def structure_overview(files: DataFrame) -> DataFrame:
    """repo_name, primary_language, project_type, summary of repositories without a README (A07). files: repo_name, path."""
    ext = files.withColumn("language", T.language_of(T.extension(F.col("path"))))
    known = ext.where(F.col("language").isin(*T.OVERVIEW_LANGUAGES))
    per = known.groupBy("repo_name", "language").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))
    main = per.groupBy("repo_name").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("first"), F.col("language"))).alias("m"), F.array_sort(F.collect_set("language")).alias("languages"))
    base = files.groupBy("repo_name").agg(F.count(F.lit(1)).alias("total_files"), F.array_sort(F.collect_list(F.when(T.is_key_file(F.col("path")), F.col("path")))).alias("key_files"))
    x = base.join(main, "repo_name", "left").withColumn("primary_language", F.coalesce("m.language", F.lit("unknown"))).withColumn("k", F.lower(F.array_join("key_files", " ")))
    has = lambda w: F.contains("k", F.lit(w))
    langs = F.coalesce("languages", F.array().cast("array<string>"))
    kind = (
        F.when(has("package.json"), F.when(has("react"), "React web application").when(has("vue"), "Vue.js web application").otherwise("Node.js application"))
        .when(has("requirements.txt") | has("setup.py"), F.when(has("django"), "Django web application").when(has("flask"), "Flask web application").otherwise("Python application"))
        .when(has("android") | F.array_contains(langs, "java"), "Android application").when(has("ios") | has("swift"), "iOS application").when(has("dockerfile"), "containerized application").otherwise("software project")
    )
    summary = F.concat(
        F.format_string("%s is a %s %s with %d files. ", "repo_name", "primary_language", kind, "total_files"),
        F.when(F.size(langs) > 1, F.format_string("It uses multiple languages: %s. ", F.array_join(langs, ", "))).otherwise(""),
        F.when(F.size("key_files") > 0, F.format_string("Key entry points include: %s.", F.array_join(F.slice("key_files", 1, 5), ", "))).otherwise(""),
    )
    return x.select("repo_name", "primary_language", kind.alias("project_type"), "total_files", F.trim(summary).alias("summary"))


def structure_text(files: DataFrame) -> DataFrame:
    """The directories of each repository as one indented text (A08). files: repo_name, path."""
    d = files.select("repo_name", T.directory(F.col("path")).alias("d")).where("d <> ''").groupBy("repo_name", "d").agg(F.count(F.lit(1)).alias("n"))
    line = F.concat(F.repeat(F.lit("  "), F.size(F.split("d", "/")) - 1), F.element_at(F.split("d", "/"), -1), F.format_string("/ (%d files)", "n"))
    return d.groupBy("repo_name").agg(F.array_sort(F.collect_list(F.struct("d", line.alias("line")))).alias("l")).select("repo_name", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("structure_text"))


def readme(files: DataFrame) -> DataFrame:
    """repo_name, path, content of the first README by the order of names (S17). files: repo_name, path, content."""
    rank = F.array_position(F.array(*[F.lit(n) for n in T.README_NAMES]), F.col("path"))
    return files.where(F.col("path").isin(*T.README_NAMES)).groupBy("repo_name").agg(F.min_by(F.struct("path", "content"), rank).alias("r")).select("repo_name", "r.path", "r.content")


def file_summary(rows: DataFrame, path: str) -> DataFrame:
    """type, names, lines of a file's elements."""
    own = rows.where((F.col("relative_path") == path) | F.endswith("relative_path", F.lit(f"/{path}")))
    name = F.when(F.col("class_name").isNotNull(), F.concat_ws(".", "class_name", "name")).otherwise(F.col("name"))
    return own.groupBy("relative_path", "type").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(name)).alias("names"), F.max("end_line").alias("last_line"))


def repository_report(files: DataFrame) -> DataFrame:
    """repo_name, files, languages map, summary, structure_text in one row."""
    per = files.withColumn("language", T.language_of(T.extension(F.col("path")))).groupBy("repo_name", "language").agg(F.count(F.lit(1)).alias("n"))
    langs = per.groupBy("repo_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"), F.sum("n").alias("files"))
    return langs.join(structure_overview(files).select("repo_name", "summary"), "repo_name").join(structure_text(files), "repo_name", "left")


def readiness(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """source, repo_name, action for each wanted source: use, update or clone (Z25). wanted: source, exists_locally;
    known: repo_name, is_stale."""
    x = wanted.withColumn("repo_name", T.repo_name(F.col("source"))).withColumn("kind", T.source_kind(F.col("source"), F.col("exists_locally")))
    x = x.join(known, "repo_name", "left")
    action = F.when(F.col("is_stale"), "update").when(F.col("is_stale").isNotNull(), "use").when(F.col("kind") == "git", "clone").when(F.col("kind") == "unknown", "reject").otherwise("index")
    return x.select("source", "repo_name", "kind", action.alias("action"))


# -- texts for answers -----------------------------------------------------------------------
def context(rows: DataFrame, most: int = 20) -> DataFrame:
    """The best rows as one text for an answer (ST22)."""
    block = T.code_block(F.col("code"), F.col("language"), F.col("relative_path"), F.col("start_line"))
    part = F.concat(F.format_string("## %s %s (score %.3f)\n", "type", "name", "total_score"), block)
    best = rows.orderBy(F.desc("total_score"), "id").limit(most).select(F.struct((-F.col("total_score")).alias("o"), "id", part.alias("part")).alias("x"))
    return best.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), "\n\n").alias("context"))


def prompt(question: str, context_row: DataFrame, turns: DataFrame, most_tokens: int = 8000) -> DataFrame:
    """History, context and question in one text, the context cut to its budget."""
    said = turns.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_number", "query", "summary"))), lambda t: F.concat(F.lit("Q: "), t["query"], F.lit("\nA: "), F.coalesce(t["summary"], F.lit("")))), "\n").alias("history"))
    cut = T.truncate_tokens(F.col("context"), most_tokens)
    return context_row.crossJoin(said).select(F.concat_ws("\n\n", F.when(F.col("history") != "", F.concat(F.lit("Conversation:\n"), "history")), F.concat(F.lit("Context:\n"), cut), F.lit(f"Question: {question}")).alias("prompt"))
