"""Registered queries that write tables to a store of their own and read them back: round trips against SQL."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .operators import graph as G
from .operators import ranked
from .operators import retrieval as Q
from .operators import small_world
from .operators import versions as W
from .queries import _BM25, _ELEMENTS, _ROUTED, ASKED, _routed, documents, elements, registered, table, vectors
from .sources import readers
from .sources.sinks import Store, mirror_json

def _none() -> Column:
    return F.lit(None).cast("string")


def _store(spark) -> Store:
    return Store(spark, G.work_folder(spark))


@registered("select doc_id, 'é' || doc_id as text, doc_id % 2 = 0 as is_text from documents")
def decoded_files(spark, sf_dir):
    """UTF-8 and Latin-1 contents."""
    text = F.concat(F.lit("é"), F.col("doc_id").cast("string"))
    rows = documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1")).alias("c"))
    return rows.select("doc_id", readers.decoded(F.col("c")).alias("text"), readers.is_text(F.col("c")).alias("is_text"))


@registered("select doc_id, md5(left(text, 500)) as digest, length(text) > 500 as truncated from documents")
def cut_files(spark, sf_dir):
    """The first characters of a file are what the reader shows."""
    return documents(spark, sf_dir).select("doc_id", readers.cut(F.col("text"), 500).alias("c")).select("doc_id", F.md5(F.col("c.content").cast("binary")).alias("digest"), "c.truncated")


@registered(f"with {_BM25} select id, round(score, 6) as score from scored where score > 0")
def stored_postings(spark, sf_dir):
    """An index with its statistics, written once; the question reads its own terms."""
    store, d = _store(spark), documents(spark, sf_dir)
    store.write("postings", Q.postings(d, "doc_id"))
    store.write("size", Q.corpus_size(d))
    idf, _ = Q.corpus_statistics(store.read("postings"), store.read("size"))
    store.write("idf", idf)
    return Q.bm25_from_postings(store.read("postings"), store.read("size"), ASKED, store.read("idf")).select("id", F.round("score", 6).alias("score"))


@registered(f"with {_ROUTED} select src_id as src, dst_id as dst from routed where graph = 'inheritance' or graph = 'containment'")
def stored_graph(spark, sf_dir):
    """A graph in folders by kind: a filter reads only its own."""
    store = _store(spark)
    store.write("graph", _routed(spark, sf_dir), ("graph",))
    return readers.read_relation(spark, *store.paths("graph")).where("graph in ('inheritance', 'containment')").select("src", "dst")


@registered("select 's' || user_id as snapshot_id, min(ts) as created_at, 'b' || max(event_id) as branch from events group by user_id")
def stored_snapshots(spark, sf_dir):
    """Two writes of the same snapshots: the first time of creation stays, the rest is replaced."""
    store, e = _store(spark), table(spark, sf_dir, "events")
    per = e.groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    snapshot = lambda at, n: per.select(F.concat(F.lit("s"), "user_id").alias("snapshot_id"), F.lit("r").alias("repo_name"), F.concat(F.lit("b"), n).alias("branch"), _none().alias("commit_id"), _none().alias("tree_id"), F.concat(F.lit("k"), "user_id").alias("artifact_key"), F.col(at).alias("created_at"))
    refs = per.select(F.concat(F.lit("f"), "user_id").alias("ref_id"), F.lit("r").alias("repo_name"), F.lit("b").alias("branch"), F.lit("c").alias("commit_id"), _none().alias("tree_id"), F.concat(F.lit("s"), "user_id").alias("snapshot_id"), F.col("first").alias("created_at"))
    store.save_snapshot(snapshot("first", "a"), refs)
    store.save_snapshot(snapshot("last", "b"), refs)
    return store.read("snapshots").select("snapshot_id", "created_at", "branch")


@registered("select source as repo_name, case when source = 'src1' then 'new' else 'old' end as content from documents where source <> 'src2' group by source")
def stored_overviews(spark, sf_dir):
    store = _store(spark)
    old = documents(spark, sf_dir).select(F.col("source").alias("repo_name")).distinct().withColumn("content", F.lit("old"))
    store.write("overviews", old)
    store.upsert("overviews", old.where("repo_name = 'src1'").withColumn("content", F.lit("new")), ["repo_name"])
    store.delete("overviews", old.where("repo_name = 'src2'"), ["repo_name"])
    return store.read("overviews").select("repo_name", "content")


@registered(f"with {_ELEMENTS} select id, relative_path from elements where repo_name <> 'src3' and repo_name <> 'src4'")
def removed_repositories(spark, sf_dir):
    store = _store(spark)
    store.write("elements", elements(spark, sf_dir).select("id", "relative_path", "repo_name"))
    for repo in ("src3", "src4"):
        store.remove_repository(repo, ("elements",))
    return store.read("elements").select("id", "relative_path")


@registered("select conv_id::varchar as session_id, turn::int as turn_number, role as answer from conversations where conv_id % 4 > 0")
def stored_turns(spark, sf_dir):
    """Turns appended in two parts; a session's are deleted."""
    store, c = _store(spark), table(spark, sf_dir, "conversations")
    turns = c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("turn_number"), F.col("text").alias("query"), F.col("role").alias("answer"))
    store.append("turns", turns.where("turn_number % 2 = 0"))
    store.append("turns", turns.where("turn_number % 2 = 1"))
    store.delete("turns", c.where("conv_id % 4 = 0").select(F.col("conv_id").cast("string").alias("session_id")).distinct(), ["session_id"])
    return store.read("turns").select("session_id", "turn_number", "answer")


@registered("select vec_id as id, round(list_sum(embedding::double[]), 5) as total from embeddings")
def stored_vectors(spark, sf_dir):
    """Two indexes read as one."""
    store, e = _store(spark), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    for i in (0, 1):
        store.write(f"vectors/{i}", e.where(F.col("id") % 2 == i))
    both = store.read("vectors/0").union(store.read("vectors/1"))
    return both.select("id", F.round(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@registered("select role, md5(text) as digest, count(*) as n from conversations group by all")
def chat_sessions(spark, sf_dir):
    """Sessions as JSON lines with a line about each, which the reader leaves out."""
    c = table(spark, sf_dir, "conversations")
    lines = c.select(_none().alias("_type"), "role", F.col("text").alias("content"), F.lit("2024-01-01 00:00:00").alias("timestamp"))
    about = c.select("conv_id").distinct().select(F.lit("metadata").alias("_type"), _none().alias("role"), F.lit("x").alias("content"), _none().alias("timestamp"))
    path = f"{G.work_folder(spark)}/sessions"
    mirror_json(lines.union(about), path)
    return readers.read_chat_sessions(spark, path).groupBy("role", F.md5(F.col("content").cast("binary")).alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@registered("select source || '/' || doc_id as path, doc_id as mtime, length(text) as size, 'e' || doc_id as ids from documents")
def file_manifests(spark, sf_dir):
    store, d = _store(spark), documents(spark, sf_dir)
    path = F.concat_ws("/", "source", "doc_id")
    files = d.select(path.alias("path"), F.col("doc_id").alias("mtime"), F.length("text").cast("long").alias("size"))
    store.write("file_manifest", W.file_manifest(files, d.select(path.alias("relative_path"), F.concat(F.lit("e"), "doc_id").alias("id"))))
    return store.read("file_manifest").select("path", "mtime", "size", F.array_join("element_ids", ",").alias("ids"))


@registered("select event_id as manifest_id, lag(event_id) over (partition by user_id, event_type order by ts, event_id) as previous from events")
def published_manifests(spark, sf_dir):
    """Two publications into one log; each manifest points to the one before."""
    store, e = _store(spark), table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").cast("string").alias("manifest_id"), F.col("user_id").cast("string").alias("repo_name"), F.col("event_type").alias("ref_name"), F.lit("s").alias("snapshot_id"), _none().alias("index_run_id"), F.col("ts").alias("published_at"), _none().alias("previous_manifest_id"), F.lit("published").alias("status"))
    store.publish(rows.where("cast(manifest_id as bigint) % 2 = 0"))
    store.publish(rows.where("cast(manifest_id as bigint) % 2 = 1"))
    found = W.with_previous(store.read("manifests").drop("previous_manifest_id").withColumn("manifest_id", F.col("manifest_id").cast("long")))
    return found.select("manifest_id", F.col("previous_manifest_id").alias("previous"))


@registered("select count(*) as asked, 10 * count(*) as wanted, true as recall_of_nine_tenths, 0 as wrong_scores from embeddings where vec_id % 100 = 0")
def small_world_recall(spark, sf_dir):
    """A stored index of two parts is asked with every hundredth vector; its answers against those of the exact search."""
    store, v = _store(spark), vectors(spark, sf_dir)
    store.write("index", small_world.build_index(v.where("id % 2 = 0")))
    shards = store.read("index").agg(F.max("shard")).first()[0] + 1
    store.append("index", small_world.build_index(v.where("id % 2 = 1"), first_shard=shards))
    asked = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    found = small_world.search_index(store.read("index"), asked, 10).select("query_id", "id", F.col("score").alias("found"))
    exact = Q.vector_batch_top(v, asked, 10).select("query_id", "id", "score")
    both = exact.join(found, ["query_id", "id"], "left")
    wrong = F.count_if(F.abs(F.col("found") - F.col("score")) > 1e-9)
    return both.agg(F.countDistinct("query_id").alias("asked"), F.count(F.lit(1)).alias("wanted"), (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("recall_of_nine_tenths"), wrong.cast("int").alias("wrong_scores"))


@registered("select user_id::varchar as repo_name, count(*) as manifests, count(*) - 1 as pointers, max(ts) as head_at from events group by user_id")
def manifest_log(spark, sf_dir):
    """Three publications, each a commit of its own rows; in each ref all but the first manifest point to the one before."""
    store, e = _store(spark), table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").cast("string").alias("manifest_id"), F.col("user_id").cast("string").alias("repo_name"), F.lit("main").alias("ref_name"), F.lit("s").alias("snapshot_id"), _none().alias("index_run_id"), F.col("ts").alias("published_at"), _none().alias("previous_manifest_id"), F.lit("published").alias("status"))
    third = F.ntile(3).over(Window.partitionBy("repo_name").orderBy("published_at", "manifest_id"))
    dealt = rows.withColumn("third", third)
    for i in (1, 2, 3):
        store.publish(dealt.where(F.col("third") == i).drop("third"))
    log = store.read("manifests")
    heads = W.heads(log).select("repo_name", F.col("published_at").alias("head_at"))
    return log.groupBy("repo_name").agg(F.count(F.lit(1)).alias("manifests"), F.countDistinct("previous_manifest_id").alias("pointers")).join(heads, "repo_name")


@registered(f"with {_BM25} select id, round(score, 6) as score from scored where score > 0 order by score desc, id limit 10")
def ranked_postings(spark, sf_dir):
    """A top-k report from stored blocks."""
    store = _store(spark)
    for name, rows in ranked.build(documents(spark, sf_dir), "doc_id").items():
        store.write(name, rows)
    found, _ = ranked.search(store.read("blocks"), store.read("terms"), ASKED, 10)
    return found.select("id", F.round("score", 6).alias("score"))


@registered("""select source || '/' || lang as folder, count(*) as documents, sum(octet_length(encode(text)) + 1)::bigint as size, md5(string_agg(text, chr(10) order by doc_id) || chr(10)) as digest
    from (select doc_id, source, lang, coalesce(text, '') as text from documents) where lang <> 'fr' and source <> 'src3' group by source, lang""")
def scanned_files(spark, sf_dir):
    """Documents as files in folders; the ignore list of the root leaves out a folder anywhere and one at the root."""
    root, d = G.work_folder(spark), documents(spark, sf_dir).where("lang is not null").withColumn("text", F.coalesce("text", F.lit("")))
    placed = d.select("source", "lang", "text", "doc_id").repartition("source", "lang").sortWithinPartitions("source", "lang", "doc_id")
    placed.select("source", "lang", "text").write.partitionBy("source", "lang").text(root)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/.gitignore")
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(b"# folders\n\nlang=fr/\n/source=src3/\n*.crc\n"))
    out.close()
    found = readers.scan(spark, root, extensions=[".txt"], ignored=readers.gitignore_patterns(spark, f"{root}/.gitignore"), megabytes=1000, content=True)
    folder = F.concat_ws("/", F.regexp_extract("relative_path", "source=([^/]+)", 1), F.regexp_extract("relative_path", "lang=([^/]+)", 1))
    counted = d.groupBy(F.concat_ws("/", "source", "lang").alias("folder")).agg(F.count(F.lit(1)).alias("documents"))
    return found.select(folder.alias("folder"), "size", F.md5(F.col("content").cast("binary")).alias("digest")).join(counted, "folder").select("folder", "documents", "size", "digest")
