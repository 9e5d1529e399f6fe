"""More registered queries: functions, selections, stores, graphs and schedules over the shared tables."""

from __future__ import annotations

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
from .queries import _EDGES, _ELEMENTS, _PATH, _ROUTED, _WEIGHTED, _edges, _files, _routed, _weighted, documents, elements, registered, table


# -- texts and names -----------------------------------------------------------------
@registered(f"""with f as (select {_PATH} as path from documents) select path, replace(regexp_replace(path, '\\.py$', ''), '/', '.') as module, string_split(path, '/')[-1] as name,
    array_to_string(string_split(path, '/')[1:-2], '/') as directory, regexp_extract(path, '(\\.[a-z]+)$', 1) as extension from f""")
def path_parts(spark, sf_dir):
    p = F.col("path")
    return _files(spark, sf_dir).select("path", T.module_name(p).alias("module"), T.base_name(p).alias("name"), T.directory(p).alias("directory"), T.extension(p).alias("extension"))


def _complexity_sql() -> str:
    return "1 + " + " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)}" for w in T.COMPLEXITY_WORDS)


@registered(f"select doc_id, ({_complexity_sql()})::int as complexity from documents")
def keyword_complexity(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.complexity(F.col("text")).alias("complexity"))


@registered("select conv_id, turn, case when length(text) > 80 then left(text, 77) || '...' else text end as title from conversations")
def titles(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.title(F.col("text")).alias("title"))


_WORDS = "list_distinct(list_filter(string_split_regex(lower(text), '[\\s_/.-]+'), lambda x: x <> ''))"


@registered(f"""with w as (select item_id, list_distinct(list_filter(string_split_regex(lower(trim(regexp_replace(text, '["''`]', '', 'g'))), '[\\s_/.-]+'), lambda x: x <> '')) as w from benchmark), f as (select w as v from w where item_id = 0)
    select item_id, round(len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v))), 6) as likeness from w, f""")
def jaccard_tokens(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", T.name_tokens(F.col("text")).alias("w"))
    one = b.where("item_id = 0").select(F.col("w").alias("v"))
    return b.crossJoin(F.broadcast(one)).select("item_id", F.round(T.jaccard(F.col("w"), F.col("v")), 6).alias("likeness"))


@registered(f"""with {_ELEMENTS} select id, array_to_string(string_split(code, chr(10))[2:3], chr(10)) as lines from elements""")
def line_range(spark, sf_dir):
    return elements(spark, sf_dir).select("id", T.line_range(F.col("code"), F.lit(2), F.lit(3)).alias("lines"))


@registered(f"""with {_ELEMENTS} select id, md5(concat_ws(' ', name, type, language, relative_path, left(code, 1000))) as digest from elements""")
def lexical_document(spark, sf_dir):
    none = F.lit(None).cast("string")
    text = T.lexical_document(*[F.col(c) for c in ("name", "type", "language", "relative_path")], none, none, none, F.col("code"))
    return elements(spark, sf_dir).select("id", F.md5(text.cast("binary")).alias("digest"))


@registered("""with t as (select conv_id, turn, lower(text) as l from conversations) select conv_id, turn, contains(l, 'function') or contains(l, 'class') or contains(l, 'method') or contains(l, 'variable') or contains(l, 'code') or contains(l, 'implementation')
    or contains(l, 'how to') or contains(l, 'algorithm') or contains(l, 'logic') or contains(l, 'file') or contains(l, 'module') or contains(l, 'import') or contains(l, 'api') or contains(l, 'endpoint') as is_code from t""")
def code_questions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_code_query(F.col("text")).alias("is_code"))


# -- numbers -------------------------------------------------------------------------------
@registered("select doc_id, round((1 + least(greatest(quality * 100, 0), 100) / 200.0)::double, 6) as boost, round((1 / greatest(0.1, quality))::double, 6) as distance, round(least(1.0, (toxic + 1) / 4.0)::double, 6) as confidence from labels")
def score_arithmetic(spark, sf_dir):
    q = F.col("quality")
    return table(spark, sf_dir, "labels").select("doc_id", F.round(V.priority_boost(q * 100), 6).alias("boost"), F.round(V.edge_distance(q), 6).alias("distance"), F.round(V.xref_confidence(F.col("toxic") + 1), 6).alias("confidence"))


@registered("""with e as (select vec_id, embedding::double[] as v from embeddings), n as (select vec_id, v, sqrt(list_dot_product(v, v)) as n from e) select vec_id, round(n, 6) as norm, round(list_sum(list_transform(v, lambda x: x / n)), 6) as sum from n""")
def unit_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(F.aggregate(V.unit(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 6).alias("sum"))


# -- selections -------------------------------------------------------------------------------
@registered(f"with {_ELEMENTS} select sum(case when end_line > start_line then end_line - start_line + 1 else 0 end)::bigint as total_lines from elements")
def total_lines(spark, sf_dir):
    return S.total_lines(elements(spark, sf_dir))


@registered(f"with {_ELEMENTS} select id from elements where relative_path like '%src3%' or (relative_path like '%src5/%' and name = 'd5')")
def keep_listed(spark, sf_dir):
    return Q.keep_listed(elements(spark, sf_dir), ["src3", "src5/:d5"]).select("id")


@registered(f"with {_ELEMENTS} select repo_name as repo, relative_path as file, name, type, start_line || '-' || end_line as lines from elements where type = 'class'")
def shown_sources(spark, sf_dir):
    return Q.sources(elements(spark, sf_dir).where("type = 'class'").withColumn("total_score", F.lit(0.0))).drop("score")


@registered(f"with {_ELEMENTS} select id from elements where coalesce(id, -1) not in (select doc_id from labels)")
def only_new_elements(spark, sf_dir):
    els = elements(spark, sf_dir)
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct().withColumns({c: F.lit(None).cast("string") for c in ("repo_name", "relative_path", "type", "name", "start_line", "end_line")})
    return S.only_new(known, els).select("id")


@registered(f"""with {_ELEMENTS}, s as (select doc_id as selection_id, 'x/' || (doc_id * 3 % 300) as path, source as repo_name from documents),
    m as (select selection_id, e.id, row_number() over (partition by selection_id order by case when e.relative_path = s.path and e.repo_name = s.repo_name then 1 when e.repo_name = s.repo_name then 2 when e.relative_path = s.path then 3 else 4 end, e.id) as r
        from s join elements e on string_split(e.relative_path, '/')[-1] = string_split(s.path, '/')[-1] where e.type = 'file')
    select selection_id, id from m where r = 1""")
def match_selections(spark, sf_dir):
    s = documents(spark, sf_dir).select(F.col("doc_id").alias("selection_id"), F.concat(F.lit("x/"), F.col("doc_id") * 3 % 300).alias("path"), F.col("source").alias("repo_name"), F.lit(None).cast("string").alias("name"))
    return S.match_selections(s, elements(spark, sf_dir)).select("selection_id", "id")


@registered(f"""with {_ELEMENTS}, w as (select *, max((type = 'file')::int) over (partition by repo_name, id % 40) as whole from elements), k as (select *, id % 40 as part from w where whole = 0 or type = 'file'),
    r as (select id, row_number() over (partition by repo_name, part, case whole when 1 then 'file' else id::varchar end order by end_line desc, id) as r from k) select id from r where r = 1""")
def drop_duplicates(spark, sf_dir):
    rows = elements(spark, sf_dir).withColumn("relative_path", (F.col("id") % 40).cast("string")).withColumn("total_score", F.col("end_line").cast("double"))
    return S.drop_duplicates(rows).select("id")


@registered("""with c as (select conv_id as query_id, turn as round, (turn * 17 % 101)::int as confidence, (turn * 400)::bigint as total_lines from conversations group by all)
    select query_id, max(round) as rounds, arg_min(confidence, round) as initial_confidence, arg_max(confidence, round) as final_confidence, arg_max(total_lines, round) as total_lines from c group by query_id""")
def iteration_summary(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("round"), (F.col("turn") * 17 % 101).cast("int").alias("confidence"), (F.col("turn") * 400).cast("long").alias("total_lines")).distinct()
    return S.iteration_summary(c).select("query_id", "rounds", "initial_confidence", "final_confidence", "total_lines")


# -- structure and overviews ----------------------------------------------------------------------
@registered("""with l as (select doc_id, unnest(string_split(text, chr(10))[1:100]) as line, generate_subscripts(string_split(text, chr(10))[1:100], 1) as line_number from documents)
    select doc_id, line_number::int as line_number, regexp_extract(line, '^\\s*(?:import|from|use|using|#include)\\s+[<"]?([\\w./:]+)', 1) as name from l
    where regexp_extract(line, '^\\s*(?:import|from|use|using|#include)\\s+[<"]?([\\w./:]+)', 1) <> '' and regexp_extract(line, '^\\s*(?:export\\s+)?class\\s+(\\w+)', 1) = '' and regexp_extract(line, '^\\s*(?:export\\s+)?(?:async\\s+)?(?:def|function|fn|func)\\s+(\\w+)', 1) = ''""")
def structure_imports(spark, sf_dir):
    files = documents(spark, sf_dir).select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return P.structure_summary(files).where("kind = 'import'").select(F.col("path").alias("doc_id"), "line_number", "name")


@registered(f"""with f as (select {_PATH} as path from documents) select distinct string_split(path, '/')[2] as name, true as is_directory from f where starts_with(path, 'src1/')""")
def list_directory(spark, sf_dir):
    return Q.list_directory(_files(spark, sf_dir), "src1")


@registered(f"""with f as (select source as repo_name, {_PATH} as path from documents), l as (select repo_name, case regexp_extract(path, '(\\.[a-z]+)$', 1) when '.py' then 'python' when '.js' then 'javascript' when '.rs' then 'rust' end as language, count(*) as n, min(path) as first from f group by all),
    m as (select repo_name, arg_min(language, (-n, first)) as primary_language from l where language is not null group by repo_name) select repo_name, coalesce(primary_language, 'unknown') as primary_language, total_files from (select repo_name, count(*) as total_files from f group by 1) left join m using (repo_name)""")
def primary_language(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("repo_name", F.substring_index("path", "/", 1))
    return O.structure_overview(files).select("repo_name", "primary_language", "total_files")


@registered("select source as repo_name, count(*) as elements, n_nationkey as region from documents left join nation on n_nationkey = try_cast(substr(source, 4) as int) group by source, n_nationkey")
def repository_list(spark, sf_dir):
    info = table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), "n_nationkey").alias("repo_name"), F.col("n_nationkey").alias("region"))
    return O.repository_list(elements(spark, sf_dir), info)


# -- graphs -------------------------------------------------------------------------------------------
@registered(f"with {_EDGES} select distinct dst_id as node from edges where src_id = 'c1'")
def successors(spark, sf_dir):
    e = _edges(spark, sf_dir).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    return G.successors(e, "c1")


@registered(f"with {_EDGES} select distinct src_id as node from edges where dst_id = 'p1'")
def predecessors(spark, sf_dir):
    e = _edges(spark, sf_dir).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    return G.predecessors(e, "p1")


@registered(f"""with {_ROUTED}, two as (select src_id as a, dst_id as b from routed union select dst_id, src_id from routed) select a as node, count(*) as degree from two group by a""")
def node_degrees(spark, sf_dir):
    return G.degrees(_routed(spark, sf_dir))


@registered(f"""with {_ROUTED}, e as (select src_id as s, dst_id as d from routed where graph = 'containment'), f1 as (select d as n from e where s = 'c1'), b1 as (select s as n from e where d = 'c1')
    select n as node, 1 as distance from f1 union select n, 1 from b1""")
def containment_neighbours(spark, sf_dir):
    own = _routed(spark, sf_dir).where("graph = 'containment'")
    return G.related_undirected(own, spark.createDataFrame([("c1",)], "seed string"), 1).select("node", "distance")


@registered(f"""with {_WEIGHTED} select a as node, 0 as depth from weighted where false union all select 'c1', 0 union all select distinct dst_id, 1 from edges where src_id = 'c1' and edge_type <> 'unknown'
    union all select distinct e2.dst_id, 2 from edges e1 join edges e2 on e2.src_id = e1.dst_id where e1.src_id = 'c1'""")
def call_chain(spark, sf_dir):
    e = _edges(spark, sf_dir).where("edge_type <> 'unknown'").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    return G.call_chain(e, "c1", 2).select("node", "depth")


@registered(f"""with {_WEIGHTED}, ends as (select a as n from weighted union select b from weighted), m as (select n, left(n, 2) as cluster from ends), s as (select cluster, count(*) as size from m group by cluster)
    select row_number() over (order by size desc, cluster)::int as chunk, cluster, size from s order by size desc, cluster limit 64""")
def cluster_chunks(spark, sf_dir):
    """The 64 largest clusters: a limit of the projection's last layer."""
    g = _weighted(spark, sf_dir)
    labels = g.select(F.col("a").alias("node")).union(g.select("b")).distinct().withColumn("cluster", F.substring("node", 1, 2))
    return projection.chunks(labels, labels.select("node", F.col("node").alias("title"))).select("chunk", "cluster", "size")


#: Milliseconds of a time without a zone.
_MILLIS = "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


# -- stores --------------------------------------------------------------------------------------------
@registered("""with a as (select o_orderkey as path, o_totalprice as p from orders), b as (select o_orderkey as path, case when o_orderkey % 7 = 1 then o_totalprice + 1 else o_totalprice end as p from orders)
    select l_orderkey * 10 + l_linenumber as id from lineitem join a on l_orderkey = a.path join b on a.path = b.path where a.p = b.p""")
def unchanged_elements(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("mtime"), F.lit(1).alias("size"))
    new = o.withColumn("mtime", F.when(F.col("path") % 7 == 1, F.col("mtime") + 1).otherwise(F.col("mtime")))
    parts = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("relative_path"))
    manifest = W.file_manifest(o, parts.withColumn("id", F.col("id").cast("string"))).withColumn("element_ids", F.col("element_ids").cast("array<bigint>"))
    return W.unchanged_elements(parts, manifest, W.file_changes(o, new)).select("id")


@registered("select event_id, user_id from (select *, row_number() over (partition by user_id, event_type order by event_id) as r from events) where r = 1")
def insert_once(spark, sf_dir):
    """The first of each key stays; later ones are ignored."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    first = W.earliest(e, ["user_id", "event_type"], ["event_id"])
    return W.insert_new(first, e, ["user_id", "event_type"]).select("event_id", "user_id")


@registered("""with r as (select user_id as run_id, event_id, ts as t, case event_type when 'signup' then 'running' when 'purchase' then 'succeeded' when 'error' then 'failed' else 'queued' end as status from events)
    select run_id, arg_max(status, (t, event_id)) as status, min(t) as created_at, min(case when status = 'running' then t end) as started_at, max(case when status in ('succeeded', 'failed') then t end) as completed_at from r group by run_id""")
def run_states(spark, sf_dir):
    status = F.when(F.col("event_type") == "signup", "running").when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed").otherwise("queued")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", F.col("ts").alias("at"), status.alias("status"), F.lit(None).cast("string").alias("error_message"))
    return W.run_states(e).drop("error_message")


@registered("select user_id as id, min(epoch_us(ts) // 1000) as next_wake_ms from events where value > 10 group by user_id having min(epoch_us(ts)) <= (select epoch_us(max(ts)) from events)")
def due_jobs(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value > 10").groupBy(F.col("user_id").alias("id")).agg(F.min(F.expr(_MILLIS)).alias("next_run_at_ms")).withColumn("enabled", F.lit(True))
    now = table(spark, sf_dir, "events").agg(F.max(F.expr(_MILLIS))).first()[0]
    return W.due_jobs(e, now).select("id", F.col("next_run_at_ms").alias("next_wake_ms"))


@registered("select event_id, user_id from events where event_type = 'click' and ts > (select max(ts) from events) - interval 720 hours and ts <= (select max(ts) from events)")
def fresh_cache(spark, sf_dir):
    """Entries that live for thirty days, asked for at the last event's time."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", "user_id", "ts")
    last = table(spark, sf_dir, "events").agg(F.max("ts").alias("now"))
    return e.crossJoin(F.broadcast(last)).where(V.is_fresh(F.col("ts"), F.col("now"), 720 * 3600)).select("event_id", "user_id")


@registered("""with i as (select c_custkey::varchar as name, 1048576 as size from customer where c_custkey % 3 <> 0), m as (select c_custkey::varchar as name, 524288 as size from customer where c_custkey % 4 <> 0)
    select coalesce(i.name, m.name) as name, case when m.name is null then 'index without metadata' else 'metadata without index' end as problem, (coalesce(i.size, m.size) / 1048576)::double as megabytes from i full join m on i.name = m.name where i.name is null or m.name is null""")
def orphan_files(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("name"), "c_custkey")
    return W.orphans(c.where("c_custkey % 3 <> 0").withColumn("size", F.lit(1048576)), c.where("c_custkey % 4 <> 0").withColumn("size", F.lit(524288)))


# -- names -----------------------------------------------------------------------------------------------
@registered("""with e as (select source as repo_name, source || '/m' || (doc_id % 13) || '.py' as path, 'f' || (doc_id % 29) as symbol, doc_id from documents)
    select repo_name, replace(regexp_replace(path, '\\.py$', ''), '/', '.') as module, symbol, max(doc_id) as id from e group by all""")
def export_map(spark, sf_dir):
    e = documents(spark, sf_dir).select(F.col("source").alias("repo_name"), F.concat(F.col("source"), F.lit("/m"), F.col("doc_id") % 13, F.lit(".py")).alias("relative_path"), F.concat(F.lit("f"), F.col("doc_id") % 29).alias("name"), F.lit("function").alias("type"), F.lit(None).cast("string").alias("class_name"), F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"))
    return R.export_map(e)


@registered("""with c as (select doc_id as id, source as repo_name, 'C' || (doc_id % 41) as name, 'C' || (doc_id * 5 % 43) as base from documents), f as (select repo_name, name, min(id) as dst from c group by all)
    select distinct c.id as src, f.dst from c join f on f.repo_name = c.repo_name and f.name = c.base where c.id <> f.dst""")
def inheritance_fallback(spark, sf_dir):
    c = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("repo_name"), F.concat(F.lit("C"), F.col("doc_id") % 41).alias("name"), F.array(F.concat(F.lit("C"), F.col("doc_id") * 5 % 43)).alias("bases"), F.col("doc_id").alias("ord"))
    return R.inheritance_edges(c, spark.createDataFrame([], "class_id bigint, base string, target bigint"))


@registered("""with s as (select l_orderkey as f, l_linenumber as id, (l_partkey % 60)::bigint as a, (l_partkey % 60 + l_quantity)::bigint as b from lineitem), c as (select o_orderkey as f, (o_custkey % 90)::bigint as p from orders)
    select c.f as call_id, arg_max(s.id, (s.a, s.id)) filter (s.a <= c.p and c.p < s.b) as scope_id from c left join s on s.f = c.f group by c.f""")
def innermost_scope(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_path"), F.col("l_linenumber").alias("scope_id"), (F.col("l_partkey") % 60).cast("long").alias("start_byte"), (F.col("l_partkey") % 60 + F.col("l_quantity")).cast("long").alias("end_byte"))
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_orderkey").alias("file_path"), (F.col("o_custkey") % 90).cast("long").alias("position"))
    return R.innermost_scope(c, s).select("call_id", "scope_id")


@registered("""with d as (select source as doc_id, lang as s from documents union all select source, 'scip' from documents where doc_id % 3 = 0) select doc_id, array_to_string(list_sort(list(distinct s)), ',') as sources from d group by doc_id""")
def document_union(spark, sf_dir):
    d = documents(spark, sf_dir)
    one = lambda rows, s: rows.select(F.col("source").alias("doc_id"), F.col("source").alias("path"), F.col("lang").alias("language"), F.array(s).alias("source_set"))
    return X.merge_documents(one(d, F.col("lang")), one(d.where("doc_id % 3 = 0"), F.lit("scip"))).select("doc_id", F.array_join("source_set", ",").alias("sources"))
