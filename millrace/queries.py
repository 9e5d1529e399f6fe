"""The registered queries over the shared tables, each with the SQL that must give the same rows.

Documents stand in for elements: id, repository = source, type by id, code = text. Events stand in for logs,
orders and line items for edges, conversations for dialogue.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions import values as V
from .operators import facts as X
from .operators import graph as G
from .operators import overview as O
from .operators import parsing as P
from .operators import resolve as R
from .operators import retrieval as Q
from .operators import selection as S
from .operators import versions as W
from .sources.readers import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The words that lexical queries ask for.
ASKED = "the that and"
#: The rows that the flagship returns: a top-k report.
FLAGSHIP_K = 5


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_TYPE = "case doc_id % 4 when 0 then 'function' when 1 then 'class' when 2 then 'file' else 'documentation' end"
_ELEMENTS = f"""elements as (select doc_id as id, {_TYPE} as type, 'd' || doc_id as name, source || '/' || doc_id as relative_path,
    lang as language, 1 as start_line, len(string_split(text, chr(10))) as end_line, text as code, source as repo_name from documents)"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select(
        F.col("doc_id").alias("id"), F.expr(_TYPE).alias("type"), F.concat(F.lit("d"), "doc_id").alias("name"), F.concat_ws("/", "source", "doc_id").alias("relative_path"), F.concat_ws("/", "source", "doc_id").alias("file_path"),
        F.col("lang").alias("language"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), F.col("text").alias("code"), F.col("source").alias("repo_name"),
    )


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


# -- lexical ------------------------------------------------------------------------
_TOKENS = "tokens as (select doc_id as id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') as w from documents)"
_IDF = f"""{_TOKENS}, size as (select count(*) as n, avg(len(w)) as mean_length from tokens),
    df as (select term, count(*) as df from (select id, unnest(list_distinct(w)) as term from tokens) group by term),
    raw as (select term, ln(n - df + 0.5) - ln(df + 0.5) as raw from df, size),
    idf as (select term, case when raw < 0 then {Q.NEGATIVE_IDF_SHARE} * (select avg(raw) from raw) else raw end as idf from raw)"""
_BM25 = f"""{_IDF},
    hits as (select id, len(w) as dl, q.term, len(list_filter(w, lambda x: x = q.term)) as tf from tokens, (values ('the'), ('that'), ('and')) as q(term)),
    scored as (select id, sum(idf * tf * {Q.K1 + 1} / (tf + {Q.K1} * (1 - {Q.B} + {Q.B} * dl / mean_length))) as score from hits join idf using (term), size where tf > 0 group by id having sum(idf * tf) <> 0)"""


@registered(f"with {_BM25} select id, round(score, 6) as score from scored where score > 0 order by score desc, id limit 10")
def bm25_topk(spark, sf_dir):
    """A top-k report."""
    found = Q.top(Q.bm25(documents(spark, sf_dir), ASKED, "doc_id"), 10)
    return found.select("id", F.round("score", 6).alias("score"))


@registered(f"with {_IDF} select term, df, round(idf, 6) as idf from idf join df using (term)")
def bm25_idf(spark, sf_dir):
    d = documents(spark, sf_dir)
    size = Q.corpus_size(d).select("documents")
    terms = Q.document_terms(d).crossJoin(F.broadcast(size))
    return Q.idf(terms, F.col("documents")).select("term", "df", F.round("idf", 6).alias("idf"))


@registered(f"with {_BM25} select id, round(score, 6) as score from scored where score > 0")
def bm25_from_index(spark, sf_dir):
    """All scores from stored postings."""
    d = documents(spark, sf_dir)
    size = Q.corpus_size(d)
    known, _ = Q.corpus_statistics(Q.document_terms(d), size)
    return Q.bm25_from_postings(Q.postings(d, "doc_id"), size, ASKED, known).select("id", F.round("score", 6).alias("score"))


# -- vectors --------------------------------------------------------------------------
_COSINE = "list_dot_product(e.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])))"
_DISTANCE = "list_sum(list_transform(list_zip(e.embedding::double[], q.embedding::double[]), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"


@registered(f"select e.vec_id as id, round({_COSINE}, 6) as score from embeddings e, embeddings q where q.vec_id = 0 order by {_COSINE} desc, id limit 10")
def cosine_topk(spark, sf_dir):
    """A top-k report."""
    return Q.vector_top(vectors(spark, sf_dir), first_vector(spark, sf_dir), 10).select("id", F.round("score", 6).alias("score"))


@registered(f"""select query_id, id, rank, score from (select q.vec_id as query_id, e.vec_id as id, round({_COSINE}, 6) as score,
    row_number() over (partition by q.vec_id order by {_COSINE} desc, e.vec_id)::int as rank from embeddings e, embeddings q where q.vec_id % 100 = 0) where rank <= 3""")
def cosine_batch_topk(spark, sf_dir):
    """Every hundredth vector against all, three best each."""
    v = vectors(spark, sf_dir)
    asked = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return Q.vector_batch_top(v, asked, 3).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@registered(f"select e.vec_id as id, round(1 / (1 + {_DISTANCE}), 6) as squared, round(1 / (1 + sqrt({_DISTANCE})), 6) as plain from embeddings e, embeddings q where q.vec_id = 0")
def l2_similarity(spark, sf_dir):
    q = F.array(*[F.lit(float(x)) for x in first_vector(spark, sf_dir)])
    return vectors(spark, sf_dir).select("id", F.round(V.squared_l2_similarity(F.col("vector"), q), 6).alias("squared"), F.round(V.l2_similarity(F.col("vector"), q), 6).alias("plain"))


# -- fusion and ranking -------------------------------------------------------------------
_FUSED = f"""with {_BM25}, {_ELEMENTS}, semantic as (select e.vec_id as id, {_COSINE} as score from embeddings e, embeddings q where q.vec_id = 0),
    keyword as (select id, score / (select max(score) from scored) as score from scored where score > 0),
    fused as (select coalesce(s.id, k.id) as id, coalesce(s.score, 0) * {Q.SEMANTIC_WEIGHT} + coalesce(k.score, 0) * {Q.KEYWORD_WEIGHT} as total
        from semantic s full join keyword k on s.id = k.id),
    boosted as (select f.id, total * (1 + least(greatest(coalesce(l.quality * 100, 0), 0), 100) / 200.0) as total from fused f left join labels l on l.doc_id = f.id)"""


def _fused(spark, sf_dir):
    d = documents(spark, sf_dir)
    semantic = vectors(spark, sf_dir).select("id", V.cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in first_vector(spark, sf_dir)])).alias("score"))
    priority = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") * 100).alias("source_priority"))
    return Q.fuse(semantic, Q.bm25(d, ASKED, "doc_id"), priority=priority)


@registered(f"{_FUSED} select id, round(total, 6) as total_score from boosted")
def hybrid_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select("id", F.round("total_score", 6).alias("total_score"))


_WEIGHT = "case type when 'function' then 1.2 when 'class' then 1.1 when 'file' then 0.9 when 'documentation' then 0.8 else 1.0 end"


@registered(f"{_FUSED} select id, type, round(total * {_WEIGHT}, 6) as total_score from boosted join elements using (id)")
def rerank_type(spark, sf_dir):
    rows = elements(spark, sf_dir).join(_fused(spark, sf_dir), "id")
    return Q.rerank(rows).select("id", "type", F.round("total_score", 6).alias("total_score"))


@registered(f"""{_FUSED}, ranked as (select id, repo_name, total * {_WEIGHT} as s from boosted join elements using (id)),
    again as (select id, s, row_number() over (partition by repo_name order by s desc, id) > 1 as r from ranked)
    select id, round(case when r then s * 0.9 else s end, 6) as total_score from again""")
def diversify(spark, sf_dir):
    rows = Q.rerank(elements(spark, sf_dir).join(_fused(spark, sf_dir), "id"))
    return Q.diversify(rows, file_col="repo_name").select("id", F.round("total_score", 6).alias("total_score"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: BM25 and cosine, fused, boosted, reranked by type, diversified by source, the five best."""
    rows = Q.diversify(Q.rerank(elements(spark, sf_dir).join(_fused(spark, sf_dir), "id")), file_col="repo_name")
    return Q.top(rows, FLAGSHIP_K, "total_score").select("id", "type", "repo_name", F.round("total_score", 6).alias("total_score"))


@registered(f"""{_FUSED}, ranked as (select id, type, repo_name, total * {_WEIGHT} as s from boosted join elements using (id)),
    again as (select *, row_number() over (partition by repo_name order by s desc, id) > 1 as r from ranked),
    final as (select id, type, repo_name, case when r then s * 0.9 else s end as s from again)
    select id, type, repo_name, round(s, 6) as total_score from final order by s desc, id limit {FLAGSHIP_K}""")
def hybrid_search(spark, sf_dir):
    """The flagship: a top-k report."""
    return flagship(spark, sf_dir)


@registered(f"""with {_BM25}, sem as (select 'src' || (vec_id % 20) as repo_name, max({_COSINE}) as score from embeddings e, (select embedding from embeddings where vec_id = 0) q group by 1),
    kw as (select source as repo_name, sum(score) as score from scored join documents on doc_id = id where score > 0 group by 1),
    s as (select * from sem order by score desc, repo_name limit 10), k as (select repo_name, score / max(score) over () as score from (select * from kw order by score desc, repo_name limit 10)),
    fused as (select coalesce(s.repo_name, k.repo_name) as repo_name, coalesce(s.score, 0) as semantic, coalesce(k.score, 0) as bm25 from s full join k on s.repo_name = k.repo_name)
    select repo_name, round(semantic, 6) as semantic_score, round(bm25, 6) as bm25_score, round(0.7 * semantic + 0.3 * bm25, 6) as total_score from fused
    where 0.7 * semantic + 0.3 * bm25 > 0.15 or semantic > 0.4 or bm25 > 0.95 order by 0.7 * semantic + 0.3 * bm25 desc, repo_name limit 5""")
def repo_select(spark, sf_dir):
    """The five repositories that fit best."""
    d = documents(spark, sf_dir)
    q = F.array(*[F.lit(float(x)) for x in first_vector(spark, sf_dir)])
    sem = vectors(spark, sf_dir).groupBy(F.concat(F.lit("src"), (F.col("id") % 20).cast("string")).alias("repo_name")).agg(F.max(V.cosine(F.col("vector"), q)).alias("score"))
    kw = Q.bm25(d, ASKED, "doc_id").join(d.select(F.col("doc_id").alias("id"), F.col("source").alias("repo_name")), "id").groupBy("repo_name").agg(F.sum("score").alias("score"))
    found = Q.select_repositories(sem, kw)
    return found.select("repo_name", *[F.round(c, 6).alias(c) for c in ("semantic_score", "bm25_score", "total_score")])


# -- filters and search ------------------------------------------------------------------------
@registered(f"with {_ELEMENTS} select id, type, language, relative_path from elements where language = 'en' and type = 'function' and relative_path like '%src1%'")
def apply_filters(spark, sf_dir):
    return Q.apply_filters(elements(spark, sf_dir), language="en", type="function", file_path="src1").select("id", "type", "language", "relative_path")


@registered("""with lines as (select source || '/' || doc_id as path, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_number from documents),
    hits as (select *, row_number() over (partition by path order by line_number) as r from lines where regexp_matches(line, '(?i)casino|lizenz|license'))
    select path, 'content' as match_type, line_number::int as line_number, line from hits where r <= 20 and path in (select path from hits group by path order by path limit 30)""")
def grep_lines(spark, sf_dir):
    """The report's own limits: twenty lines a file, thirty files."""
    files = documents(spark, sf_dir).select(F.concat_ws("/", "source", "doc_id").alias("path"), F.col("text").alias("content"))
    return Q.grep(files, "casino|lizenz|license")


@registered("""select id, name, tier from (select p_partkey as id, p_name as name, case when lower(p_name) = 'small widget' then 0 when starts_with(lower(p_name), 'small widget') then 1 when contains(lower(p_name), 'small widget') then 2 end as tier from part)
    where tier is not null order by tier, name, id limit 20""")
def symbol_search(spark, sf_dir):
    """The twenty best names: a top-k report."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return Q.symbol_search(names, "Small Widget").select("id", "name", "tier")


_NORMAL = "lower(trim(regexp_replace({}, '[\"''`]', '', 'g')))"
_NAME_TOKENS = "list_distinct(list_filter(string_split_regex({}, '[\\s_/.-]+'), lambda x: x <> ''))"


@registered(f"""with names(name) as (values ('SRC3'), ('src 7'), ('the src11 repository')), repos as (select distinct source as repo_name from documents),
    n as (select name, repo_name, {_NORMAL.format('name')} as a, {_NORMAL.format('repo_name')} as b from names, repos),
    t as (select *, {_NAME_TOKENS.format('a')} as x, {_NAME_TOKENS.format('b')} as y from n),
    j as (select *, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) as likeness from t),
    r as (select name, repo_name, likeness, case when a = b then 0 when contains(a, b) or contains(b, a) then 1 when likeness >= 0.5 then 2 end as tier from j)
    select name, repo_name, tier from (select *, row_number() over (partition by name order by tier, likeness desc, repo_name) as rank from r where tier is not null) where rank = 1""")
def fuzzy_match(spark, sf_dir):
    names = spark.createDataFrame([("SRC3",), ("src 7",), ("the src11 repository",)], "name string")
    repos = documents(spark, sf_dir).select(F.col("source").alias("repo_name")).distinct()
    return Q.fuzzy_repository(names, repos)


# -- texts ---------------------------------------------------------------------------------------
def _intent_sql() -> str:
    scores = {k: " + ".join("(position('" + p.replace("'", "''") + "' in lower(text)) > 0)::int" for p in v) for k, v in T.INTENTS.items()}
    most = f"greatest({', '.join(scores.values())})"
    return "case when " + most + " = 0 then 'general' " + " ".join(f"when {s} = {most} then '{k}'" for k, s in scores.items()) + " end"


@registered(f"select conv_id, turn, {_intent_sql()} as intent from conversations")
def intent(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.intent(F.col("text")).alias("intent"))


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_KEPT = f"list_filter({_WORDS}, lambda w: length(w) > 2 and w not in {_IN(T.STOP_WORDS)})"


@registered(f"select doc_id, array_to_string(list_concat(list_filter({_KEPT}, lambda w: w in {_IN(T.CODE_TERMS)}), list_filter({_KEPT}, lambda w: w not in {_IN(T.CODE_TERMS)})), ' ') as keywords from documents")
def keywords(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))


def _expand_sql() -> str:
    cases = " ".join(f"when '{k}' then [{', '.join(repr(x) for x in v)}]" for k, v in T.SYNONYMS.items())
    return f"list_transform(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''), lambda w: case w {cases} else [w] end)"


@registered(f"""with e as (select conv_id, turn, flatten({_expand_sql()}) as l from conversations), p as (select conv_id, turn, unnest(l) as w, generate_subscripts(l, 1) as i from e),
    f as (select conv_id, turn, w, min(i) as i from p group by all) select conv_id, turn, string_agg(w, ' ' order by i) as expanded from f group by conv_id, turn""")
def expand(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.expand(F.col("text")).alias("expanded"))


@registered("""with p as (select conv_id, turn, text, list_filter(list_transform(string_split_regex(text, ' and | or |, |; '), lambda x: trim(x)), lambda x: length(x) > 15 and x <> text) as parts, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as n from conversations)
    select conv_id, turn, case when n >= 10 then array_to_string(parts[1:3], '|') else '' end as subqueries from p""")
def decompose(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.decompose(F.col("text")), "|").alias("subqueries"))


@registered("""with w as (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as w from documents),
    s as (select doc_id, w, unnest(generate_series(0, greatest(0, ceil((len(w) - 1000) / 800.0))::bigint)) * 800 as start_word from w where len(w) > 0)
    select doc_id, start_word::int as start_word, least(start_word + 1000, len(w))::int as end_word, md5(array_to_string(w[start_word + 1 : start_word + 1000], ' ')) as digest from s""")
def chunk_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.explode(T.chunk_words(F.col("text"))).alias("c")).select("doc_id", "c.start_word", "c.end_word", F.md5(F.col("c.text").cast("binary")).alias("digest"))


@registered("""with l as (select doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x))) as line, from documents),
    c as (select doc_id, regexp_matches(line, '^(//|#|/\\*|\\*)') as comment, line from l)
    select doc_id, count(*) filter (line <> '' and not comment) as code_lines, count(*) filter (comment) as comment_lines from c group by doc_id""")
def line_counts(spark, sf_dir):
    return P.line_counts(documents(spark, sf_dir), "text", "doc_id").select("doc_id", "code_lines", "comment_lines")


def _entities(x: str) -> str:
    for entity, plain in T._ENTITIES:
        x = f"replace({x}, '{entity}', '" + plain.replace("'", "''") + "')"
    return x


_STRIPPED = _entities("regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<[^>]+>', '', 'g')")


@registered(f"select page_id, md5(trim({_STRIPPED}, ' ')) as digest from pages")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_html(F.col("html")).cast("binary")).alias("digest"))


def _markdown_sql() -> str:
    x = "regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g')"
    x = f"""regexp_replace({x}, '(?is)<a[^>]*href=["'']([^"'']*)["''][^>]*>(.*?)</a>', '[\\2](\\1)', 'g')"""
    for level in range(1, 7):
        x = f"regexp_replace({x}, '(?is)<h{level}[^>]*>(.*?)</h{level}>', chr(10) || '{'#' * level} \\1' || chr(10), 'g')"
    x = f"regexp_replace({x}, '(?is)<li[^>]*>(.*?)</li>', chr(10) || '- \\1', 'g')"
    x = f"regexp_replace({x}, '(?i)</(p|div|section|article)>', chr(10) || chr(10), 'g')"
    x = f"regexp_replace({x}, '(?i)<br\\s*/?>|<hr\\s*/?>', chr(10), 'g')"
    x = _entities(f"regexp_replace({x}, '(?s)<[^>]+>', '', 'g')")
    x = f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@registered(f"select page_id, md5({_markdown_sql()}) as digest from pages")
def html_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_to_markdown(F.col("html")).cast("binary")).alias("digest"))


# -- overviews -------------------------------------------------------------------------------------
@registered(f"""with {_ELEMENTS} select repo_name, count(distinct relative_path) as files, count(*) filter (type = 'class') as classes, count(*) filter (type = 'function') as functions,
    round(coalesce(avg(case when end_line > start_line then end_line - start_line + 1 end), 0), 6) as avg_lines, max(len(string_split(relative_path, '/')) - 1)::int as max_depth from elements group by repo_name""")
def repo_stats(spark, sf_dir):
    return O.repository_stats(elements(spark, sf_dir)).withColumn("avg_lines", F.round("avg_lines", 6))


@registered("select coalesce(source, 'unknown') as repo_name, count(*) as elements from documents group by 1")
def count_by_repo(spark, sf_dir):
    return O.count_by_repository(elements(spark, sf_dir))


_PATH = "source || '/' || lang || '/d' || doc_id || case lang when 'en' then '.py' when 'de' then '.js' when 'fr' then '.rs' else '.md' end"


def _files(spark, sf_dir):
    suffix = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".js").when(F.col("lang") == "fr", ".rs").otherwise(".md")
    return documents(spark, sf_dir).select(F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/d"), F.col("doc_id"), suffix).alias("path"))


@registered(f"""with f as (select {_PATH} as path from documents), e as (select regexp_extract(path, '(\\.[a-z]+)$', 1) as extension from f)
    select extension, count(*) as files, case extension when '.py' then 'python' when '.js' then 'javascript' when '.rs' then 'rust' else 'markdown' end as language from e group by extension""")
def ext_counts(spark, sf_dir):
    return O.extension_counts(_files(spark, sf_dir))


@registered(f"""with p as (select string_split({_PATH}, '/') as p from documents), d as (select p, unnest(generate_series(1, len(p) - 1)) as depth from p)
    select array_to_string(p[1:depth], '/') as directory, count(distinct case when depth = len(p) - 1 then p[-1] end) as n from d group by 1""")
def directory_tree(spark, sf_dir):
    return O.directories(_files(spark, sf_dir)).select("directory", F.size("files").cast("long").alias("n"))


@registered("""select repo_name, count(*) as elements, count(distinct relative_path) as files from (select source as repo_name, source || '/' || doc_id as relative_path from documents) group by repo_name""")
def index_catalogue(spark, sf_dir):
    return O.catalogue(elements(spark, sf_dir).withColumn("repo_url", F.lit(None).cast("string"))).drop("url")


# -- facts -------------------------------------------------------------------------------------------
_AST = "ast as (select 'ast:' || doc_id as symbol_id, source as path, 'n' || (doc_id % 97) as display_name, lang as kind, (doc_id % 5)::int as start_line from documents)"
_PRECISE = "precise as (select 'scip:' || d.doc_id as symbol_id, source as path, 'n' || (d.doc_id % 97) as display_name, lang as kind, (d.doc_id % 5)::int as start_line from documents d join labels l on l.doc_id = d.doc_id where l.quality = 1)"


def _symbols(spark, sf_dir, prefix: str, kept: DataFrame) -> DataFrame:
    n = F.lit(None).cast("string")
    return kept.select(
        F.concat(F.lit(f"{prefix}:"), "doc_id").alias("symbol_id"), n.alias("external_symbol_id"), F.col("source").alias("path"), F.concat(F.lit("n"), F.col("doc_id") % 97).alias("display_name"), F.col("lang").alias("kind"), F.col("lang").alias("language"), n.alias("qualified_name"), n.alias("signature"),
        (F.col("doc_id") % 5).cast("int").alias("start_line"), F.lit(0).alias("start_col"), F.lit(0).alias("end_line"), F.lit(0).alias("end_col"), F.lit(10).alias("source_priority"), F.array(F.lit(prefix)).alias("source_set"), F.array().cast("array<string>").alias("aliases"), n.alias("element_id"),
    )


def _both(spark, sf_dir):
    d = documents(spark, sf_dir)
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    return _symbols(spark, sf_dir, "ast", d), _symbols(spark, sf_dir, "scip", d.join(good, "doc_id", "left_semi"))


_MERGED = f"""{_AST}, {_PRECISE}, keyed as (select path, display_name, kind, start_line, max(symbol_id) as canonical_id from precise group by all),
    matched as (select a.symbol_id, canonical_id from ast a join keyed k on a.path = k.path and a.display_name = k.display_name and a.kind = k.kind and a.start_line = k.start_line)"""


@registered(f"""with {_MERGED}, gained as (select canonical_id as symbol_id, list_sort(list(symbol_id)) as aliases from matched group by canonical_id)
    select p.symbol_id, coalesce(array_to_string(aliases, ','), '') as aliases, case when aliases is null then 'scip' else 'ast,scip' end as sources from precise p left join gained using (symbol_id)
    union all select symbol_id, '', 'ast' from ast where symbol_id not in (select symbol_id from matched)""")
def merge_precedence(spark, sf_dir):
    symbols, _ = X.merge_symbols(*_both(spark, sf_dir))
    return symbols.select("symbol_id", F.array_join("aliases", ",").alias("aliases"), F.array_join("source_set", ",").alias("sources"))


def _occurrences(symbols: DataFrame, source: str) -> DataFrame:
    return symbols.select(F.concat(F.lit("occ:"), "symbol_id").alias("occurrence_id"), "symbol_id", F.col("path").alias("doc_id"), F.lit("definition").alias("role"), "start_line", F.lit(0).alias("start_col"), F.lit(0).alias("end_line"), F.lit(0).alias("end_col"), F.lit(source).alias("source"))


@registered(f"""with {_MERGED}, occ as (select symbol_id, path, start_line, 0 as rank, 'occ:' || symbol_id as occurrence_id from precise
    union all select coalesce(canonical_id, a.symbol_id), path, start_line, 1, 'occ:' || a.symbol_id from ast a left join matched m on m.symbol_id = a.symbol_id),
    r as (select *, row_number() over (partition by symbol_id, path, start_line order by rank, occurrence_id) as n from occ)
    select occurrence_id, symbol_id, case rank when 0 then 'scip' else 'ast' end as source from r where n = 1""")
def occurrence_dedup(spark, sf_dir):
    ast, precise = _both(spark, sf_dir)
    _, canonical = X.merge_symbols(ast, precise)
    return X.merge_occurrences(_occurrences(ast, "ast"), _occurrences(precise, "scip"), canonical).select("occurrence_id", "symbol_id", "source")


@registered("""with docs as (select doc_id::varchar as i, source as path from documents), nodes as (select doc_id::varchar as i from labels)
    select 'duplicate document path' as rule, path as detail from docs group by path having count(*) > 1
    union all select 'edge dst not found', 'e' || i || ' -> ' || i from docs where i not in (select i from nodes) and i not in (select i from docs where i::bigint < 100)""")
def validate_anti(spark, sf_dir):
    """Two of the integrity rules over planted violations: repeated paths, edges to nothing."""
    d, n = documents(spark, sf_dir), F.lit(None).cast("string")
    docs = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("path"))
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("symbol_id")).distinct().withColumn("source_set", F.array(F.lit("x")))
    edges = d.select(F.concat(F.lit("e"), "doc_id").alias("edge_id"), F.col("doc_id").cast("string").alias("src_id"), F.col("doc_id").cast("string").alias("dst_id"), F.lit("x").alias("source"), F.lit("x").alias("confidence"))
    small = docs.where(F.col("doc_id").cast("long") < 100)
    none = docs.limit(0).select(n.alias("doc_id"), n.alias("symbol_id"))
    repeated = X.validate({"documents": docs, "symbols": known, "occurrences": none, "edges": edges.limit(0)}).where("rule = 'duplicate document path'")
    lost = X.validate({"documents": small, "symbols": known, "occurrences": none, "edges": edges}).where("rule = 'edge dst not found'")
    return repeated.union(lost)


@registered(f"""with {_MERGED}, merged as (select symbol_id, display_name, path from precise union all select symbol_id, display_name, path from ast where symbol_id not in (select symbol_id from matched)),
    alias as (select symbol_id as alias, symbol_id as c from merged union select symbol_id, canonical_id from matched), asked as (select doc_id as ask_id, 'ast:' || doc_id as s, 'n' || (doc_id % 101) as name from documents)
    select ask_id, coalesce((select min(c) from alias where alias = s), (select min(symbol_id) from merged where display_name = name)) as canonical_id from asked""")
def alias_resolve(spark, sf_dir):
    symbols, _ = X.merge_symbols(*_both(spark, sf_dir))
    asked = documents(spark, sf_dir).select(F.col("doc_id").alias("ask_id"), F.concat(F.lit("ast:"), "doc_id").alias("symbol_id"), F.concat(F.lit("n"), F.col("doc_id") % 101).alias("name"), F.lit(None).cast("string").alias("path"))
    return X.resolve(asked, symbols).select("ask_id", "canonical_id")


@registered("""select 'doc:' || left(md5('snap:' || source || '/' || doc_id), 24) as fact, 'src_function_' || left(md5('src/function/' || source || '/d' || doc_id), 16) as element, 'snap_' || left(md5('snap:r:' || doc_id), 20) as artifact,
    sha1('r:snap:' || doc_id || ':True:False') as idempotency from documents""")
def identity_ids(spark, sf_dir):
    path = F.concat_ws("/", "source", "doc_id")
    return documents(spark, sf_dir).select(
        V.fact_id("doc", F.lit("snap"), path).alias("fact"), V.element_id(F.lit("src"), F.lit("function"), F.col("source"), F.concat(F.lit("d"), "doc_id")).alias("element"),
        V.artifact_key(V.snapshot_id(F.lit("r"), F.col("doc_id").cast("string"))).alias("artifact"), V.idempotency_key(F.lit("r"), F.concat_ws(":", F.lit("snap"), "doc_id"), F.lit(True), F.lit(False)).alias("idempotency"),
    )


# -- graphs --------------------------------------------------------------------------------------------
_EDGES = """edges as (select 'o' || l_orderkey as src_id, 'p' || l_partkey as dst_id, 'call' as edge_type, l_linenumber as ord from lineitem
    union all select 'o' || l_orderkey, 's' || l_suppkey, 'ref', l_linenumber from lineitem
    union all select 'c' || o_custkey, 'o' || o_orderkey, 'contain', 0 from orders
    union all select 'n' || n_nationkey, 'r' || n_regionkey, 'inherit', 0 from nation union all select 'x', 'y', 'unknown', 0)"""


def _edges(spark, sf_dir):
    l, o, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "nation"))
    pre = lambda p, c: F.concat(F.lit(p), F.col(c))
    kinds = [
        l.select(pre("o", "l_orderkey").alias("src_id"), pre("p", "l_partkey").alias("dst_id"), F.lit("call").alias("edge_type"), F.col("l_linenumber").alias("ord")),
        l.select(pre("o", "l_orderkey"), pre("s", "l_suppkey"), F.lit("ref"), "l_linenumber"), o.select(pre("c", "o_custkey"), pre("o", "o_orderkey"), F.lit("contain"), F.lit(0)),
        n.select(pre("n", "n_nationkey"), pre("r", "n_regionkey"), F.lit("inherit"), F.lit(0)), spark.range(1).select(F.lit("x"), F.lit("y"), F.lit("unknown"), F.lit(0)),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.union(k)
    return out


_ROUTED = f"""{_EDGES}, routed as (select case edge_type when 'call' then 'call' when 'ref' then 'reference' when 'contain' then 'containment' when 'inherit' then 'inheritance' when 'import' then 'dependency' end as graph, src_id, dst_id, max(ord) as ord
    from edges where edge_type <> 'unknown' group by all)"""


@registered(f"with {_ROUTED} select graph, src_id, dst_id from (select graph, src_id, dst_id from routed group by all)")
def edge_route(spark, sf_dir):
    return G.route_edges(_edges(spark, sf_dir)).select("graph", "src_id", "dst_id")


def _routed(spark, sf_dir):
    return G.route_edges(_edges(spark, sf_dir)).select("graph", F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))


@registered(f"""with {_ROUTED}, ends as (select graph, src_id as n from routed union select graph, dst_id from routed), nodes as (select graph, count(*) as nodes from ends group by graph),
    e as (select graph, count(distinct src_id || '>' || dst_id) as edges from routed group by graph) select graph, nodes, edges from nodes join e using (graph)""")
def graph_stats(spark, sf_dir):
    return G.graph_stats(_routed(spark, sf_dir))


_BIPARTITE = "links as (select distinct 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem)"


def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"))


def _bipartite(spark, sf_dir):
    return _pairs(spark, sf_dir).distinct()


@registered(f"""with {_BIPARTITE}, two as (select src, dst from links union select dst, src from links), h0 as (select 's1' as node, 0 as distance),
    h1 as (select distinct dst as node, 1 as distance from two join h0 on src = node), h2 as (select distinct dst as node, 2 as distance from two join h1 on src = node)
    select node, min(distance) as distance from (select * from h0 union all select * from h1 union all select * from h2) group by node""")
def khop(spark, sf_dir):
    seed = spark.createDataFrame([("s1",)], "seed string")
    return G.reach(G.both_ways(_pairs(spark, sf_dir)), seed, 2).select("node", "distance")


@registered(f"""with {_BIPARTITE}, two as (select src, dst from links union select dst, src from links),
    p1 as (select dst as node, ['p1', dst] as path from two where src = 'p1'),
    p2 as (select b.dst as node, min(list_append(path, b.dst)) as path from two b join p1 on b.src = node group by b.dst),
    p3 as (select b.dst as node, min(list_append(path, b.dst)) as path from two b join p2 on b.src = node group by b.dst),
    p4 as (select b.dst as node, min(list_append(path, b.dst)) as path from two b join p3 on b.src = node group by b.dst)
    select array_to_string(path, '>') as path, (len(path) - 1)::int as hops from (select * from p1 union all select * from p2 union all select * from p3 union all select * from p4) where node = 'p2' order by len(path), path limit 1""")
def shortest_path(spark, sf_dir):
    return G.shortest_path(G.both_ways(_pairs(spark, sf_dir)), "p1", "p2").select(F.array_join("path", ">").alias("path"), "hops")


_WEIGHTED = f"""{_EDGES}, weighted as (select least(src_id, dst_id) as a, greatest(src_id, dst_id) as b, sum(case edge_type when 'call' then 3.0 when 'inherit' then 2.5 when 'import' then 2.0 when 'ref' then 1.5 else 1.0 end)::double as weight,
    array_to_string(list_sort(list(distinct edge_type)), ',') as edge_types from edges where edge_type <> 'unknown' group by 1, 2)"""


def _weighted(spark, sf_dir):
    e = _edges(spark, sf_dir).where("edge_type <> 'unknown'").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "edge_type")
    return G.weighted_graph(e)


@registered(f"with {_WEIGHTED} select a, b, weight, edge_types from weighted")
def weighted_graph(spark, sf_dir):
    return _weighted(spark, sf_dir).withColumn("edge_types", F.array_join("edge_types", ","))


@registered(f"""with {_WEIGHTED}, c as (select left(a, 2) as x, left(b, 2) as y, weight from weighted where left(a, 2) <> left(b, 2))
    select least(x, y) as ca, greatest(x, y) as cb, sum(weight) as weight, least(1.0, sum(weight) / 4) as confidence from c group by 1, 2""")
def cluster_xrefs(spark, sf_dir):
    g = _weighted(spark, sf_dir)
    labels = g.select(F.col("a").alias("node")).union(g.select("b")).distinct().withColumn("cluster", F.substring("node", 1, 2))
    return G.cluster_graph(g, labels)


@registered(f"""with {_WEIGHTED}, ends as (select a as node from weighted union all select b from weighted), degree as (select node, count(*) as degree from ends group by node),
    o as (select degree, row_number() over (order by degree) as r, count(*) over () as n from degree),
    t as (select greatest(30, max(degree) filter (r = floor(0.99 * (n - 1)) + 1)) as t, max(n) as n from o), hubs as (select node from degree, t where degree > t and n >= 20)
    select a, b, case when a in (select node from hubs) or b in (select node from hubs) then least(weight, 0.5) else weight end as weight from weighted""")
def hub_damping(spark, sf_dir):
    return G.damp_hubs(_weighted(spark, sf_dir).select("a", "b", "weight")).select("a", "b", "weight")


def _pagerank_sql(rounds: int = 5) -> str:
    steps = ["r0 as (select node, 1.0::double / n as rank from nodes, size)"]
    for i in range(1, rounds + 1):
        steps.append(f"r{i} as (select nodes.node, 0.15 / n + 0.85 * coalesce(got, 0) as rank from nodes cross join size left join (select dst, sum(rank * share) as got from shares join r{i - 1} on src = r{i - 1}.node group by dst) g on g.dst = nodes.node)")
    return f"""with links as (select distinct least(n_nationkey, c_nationkey) as a, greatest(n_nationkey, c_nationkey) as b from (select s_nationkey as n_nationkey, c_nationkey from supplier join customer on s_suppkey = c_custkey)),
        g as (select a, b, (1 + (a + b) % 3)::double as weight from links where a <> b), two as (select a as src, b as dst, weight from g union all select b, a, weight from g),
        shares as (select src, dst, weight / sum(weight) over (partition by src) as share from two), nodes as (select distinct src as node from two), size as (select count(*) as n from nodes), {", ".join(steps)}
        select node, round(rank, 6) as rank from r{rounds}"""


def _nations(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    x = s.join(c, s["s_suppkey"] == c["c_custkey"]).select(F.least("s_nationkey", "c_nationkey").alias("a"), F.greatest("s_nationkey", "c_nationkey").alias("b")).distinct().where("a <> b")
    return x.withColumn("weight", (1 + (F.col("a") + F.col("b")) % 3).cast("double"))


@registered(_pagerank_sql())
def pagerank(spark, sf_dir):
    return G.pagerank(_nations(spark, sf_dir), rounds=5).select("node", F.round("rank", 6).alias("rank"))


@registered("""with recursive links as (select distinct s_nationkey as a, c_nationkey as b from supplier join customer on s_suppkey = c_custkey where s_nationkey <> c_nationkey), two as (select a, b from links union select b, a from links),
    reach as (select a as root, a as node from two union select root, b from reach join two on node = a) select node, min(root) as component from reach group by node""")
def components(spark, sf_dir):
    return G.connected(_nations(spark, sf_dir))


@registered(f"""{_FUSED}, best as (select id, total from boosted order by total desc, id limit 10), links as (select distinct doc_id as src, (doc_id * 7 + 3) % 500 as dst from documents),
    near as (select dst as id, max(total) as parent from best join links on src = best.id where dst not in (select id from boosted) group by dst)
    select id, round(total, 6) as total_score from boosted where id in (select doc_id from documents) union all select id, round(parent * 0.5 * 0.1, 6) from near join documents on doc_id = id""")
def graph_expand(spark, sf_dir):
    els = elements(spark, sf_dir)
    fused = G.written(_fused(spark, sf_dir), f"{G.work_folder(spark)}/fused")  # rows are read thrice
    rows = els.join(fused, "id").withColumn("related_to", F.lit(None).cast("string"))
    links = documents(spark, sf_dir).select(F.col("doc_id").alias("seed"), ((F.col("doc_id") * 7 + 3) % 500).alias("node"))
    return G.expand(rows, links, els).select("id", F.round("total_score", 6).alias("total_score"))


# -- versions ---------------------------------------------------------------------------------------------
def _manifests(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("manifest_id"), F.col("user_id").alias("repo_name"), F.col("event_type").alias("ref_name"), F.col("event_id").alias("snapshot_id"), F.col("ts").alias("published_at"))


@registered("""select user_id as repo_name, event_type as ref_name, event_id as manifest_id, previous as previous_manifest_id from (
    select *, lag(event_id) over (partition by user_id, event_type order by ts, event_id) as previous, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1""")
def manifest_head(spark, sf_dir):
    return W.heads(W.with_previous(_manifests(spark, sf_dir))).select("repo_name", "ref_name", "manifest_id", "previous_manifest_id")


@registered("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def latest_per_key(spark, sf_dir):
    return W.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@registered("""with a as (select o_orderkey as path, o_totalprice as p, o_orderstatus as s from orders where o_orderkey % 10 <> 3),
    b as (select o_orderkey as path, case when o_orderkey % 7 = 1 then o_totalprice + 1 else o_totalprice end as p, o_orderstatus as s from orders where o_orderkey % 10 <> 4)
    select coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'deleted' when a.p = b.p and a.s = b.s then 'unchanged' else 'modified' end as status from a full join b on a.path = b.path""")
def change_detect(spark, sf_dir):
    """Two versions of one table, made by rules: the second lacks and changes other rows than the first."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("mtime"), F.col("o_orderstatus").alias("size"))
    new = o.where("path % 10 <> 4").withColumn("mtime", F.when(F.col("path") % 7 == 1, F.col("mtime") + 1).otherwise(F.col("mtime")))
    return W.file_changes(o.where("path % 10 <> 3"), new)


@registered("""with t as (select event_type as k, max(event_id) as v, min(ts) as first_ts from events where value < 50 group by 1), n as (select event_type as k, min(event_id) as v, max(ts) as first_ts from events where value >= 50 group by 1)
    select coalesce(n.k, t.k) as k, coalesce(n.v, t.v) as v, coalesce(t.first_ts, n.first_ts) as first_ts from t full join n on t.k = n.k""")
def upsert_keep_first(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    old = e.where("value < 50").groupBy(F.col("event_type").alias("k")).agg(F.max("event_id").alias("v"), F.min("ts").alias("first_ts"))
    new = e.where("value >= 50").groupBy(F.col("event_type").alias("k")).agg(F.min("event_id").alias("v"), F.max("ts").alias("first_ts"))
    return W.upsert(old, new, ["k"], keep_first=("first_ts",))


@registered("select conv_id, turn, role from (select *, max(turn) over (partition by conv_id) as m from conversations) where turn > m - 3")
def last_n_turns(spark, sf_dir):
    return W.last_turns(table(spark, sf_dir, "conversations"), 3, "conv_id", "turn").select("conv_id", "turn", "role")


@registered("""with s as (select conv_id, max(turn) as total_turns, bool_or(role = 'assistant') as multi_turn from conversations group by conv_id), f as (select conv_id, text from (select *, row_number() over (partition by conv_id order by turn, role) as r from conversations where role = 'user') where r = 1)
    select s.conv_id as session_id, total_turns, multi_turn, case when length(text) > 80 then left(text, 77) || '...' else text end as title from s left join f using (conv_id)""")
def session_list(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    turns = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_number"), F.lit(None).cast("timestamp").alias("timestamp"), F.col("text").alias("query"), "role", (F.col("role") == "assistant").alias("multi_turn"))
    first = W.earliest(turns.where("role = 'user'"), ["session_id"], ["turn_number", "role"])
    return W.session_list(W.session_index(turns), first).select("session_id", "total_turns", "multi_turn", "title")


@registered("""with e as (select user_id as task_id, event_id, ts, case event_type when 'click' then 'running' when 'purchase' then 'completed' else 'pending' end as status from events)
    select task_id, arg_max(status, (ts, event_id)) as status, count(*) filter (status = 'running') as attempts from e group by task_id""")
def task_states(spark, sf_dir):
    status = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "completed").otherwise("pending")
    return W.task_states(table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), "event_id", F.col("ts").alias("at"), status.alias("status"))).select("task_id", "status", "attempts")


# -- selection ------------------------------------------------------------------------------------------
_SPANS = """one as (select row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)::varchar || '-' || l_orderkey as id, 'f' || (l_orderkey // 5) as relative_path,
    case l_linenumber % 3 when 0 then 'class' else 'function' end as type, (l_partkey % 50)::int as start_line, (l_partkey % 50 + l_quantity)::int as end_line from lineitem)"""


def _spans(spark, sf_dir):
    """Every line item is a span; five orders make a file."""
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", number.cast("string"), "l_orderkey").alias("id"), F.concat(F.lit("f"), F.floor(F.col("l_orderkey") / 5)).alias("relative_path"), F.when(F.col("l_linenumber") % 3 == 0, "class").otherwise("function").alias("type"),
        (F.col("l_partkey") % 50).cast("int").alias("start_line"), (F.col("l_partkey") % 50 + F.col("l_quantity")).cast("int").alias("end_line"), F.lit("r").alias("repo_name"),
    )


@registered(f"""with {_SPANS}, o as (select *, row_number() over (partition by relative_path order by case type when 'class' then 0 else 1 end, -(case when end_line > start_line then end_line - start_line + 1 else 0 end), start_line, id) as n from one)
    select id from o a where not exists (select 1 from o b where b.relative_path = a.relative_path and b.n < a.n and b.start_line <= a.start_line and a.end_line <= b.end_line and (b.start_line < a.start_line or a.end_line < b.end_line))""")
def containment_dedup(spark, sf_dir):
    return S.drop_contained(_spans(spark, sf_dir)).select("id")


@registered(f"""with recursive {_SPANS}, r as (select relative_path as g, id, (case when end_line > start_line then end_line - start_line + 1 else 0 end)::bigint as lines, row_number() over (partition by relative_path order by end_line desc, id) as n from one),
    fold as (select g, n, id, true as take, lines as used, 1 as kept, false as done from r where n = 1
        union all select f.g, r.n, r.id, not f.done and f.used + r.lines <= 120, f.used + case when not f.done and f.used + r.lines <= 120 then r.lines else 0 end, f.kept + case when not f.done and f.used + r.lines <= 120 then 1 else 0 end,
            f.done or (f.used + r.lines > 120 and f.kept >= 5) from fold f join r on r.g = f.g and r.n = f.n + 1)
    select id from fold where take""")
def budget_prune(spark, sf_dir):
    return S.prune_to_budget(_spans(spark, sf_dir).withColumn("priority", F.col("end_line").cast("double")), 120, "relative_path").select("id")


@registered(f"""with {_ELEMENTS}, s as (select id, case when end_line > start_line then end_line - start_line + 1 else 100 end as n, type from elements)
    select id, round(0.2::double + case type when 'function' then 0.2 when 'class' then 0.15 else 0 end + 0.2 * case when n < 50 then 0.8 when n <= 200 then 1.0 when n <= 500 then 0.7 else 0.5 end::double, 6) as priority from s""")
def priority_score(spark, sf_dir):
    none = F.lit(None)
    rows = elements(spark, sf_dir).withColumns({"total_score": none.cast("double"), "semantic_score": none.cast("double"), "agent_found": none.cast("boolean"), "llm_file_selected": none.cast("boolean"), "selection_granularity": none.cast("string")})
    return S.priority(rows).select("id", F.round("priority", 6).alias("priority"))


@registered("""with r as (select conv_id as query_id, turn as round, least(100, turn * 17 % 101)::int as confidence, (turn * 400)::bigint as total_lines from conversations group by all),
    g as (select *, confidence - coalesce(lag(confidence) over w, 0) as confidence_gain, total_lines - coalesce(lag(total_lines) over w, 0) as lines_added from r window w as (partition by query_id order by round))
    select query_id, round, confidence_gain, lines_added, round(case when lines_added > 0 then confidence_gain / lines_added * 1000 else 0 end, 6) as roi from g""")
def round_gains(spark, sf_dir):
    r = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("round"), F.least(F.lit(100), F.col("turn") * 17 % 101).cast("int").alias("confidence"), (F.col("turn") * 400).cast("long").alias("total_lines")).distinct()
    return S.round_gains(r).select("query_id", "round", "confidence_gain", "lines_added", F.round("roi", 6).alias("roi"))


# -- resolution ------------------------------------------------------------------------------------------------
_MODULES = "modules as (select source as repo_name, 'pkg' || (doc_id % 10) || '.mod' || (doc_id % 37) as module, max(doc_id) as file_id from documents group by 1, 2)"


def _modules(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("source").alias("repo_name"), F.concat(F.lit("pkg"), F.col("doc_id") % 10, F.lit(".mod"), F.col("doc_id") % 37).alias("module"), "doc_id").groupBy("repo_name", "module").agg(F.max("doc_id").alias("file_id"))


@registered(f"""with {_MODULES}, i as (select doc_id as importer_id, source as repo_name, 'pkg' || (doc_id % 10) || '.mod' || (doc_id % 37) as importer, 'mod' || ((doc_id * 3) % 37) as m from documents)
    select importer_id, file_id as target_file from i left join modules on modules.repo_name = i.repo_name and module = split_part(importer, '.', 1) || '.' || m""")
def relative_imports(spark, sf_dir):
    """from .mod import x, one in every file."""
    i = documents(spark, sf_dir).select(F.col("doc_id").alias("importer_id"), F.col("source").alias("repo_name"), F.concat(F.lit("pkg"), F.col("doc_id") % 10, F.lit(".mod"), F.col("doc_id") % 37).alias("importer_module"), F.lit(False).alias("is_package"), F.concat(F.lit("mod"), (F.col("doc_id") * 3) % 37).alias("module"), F.lit(1).alias("level"))
    return R.resolve_imports(i, _modules(spark, sf_dir)).select("importer_id", "target_file")


def queries() -> dict[str, Query]:
    from . import code_queries, graph_queries, more_queries, store_queries, stream_queries  # noqa: F401  register their own

    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return SQL
