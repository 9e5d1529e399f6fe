"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, fingerprints, language_id, mixing, near_dup, passages, rolling, token_counts, url_filter, vector_codes, wavelet
from .common import SPACE, default_tokenizer, table

#: Rules of op3: verdict, host/path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
WORD_TOKENIZER, PIECE_TOKENIZER, BYTE_TOKENIZER = "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"
END_ID, TOKEN_LIMIT = 1, 4096


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet.shard_documents(spark, table(spark, sf_dir, "documents"), default_tokenizer(WORD_TOKENIZER), END_ID)
    return wavelet.read_documents(shards)


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict(docs, model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.count_tokens(table(spark, sf_dir, "documents"), default_tokenizer(PIECE_TOKENIZER))
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def bpe_digests(docs: DataFrame, memo_entries: int = bpe.MEMO_ENTRIES) -> DataFrame:
    import public_tokenizers

    encoded = bpe.encode_documents(docs, default_tokenizer(BYTE_TOKENIZER), public_tokenizers.PATTERN, decode=True, memo_entries=memo_entries)
    ids = F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op12_rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.roll(rolling.document_events(table(spark, sf_dir, "documents")))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_wavelet_tokens, op2_repeated_passages, op3_url_filter, op4_language_id, op5_exact_dedup, op6_source_mixing, op7_nearest_vectors, op8_token_counts, op9_byte_bpe, op10_ngram_jaccard, op11_vector_codes, op12_rolling_features, op13_fingerprints)}

_NORMAL = f"regexp_replace(coalesce(text, ''), '[{SPACE}]+', '', 'g')"
_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rule_sql() -> tuple[str, str]:
    cases = []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        host, _, path = rule.partition("/")
        cases.append((f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '/{path}')", rule, verdict))
    rule = " ".join(f"when {fits} then '{r}'" for fits, r, _ in cases)
    verdict = " ".join(f"when {fits} then '{v}'" for fits, _, v in cases)
    return f"case {rule} end", f"case {verdict} when strict_hits * {url_filter.STRICT_WEIGHT} + soft_hits * {url_filter.SOFT_WEIGHT} >= {url_filter.LIMIT} then 'block' else 'allow' end"


def _hits_sql(terms) -> str:
    return " + ".join(f"coalesce(regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])'), false)::int" for t in terms)


def _vector_codes_sql() -> str:
    """Each round as CTEs of its own: distances of all parts to all entries, the nearest, and the new entries."""
    v = vector_codes
    width = "(select max(len(ints)) from kept)"
    text = f"""
        with usable as (
            select vec_id, label, list_transform(embedding, lambda x: floor(x::double * {v.SCALE})::bigint) as ints from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), kept as materialized (select *, row_number() over (order by vec_id) as place from usable
        ), parts as materialized (
            select place, vec_id, label, p, ints[p * {width} // {v.PARTS} + 1 : (p + 1) * {width} // {v.PARTS}] as part from kept, range({v.PARTS}) as r(p)
        ), book0 as materialized (select p, place - 1 as e, part as entry from parts where place <= {v.ENTRIES})"""
    for i in range(v.ROUNDS + 1):
        text += f""", near{i} as materialized (
            select place, vec_id, label, x.p, any_value(part) as part, min(list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint * {v.ENTRIES} + e) as best
            from parts x join book{i} b on x.p = b.p group by all
        )"""
        if i < v.ROUNDS:
            text += f""", sums{i} as (
                select p, best % {v.ENTRIES} as e, j, floor(sum(part[j])::hugeint / count(*))::bigint as mean
                from near{i}, range(1, {width} // {v.PARTS} + 1) as r(j) group by all
            ), book{i + 1} as materialized (
                select b.p, b.e, coalesce(n.entry, b.entry) as entry from book{i} b left join (select p, e, list(mean order by j) as entry from sums{i} group by all) n on n.p = b.p and n.e = b.e
            )"""
    return text + f""", coded as (
            select vec_id, label, string_agg(printf('%02x', best % {v.ENTRIES}), '' order by p) as code, sum(best // {v.ENTRIES})::bigint as error
            from near{v.ROUNDS} group by place, vec_id, label
        )
        select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
            (select sha256(string_agg(array_to_string(entry, ','), ',' order by p, e)) from book{v.ROUNDS}) as codebooks_sha256
        from coded"""


def _rolling_sql() -> str:
    """crc32 is made of its table; a window's lengths are listed and sorted."""
    whole = 0xFFFFFFFF
    lists = ", ".join(f"list(length) filter (length is not null) over w{w} as l{w}, count(*) over w{w} as n{w}, coalesce(sum(length) over w{w}, 0)::bigint as s{w}, count(distinct lang) over w{w} as g{w}" for w in rolling.WINDOWS)
    spans = ", ".join(f"w{w} as (partition by source order by event_s range between {w} preceding and 1 preceding)" for w in rolling.WINDOWS)
    rows = " union all ".join(
        f"""select doc_id, {w}::bigint as window_s, event_s, n{w} as n_events, s{w} as sum_chars, g{w} as n_langs,
            list_sort(l{w})[(50 * len(l{w}) + 99) // 100] as median_chars, list_sort(l{w})[(90 * len(l{w}) + 99) // 100] as high_chars from seen"""
        for w in rolling.WINDOWS
    )
    return f"""
        with crc as (
            select list(list_reduce(list_prepend(i::ubigint, list_transform(range(8), lambda k: k::ubigint)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) order by i) as t from range(256) as r(i)
        ), hashed as (
            select doc_id, source, lang, length(text)::bigint as length,
                xor(list_reduce(list_prepend({whole}::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::ubigint)), lambda h, b: xor(h >> 8, t[(xor(h, b) & 255)::bigint + 1])), {whole}::ubigint)::bigint as h
            from documents, crc
        ), timed as (select *, 60 * floor((doc_id + h % 10000) / 6)::bigint as event_s from hashed
        ), seen as (select doc_id, event_s, {lists} from timed window {spans})
        {rows}"""


def oracle_sql() -> dict[str, str]:
    rule, verdict = _rule_sql()
    soft = [t for t in url_filter.SOFT if t not in url_filter.STRICT]
    weights = " ".join(f"when {i} then {w}.0" for i, w in enumerate(mixing.WEIGHTS))
    levels = len(mixing.WEIGHTS)
    return {
        "op11_vector_codes": _vector_codes_sql(),
        "op12_rolling_features": _rolling_sql(),
        # Fingerprints have no SQL form; the edited texts have.
        "op13_edits": """
            with ordered as (select doc_id, coalesce(text, '') as text, row_number() over (order by doc_id) as place from documents
            ), turned as (select a.doc_id, a.text, b.text as following from ordered a join ordered b on b.place = a.place % (select count(*) from ordered) + 1)
            select doc_id, length(text) as n_chars, sha256(concat(substr(text, 1, length(text) - length(text) // 4), substr(following, 1, length(text) // 4))) as edited_sha256 from turned""",
        "op3_url_filter": f"""
            with parts as (
                select page_id, {_AZ.format("url")} as low,
                    coalesce({_AZ.format("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")}, '') as host,
                    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
                from pages
            ), hits as (select *, ({_hits_sql(url_filter.STRICT)})::int as strict_hits, ({_hits_sql(soft)})::int as soft_hits from parts)
            select page_id, host, path, {rule} as rule, {verdict} as verdict, strict_hits, soft_hits from hits""",
        "op5_exact_dedup": f"""
            with texts as (select doc_id, length(coalesce(text, '')) as n, {_NORMAL} as norm from documents)
            select doc_id, first_value(doc_id) over (partition by norm order by n desc, doc_id) as keep_id,
                count(*) over (partition by norm) as group_size,
                row_number() over (partition by norm order by n desc, doc_id) = 1 as kept, sha256(norm) as text_sha256
            from texts""",
        "op10_ngram_jaccard": f"""
            with recursive lists as (
                select doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^{SPACE}]+') as w from documents
            ), shingles as (
                select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s
                from lists, unnest(generate_series(1, greatest(len(w) - 4, 1))) as g(i) where len(w) > 0
            ), counts as (select doc_id, count(*) as n from shingles group by doc_id
            ), pairs as (
                select a.doc_id as a, b.doc_id as b, count(*) as shared from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all
            ), links as (
                select a, b from pairs join counts x on x.doc_id = a join counts y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)
            ), edges as (select a, b from links union all select b, a from links
            ), reach as (select doc_id as root, doc_id as node from documents union select root, b from reach join edges on node = a)
            select doc_id, coalesce(n, 0) as n_shingles, least_id as component_id
            from documents left join counts using (doc_id) join (select node as doc_id, min(root) as least_id from reach group by node) using (doc_id)""",
        # The draw itself is by a hash that this SQL dialect lacks: sizes and targets are compared by queries of their own.
        "op6_targets": f"""
            with recursive sized as (select source, len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+')) as size from documents
            ), per_source as (select source, sum(size)::bigint as source_size from sized group by source
            ), ordered as (select *, row_number() over (order by source nulls last) - 1 as place, (select sum(source_size) from per_source) * {mixing.SHARE} as total from per_source
            ), weighed as (select *, case place % {levels} {weights} end as weight, {mixing.MOST} * source_size as cap from ordered
            ), filled as (
                select 0 as step, source, weight, cap, false as stopped, 0.0::double as given, total from weighed
                union all
                select step + 1, source, weight, cap, stopped or share >= cap, case when stopped then given else least(share, cap) end, total
                from (select *, (total - coalesce(sum(case when stopped then given end) over (), 0)) * weight / nullif(sum(case when not stopped then weight end) over (), 0) as share from filled)
                where step <= (select count(*) from weighed)
            )
            select p.source, p.source_size, round(f.given, 3) as target from filled f join per_source p on p.source is not distinct from f.source
            where step = (select max(step) from filled)""",
    }


def op6_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_source = mixing.sizes(table(spark, sf_dir, "documents")).groupBy("source").agg(F.sum("size").alias("source_size"))
    return mixing.targets(per_source).select("source", "source_size", F.round("target", 3).alias("target"))


def op13_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def queries() -> dict:
    return QUERIES | {"op6_targets": op6_targets, "op13_edits": op13_edits}
