"""Ids, vectors, arithmetic, maps, JSON and time as column expressions."""

from __future__ import annotations

import json
import re
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


# -- ids (exact formulas) ---------------------------------------------------
def short_md5(text: Column, length: int) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, length)


def element_id(repo: Column, kind: Column, *parts: Column) -> Column:
    """{repo}_{type}_ and 16 hex digits of md5({repo}/{type}/{parts}); null parts are left out."""
    return F.concat(repo, F.lit("_"), kind, F.lit("_"), short_md5(F.concat_ws("/", repo, kind, *parts), 16))


#: One width for both extractors' ids, so that a file has one document id.
FACT_ID_HEX = 24


def fact_id(prefix: str, *parts: Column, sep: str = ":") -> Column:
    """Document, occurrence and edge ids."""
    return F.concat(F.lit(f"{prefix}:"), short_md5(F.concat_ws(sep, *parts), FACT_ID_HEX))


def ast_symbol_id(snapshot, language, path, kind, qualified, line, col) -> Column:
    return F.concat_ws(":", F.lit("ast"), snapshot, language, path, kind, qualified, F.coalesce(line, F.lit(0)).cast("string"), F.coalesce(col, F.lit(0)).cast("string"))


def scip_symbol_id(snapshot: Column, external: Column) -> Column:
    return F.concat_ws(":", F.lit("scip"), snapshot, external)


def snapshot_id(repo: Column, commit: Column) -> Column:
    return F.concat_ws(":", F.lit("snap"), repo, commit)


def artifact_key(snapshot: Column) -> Column:
    return F.concat(F.lit("snap_"), short_md5(snapshot, 20))


def idempotency_key(repo, snapshot, publish, with_scip) -> Column:
    flag = lambda c: F.when(c, F.lit("True")).otherwise(F.lit("False"))
    return F.sha1(F.concat_ws(":", repo, snapshot, flag(publish), flag(with_scip)).cast("binary"))


def projection_id(snapshot, kind, key, target, query, filters: Column) -> Column:
    """filters: map<string,string>, in order of its keys."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(filters)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    whole = F.concat_ws("|", snapshot, kind, key, F.coalesce(target, F.lit("")), F.coalesce(query, F.lit("")), pairs)
    return F.concat(F.lit("proj_"), F.substring(F.sha1(whole.cast("binary")), 1, 20))


def cache_key(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.md5(F.concat_ws("_", *parts).cast("binary")))


# -- vectors ----------------------------------------------------------------
def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """L2-normalised; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(_double(v), lambda x: x / n)).otherwise(_double(v))


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def squared_l2_similarity(a: Column, b: Column) -> Column:
    """1 / (1 + d^2), as element search has it (Q6)."""
    return 1 / (1 + squared_distance(a, b))


def l2_similarity(a: Column, b: Column) -> Column:
    """1 / (1 + d), as overview search has it (Q6)."""
    return 1 / (1 + F.sqrt(squared_distance(a, b)))


def hash_embedding(tokens: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed token counts by hash, L2-normalised."""
    slots = F.transform(tokens, lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(dim)).cast("int").alias("slot"), F.when(F.pmod(F.hash(t), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("sign")))
    zero = F.array_repeat(F.lit(0.0), dim)
    return unit(F.aggregate(slots, zero, lambda acc, s: F.transform(acc, lambda x, i: F.when(i == s["slot"], x + s["sign"]).otherwise(x))))


# -- arithmetic ---------------------------------------------------------------
def priority_boost(priority: Column) -> Column:
    """1 to 1.5 by source priority."""
    return 1 + F.least(F.greatest(F.coalesce(priority.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(100.0)) / 200


def share_of_most(score: Column, most: Column) -> Column:
    """score / most, 0 if there is none."""
    return F.when(most > 0, score / most).otherwise(F.lit(0.0))


def repo_complexity(files: Column, avg_lines: Column, depth: Column) -> Column:
    """Mean of three clipped factors, by log of the files, by lines and by depth."""
    clip = lambda c, a, b: F.least(F.greatest(c, F.lit(a)), F.lit(b))
    return (clip(F.log10(F.greatest(files, F.lit(1)).cast("double")) / 2, 0.5, 2.0) + clip(avg_lines / 50, 0.5, 2.0) + clip(depth / 5.0, 0.5, 2.0)) / 3


def adaptive_rounds(query_complexity: Column, repo_factor: Column, base: int = 4) -> Column:
    """Rounds of refinement: the base with more for hard queries, 2 to 6."""
    return F.least(F.greatest(F.floor(base * repo_factor * F.when(query_complexity >= 70, 1.2).when(query_complexity <= 30, 0.7).otherwise(1.0)), F.lit(2)), F.lit(6)).cast("int")


def edge_distance(weight: Column) -> Column:
    """How far apart linked nodes are."""
    return 1 / F.greatest(weight, F.lit(0.1))


def xref_confidence(weight: Column) -> Column:
    """How sure a link between clusters is."""
    return F.least(F.lit(1.0), weight / 4)


def cluster_importance(n: Column) -> Column:
    """By size (M09)."""
    return F.least(F.lit(1.0), 0.3 + n / 20)


# -- arrays, maps, JSON ---------------------------------------------------------
def content_digest(content: Column) -> Column:
    """md5 of a file's bytes."""
    return F.md5(content.cast("binary"))


def ordered_distinct(values: Column) -> Column:
    """Without repeats, in order of first mention."""
    return F.array_distinct(values)


def to_row_json(*columns: str) -> Column:
    """Columns as one JSON text; from_json with a schema reads it back (C05). Values of other kinds than JSON's
    become texts (C08)."""
    return F.to_json(F.struct(*columns))


def now() -> Column:
    """The time of the query, one for all rows."""
    return F.current_timestamp()


def sorted_set(values: Column) -> Column:
    """A set as a sorted array."""
    return F.array_sort(F.array_distinct(values))


def merged(a: Column, b: Column) -> Column:
    """Two maps as one; what the second has wins, without a session setting."""
    kept = F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_concat(kept, b))


def canonical_json(entries: Column) -> Column:
    """A map<string,string> as JSON in order of its keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)


def tolerant_json(text: str | None) -> str | None:
    """The first JSON object or array in a reply, as compact JSON: out of fences, comments and trailing
    commas removed, brackets closed; null if there is none (C07)."""
    if not text:
        return None
    candidates = [m.strip() for m in _FENCE.findall(text)] + [text]
    for c in candidates:
        start = min((i for i in (c.find("{"), c.find("[")) if i >= 0), default=-1)
        if start < 0:
            continue
        own, closers, quoted, escaped, out = c[start:], [], False, False, []
        for ch in own:
            out.append(ch)
            if quoted:
                quoted, escaped = (ch != '"' or escaped), ch == "\\" and not escaped
                continue
            if ch == '"':
                quoted = True
            elif ch in "{[":
                closers.append("}" if ch == "{" else "]")
            elif ch in "}]" and closers:
                closers.pop()
                if not closers:
                    break
        whole = "".join(out) + ('"' if quoted else "") + "".join(reversed(closers))
        for variant in (whole, re.sub(r",(\s*[}\]])", r"\1", re.sub(r"(?m)(?<![:\"'])//[^\n\"]*$|#[^\n\"]*$", "", whole))):
            try:
                return json.dumps(json.loads(variant, strict=False), separators=(",", ":"), sort_keys=True)
            except ValueError:
                continue
    return None


def tolerant_json_udf():
    """The Arrow-batched form of tolerant_json; try_parse_json does for clean text."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(tolerant_json)

    return run


# -- time -----------------------------------------------------------------------
def expires_at(stored: Column, seconds: int = 3600) -> Column:
    return stored + F.make_interval(secs=F.lit(seconds))


def is_fresh(stored: Column, now: Column, seconds: int) -> Column:
    """Whether something stored still counts: cache entries, the catalogue's scan."""
    return now < expires_at(stored, seconds)


def _field(spec: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in spec.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        first, last = (low, high) if a == "*" else (int(a), int(b or (high if step else a)))
        out |= set(range(first, last + 1, int(step or 1)))
    return out


def next_cron(expression: str, after: datetime, tz: str = "UTC") -> datetime | None:
    """The first minute after the given time that a five-field expression names, in its own time zone."""
    minutes, hours, days, months, weekdays = expression.split()
    allowed = _field(minutes, 0, 59), _field(hours, 0, 23), _field(days, 1, 31), _field(months, 1, 12), {d % 7 for d in _field(weekdays, 0, 7)}
    at = after.astimezone(ZoneInfo(tz)).replace(second=0, microsecond=0) + timedelta(minutes=1)
    for _ in range(366 * 5):
        if at.month in allowed[3]:
            by_day, by_weekday = at.day in allowed[2], (at.weekday() + 1) % 7 in allowed[4]
            if (by_day or by_weekday) if days != "*" and weekdays != "*" else (by_day and by_weekday):
                for hour in sorted(h for h in allowed[1] if h >= at.hour):
                    for minute in sorted(m for m in allowed[0] if hour > at.hour or m >= at.minute):
                        return at.replace(hour=hour, minute=minute)
        at = (at + timedelta(days=1)).replace(hour=0, minute=0)
    return None


def next_run_ms(kind: Column, at_ms: Column, every_ms: Column, expr: Column, tz: Column, now_ms: Column) -> Column:
    """When a job runs next: once at, every so often, or by cron; null if never."""

    @F.pandas_udf("bigint")
    def cron(expr: pd.Series, tz: pd.Series, now: pd.Series) -> pd.Series:
        from datetime import UTC

        def one(e, z, n):
            if not e:
                return None
            found = next_cron(e, datetime.fromtimestamp(n / 1000, UTC), z or "UTC")
            return None if found is None else int(found.timestamp() * 1000)

        return pd.Series([one(*x) for x in zip(expr, tz, now, strict=True)], dtype="Int64")

    return F.when(kind == "at", F.when(at_ms > now_ms, at_ms)).when(kind == "every", F.when(every_ms > 0, now_ms + every_ms)).when(kind == "cron", cron(F.when(kind == "cron", expr), tz, now_ms))
