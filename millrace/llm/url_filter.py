"""URL filters: rules by host and path, and a weighted vocabulary for the rest.

An Aho-Corasick automaton finds every term of the vocabulary in one pass over
the URL. A hit counts if no letter or digit touches it on either side. Strict
terms weigh as much as the limit, soft terms less, each once: one strict term
or several distinct soft ones reject a URL.

Edge cases: a null URL or one without "://" has an empty host and path and no
rule; it is judged by its terms alone (null: allowed). Repeated rows are judged
alike; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, ascii_lower_col, small_batches, with_columns_of

#: Fixed vocabulary: terms that reject on their own, and terms of which two distinct ones do.
STRICT = ("casino", "gambling", "porn", "xxx", "sex", "escort", "viagra", "cialis", "warez", "malware", "phishing", "spam")
SOFT = ("adult", "ads", "track", "bet", "bets", "betting", "bonus", "cheap", "click", "crack", "dating", "deal", "deals", "farm", "free", "jackpot", "loan", "loans", "lottery", "nude", "pill", "pills", "poker", "promo", "slots", "win", "x")
#: Two distinct soft hits weigh as much as a strict one.
STRICT_WEIGHT, SOFT_WEIGHT, LIMIT = 2, 1, 2


class Vocabulary:
    """Terms in lower case with their weights, as an automaton that is built in each worker."""

    def __init__(self, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT):
        self.weights = dict.fromkeys(map(ascii_lower, soft), SOFT_WEIGHT) | dict.fromkeys(map(ascii_lower, strict), STRICT_WEIGHT)
        self._automaton = None

    def __getstate__(self):
        return {"weights": self.weights, "_automaton": None}

    def hits(self, url: str | None) -> set[str]:
        """The distinct terms that stand alone in url."""
        if not url or not self.weights:
            return set()
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for term in self.weights:
                self._automaton.add_word(term, term)
            self._automaton.make_automaton()
        text, found = ascii_lower(url), set()
        for last, term in self._automaton.iter(text):
            first = last - len(term) + 1
            if not (first and _joins(text[first - 1])) and not (last + 1 < len(text) and _joins(text[last + 1])):
                found.add(term)
        return found


def _joins(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def url_terms(pages: DataFrame, vocabulary: Vocabulary | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, url, strict_hits, soft_hits (distinct terms) and weight of each row. No shuffle."""
    small_batches(pages.sparkSession, rows=8192)
    rows = with_columns_of(pages, id_col, url_col)
    kind = rows.schema[id_col].dataType.simpleString()
    terms = vocabulary or Vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [[terms.weights[t] for t in terms.hits(url)] for url in batch.column(1).to_pylist()]
            strict = [sum(w >= LIMIT for w in x) for x in weights]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), url_col: batch.column(1), "strict_hits": pa.array(strict, pa.int32()), "soft_hits": pa.array([len(x) - s for x, s in zip(weights, strict, strict=True)], pa.int32()), "weight": pa.array(map(sum, weights), pa.int32())})

    return rows.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, strict_hits int, soft_hits int, weight int")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(ascii_lower_col(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict. rules: (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # a longer rule goes over a shorter one
        own_host, slash, rest = text.partition("/")
        fits = ((host == own_host) | host.endswith(f".{own_host}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = (), vocabulary: Vocabulary | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict (allow or block), strict_hits, soft_hits."""
    found = url_terms(pages, vocabulary, id_col, url_col)
    found = found.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("weight") >= LIMIT, F.lit("block")).otherwise(F.lit("allow"))
    return found.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "strict_hits", "soft_hits")
