"""Rolling window features per source: counts, sums, languages and order statistics of text lengths.

A row's window of W seconds holds the rows of its source with time in
[its time - W, its time). Rows of one source and time have the same windows, so
features are made once per (source, time) and joined back.

A source's time line is cut into segments of half the widest window; a row goes to its own segment and to those
that its windows reach into (two more at most), so a source that holds a third of all rows is
spread over as many tasks as it has segments. Before that, rows that agree in
source, time, length and language are counted, in each task and then after the
shuffle: what a segment holds is bounded by its distinct values, not by its rows.

In a segment, each window is a Fenwick tree over the compressed lengths. Two
pointers add what enters and remove what leaves, and keep the number of rows,
the sum and one counter per language; a binary-lifting descent finds the value
of a rank.

Nothing that grows with the input meets in one task, is sent to the driver or broadcast.

Edge cases: a null source is a source; null lengths count as rows and their languages count,
but they have no length; a null time has empty windows and is in none; repeated rows count
each for itself; times may be negative; an id whose time doesn't fit a long has none; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir, with_columns_of

WINDOWS = (600, 43200)
#: Ranks are ceil(percent * m / 100), counted from 1.
MIDDLE, HIGH = 50, 90
_FEATURES = ("n_events", "sum_chars", "n_langs", "median_chars", "high_chars")


class Sliding:
    """The rows of a window over ranks of lengths: a Fenwick tree, their number and sum, and a counter per language."""

    def __init__(self, lengths: list[int], n_langs: int):
        self.lengths, self.size = lengths, len(lengths)
        self.tree = [0] * (self.size + 1)
        self.top = 1 << max(self.size.bit_length() - 1, 0)
        self.rows = self.measured = self.total = self.langs = 0
        self.by_lang = [0] * n_langs

    def add(self, rank: int, lang: int, n: int) -> None:
        """n rows of the length with that rank (-1: none) and that language (-1: none); they leave if n is negative."""
        self.rows += n
        if lang >= 0:
            before = self.by_lang[lang]
            self.by_lang[lang] = before + n
            self.langs += (before + n > 0) - (before > 0)
        if rank >= 0:
            self.measured += n
            self.total += n * self.lengths[rank]
            at, tree, size = rank + 1, self.tree, self.size
            while at <= size:
                tree[at] += n
                at += at & -at

    def ranked(self, k: int) -> int:
        """The k-th smallest length, from 1."""
        at, step, tree, size = 0, self.top, self.tree, self.size
        while step:
            there = at + step
            if there <= size and tree[there] < k:
                at = there
                k -= tree[there]
            step >>= 1
        return self.lengths[at]

    def features(self) -> tuple:
        m = self.measured
        middle, high = ((self.ranked(-(-p * m // 100)) for p in (MIDDLE, HIGH)) if m else (None, None))
        return self.rows, self.total, self.langs, middle, high


def sweep(times: np.ndarray, lengths: np.ndarray, langs: np.ndarray, counts: np.ndarray, asked: np.ndarray, windows=WINDOWS) -> list[list[tuple]]:
    """For each window, the features at each time of asked (ascending). Entries are sorted by time; -1: no length, no language."""
    values = np.unique(lengths[lengths >= 0])
    ranks = np.where(lengths >= 0, np.searchsorted(values, lengths), -1).tolist()
    n_langs = int(langs.max(initial=-1)) + 1
    language, number = langs.tolist(), counts.tolist()
    out = []
    for w in windows:
        state = Sliding(values.tolist(), n_langs)
        ends, starts = np.searchsorted(times, asked, "left").tolist(), np.searchsorted(times, asked - w, "left").tolist()
        found, left, right = [], starts[0] if starts else 0, starts[0] if starts else 0
        for start, end in zip(starts, ends, strict=True):
            if start >= right:  # nothing stays
                for i in range(left, right):
                    state.add(ranks[i], language[i], -number[i])
                left = right = start
            for i in range(right, end):
                state.add(ranks[i], language[i], number[i])
            for i in range(left, start):
                state.add(ranks[i], language[i], -number[i])
            left, right = start, end
            found.append(state.features())
        out.append(found)
    return out


def window_features(events: DataFrame, windows=WINDOWS) -> DataFrame:
    """source, event_s, features: an array with one struct (window_s, n_events, sum_chars, n_langs, median_chars, high_chars) per window,
    for each source and time of events (source, event_s, length, lang)."""
    windows = tuple(windows)
    widest = max(windows)
    segment = max(1, widest // 2)
    kind = dict(events.dtypes)["source"]
    slots = events.where("event_s is not null").groupBy("source", "event_s", "length", "lang").agg(F.count("*").alias("n"))
    cell = lambda t: F.expr(f"({t} - pmod({t}, {segment}L)) div {segment}L")
    dealt = slots.withColumn("segment", F.explode(F.sequence(cell("event_s"), cell(f"(event_s + {widest}L)"))))
    item = pa.struct([("window_s", pa.int64()), *((name, pa.int64()) for name in _FEATURES)])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("event_s")
        times = group.column("event_s").to_numpy()
        asked = np.unique(times[times // segment == group.column("segment")[0].as_py()])
        lengths = group.column("length").fill_null(-1).to_numpy()
        langs = group.column("lang").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        made = sweep(times, lengths, langs, group.column("n").to_numpy(), asked, windows)
        flat = [pa.array([made[w][i][f] for i in range(len(asked)) for w in range(len(windows))], pa.int64()) for f in range(len(_FEATURES))]
        structs = pa.StructArray.from_arrays([pa.array(list(windows) * len(asked), pa.int64()), *flat], fields=list(item))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(asked) + 1) * len(windows), pa.int32()), structs)
        source = group.column("source").take(pa.array(np.zeros(len(asked), np.int64)))
        return pa.table({"source": source, "event_s": pa.array(asked, pa.int64()), "features": lists})

    inner = ", ".join(f"{name}: bigint" for name in ("window_s", *_FEATURES))
    return dealt.groupBy("source", "segment").applyInArrow(run, f"source {kind}, event_s bigint, features array<struct<{inner}>>")


def roll(events: DataFrame, windows=WINDOWS) -> DataFrame:
    """doc_id, window_s, event_s and the features: one row per window for each row of events (doc_id, source, event_s, length, lang)."""
    kept = materialize(with_columns_of(events, "doc_id", "source", "event_s", "length", "lang"), f"{shared_dir(events.sparkSession)}/events")
    found = window_features(kept.drop("doc_id"), windows).select(F.col("source").alias("of"), F.col("event_s").alias("at"), "features")
    rows = kept.select("doc_id", "source", "event_s").join(found, F.col("source").eqNullSafe(F.col("of")) & (F.col("event_s") == F.col("at")), "left")
    none = F.array(*[F.struct(F.lit(w).cast("bigint").alias("window_s"), *(F.lit(0 if i < 3 else None).cast("bigint").alias(n) for i, n in enumerate(_FEATURES))) for w in windows])
    rows = rows.select("doc_id", "event_s", F.explode(F.coalesce("features", none)).alias("f"))
    return rows.select("doc_id", "f.window_s", "event_s", *(f"f.{n}" for n in _FEATURES))


def event_time(doc_id: Column) -> Column:
    """60 * floor((doc_id + (crc32 of doc_id in decimal, mod 10000)) / 6), exactly; null where it doesn't fit."""
    at = F.try_add(doc_id, F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10_000)))
    made = F.try_multiply(F.lit(60), F.call_function("div", at - F.pmod(at, F.lit(6)), F.lit(6)))
    return F.when(F.abs(made) < 1 << 62, made)


def document_events(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """doc_id, source, event_s, length (code points), lang of documents."""
    rows = with_columns_of(docs, id_col, text_col, source_col, lang_col)
    return rows.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), event_time(F.col(id_col).cast("bigint")).alias("event_s"), F.char_length(text_col).cast("bigint").alias("length"), F.col(lang_col).alias("lang"))
