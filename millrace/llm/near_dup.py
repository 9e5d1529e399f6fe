"""n-gram Jaccard join by universe partition and the pigeonhole principle, exactly.

Two sets of sizes r and s with Jaccard >= 0.8 differ in at most (r + s) / 9
shingles. Sizes fall into bands; each band hashes the universe of shingles into
segments. Sets that differ in H places agree on all but H of the segments, so
each set need only index its H + 1 cheapest ones, in an order of the segments'
contents that is the same for all sets: cheapest are contents with a shingle
that few documents have (by counts over all documents), empty segments come
last. In bands where that is cheaper, some segments are indexed with their
one-deletion neighbourhood (the content and the content without each one of its
shingles): it finds sets that differ there in one place, so that it stands for
two segments. A set whose cheap segments don't suffice is indexed under a second
hashing as well, and so on; empty contents are indexed under the last only.

Candidates become links only if the shingles themselves, words compared, have
100 * intersection >= 80 * union. Before their texts are fetched, sketches as wide as the sets leave out
what can't reach that. Equal sets are one class from the start: found by fingerprints, and compared by
words as well, or by SHA-256 of all words in order. Within
an index entry every member is compared with the most central one; then members of one
entry that are still in different components are compared with each other. That
leaves out only pairs whose components are one already, so components are exact.

Edge cases: null texts and texts without words have no shingles and link with
nothing; fewer than five words are one shingle; rows without an id have no
component; the texts of a repeated id are nodes of their own, and each of its rows has
the component of its own text; repeated rows are one node; very long texts are read
whole; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower_col, materialize, shared_dir, small_batches, with_columns_of, worker_cache
from .shingles import Shingler, components, exact_shingles, mixed

#: Counters of shingles, by hash; those HOT times over the mean mark shingles that many documents have.
#: A task reports only what stands out in it; the order that they give needn't be exact, only the same for all.
COUNTERS, HOT = 1 << 20, 4
#: 64-bit words of a sketch; sets of more shingles than bits have a wide one besides, of a bit or more for each shingle.
SKETCH = 8
#: Hashings that a set tries before it indexes empty segments.
HASHINGS = 4
#: Ids are broadcast up to this many, else joined by shuffle.
BROADCAST_IDS = 200_000
#: Partners of a text that one task verifies at most, on average.
PARTNERS = 64
_SPARE = 0.3


def most_different(r: int, s: int) -> int:
    """How many shingles sets of these sizes may differ in at Jaccard 0.8."""
    return (r + s) // 9


def band_of(n: int) -> int:
    """Bands 1-2, 3-6, 7-14, ...: a partner of a set is in its band or the next on either side."""
    return (n + 1).bit_length() - 2


def band_ends(band: int) -> tuple[int, int]:
    low = (1 << band + 1) - 1
    return low, 2 * low


@lru_cache(maxsize=None)
def layout(band: int) -> tuple[int, int]:
    """Exact segments and neighbourhood segments of a band: the cheapest allocation of the credits it needs."""
    low, high = band_ends(band)
    need = most_different(high, high * 5 // 4) + 1
    if need == 1:
        return 1, 0
    best = None
    for q in range(min(3, need // 2) + 1):
        exact = need - 2 * q
        exact += math.ceil(_SPARE * exact) if exact > 1 else 0
        slots, n = exact + 2 * q, math.sqrt(low * high)
        own = max(0, most_different(round(n), round(1.25 * n)) + 1 - 2 * q)
        empty = exact * (1 - 1 / slots) ** n if slots > 1 else 0
        short = max(0.0, own + empty + 2 * math.sqrt(empty) - exact)  # empty segments that may have to be indexed
        cost = own + q * (1 + 2 * n / slots) + 8 * short
        if best is None or cost < best[0]:
            best = cost, exact, q
    return best[1], best[2]


def band_keys(x: np.ndarray, levels: np.ndarray, band: int, credits: int) -> list[np.ndarray]:
    """Index entries of a set of shingle hashes in a band, so that one is shared with every set that differs in fewer than credits."""
    exact, near = layout(band)
    slots, out = exact + 2 * near, []
    for hashing in range(HASHINGS):
        seed = 64 * hashing + band
        slot = (mixed(x, 2 * seed + 1) % np.uint64(slots)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        slot, y, own = slot[order], mixed(x, 2 * seed + 2)[order], levels[order]
        slot = np.where(slot < exact, slot, exact + (slot - exact) // 2)
        begin = np.flatnonzero(np.diff(slot, prepend=-1))
        sums, at = np.add.reduceat(y, begin), slot[begin]
        left = credits
        if near:
            sizes = np.diff(begin, append=len(y))
            for i in np.flatnonzero(at >= exact):
                part = y[begin[i] : begin[i] + sizes[i]]
                kept = np.append(sums[i], sums[i] - part) if sizes[i] > 1 else sums[i : i + 1]
                out.append(mixed(kept + np.uint64(int(at[i]) + 1) * np.uint64(0xD6E8FEB86659FD93), seed))
                left -= 2 * (sizes[i] > 1)
        plain = at < exact
        keys = mixed(sums[plain] + (at[plain] + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F), seed)
        cheap = np.lexsort((keys, np.minimum.reduceat(own, begin)[plain]))
        out.append(keys[cheap[: max(0, left)]])
        short = left - len(keys)
        if short <= 0:
            return out
        if hashing == HASHINGS - 1:
            missing = np.setdiff1d(np.arange(exact), at[plain]).astype(np.uint64)
            out.append(np.sort(mixed((missing + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB), seed))[:short])
    return out


def index_keys(x: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """All index entries of a set: in its own band, and in the band below if it can have partners there."""
    n = len(x)
    if not n:
        return np.empty(0, np.uint64)
    band = band_of(n)
    with np.errstate(over="ignore"):
        out = band_keys(x, levels, band, most_different(n, n * 5 // 4) + 1)
        if band and -(-4 * n // 5) <= (high := band_ends(band - 1)[1]):
            out += band_keys(x, levels, band - 1, most_different(n, high) + 1)
    return np.unique(np.concatenate(out))


def parity_sketch(x: np.ndarray) -> np.ndarray:
    """Parities of how many shingles fall on each bit, as SKETCH words: the sketches of two sets differ in no
    more bits than the sets in shingles."""
    bits = np.bincount((mixed(x, 999) & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(bool), bitorder="little").view(np.int64)


def wide_sketch(x: np.ndarray) -> bytes | None:
    """Parities as in parity_sketch(), in the least doubling of its bits that isn't below the number of shingles; null if that is none."""
    bits = 64 * SKETCH << max(0, (max(len(x), 1) - 1) // (64 * SKETCH)).bit_length()
    if bits == 64 * SKETCH:
        return None
    counts = np.bincount((mixed(x, 999) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(counts.astype(bool), bitorder="little").tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """In how many bits wide sketches differ; the wider one is folded to the other's width."""
    sizes, p, q = [len(x), len(y)], int.from_bytes(x, "little"), int.from_bytes(y, "little")
    if sizes[0] < sizes[1]:
        sizes, p, q = sizes[::-1], q, p
    while sizes[0] > sizes[1]:
        sizes[0] //= 2
        p = p >> 8 * sizes[0] ^ p & (1 << 8 * sizes[0]) - 1
    return (p ^ q).bit_count()


def _profile(docs: DataFrame) -> DataFrame:
    """docs: id, text, print. Per document: bucket null, id, print, n, a fingerprint of its set and its sketches; per task: bucket and how many shingles fell there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = worker_cache(("shingler",), Shingler)
        counters = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            sets = [shingler.distinct(t) for t in batch.column(1).to_pylist()]
            n = len(sets)
            every = np.concatenate(sets) if n else np.empty(0, np.uint64)
            counters += np.bincount((every & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            ends = np.cumsum([len(x) for x in sets])
            prints = []
            for seed in (1001, 1002):
                with np.errstate(over="ignore"):
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(every, seed), dtype=np.uint64)))[np.concatenate(([0], ends)).astype(np.int64)]
                    prints.append(np.diff(sums).view(np.int64))
            yield pa.RecordBatch.from_pydict({"bucket": pa.nulls(n, pa.int32()), "doc_id": batch.column(0), "print": batch.column(2), "n": pa.array(map(len, sets), pa.int64()), "print_a": pa.array(prints[0]), "print_b": pa.array(prints[1]), "sketch": pa.array(list(map(parity_sketch, sets)), pa.list_(pa.int64())), "wide": pa.array(list(map(wide_sketch, sets)), pa.binary())})
        full = np.flatnonzero(counters > 8 + HOT * counters.mean())
        if len(full):
            none = pa.nulls(len(full), pa.int64())
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "doc_id": none, "print": none, "n": pa.array(counters[full]), "print_a": none, "print_b": none, "sketch": pa.nulls(len(full), pa.list_(pa.int64())), "wide": pa.nulls(len(full), pa.binary())})

    return docs.mapInArrow(run, "bucket int, doc_id bigint, print bigint, n bigint, print_a bigint, print_b bigint, sketch array<bigint>, wide binary")


def _hot(profile: DataFrame) -> dict[int, int]:
    """Level by counter, of at most COUNTERS / HOT counters."""
    total = profile.where("bucket is null").agg(F.sum("n")).first()[0] or 0
    sums = profile.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = sums.where(F.col("n") > 8 + HOT * total / COUNTERS).collect()
    return {r.bucket: int(r.n).bit_length() for r in rows}


def _keys(docs: DataFrame, hot: dict[int, int]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        shingler = worker_cache(("shingler",), Shingler)
        levels = np.zeros(COUNTERS, np.int16)
        for bucket, level in sent.value.items():
            levels[bucket] = level
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = shingler.distinct(text)
                if doc_id is not None and len(x):
                    keys.append(index_keys(x, levels[(x & np.uint64(COUNTERS - 1)).astype(np.int64)]))
                    ids.append(np.full(len(keys[-1]), doc_id, np.int64))
            if ids:
                yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(keys).view(np.int64)), "id": pa.array(np.concatenate(ids))})

    return docs.mapInArrow(run, "key bigint, id bigint")


def few_or_shuffled(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """ids, to be broadcast if they are counted to be at most so many."""
    return F.broadcast(ids) if ids.count() <= most else ids


def with_nodes(rows: DataFrame, prints: DataFrame, id_col: str, folder: str) -> tuple[DataFrame, DataFrame, int]:
    """rows (id_col, text) and prints (id_col, print: xxhash64 of the text, ...) with a column node: the id, or a hash of
    id and print where an id stands with several texts, so that each text is a node of its own; and how many such ids
    there are."""
    several = prints.groupBy(id_col).agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low < high")
    several = materialize(several.select(id_col, F.lit(True).alias("several")), folder)
    n = several.count()
    if not n:
        return rows.withColumn("node", F.col(id_col)), prints.withColumn("node", F.col(id_col)), 0
    marks = F.broadcast(several) if n <= BROADCAST_IDS else several
    node = lambda p: F.when(F.col("several"), F.xxhash64(F.col(id_col), p)).otherwise(F.col(id_col))
    rows, prints = (x.join(marks, id_col, "left").withColumn("node", node(p)).drop("several") for x, p in ((rows, F.xxhash64("text")), (prints, F.col("print"))))
    return rows, prints, n


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with text_a and text_b, from texts (id, text). Texts with many partners go to several tasks, each
    with some of them, and the pairs of one text stand together in each."""
    hot = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts")).where("parts > 1")
    hot = few_or_shuffled(hot.select(F.col("a").alias("__hot"), "parts"))
    part = F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0)).alias("part")
    left = pairs.join(hot, F.col("a") == F.col("__hot"), "left").select(*pairs.columns, part)
    firsts = few_or_shuffled(pairs.select(F.col("a").alias("id")).distinct())
    dealt = texts.join(firsts, "id", "left_semi").join(hot, F.col("id") == F.col("__hot"), "left").select(F.col("id").alias("a"), F.col("text").alias("text_a"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    return left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(dealt, ["a", "part"])


def verify(pairs: DataFrame, texts: DataFrame, least: int = 80) -> DataFrame:
    """The pairs (a, b) whose texts (id, text) link, by their words: least is the percentage of shingles in common. Each
    pair's texts travel to it by two joins."""
    joined = with_texts(pairs, texts).select("a", "b", "text_a", "text_b")

    def run(batches):
        at, left = None, set()
        for batch in batches:
            a, b, text_a, text_b = (c.to_pylist() for c in batch.columns)
            linked = []
            for i in range(len(a)):
                if a[i] != at:
                    at, left = a[i], exact_shingles(text_a[i])
                right = exact_shingles(text_b[i])
                both = len(left & right)
                linked.append(bool(both) and 100 * both >= least * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_pydict({"a": batch.column(0), "b": batch.column(1)}).filter(pa.array(linked, pa.bool_()))

    return joined.mapInArrow(run, "a bigint, b bigint")


def _texts(rows: DataFrame, pairs: DataFrame, value: Column | str = "text") -> DataFrame:
    """id and text, or what is made of it, of the documents that the pairs name."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    return rows.join(few_or_shuffled(ids), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), value).dropDuplicates(["id"])


def _similar_enough(left: str, right: str):
    """Whether sizes and sketches, columns n and sketch of both sides, allow the similarity."""
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    bits = [F.bit_count(F.col(f"{left}.sketch")[i].bitwiseXOR(F.col(f"{right}.sketch")[i])) for i in range(SKETCH)]
    return (F.least(n, m) * 100 >= F.greatest(n, m) * 80) & (sum(bits[1:], bits[0]) <= F.floor((n + m) / 9))


def _plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the similarity; their texts needn't be fetched otherwise."""
    x = pairs.join(sketches.alias("l"), F.col("a") == F.col("l.id")).select("a", "b", F.struct("l.n", "l.sketch").alias("l"))
    return x.join(sketches.alias("r"), (F.col("b") == F.col("r.id")) & _similar_enough("l", "r")).select("a", "b")


def _closer(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose wide sketches, if both have one, allow the similarity: long texts, the narrow ones of which are full."""
    wide = sketches.where("wide is not null")
    end = lambda c: wide.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}"))
    joined = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left").select("a", "b", "n_a", "n_b", "wide_a", "wide_b")

    def run(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)
            near = [x is None or y is None or bits_apart(x, y) <= most_different(n, m) for n, m, x, y in rows]
            yield pa.RecordBatch.from_pydict({"a": batch.column(0), "b": batch.column(1)}).filter(pa.array(near, pa.bool_()))

    return joined.mapInArrow(run, "a bigint, b bigint")


def _copies(equal: DataFrame, texts: DataFrame, folder: str) -> DataFrame:
    """The pairs (a, b) of equal whose sets are equal: by digests of their words, and by the words where these differ."""
    digest = F.sha2(F.trim(F.regexp_replace(ascii_lower_col("text"), f"[{SPACE}]+", " ")).cast("binary"), 256)
    digests = materialize(_texts(texts, equal, digest.alias("digest")), f"{folder}/digests")
    end = lambda c: digests.select(F.col("id").alias(c), F.col("digest").alias(f"of_{c}"))
    compared = equal.join(end("a"), "a").join(end("b"), "b").select("a", "b", (F.col("of_a") == F.col("of_b")).alias("same"))
    compared = materialize(compared, f"{folder}/compared")
    rest = compared.where("not same").select("a", "b")
    return compared.where("same").select("a", "b").union(verify(rest, _texts(texts, rest), 100))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest id reachable by links), class_id (the smallest
    id with an equal set), print (xxhash64 of the text), kept (whether the text is the one that stands for its component).

    Shuffles: a record per document; the index, (key, id) per entry, about a third of the number of shingles;
    and texts of documents that share an entry and whose sketches allow the similarity, to verify them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_dir(spark)
    rows = with_columns_of(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    profile = materialize(_profile(rows.withColumn("print", F.xxhash64("text"))), f"{folder}/profile")
    hot = _hot(profile)
    # from here on each text is a node: its id, or a hash where an id stands with several texts
    rows, sets, several = with_nodes(rows, profile.where("bucket is null").drop("bucket"), "doc_id", f"{folder}/several")
    filled = sets.where("n > 0 and doc_id is not null")
    classes = filled.groupBy("print_a", "print_b", "n").agg(F.min("node").alias("id"), F.max("node").alias("most")).where("id < most").drop("most")
    equal = materialize(filled.join(classes, ["print_a", "print_b", "n"]).where("node <> id").select(F.col("id").alias("a"), F.col("node").alias("b")).distinct(), f"{folder}/equal")
    texts = rows.select(F.col("node").alias("doc_id"), "text")
    copies = materialize(_copies(equal, texts, folder), f"{folder}/copies")
    single = texts.join(few_or_shuffled(copies.select(F.col("b").alias("doc_id"))), "doc_id", "left_anti")

    same = Window.partitionBy("key")
    index = _keys(single, hot).withColumn("members", F.count(F.lit(1)).over(same))
    groups = materialize(index.where("members > 1"), f"{folder}/groups")
    ids = materialize(groups.groupBy("id").agg(F.sum("members").alias("central")), f"{folder}/ids")
    held = sets.where("n > 0").select(F.col("node").alias("id"), "n", "sketch", "wide").join(few_or_shuffled(ids.select("id")), "id", "left_semi")
    sketches = materialize(held.dropDuplicates(["id"]), f"{folder}/sketches")

    # the first of an entry: the member with the most company over all its entries, such as the text that others are edits of
    groups = groups.join(ids, "id").withColumn("first", -F.max(F.struct("central", -F.col("id"))).over(same)["col2"])
    groups = materialize(groups.select("key", "id", "first"), f"{folder}/starred")
    stars = groups.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    stars = materialize(_closer(_plausible(stars, sketches), sketches), f"{folder}/plausible-stars")
    linked = materialize(verify(stars, _texts(texts, stars)), f"{folder}/stars")
    parts = materialize(components(linked, f"{folder}/first"), f"{folder}/parts")

    apart = groups.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = apart.withColumn("low", F.min("component").over(same)).withColumn("high", F.max("component").over(same)).where("low < high and id <> first")
    apart = materialize(apart.join(sketches, "id").select("key", "id", "component", "n", "sketch"), f"{folder}/apart")
    ordered = (F.col("l.key") == F.col("r.key")) & (F.col("l.id") < F.col("r.id")) & (F.col("l.component") != F.col("r.component"))
    cross = apart.alias("l").join(apart.alias("r"), ordered & _similar_enough("l", "r"))
    cross = cross.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    cross = materialize(_closer(cross, sketches), f"{folder}/cross")
    more = materialize(verify(cross, _texts(texts, cross)), f"{folder}/more")
    if not more.isEmpty():
        links = parts.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more)
        parts = materialize(components(links, f"{folder}/second"), f"{folder}/all")

    wide = sets.select("doc_id", "node", "print", "n").join(copies.withColumnsRenamed({"b": "node", "a": "class"}), "node", "left").withColumn("class", F.coalesce("class", "node"))
    wide = wide.join(parts.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    wide = wide.withColumn("kept", F.col("node").eqNullSafe(F.col("component")))
    if several:  # nodes aren't ids: the smallest id of each component and class, and one node of that id
        first = wide.groupBy("component").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "node"))["node"].alias("first"))
        same = wide.groupBy("class").agg(F.min("doc_id").alias("least_class"))
        wide = wide.join(first, "component", "left").join(same, "class", "left").withColumn("kept", F.col("node").eqNullSafe(F.col("first")))
        wide = wide.withColumn("component", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))).withColumn("class", F.when(F.col("n") > 0, F.col("least_class")).otherwise(F.col("doc_id")))
    kept = F.col("kept") | (F.col("n") == 0) | F.col("doc_id").isNull()
    return wide.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("class").alias("class_id"), "print", kept.alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the texts that near_duplicates() doesn't keep: one text of each component stays, that of the smallest
    id. Rows without id, text or words all stay, and so do repeated rows of the text that stays."""
    names = ["__id", "__print"]
    drop = near_duplicates(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias(names[0]), F.col("print").alias(names[1])).distinct()
    drop = few_or_shuffled(materialize(drop, f"{shared_dir(docs.sparkSession)}/drop"))
    return docs.join(drop, (docs[id_col] == drop[names[0]]) & (F.xxhash64(docs[text_col]) == drop[names[1]]), "left_anti")
