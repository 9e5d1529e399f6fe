"""Document fingerprints: digests of improbable byte windows in chained Bloom filters.

Every byte window of WINDOW bytes has an entropy, kept as a sum that changes by table lookups as the window
slides. A window's rank says how probable its entropy is: the rarer, the lower. In each run of SPAN
neighbouring windows the leftmost of lowest rank gets a point; windows with LEAST points or more are the
features of the text. Features, in order and each once, are inserted into a chain of Bloom filters of BITS
bits, FEATURES to a filter. Two filters are compared by the bits that they share, less what chance gives,
over the most that they could share; a chain's likeness to another is the mean of each filter's best match,
weighed by its features, and the likeness of two fingerprints is the smaller of both directions.

A fingerprint is a function of the text's bytes alone: it doesn't change with the corpus, its order or its
partitions. Ranks go by a fixed rule over the entropies of prose; `fit_ranks` counts them over all of a corpus
instead, and what it returns can be given to every function here.

Short texts have few windows of WINDOW bytes, so a text below SHORT_BYTES has a chain of windows of SHORT_WINDOW bytes
besides, and two texts that both have one are compared by it.

Neighbours: `edited` compares each document with its own edited text and with the document after it. Ids and
sizes alone are sorted by ranges and summed, which cuts the ids into buckets of about the same bytes; each text is then shuffled once, to
its bucket, the first of each bucket to the one before as well, and each task streams over its sorted texts. What
the driver gets is the first id of each bucket, MAX_BUCKETS at most.

Edge cases: a null text is empty; texts without any window of SHORT_WINDOW bytes insert the whole text as one feature, an
empty text none; texts without a feature that has LEAST points (runs of one pattern) take those with the most; equal
fingerprints have likeness 1, a text without features has 0 with any other; null ids
come first; texts that share an id are ordered by a hash of the text, and rows that agree in id and text are one
document, whose result each of them gets; a single document follows itself; extra columns are left
out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import materialize, shared_dir, small_batches, with_columns_of

WINDOW, SHORT_WINDOW, SHORT_BYTES = 32, 8, 256
SPAN, LEAST = 32, 8
SHORT_SPAN, SHORT_LEAST = 4, 1
FEATURES, BITS, PROBES = 160, 2048, 5
#: Entropies are kept in thousandths of the most a window can have. Prose has most windows near USUAL; below LOW are runs and tables.
LEVELS, USUAL, LOW = 1000, 710, 200
#: Bytes of one text that are worked on at once, and of several.
PIECE, BATCH = 1 << 19, 96 << 10
#: A bucket has about BUCKET_BYTES of text, more if there would be more than MAX_BUCKETS.
BUCKET_BYTES, LEAST_BUCKET, MAX_BUCKETS = 64 << 20, 256 << 10, 20_000
_UNIT = 1 << 12
_ODD = np.uint64(0x9E3779B97F4A7C15)


def default_ranks() -> np.ndarray:
    """Rank of each entropy level by rule: the further from USUAL, the rarer; levels below LOW aren't text and come last."""
    levels = np.arange(LEVELS + 1)
    return np.where(levels < LOW, LEVELS + 1 + LOW - levels, LEVELS - np.abs(levels - USUAL)).astype(np.int64)


def _steps(width: int) -> tuple[np.ndarray, int]:
    """What the c-th equal byte adds to the sum of c * log2(c), in units; and the sum's greatest value."""
    c = np.arange(1, width + 1)
    sums = np.concatenate(([0], np.rint(c * np.log2(c) * _UNIT).astype(np.int64)))
    return np.concatenate(([0], np.diff(sums))), int(sums[-1])


_STEPS = {w: _steps(w) for w in (WINDOW, SHORT_WINDOW)}


def entropy_levels(data: np.ndarray, width: int) -> np.ndarray:
    """The entropy of each window of `width` bytes, from 0 (one byte repeated) to LEVELS (all bytes differ)."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.int64)
    ahead, behind = np.ones(n, np.uint8), np.ones(n, np.uint8)  # equal bytes among the next and the last `width`, itself included
    for d in range(1, width):
        same = (data[d:] == data[:-d]).view(np.uint8)
        ahead[: n - d] += same
        behind[d:] += same
    step, most = _STEPS[width]
    first = int(step[[np.count_nonzero(data[i:width] == data[i]) for i in range(width)]].sum())
    sums = np.empty(n - width + 1, np.int64)
    sums[0] = first
    np.cumsum(step[behind[width:]] - step[ahead[: n - width]], out=sums[1:])
    sums[1:] += first
    return LEVELS - sums * LEVELS // most


def _points(ranks: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Points of each position: one for each run of `span` windows, of those at `starts`, whose leftmost lowest rank stands there."""
    low = (ranks << 32) | np.arange(len(ranks))
    done = 1
    while done < span:
        by = min(done, span - done)
        low = np.minimum(low[: len(low) - by], low[by:])
        done += by
    return np.bincount(low[starts] & 0xFFFFFFFF, minlength=len(ranks))


def _hashes(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the windows at the given positions."""
    words = np.lib.stride_tricks.sliding_window_view(data, width)[at].view("<u8")
    h = np.full(len(at), np.uint64(width))
    for j in range(words.shape[1]):
        h = (h ^ words[:, j]) * _ODD
        h ^= h >> np.uint64(29)
    h *= _ODD
    return h ^ (h >> np.uint64(32))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _batch_features(texts: list[bytes], width: int, span: int, least: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the features of texts, by text and order of first occurrence.

    The texts stand one after another in one buffer. A window that crosses into the next text ranks behind all others,
    and a run starts only where it holds a window of its text: span <= width keeps it from the text after the next.
    """
    n = np.array([len(t) for t in texts])
    offsets = np.cumsum(n) - n
    own = np.maximum(n - width + 1, 0)
    data = np.frombuffer(b"".join(texts) + bytes(width + span), np.uint8)
    levels = entropy_levels(data, width)
    rank = np.full(len(levels), 1 << 20, np.int64)
    inside = _ranges(offsets, own)
    rank[inside] = ranks[levels[inside]]
    points = _points(rank, _ranges(offsets, np.where(own > 0, np.maximum(own - span, 0) + 1, 0)), span)
    at = np.flatnonzero(points >= least)
    found = np.searchsorted(offsets, at, "right") - 1
    more = [(offsets[i] + np.flatnonzero((p := points[offsets[i] : offsets[i] + own[i]]) == p.max()), i) for i in np.flatnonzero((own > 0) & (np.bincount(found, minlength=len(texts)) == 0))]
    at = np.concatenate([at, *(x for x, _ in more)])
    found = np.concatenate([found, *(np.full(len(x), i) for x, i in more)]).astype(np.intp)
    return _distinct(found, at, _hashes(data, at, width))


def _distinct(text: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """text and hash of each feature's first occurrence, by text and place."""
    order = np.lexsort((at, hashes, text))
    t, h = text[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    kept = order[new]
    kept = kept[np.lexsort((at[kept], text[kept]))]
    return text[kept], hashes[kept]


def _long_features(data: bytes, width: int, span: int, least: int, ranks: np.ndarray) -> np.ndarray:
    """The features of one text of any length, piece by piece; neighbouring pieces overlap by all that a position's points depend on."""
    whole = np.frombuffer(data, np.uint8)
    windows = len(whole) - width + 1
    kept: dict[int, list] = {0: []}
    for a in range(0, windows, PIECE):
        b = min(a + PIECE, windows)
        left, right = max(0, a - span + 1), min(windows, b + span - 1)
        rank = ranks[entropy_levels(whole[left : right + width - 1], width)]
        points = _points(rank, np.arange(len(rank) - span + 1), span)[a - left : b - left]
        # The best number of points below `least` is remembered as long as nothing has `least`.
        best = int(min(points.max(), least))
        if best >= max(kept):
            at = a + np.flatnonzero(points >= best)
            _, hashes = _distinct(np.zeros(len(at), np.intp), at, _hashes(whole, at, width))
            kept = {best: [*kept.get(best, []), hashes]}
    found = np.concatenate(kept[max(kept)])
    return _distinct(np.zeros(len(found), np.intp), np.arange(len(found)), found)[1]


def _features(texts: list[bytes], width: int, span: int, least: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _batch_features, with bounded buffers."""
    out, batch, first, held = [], [], 0, 0
    for i, data in enumerate(texts):
        if batch and held + len(data) > BATCH:
            out.append((first, _batch_features(batch, width, span, least, ranks)))
            batch, held = [], 0
        if len(data) > PIECE:
            hashes = _long_features(data, width, span, least, ranks)
            out.append((i, (np.zeros(len(hashes), np.intp), hashes)))
        else:
            first = first if batch else i
            batch.append(data)
            held += len(data)
    if batch:
        out.append((first, _batch_features(batch, width, span, least, ranks)))
    return np.concatenate([np.zeros(0, np.intp), *(t + at for at, (t, _) in out)]), np.concatenate([np.zeros(0, np.uint64), *(h for _, (_, h) in out)])


def _chains(text: np.ndarray, hashes: np.ndarray, n_texts: int) -> list[tuple[int, bytes]]:
    """The number of features of each text and its Bloom filters, one after another."""
    n = np.bincount(text, minlength=n_texts)
    first = np.cumsum(n) - n
    held = -(-n // FEATURES)
    base = np.cumsum(held) - held
    place = base[text] + (np.arange(len(text)) - first[text]) // FEATURES
    bits = np.zeros((int(held.sum()), BITS), np.uint8)
    for p in range(PROBES):
        bits[place, ((hashes >> np.uint64(11 * p)) % np.uint64(BITS)).astype(np.intp)] = 1
    packed = np.packbits(bits, axis=1).tobytes()
    size = BITS // 8
    return [(k, packed[b * size : (b + f) * size]) for k, b, f in zip(n.tolist(), base.tolist(), held.tolist(), strict=True)]


class Digest:
    """A text's chains: kind -> (number of features, filters). Kind s has short windows, kind w those of WINDOW bytes."""

    def __init__(self, chains: dict[str, tuple[int, bytes]]):
        self.chains = chains
        self._filters: dict[str, list[tuple[int, int, int]]] = {}

    @classmethod
    def parse(cls, written: str) -> Digest:
        parts = ((part[0], *part[1:].split(":")) for part in written.split("."))
        return cls({kind: (int(n), base64.b64decode(code)) for kind, n, code in parts})

    def __str__(self) -> str:
        return ".".join(f"{kind}{n}:{base64.b64encode(code).decode()}" for kind, (n, code) in self.chains.items())

    def filters(self, kind: str) -> list[tuple[int, int, int]]:
        """Bits, their number, and the number of features of each filter."""
        if kind not in self._filters:
            n, code = self.chains[kind]
            size = BITS // 8
            bits = [int.from_bytes(code[at : at + size]) for at in range(0, len(code), size)]
            self._filters[kind] = [(b, b.bit_count(), min(n - i * FEATURES, FEATURES)) for i, b in enumerate(bits)]
        return self._filters[kind]

    def likeness(self, other: Digest) -> float:
        """From 0 to 1; 1 for equal digests."""
        if self.chains == other.chains:
            return 1.0
        kind = "s" if "s" in self.chains and "s" in other.chains else "w"
        left, right = self.filters(kind), other.filters(kind)
        if not left or not right:
            return 0.0
        best_left, best_right = [0.0] * len(left), [0.0] * len(right)
        for i, (a, n_a, _) in enumerate(left):
            for j, (b, n_b, _) in enumerate(right):
                chance = n_a * n_b / BITS
                score = 1.0 if a == b else ((a & b).bit_count() - chance) / (max(n_a, n_b) - chance)
                best_left[i] = max(best_left[i], score)
                best_right[j] = max(best_right[j], score)
        mean = lambda best, of: sum(s * n for s, (_, _, n) in zip(best, of, strict=True)) / sum(n for _, _, n in of)
        return min(mean(best_left, left), mean(best_right, right))


def digests(texts: list[str | None], ranks: np.ndarray | None = None) -> list[Digest]:
    """The digest of each text."""
    data = [(t or "").encode() for t in texts]
    ranks = default_ranks() if ranks is None else ranks
    out: list[dict] = [{} for _ in data]
    few = [i for i, d in enumerate(data) if len(d) < SHORT_BYTES]
    if few:
        made = _chains(*_features([data[i] for i in few], SHORT_WINDOW, SHORT_SPAN, SHORT_LEAST, ranks), len(few))
        for i, chain in zip(few, made, strict=True):
            if not chain[0] and data[i]:
                whole = np.frombuffer(hashlib.sha256(data[i]).digest()[:8], "<u8")
                (chain,) = _chains(np.zeros(1, np.intp), whole, 1)
            out[i]["s"] = chain
    for i, chain in enumerate(_chains(*_features(data, WINDOW, SPAN, LEAST, ranks), len(data))):
        out[i]["w"] = chain
    return [Digest(x) for x in out]


def fingerprint(text: str | None, ranks: np.ndarray | None = None) -> str:
    """The digest of a text: chains joined by '.', each as its kind, its number of features and its filters in base64."""
    return str(digests([text], ranks)[0])


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, from 0 to 1."""
    return Digest.parse(a).likeness(Digest.parse(b))


def edit(text: str, following: str) -> str:
    """text with its last floor(n / 4) code points replaced by the first as many, or all, of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def fit_ranks(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Ranks by how often each entropy level occurs among all windows of all texts, rarest first. Each task counts its own
    texts; the driver gets one row per level."""
    small_batches(docs.sparkSession, rows=1024, mb=8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(LEVELS + 1, np.int64)
        for b in batches:
            for text in b.column(0):
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                for a in range(0, len(data) - WINDOW + 1, PIECE):
                    seen += np.bincount(entropy_levels(data[a : a + PIECE + WINDOW - 1], WINDOW), minlength=LEVELS + 1)
        yield pa.RecordBatch.from_pydict({"level": np.arange(LEVELS + 1, dtype=np.int32), "n": seen})

    counted = with_columns_of(docs, text_col).mapInArrow(run, "level int, n bigint").groupBy("level").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(LEVELS + 1, np.int64)
    for r in counted:
        n[r.level] = r.n
    ranks = np.empty(LEVELS + 1, np.int64)
    ranks[np.argsort(n, kind="stable")] = np.arange(LEVELS + 1)
    ranks[:LOW] += LEVELS + 1
    return ranks


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_chars, fingerprint of each row."""
    small_batches(docs.sparkSession, rows=1024, mb=8)
    ranks = default_ranks() if ranks is None else ranks
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(map(str, digests(texts, ranks)), pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return with_columns_of(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_chars bigint, fingerprint string")


def _key(doc_id, mark) -> tuple:
    return (doc_id is not None, doc_id if doc_id is not None else 0, mark)


def _bounds(keys: DataFrame, folder: str) -> list[tuple]:
    """The first key of each bucket, ascending, from keys (doc_id, mark, n, n_bytes)."""
    cores = keys.sparkSession.sparkContext.defaultParallelism
    ranged = materialize(keys.repartitionByRange(F.col("doc_id").asc_nulls_first(), "mark").withColumn("range", F.spark_partition_id()), f"{folder}/ranges")
    sums = ranged.groupBy("range").agg(F.sum("n_bytes").alias("bytes"))
    total = sums.agg(F.sum("bytes")).first()[0] or 0
    size = max(min(BUCKET_BYTES, max(LEAST_BUCKET, total // (16 * cores))), total // MAX_BUCKETS, 1)
    # One row per range meets here, as many as there are shuffle partitions.
    sums = sums.withColumn("ahead", F.coalesce(F.sum("bytes").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("upto", F.sum("n_bytes").over(within)).join(F.broadcast(sums.select("range", "ahead")), "range")
    bucket = F.floor((F.col("ahead") + F.col("upto") - F.col("n_bytes")) / F.lit(size))
    first = placed.groupBy(bucket.alias("bucket")).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "mark")).alias("first"))
    return sorted(_key(r.first.doc_id, r.first.mark) for r in first.withColumnRenamed("first", "first_key").select(F.col("first_key").alias("first")).collect())


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs."""
    spark = docs.sparkSession
    folder, kind = shared_dir(spark), dict(docs.dtypes)[id_col]
    small_batches(spark, rows=1024, mb=8)
    ranks = default_ranks() if ranks is None else ranks
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    sizes = rows.select("doc_id", "mark", (F.octet_length("text") + F.lit(64)).cast("bigint").alias("n_bytes"))
    keys = materialize(sizes.groupBy("doc_id", "mark").agg(F.count("*").alias("n"), F.first("n_bytes").alias("n_bytes")), f"{folder}/keys")
    repeated = keys.where("n > 1").select(F.col("doc_id").alias("of"), F.col("mark").alias("at"), "n")
    repeats = not repeated.isEmpty()
    if repeats:
        rows = rows.dropDuplicates(["doc_id", "mark"])
    bounds = _bounds(keys, folder)
    n_buckets = max(1, len(bounds))

    @F.arrow_udf(LongType())
    def placed(doc_id: pa.Array, mark: pa.Array) -> pa.Array:
        found = []
        for key in map(_key, doc_id.to_pylist(), mark.to_pylist()):
            b = bisect_right(bounds, key) - 1
            found.append(2 * b + (bounds[b] == key))
        return pa.array(found, pa.int64())

    at = F.floor(F.col("place") / 2).cast("int")
    own = F.struct(at.alias("bucket"), F.lit(0).alias("lead"))
    ahead = F.struct(F.pmod(at - 1, F.lit(n_buckets)).alias("bucket"), F.lit(1).alias("lead"))
    dealt = rows.withColumn("place", placed("doc_id", "mark"))
    dealt = dealt.select("doc_id", "mark", "text", F.explode(F.when(F.col("place") % 2 == 1, F.array(own, ahead)).otherwise(F.array(own))).alias("to")).select("to.*", "doc_id", "mark", "text")
    dealt = dealt.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "lead", F.col("doc_id").asc_nulls_first(), "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            leads, ids, marks, texts = (b.column(name).to_pylist() for name in ("lead", "doc_id", "mark", "text"))
            pairs = []
            for lead, *row in zip(leads, ids, marks, texts, digests(texts, ranks), strict=True):
                if last:
                    pairs.append((*last, edit(last[2], row[2]), row[3]))
                last = None if lead else row
            made = digests([p[4] for p in pairs], ranks)
            out = [(i, m, len(t), hashlib.sha256(e.encode()).hexdigest(), str(d), str(x), d.likeness(x), d.likeness(after)) for (i, m, t, d, e, after), x in zip(pairs, made, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _schema(b), strict=True)], names=_NAMES)

    result = dealt.mapInArrow(run, f"doc_id {kind}, mark bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    if repeats:
        result = result.join(repeated, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("at")), "left")
        result = result.withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1)).cast("int"))))
    return result.select("doc_id", *_NAMES[2:])


_NAMES = ["doc_id", "mark", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _schema(batch: pa.RecordBatch) -> list[pa.Field]:
    kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return [pa.field(n, k) for n, k in zip(_NAMES, kinds, strict=True)]
