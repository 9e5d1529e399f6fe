"""Vector code compression: product codes whose codebooks are trained by an RDD treeAggregate.

Vectors become integers (floor of SCALE times each component) and are packed,
column by column, into blocks: a row of the block table holds one contiguous
NumPy array per component. A part of a vector is coded by the index of the
nearest entry of that part's codebook. Distances of a block accumulate dimension
by dimension into one (rows, entries) matrix; `np.add.at` adds each row to int64
tensors of sums and counts, and the tensors of all tasks merge through a
reduction tree. What a round sends is one tensor of parts x entries x width per
task, whatever the number of vectors; what is broadcast is the codebook, of the
same fixed size.

All arithmetic is on integers, so reruns, partitions and lost executors change nothing.

Edge cases: vectors that are null or hold null or non-finite components take no
part; shorter vectors count as if zeros followed, up to the longest length rounded
up to a multiple of the parts; an empty vector is all zeros; components beyond
what keeps a distance within a long are cut to that (about 2**27 at 64
dimensions, 131,072 before scaling); null ids stand after all others and repeated
ids are rows of their own, ordered by their vectors; fewer rows than entries make
smaller codebooks; equal entries: the lower index; a label's error that exceeds a long is null;
extra columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose distances to all entries are held at once.
TILE = 1024
#: A label with more than one row in so many is joined by broadcast: there are fewer such labels than this.
HOT_SHARE = 1000
#: Levels of the reduction tree: with n tasks, the driver merges the last n ** (1 / DEPTH) tensors.
DEPTH = 3


@dataclass
class Codebooks:
    """entries[part, index, position], int64."""

    entries: np.ndarray

    def digest(self) -> str:
        """sha256 of all components by part, index, position, in decimal, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def vector(self, code: str) -> list[float]:
        """The vector that a code stands for, in the scale of the original components."""
        found = bytes.fromhex(code)
        return np.concatenate([self.entries[p, i] for p, i in enumerate(found)]).astype(float).__truediv__(SCALE).tolist() if found else []


def assign(columns: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """codes[part, row] and errors[row]: the nearest entry of each part of each row, and the squared distances' sum.

    columns[dimension, row] and entries are int64. Distances that fit a double's 53 bits are summed as doubles, which
    is exact and faster; others as int64.
    """
    parts, k, width = entries.shape
    n = columns.shape[1]
    widest = int(max(np.abs(columns).max(initial=0), np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * width * widest * widest < 1 << 53 else np.int64
    cols, books = columns.astype(kind, copy=False), entries.astype(kind, copy=False)
    codes, errors = np.empty((parts, n), np.intp), np.zeros(n, np.int64)
    far, step = np.empty((TILE, k), kind), np.empty((TILE, k), kind)
    for at in range(0, n, TILE):
        size = min(TILE, n - at)
        d, s = far[:size], step[:size]
        for p in range(parts):
            d.fill(0)
            for j in range(width):
                np.subtract(cols[p * width + j, at : at + size, None], books[p, :, j], out=s)
                np.multiply(s, s, out=s)
                np.add(d, s, out=d)
            best = d.argmin(axis=1)
            codes[p, at : at + size] = best
            errors[at : at + size] += d[np.arange(size), best].astype(np.int64)
    return codes, errors


def merge(a, b):
    """Adds the tensors of two tasks; None has seen no rows."""
    if a is None or b is None:
        return a if b is None else b
    a[0][...] += b[0]
    a[1][...] += b[1]
    return a


def _limit(dim: int) -> int:
    """The largest component for which a vector's error stays below 2**62."""
    return int((2**62 / max(dim, 1)) ** 0.5) // 2


def _integers(vectors: pa.Array, dim: int) -> np.ndarray:
    """[dimension, row] of floor(SCALE * x)."""
    n, sizes = len(vectors), np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.zeros((n, dim))
    x[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    limit = _limit(dim)
    with np.errstate(over="ignore"):
        return np.ascontiguousarray(np.floor(x * SCALE).clip(-limit, limit).astype(np.int64).T)


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, vector (array<double>), label of the rows that take part."""
    rows = table.select(table[id_col].alias("id"), table[vector_col].cast("array<double>").alias("vector"), table[label_col].alias("label"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col("vector").isNotNull() & finite)


def pack(rows: DataFrame, dim: int) -> DataFrame:
    """n, ids, labels, columns: blocks of rows of `usable`; columns is the int64 array [dim, n]."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, labels = b.column("id"), b.column("label")
                whole = pa.array([0, b.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32()), pa.ListArray.from_arrays(whole, ids), pa.ListArray.from_arrays(whole, labels), pa.array([_integers(b.column("vector"), dim).tobytes()], pa.binary())], names=["n", "ids", "labels", "columns"])

    return rows.mapInArrow(run, f"n int, ids array<{kinds['id']}>, labels array<{kinds['label']}>, columns binary")


def train(blocks: DataFrame, seeds: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS) -> Codebooks:
    """Rounds of assignment and floor(sum / count), from seeds[row, dimension]; entries that nothing chose stay."""
    sc, dim = blocks.sparkSession.sparkContext, seeds.shape[1]
    entries = np.ascontiguousarray(seeds.reshape(len(seeds), parts, dim // parts).transpose(1, 0, 2))
    rdd = blocks.select("n", "columns").rdd
    for _ in range(rounds):
        sent = sc.broadcast(entries)

        def add(seen, row, sent=sent):
            book = sent.value
            columns = np.frombuffer(row["columns"], np.int64).reshape(dim, row["n"])
            sums, counts = seen or (np.zeros(book.shape, np.int64), np.zeros(book.shape[:2], np.int64))
            codes, _ = assign(columns, book)
            for p, part in enumerate(np.split(columns, parts)):
                np.add.at(sums[p], codes[p], part.T)
                np.add.at(counts[p], codes[p], 1)
            return sums, counts

        total = rdd.treeAggregate(None, add, merge, DEPTH)
        if total is not None:
            sums, counts = total
            used = counts > 0
            entries = entries.copy()
            entries[used] = sums[used] // counts[used][:, None]
        sent.unpersist()
    return Codebooks(entries)


def encode(blocks: DataFrame, books: Codebooks) -> DataFrame:
    """id, label, code, error of each row of the blocks."""
    sent, parts, dim = blocks.sparkSession.sparkContext.broadcast(books.entries), books.entries.shape[0], books.entries.shape[0] * books.entries.shape[2]
    kinds = {f.name: f.dataType.elementType.simpleString() for f in blocks.schema if f.name in ("ids", "labels")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n = b.column("n")[i].as_py()
                codes, errors = assign(np.frombuffer(b.column("columns")[i].as_buffer(), np.int64).reshape(dim, n), sent.value)
                text = codes.T.astype(np.uint8).tobytes().hex()
                written = [text[at : at + 2 * parts] for at in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, b.column("labels")[i].values, pa.array(written, pa.string()), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"id {kinds['ids']}, label {kinds['labels']}, code string, error bigint")


def _with_label_errors(coded: DataFrame, folder: str) -> DataFrame:
    """coded with label_error. Labels that hold more than a share of the rows are few by definition and broadcast; the
    others join by hash, where none of them is hot."""
    least = coded.count() // HOT_SHARE
    sums = materialize(coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")), f"{folder}/labels").withColumnRenamed("label", "of")
    hot, rest = sums.where(F.col("n") > least), sums.where(F.col("n") <= least)
    same = F.col("label").eqNullSafe(F.col("of"))
    near = coded.join(F.broadcast(hot), same, "left")
    known = F.col("n").isNotNull()
    if rest.isEmpty():
        return near.drop("of", "n")
    far = near.where(~known).drop("of", "n", "label_error").join(rest, same)
    return near.where(known).drop("of", "n").unionByName(far.drop("of", "n"))


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(vec_id, code, error, label_error of each usable row, the codebooks)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part")
    spark = table.sparkSession
    folder = shared_dir(spark)
    small_batches(spark, rows=4096, mb=8)
    rows = usable(table, id_col, vector_col, label_col)
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    dim = -(-max(longest, 1) // parts) * parts
    first = rows.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    seeds = _integers(pa.array([r.vector for r in first], pa.list_(pa.float64())), dim).T
    blocks = materialize(pack(rows, dim), f"{folder}/blocks", 16 << 20)
    books = train(blocks, seeds, parts, rounds)
    coded = materialize(encode(blocks, books), f"{folder}/coded")
    return _with_label_errors(coded, folder).select(F.col("id").alias("vec_id"), "code", "error", "label_error"), books
